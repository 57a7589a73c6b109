"""Small helpers the corpus operators share: stored intermediate tables, spare names, a bounded row filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.session import work_dir

#: Slots of the broadcast row filter: a fixed bound on what is sent, whatever the corpus.
FILTER_SLOTS = 1 << 20


def stage(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` under the shared work folder and read it back.

    Cuts the lineage: a lost executor costs the tasks that were running, not the steps before.
    """
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spare(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, each with underscores put before it until no column of ``df`` has it (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")


def doc_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, as ``doc_id`` and ``text``; null text becomes empty."""
    return docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))


def slot(key: Column, slots: int = FILTER_SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots))


def maybe_in(df: DataFrame, key: Column, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose key may be among ``keys`` (one column), or with ``left_anti`` surely is not.

    The keys are folded to at most ``FILTER_SLOTS`` distinct numbers before they are sent out, so the
    broadcast has a fixed bound.  Rows let through in error are for the join that follows.
    """
    (name,) = spare(df, "slot_")
    found = keys.select(slot(F.col(keys.columns[0])).alias(name)).distinct()
    return df.withColumn(name, slot(key)).join(F.broadcast(found), name, how).drop(name)
