"""What both substring operators begin with: documents by identity, and one document of each group of equal texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.staging import maybe_in, stage

#: Stands for a null doc_id: after all others.
LAST_ID = (1 << 63) - 1


def identified(docs: DataFrame) -> DataFrame:
    """(doc, crc, text): a row is named by its id (null last) and a checksum of its text."""
    return docs.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc"), F.crc32(F.encode("text", "utf-8")).alias("crc"), "doc_id", "text")


def row_key(*columns: str) -> Column:
    return F.xxhash64(*columns)


def copies(rows: DataFrame, content: Column) -> DataFrame:
    """Stored (doc, crc, key, first) of the documents whose content another document has too; ``first`` marks
    the one with the smallest doc.

    Rows that repeat both doc and text are one document.  Both sides of the join are stored tables, so Spark can
    split one very large group.
    """
    named = stage(rows.select("doc", "crc", F.sha2(content, 256).alias("sha")), "text-names")
    ends = named.groupBy("sha").agg(F.min(F.struct("doc", "crc")).alias("low"), F.max(F.struct("doc", "crc")).alias("high"))
    several = stage(ends.where("low <> high").select("sha", "low"), "copied-texts")
    met = named.join(several, "sha").select("doc", "crc", row_key("doc", "crc").alias("key"), (F.struct("doc", "crc") == F.col("low")).alias("first"))
    return stage(met.distinct(), "copied-documents")


def without(rows: DataFrame, lost: DataFrame) -> DataFrame:
    """``rows`` whose (doc, crc) is not in ``lost``; only rows that may be are shuffled."""
    key = row_key("doc", "crc")
    sure = maybe_in(rows, key, lost.select("key"), "left_anti")
    asked = maybe_in(rows, key, lost.select("key"))
    return sure.unionByName(asked.join(lost.select("doc", "crc"), ["doc", "crc"], "left_anti"))


def beside(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``found`` (doc, crc, key, ...), null where it has no row; only rows that may have one are shuffled."""
    key = row_key("doc", "crc")
    extra = [c for c in found.columns if c not in ("doc", "crc", "key")]
    sure = maybe_in(rows, key, found.select("key"), "left_anti")
    for c in extra:
        sure = sure.withColumn(c, F.lit(None).cast(found.schema[c].dataType))
    asked = maybe_in(rows, key, found.select("key"))
    return sure.unionByName(asked.join(found.drop("key"), ["doc", "crc"], "left").select(*sure.columns))
