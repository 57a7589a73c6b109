"""Keyed history (type 2): every version of a row with the interval it held.

Intervals are half open, ``start <= t < end``, and one load uses one moment
``as_of`` for both closing and opening, so versions meet without a gap.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.contracts import CURRENT, END, HISTORY, START, VERSION
from lamina.functions.times import moment
from lamina.operators.merge import as_list, check_source, differs, not_older
from lamina.session import stored

# Texts that count as "current" besides a true boolean.
TRUE_TEXTS = ("true", "True", "1", "yes", "Y")


def is_current(column: str = CURRENT) -> Column:
    """True for a current row whatever type the flag was stored as; never null."""
    flag = F.col(column)
    return F.coalesce(flag.try_cast("boolean"), F.lit(False)) | F.coalesce(
        flag.cast("string").isin(*TRUE_TEXTS), F.lit(False)
    )


def filter_current(df: DataFrame, column: str = CURRENT) -> DataFrame:
    return df.where(is_current(column)) if column in df.columns else df.where(F.lit(False))


def open_versions(source: DataFrame, as_of: dt.datetime | Column, version: Column | int = 1) -> DataFrame:
    """First state of a history: every source row current from ``as_of``."""
    return source.withColumns(
        {
            START: moment(as_of).cast(HISTORY[START]),
            END: F.lit(None).cast(HISTORY[END]),
            CURRENT: F.lit(True),
            VERSION: (version if isinstance(version, Column) else F.lit(version)).cast(HISTORY[VERSION]),
        }
    )


def detect_changes(history: DataFrame, source: DataFrame, keys: str | Sequence[str], tracked: Sequence[str]) -> DataFrame:
    """Source rows whose current version differs in a tracked column."""
    keys = as_list(keys)
    held = filter_current(history).select(*keys, F.struct(*tracked).alias("t"))
    sent = source.select(*keys, F.struct(*source.columns).alias("s"))
    return sent.join(held, keys).where(differs(tracked)).select("s.*")


def detect_new_keys(history: DataFrame, source: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Source rows whose key has no current version."""
    keys = as_list(keys)
    return source.join(filter_current(history).select(*keys), keys, "left_anti")


def advance(
    history: DataFrame,
    source: DataFrame,
    keys: str | Sequence[str],
    tracked: Sequence[str],
    as_of: dt.datetime,
    close_missing: bool = False,
    newest_by: str | None = None,
) -> DataFrame:
    """Rows the load touches or keeps current: current versions and those it closes.

    Versions closed earlier are not among them, so a writer that stores closed
    rows apart leaves those files alone.  One full join of current rows with the
    source decides everything; each pair yields up to two rows.  With ``newest_by``
    a row that arrives late does not follow a newer version.
    """
    keys = as_list(keys)
    rows = history.withColumn(CURRENT, is_current())
    closed_before = rows.where(~F.col(CURRENT)).groupBy(*keys).agg(F.max(VERSION).alias("_before"))
    present = rows.where(F.col(CURRENT)).select(F.struct(*rows.columns).alias("t"))
    sent = source.join(closed_before, keys, "left").select(F.struct(*source.columns).alias("s"), "_before")
    on = reduce(Column.__and__, [F.col(f"t.`{k}`") == F.col(f"s.`{k}`") for k in keys])
    pairs = present.join(sent, on, "full_outer")

    held, arrived = F.col("t").isNotNull(), F.col("s").isNotNull()
    changed = held & arrived & differs(tracked)
    if newest_by:
        changed = changed & not_older(newest_by)
    closing = changed | (held & ~arrived) if close_missing else changed
    opening = arrived & (~held | changed)
    now = moment(as_of).cast(HISTORY[START])
    last = F.coalesce(F.col(f"t.{VERSION}"), F.col("_before"), F.lit(0))

    kinds = {f.name: f.dataType for f in source.schema.fields} | {f.name: f.dataType for f in rows.schema.fields}
    names = [c for c in rows.columns if c not in HISTORY]
    names += [c for c in source.columns if c not in rows.columns]
    before, after = [], []
    for name in names:
        old = F.col(f"t.`{name}`") if name in rows.columns else F.lit(None)
        new = F.col(f"s.`{name}`") if name in source.columns else F.lit(None)
        before.append(old.cast(kinds[name]).alias(name))
        after.append(new.cast(kinds[name]).alias(name))
    before += [
        F.col(f"t.{START}").alias(START),
        F.when(closing, now).otherwise(F.col(f"t.{END}")).alias(END),
        (~closing).alias(CURRENT),
        F.col(f"t.{VERSION}").cast("int").alias(VERSION),
    ]
    after += [
        now.alias(START),
        F.lit(None).cast(HISTORY[END]).alias(END),
        F.lit(True).alias(CURRENT),
        (last + 1).cast("int").alias(VERSION),
    ]
    outcome = F.array_compact(F.array(F.when(held, F.struct(*before)), F.when(opening, F.struct(*after))))
    return pairs.select(F.explode(outcome).alias("_row")).select("_row.*")


def apply_history(
    history: DataFrame | None,
    source: DataFrame,
    keys: str | Sequence[str],
    tracked: Sequence[str],
    as_of: dt.datetime,
    close_missing: bool = False,
) -> DataFrame:
    """Whole history after a load: earlier closed rows plus what ``advance`` yields.

    Keys absent from the source stay current unless ``close_missing``.  A key
    that returns continues its numbering.  The same source applied again changes
    nothing.  Repeated or missing source keys are refused.
    """
    keys = as_list(keys)
    tracked = [c for c in tracked if c in source.columns]
    if not tracked:
        raise ValueError("none of the tracked columns is in the source")
    check_source(source, keys)
    if history is None or CURRENT not in history.columns:
        return open_versions(source, as_of)
    unknown = [c for c in tracked if c not in history.columns]
    history = history.withColumns({c: F.lit(None).cast(source.schema[c].dataType) for c in unknown})
    closed = history.withColumn(CURRENT, is_current()).where(~F.col(CURRENT))
    return closed.unionByName(
        advance(history, source, keys, tracked, as_of, close_missing), allowMissingColumns=True
    )


def in_ranges(log: DataFrame, keys: Sequence[str], order: Sequence[str], max_rows: int) -> DataFrame:
    """The stored log with ``_chunk``: numbers of ranges of ``max_rows`` rows in the order of keys and ``order``.

    Spark samples where partitions end, so each holds about as many rows as another, whatever share of the log one key has;
    there are as many as the session shuffles into.  Inside a partition rows are sorted and numbered, and every ``max_rows``
    of them are a range.  So more ranges are more numbers, not more tasks or files.
    """
    # The id of a row holds its partition above bit 33 and its place in it below.
    placed = log.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_id", F.monotonically_increasing_id())
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    placed = stored(placed.select("*", part.alias("_part"), F.floor(place / max_rows).alias("_range")).drop("_id"), "log-ranges")
    stride = 1 + (placed.agg(F.max("_range")).first()[0] or 0)
    return placed.withColumn("_chunk", F.col("_part") * stride + F.col("_range")).drop("_part", "_range")


def _opens(first: Column, prior: Column) -> Column:
    """Whether the first state of a stretch is a change after the state before it; there may be none."""
    return prior.isNull() | ~first.eqNullSafe(prior)


def settled(nodes: DataFrame, keys: Sequence[str], fan: int) -> DataFrame:
    """For stretches of a key's timeline, what stands around each: (keys, _chunk, _before, _offset, _next).

    ``nodes`` sum up a stretch: ``_first`` and ``_last`` state, ``_at`` of the first, ``_n`` changes inside and ``_change`` time of
    the first of these.  Two stretches that follow each other sum up to one of the same form, in any grouping.  So
    ``fan`` of them at a time become one of a level above, up to one per key; on the way back each learns the
    state before it, how many versions came before and when the next one starts.  No window holds more
    than ``fan`` rows of a key.
    """
    most = nodes.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    top = most <= fan
    if not top:
        nodes = nodes.withColumn("_group", F.floor(F.col("_chunk") / fan))
    group = [*keys] if top else [*keys, "_group"]
    order = Window.partitionBy(*group).orderBy("_chunk")
    upto, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    prior = F.lag("_last").over(order)
    if top:
        nodes = nodes.withColumns({"_outer": F.lit(None).cast(nodes.schema["_last"].dataType), "_passed": F.lit(0).cast("long"), "_then": F.lit(None).cast(nodes.schema["_at"].dataType)})
    else:
        within = nodes.withColumn("_prior", prior)
        opens = F.col("_prior").isNotNull() & ~F.col("_first").eqNullSafe(F.col("_prior"))
        change = F.when(opens, F.col("_at")).otherwise(F.col("_change"))
        above = within.groupBy(*group).agg(
            F.min_by("_first", "_chunk").alias("_first"),
            F.min_by("_at", "_chunk").alias("_at"),
            F.max_by("_last", "_chunk").alias("_last"),
            F.sum(F.col("_n") + opens.cast("long")).alias("_n"),
            F.min_by(change, F.when(change.isNotNull(), F.col("_chunk"))).alias("_change"),
        )
        above = stored(above.withColumnRenamed("_group", "_chunk"), "log-level")
        outer = settled(above, keys, fan)
        outer = outer.select(*keys, F.col("_chunk").alias("_group"), F.col("_before").alias("_outer"), F.col("_offset").alias("_passed"), F.col("_next").alias("_then"))
        nodes = nodes.join(outer, group)
    nodes = nodes.withColumn("_before", F.coalesce(prior, F.col("_outer")))
    opens = _opens(F.col("_first"), F.col("_before"))
    nodes = nodes.withColumns({"_real": F.col("_n") + opens.cast("long"), "_from": F.when(opens, F.col("_at")).otherwise(F.col("_change"))})
    return nodes.select(
        *keys,
        "_chunk",
        "_before",
        (F.col("_passed") + F.coalesce(F.sum("_real").over(upto), F.lit(0))).alias("_offset"),
        F.coalesce(F.first("_from", ignorenulls=True).over(after), F.col("_then")).alias("_next"),
    )


def history_from_log(log: DataFrame, keys: str | Sequence[str], tracked: Sequence[str], at: str, sequence: str, max_rows: int = 5_000_000) -> DataFrame:
    """History of a change log holding many changes per key; rows without a key are left out.

    A window over a key would put all its changes into one task.  Where a key has more than ``max_rows``, the log is cut
    into ranges of about equal size, in which windows run, and what stands around each range comes from
    summaries merged level by level (``settled``).  Keys with few changes are not cut finer for it.
    """
    keys = as_list(keys)
    known = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    steps = log.where(known).select(*keys, at, sequence, F.struct(*tracked).alias("_state"))
    cut = (steps.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > max_rows
    steps = in_ranges(steps, keys, [at, sequence], max_rows) if cut else steps
    part = [*keys, "_chunk"] if cut else keys
    inside = Window.partitionBy(*part).orderBy(at, sequence)
    # Drop rows equal to the one before them; the first of a range stays for now.
    steps = steps.withColumns({"_prior": F.lag("_state").over(inside), "_n": F.row_number().over(inside)})
    moved = steps.where((F.col("_n") == 1) | ~F.col("_state").eqNullSafe(F.col("_prior")))
    offset, following = F.lit(0), F.lit(None).cast(log.schema[at].dataType)
    if cut:
        moved = stored(moved.drop("_prior"), "log-changes")
        first, later = F.col("_n") == 1, F.col("_n") > 1
        nodes = moved.groupBy(*part).agg(
            F.max_by("_state", F.when(first, F.lit(1))).alias("_first"),
            F.max(F.when(first, F.col(at))).alias("_at"),
            F.max_by("_state", F.struct(at, sequence)).alias("_last"),
            F.count_if(later).alias("_n"),
            F.min(F.when(later, F.col(at))).alias("_change"),
        )
        around = stored(settled(stored(nodes, "log-summaries"), keys, max(2, max_rows)), "log-borders")
        moved = moved.join(around, part).where((F.col("_n") > 1) | _opens(F.col("_state"), F.col("_before")))
        offset, following = F.col("_offset"), F.col("_next")
    numbered = moved.withColumns({"_rank": F.row_number().over(inside), "_until": F.lead(at).over(inside)})
    end = F.coalesce("_until", following)
    return numbered.select(
        *keys,
        "_state.*",
        F.col(at).alias(START),
        end.alias(END),
        end.isNull().alias(CURRENT),
        (offset + F.col("_rank")).cast("int").alias(VERSION),
    )


def valid_at(history: DataFrame, at: dt.datetime | Column) -> DataFrame:
    """Rows of the history that held at a moment."""
    at = moment(at)
    return history.where((F.col(START) <= at) & (F.col(END).isNull() | (F.col(END) > at)))


def version_counts(history: DataFrame, limit: int | None = 20) -> DataFrame:
    """What each version number brought: rows inserted or updated, closed since, and current.

    The newest ``limit`` versions, or all.
    """
    n = F.col(VERSION)
    counts = (
        history.groupBy(VERSION)
        .agg(
            F.count_if(n == 1).alias("Inserted"),
            F.count_if(n > 1).alias("Updated"),
            F.count_if(~is_current()).alias("Closed"),
            F.count_if(is_current()).alias("CurrentRows"),
        )
        .orderBy(F.desc(VERSION))
    )
    return counts if limit is None else counts.limit(limit)


def changes_between(old: DataFrame, new: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Change feed of two snapshots: inserts, deletes, and both images of an update."""
    keys = as_list(keys)
    kinds = {f.name: f.dataType for f in old.schema.fields} | {f.name: f.dataType for f in new.schema.fields}

    def image(df: DataFrame, name: str) -> DataFrame:
        row = [(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]
        return df.select(F.struct(*row).alias(name))

    on = reduce(Column.__and__, [F.col(f"t.`{k}`") == F.col(f"s.`{k}`") for k in keys])
    pairs = image(old, "t").join(image(new, "s"), on, "full_outer")
    gone, came = F.col("s").isNull(), F.col("t").isNull()
    rest = [c for c in kinds if c not in keys]
    changed = ~gone & ~came & (differs(rest) if rest else F.lit(False))

    def entry(condition: Column, kind: Column, row: str) -> Column:
        return F.when(condition, F.struct(kind.alias("_change_type"), F.col(row).alias("_row")))

    feed = F.array_compact(
        F.array(
            entry(gone | changed, F.when(gone, "delete").otherwise("update_preimage"), "t"),
            entry(came | changed, F.when(came, "insert").otherwise("update_postimage"), "s"),
        )
    )
    return pairs.select(F.explode(feed).alias("e")).select("e._row.*", "e._change_type")
