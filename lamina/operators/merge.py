"""Keyed merge of a source into a target as one DataFrame plan.

Parquet tables cannot be updated in place, so a merge yields the next snapshot
of the target together with what happened to each row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators.joins import fits_broadcast
from lamina.session import stored

ACTION = "_action"
BEFORE = "_before"


class MergeKeyError(ValueError):
    """The source repeats a key or lacks one, so the merge has no single outcome."""


def as_list(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def check_source(source: DataFrame, keys: Sequence[str]) -> int:
    """Number of source rows, after making sure keys are present and unique.

    One aggregation, combined on the map side, so repeated keys do not pile up.
    """
    missing = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    per_key = source.groupBy(*keys).agg(F.count("*").alias("n"))
    rows, most, absent = per_key.agg(F.sum("n"), F.max("n"), F.sum(F.when(missing, F.col("n")))).first()
    if absent:
        raise MergeKeyError(f"{absent} source rows have no value in {', '.join(keys)}")
    if (most or 0) > 1:
        raise MergeKeyError(f"source rows are not unique in {', '.join(keys)}")
    return rows or 0


def differs(columns: Sequence[str], left: str = "t", right: str = "s") -> Column:
    """Null-safe: true if any of the columns differ between two aliased sides."""
    parts = [~F.col(f"{left}.`{c}`").eqNullSafe(F.col(f"{right}.`{c}`")) for c in columns]
    return reduce(Column.__or__, parts)


def not_older(column: str) -> Column:
    """The source row is at least as new as the target row; no time counts as oldest."""
    held, sent = F.col(f"t.`{column}`"), F.col(f"s.`{column}`")
    return F.coalesce(sent >= held, held.isNull())


@dataclass(frozen=True)
class MergeResult:
    """Rows of both sides with the action taken: kept, inserted, updated or deleted.

    With images an updated row has what it was before, as a struct.
    """

    actions: DataFrame

    @property
    def snapshot(self) -> DataFrame:
        return self.actions.where(F.col(ACTION) != "deleted").drop(ACTION, BEFORE)

    def counts(self) -> DataFrame:
        return self.actions.groupBy(F.col(ACTION).alias("Action")).agg(F.count("*").alias("Rows"))


def _condition(keys: Sequence[str], also: str | None) -> Column:
    on = reduce(Column.__and__, [F.col(f"t.`{k}`") == F.col(f"s.`{k}`") for k in keys])
    return on & F.expr(also) if also else on


def _side(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def _pairs(target: DataFrame, source: DataFrame, keys: Sequence[str], also: str | None, small: bool) -> DataFrame:
    """Rows ``(t, s)`` of both sides, either of which is null where unmatched.

    With a source small enough to broadcast the target is never shuffled: it is
    left-joined to the source, and the few keys that matched decide the inserts.
    """
    t, s, on = _side(target, "t"), _side(source, "s"), _condition(keys, also)
    if not small:
        # Keys beside the rows let Spark see that a side is dealt out by them already, as cleaned rows are, and not move it again.
        t, s = (side.withColumns({f"_{n}{i}": F.col(f"{n}.`{k}`") for i, k in enumerate(keys)}) for n, side in (("t", t), ("s", s)))
        met = reduce(Column.__and__, [F.col(f"_t{i}") == F.col(f"_s{i}") for i in range(len(keys))])
        return t.join(s, met & F.expr(also) if also else met, "full_outer").select("t", "s")
    held = t.join(F.broadcast(s), on, "left")
    matched = t.join(F.broadcast(s), on, "inner").select(*[F.col(f"s.`{k}`").alias(k) for k in keys]).distinct()
    fresh = source.join(F.broadcast(matched), list(keys), "left_anti").select(*[F.col(f"`{c}`") for c in source.columns])
    return held.unionByName(_side(fresh, "s").withColumn("t", F.lit(None).cast(t.schema["t"].dataType)))


def merge(
    target: DataFrame | None,
    source: DataFrame,
    keys: str | Sequence[str],
    *,
    match_also: str | None = None,
    delete_when: str | None = None,
    update_when: Column | str | None = None,
    update_set: Mapping[str, str] | None = None,
    insert: bool = True,
    images: bool = False,
    checked: bool = False,
    small: bool | None = None,
) -> MergeResult:
    """Upsert ``source`` into ``target``.

    Conditions are SQL over the aliases ``t`` and ``s``.  A matched row is first
    tested for deletion, then for update; an update takes every source column, or
    only ``update_set`` (target column to SQL).  Columns the target lacks are
    added.  A missing target yields the source.  ``images`` adds the row before an update, for the change feed.
    ``checked`` says that the source is known to have its keys present and unique, so they are not counted again;
    ``small`` whether it is small enough to broadcast, which is else found by reading some of it.
    """
    keys = as_list(keys)
    if not checked:
        check_source(source, keys)
    if target is None:
        fresh = source.withColumn(ACTION, F.lit("inserted"))
        return MergeResult(fresh.withColumn(BEFORE, F.lit(None).cast(source.schema)) if images else fresh)
    pairs = _pairs(target, source, keys, match_also, fits_broadcast(source) if small is None else small)
    return _resolved(pairs, target, source, delete_when, update_when, update_set, insert, images)


def _resolved(
    pairs: DataFrame,
    target: DataFrame,
    source: DataFrame,
    delete_when: str | None,
    update_when: Column | str | None,
    update_set: Mapping[str, str] | None,
    insert: bool,
    images: bool,
) -> MergeResult:
    """What becomes of pairs ``(t, s)``, however they were matched."""
    both = F.col("t").isNotNull() & F.col("s").isNotNull()
    remove = F.expr(delete_when) if delete_when else F.lit(False)
    change = F.expr(update_when) if isinstance(update_when, str) else update_when
    action = (
        F.when(both & F.coalesce(remove, F.lit(False)), "deleted")
        .when(both & (F.lit(True) if change is None else F.coalesce(change, F.lit(False))), "updated")
        .when(F.col("t").isNotNull(), "kept")
        .otherwise("inserted")
    )
    kinds = {f.name: f.dataType for f in source.schema.fields} | {f.name: f.dataType for f in target.schema.fields}
    acted = pairs.withColumn(ACTION, action)
    if not insert:
        acted = acted.where(F.col(ACTION) != "inserted")
    columns, earlier = [], []
    for name in [*target.columns, *[c for c in source.columns if c not in target.columns]]:
        held = F.col(f"t.`{name}`") if name in target.columns else F.lit(None)
        sent = F.col(f"s.`{name}`") if name in source.columns else F.lit(None)
        if update_set is not None:
            updated = F.expr(update_set[name]) if name in update_set else held
        else:
            updated = sent if name in source.columns else held
        value = F.when(F.col(ACTION) == "updated", updated).when(F.col(ACTION) == "inserted", sent).otherwise(held)
        columns.append(value.cast(kinds[name]).alias(name))
        earlier.append(held.cast(kinds[name]).alias(name))
    before = [F.when(F.col(ACTION) == "updated", F.struct(*earlier)).alias(BEFORE)] if images else []
    return MergeResult(acted.select(*columns, ACTION, *before))


def merge_changed(
    target: DataFrame | None,
    source: DataFrame,
    keys: str | Sequence[str],
    compared: Sequence[str] | None = None,
    newest_by: str | None = None,
    images: bool = False,
    checked: bool = False,
    small: bool | None = None,
) -> MergeResult:
    """Keep only the present state per key (type 1): update where a compared column differs.

    With ``newest_by`` a row that arrives late does not replace a newer one.  ``checked`` and ``small`` as in ``merge``.
    """
    shared = [c for c in compared or () if c in source.columns]
    if target is not None and shared:
        added = [c for c in shared if c not in target.columns]
        for name in added:  # a column new to the target counts as null before
            target = target.withColumn(name, F.lit(None).cast(source.schema[name].dataType))
        guard = not_older(newest_by) if newest_by else F.lit(True)
        return merge(target, source, keys, update_when=differs(shared) & guard, images=images, checked=checked, small=small)
    update = not_older(newest_by) if newest_by and target is not None else None
    return merge(target, source, keys, update_when=update, images=images, checked=checked, small=small)


def _number(column: Column, kind: str) -> Column:
    """A place on a line of doubles, in the order of the column's values."""
    if kind.startswith("timestamp"):
        column = F.unix_micros(column.cast("timestamp"))
    elif kind == "date":
        column = F.unix_date(column)
    return column.cast("double")


def _within(value: Column, low: Column, high: Column) -> Column:
    return (low.isNull() | (value >= low)) & (high.isNull() | (value < high))


def interval_hits(points: DataFrame, spans: DataFrame, point: str, low: str, high: str, keys: Sequence[str] = ()) -> DataFrame:
    """(_point, _span): ids of rows with ``low <= point < high`` and equal ``keys``; a null bound is open.

    Points and spans have ids of these names and are stored.  A span belongs to the band whose width is the power of two above
    its length, and lies in two of the band's buckets or three; a point lies in one bucket of every band there is.  So
    both sides meet by equality, whatever the lengths, and rows within a bucket are checked.
    """
    kinds = dict(points.dtypes)
    at = _number(F.col(f"`{point}`"), kinds[point])
    least, most = points.agg(F.min(at), F.max(at)).first()
    if least is None:
        return points.select("_point", F.lit(None).cast("long").alias("_span")).limit(0)
    bounds = dict(spans.dtypes)
    start = F.coalesce(_number(F.col(f"`{low}`"), bounds[low]), F.lit(least))
    end = F.coalesce(_number(F.col(f"`{high}`"), bounds[high]), F.lit(most + 1))
    # Ends beyond all points make no buckets.
    start, end = F.greatest(start, F.lit(least)), F.least(end, F.lit(most + 1))
    banded = spans.select("*", start.alias("_start"), end.alias("_end")).where("_start < _end")
    banded = banded.withColumn("_band", F.ceil(F.log2(F.col("_end") - F.col("_start"))).cast("int"))
    bands = sorted(r[0] for r in banded.select("_band").distinct().collect())  # at most a few hundred powers of two
    width = F.pow(F.lit(2.0), F.col("_band"))
    buckets = F.sequence(F.floor(F.col("_start") / width), F.floor(F.col("_end") / width))
    banded = banded.select("_span", *[F.col(f"`{k}`").alias(f"_s_{k}") for k in keys], F.col(f"`{low}`").alias("_low"), F.col(f"`{high}`").alias("_high"), "_band", F.explode(buckets).alias("_bucket"))
    placed = points.where(at.isNotNull()).select("_point", *[F.col(f"`{k}`").alias(f"_p_{k}") for k in keys], F.col(f"`{point}`").alias("_value"), at.alias("_at"))
    placed = placed.withColumn("_in", F.explode(F.array(*[F.lit(b) for b in bands]).cast("array<int>")))
    placed = placed.withColumn("_place", F.floor(F.col("_at") / F.pow(F.lit(2.0), F.col("_in"))))
    on = (F.col("_in") == F.col("_band")) & (F.col("_place") == F.col("_bucket")) & _within(F.col("_value"), F.col("_low"), F.col("_high"))
    for k in keys:
        on = on & (F.col(f"_p_{k}") == F.col(f"_s_{k}"))
    return placed.join(banded, on).select("_point", "_span")


def merge_between(
    target: DataFrame,
    source: DataFrame,
    point: str,
    low: str,
    high: str,
    keys: str | Sequence[str] = (),
    *,
    delete_when: str | None = None,
    update_when: Column | str | None = None,
    update_set: Mapping[str, str] | None = None,
    insert: bool = True,
    images: bool = False,
) -> MergeResult:
    """``merge`` where a target row matches the source row whose span ``[low, high)`` holds its ``point``.

    Equality of ``keys`` may be asked for as well, but need not.  A source row may match many target rows; a target row that
    matches several source rows is refused, as there is no single outcome.  Null points and empty spans match nothing; a
    null bound is open.  Both sides are stored with row ids, and only ids, keys and bounds are matched.
    """
    keys = as_list(keys)
    t = stored(_side(target, "t").withColumn("_point", F.monotonically_increasing_id()), "merge-target")
    s = stored(_side(source, "s").withColumn("_span", F.monotonically_increasing_id()), "merge-source")
    points = t.select("_point", F.col(f"t.`{point}`").alias(point), *[F.col(f"t.`{k}`").alias(k) for k in keys])
    spans = s.select("_span", F.col(f"s.`{low}`").alias(low), F.col(f"s.`{high}`").alias(high), *[F.col(f"s.`{k}`").alias(k) for k in keys])
    hits = stored(interval_hits(points, spans, point, low, high, keys), "merge-hits")
    many = hits.groupBy("_point").count().where("count > 1").count()
    if many:
        raise MergeKeyError(f"{many} target rows are within several source spans")
    matched = t.join(hits, "_point", "left").join(s, "_span", "left").select("t", "s")
    fresh = s.join(hits.select("_span").distinct(), "_span", "left_anti").select(F.lit(None).cast(t.schema["t"].dataType).alias("t"), "s")
    return _resolved(matched.unionByName(fresh), target, source, delete_when, update_when, update_set, insert, images)
