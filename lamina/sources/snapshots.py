"""Tables kept as numbered snapshots, each written to its own folder.

A snapshot becomes visible when its row in the small ``_commits`` table is
written, after its data.  A run that dies in between leaves no visible change,
and its successor overwrites the same folder.  One writer per table.

Data that breaks a constraint is refused between the two: predicates are counted in the pass that
writes the data, keys are checked on what was written, and only clean data is committed.

A merge that hands over row images is stored by action, so the change feed of a version is part of its
snapshot: reading it touches the changed rows only.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from lamina.contracts import CURRENT
from lamina.functions.times import moment, utc
from lamina.operators import quality
from lamina.operators.history import is_current
from lamina.operators.merge import ACTION, BEFORE
from lamina.session import PACKED, path_exists

COMMITS = "version int, committed_at timestamp, operation string, rows bigint, inserted bigint, updated bigint, deleted bigint"


def commits(spark: SparkSession, base: str) -> DataFrame:
    """Version log of a table; empty if nothing was committed."""
    log = f"{base}/_commits"
    return spark.read.schema(COMMITS).parquet(log) if path_exists(spark, log) else spark.createDataFrame([], COMMITS)


def version_log(spark: SparkSession, base: str, limit: int = 20) -> DataFrame:
    return commits(spark, base).orderBy(F.desc("version")).limit(limit)


def last_version(spark: SparkSession, base: str, at: dt.datetime | None = None) -> int | None:
    """Newest version, or the newest committed no later than ``at``."""
    log = commits(spark, base)
    if at is not None:
        log = log.where(F.col("committed_at") <= moment(at))
    return log.agg(F.max("version")).first()[0]


def _record(spark: SparkSession, base: str, version: int, at: dt.datetime, operation: str, seen: dict) -> dict:
    row = {
        "version": version,
        "committed_at": utc(at),
        "operation": operation,
        **{k: int(seen.get(k) or 0) for k in ("rows", "inserted", "updated", "deleted")},
    }
    spark.createDataFrame([tuple(row.values())], COMMITS).coalesce(1).write.mode("append").parquet(f"{base}/_commits")
    return row


def _row_rules(rules: Sequence[quality.Rule]) -> list[quality.RowRule]:
    return [r for r in rules if isinstance(r, quality.RowRule)]


def _broken(df: DataFrame, rules: Sequence[quality.Rule], live: Column) -> list[Column]:
    """Rows that break each row rule, as measures of the pass that writes them."""
    return [F.count_if(live & r.predicate(df)).alias(f"broken_{i}") for i, r in enumerate(_row_rules(rules))]


def _refuse_broken(written: DataFrame, rules: Sequence[quality.Rule], seen: Mapping) -> None:
    """Raise if what was written breaks a rule: row rules from their counts, key rules by reading the key columns."""
    broken = {r.name: seen.get(f"broken_{i}") or 0 for i, r in enumerate(_row_rules(rules))}
    keys = quality.offending_keys(written, rules)
    if keys is not None:
        broken |= {r["RuleName"]: r["n"] for r in keys.groupBy("RuleName").agg(F.sum("n").alias("n")).collect()}
    found = [f"{name}: {n} rows" for name, n in sorted(broken.items()) if n]
    if found:
        raise quality.ConstraintViolated("; ".join(found))


def table_constraints(spark: SparkSession, base: str) -> list[quality.Rule]:
    """The constraints kept with a table, as rules that every later write must meet."""
    place = f"{base}/_constraints"
    if not path_exists(spark, place):
        return []
    notes = [json.loads(r["value"]) for r in spark.read.text(place).collect()]
    checks = {name: text for n in notes for name, text in n["checks"].items()}
    keys = [n["primary_key"] for n in notes if n["primary_key"]]
    return [*quality.constraints(checks), *[rule for key in keys for rule in quality.constraints({}, key)]]


def add_constraints(spark: SparkSession, base: str, checks: Mapping[str, str], primary_key: Sequence[str] = ()) -> None:
    """Keep constraints with a table: SQL checks by name (null passes), and a primary key.

    Refused if the rows of today break one, if a name is taken, or if there is a primary key already.
    """
    rules, held = quality.constraints(checks, primary_key), table_constraints(spark, base)
    taken = {r.name for r in held} & {r.name for r in rules}
    if taken or (primary_key and any(isinstance(r, quality.UniqueRule) for r in held)):
        raise ValueError(f"constraint there already: {', '.join(sorted(taken)) or 'primary key'}")
    version = last_version(spark, base)
    stored = None if version is None else _rows(spark.read.parquet(f"{base}/version={version}"))
    current = stored if stored is None or CURRENT not in stored.columns else stored.where(is_current())
    if current is not None:
        quality.enforce(current, rules)
    note = json.dumps({"checks": dict(checks), "primary_key": list(primary_key)})
    spark.createDataFrame([(note,)], "value string").coalesce(1).write.mode("append").text(f"{base}/_constraints")


def write_snapshot(df: DataFrame, base: str, at: dt.datetime, operation: str = "write", checks: Sequence[quality.Rule] = ()) -> dict:
    """Write the next snapshot and commit it; returns its log row.

    Rows are counted while they are written.  A frame with an ``_action`` column (see ``merge``) has its actions
    counted, and deleted rows are no part of the snapshot.  With row images too (``merge(images=True)``) it is
    stored by action, and ``read_changes`` can read what it changed.

    The rows must meet ``checks`` and the table's own constraints; else ``ConstraintViolated`` is raised and the
    version before stays the newest.
    """
    spark = df.sparkSession
    version = (last_version(spark, base) or 0) + 1
    rules = [*checks, *table_constraints(spark, base)]
    seen, path = Observation(), f"{base}/version={version}"
    action = F.col(ACTION) if ACTION in df.columns else F.lit("written")
    live = action != "deleted"
    measures = [F.count_if(live).alias("rows"), *_broken(df, rules, live)]
    if ACTION in df.columns:
        measures += [F.count_if(action == k).alias(k) for k in ("inserted", "updated", "deleted")]
    out = df.observe(seen, *measures)
    if BEFORE in df.columns:
        out.write.options(**PACKED).mode("overwrite").partitionBy(ACTION).parquet(path)
    elif ACTION in df.columns:
        out.where(live).drop(ACTION).write.options(**PACKED).mode("overwrite").parquet(path)
    else:
        out.write.options(**PACKED).mode("overwrite").parquet(path)
    if rules:
        _refuse_broken(_rows(spark.read.schema(df.schema).parquet(path)), rules, seen.get)
    return _record(spark, base, version, at, operation, seen.get)


def _rows(stored: DataFrame) -> DataFrame:
    """The rows of a snapshot, however it was stored."""
    if BEFORE not in stored.columns:
        return stored.drop(ACTION)
    return stored.where(F.col(ACTION) != "deleted").drop(ACTION, BEFORE)


def keeps_feed(spark: SparkSession, base: str, version: int) -> bool:
    return path_exists(spark, f"{base}/version={version}") and BEFORE in spark.read.parquet(f"{base}/version={version}").columns


def read_changes(spark: SparkSession, base: str, first: int, last: int | None = None) -> DataFrame:
    """The change feed that the loads of versions ``first`` to ``last`` (by default the newest) left.

    Rows as they are in the newest of these versions, with ``_change_type`` (insert, delete and both images of an update),
    ``_commit_version`` and ``_commit_timestamp``.  Rows that a load kept are not read.  A rewrite that only clusters rows
    changes none; any other version stored without images is refused.
    """
    log = {r["version"]: r for r in commits(spark, base).where(F.col("version").between(first, last or (1 << 31) - 1)).collect()}
    if not log:
        raise ValueError(f"no versions from {first} on")
    with_feed = [v for v in sorted(log) if keeps_feed(spark, base, v)]
    without = [v for v in sorted(log) if v not in with_feed and log[v]["operation"] != "cluster"]
    if without:
        raise ValueError(f"versions without a change feed: {', '.join(map(str, without))}")
    if not with_feed:
        raise ValueError("no version of the range changed rows")
    parts = []
    for version in with_feed:
        stored = spark.read.parquet(f"{base}/version={version}").where(F.col(ACTION).isin("inserted", "updated", "deleted"))
        names = [c for c in stored.columns if c not in (ACTION, BEFORE)]
        row, action = F.struct(*[F.col(f"`{c}`") for c in names]), F.col(ACTION)
        kind = F.element_at(F.create_map(*[F.lit(x) for x in ("inserted", "insert", "updated", "update_postimage", "deleted", "delete")]), action)
        entry = lambda kind, image: F.struct(kind.alias("_change_type"), image.alias("_row"))
        entries = F.array_compact(F.array(F.when(action == "updated", entry(F.lit("update_preimage"), F.col(BEFORE))), entry(kind, row)))
        part = stored.select(F.explode(entries).alias("e")).select("e._row.*", "e._change_type")
        parts.append(part.withColumns({"_commit_version": F.lit(version), "_commit_timestamp": F.lit(log[version]["committed_at"])}))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_snapshot(
    spark: SparkSession, base: str, version: int | None = None, at: dt.datetime | None = None
) -> DataFrame | None:
    """A table as of a version or moment, by default now; None if it had no rows yet."""
    if version is None:
        version = last_version(spark, base, at)
    return None if version is None else _rows(spark.read.parquet(f"{base}/version={version}"))


def write_history(rows: DataFrame, base: str, at: dt.datetime, operation: str = "scd2", checks: Sequence[quality.Rule] = ()) -> dict:
    """Commit what a load did to a history: current rows, and rows it closed.

    The current rows must meet ``checks`` and the table's own constraints, as in ``write_snapshot``.

    ``rows`` come from ``advance``.  They are stored by version and flag, so rows
    closed by earlier loads stay where they are and are never rewritten.
    """
    spark = rows.sparkSession
    version = (last_version(spark, base) or 0) + 1
    rules = [*checks, *table_constraints(spark, base)]
    seen = Observation()
    opened = F.col(CURRENT) & (F.col("EffectiveStartDate") == moment(at))
    out = rows.observe(
        seen,
        F.count_if(F.col(CURRENT)).alias("rows"),
        F.count_if(opened & (F.col("VersionNumber") == 1)).alias("inserted"),
        F.count_if(opened & (F.col("VersionNumber") > 1)).alias("updated"),
        F.count_if(~F.col(CURRENT)).alias("closed"),
        *_broken(rows, rules, F.col(CURRENT)),
    )
    out.write.options(**PACKED).mode("overwrite").partitionBy(CURRENT).parquet(f"{base}/version={version}")
    if rules:
        written = spark.read.schema(rows.schema).parquet(f"{base}/version={version}")
        _refuse_broken(written.where(is_current()), rules, seen.get)
    counts = dict(seen.get)
    # A version that a later one follows is an update; what only ends is a deletion.
    counts["deleted"] = max(0, (counts.get("closed") or 0) - (counts.get("updated") or 0))
    return _record(spark, base, version, at, operation, counts)


def read_history(
    spark: SparkSession, base: str, version: int | None = None, at: dt.datetime | None = None
) -> DataFrame | None:
    """Whole history as of a version: its current rows and all rows closed up to it."""
    if version is None:
        version = last_version(spark, base, at)
    if version is None:
        return None
    # Columns are only ever added, so the newest folder knows them all.
    newest = spark.read.parquet(f"{base}/version={version}").schema
    stored = spark.read.schema(newest.add("version", IntegerType())).parquet(base)
    upto, now = F.col("version") <= version, F.col("version") == version
    held = stored.where((now & is_current()) | (upto & ~is_current())).drop("version")
    return held.withColumn(CURRENT, is_current())  # a folder name holds the flag as text
