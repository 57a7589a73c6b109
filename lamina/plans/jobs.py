"""The jobs of the platform as plain functions over a lake folder.

Everything a later step reads more than once is a stored table, so no step is
computed twice, and a lost executor costs only the tasks it held.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass
from functools import reduce
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lamina.contracts import BATCH_ID, ENTITIES, HISTORY, INGESTION_DATE, entity
from lamina.operators import monitoring, quality
from lamina.operators.cleaning import clean
from lamina.operators.history import advance, filter_current, open_versions
from lamina.operators.joins import MAX_ROWS
from lamina.operators.layout import cluster
from lamina.operators.lineage import add_lineage, batch_id, lacks_lineage, lineage_report
from lamina.operators.merge import merge_changed
from lamina.plans import marts, suites, views
from lamina.session import PACKED, freeing_shuffles, path_bytes, path_exists, remove
from lamina.sources import inference
from lamina.sources.landing import rescued_rows, scan, split_bad_records
from lamina.sources.snapshots import (
    commits,
    keeps_feed,
    last_version,
    read_history,
    read_snapshot,
    version_log,
    write_history,
    write_snapshot,
)
from lamina.sources.tables import register_layer
from lamina.streaming.files import ingest, write_typed

# The marts that are clustered, and by what.
MART_CLUSTERING = {
    "revenue_analytics": ("PaymentDate", "Hospital", "Department"),
    "patient_summary": ("PatientID", "InsuranceID"),
    "doctor_performance": ("DoctorID", "Department"),
}
# Columns of clustered marts that are made anew instead of being moved.
MART_DERIVED = {"revenue_analytics": marts.payment_period}
HISTORY_ENTITY = "patients"
# The entities whose cleaned rows the advisory checks of the silver job read.
CHECKED = ("patients", "doctors", "appointments")

# Bytes of bronze from which on steps over whole tables fill the cluster one by one, and how many then run at once.
LARGE_LAKE_BYTES = 512 * 1024 * 1024
FEW_STEPS = 2

Clock = Callable[[], dt.datetime]
T = TypeVar("T")


def utc_now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


@dataclass(frozen=True)
class Lake:
    """Where each layer of the platform is stored."""

    root: str

    def path(self, layer: str, name: str) -> str:
        return f"{self.root.rstrip('/')}/{layer}/{name}"


@dataclass(frozen=True)
class Run:
    """What identifies one run: its id, the moment it works for, a clock, and parallelism; and whether silver keeps a change feed."""

    run_id: str
    at: dt.datetime
    clock: Clock = utc_now
    workers: int = 8
    feed: bool = False


class Ledger:
    """Audit and log rows of one job, a handful, appended in one write each when the job ends."""

    def __init__(self, spark: SparkSession, lake: Lake, run: Run, job: str) -> None:
        self.spark, self.lake, self.run, self.job = spark, lake, run, job
        self.rows: list[tuple] = []
        self.logs: list[tuple] = []

    def __enter__(self) -> Ledger:
        return self

    def __exit__(self, *_: object) -> None:
        if self.rows:
            rows = self.spark.createDataFrame(self.rows, monitoring.AUDIT_SCHEMA)
            rows.coalesce(1).write.mode("append").parquet(self.lake.path("ops", "audit"))
        if self.logs:
            logs = self.spark.createDataFrame(self.logs, monitoring.LOG_SCHEMA)
            logs.coalesce(1).write.mode("append").parquet(self.lake.path("ops", "logs"))

    def log(self, level: str, module: str, message: str, details: Mapping | None = None, problem: BaseException | None = None) -> None:
        entry = monitoring.log_entry(self.run.run_id, self.job, module, level, message, self.run.clock(), len(self.logs), details, problem)
        self.logs.append(entry)

    @contextmanager
    def step(self, name: str) -> Iterator[dict]:
        """Audit a step, whatever way it ends; the caller fills in the row counts."""
        seen: dict = {}
        started = self.run.clock()
        try:
            yield seen
        except Exception as problem:
            self._add(name, started, "FAILED", seen, str(problem))
            self.log("ERROR", name, str(problem), seen, problem)
            raise
        self._add(name, started, "SUCCESS", seen, None)
        self.log("INFO", name, "step finished", seen)

    def _add(self, name: str, started: dt.datetime, status: str, seen: dict, error: str | None) -> None:
        counts = [seen.get(k, 0) for k in ("read", "inserted", "updated", "deleted")]
        row = monitoring.audit_values(self.job, name, self.run.run_id, started, self.run.clock(), status, *counts, error=error)
        self.rows.append(row)


def together(run: Run, tasks: Mapping[str, Callable[[], T]], at_once: int | None = None) -> dict[str, T]:
    """Run independent steps side by side, so small ones fill the gaps of large ones."""
    with ThreadPoolExecutor(at_once or run.workers) as pool:
        futures = {name: pool.submit(task) for name, task in tasks.items()}
        return {name: future.result() for name, future in futures.items()}


def at_once(spark: SparkSession, lake: Lake, run: Run) -> int:
    """How many steps that shuffle whole tables run side by side: few over a large lake, so not all their shuffles are on disk together."""
    bronze = f"{lake.root.rstrip('/')}/bronze"
    large = path_exists(spark, bronze) and path_bytes(spark, bronze) >= LARGE_LAKE_BYTES
    return min(run.workers, FEW_STEPS) if large else run.workers


def write_counted(df: DataFrame, path: str) -> int:
    """Write a frame and return its rows, counted on the way."""
    counted, measure = monitoring.counting(df)
    counted.write.options(**PACKED).mode("overwrite").parquet(path)
    return measure.get.get("rows") or 0


# --- bronze -----------------------------------------------------------------
def _bronze_schema(spark: SparkSession, lake: Lake, name: str) -> StructType:
    """The schema wide enough for all loads, from the small files the loads leave beside the table.

    So a read opens no more footers than it reads files.
    """
    noted = lake.path("ops/bronze_schemas", name)
    if not path_exists(spark, noted):
        return spark.read.option("mergeSchema", "true").parquet(lake.path("bronze", name)).schema
    fields: dict[str, StructField] = {}
    for row in spark.read.text(noted).distinct().orderBy("value").collect():
        for field in StructType.fromJson(json.loads(row["value"])).fields:
            fields.setdefault(field.name, field)
    return StructType(list(fields.values()))


def _note_schema(lake: Lake, name: str, batch: DataFrame) -> None:
    """Note the schema of a batch, if it has columns that none before it had."""
    spark, noted = batch.sparkSession, lake.path("ops/bronze_schemas", name)
    if not path_exists(spark, noted) or set(batch.columns) - set(_bronze_schema(spark, lake, name).names):
        spark.createDataFrame([(batch.schema.json(),)], "value string").coalesce(1).write.mode("append").text(noted)


def read_bronze(spark: SparkSession, lake: Lake, name: str, since: dt.date | None = None) -> DataFrame:
    """Bronze rows, all of them or those ingested from a day on; other days are not read.

    Columns that the contract does not declare have the type that all loads together ask for.
    """
    rows = spark.read.schema(_bronze_schema(spark, lake, name)).parquet(lake.path("bronze", name))
    rows = inference.apply_types(rows, inference.noted(spark, lake.path("ops/bronze_types", name))[1])
    return rows.where(F.col(INGESTION_DATE) >= F.lit(since)) if since else rows


def _bring_in(
    spark: SparkSession, lake: Lake, run: Run, name: str, fmt: str, incremental: bool, bad_records: bool, seen: dict, options: Mapping[str, object]
) -> None:
    spec = entity(name)
    landing, target = lake.path("landing", name), lake.path("bronze", name)
    bad_target = lake.path("bad_records", name) if bad_records else None
    if incremental:
        checkpoint = lake.path("checkpoints", name)
        stream = ingest(
            spark, landing, spec, target, checkpoint, run.run_id, lambda: run.at, fmt, bad_target=bad_target, counts=seen,
            note=lambda df: _note_schema(lake, name, df), types=lake.path("ops/bronze_types", name), **options,
        )
        stream.awaitTermination()
        return
    batch = batch_id(run.run_id)
    stamped = add_lineage(scan(spark, landing, spec, fmt, **options), run.run_id, batch, run.at)
    bad = 0
    if bad_target:
        stamped, broken = split_bad_records(stamped)
        bad = write_counted(broken, f"{bad_target}/{BATCH_ID}={batch}")
    _note_schema(lake, name, stamped)
    seen["inserted"] = write_typed(stamped, target, batch, spec, lake.path("ops/bronze_types", name), run.at)
    seen["read"] = seen["inserted"] + bad


def bronze_job(
    spark: SparkSession,
    lake: Lake,
    run: Run,
    fmt: str = "csv",
    entities: Sequence[str] = tuple(ENTITIES),
    incremental: bool = True,
    stop_on_error: bool = False,
    bad_records: bool = False,
    **options: object,
) -> dict[str, str]:
    """Bring landing files of each entity into bronze; one failure does not stop the rest.

    Incremental runs take files not seen before, once each.  Otherwise all files
    are read and replace what the same run wrote earlier.  ``bad_records`` puts rows that do
    not fit the schema aside instead of keeping their text in the rescue column.  ``options`` go to the scan.
    """

    def attempt(name: str) -> str:
        try:
            with ledger.step(name) as seen:
                _bring_in(spark, lake, run, name, fmt, incremental, bad_records, seen, options)
            return "SUCCESS"
        except Exception as problem:  # reported per entity, unless the caller asked to stop
            if stop_on_error:
                raise
            return f"FAILED: {problem}"

    with freeing_shuffles(spark), Ledger(spark, lake, run, "bronze") as ledger:
        return together(run, {name: lambda n=name: attempt(n) for name in entities})


def bronze_report(spark: SparkSession, lake: Lake, entities: Sequence[str] = tuple(ENTITIES)) -> DataFrame:
    """Lineage completeness and rescued rows per entity.

    Rows are summed up where they are read; hashes, which hardly pack, move only if their numbers are asked for.
    """
    return reduce(DataFrame.unionByName, [_bronze_facts(name, read_bronze(spark, lake, name)) for name in entities])


def _bronze_facts(name: str, bronze: DataFrame) -> DataFrame:
    hashes = lineage_report(bronze).agg(F.sum("DistinctHashes").alias("d"), F.sum("RepeatedRows").alias("r"))
    rescued = rescued_rows(bronze).agg(F.count("*").alias("RescuedRows"))
    # Scalar subqueries, so a reader that leaves a column out does not pay for it.
    return bronze.agg(F.count("*").alias("Rows"), F.count_if(lacks_lineage()).alias("RowsMissingLineage")).select(
        F.lit(name).alias("Entity"),
        "Rows",
        "RowsMissingLineage",
        F.coalesce(hashes.select("d").scalar(), F.lit(0)).alias("DistinctHashes"),
        F.coalesce(hashes.select("r").scalar(), F.lit(0)).alias("RepeatedRows"),
        rescued.scalar().alias("RescuedRows"),
    )


# --- silver -----------------------------------------------------------------
def read_silver(spark: SparkSession, lake: Lake, name: str) -> DataFrame | None:
    base = lake.path("silver", name)
    return read_history(spark, base) if name == HISTORY_ENTITY else read_snapshot(spark, base)


def read_silver_current(spark: SparkSession, lake: Lake) -> dict[str, DataFrame]:
    """Silver tables as marts and suites read them: only current patients."""
    tables = {name: read_silver(spark, lake, name) for name in ENTITIES}
    missing = [name for name, df in tables.items() if df is None]
    if missing:
        raise FileNotFoundError(f"silver tables not built yet: {', '.join(missing)}")
    return tables | {HISTORY_ENTITY: filter_current(tables[HISTORY_ENTITY])}


def _merge_in(spark: SparkSession, lake: Lake, run: Run, name: str, rows: DataFrame, small: bool | None = None) -> dict:
    """Bring cleaned rows into the silver table of an entity; returns the commit.

    ``clean`` leaves one row per key and no key null, so keys are not counted once more.
    """
    spec, base = ENTITIES[name], lake.path("silver", name)
    if name != HISTORY_ENTITY:
        held = read_snapshot(spark, base)
        merged = merge_changed(held, rows, spec.key, spec.compared, spec.modified_by, images=run.feed, checked=True, small=small)
        return write_snapshot(merged.actions, base, run.at, "scd1")
    held = read_history(spark, base)
    if held is None:
        return write_history(open_versions(rows, run.at), base, run.at)
    step = advance(held, rows, spec.key, spec.tracked, run.at, newest_by=spec.modified_by)
    return write_history(step, base, run.at)


def silver_job(spark: SparkSession, lake: Lake, run: Run, since: dt.date | None = None) -> dict[str, dict]:
    """Clean every entity, check two of them, and merge all into silver.

    By default all of bronze is read again.  With ``since`` only later ingestion
    days are, and what they bring is merged into what silver holds; rows of an
    entity with a modification time do not replace newer ones.

    Rows are cleaned and merged in one pass.  Only where cleaned rows are read again are they
    staged, and removed once they are merged and checked.
    """
    staged: dict[str, DataFrame] = {}
    report: dict[str, dict] = {}

    def place(name: str) -> str:
        return lake.path(f"staging/{run.run_id}", name)

    def asks_staging(name: str) -> bool:
        """Whether cleaned rows are read more than once: by checks, which silver can serve after a first load, or to broadcast few rows."""
        if last_version(spark, lake.path("silver", name)) is None:
            return False
        return name in CHECKED or read_bronze(spark, lake, name, since).count() <= MAX_ROWS

    def load(name: str) -> None:
        bronze, read = monitoring.counting(read_bronze(spark, lake, name, since))
        rows = clean(name, bronze)
        if asks_staging(name):
            with ledger.step(f"clean_{name}") as seen:
                seen["inserted"] = write_counted(rows, place(name))
                seen["read"] = read.get.get("rows") or 0
            staged[name] = spark.read.parquet(place(name))
            with ledger.step(f"merge_{name}") as into:
                done = _merge_in(spark, lake, run, name, staged[name])
                into.update(read=seen["inserted"], **{k: done[k] for k in ("inserted", "updated", "deleted")})
        else:  # one pass does both steps
            rows, cleaned = monitoring.counting(rows)
            with ledger.step(f"clean_{name}") as seen, ledger.step(f"merge_{name}") as into:
                done = _merge_in(spark, lake, run, name, rows, small=False)
                seen.update(inserted=cleaned.get.get("rows") or 0, read=read.get.get("rows") or 0)
                into.update(read=seen["inserted"], **{k: done[k] for k in ("inserted", "updated", "deleted")})
        report[f"clean_{name}"], report[f"merge_{name}"] = seen, done
        if name not in CHECKED:
            remove(spark, place(name))

    def cleaned_rows(name: str) -> DataFrame:
        """The rows this run cleaned; after a first load they are what silver holds."""
        return staged[name] if name in staged else read_silver(spark, lake, name).drop(*HISTORY)

    def check(name: str, rules: Sequence[quality.Rule]) -> None:
        try:
            store_quality(spark, lake, run, {name: cleaned_rows(name)}, {name: rules}, f"{run.run_id}-advisory")
            report[f"quality_{name}"] = {"status": "SUCCESS"}
        except Exception as problem:  # advisory: silver goes on
            report[f"quality_{name}"] = {"status": f"FAILED: {problem}"}

    def load_checked() -> None:
        together(run, {n: lambda n=n: load(n) for n in CHECKED})
        advisory = {
            "patients": suites.advisory_patients(),
            "appointments": suites.advisory_appointments(cleaned_rows("patients"), cleaned_rows("doctors")),
        }
        together(run, {n: lambda n=n: check(n, advisory[n]) for n in advisory})
        for name in CHECKED:
            remove(spark, place(name))

    with freeing_shuffles(spark), Ledger(spark, lake, run, "silver") as ledger:
        # Checks stop nothing, so they run beside the larger tables.
        together(run, {n: lambda n=n: load(n) for n in ENTITIES if n not in CHECKED} | {"checked": load_checked}, at_once(spark, lake, run))
    current = filter_current(read_history(spark, lake.path("silver", HISTORY_ENTITY)))
    report["patients_current"] = write_snapshot(current, lake.path("silver", "patients_current"), run.at)
    return report


# --- gold -------------------------------------------------------------------
def gold_job(spark: SparkSession, lake: Lake, run: Run, files: int | None = None) -> dict[str, dict]:
    """Build and store the marts.  Marts over marts read the stored ones.

    Clustered marts fill as many files as their size asks for, unless ``files`` says otherwise.
    """

    def keep(name: str, df: DataFrame) -> dict:
        with ledger.step(name) as seen:
            done = write_snapshot(df, lake.path("gold", name), run.at)
            seen["inserted"] = done["rows"]
            return done

    def arrange(name: str) -> dict:
        derived = MART_DERIVED[name]() if name in MART_DERIVED else None
        arranged = cluster(read_mart(spark, lake, name), MART_CLUSTERING[name], files, derived=derived)
        return write_snapshot(arranged, lake.path("gold", name), run.at, "cluster")

    with freeing_shuffles(spark), Ledger(spark, lake, run, "gold") as ledger:
        base = marts.base_marts(read_silver_current(spark, lake), run.at.date())
        report = together(run, {n: lambda n=n: keep(n, base[n]) for n in base}, at_once(spark, lake, run))
        over = marts.derived_marts(
            read_mart(spark, lake, "revenue_analytics"), read_mart(spark, lake, "doctor_performance")
        )
        # Marts over marts read the version that was just stored, so clustered ones are rewritten beside them.
        rewrites = {f"arrange_{n}": lambda n=n: arrange(n) for n in MART_CLUSTERING}
        done = together(run, rewrites | {n: lambda n=n: keep(n, over[n]) for n in over}, at_once(spark, lake, run))
        report |= {n: done[n] for n in over}
    return report


def read_mart(spark: SparkSession, lake: Lake, name: str) -> DataFrame:
    df = read_snapshot(spark, lake.path("gold", name))
    if df is None:
        raise FileNotFoundError(f"mart not built yet: {name}")
    return df


# --- data quality -----------------------------------------------------------
def store_quality(
    spark: SparkSession,
    lake: Lake,
    run: Run,
    tables: Mapping[str, DataFrame],
    rules: Mapping[str, Sequence[quality.Rule]],
    run_id: str | None = None,
    ledger: Ledger | None = None,
) -> DataFrame:
    """Evaluate suites, store results and failing rows under the run id, return the results.

    With a ledger each entity is a step: rows checked, results stored, failing rows put aside.
    """
    run_id = run_id or run.run_id

    def one(name: str) -> None:
        with ledger.step(name) if ledger else nullcontext({}) as seen:
            check(name, seen)

    def check(name: str, seen: dict) -> None:
        where = f"RunID={run_id}/Entity={name}"
        keys = quality.offending_keys(tables[name], rules[name])
        if keys is not None:
            keys.write.options(**PACKED).mode("overwrite").parquet(lake.path(f"staging/{run_id}", f"keys_{name}"))
            keys = spark.read.parquet(lake.path(f"staging/{run_id}", f"keys_{name}"))
        found = quality.evaluate(tables[name], rules[name], name, run_id, run.at, keys).drop("RunID", "Entity")
        path = f"{lake.path('ops', 'dq_results')}/{where}"
        seen["inserted"] = write_counted(found.coalesce(1), path)
        results = spark.read.schema(found.schema).parquet(path).select("RuleName", "FailedCount", "TotalCount").collect()  # a row per rule
        seen["read"] = max((r["TotalCount"] for r in results), default=0)
        # Rules that no row failed put nothing aside, so rows are held against the others only.
        broken = {r["RuleName"] for r in results if r["FailedCount"]}
        failed = [r for r in rules[name] if r.name in broken]
        aside = f"{lake.path('ops', 'dq_failed')}/{where}"
        if failed:
            bad = quality.quarantine(tables[name], failed, name, run_id, run.at, keys).drop("RunID", "Entity")
            seen["deleted"] = write_counted(bad, aside)
        else:
            none = quality.quarantine(tables[name].limit(0), rules[name], name, run_id, run.at, keys).drop("RunID", "Entity")
            none.write.options(**PACKED).mode("overwrite").parquet(aside)
            seen["deleted"] = 0
        if keys is not None:
            remove(spark, lake.path(f"staging/{run_id}", f"keys_{name}"))
        if ledger and seen["deleted"]:
            ledger.log("WARNING", name, "rows failed rules and were put aside", {"rows": seen["deleted"]})

    together(run, {n: lambda n=n: one(n) for n in rules}, at_once(spark, lake, run))
    kept = spark.read.parquet(lake.path("ops", "dq_results"))
    return kept.where((F.col("RunID") == run_id) & F.col("Entity").isin(*rules))


def quality_job(spark: SparkSession, lake: Lake, run: Run, fail_on_critical: bool = False) -> DataFrame:
    """Every suite over silver.  With the flag, critical failures raise after all is stored."""
    silver = read_silver_current(spark, lake)
    with freeing_shuffles(spark), Ledger(spark, lake, run, "data_quality") as ledger:
        rules = suites.all_suites(silver, run.at.date())
        results = store_quality(spark, lake, run, silver, rules, ledger=ledger)
        if fail_on_critical:
            quality.require_no_critical(results)
    return quality.run_summary(results)


# --- monitoring and maintenance ---------------------------------------------
def maintain(spark: SparkSession, lake: Lake, run: Run, files: int | None = None) -> dict[str, str]:
    """Rewrite silver tables clustered by their columns, as new snapshots."""

    def one(name: str) -> str:
        base = lake.path("silver", "patients_current" if name == HISTORY_ENTITY else name)
        df = read_snapshot(spark, base)
        if df is None:
            return "SKIPPED"
        write_snapshot(cluster(df, ENTITIES[name].cluster_by, files), base, run.at, "cluster")
        return "SUCCESS"

    return together(run, {n: lambda n=n: one(n) for n in ENTITIES}, at_once(spark, lake, run))


def monitoring_job(spark: SparkSession, lake: Lake, run: Run, maintenance: bool = True) -> dict[str, DataFrame]:
    """Figures of the monitoring page, and table maintenance."""
    if maintenance:
        with freeing_shuffles(spark), Ledger(spark, lake, run, "maintenance") as ledger, ledger.step("silver"):
            maintain(spark, lake, run)
    audit = spark.read.parquet(lake.path("ops", "audit"))
    base = lake.path("silver", HISTORY_ENTITY)
    page = {
        "audit_summary": monitoring.audit_summary(audit),
        "latest_audit": monitoring.latest_audit(audit),
        "versions": version_log(spark, base),
        "quality_trend": quality.trend(spark.read.parquet(lake.path("ops", "dq_results"))),
    }
    if path_exists(spark, lake.path("ops", "logs")):
        logs = spark.read.parquet(lake.path("ops", "logs"))
        page |= {"problem_logs": monitoring.problem_logs(logs), "log_counts": monitoring.log_counts(logs)}
    newest = last_version(spark, base)
    if newest and newest > 1:
        page["previous_patients"] = read_history(spark, base, version=newest - 1)
    return page


def register_all(spark: SparkSession, lake: Lake, databases: Mapping[str, str] | None = None) -> dict[str, str]:
    """Make every stored table readable by name, by layer; temporary views by default.

    The patients' history spans many folders, so it is always a temporary view; so are the views over the marts, and
    silver tables that keep a change feed.
    Registering again after a later run shows what that run stored.
    """
    databases = databases or {}
    report = register_layer(spark, {n: lake.path("bronze", n) for n in ENTITIES}, databases.get("bronze"))
    report = {f"bronze.{k}": v for k, v in report.items()}
    current = {
        "silver": [*[n for n in ENTITIES if n != HISTORY_ENTITY], "patients_current"],
        "gold": [*MART_NAMES],
    }
    for layer, names in current.items():
        paths, done = {}, {}
        for name in names:
            base = lake.path(layer, name)
            version = last_version(spark, base)
            if layer == "silver" and version and keeps_feed(spark, base, version):
                read_snapshot(spark, base).createOrReplaceTempView(name)
                done[name] = "SUCCESS"
            else:
                paths[name] = f"{base}/version={version}"
        done |= register_layer(spark, paths, databases.get(layer))
        report |= {f"{layer}.{k}": v for k, v in done.items()}
    history = read_history(spark, lake.path("silver", HISTORY_ENTITY))
    if history is not None:
        history.createOrReplaceTempView(HISTORY_ENTITY)
    report[f"silver.{HISTORY_ENTITY}"] = "SKIPPED" if history is None else "SUCCESS"
    ops = register_layer(spark, {n: lake.path("ops", n) for n in ("audit", "logs", "dq_results", "dq_failed")}, databases.get("ops"))
    report |= {f"ops.{k}": v for k, v in ops.items()}
    built = {n: read_snapshot(spark, lake.path("gold", n)) for n in MART_NAMES}
    built["patients_current"] = read_snapshot(spark, lake.path("silver", "patients_current"))
    published = views.publish(spark, {n: df for n, df in built.items() if df is not None})
    return report | {f"views.{k}": v for k, v in published.items() if k in views.VIEWS}


MART_NAMES = marts.MART_NAMES


STAGES: dict[str, Callable[[SparkSession, Lake, Run], object]] = {
    "bronze": bronze_job,
    "silver": silver_job,
    "gold": gold_job,
    "quality": quality_job,
    "monitoring": monitoring_job,
}


def full_run(spark: SparkSession, lake: Lake, run: Run, stages: Sequence[str] = tuple(STAGES)) -> dict[str, object]:
    """The stages in their order, or those named, such as the rest of a run that stopped."""
    return {name: job(spark, lake, run) for name, job in STAGES.items() if name in stages}


def mart_versions(spark: SparkSession, lake: Lake) -> DataFrame:
    """Rows and newest version of every mart, from their version logs."""
    parts = [
        commits(spark, lake.path("gold", n))
        .groupBy()
        .agg(F.max("version").alias("Version"), F.max_by("rows", "version").alias("Rows"))
        .select(F.lit(n).alias("Mart"), "Version", "Rows")
        for n in MART_NAMES
    ]
    return reduce(DataFrame.unionByName, parts)
