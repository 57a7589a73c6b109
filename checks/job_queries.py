"""Whole jobs over a lake that is landed from the tables, and what they leave behind."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks import clean_queries, mart_queries  # noqa: F401  their SQL is used below
from checks.quality_queries import ALL_RESULTS
from checks.registry import AS_OF_TIME, ORACLE, QUERIES, query
from checks.source_queries import PADDED, land_all
from lamina.contracts import ENTITIES
from lamina.operators.quality import failed_rules, run_summary, trend
from lamina.plans import jobs
from lamina.session import path_bytes, work_dir

RUN = jobs.Run("LOAD_20250630000000_checks", AS_OF_TIME)
#: Bytes of order lines from which on no two queries share a lake.
OWN_LAKE_BYTES = 8 * 1024 * 1024
_LAKES: dict[tuple[str, str], dict] = {}


def lake_at(spark, sf, stage, asked):
    """A lake landed from the tables and brought up to a stage, and what its jobs returned.

    Every call makes its own, so what a query costs does not depend on the queries before it.  Only over tables so small that
    starting jobs takes longer than running them, as in tests, do the queries of a session share one, and a query that asks a
    second time gets a new one there too.
    """
    own = path_bytes(spark, f"{sf}/lineitem.parquet") >= OWN_LAKE_BYTES
    key = (spark.sparkContext.applicationId, sf)
    state = {"done": {}, "asked": set()} if own else _LAKES.setdefault(key, {"done": {}, "asked": set()})
    if asked in state["asked"]:
        state = _LAKES[key] = {"done": {}, "asked": set()}
    state["asked"].add(asked)
    if "lake" not in state:
        lake = jobs.Lake(work_dir(spark, "lake"))
        land_all(spark, sf, lake)
        state["lake"] = lake
    names = list(jobs.STAGES)
    for name in names[: names.index(stage) + 1]:
        if name not in state["done"]:
            state["done"] |= jobs.full_run(spark, state["lake"], RUN, [name])
    return state["lake"], state["done"]


def stored_results(spark, lake):
    """Quality results as the quality job stored them."""
    kept = spark.read.parquet(lake.path("ops", "dq_results")).where(F.col("RunID") == RUN.run_id)
    return kept.select("Entity", "RuleName", "Severity", "FailedCount", "TotalCount", "PassRate", "Status")


def _rows(names, prefix=""):
    return " UNION ALL ".join(f"SELECT '{n}' AS Entity, count(*) AS Rows FROM {prefix}{n}" for n in names)


@query(
    "j01_bronze",
    f"SELECT Entity, Rows, 0 AS RowsMissingLineage, 0 AS RescuedRows FROM ({_rows(ENTITIES, 'raw_')})",
)
def _(spark, sf):
    lake, _ = lake_at(spark, sf, "bronze", "j01_bronze")
    return jobs.bronze_report(spark, lake).select("Entity", "Rows", "RowsMissingLineage", "RescuedRows")


@query("j02_silver", f"{_rows([*ENTITIES])} UNION ALL SELECT 'patients_current', count(*) FROM patients")
def _(spark, sf):
    lake, _ = lake_at(spark, sf, "silver", "j02_silver")
    out = None
    for name in [*ENTITIES, "patients_current"]:
        df = jobs.read_silver(spark, lake, name)
        part = df.agg(F.lit(name).alias("Entity"), F.count("*").alias("Rows"))
        out = part if out is None else out.unionByName(part)
    return out


@query("j04_gold", _rows(jobs.MART_NAMES).replace("AS Entity", "AS Mart"))
def _(spark, sf):
    lake, _ = lake_at(spark, sf, "gold", "j04_gold")
    return jobs.mart_versions(spark, lake).select("Mart", "Rows")


@query("j04_gold_hospital_revenue", "SELECT * FROM hospital_revenue")
def _(spark, sf):
    lake, _ = lake_at(spark, sf, "gold", "j04_gold_hospital_revenue")
    return jobs.read_mart(spark, lake, "hospital_revenue")


@query("j05_quality", "SELECT * FROM r", r=ALL_RESULTS)
def _(spark, sf):
    _, done = lake_at(spark, sf, "quality", "j05_quality")
    return done["quality"].select("Entity", "RuleName", "Severity", "FailedCount", "TotalCount", "PassRate", "Status")


@query("e21_run_summary", "SELECT * FROM r", r=ALL_RESULTS)
def _(spark, sf):
    return run_summary(stored_results(spark, lake_at(spark, sf, "quality", "e21_run_summary")[0]))


@query("e21_failed_rules", "SELECT count(*) AS FailedRules FROM r WHERE Status = 'FAILED'", r=ALL_RESULTS)
def _(spark, sf):
    return failed_rules(stored_results(spark, lake_at(spark, sf, "quality", "e21_failed_rules")[0]))


@query(
    "e22_trend",
    """SELECT Entity, Status, count(*) AS RuleExecutions, CAST(sum(FailedCount) AS BIGINT) AS FailedRows
       FROM r GROUP BY 1, 2""",
    r=ALL_RESULTS,
)
def _(spark, sf):
    return trend(stored_results(spark, lake_at(spark, sf, "quality", "e22_trend")[0]))


@query(
    "j05_quarantined_rows",
    """SELECT Entity, RuleName, FailedCount AS Rows FROM r WHERE FailedCount > 0""",
    r=ALL_RESULTS,
)
def _(spark, sf):
    """Failing rows put aside by the quality job: as many as each rule counted."""
    lake, _ = lake_at(spark, sf, "quality", "j05_quarantined_rows")
    bad = spark.read.parquet(lake.path("ops", "dq_failed")).where(F.col("RunID") == RUN.run_id)
    return bad.groupBy("Entity", "RuleName").agg(F.count("*").alias("Rows"))


_STEPS = (
    f"""SELECT 'bronze' AS PipelineName, Entity AS TableName, Rows AS RowsRead, Rows AS RowsInserted, 0 AS RowsUpdated, 0 AS RowsDeleted
        FROM ({_rows(ENTITIES, 'raw_')})
        UNION ALL SELECT 'silver', 'clean_' || r.Entity, r.Rows, s.Rows, 0, 0
                  FROM ({_rows(ENTITIES, 'raw_')}) r JOIN ({_rows(ENTITIES)}) s ON r.Entity = s.Entity
        UNION ALL SELECT 'silver', 'merge_' || Entity, Rows, Rows, 0, 0 FROM ({_rows(ENTITIES)})
        UNION ALL SELECT 'gold', Entity, 0, Rows, 0, 0 FROM ({_rows(jobs.MART_NAMES)})
        UNION ALL SELECT 'data_quality', Entity, CAST(max(TotalCount) AS BIGINT), count(*), 0, CAST(sum(FailedCount) AS BIGINT) FROM r GROUP BY Entity"""
)


_SUMMARY = """
    SELECT PipelineName, 'SUCCESS' AS Status, count(*) AS Runs, CAST(sum(RowsRead) AS BIGINT) AS TotalRowsRead,
           CAST(sum(RowsInserted) AS BIGINT) AS TotalRowsInserted
    FROM steps GROUP BY 1
    UNION ALL SELECT 'maintenance', 'SUCCESS', 1, 0, 0"""


@query("j06_monitoring", _SUMMARY, r=ALL_RESULTS, steps=_STEPS)
def _(spark, sf):
    """Audit summary the jobs themselves left, but for times, which differ from run to run."""
    _, done = lake_at(spark, sf, "monitoring", "j06_monitoring")
    return done["monitoring"]["audit_summary"].drop("AvgSeconds", "LastRun")


_LOG_COUNTS = """SELECT PipelineName, 'INFO' AS LogLevel, count(*) AS "count" FROM steps GROUP BY 1
    UNION ALL SELECT 'data_quality', 'WARNING', count(*) FROM steps WHERE PipelineName = 'data_quality' AND RowsDeleted > 0
    UNION ALL SELECT 'maintenance', 'INFO', 1"""


@query("j06_log_counts", _LOG_COUNTS, r=ALL_RESULTS, steps=_STEPS)
def _(spark, sf):
    """Log figures of the monitoring page, over the rows that the jobs logged."""
    _, done = lake_at(spark, sf, "monitoring", "j06_log_counts")
    return done["monitoring"]["log_counts"]


@query(
    "j06_problem_logs",
    """SELECT 'data_quality' AS PipelineName, TableName AS Module, 'WARNING' AS LogLevel, '{"rows": ' || RowsDeleted || '}' AS Details
       FROM steps WHERE PipelineName = 'data_quality' AND RowsDeleted > 0""",
    r=ALL_RESULTS,
    steps=_STEPS,
)
def _(spark, sf):
    _, done = lake_at(spark, sf, "monitoring", "j06_problem_logs")
    return done["monitoring"]["problem_logs"].select("PipelineName", "Module", "LogLevel", "Details")


@query("o01_step_counts", _STEPS, r=ALL_RESULTS)
def _(spark, sf):
    """Rows that every step of every job reports, counted while they were read and written."""
    lake, _ = lake_at(spark, sf, "quality", "o01_step_counts")
    audit = spark.read.parquet(lake.path("ops", "audit")).where("Status = 'SUCCESS' AND PipelineName <> 'maintenance'")
    return audit.select("PipelineName", "TableName", "RowsRead", "RowsInserted", "RowsUpdated", "RowsDeleted")


@query(
    "j07_full_run",
    f"""SELECT 'bronze' AS Layer, CAST(sum(Rows) AS BIGINT) AS Rows FROM ({_rows(ENTITIES, 'raw_')})
        UNION ALL SELECT 'silver', CAST(sum(Rows) AS BIGINT) FROM ({_rows(ENTITIES)})
        UNION ALL SELECT 'gold', CAST(sum(Rows) AS BIGINT) FROM ({_rows(jobs.MART_NAMES)})
        UNION ALL SELECT 'quality', count(*) FROM r""",
    r=ALL_RESULTS,
)
def _(spark, sf):
    """All stages in order; rows per layer at the end."""
    lake, _ = lake_at(spark, sf, "monitoring", "j07_full_run")
    bronze = jobs.bronze_report(spark, lake).agg(F.lit("bronze").alias("Layer"), F.sum("Rows").alias("Rows"))
    silver = None
    for name in ENTITIES:
        part = jobs.read_silver(spark, lake, name).agg(F.count("*").alias("Rows"))
        silver = part if silver is None else silver.unionByName(part)
    gold = jobs.mart_versions(spark, lake)
    return (
        bronze.unionByName(silver.agg(F.lit("silver").alias("Layer"), F.sum("Rows").alias("Rows")))
        .unionByName(gold.agg(F.lit("gold").alias("Layer"), F.sum("Rows").alias("Rows")))
        .unionByName(stored_results(spark, lake).agg(F.lit("quality").alias("Layer"), F.count("*").alias("Rows")))
    )


# --- values, table by table ---------------------------------------------------
_CLEAN = {
    "doctors": "c15_clean_doctors",
    "appointments": "c16_clean_appointments",
    "insurance_claims": "c17_clean_insurance_claims",
    "pharmacy_orders": "c18_clean_pharmacy_orders",
    "laboratory_results": "c19_clean_laboratory_results",
    "billing": "c20_clean_billing",
}
_MARTS = {name.split("_", 1)[1]: name for name in ORACLE if name[0] == "g" and name[1:3].isdigit()}


def _values(name, source, stage, read):
    def build(spark, sf):
        lake, _ = lake_at(spark, sf, stage, name)
        return read(spark, lake)

    query(name)(build)
    ORACLE[name] = ORACLE[source]


for _table, _source in _CLEAN.items():
    _values(f"j02_silver_{_table}", _source, "silver", lambda spark, lake, n=_table: jobs.read_silver(spark, lake, n))
for _mart in jobs.MART_NAMES:
    if f"j04_gold_{_mart}" not in QUERIES:
        _values(f"j04_gold_{_mart}", _MARTS[_mart], "gold", lambda spark, lake, n=_mart: jobs.read_mart(spark, lake, n))


# --- a second load ------------------------------------------------------------
_SECOND_SQL = """
    SELECT 'billing' AS Entity, InvoiceID AS Key,
           CASE WHEN right(InvoiceID, 1) IN ('0', '5') THEN 'WrittenOff' ELSE PaymentStatus END AS A,
           CAST(CAST(round(TotalAmount * 100) AS BIGINT) + CASE WHEN right(InvoiceID, 1) IN ('0', '5') THEN 100 ELSE 0 END AS VARCHAR) AS B
    FROM billing
    UNION ALL
    SELECT 'appointments', AppointmentID, CASE WHEN right(AppointmentID, 1) IN ('0', '5') THEN 'NoShow' ELSE Status END,
           strftime(CASE WHEN right(AppointmentID, 1) IN ('0', '5') THEN AppointmentDate - INTERVAL 1 DAY ELSE AppointmentDate END, '%Y-%m-%d %H:%M:%S')
    FROM appointments
    UNION ALL
    SELECT 'patients', PatientID, CASE WHEN right(PatientID, 1) = '0' THEN '+15550001' ELSE Phone END, '' FROM patients"""


def _second_load(spark, sf, since):
    """Corrections land a day later: other statuses and amounts, visits moved to an earlier day, patients with newer
    and with older modification times.  Silver takes all but the last."""
    lake, next_day = jobs.Lake(work_dir(spark, "lake")), AS_OF_TIME + dt.timedelta(days=1)
    land_all(spark, sf, lake)
    jobs.full_run(spark, lake, RUN, ["bronze", "silver"])
    hit = lambda key: F.right(key, F.lit(1)).isin("0", "5")
    bills, visits, people = (jobs.read_silver_current(spark, lake)[n] for n in ("billing", "appointments", "patients"))
    people = people.select(*ENTITIES["patients"].columns).where(hit(F.col("PatientID")))
    newer = F.right("PatientID", F.lit(1)) == "0"
    later = {
        "billing": bills.where(hit(F.col("InvoiceID"))).withColumns({"PaymentStatus": F.lit("WrittenOff"), "TotalAmount": F.col("TotalAmount") + 1}),
        "appointments": visits.where(hit(F.col("AppointmentID"))).withColumns(
            {"Status": F.lit("NoShow"), "AppointmentDate": F.timestamp_add("DAY", F.lit(-1), F.col("AppointmentDate"))}
        ),
        "patients": people.withColumns(
            {
                "Phone": F.when(newer, "+15550001").otherwise("+15550002"),
                "ModifiedDate": F.timestamp_add("DAY", F.when(newer, 400).otherwise(-400), F.col("ModifiedDate")),
            }
        ),
    }
    for name, df in later.items():
        df.write.mode("append").options(header="true", **PADDED).csv(lake.path("landing", name))
    run = jobs.Run("LOAD_20250701000000_checks", next_day)
    jobs.bronze_job(spark, lake, run, stop_on_error=True)
    jobs.silver_job(spark, lake, run, since=next_day.date() if since else None)
    now = jobs.read_silver_current(spark, lake)
    cents = (F.col("TotalAmount") * 100).cast("bigint").cast("string")
    return (
        now["billing"].select(F.lit("billing").alias("Entity"), F.col("InvoiceID").alias("Key"), F.col("PaymentStatus").alias("A"), cents.alias("B"))
        .unionByName(now["appointments"].select(F.lit("appointments").alias("Entity"), F.col("AppointmentID").alias("Key"), F.col("Status").alias("A"), F.date_format("AppointmentDate", "yyyy-MM-dd HH:mm:ss").alias("B")))
        .unionByName(now["patients"].select(F.lit("patients").alias("Entity"), F.col("PatientID").alias("Key"), F.col("Phone").alias("A"), F.lit("").alias("B")))
    )


@query("j02_second_load_full", _SECOND_SQL)
def _(spark, sf):
    return _second_load(spark, sf, since=False)


@query("j02_second_load_since", _SECOND_SQL)
def _(spark, sf):
    return _second_load(spark, sf, since=True)
