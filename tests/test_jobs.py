from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lamina.contracts import ENTITIES
from lamina.operators.quality import CriticalFailures
from lamina.plans import jobs
from lamina.sources.startables import READERS

SF = "/root/testdata/sf0.001"
AT = dt.datetime(2025, 6, 30)


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    lake = jobs.Lake(str(tmp_path_factory.mktemp("lake")))
    for name, read in READERS.items():
        options = {"header": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "timestampFormat": "yyyy-MM-dd HH:mm:ss"}
        read(spark, SF).write.options(**options).csv(lake.path("landing", name))
    return lake


@pytest.fixture(scope="module")
def done(spark, lake):
    return jobs.full_run(spark, lake, jobs.Run("run1", AT))


def test_layers_are_filled(spark, lake, done):
    assert set(done["bronze"].values()) == {"SUCCESS"}
    assert jobs.bronze_report(spark, lake).where("RowsMissingLineage > 0 OR RescuedRows > 0").isEmpty()
    assert set(done["gold"]) == set(jobs.MART_NAMES)
    assert done["quality"].count() == 55
    assert done["monitoring"]["audit_summary"].where("Status = 'FAILED'").isEmpty()


def test_second_run_takes_only_new_files_and_keeps_versions(spark, lake, done):
    before = {n: jobs.read_silver(spark, lake, n).count() for n in ENTITIES}
    late = READERS["patients"](spark, SF).where("PatientID = 'PAT1'").withColumns(
        {"Address": F.lit("9 New Rd"), "ModifiedDate": F.lit(dt.datetime(2025, 1, 1))}
    )
    options = {"header": "true", "timestampFormat": "yyyy-MM-dd HH:mm:ss"}
    late.write.mode("append").options(**options).csv(lake.path("landing", "patients"))
    report = jobs.bronze_job(spark, lake, jobs.Run("run2", AT + dt.timedelta(days=1)))
    assert set(report.values()) == {"SUCCESS"}
    report = jobs.silver_job(spark, lake, jobs.Run("run2", AT + dt.timedelta(days=1)), since=AT.date() + dt.timedelta(days=1))
    assert report["clean_patients"]["inserted"] == 1 and report["clean_billing"]["inserted"] == 0
    after = {n: jobs.read_silver(spark, lake, n).count() for n in ENTITIES}
    assert after == before | {"patients": before["patients"] + 1}
    rows = jobs.read_silver(spark, lake, "patients").where("PatientID = 'PAT1'").orderBy("VersionNumber").collect()
    assert [(r["VersionNumber"], r["IsCurrent"]) for r in rows] == [(1, False), (2, True)]
    assert rows[0]["EffectiveEndDate"] == rows[1]["EffectiveStartDate"]
    page = jobs.monitoring_job(spark, lake, jobs.Run("run2", AT), maintenance=False)
    assert page["previous_patients"].count() == before["patients"]
    assert [r["version"] for r in page["versions"].collect()] == [2, 1]


def test_one_failing_entity_does_not_stop_the_others(spark, lake, done):
    run = jobs.Run("run3", AT)
    report = jobs.bronze_job(spark, lake, run, entities=["doctors", "parrots"], incremental=False)
    assert report["doctors"] == "SUCCESS" and report["parrots"].startswith("FAILED: unknown entity")
    audit = spark.read.parquet(lake.path("ops", "audit")).where("RunID = 'run3'")
    assert {r["TableName"]: r["Status"] for r in audit.collect()} == {"doctors": "SUCCESS", "parrots": "FAILED"}
    logged = {r["Module"]: r for r in spark.read.parquet(lake.path("ops", "logs")).where("RunID = 'run3'").collect()}
    assert (logged["doctors"]["LogLevel"], logged["parrots"]["LogLevel"], logged["parrots"]["ExceptionType"]) == ("INFO", "ERROR", "ValueError")
    assert "unknown entity" in logged["parrots"]["StackTrace"] and logged["doctors"]["StackTrace"] is None
    page = jobs.monitoring_job(spark, lake, run, maintenance=False)
    assert page["problem_logs"].where("Module = 'parrots'").count() == 1
    assert page["log_counts"].where("PipelineName = 'bronze' AND LogLevel = 'ERROR'").first()["count"] == 1
    with pytest.raises(ValueError):
        jobs.bronze_job(spark, lake, run, entities=["parrots"], stop_on_error=True)


def test_batch_run_repeated_replaces_its_rows(spark, lake, done):
    run = jobs.Run("run4", AT)
    for _ in range(2):
        jobs.bronze_job(spark, lake, run, entities=["doctors"], incremental=False)
    bronze = jobs.read_bronze(spark, lake, "doctors").where("_batch_id = 'BATCH_run4'")
    assert bronze.count() == READERS["doctors"](spark, SF).count()


def test_critical_failures_stop_the_job_after_results_are_kept(spark, lake, done):
    with pytest.raises(CriticalFailures):
        jobs.quality_job(spark, lake, jobs.Run("run5", AT), fail_on_critical=True)
    kept = spark.read.parquet(lake.path("ops", "dq_results")).where("RunID = 'run5'")
    assert kept.count() == 55
    assert not spark.read.parquet(lake.path("ops", "dq_failed")).where("RunID = 'run5'").isEmpty()


def test_all_tables_register(spark, lake, done):
    report = jobs.register_all(spark, lake)
    assert set(report.values()) == {"SUCCESS"} and len(report) == 7 + 7 + 1 + 14 + 4 + 11
    assert spark.sql("SELECT count(*) FROM patient_summary").first()[0] > 0


def test_marts_need_silver(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="silver"):
        jobs.gold_job(spark, jobs.Lake(str(tmp_path)), jobs.Run("x", AT))
