"""What the jobs read, move and repeat, beyond their results."""

from __future__ import annotations

import datetime as dt
import gzip
import time

import pytest
from pyspark.sql import functions as F

from checks import job_queries, source_queries
from lamina.contracts import ENTITIES
from lamina.functions.measures import amount_where
from lamina.operators import layout, merge, quality
from lamina.operators.cleaning import keep_latest
from lamina.operators.lineage import add_lineage
from lamina.plans import jobs, marts
from lamina.session import FREE_SHUFFLES, freeing_shuffles
from lamina.sources import landing
from lamina.streaming.files import write_typed

AT = dt.datetime(2025, 6, 30)
SF = "/root/testdata/sf0.001"


def test_queries_over_large_tables_share_no_lake(spark, monkeypatch):
    ran = []
    monkeypatch.setattr(job_queries, "land_all", lambda spark, sf, lake: None)
    monkeypatch.setattr(jobs, "full_run", lambda spark, lake, run, stages: ran.append((lake.root, *stages)) or {s: None for s in stages})
    monkeypatch.setattr(job_queries, "OWN_LAKE_BYTES", 1)
    first, _ = job_queries.lake_at(spark, SF, "silver", "one")
    second, _ = job_queries.lake_at(spark, SF, "silver", "other")
    assert first.root != second.root
    assert [r for r in ran if r[0] == second.root] == [(second.root, "bronze"), (second.root, "silver")]


def test_full_run_query_makes_one_lake(spark, monkeypatch):
    made = []
    lake_at = job_queries.lake_at
    monkeypatch.setattr(job_queries, "lake_at", lambda *a: made.append(a) or lake_at(*a))
    assert job_queries.QUERIES["j07_full_run"](spark, SF).count() == 4
    assert len(made) == 1


def test_rows_meet_only_rules_that_failed(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1, 5), (1, None), (2, 7)], "id int, v int")
    rules = quality.not_null(["id", "v"]) + quality.unique(["id"]) + quality.in_range("v", low=0)
    met, whole = [], quality.quarantine
    monkeypatch.setattr(quality, "quarantine", lambda df, rules, *a: met.append([r.name for r in rules]) or whole(df, rules, *a))
    lake, run = jobs.Lake(str(tmp_path)), jobs.Run("r", AT)
    jobs.store_quality(spark, lake, run, {"e": df}, {"e": rules})
    assert met == [["not_null_v", "unique_id"]]
    bad = spark.read.parquet(lake.path("ops", "dq_failed"))
    assert sorted((r["RuleName"], r["Payload"]) for r in bad.collect()) == [
        ("not_null_v", '{"id":1}'), ("unique_id", '{"id":1,"v":5}'), ("unique_id", '{"id":1}')
    ]
    jobs.store_quality(spark, lake, run, {"e": df.where("id = 2")}, {"e": rules}, "clean")
    assert spark.read.parquet(lake.path("ops", "dq_failed")).where("RunID = 'clean'").isEmpty()


def test_clustering_moves_no_hash(spark):
    df = spark.range(50).select((F.col("id") % 7).alias("a"), F.col("id").cast("string").alias("b"))
    out = layout.cluster(df, ["a", "b"], 3)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression"):].splitlines()[1:]
    assert below and not any("_h" in line or "xxhash64" in line for line in below)
    assert out.columns == ["a", "b"] and sorted(out.collect()) == sorted(df.collect())


def test_checked_source_is_not_counted_again(spark, monkeypatch):
    monkeypatch.setattr(merge, "check_source", lambda *a: 1 / 0)
    held = spark.createDataFrame([(1, "x"), (2, "y")], "id int, val string")
    sent = spark.createDataFrame([(2, "z"), (3, "w")], "id int, val string")
    rows = merge.merge_changed(held, sent, "id", ["val"], checked=True).snapshot.collect()
    assert sorted(map(tuple, rows)) == [(1, "x"), (2, "z"), (3, "w")]


def test_sums_beside_members_are_the_two_step_ones(spark):
    rows = [("A", "p", "1.50", True), ("A", "p", "2.50", False), ("A", None, None, True), (None, "q", "4.00", True), (None, "r", "1.00", False), ("B", None, "2.00", False)]
    df = spark.createDataFrame(rows, "g string, m string, v string, paid boolean").withColumn("v", F.col("v").cast("decimal(12,2)"))
    partial = {"total": F.sum("v"), "n": F.count("v"), "paid": amount_where(F.col("paid"), F.col("v"))}
    names = ["g", "_members", *[f"_{n}" for n in partial]]
    two = {tuple(r) for r in marts._two_step(df, ["g"], "m", partial).select(*names).collect()}
    assert two == {tuple(r) for r in marts._beside(df, "g", "m", partial).select(*names).collect()} and len(two) == 3


def test_landed_files_of_jobs_are_packed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(source_queries, "READERS", {"doctors": source_queries.READERS["doctors"]})
    lake = jobs.Lake(str(tmp_path))
    source_queries.land_all(spark, SF, lake)
    files = [p.name for p in (tmp_path / "landing" / "doctors").glob("part-*")]
    assert files and all(f.endswith(".csv.gz") for f in files)
    assert landing.scan_csv(spark, lake.path("landing", "doctors"), ENTITIES["doctors"]).count() == 10


def plans(spark, text):
    """Plans of the writes that this session ran and that name a text."""
    ran = spark._jsparkSession.sharedState().statusStore().executionsList()
    found = [ran.apply(i).physicalPlanDescription() for i in range(ran.size())]
    return [p for p in found if text in p and "WriteFiles" in p]


def test_batch_of_one_moment_is_not_sorted_by_its_date(spark, tmp_path):
    spec = ENTITIES["doctors"]
    df = spark.createDataFrame([("D1", 1), ("D2", 2)], "DoctorID string, Experience int").repartition(2)
    for at in (AT, AT + dt.timedelta(days=1)):
        assert write_typed(add_lineage(df, "L", "B", at), f"{tmp_path}/one_day", "B", spec, None, at) == 2
    assert plans(spark, f"{tmp_path}/one_day") and not any("Sort" in p for p in plans(spark, f"{tmp_path}/one_day"))
    out = spark.read.parquet(f"{tmp_path}/one_day").collect()
    assert sorted((r["DoctorID"], r["_batch_id"], r["ingestion_date"]) for r in out) == [(d, "B", dt.date(2025, 7, 1)) for d in ("D1", "D2")]


def test_bronze_job_sorts_no_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(source_queries, "READERS", {"doctors": source_queries.READERS["doctors"]})
    lake = jobs.Lake(str(tmp_path))
    source_queries.land_all(spark, SF, lake)
    for number, incremental in enumerate((True, False)):
        jobs.bronze_job(spark, lake, jobs.Run(f"r{number}", AT), entities=["doctors"], incremental=incremental, stop_on_error=True)
    wrote = plans(spark, f"{tmp_path}/bronze/doctors")
    assert len(wrote) == 2 and not any("Sort" in p for p in wrote)
    assert jobs.read_bronze(spark, lake, "doctors").count() == 20
    assert jobs.read_bronze(spark, lake, "doctors", since=AT.date() + dt.timedelta(days=1)).isEmpty()


def test_headers_are_found_in_the_heads_of_files(spark, tmp_path):
    body = "\n".join(f"{i},{hash((i, 'x'))}" for i in range(60_000))
    whole = gzip.compress(f"\ufeffa,b\n{body}".encode())
    (tmp_path / "a [1].csv.gz").write_bytes(whole[: len(whole) // 2])  # reading on would fail
    (tmp_path / "b.csv").write_text('"b","a, c"\r\n1,2\n')
    (tmp_path / "c.csv").write_text("")
    found = landing.csv_headers(spark, str(tmp_path))
    assert {h: [f.rsplit("/", 1)[1] for f in files] for h, files in found.items()} == {("a", "b"): ["a [1].csv.gz"], ("b", "a, c"): ["b.csv"]}


def test_audit_rows_are_one_frame(spark, tmp_path):
    lake = jobs.Lake(str(tmp_path))
    with jobs.Ledger(spark, lake, jobs.Run("r", AT), "job") as ledger:
        for name in ("a", "b"):
            with ledger.step(name) as seen:
                seen["read"] = 1
    assert spark.read.parquet(lake.path("ops", "audit")).agg(F.sum("RowsRead")).first()[0] == 2
    assert plans(spark, lake.path("ops", "audit")) and not any("Union" in p for p in plans(spark, lake.path("ops", "audit")))


def test_year_month_is_that_of_the_format(spark):
    days = ["2024-02-29", "1998-12-01", "0999-01-01", "0001-10-01", "+10000-01-31", None]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(F.col("d").cast("date").alias("d"))
    rows = df.select(marts._year_month("d").alias("a"), F.date_format("d", "yyyy-MM").alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows] and rows[0]["a"] == "2024-02" and rows[-1]["a"] is None


def test_counting_bronze_moves_no_hash(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(source_queries, "READERS", {"doctors": source_queries.READERS["doctors"]})
    lake = jobs.Lake(str(tmp_path))
    source_queries.land_all(spark, SF, lake)
    jobs.bronze_job(spark, lake, jobs.Run("r", AT), entities=["doctors"], stop_on_error=True)
    bronze = jobs.read_bronze(spark, lake, "doctors")
    bronze.write.mode("append").partitionBy("_batch_id", "ingestion_date").parquet(lake.path("bronze", "doctors"))
    report = jobs.bronze_report(spark, lake, ["doctors"])
    assert report.columns == ["Entity", "Rows", "RowsMissingLineage", "DistinctHashes", "RepeatedRows", "RescuedRows"]
    assert [tuple(r) for r in report.collect()] == [("doctors", 20, 0, 10, 10, 0)]
    plan = report.select("Entity", "Rows", "RowsMissingLineage")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and "Aggregate [_load_id" not in plan and "scalar-subquery" not in plan


def shuffle_files(spark):
    files = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_shuffles_of_jobs_are_freed_at_once(spark, tmp_path):
    held = spark.range(20).repartition(3)
    held.write.parquet(f"{tmp_path}/kept")
    before = shuffle_files(spark)
    with freeing_shuffles(spark):
        spark.range(20).repartition(3, "id").join(held, "id").write.parquet(f"{tmp_path}/freed")
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(FREE_SHUFFLES) == "false"
    assert spark.read.parquet(f"{tmp_path}/freed").count() == 20 and held.count() == 20
    with pytest.raises(ZeroDivisionError), freeing_shuffles(spark):
        1 / 0
    assert spark.conf.get(FREE_SHUFFLES) == "false"


def test_merge_moves_a_side_dealt_out_by_key_once(spark, monkeypatch):
    monkeypatch.setattr(merge, "fits_broadcast", lambda df: 1 / 0)
    sent = keep_latest(spark.createDataFrame([(2, "z"), (2, "a"), (3, "w")], "id int, val string"), ["id"])
    held = spark.createDataFrame([(1, "x"), (2, "y")], "id int, val string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = merge.merge_changed(held, sent, "id", ["val"], checked=True, small=False)
        plan = done.actions._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2
        rows = [tuple(r) for r in done.actions.orderBy("id").collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows == [(1, "x", "kept"), (2, "a", "updated"), (3, "w", "inserted")]


def test_silver_stages_only_what_is_read_again_and_leaves_nothing_staged(spark, tmp_path, monkeypatch):
    lake, wrote = jobs.Lake(str(tmp_path)), []
    source_queries.land_all(spark, SF, lake)
    whole = jobs.write_counted
    monkeypatch.setattr(jobs, "write_counted", lambda df, path: wrote.append(path.rsplit("/", 1)[1]) or whole(df, path))
    run, later = jobs.Run("r1", AT), jobs.Run("r2", AT + dt.timedelta(days=1))
    jobs.bronze_job(spark, lake, run, stop_on_error=True)
    first = jobs.silver_job(spark, lake, run)
    assert not set(wrote) & set(ENTITIES)
    again = jobs.silver_job(spark, lake, later)
    assert set(ENTITIES) <= set(wrote)
    monkeypatch.setattr(jobs, "MAX_ROWS", 0)
    wrote.clear()
    third = jobs.silver_job(spark, lake, jobs.Run("r3", AT + dt.timedelta(days=2)))
    assert set(wrote) & set(ENTITIES) == set(jobs.CHECKED)
    for name in ENTITIES:
        rows = first[f"clean_{name}"]["inserted"]
        assert rows and first[f"clean_{name}"]["read"] == jobs.read_bronze(spark, lake, name).count()
        assert first[f"clean_{name}"] == again[f"clean_{name}"] == third[f"clean_{name}"]
        counts = [tuple(r[f"merge_{name}"][k] for k in ("rows", "inserted", "updated", "deleted")) for r in (first, again, third)]
        assert counts == [(rows, rows, 0, 0), (rows, 0, 0, 0), (rows, 0, 0, 0)]
    assert first["quality_appointments"] == again["quality_appointments"] == {"status": "SUCCESS"}
    found = spark.read.parquet(lake.path("ops", "dq_results")).groupBy("Entity", "RuleName").agg(F.count_distinct("FailedCount", "TotalCount").alias("n"), F.count("*").alias("runs"))
    assert found.where("n <> 1 OR runs <> 3").isEmpty() and found.count() == 15
    bad = spark.read.parquet(lake.path("ops", "dq_failed")).groupBy("Entity", "RuleName", "Payload").count()
    assert bad.where("count <> 3").isEmpty()
    left = [str(p) for p in (tmp_path / "staging").rglob("*.parquet")]
    assert left == []


def test_doctors_of_a_day_move_without_patients(spark):
    at = [dt.datetime(2024, 1, d) for d in (1, 2)]
    rows = [("P1", "D1", at[0], "x"), ("P1", "D1", at[0], "x"), ("P2", "D2", at[0], "x"), ("P1", "D3", at[0], "x"), (None, "D1", at[0], "x")]
    rows += [("P1", None, at[0], "x"), ("P9", "D8", at[0], "x"), ("P9", "D9", at[0], "x"), ("P1", "D1", at[1], None), ("P1", "D1", at[1], None)]
    visits = spark.createDataFrame(rows, "PatientID string, DoctorID string, AppointmentDate timestamp, Status string")
    doctors = spark.createDataFrame([("D1", "A", "H"), ("D2", "A", "H"), ("D3", "B", None)], "DoctorID string, Department string, Hospital string")
    out = marts.appointment_analytics(visits, doctors)
    found = {(r["AppointmentDay"].day, r["Status"], r["Department"], r["Hospital"]): tuple(r)[4:] for r in out.collect()}
    assert found == {(1, "x", "A", "H"): (4, 2, 2), (1, "x", "B", None): (1, 1, 1), (1, "x", None, None): (3, 2, 2), (2, None, "A", "H"): (2, 1, 1)}
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_clustering_moves_no_derived_column(spark):
    df = spark.range(50).select((F.col("id") % 7).alias("a"), (F.col("id") % 7 + 1).alias("c"), F.col("id").cast("string").alias("b"))
    out = layout.cluster(df, ["a", "b"], 3, derived={"c": F.col("a") + 1})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression"):].splitlines()[1]
    assert "[a#" in below and " b#" in below and "c#" not in below
    assert out.columns == ["a", "c", "b"] and sorted(out.collect()) == sorted(df.collect())
    period = spark.createDataFrame([(dt.date(2024, 2, 29),), (None,)], "PaymentDate date").withColumns(marts.payment_period())
    assert [tuple(r)[1:] for r in period.collect()] == [(2024, 2, "2024-02"), (None, None, None)]
    assert set(jobs.MART_DERIVED["revenue_analytics"]()) == {"PaymentYear", "PaymentMonth", "PaymentYearMonth"}


def test_few_steps_run_at_once_over_a_large_lake(spark, tmp_path, monkeypatch):
    lake, run = jobs.Lake(str(tmp_path)), jobs.Run("r", AT)
    assert jobs.at_once(spark, lake, run) == run.workers
    spark.range(9).write.parquet(lake.path("bronze", "doctors"))
    assert jobs.at_once(spark, lake, run) == run.workers
    monkeypatch.setattr(jobs, "LARGE_LAKE_BYTES", 100)
    assert jobs.at_once(spark, lake, run) == jobs.FEW_STEPS < run.workers
    assert jobs.at_once(spark, lake, jobs.Run("r", AT, workers=1)) == 1
    running, most = [], []

    def step():
        running.append(1)
        most.append(len(running))
        time.sleep(0.1)
        running.pop()

    jobs.together(run, {str(i): step for i in range(6)}, jobs.at_once(spark, lake, run))
    assert max(most) == jobs.FEW_STEPS
