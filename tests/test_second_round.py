"""Late rows, files of any header, streams that begin anew, moments in any zone, and layouts that follow size."""

from __future__ import annotations

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from lamina.contracts import ENTITIES
from lamina.functions.times import moment, utc
from lamina.operators.cleaning import clean, drop_lineage
from lamina.operators.history import open_versions, valid_at
from lamina.operators.layout import cluster, files_for
from lamina.operators.lineage import add_lineage
from lamina.operators.monitoring import audit_row
from lamina.plans import views
from lamina.sources import landing, snapshots, tables
from lamina.streaming.files import ingest

AT = dt.datetime(2025, 1, 1, 22)


@pytest.fixture
def new_york(monkeypatch):
    monkeypatch.setenv("TZ", "America/New_York")
    time.tzset()
    yield
    monkeypatch.undo()
    time.tzset()


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path.parent)


def test_moments_do_not_follow_the_drivers_zone(spark, new_york, tmp_path):
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    one = spark.range(1)
    assert one.select(text(moment(AT)), text(moment(AT.date()))).first()[:] == ("2025-01-01 22:00:00", "2025-01-01 00:00:00")
    assert utc(AT).utcoffset() == dt.timedelta(0) and moment(F.col("id")) is not None
    stamped = add_lineage(one, "L", "B", AT).select(text("_ingestion_time"), F.col("ingestion_date").cast("string")).first()
    assert stamped[:] == ("2025-01-01 22:00:00", "2025-01-01")
    held = open_versions(one, AT)
    assert held.select(text("EffectiveStartDate")).first()[0] == "2025-01-01 22:00:00"
    assert valid_at(held, AT).count() == 1 and valid_at(held, AT - dt.timedelta(seconds=1)).isEmpty()
    assert audit_row(spark, "p", "t", "r", AT, AT, "SUCCESS").select(text("StartTime")).first()[0] == "2025-01-01 22:00:00"
    base = str(tmp_path / "t")
    snapshots.write_snapshot(one, base, AT)
    assert snapshots.last_version(spark, base, AT) == 1 and snapshots.last_version(spark, base, AT - dt.timedelta(seconds=1)) is None


def test_the_row_that_arrived_last_wins(spark):
    schema = "InvoiceID string, PatientID string, AppointmentID string, TotalAmount string, PaymentStatus string, PaymentDate string"
    first = spark.createDataFrame([("I1", "P", "A", "100.00", "Paid", "2024-01-02"), ("I2", "P", "A", "5.00", "Paid", "2024-01-02")], schema)
    later = spark.createDataFrame([("I1", "P", "A", "150.00", "WrittenOff", "2024-01-01")], schema)
    bronze = add_lineage(first, "L1", "B1", AT).unionByName(add_lineage(later, "L2", "B2", AT + dt.timedelta(days=1)))
    rows = {r["InvoiceID"]: r for r in clean("billing", bronze).collect()}
    assert (rows["I1"]["PaymentStatus"], float(rows["I1"]["TotalAmount"]), len(rows)) == ("WrittenOff", 150.0, 2)
    assert "_ingestion_time" not in clean("billing", bronze).columns


def test_a_modification_time_goes_before_arrival(spark):
    columns = ENTITIES["patients"].columns
    row = lambda phone, day: tuple({"PatientID": "P1", "FirstName": "A", "Phone": phone, "ModifiedDate": day}.get(c) for c in columns)
    schema = ", ".join(f"{c} string" for c in columns)
    newer, late = (spark.createDataFrame([row(*r)], schema) for r in (("1", "2024-05-01 00:00:00"), ("2", "2024-04-01 00:00:00")))
    bronze = add_lineage(newer, "L1", "B1", AT).unionByName(add_lineage(late, "L2", "B2", AT + dt.timedelta(days=1)))
    assert clean("patients", bronze).first()["Phone"] == "1"


def test_files_of_any_header(spark, tmp_path):
    folder = put(tmp_path, "in/a.csv", "DoctorID,DoctorName,Hospital\nD1,Ann,North\n")
    put(tmp_path, "in/b.csv", "Hospital,DoctorID,DoctorName,Pager\nSouth,D2,Bo,77\n")
    put(tmp_path, "in/c d.csv", '"DoctorID","Experience"\nD3,x\n')
    put(tmp_path, "in/empty.csv", "")
    rows = {r["DoctorID"]: r for r in landing.scan_csv(spark, folder, ENTITIES["doctors"]).collect()}
    assert [rows[k]["Hospital"] for k in ("D1", "D2", "D3")] == ["North", "South", None]
    assert (rows["D2"]["DoctorName"], rows["D2"]["Pager"], rows["D1"]["Pager"]) == ("Bo", "77", None)
    assert rows["D3"]["_rescued_data"] == "D3,x" and rows["D1"]["_rescued_data"] is None
    with pytest.raises(landing.NewColumnsFound):
        landing.scan_csv(spark, folder, ENTITIES["doctors"], "failOnNewColumns")


def test_streams_keep_each_others_rows(spark, tmp_path):
    """A stream with a new checkpoint, arrays of JSON, and rows put aside."""
    spec, target, bad = ENTITIES["doctors"], str(tmp_path / "bronze"), str(tmp_path / "bad")
    for k, names in enumerate((["D1", "D2"], ["D3"])):
        folder = put(tmp_path, f"in{k}/x.json", json.dumps([{"DoctorID": n, "Experience": 3} for n in names] + [{"DoctorID": "D9", "Experience": "many"}]))
        counts: dict = {}
        for _ in range(2):
            run = ingest(spark, folder, spec, target, str(tmp_path / f"check{k}"), "L", lambda: AT, "json", bad_target=bad, counts=counts)
            run.awaitTermination()
        assert counts == {"read": len(names) + 1, "inserted": len(names)}
    assert sorted(r["DoctorID"] for r in drop_lineage(spark.read.parquet(target)).collect()) == ["D1", "D2", "D3"]
    assert spark.read.parquet(bad).count() == 2


def test_catalog_follows_the_table(spark, tmp_path):
    for version, names in enumerate((["a"], ["a", "b"]), 1):
        path = str(tmp_path / f"version={version}")
        df = spark.createDataFrame([(n, version) for n in names], "k string, v int")
        (df if version == 1 else df.withColumn("w", F.lit(1))).write.parquet(path)
        assert tables.register_layer(spark, {"followed": path}, "followers") == {"followed": "SUCCESS"}
        assert spark.table("followers.followed").count() == len(names)
    assert spark.table("followers.followed").columns == ["k", "v", "w"]
    parts = str(tmp_path / "parts")
    for p in ("x", "y"):
        spark.range(1).withColumn("p", F.lit(p)).write.mode("append").partitionBy("p").parquet(parts)
        assert tables.register_layer(spark, {"parts": parts}, "followers") == {"parts": "SUCCESS"}
    assert spark.table("followers.parts").count() == 2


def test_views_report_what_went_wrong(spark, monkeypatch):
    def broken(marts):
        return marts["billing_mart"].select("nothing_like_it")

    monkeypatch.setattr(views, "VIEWS", {"v_broken": broken, "v_absent": lambda m: m["elsewhere"]})
    report = views.publish(spark, {"billing_mart": spark.range(1)})
    assert (report["billing_mart"], report["v_absent"]) == ("SUCCESS", "SKIPPED") and report["v_broken"].startswith("FAILED")


def test_more_rows_fill_more_files(spark, tmp_path):
    for n in (1000, 8000):
        df = spark.range(n).select("id", F.concat(F.lit("k"), F.col("id") % 97).alias("k"))
        cluster(df, ["k", "id"], file_bytes=30_000).write.parquet(f"{tmp_path}/{n}")
        sizes = spark.read.parquet(f"{tmp_path}/{n}").groupBy(F.input_file_name()).count().collect()
        assert len(sizes) == files_for(df, 30_000) and sum(r["count"] for r in sizes) == n
    assert files_for(spark.range(8000), 30_000) > files_for(spark.range(1000), 30_000)
