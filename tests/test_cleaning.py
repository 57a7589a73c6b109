from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lamina.contracts import ENTITIES
from lamina.functions.ages import age_band, age_years
from lamina.functions.text import record_hash
from lamina.operators.cleaning import cast_columns, clean, keep_latest
from lamina.operators.lineage import add_lineage

AT = dt.datetime(2025, 6, 30)


def test_patients_are_standardised_and_newest_kept(patients):
    rows = {r["PatientID"]: r for r in clean("patients", patients).collect()}
    assert set(rows) == {"PAT1", "PAT2", "PAT3"}
    assert rows["PAT2"]["Phone"] == "5550199"
    assert rows["PAT1"]["Email"] == "rosa@mail.org"
    assert rows["PAT1"]["Gender"] == "Female"
    assert rows["PAT1"]["FirstName"] == "Rosa"
    assert rows["PAT3"]["Gender"] == "Unknown"
    assert rows["PAT3"]["DOB"] is None
    assert rows["PAT2"]["DOB"] == dt.date(1985, 7, 9)


def test_lineage_is_dropped_unless_asked_for(patients):
    bronze = add_lineage(patients, "LOAD", "BATCH", AT)
    assert clean("patients", bronze).columns == list(ENTITIES["patients"].columns)
    assert "_record_hash" in clean("patients", bronze, keep_lineage=True).columns


def test_experience_has_a_floor(spark):
    rows = [("D1", "a", "s", "d", "h", "-5"), ("D2", "b", "s", "d", "h", "7"), ("D3", "c", "s", "d", "h", None), ("D4", "c", "s", "d", "h", "12.7")]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ENTITIES["doctors"].columns))
    assert {r["DoctorID"]: r["Experience"] for r in clean("doctors", df).collect()} == {"D1": 0, "D2": 7, "D3": None, "D4": 12}


def test_unknown_status_takes_the_default(spark):
    rows = [("A1", "P1", "D1", "2024-05-01 09:00:00", "Lost", "x"), ("A2", "P1", "D1", "2024-05-01 09:00:00", None, "x"), ("A3", "P1", "D1", "2024-05-01 09:00:00", " NoShow ", "x")]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ENTITIES["appointments"].columns))
    got = {r["AppointmentID"]: r["Status"] for r in clean("appointments", df).collect()}
    assert got == {"A1": "Scheduled", "A2": "Scheduled", "A3": "NoShow"}


def test_amounts_below_zero_or_missing_are_dropped(spark):
    rows = [("I1", "P", "A", "10.005", "Paid", "2024-01-01"), ("I2", "P", "A", "-1", "Paid", "2024-01-01"), ("I3", "P", "A", "none", "Paid", "2024-01-01")]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ENTITIES["billing"].columns))
    got = clean("billing", df)
    assert [(r["InvoiceID"], str(r["TotalAmount"])) for r in got.collect()] == [("I1", "10.01")]
    assert dict(got.dtypes)["TotalAmount"] == "decimal(12,2)"


def test_lab_results_outside_a_readable_range(spark):
    rows = [("L1", "P", "T", "5", "10 - 20"), ("L2", "P", "T", "15", "10-20"), ("L3", "P", "T", "high", "10-20"), ("L4", "P", "T", "5", "n/a"), ("L5", "P", "T", " 21.5 ", "10 - 20")]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ENTITIES["laboratory_results"].columns))
    got = {r["LabID"]: r["IsAbnormal"] for r in clean("laboratory_results", df).collect()}
    assert got == {"L1": True, "L2": False, "L3": False, "L4": False, "L5": True}


def test_line_amount_type(spark):
    df = spark.createDataFrame([("R1", "P", "M", "3", "2.50")], ", ".join(f"{c} string" for c in ENTITIES["pharmacy_orders"].columns))
    got = clean("pharmacy_orders", df)
    assert dict(got.dtypes)["LineAmount"] == "decimal(23,2)"
    assert str(got.first()["LineAmount"]) == "7.50"


def test_unknown_entity_is_refused(patients):
    with pytest.raises(ValueError, match="unknown entity"):
        clean("parrots", patients)


def test_unreadable_values_become_null_not_errors(spark):
    df = spark.createDataFrame([("x", "1"), ("2024-01-05", "b")], "d string, n string")
    rows = cast_columns(df, {"d": "date", "n": "int", "absent": "int"}).collect()
    assert [r["d"] for r in rows] == [None, dt.date(2024, 1, 5)]
    assert [r["n"] for r in rows] == [1, None]


def test_ties_are_settled_by_content(spark):
    rows = [("k", 1, "b"), ("k", 1, "a"), ("k", 0, "0")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "k string, at int, v string").repartition(3)
        assert [tuple(r) for r in keep_latest(df, ["k"], "at").collect()] == [("k", 1, "a")]


def test_rank_filter_reaches_below_the_exchange(spark):
    """A hot key shrinks to one row per task before it is shuffled."""
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    plan = keep_latest(df, ["k"], "id")._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_hash_is_stable_and_length_prefix_prevents_collisions(spark):
    df = spark.createDataFrame([("a||b", "c"), ("a", "b||c"), ("a", "b||c"), (None, "c")], "x string, y string")
    plain = [r[0] for r in df.select(record_hash(["x", "y"])).collect()]
    safe = [r[0] for r in df.select(record_hash(["x", "y"], length_prefixed=True)).collect()]
    assert plain[0] == plain[1] == plain[2] and plain[3] != plain[0]
    assert safe[0] != safe[1] and safe[1] == safe[2]


def test_lineage_columns(spark):
    df = spark.createDataFrame([("P1", "Ada")], "PatientID string, FirstName string")
    row = add_lineage(df, "LOAD1", "BATCH1", AT).first()
    assert (row["_load_id"], row["_batch_id"], row["_source_file"]) == ("LOAD1", "BATCH1", "unknown")
    assert row["_record_hash"] and row["ingestion_date"] == AT.date()


def test_ages_and_bands(spark):
    df = spark.createDataFrame([("2007-07-01",), ("2007-06-30",), ("1985-07-01",), ("1960-01-01",), (None,)], "d string")
    age = age_years(F.to_date("d"), AT.date())
    got = [tuple(r) for r in df.select(age, age_band(age), age_band(age, "unknown")).collect()]
    assert got == [(17, "0-17", "0-17"), (18, "18-39", "18-39"), (39, "18-39", "18-39"), (65, "65+", "65+"), (None, "65+", "unknown")]
