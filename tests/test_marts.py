from __future__ import annotations

import datetime as dt
import statistics
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lamina.functions.quantiles import exact_median
from lamina.operators.joins import broadcast_join, fits_broadcast
from lamina.operators.layout import cluster
from lamina.plans import marts, views

AS_OF = dt.date(2025, 6, 30)


@pytest.fixture(scope="module")
def silver(spark):
    def frame(rows, schema):
        return spark.createDataFrame(rows, schema)

    visits = [
        ("A1", "P1", "D1", dt.datetime(2024, 1, 1, 9), "Completed", "flu"),
        ("A2", "P1", "D1", dt.datetime(2024, 1, 1, 10), "Cancelled", " "),
        ("A3", "P2", "D1", dt.datetime(2024, 1, 2, 9), "NoShow", "flu"),
        ("A4", "P9", None, dt.datetime(2024, 1, 2, 9), "Scheduled", None),
        ("A5", "P2", "D9", dt.datetime(2024, 1, 2, 9), "Completed", "cold"),
    ]
    bills = [("I1", "P1", "A1", "10.00", "Paid"), ("I2", "P1", "A1", "5.50", "Pending"), ("I3", "P2", "A5", "1.01", "Paid"), ("I4", "P2", None, "2.00", "Overdue")]
    return {
        "patients": frame([("P1", "a", "b", "Male", dt.date(1990, 1, 1), "X"), ("P2", "c", "d", "Female", None, "Y"), ("P3", "e", "f", "Other", dt.date(2020, 1, 1), "Z")], "PatientID string, FirstName string, LastName string, Gender string, DOB date, InsuranceID string"),
        "doctors": frame([("D1", "n", "s", "dep", "hos", 3), ("D2", "m", "s", "dep", "hos", 4)], "DoctorID string, DoctorName string, Specialization string, Department string, Hospital string, Experience int"),
        "appointments": frame(visits, "AppointmentID string, PatientID string, DoctorID string, AppointmentDate timestamp, Status string, Diagnosis string"),
        "billing": frame([(i, p, a, Decimal(m), s, dt.date(2024, 1, 5)) for i, p, a, m, s in bills], "InvoiceID string, PatientID string, AppointmentID string, TotalAmount decimal(12,2), PaymentStatus string, PaymentDate date"),
        "insurance_claims": frame([("C1", "P1", "co", Decimal("7.00"), "Approved", AS_OF), ("C2", "P1", "co", Decimal("8.00"), "Denied", AS_OF)], "ClaimID string, PatientID string, InsuranceCompany string, ClaimAmount decimal(12,2), ApprovalStatus string, ClaimDate date"),
        "laboratory_results": frame([("L1", "T", True), ("L2", "T", False), ("L3", "U", False)], "LabID string, TestName string, IsAbnormal boolean"),
        "pharmacy_orders": frame([("R1", "P1", "m", 2, Decimal("1.50"), Decimal("3.00")), ("R2", "P1", "m", 1, Decimal("1.50"), Decimal("1.50"))], "PrescriptionID string, PatientID string, Medicine string, Quantity int, Price decimal(12,2), LineAmount decimal(23,2)"),
    }


@pytest.fixture(scope="module")
def built(silver):
    base = marts.base_marts(silver, AS_OF)
    return base | marts.derived_marts(base["revenue_analytics"], base["doctor_performance"])


def test_every_mart_is_there(built):
    assert len(built) == 14 and all(df.columns for df in built.values())


def test_patient_summary(built):
    rows = {r["PatientID"]: r for r in built["patient_summary"].collect()}
    assert set(rows) == {"P1", "P2", "P3"}
    one = rows["P1"]
    assert (one["TotalAppointments"], one["CompletedAppointments"], one["CancelledAppointments"]) == (2, 1, 1)
    assert (one["LifetimeBilled"], one["LifetimePaid"], one["TotalClaims"], one["ApprovedClaims"]) == (Decimal("15.50"), Decimal("10.00"), 2, 1)
    assert (one["Age"], rows["P2"]["Age"], rows["P3"]["LifetimeBilled"]) == (35, None, Decimal("0.00"))
    types = dict(built["patient_summary"].dtypes)
    assert types["LifetimeBilled"] == "decimal(22,2)" and types["Age"] == "int"


def test_doctor_performance_counts_per_invoice_by_default(silver, built):
    (row,) = built["doctor_performance"].collect()
    assert (row["TotalAppointments"], row["CompletedAppointments"], row["CancelledAppointments"], row["NoShowAppointments"]) == (3, 2, 1, 1)
    assert (row["UniquePatients"], row["AttributedRevenue"], row["CompletionRatePct"]) == (2, Decimal("15.50"), 66.67)
    (once,) = marts.doctor_performance(silver["doctors"], silver["appointments"], silver["billing"], True).collect()
    assert (once["CompletedAppointments"], once["CompletionRatePct"]) == (1, 33.33)
    assert built["doctor_utilization"].first()["UtilizationPct"] == 66.67


def test_revenue_keeps_invoices_without_a_known_doctor(built):
    rows = {r["InvoiceID"]: r for r in built["revenue_analytics"].collect()}
    assert set(rows) == {"I1", "I2", "I3", "I4"}
    assert rows["I3"]["Hospital"] is None and rows["I1"]["Hospital"] == "hos"
    assert rows["I1"]["PaymentYearMonth"] == "2024-01"
    hospitals = {r["Hospital"]: r for r in built["hospital_revenue"].collect()}
    assert (hospitals[None]["TotalRevenue"], hospitals[None]["InvoiceCount"], hospitals["hos"]["PatientCount"]) == (Decimal("3.01"), 2, 1)
    assert dict(built["hospital_revenue"].dtypes)["AvgInvoiceAmount"] == "decimal(13,2)"


def test_types_agree_with_a_plain_average(built, silver):
    plain = silver["billing"].agg(F.round(F.avg("TotalAmount"), 2).alias("a"))
    assert dict(plain.dtypes)["a"] == dict(built["hospital_revenue"].dtypes)["AvgInvoiceAmount"]


def test_unknown_birth_date_falls_to_the_oldest_band(built):
    groups = {(r["Gender"], r["AgeGroup"]) for r in built["patient_visit_summary"].collect()}
    assert ("Female", "65+") in groups and (None, "65+") in groups and ("Male", "18-39") in groups


def test_diseases_and_cancellations(built):
    assert [(r["Diagnosis"], r["DiagnosisCount"]) for r in built["top_diseases"].collect()] == [("flu", 2), ("cold", 1)]
    assert [r["AppointmentID"] for r in built["cancelled_appointments"].collect()] == ["A2"]


def test_publish_makes_views_readable_by_sql(spark, built):
    report = views.publish(spark, built)
    assert report["v_executive_kpis"] == "SUCCESS" and report["v_patient_growth"] == "SKIPPED"
    row = spark.sql("SELECT * FROM v_executive_kpis").first()
    assert (row["TotalPatients"], row["TotalDoctors"], row["NetworkRevenue"]) == (3, 1, Decimal("18.51"))
    assert spark.sql("SELECT DoctorID FROM v_top_10_doctors").first()[0] == "D1"


@pytest.mark.parametrize("values", [[], ["1.00"], ["1.00", "2.00"], ["-5.25", "0.00", "7.10", "7.10", None], [str(i * i % 977) for i in range(400)]])
def test_exact_median(spark, values):
    df = spark.createDataFrame([(Decimal(v) if v else None,) for v in values], "x decimal(12,2)")
    present = [Decimal(v) for v in values if v]
    assert exact_median(df, "x", slots=5) == (statistics.median(present) if present else None)


def test_clustered_files_cover_narrower_ranges(spark, folder):
    df = spark.range(4000).select((F.hash("id") % 500).alias("a"), (F.xxhash64("id") % 500).alias("b"), F.col("id"))
    spread = {}
    for name, arranged in (("plain", df.repartition(8)), ("z", cluster(df, ["a", "b"], 8))):
        arranged.write.parquet(f"{folder}/{name}")
        back = spark.read.parquet(f"{folder}/{name}")
        assert back.exceptAll(df).isEmpty() and back.count() == 4000
        ranges = back.groupBy(F.input_file_name()).agg(*[(F.max(c) - F.min(c)).alias(c) for c in "ab"])
        spread[name] = ranges.agg(F.avg("a"), F.avg("b"), F.count("*")).first()
    assert spread["z"][0] < 0.8 * spread["plain"][0] and spread["z"][1] < 0.8 * spread["plain"][1]


def test_one_value_is_still_divided_over_files(spark, folder):
    cluster(spark.range(2000).select(F.lit(1).alias("k"), "id"), ["k"], 4).write.parquet(f"{folder}/hot")
    sizes = [r["count"] for r in spark.read.parquet(f"{folder}/hot").groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1000


def test_broadcast_only_within_bounds(spark):
    left, right = spark.range(50).toDF("k"), spark.range(20).select(F.col("id").alias("k"), F.lit("x" * 100).alias("v"))
    assert fits_broadcast(right) and not fits_broadcast(right, max_rows=19) and not fits_broadcast(right, max_bytes=1000)
    assert broadcast_join(left, right, "k").count() == broadcast_join(left, right, "k", max_rows=1).count() == 50


def test_hot_appointment_is_split_at_run_time(spark):
    """A third of all invoices on one appointment: the join splits that partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        n = 60000
        bills = spark.range(0, n, 1, 8).select(
            F.concat(F.lit("I"), "id").alias("InvoiceID"),
            F.lit("P").alias("PatientID"),
            F.when(F.col("id") % 3 == 0, "A0").otherwise(F.concat(F.lit("A"), "id")).alias("AppointmentID"),
            F.lit(1).cast("decimal(12,2)").alias("TotalAmount"),
            F.lit("Paid").alias("PaymentStatus"),
            F.lit(AS_OF).alias("PaymentDate"),
        )
        visits = spark.range(n).select(F.concat(F.lit("A"), "id").alias("AppointmentID"), F.lit("D1").alias("DoctorID"))
        doctors = spark.createDataFrame([("D1", "n", "d", "h")], "DoctorID string, DoctorName string, Department string, Hospital string")
        out = marts.revenue_analytics(bills, visits, doctors)
        rows = out.where("Hospital = 'h'")
        assert rows.groupBy().count().first()[0] == n
        joined = out.select("InvoiceID", "Hospital")
        joined.write.format("noop").mode("overwrite").save()
        assert joined.collect() and "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in settings:
            spark.conf.unset(key)
