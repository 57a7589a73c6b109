"""Standardisers and the seven entity cleaners."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.oracle_ctes import AS_OF, age, d, ts
from checks.registry import AS_OF_DATE, query
from checks.silver import silver
from lamina.contracts import ENTITIES
from lamina.functions.ages import age_years
from lamina.functions.text import email_canonical, fit_domain, outside_range, phone_digits
from lamina.operators import cleaning as c
from lamina.operators.lineage import add_lineage
from lamina.sources.startables import patient_updates, read_entity, table


@query("c01_trim_columns", "SELECT LabID, trim(Result) AS Result, NormalRange FROM raw_laboratory_results")
def _(spark, sf):
    labs = read_entity(spark, sf, "laboratory_results")
    return c.trim_columns(labs, ["LabID", "Result", "NormalRange", "NotThere"]).select("LabID", "Result", "NormalRange")


@query("c02_phone_digits", "SELECT PatientID, regexp_replace(Phone, '[^0-9+]', '', 'g') AS Phone FROM raw_patients")
def _(spark, sf):
    return read_entity(spark, sf, "patients").select("PatientID", phone_digits(F.col("Phone")).alias("Phone"))


@query("c03_email_canonical", "SELECT PatientID, lower(trim(Email)) AS Email FROM raw_patients")
def _(spark, sf):
    return read_entity(spark, sf, "patients").select("PatientID", email_canonical(F.col("Email")).alias("Email"))


@query(
    "c04_cast_columns",
    """SELECT LabID, CAST(TRY_CAST(trim(Result) AS DECIMAL(12,2)) AS DOUBLE) AS Result,
              CAST(TRY_CAST(PatientID AS INTEGER) AS BIGINT) AS PatientID FROM raw_laboratory_results""",
)
def _(spark, sf):
    labs = c.trim_columns(read_entity(spark, sf, "laboratory_results"), ["Result"])
    return c.cast_columns(labs, {"Result": "decimal(12,2)", "PatientID": "int", "NotThere": "date"}).select(
        "LabID", "Result", "PatientID"
    )


@query(
    "c05_fit_domain",
    """SELECT p.PatientID, g.Gender, a.AppointmentID, a.Status FROM raw_patients p
       JOIN (SELECT PatientID AS pid, CASE lower(trim(Gender)) WHEN 'male' THEN 'Male' WHEN 'female' THEN 'Female'
             WHEN 'other' THEN 'Other' ELSE 'Unknown' END AS Gender FROM raw_patients) g ON g.pid = p.PatientID
       JOIN (SELECT AppointmentID, PatientID, CASE WHEN Status IN ('Scheduled','Completed','Cancelled','NoShow','Rescheduled')
             THEN Status ELSE 'Scheduled' END AS Status FROM raw_appointments) a ON a.PatientID = p.PatientID""",
)
def _(spark, sf):
    gender = ENTITIES["patients"].domains["Gender"]
    status = ENTITIES["appointments"].domains["Status"]
    people = read_entity(spark, sf, "patients").select("PatientID", fit_domain(F.trim("Gender"), gender).alias("Gender"))
    visits = read_entity(spark, sf, "appointments").select(
        "PatientID", "AppointmentID", fit_domain(F.col("Status"), status).alias("Status")
    )
    return people.join(visits, "PatientID")


@query(
    "c06_floor",
    "SELECT DoctorID, CAST(CASE WHEN Experience < 0 THEN 0 ELSE Experience END AS BIGINT) AS Experience FROM raw_doctors",
)
def _(spark, sf):
    return c.standardise(read_entity(spark, sf, "doctors"), ENTITIES["doctors"]).select("DoctorID", "Experience")


@query(
    "c07_valid_rows",
    """SELECT 'billing' AS Entity, count(*) AS Kept FROM raw_billing WHERE InvoiceID IS NOT NULL AND TotalAmount >= 0
       UNION ALL SELECT 'pharmacy_orders', count(*) FROM raw_pharmacy_orders WHERE Quantity > 0 AND Price >= 0
       UNION ALL SELECT 'patients', count(*) FROM raw_patients WHERE trim(PatientID) <> ''
       UNION ALL SELECT 'doctors', count(*) FROM raw_doctors WHERE DoctorID IS NOT NULL
       UNION ALL SELECT 'appointments', count(*) FROM raw_appointments WHERE AppointmentID IS NOT NULL
       UNION ALL SELECT 'insurance_claims', count(*) FROM raw_insurance_claims WHERE ClaimID IS NOT NULL AND ClaimAmount >= 0
       UNION ALL SELECT 'laboratory_results', count(*) FROM raw_laboratory_results WHERE LabID IS NOT NULL""",
)
def _(spark, sf):
    parts = [
        read_entity(spark, sf, name)
        .where(c.valid_rows(ENTITIES[name]))
        .agg(F.lit(name).alias("Entity"), F.count("*").alias("Kept"))
        for name in ENTITIES
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "c08_dedupe_latest",
    f"""SELECT user_id AS UserID, event_id AS EventID, event_type AS Kind, value AS Amount, {ts('CAST(ts AS TIMESTAMP)')} AS SeenAt
        FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id, event_type, value) = 1""",
)
def _(spark, sf):
    seen = table(spark, sf, "events").select(
        F.col("user_id").alias("UserID"),
        F.col("event_id").alias("EventID"),
        F.col("event_type").alias("Kind"),
        F.col("value").alias("Amount"),
        F.col("ts").cast("timestamp").alias("SeenAt"),
    )
    return c.keep_latest(seen, ["UserID"], "SeenAt")


@query(
    "c09_one_per_key",
    """SELECT l_orderkey AS OrderID, l_linenumber AS Line, l_partkey AS PartID, l_quantity AS Quantity FROM lineitem
       QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey NULLS FIRST, l_quantity NULLS FIRST) = 1""",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("OrderID"),
        F.col("l_linenumber").alias("Line"),
        F.col("l_partkey").alias("PartID"),
        F.col("l_quantity").alias("Quantity"),
    )
    return c.one_per_key(lines, ["OrderID", "Line"])


@query(
    "c10_outside_range",
    """SELECT LabID, coalesce(TRY_CAST(trim(Result) AS DOUBLE) < lo OR TRY_CAST(trim(Result) AS DOUBLE) > hi, false) AS IsAbnormal
       FROM (SELECT *, TRY_CAST(regexp_extract(NormalRange, '^\\s*([0-9.]+)\\s*-', 1) AS DOUBLE) AS lo,
                    TRY_CAST(regexp_extract(NormalRange, '-\\s*([0-9.]+)\\s*$', 1) AS DOUBLE) AS hi FROM raw_laboratory_results)""",
)
def _(spark, sf):
    return read_entity(spark, sf, "laboratory_results").select(
        "LabID", outside_range(F.trim("Result"), F.col("NormalRange")).alias("IsAbnormal")
    )


@query(
    "c11_line_amount",
    "SELECT PrescriptionID, CAST(LineAmount AS DOUBLE) AS LineAmount FROM pharmacy_orders",
)
def _(spark, sf):
    return silver(spark, sf, "pharmacy_orders").select("PrescriptionID", "LineAmount")


@query("c12_drop_lineage", "SELECT DoctorID, DoctorName, Specialization, Department, Hospital, Experience FROM raw_doctors")
def _(spark, sf):
    bronze = add_lineage(read_entity(spark, sf, "doctors"), "LOAD", "BATCH", AS_OF_DATE)
    return c.drop_lineage(bronze)


@query(
    "c13_fill_nulls",
    """SELECT InvoiceID, CAST(coalesce(TotalAmount, 0) AS DOUBLE) AS TotalAmount, PaymentStatus FROM raw_billing""",
)
def _(spark, sf):
    bills = read_entity(spark, sf, "billing").select(
        "InvoiceID", F.col("TotalAmount").cast("double").alias("TotalAmount"), "PaymentStatus"
    )
    return c.fill_nulls(bills, {"TotalAmount": 0.0, "PaymentStatus": "Pending"})


_PATIENT_SQL = f"""SELECT * REPLACE ({d('DOB')} AS DOB, {ts('CreatedDate')} AS CreatedDate,
                          {ts('ModifiedDate')} AS ModifiedDate) FROM patient_updates"""


@query("c14_clean_patients", _PATIENT_SQL)
def _(spark, sf):
    return c.clean("patients", patient_updates(spark, sf))


@query("c15_clean_doctors", "SELECT * FROM doctors")
def _(spark, sf):
    return silver(spark, sf, "doctors")


@query("c16_clean_appointments", f"SELECT * REPLACE ({ts('AppointmentDate')} AS AppointmentDate) FROM appointments")
def _(spark, sf):
    return silver(spark, sf, "appointments")


@query(
    "c17_clean_insurance_claims",
    f"SELECT * REPLACE (CAST(ClaimAmount AS DOUBLE) AS ClaimAmount, {d('ClaimDate')} AS ClaimDate) FROM insurance_claims",
)
def _(spark, sf):
    return silver(spark, sf, "insurance_claims")


@query(
    "c18_clean_pharmacy_orders",
    "SELECT * REPLACE (CAST(Price AS DOUBLE) AS Price, CAST(LineAmount AS DOUBLE) AS LineAmount) FROM pharmacy_orders",
)
def _(spark, sf):
    return silver(spark, sf, "pharmacy_orders")


@query("c19_clean_laboratory_results", "SELECT * EXCLUDE (lo, hi) FROM laboratory_results")
def _(spark, sf):
    return silver(spark, sf, "laboratory_results")


@query(
    "c20_clean_billing",
    f"SELECT * REPLACE (CAST(TotalAmount AS DOUBLE) AS TotalAmount, {d('PaymentDate')} AS PaymentDate) FROM billing",
)
def _(spark, sf):
    return silver(spark, sf, "billing")


@query(
    "c21_clean_by_name",
    " UNION ALL ".join(f"SELECT '{n}' AS Entity, count(*) AS Kept FROM {n}" for n in ENTITIES),
)
def _(spark, sf):
    out = None
    for name in ENTITIES:
        part = silver(spark, sf, name).agg(F.lit(name).alias("Entity"), F.count("*").alias("Kept"))
        out = part if out is None else out.unionByName(part)
    return out


@query("c22_age_years", f"SELECT PatientID, CAST({age('DOB')} AS BIGINT) AS Age, '{AS_OF}' AS AsOf FROM raw_patients")
def _(spark, sf):
    return read_entity(spark, sf, "patients").select(
        "PatientID", age_years(F.col("DOB"), AS_OF_DATE).alias("Age"), F.lit(AS_OF).alias("AsOf")
    )
