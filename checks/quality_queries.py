"""Data-quality rules, suites and quarantine; audit and log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.oracle_ctes import AS_OF, r2, ts
from checks.registry import AS_OF_DATE, AS_OF_TIME, query
from checks.silver import silver, stored
from lamina.contracts import APPOINTMENT_STATUSES, CLAIM_STATUSES, EMAIL_PATTERN, GENDERS, PAYMENT_STATUSES
from lamina.operators import monitoring as m
from lamina.operators import quality as q
from lamina.plans import suites
from lamina.sources.startables import audit_rows, log_rows, read_entity

RUN = "run-1"


def results(df, rules, entity="entity"):
    out = q.evaluate(df, rules, entity, RUN, AS_OF_TIME)
    return out.select("Entity", "RuleName", "Severity", "FailedCount", "TotalCount", "PassRate", "Status")


def rule_sql(entity: str, source: str, rules: list[tuple[str, str, str]]) -> str:
    """Results of (rule, severity, count of failing rows as SQL) over a source."""
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS RuleName, '{severity}' AS Severity, CAST(coalesce(({count}), 0) AS BIGINT) AS FailedCount"
        for name, severity, count in rules
    )
    return f"""SELECT '{entity}' AS Entity, RuleName, Severity, FailedCount, n AS TotalCount,
        CAST(CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE round((n - FailedCount) / CAST(n AS DOUBLE) * 100, 4) END AS VARCHAR) AS PassRate,
        CASE WHEN FailedCount = 0 THEN 'PASSED' ELSE 'FAILED' END AS Status
        FROM ({rows}), (SELECT count(*) AS n FROM {source})"""


def n_where(source: str, condition: str) -> str:
    return f"SELECT count(*) FROM {source} WHERE {condition}"


def n_repeated(source: str, *columns: str) -> str:
    return f"SELECT sum(n) FROM (SELECT count(*) AS n FROM {source} GROUP BY {', '.join(columns)} HAVING count(*) > 1)"


def n_orphans(source: str, column: str, reference: str, key: str) -> str:
    return f"SELECT count(*) FROM {source} WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {key} FROM {reference})"


def nulls(source: str, *columns: str) -> list[tuple[str, str, str]]:
    return [(f"not_null_{c}", "CRITICAL", n_where(source, f"{c} IS NULL")) for c in columns]


def repeated(source: str, *columns: str) -> tuple[str, str, str]:
    return (f"unique_{'_'.join(columns)}", "CRITICAL", n_repeated(source, *columns))


def orphans(source: str, column: str, reference: str, key: str) -> tuple[str, str, str]:
    return (f"fk_{column}_to_{key}", "CRITICAL", n_orphans(source, column, reference, key))


def outside(source: str, column: str, values: tuple[str, ...]) -> tuple[str, str, str]:
    listed = ", ".join(f"'{v}'" for v in values)
    return (f"valid_values_{column}", "WARNING", n_where(source, f"{column} NOT IN ({listed})"))


def beyond(source: str, column: str, condition: str) -> tuple[str, str, str]:
    return (f"range_{column}", "WARNING", n_where(source, condition))


def unlike(source: str) -> tuple[str, str, str]:
    return ("regex_Email", "WARNING", n_where(source, f"NOT regexp_matches(Email, '{EMAIL_PATTERN}')"))


@query("e01_not_null", rule_sql("billing", "raw_billing", nulls("raw_billing", "InvoiceID", "TotalAmount")))
def _(spark, sf):
    return results(read_entity(spark, sf, "billing"), q.not_null(["InvoiceID", "TotalAmount"]), "billing")


@query(
    "e02_unique",
    rule_sql(
        "billing",
        "raw_billing",
        [repeated("raw_billing", "InvoiceID"), repeated("raw_billing", "AppointmentID", "TotalAmount")],
    ),
)
def _(spark, sf):
    rules = q.unique(["InvoiceID"]) + q.unique(["AppointmentID", "TotalAmount"])
    return results(read_entity(spark, sf, "billing"), rules, "billing")


@query("e03_values_in", rule_sql("billing", "raw_billing", [outside("raw_billing", "PaymentStatus", PAYMENT_STATUSES)]))
def _(spark, sf):
    return results(read_entity(spark, sf, "billing"), q.values_in("PaymentStatus", PAYMENT_STATUSES), "billing")


@query(
    "e04_range",
    rule_sql(
        "billing", "raw_billing", [beyond("raw_billing", "TotalAmount", "TotalAmount < 0 OR TotalAmount > 50000")]
    ),
)
def _(spark, sf):
    return results(read_entity(spark, sf, "billing"), q.in_range("TotalAmount", 0, 50000), "billing")


@query("e05_regex", rule_sql("patients", "raw_patients", [unlike("raw_patients")]))
def _(spark, sf):
    return results(read_entity(spark, sf, "patients"), q.matches("Email", EMAIL_PATTERN), "patients")


@query(
    "e06_business_rule",
    rule_sql(
        "appointments",
        "raw_appointments",
        [("noshow_without_doctor", "WARNING", n_where("raw_appointments", "Status = 'NoShow' AND DoctorID IS NULL"))],
    ),
)
def _(spark, sf):
    rule = q.business_rule(
        "noshow_without_doctor",
        "a missed appointment names its doctor",
        lambda df: (df["Status"] == "NoShow") & df["DoctorID"].isNull(),
    )
    return results(read_entity(spark, sf, "appointments"), rule, "appointments")


@query(
    "e07_foreign_key",
    rule_sql("appointments", "raw_appointments", [orphans("raw_appointments", "PatientID", "raw_patients", "PatientID")]),
)
def _(spark, sf):
    rule = q.foreign_key("PatientID", read_entity(spark, sf, "patients"), "PatientID")
    return results(read_entity(spark, sf, "appointments"), rule, "appointments")


def billing_rules(spark, sf):
    return suites.billing_suite(read_entity(spark, sf, "patients"), silver(spark, sf, "appointments"))


_BILLING = [
    *nulls("raw_billing", "InvoiceID", "PatientID", "TotalAmount", "PaymentStatus"),
    repeated("raw_billing", "InvoiceID"),
    outside("raw_billing", "PaymentStatus", PAYMENT_STATUSES),
    beyond("raw_billing", "TotalAmount", "TotalAmount < 0"),
    orphans("raw_billing", "PatientID", "raw_patients", "PatientID"),
    orphans("raw_billing", "AppointmentID", "appointments", "AppointmentID"),
]


@query("e08_evaluate", rule_sql("billing", "raw_billing", _BILLING))
def _(spark, sf):
    """A whole suite over the uncleaned table."""
    return results(read_entity(spark, sf, "billing"), billing_rules(spark, sf), "billing")


@query(
    "e09_results_table",
    f"""SELECT sha256('{RUN}|billing|' || RuleName) AS ResultID, '{RUN}' AS RunID, Entity, RuleName, FailedCount,
               '{AS_OF} 00:00:00' AS ValidatedAt FROM r""",
    r=rule_sql("billing", "raw_billing", _BILLING),
)
def _(spark, sf):
    out = q.evaluate(read_entity(spark, sf, "billing"), billing_rules(spark, sf), "billing", RUN, AS_OF_TIME)
    return out.select("ResultID", "RunID", "Entity", "RuleName", "FailedCount", "ValidatedAt")


_APPOINTMENT_ROWS = "raw_appointments"


@query(
    "e10_quarantine",
    f"""SELECT AppointmentID, RuleName, Severity FROM (
          SELECT AppointmentID, 'not_null_DoctorID' AS RuleName, 'CRITICAL' AS Severity FROM raw_appointments WHERE DoctorID IS NULL
          UNION ALL SELECT AppointmentID, 'valid_values_Status', 'WARNING' FROM raw_appointments
            WHERE Status NOT IN ({", ".join(f"'{s}'" for s in APPOINTMENT_STATUSES)})
          UNION ALL SELECT AppointmentID, 'fk_PatientID_to_PatientID', 'CRITICAL' FROM raw_appointments
            WHERE PatientID NOT IN (SELECT PatientID FROM raw_patients))""",
)
def _(spark, sf):
    rules = suites.advisory_appointments(read_entity(spark, sf, "patients"), read_entity(spark, sf, "doctors"))
    bad = q.quarantine(read_entity(spark, sf, "appointments"), rules, "appointments", RUN, AS_OF_TIME)
    return bad.select(F.get_json_object("Payload", "$.AppointmentID").alias("AppointmentID"), "RuleName", "Severity")


@query(
    "e10_quarantine_repeated_keys",
    """SELECT InvoiceID, 'unique_InvoiceID' AS RuleName, count(*) AS Rows FROM raw_billing GROUP BY 1 HAVING count(*) > 1""",
)
def _(spark, sf):
    bad = q.quarantine(read_entity(spark, sf, "billing"), q.unique(["InvoiceID"]), "billing", RUN, AS_OF_TIME)
    key = F.get_json_object("Payload", "$.InvoiceID").alias("InvoiceID")
    return bad.groupBy(key, "RuleName").agg(F.count("*").alias("Rows"))


@query(
    "e11_failures_by_severity",
    """SELECT Entity, Severity, CAST(sum(FailedCount) AS BIGINT) AS FailedRows,
              count(*) FILTER (WHERE Status = 'FAILED') AS FailedRules FROM r GROUP BY 1, 2""",
    r=rule_sql("billing", "raw_billing", _BILLING),
)
def _(spark, sf):
    return q.failures_by_severity(results(read_entity(spark, sf, "billing"), billing_rules(spark, sf), "billing"))


# --- the suites, each over its cleaned table --------------------------------
SUITE_SQL: dict[str, tuple[str, list[tuple[str, str, str]]]] = {
    "e14_patients_suite": (
        "patients",
        [
            *nulls("patients", "PatientID", "FirstName", "LastName", "DOB", "Gender"),
            repeated("patients", "PatientID"),
            unlike("patients"),
            ("dob_not_future", "CRITICAL", n_where("patients", f"DOB > DATE '{AS_OF}'")),
        ],
    ),
    "e15_doctors_suite": (
        "doctors",
        [
            *nulls("doctors", "DoctorID", "DoctorName", "Specialization", "Department"),
            repeated("doctors", "DoctorID"),
            beyond("doctors", "Experience", "Experience < 0 OR Experience > 60"),
        ],
    ),
    "e16_appointments_suite": (
        "appointments",
        [
            *nulls("appointments", "AppointmentID", "PatientID", "DoctorID", "AppointmentDate", "Status"),
            repeated("appointments", "AppointmentID"),
            orphans("appointments", "PatientID", "patients", "PatientID"),
            orphans("appointments", "DoctorID", "doctors", "DoctorID"),
            (
                "completed_requires_diagnosis",
                "WARNING",
                n_where("appointments", "Status = 'Completed' AND coalesce(trim(Diagnosis), '') = ''"),
            ),
        ],
    ),
    "e17_claims_suite": (
        "insurance_claims",
        [
            *nulls("insurance_claims", "ClaimID", "PatientID", "ClaimAmount", "ApprovalStatus"),
            repeated("insurance_claims", "ClaimID"),
            outside("insurance_claims", "ApprovalStatus", CLAIM_STATUSES),
            beyond("insurance_claims", "ClaimAmount", "ClaimAmount < 0 OR ClaimAmount > 1000000"),
            orphans("insurance_claims", "PatientID", "patients", "PatientID"),
        ],
    ),
    "e18_billing_suite": ("billing", [(n, s, c.replace("raw_billing", "billing").replace("raw_patients", "patients")) for n, s, c in _BILLING]),
    "e19_pharmacy_suite": (
        "pharmacy_orders",
        [
            *nulls("pharmacy_orders", "PrescriptionID", "PatientID", "Medicine", "Quantity", "Price"),
            repeated("pharmacy_orders", "PrescriptionID"),
            beyond("pharmacy_orders", "Quantity", "Quantity < 1"),
            beyond("pharmacy_orders", "Price", "Price < 0"),
            orphans("pharmacy_orders", "PatientID", "patients", "PatientID"),
        ],
    ),
    "e20_labs_suite": (
        "laboratory_results",
        [
            *nulls("laboratory_results", "LabID", "PatientID", "TestName", "Result"),
            repeated("laboratory_results", "LabID"),
            orphans("laboratory_results", "PatientID", "patients", "PatientID"),
        ],
    ),
}


class _Plans(dict):
    """Cleaned entities as plans, for the references a suite reads once."""

    def __init__(self, spark, sf):
        super().__init__()
        self.spark, self.sf = spark, sf

    def __missing__(self, name):
        return silver(self.spark, self.sf, name)


def suite_results(spark, sf, entity):
    checked = stored(silver(spark, sf, entity), entity)
    return results(checked, suites.SUITES[entity](_Plans(spark, sf), AS_OF_DATE), entity)


for _key, (_entity, _rules) in SUITE_SQL.items():
    query(_key, rule_sql(_entity, _entity, _rules))(lambda spark, sf, e=_entity: suite_results(spark, sf, e))


@query(
    "e12_advisory_patients",
    rule_sql(
        "patients",
        "raw_patients",
        [
            *nulls("raw_patients", "PatientID", "FirstName", "LastName", "DOB"),
            repeated("raw_patients", "PatientID"),
            outside("raw_patients", "Gender", GENDERS),
            unlike("raw_patients"),
        ],
    ),
)
def _(spark, sf):
    return results(read_entity(spark, sf, "patients"), suites.advisory_patients(), "patients")


@query(
    "e13_advisory_appointments",
    rule_sql(
        "appointments",
        "raw_appointments",
        [
            *nulls("raw_appointments", "AppointmentID", "PatientID", "DoctorID", "AppointmentDate"),
            repeated("raw_appointments", "AppointmentID"),
            outside("raw_appointments", "Status", APPOINTMENT_STATUSES),
            orphans("raw_appointments", "PatientID", "raw_patients", "PatientID"),
            orphans("raw_appointments", "DoctorID", "raw_doctors", "DoctorID"),
        ],
    ),
)
def _(spark, sf):
    rules = suites.advisory_appointments(read_entity(spark, sf, "patients"), read_entity(spark, sf, "doctors"))
    return results(read_entity(spark, sf, "appointments"), rules, "appointments")


ALL_RESULTS = " UNION ALL ".join(f"({rule_sql(e, e, r)})" for e, r in SUITE_SQL.values())


@query(
    "d16_constraints",
    rule_sql(
        "billing",
        "raw_billing",
        [
            ("amount_not_negative", "CRITICAL", n_where("raw_billing", "NOT (TotalAmount >= 0)")),
            *nulls("raw_billing", "InvoiceID"),
            repeated("raw_billing", "InvoiceID"),
        ],
    ),
)
def _(spark, sf):
    rules = q.constraints({"amount_not_negative": "TotalAmount >= 0"}, ["InvoiceID"])
    return results(read_entity(spark, sf, "billing"), rules, "billing")


# --- audit and log rows -----------------------------------------------------
@query(
    "o02_audit_summary",
    f"""SELECT PipelineName, Status, count(*) AS Runs, {r2('avg(ExecutionTimeSeconds)')} AS AvgSeconds,
               CAST(sum(RowsRead) AS BIGINT) AS TotalRowsRead, CAST(sum(RowsInserted) AS BIGINT) AS TotalRowsInserted,
               {ts('max(EndTime)')} AS LastRun FROM audit_rows GROUP BY 1, 2""",
)
def _(spark, sf):
    return m.audit_summary(audit_rows(spark, sf))


@query(
    "o03_latest_audit",
    f"""SELECT * REPLACE ({ts('a.StartTime')} AS StartTime, {ts('a.EndTime')} AS EndTime)
        FROM (SELECT * FROM audit_rows ORDER BY StartTime DESC, AuditID LIMIT 50) a""",
)
def _(spark, sf):
    return m.latest_audit(audit_rows(spark, sf))


@query(
    "o05_problem_logs",
    f"""SELECT * REPLACE ({ts('a.LoggedAt')} AS LoggedAt)
        FROM (SELECT * FROM log_rows WHERE LogLevel IN ('ERROR', 'WARNING', 'CRITICAL') ORDER BY LoggedAt DESC, LogID LIMIT 100) a""",
)
def _(spark, sf):
    return m.problem_logs(log_rows(spark, sf))


@query("o06_log_counts", 'SELECT PipelineName, LogLevel, count(*) AS "count" FROM log_rows GROUP BY 1, 2')
def _(spark, sf):
    return m.log_counts(log_rows(spark, sf))
