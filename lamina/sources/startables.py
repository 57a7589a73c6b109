"""Read the star-schema parquet tables as the seven entities.

Keys are built by joining text to integer keys, and some values are left dirty
on purpose (padded text, unknown statuses, negative or missing amounts, unknown
references), so the cleaning and quality operators have real work on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.contracts import MONEY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, *parts: Column | str) -> Column:
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.concat(F.lit(prefix), F.concat_ws("-", *[c.cast("string") for c in columns]))


def doctors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = (table(spark, sf_dir, t) for t in ("nation", "region"))
    return (
        table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            _id("DOC", "s_suppkey").alias("DoctorID"),
            F.col("s_name").alias("DoctorName"),
            F.col("n_name").alias("Specialization"),
            F.col("n_name").alias("Department"),
            F.col("r_name").alias("Hospital"),
            (F.col("s_suppkey") % 40 - 2).cast("int").alias("Experience"),
        )
    )


def _patient_columns() -> dict[str, Column]:
    key = F.col("c_custkey")
    created = F.timestamp_add("DAY", (key % 1000).cast("int"), F.lit("2020-01-01").cast("timestamp"))
    return {
        "PatientID": _id("PAT", key),
        "FirstName": F.when(key % 97 != 0, F.col("c_mktsegment")),
        "LastName": F.col("c_name"),
        "DOB": F.date_add(F.lit("1930-01-01").cast("date"), (key * 37 % 30000).cast("int")),
        "Gender": F.when(key % 5 == 0, "male").when(key % 5 == 1, " FEMALE ").when(key % 5 == 2, "Other").when(
            key % 5 == 3, "x"
        ),
        "Phone": F.concat(F.lit("(+1) 555-"), (key + 1000000).cast("string")),
        "Email": F.when(key % 10 == 0, F.concat(F.lit("bad-email-"), key.cast("string"))).otherwise(
            F.concat(F.lit("  USER"), key.cast("string"), F.lit("@Example.COM "))
        ),
        "Address": F.concat(key.cast("string"), F.lit(" Main St")),
        "InsuranceID": _id("INS", "c_nationkey"),
        "CreatedDate": created,
        "ModifiedDate": F.timestamp_add("DAY", (key % 365).cast("int"), created),
    }


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = _patient_columns()
    return table(spark, sf_dir, "customer").select(*[c.alias(n) for n, c in columns.items()])


def patient_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One patient record per order: many versions of a key, some on the same day."""
    columns = _patient_columns()
    columns["Address"] = F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" St "))
    columns["Phone"] = F.concat(F.lit("555-"), F.col("o_orderstatus"), F.col("o_orderkey").cast("string"))
    columns["ModifiedDate"] = F.col("o_orderdate").cast("timestamp")
    return (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(*[c.alias(n) for n, c in columns.items()])
    )


def appointments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the first supplier of their lines; some have none."""
    lead = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("_supplier"))
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    stray = F.when((status == "P") & (priority == "5-LOW"), F.lit(100000000)).otherwise(0)
    return (
        table(spark, sf_dir, "orders")
        .join(lead, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            _id("APT", "o_orderkey").alias("AppointmentID"),
            _id("PAT", F.col("o_custkey") + stray).alias("PatientID"),
            F.when(F.col("_supplier").isNotNull(), _id("DOC", "_supplier")).alias("DoctorID"),
            F.col("o_orderdate").cast("timestamp").alias("AppointmentDate"),
            F.when((status == "F") & (priority == "1-URGENT"), " Completed ")
            .when(status == "F", "Completed")
            .when((status == "O") & (priority == "2-HIGH"), "scheduled")
            .when(status == "O", "Scheduled")
            .when(priority == "5-LOW", "NoShow")
            .otherwise("Cancelled")
            .alias("Status"),
            F.when(priority == "4-NOT SPECIFIED", "  ").otherwise(priority).alias("Diagnosis"),
        )
    )


def billing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as invoices; (order, line) repeats, so invoice ids do too."""
    flag, status, quantity = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_quantity")
    price = F.col("l_extendedprice").cast(MONEY)
    # Lines move to their orders in the few narrow columns that invoices have.
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(quantity == 49, -price).when(quantity != 50, price).cast(MONEY).alias("TotalAmount"),
        F.when(flag == "A", "Paid")
        .when((flag == "N") & (status == "F"), "Partial")
        .when(flag == "N", "Pending")
        .when(status == "O", "overdue")
        .otherwise("Overdue")
        .alias("PaymentStatus"),
        F.col("l_shipdate").cast("date").alias("PaymentDate"),
    )
    return lines.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        _id("INV", "l_orderkey", "l_linenumber").alias("InvoiceID"),
        _id("PAT", "o_custkey").alias("PatientID"),
        _id("APT", "l_orderkey").alias("AppointmentID"),
        "TotalAmount",
        "PaymentStatus",
        "PaymentDate",
    )


def insurance_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = F.col("o_orderpriority")
    return (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            _id("CLM", "o_orderkey").alias("ClaimID"),
            _id("PAT", "o_custkey").alias("PatientID"),
            F.col("c_mktsegment").alias("InsuranceCompany"),
            F.col("o_totalprice").cast(MONEY).alias("ClaimAmount"),
            F.when(priority == "1-URGENT", "Approved")
            .when(priority == "2-HIGH", "Denied")
            .when(priority == "3-MEDIUM", "Partial")
            .when(priority == "4-NOT SPECIFIED", "unknown")
            .otherwise("Pending")
            .alias("ApprovalStatus"),
            F.col("o_orderdate").cast("date").alias("ClaimDate"),
        )
    )


def pharmacy_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            _id("RX", "l_orderkey", "l_linenumber").alias("PrescriptionID"),
            _id("PAT", "o_custkey").alias("PatientID"),
            F.col("p_name").alias("Medicine"),
            (F.col("l_quantity").cast("int") - 1).alias("Quantity"),
            F.col("p_retailprice").cast(MONEY).alias("Price"),
        )
    )


def laboratory_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    return table(spark, sf_dir, "events").select(
        _id("LAB", "event_id").alias("LabID"),
        _id("PAT", "user_id").alias("PatientID"),
        kind.alias("TestName"),
        F.when((kind == "purchase") & (value < 1), "pending")
        .otherwise(F.concat(F.lit(" "), value.cast(MONEY).cast("string")))
        .alias("Result"),
        F.when(kind == "error", "n/a").otherwise("10 - 200").alias("NormalRange"),
    )


READERS = {
    "patients": patients,
    "doctors": doctors,
    "appointments": appointments,
    "insurance_claims": insurance_claims,
    "pharmacy_orders": pharmacy_orders,
    "laboratory_results": laboratory_results,
    "billing": billing,
}


def read_entity(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return READERS[name](spark, sf_dir)


def status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change log: what each user's latest event type was, over time."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("Key"),
        F.col("event_type").alias("State"),
        F.col("ts").cast("timestamp").alias("ChangedAt"),
        F.col("event_id").alias("Sequence"),
    )


def customer_state(spark: SparkSession, sf_dir: str, since: str | None, until: str | None) -> DataFrame:
    """Each customer's newest order within a period: one load of a keyed table."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("CustomerID"),
        F.col("o_orderkey").alias("OrderID"),
        F.col("o_orderstatus").alias("Status"),
        F.col("o_totalprice").cast(MONEY).alias("Amount"),
        F.col("o_orderdate").cast("timestamp").alias("OrderedAt"),
    )
    if since:
        orders = orders.where(F.col("OrderedAt") >= F.lit(since).cast("timestamp"))
    if until:
        orders = orders.where(F.col("OrderedAt") < F.lit(until).cast("timestamp"))
    from lamina.operators.cleaning import keep_latest

    return keep_latest(orders, ["CustomerID"], "OrderedAt")


def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as one audit row per tracked step."""
    kind = F.col("event_type")
    start = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("AuditID"),
        kind.alias("PipelineName"),
        F.concat(F.lit("table_"), (F.col("user_id") % 7).cast("string")).alias("TableName"),
        start.alias("StartTime"),
        F.timestamp_add("SECOND", F.col("value").cast("int"), start).alias("EndTime"),
        F.when((kind == "error") | (F.col("value") > 200), "FAILED").otherwise("SUCCESS").alias("Status"),
        F.col("user_id").alias("RowsRead"),
        (F.col("user_id") % 11).alias("RowsInserted"),
        F.col("value").alias("ExecutionTimeSeconds"),
    )


def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as log lines."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("LogID"),
        F.concat(F.lit("job_"), (F.col("user_id") % 5).cast("string")).alias("PipelineName"),
        F.when(kind == "error", "ERROR")
        .when(kind == "signup", "WARNING")
        .when((kind == "purchase") & (F.col("value") > 100), "CRITICAL")
        .otherwise("INFO")
        .alias("LogLevel"),
        F.col("props").alias("Message"),
        F.col("ts").cast("timestamp").alias("LoggedAt"),
    )
