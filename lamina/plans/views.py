"""Named views and dashboard figures over the gold marts.

Each one is a function of the marts it reads, so a figure costs only those
marts.  ``publish`` registers marts and views as temporary views, after which
plain ``spark.sql`` text reads them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.quantiles import exact_median
from lamina.functions.sketches import merged_quantiles, quantile_sketches
from lamina.plans.marts import department_revenue

Marts = Mapping[str, DataFrame]
VIEWS: dict[str, Callable[[Marts], DataFrame]] = {}
FIGURES: dict[str, Callable[[Marts], DataFrame]] = {}

# Report sizes and the statuses that still owe money.
DOCTORS_SHOWN = 10
DISEASES_SHOWN = 15
PATIENTS_SHOWN = 25
OUTSTANDING = ("Pending", "Overdue", "Partial")


def _view(build: Callable[[Marts], DataFrame]) -> Callable[[Marts], DataFrame]:
    VIEWS[f"v_{build.__name__}"] = build
    return build


def _figure(build: Callable[[Marts], DataFrame]) -> Callable[[Marts], DataFrame]:
    FIGURES[build.__name__] = build
    return build


def _rate(part: str, whole: str) -> Column:
    return F.round(F.col(part) / F.nullif(F.col(whole), F.lit(0)) * 100, 2)


def _cohorts(df: DataFrame, moment: str) -> DataFrame:
    month = F.date_format(moment, "yyyy-MM").alias("CohortMonth")
    return df.groupBy(month).agg(F.count("*").alias("NewPatients")).orderBy("CohortMonth")


# --- views ------------------------------------------------------------------
@_view
def top_10_doctors(m: Marts) -> DataFrame:
    return (
        m["doctor_performance"]
        .drop("Experience", "CancelledAppointments", "NoShowAppointments")
        .orderBy(F.desc("AttributedRevenue"), "DoctorID")
        .limit(DOCTORS_SHOWN)
    )


@_view
def monthly_revenue(m: Marts) -> DataFrame:
    return (
        m["monthly_revenue"]
        .withColumn("CollectionRatePct", _rate("CollectedRevenue", "TotalRevenue"))
        .orderBy("PaymentYear", "PaymentMonth")
    )


@_view
def insurance_approval_pct(m: Marts) -> DataFrame:
    return m["insurance_analytics"].orderBy(F.desc("ApprovalRatePct"), "InsuranceCompany")


@_view
def revenue_by_department(m: Marts) -> DataFrame:
    return department_revenue(m["revenue_analytics"]).orderBy(F.desc("TotalRevenue"), "Department")


@_view
def patient_growth(m: Marts) -> DataFrame:
    return _cohorts(m["patients_current"], "CreatedDate")


@_view
def patient_growth_by_first_visit(m: Marts) -> DataFrame:
    return _cohorts(m["patient_summary"].where(F.col("FirstVisitDate").isNotNull()), "FirstVisitDate")


@_view
def daily_appointments(m: Marts) -> DataFrame:
    """Appointments per day; ``UniquePatients`` adds up the groups of the mart."""
    n = F.col("AppointmentCount")

    def having(status: str) -> Column:
        return F.sum(F.when(F.col("Status") == status, n).otherwise(0))

    return (
        m["appointment_analytics"]
        .groupBy("AppointmentDay")
        .agg(
            F.sum(n).alias("TotalAppointments"),
            having("Completed").alias("Completed"),
            having("Cancelled").alias("Cancelled"),
            having("NoShow").alias("NoShows"),
            F.sum("UniquePatients").alias("UniquePatients"),
        )
        .orderBy("AppointmentDay")
    )


def daily_appointments_exact(appointments: DataFrame) -> DataFrame:
    """Like ``daily_appointments`` with each patient counted once per day."""
    per_patient = appointments.groupBy(F.to_date("AppointmentDate").alias("AppointmentDay"), "PatientID").agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("Status") == s).alias(s) for s in ("Completed", "Cancelled", "NoShow")],
    )
    return (
        per_patient.groupBy("AppointmentDay")
        .agg(
            F.sum("n").alias("TotalAppointments"),
            F.sum("Completed").alias("Completed"),
            F.sum("Cancelled").alias("Cancelled"),
            F.sum("NoShow").alias("NoShows"),
            F.count("PatientID").alias("UniquePatients"),
        )
        .orderBy("AppointmentDay")
    )


def _billing_figures(revenue: DataFrame, median: Column) -> DataFrame:
    amount = F.col("TotalAmount")
    return revenue.agg(
        F.round(F.avg(amount), 2).alias("AvgInvoiceAmount"),
        median.alias("MedianInvoiceAmount"),
        F.min(amount).alias("MinInvoiceAmount"),
        F.max(amount).alias("MaxInvoiceAmount"),
        F.count("*").alias("InvoiceCount"),
        F.sum(amount).alias("TotalBilled"),
    )


@_view
def average_billing(m: Marts) -> DataFrame:
    """Billing figures with a sketched median, one pass."""
    return _billing_figures(m["revenue_analytics"], F.round(F.percentile_approx("TotalAmount", 0.5), 2))


def average_billing_exact(m: Marts) -> DataFrame:
    """Billing figures with the exact median, found by histogram narrowing.

    The mart is read a few times; pass a stored table, not a long plan.
    """
    revenue = m["revenue_analytics"]
    median: Decimal | None = exact_median(revenue, "TotalAmount")
    return _billing_figures(revenue, F.lit(median).cast("decimal(13,3)"))


def daily_billing_sketches(m: Marts) -> DataFrame:
    """A quantile sketch of the invoices of each payment day, to be stored; new days add rows."""
    return quantile_sketches(m["revenue_analytics"], ["PaymentDate"], "TotalAmount")


def median_of_days(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Invoices and median of any days whose sketches are stored; no invoice is read."""
    return merged_quantiles(sketches, [0.5], by).select(*by, F.col("Rows").alias("InvoiceCount"), F.round(F.col("Quantiles")[0], 2).alias("MedianInvoice"))


@_view
def lab_trends(m: Marts) -> DataFrame:
    return m["laboratory_trends"].orderBy(F.desc("AbnormalRatePct"), "TestName")


@_view
def prescription_trends(m: Marts) -> DataFrame:
    return m["pharmacy_sales"].orderBy(F.desc("TotalSales"), "Medicine")


@_view
def executive_kpis(m: Marts) -> DataFrame:
    """Six network figures in one row: the one-row aggregates of four marts side by side."""
    patients = m["patient_summary"].agg(
        F.count("*").alias("TotalPatients"), F.sum("CancelledAppointments").alias("CancelledAppointments")
    )
    doctors = m["doctor_performance"].agg(F.count("*").alias("TotalDoctors"))
    money = m["hospital_revenue"].agg(
        F.sum("TotalRevenue").alias("NetworkRevenue"), F.sum("CollectedRevenue").alias("NetworkCollected")
    )
    payers = m["insurance_analytics"].agg(F.avg("ApprovalRatePct").alias("AvgInsuranceApprovalPct"))
    return patients.select(
        "TotalPatients",
        doctors.scalar().alias("TotalDoctors"),
        money.select("NetworkRevenue").scalar().alias("NetworkRevenue"),
        money.select("NetworkCollected").scalar().alias("NetworkCollected"),
        "CancelledAppointments",
        payers.scalar().alias("AvgInsuranceApprovalPct"),
    )


# --- dashboard figures ------------------------------------------------------
@_figure
def total_patients(m: Marts) -> DataFrame:
    return m["patient_summary"].agg(F.count("*").alias("total_patients"))


@_figure
def network_revenue(m: Marts) -> DataFrame:
    return m["hospital_revenue"].agg(F.round(F.sum("TotalRevenue"), 2).alias("network_revenue"))


@_figure
def collection_rate(m: Marts) -> DataFrame:
    sums = m["hospital_revenue"].agg(F.sum("CollectedRevenue").alias("got"), F.sum("TotalRevenue").alias("due"))
    return sums.select(_rate("got", "due").alias("collection_rate_pct"))


@_figure
def average_approval(m: Marts) -> DataFrame:
    """Plain mean over payers, not weighted by their claims."""
    return m["insurance_analytics"].agg(F.round(F.avg("ApprovalRatePct"), 2).alias("avg_approval_pct"))


@_figure
def monthly_trend(m: Marts) -> DataFrame:
    return (
        m["monthly_revenue"]
        .select("PaymentYearMonth", "TotalRevenue", "CollectedRevenue")
        .orderBy("PaymentYearMonth")
    )


@_figure
def revenue_by_hospital(m: Marts) -> DataFrame:
    return (
        m["hospital_revenue"]
        .select("Hospital", "TotalRevenue", "CollectedRevenue", "PendingRevenue")
        .orderBy(F.desc("TotalRevenue"), "Hospital")
    )


@_figure
def leading_diseases(m: Marts) -> DataFrame:
    return m["top_diseases"].orderBy(F.desc("DiagnosisCount"), "Diagnosis").limit(DISEASES_SHOWN)


@_figure
def utilization_by_hospital(m: Marts) -> DataFrame:
    return (
        m["doctor_utilization"]
        .select("Hospital", "Department", "DoctorName", "UtilizationPct", "AttributedRevenue")
        .orderBy("Hospital", F.desc("UtilizationPct"))
    )


@_figure
def payment_status_mix(m: Marts) -> DataFrame:
    return (
        m["revenue_analytics"]
        .groupBy("PaymentStatus")
        .agg(F.count("*").alias("invoices"), F.round(F.sum("TotalAmount"), 2).alias("amount"))
    )


@_figure
def outstanding_receivables(m: Marts) -> DataFrame:
    owed = m["revenue_analytics"].where(F.col("PaymentStatus").isin(*OUTSTANDING))
    return owed.agg(F.round(F.sum("TotalAmount"), 2).alias("outstanding_ar"))


@_figure
def revenue_by_specialization(m: Marts) -> DataFrame:
    return (
        m["doctor_performance"]
        .groupBy("Specialization")
        .agg(F.sum("AttributedRevenue").alias("revenue"), F.sum("TotalAppointments").alias("appointments"))
        .orderBy(F.desc("revenue"), "Specialization")
    )


@_figure
def denied_dollars(m: Marts) -> DataFrame:
    """Claimed total scaled by the share of claims denied, per payer."""
    share = F.col("DeniedCount") / F.nullif(F.col("TotalClaims"), F.lit(0))
    return (
        m["insurance_analytics"]
        .select(
            "InsuranceCompany",
            "DeniedCount",
            F.round(F.col("TotalClaimAmount") * share, 2).alias("estimated_denied_amount"),
        )
        .orderBy(F.desc("DeniedCount"), "InsuranceCompany")
    )


@_figure
def high_utilizers(m: Marts) -> DataFrame:
    return (
        m["patient_summary"]
        .select(
            "PatientID", "FirstName", "LastName", "TotalAppointments", "LifetimeBilled", "CancelledAppointments"
        )
        .orderBy(F.desc("TotalAppointments"), "PatientID")
        .limit(PATIENTS_SHOWN)
    )


def publish(spark: SparkSession, marts: Marts) -> dict[str, str]:
    """Register marts and the views over them; reports each as SUCCESS, SKIPPED or FAILED.

    A view is skipped if a mart it reads was not handed over.
    """
    report = {}
    for name, df in marts.items():
        df.createOrReplaceTempView(name)
        report[name] = "SUCCESS"
    for name, build in VIEWS.items():
        asked = _Asked(marts)
        try:
            build(asked).createOrReplaceTempView(name)
            report[name] = "SUCCESS"
        except Exception as problem:  # reported per view; the others go on
            report[name] = "SKIPPED" if asked.absent else f"FAILED: {str(problem).splitlines()[0]}"
    return report


class _Asked(dict):
    """Marts that remember which absent ones were asked for."""

    def __init__(self, marts: Marts) -> None:
        super().__init__(marts)
        self.absent: list[str] = []

    def __missing__(self, name: str) -> DataFrame:
        self.absent.append(name)
        raise KeyError(name)
