"""SQL views and dashboard figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.mart_queries import dbl, revenue
from checks.oracle_ctes import mean2, r2
from checks.registry import AS_OF_DATE, query
from checks.silver import SilverTables, silver, stored
from lamina.functions.sketches import rank_error, rank_span
from lamina.plans import marts, views


class LazyMarts(dict):
    """Marts built the first time a view asks for one, so a view pays for no other.

    With ``keep`` the silver tables are stored once, for views that read several
    marts over the same ones.
    """

    def __init__(self, spark, sf, keep=False):
        super().__init__()
        tables = SilverTables(spark, sf) if keep else None
        self.silver = tables.__getitem__ if keep else lambda name: silver(spark, sf, name)

    def _from_silver(self, build, *names, **options):
        return build(*[self.silver(n) for n in names], **options)

    def __missing__(self, name):
        if name in marts.FROM_REVENUE:
            df = marts.FROM_REVENUE[name](self["revenue_analytics"])
        elif name in marts.FROM_PERFORMANCE:
            df = marts.FROM_PERFORMANCE[name](self["doctor_performance"])
        elif name == "patients_current":
            df = self.silver("patients")
        else:
            sources = {
                "patient_summary": ["patients", "appointments", "billing", "insurance_claims"],
                "doctor_performance": ["doctors", "appointments", "billing"],
                "revenue_analytics": ["billing", "appointments", "doctors"],
                "insurance_analytics": ["insurance_claims"],
                "appointment_analytics": ["appointments", "doctors"],
                "laboratory_trends": ["laboratory_results"],
                "pharmacy_sales": ["pharmacy_orders"],
                "top_diseases": ["appointments"],
            }[name]
            options = {"as_of": AS_OF_DATE} if name == "patient_summary" else {}
            df = self._from_silver(getattr(marts, name), *sources, **options)
        self[name] = df
        return df


def _register(key, build, sql):
    query(key, sql)(lambda spark, sf: build(LazyMarts(spark, sf)))


_BILLING_SQL = f"""SELECT {mean2('TotalAmount')} AS AvgInvoiceAmount,
    quantile_cont(CAST(TotalAmount AS DOUBLE), 0.5) AS MedianInvoiceAmount,
    CAST(min(TotalAmount) AS DOUBLE) AS MinInvoiceAmount, CAST(max(TotalAmount) AS DOUBLE) AS MaxInvoiceAmount,
    count(*) AS InvoiceCount, CAST(sum(TotalAmount) AS DOUBLE) AS TotalBilled FROM revenue_analytics"""

VIEW_SQL = {
    "v01_top_10_doctors": (
        views.top_10_doctors,
        f"""SELECT DoctorID, DoctorName, Specialization, Department, Hospital, TotalAppointments, CompletedAppointments,
                   UniquePatients, {dbl('AttributedRevenue')}, CompletionRatePct
            FROM doctor_performance ORDER BY doctor_performance.AttributedRevenue DESC, DoctorID LIMIT 10""",
    ),
    "v02_monthly_revenue": (
        views.monthly_revenue,
        f"SELECT *, {r2('CollectedRevenue / nullif(TotalRevenue, 0) * 100')} AS CollectionRatePct FROM monthly_revenue",
    ),
    "v03_insurance_approval_pct": (views.insurance_approval_pct, "SELECT * FROM insurance_analytics"),
    "v04_revenue_by_department": (
        views.revenue_by_department,
        f"""SELECT Department, CAST(sum(TotalAmount) AS DOUBLE) AS TotalRevenue,
                   CAST(sum(CASE WHEN PaymentStatus = 'Paid' THEN TotalAmount ELSE 0 END) AS DOUBLE) AS CollectedRevenue,
                   count(DISTINCT InvoiceID) AS InvoiceCount, count(DISTINCT PatientID) AS PatientCount,
                   {mean2('TotalAmount')} AS AvgInvoiceAmount
            FROM revenue_analytics WHERE Department IS NOT NULL GROUP BY 1""",
    ),
    "v05_patient_growth": (
        views.patient_growth,
        "SELECT strftime(CreatedDate, '%Y-%m') AS CohortMonth, count(*) AS NewPatients FROM patients GROUP BY 1",
    ),
    "v06_patient_growth_by_first_visit": (
        views.patient_growth_by_first_visit,
        """SELECT strftime(FirstVisitDate, '%Y-%m') AS CohortMonth, count(*) AS NewPatients
           FROM patient_summary WHERE FirstVisitDate IS NOT NULL GROUP BY 1""",
    ),
    "v07_daily_appointments": (
        views.daily_appointments,
        """SELECT CAST(AppointmentDay AS VARCHAR) AS AppointmentDay, CAST(sum(AppointmentCount) AS BIGINT) AS TotalAppointments,
                  CAST(sum(CASE WHEN Status = 'Completed' THEN AppointmentCount ELSE 0 END) AS BIGINT) AS Completed,
                  CAST(sum(CASE WHEN Status = 'Cancelled' THEN AppointmentCount ELSE 0 END) AS BIGINT) AS Cancelled,
                  CAST(sum(CASE WHEN Status = 'NoShow' THEN AppointmentCount ELSE 0 END) AS BIGINT) AS NoShows,
                  CAST(sum(UniquePatients) AS BIGINT) AS UniquePatients
           FROM appointment_analytics GROUP BY 1""",
    ),
    "v09_lab_trends": (views.lab_trends, "SELECT * FROM laboratory_trends"),
    "v10_prescription_trends": (views.prescription_trends, "SELECT * FROM pharmacy_sales"),
    "v11_executive_kpis": (
        views.executive_kpis,
        """SELECT (SELECT count(*) FROM patient_summary) AS TotalPatients,
                  (SELECT count(*) FROM doctor_performance) AS TotalDoctors,
                  (SELECT CAST(sum(CAST(TotalRevenue AS DECIMAL(22,2))) AS DOUBLE) FROM hospital_revenue) AS NetworkRevenue,
                  (SELECT CAST(sum(CAST(CollectedRevenue AS DECIMAL(22,2))) AS DOUBLE) FROM hospital_revenue) AS NetworkCollected,
                  (SELECT CAST(sum(CancelledAppointments) AS BIGINT) FROM patient_summary) AS CancelledAppointments,
                  (SELECT round(avg(ApprovalRatePct), 6) FROM insurance_analytics) AS AvgInsuranceApprovalPct""",
    ),
    "h01_total_patients": (views.total_patients, "SELECT count(*) AS total_patients FROM patient_summary"),
    "h02_network_revenue": (
        views.network_revenue,
        "SELECT CAST(sum(CAST(TotalRevenue AS DECIMAL(22,2))) AS DOUBLE) AS network_revenue FROM hospital_revenue",
    ),
    "h03_collection_rate": (
        views.collection_rate,
        f"""SELECT {r2('sum(CAST(CollectedRevenue AS DECIMAL(22,2))) / sum(CAST(TotalRevenue AS DECIMAL(22,2))) * 100')}
            AS collection_rate_pct FROM hospital_revenue""",
    ),
    "h04_average_approval": (
        views.average_approval,
        f"SELECT {r2('avg(ApprovalRatePct)')} AS avg_approval_pct FROM insurance_analytics",
    ),
    "h05_monthly_trend": (
        views.monthly_trend,
        "SELECT PaymentYearMonth, TotalRevenue, CollectedRevenue FROM monthly_revenue",
    ),
    "h06_revenue_by_hospital": (
        views.revenue_by_hospital,
        "SELECT Hospital, TotalRevenue, CollectedRevenue, PendingRevenue FROM hospital_revenue",
    ),
    "h07_leading_diseases": (
        views.leading_diseases,
        "SELECT * FROM top_diseases ORDER BY DiagnosisCount DESC, Diagnosis LIMIT 15",
    ),
    "h08_utilization_by_hospital": (
        views.utilization_by_hospital,
        f"SELECT Hospital, Department, DoctorName, UtilizationPct, {dbl('AttributedRevenue')} FROM doctor_utilization",
    ),
    "h09_payment_status_mix": (
        views.payment_status_mix,
        """SELECT PaymentStatus, count(*) AS invoices, CAST(sum(TotalAmount) AS DOUBLE) AS amount
           FROM revenue_analytics GROUP BY 1""",
    ),
    "h10_outstanding_ar": (
        views.outstanding_receivables,
        """SELECT CAST(sum(TotalAmount) AS DOUBLE) AS outstanding_ar FROM revenue_analytics
           WHERE PaymentStatus IN ('Pending', 'Overdue', 'Partial')""",
    ),
    "h11_revenue_by_specialization": (
        views.revenue_by_specialization,
        """SELECT Specialization, CAST(sum(AttributedRevenue) AS DOUBLE) AS revenue,
                  CAST(sum(TotalAppointments) AS BIGINT) AS appointments FROM doctor_performance GROUP BY 1""",
    ),
    "h12_denied_dollars": (
        views.denied_dollars,
        f"""SELECT InsuranceCompany, DeniedCount,
                   {r2('TotalClaimAmount * (DeniedCount / CAST(TotalClaims AS DOUBLE))')} AS estimated_denied_amount
            FROM insurance_analytics""",
    ),
    "h13_high_utilizers": (
        views.high_utilizers,
        f"""SELECT PatientID, FirstName, LastName, TotalAppointments, {dbl('LifetimeBilled')}, CancelledAppointments
            FROM patient_summary ORDER BY TotalAppointments DESC, PatientID LIMIT 25""",
    ),
}

for _key, (_build, _sql) in VIEW_SQL.items():
    if _key == "v11_executive_kpis":
        continue
    _register(_key, _build, _sql)


@query("v11_executive_kpis", VIEW_SQL["v11_executive_kpis"][1])
def _(spark, sf):
    row = views.executive_kpis(LazyMarts(spark, sf, keep=True))
    return row.withColumn("AvgInsuranceApprovalPct", F.round("AvgInsuranceApprovalPct", 6))


@query("v08_average_billing", _BILLING_SQL)
def _(spark, sf):
    """Exact median, so read the mart from a stored copy rather than planning it anew per pass."""
    amounts = stored(revenue(spark, sf).select("TotalAmount"), "revenue")
    return views.average_billing_exact({"revenue_analytics": amounts})


_CHECKED_SQL = _BILLING_SQL.replace("quantile_cont(CAST(TotalAmount AS DOUBLE), 0.5) AS MedianInvoiceAmount", "true AS MedianRankWithinBound")


@query("v08_average_billing_approx", _CHECKED_SQL)
def _(spark, sf):
    """The view with its sketched median; the rank that the median really has is counted and held against the bound."""
    amounts = stored(revenue(spark, sf).select("TotalAmount"), "revenue")
    figures = stored(views.average_billing({"revenue_analytics": amounts}), "figures")
    below, upto = rank_span("TotalAmount", F.lit(float(figures.first()["MedianInvoiceAmount"])))
    # The sketch keeps 10,000 steps; half a cent of rounding moves no rank further than to a neighbour.
    within = amounts.agg(((below <= 0.5 + 2e-4) & (upto >= 0.5 - 2e-4)).alias("MedianRankWithinBound"))
    return figures.withColumn("MedianRankWithinBound", F.lit(within.first()[0])).drop("MedianInvoiceAmount")


@query(
    "v08_monthly_median_of_daily_sketches",
    """SELECT PaymentYear, PaymentMonth, count(TotalAmount) AS InvoiceCount, true AS RankWithinBound
       FROM (SELECT year(PaymentDate) AS PaymentYear, month(PaymentDate) AS PaymentMonth, TotalAmount FROM revenue_analytics)
       WHERE TotalAmount IS NOT NULL GROUP BY 1, 2""",
)
def _(spark, sf):
    """Monthly medians from stored daily sketches, each rank counted in the month's invoices."""
    amounts = stored(revenue(spark, sf).select("PaymentDate", "TotalAmount"), "revenue")
    days = stored(views.daily_billing_sketches({"revenue_analytics": amounts}), "daily-sketches")
    month = {"PaymentYear": F.year("PaymentDate"), "PaymentMonth": F.month("PaymentDate")}
    medians = stored(views.median_of_days(days.withColumns(month), list(month)), "medians")
    below, upto = rank_span("TotalAmount", F.col("MedianInvoice"))
    bound = 3 * rank_error()  # three times what 99 of 100 keep
    met = amounts.withColumns(month).join(F.broadcast(medians.drop("InvoiceCount")), list(month))
    checked = met.groupBy(*month).agg(((below <= 0.5 + bound + 1 / F.count("*")) & (upto >= 0.5 - bound - 1 / F.count("*"))).alias("RankWithinBound"))
    return medians.drop("MedianInvoice").join(checked, list(month))


@query(
    "v07_daily_appointments_exact",
    """SELECT CAST(CAST(AppointmentDate AS DATE) AS VARCHAR) AS AppointmentDay, count(*) AS TotalAppointments,
              count(*) FILTER (WHERE Status = 'Completed') AS Completed,
              count(*) FILTER (WHERE Status = 'Cancelled') AS Cancelled,
              count(*) FILTER (WHERE Status = 'NoShow') AS NoShows, count(DISTINCT PatientID) AS UniquePatients
       FROM appointments GROUP BY 1""",
)
def _(spark, sf):
    return views.daily_appointments_exact(silver(spark, sf, "appointments"))
