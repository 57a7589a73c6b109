"""Gold marts, views and dashboard queries."""

from __future__ import annotations

from checks.oracle_ctes import d, ts
from checks.registry import AS_OF_DATE, query
from checks.silver import silver
from lamina.plans import marts

_DOUBLE = "CAST({0} AS DOUBLE) AS {0}"


def dbl(*columns: str) -> str:
    return ", ".join(_DOUBLE.format(c) for c in columns)


def _silver(spark, sf, *names):
    return [silver(spark, sf, n) for n in names]


def summary(spark, sf):
    return marts.patient_summary(*_silver(spark, sf, "patients", "appointments", "billing", "insurance_claims"), AS_OF_DATE)


def performance(spark, sf, **options):
    return marts.doctor_performance(*_silver(spark, sf, "doctors", "appointments", "billing"), **options)


def revenue(spark, sf):
    return marts.revenue_analytics(*_silver(spark, sf, "billing", "appointments", "doctors"))


SUMMARY_SQL = f"""
    SELECT PatientID, FirstName, LastName, Gender, {d('DOB')} AS DOB, InsuranceID, TotalAppointments,
           CompletedAppointments, CancelledAppointments, {ts('LastVisitDate')} AS LastVisitDate,
           {ts('FirstVisitDate')} AS FirstVisitDate, {dbl('LifetimeBilled', 'LifetimePaid', 'TotalClaimAmount')},
           TotalClaims, ApprovedClaims, Age FROM patient_summary"""
PERFORMANCE_SQL = f"SELECT * REPLACE ({dbl('AttributedRevenue')}) FROM doctor_performance"


@query("g01_patient_summary", SUMMARY_SQL)
def _(spark, sf):
    return summary(spark, sf)


@query("g02_doctor_performance", PERFORMANCE_SQL)
def _(spark, sf):
    return performance(spark, sf)


@query(
    "g02_doctor_performance_per_appointment",
    """SELECT d.DoctorID, count(*) AS TotalAppointments,
              count(*) FILTER (WHERE Status = 'Completed') AS CompletedAppointments,
              count(*) FILTER (WHERE Status = 'Cancelled') AS CancelledAppointments,
              count(*) FILTER (WHERE Status = 'NoShow') AS NoShowAppointments,
              count(DISTINCT PatientID) AS UniquePatients, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS AttributedRevenue
       FROM appointments a JOIN doctors d ON a.DoctorID = d.DoctorID
       LEFT JOIN (SELECT AppointmentID, sum(TotalAmount) AS amount FROM billing GROUP BY 1) b
         ON b.AppointmentID = a.AppointmentID GROUP BY 1""",
)
def _(spark, sf):
    return performance(spark, sf, per_appointment=True).drop(
        "DoctorName", "Specialization", "Department", "Hospital", "Experience", "CompletionRatePct"
    )


@query("g03_revenue_analytics", f"SELECT * REPLACE ({dbl('TotalAmount')}, {d('PaymentDate')} AS PaymentDate) FROM revenue_analytics")
def _(spark, sf):
    return revenue(spark, sf)


@query("g04_hospital_revenue", "SELECT * FROM hospital_revenue")
def _(spark, sf):
    return marts.hospital_revenue(revenue(spark, sf))


@query("g05_insurance_analytics", "SELECT * FROM insurance_analytics")
def _(spark, sf):
    return marts.insurance_analytics(silver(spark, sf, "insurance_claims"))


@query("g06_appointment_analytics", f"SELECT * REPLACE ({d('AppointmentDay')} AS AppointmentDay) FROM appointment_analytics")
def _(spark, sf):
    return marts.appointment_analytics(*_silver(spark, sf, "appointments", "doctors"))


@query("g07_monthly_revenue", "SELECT * FROM monthly_revenue")
def _(spark, sf):
    return marts.monthly_revenue(revenue(spark, sf))


@query("g08_daily_revenue", f"SELECT * REPLACE ({d('RevenueDate')} AS RevenueDate) FROM daily_revenue")
def _(spark, sf):
    return marts.daily_revenue(revenue(spark, sf))


@query("g09_laboratory_trends", "SELECT * FROM laboratory_trends")
def _(spark, sf):
    return marts.laboratory_trends(silver(spark, sf, "laboratory_results"))


@query("g10_pharmacy_sales", "SELECT * FROM pharmacy_sales")
def _(spark, sf):
    return marts.pharmacy_sales(silver(spark, sf, "pharmacy_orders"))


@query("g11_patient_visit_summary", f"SELECT * REPLACE ({d('VisitDate')} AS VisitDate) FROM patient_visit_summary")
def _(spark, sf):
    return marts.patient_visit_summary(*_silver(spark, sf, "appointments", "patients"), AS_OF_DATE)


@query(
    "g11_patient_visit_summary_unknown_age",
    """SELECT * REPLACE (CAST(VisitDate AS VARCHAR) AS VisitDate, CASE WHEN Gender IS NULL THEN 'unknown' ELSE AgeGroup END AS AgeGroup)
       FROM patient_visit_summary""",
)
def _(spark, sf):
    return marts.patient_visit_summary(*_silver(spark, sf, "appointments", "patients"), AS_OF_DATE, "unknown")


@query("g12_doctor_utilization", f"SELECT * REPLACE ({dbl('AttributedRevenue')}) FROM doctor_utilization")
def _(spark, sf):
    return marts.doctor_utilization(performance(spark, sf))


@query("g13_top_diseases", "SELECT * FROM top_diseases")
def _(spark, sf):
    return marts.top_diseases(silver(spark, sf, "appointments"))


@query("g14_cancelled_appointments", f"SELECT * REPLACE ({ts('AppointmentDate')} AS AppointmentDate) FROM cancelled_appointments")
def _(spark, sf):
    return marts.cancelled_appointments(*_silver(spark, sf, "appointments", "doctors", "patients"))
