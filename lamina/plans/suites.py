"""Rule suites per entity: the two advisory ones of the silver job and the full set."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.contracts import (
    APPOINTMENT_STATUSES,
    CLAIM_STATUSES,
    EMAIL_PATTERN,
    GENDERS,
    PAYMENT_STATUSES,
)
from lamina.operators.quality import (
    Rule,
    business_rule,
    foreign_key,
    in_range,
    matches,
    not_null,
    unique,
    values_in,
)

# Limits the suites check against.
MOST_EXPERIENCE = 60
LARGEST_CLAIM = 1_000_000


def advisory_patients() -> list[Rule]:
    return (
        not_null(["PatientID", "FirstName", "LastName", "DOB"])
        + unique(["PatientID"])
        + values_in("Gender", GENDERS)
        + matches("Email", EMAIL_PATTERN)
    )


def advisory_appointments(patients: DataFrame, doctors: DataFrame) -> list[Rule]:
    return (
        not_null(["AppointmentID", "PatientID", "DoctorID", "AppointmentDate"])
        + unique(["AppointmentID"])
        + values_in("Status", APPOINTMENT_STATUSES)
        + foreign_key("PatientID", patients, "PatientID")
        + foreign_key("DoctorID", doctors, "DoctorID")
    )


def patients_suite(as_of: dt.date) -> list[Rule]:
    return (
        not_null(["PatientID", "FirstName", "LastName", "DOB", "Gender"])
        + unique(["PatientID"])
        + matches("Email", EMAIL_PATTERN)
        + business_rule(
            "dob_not_future", "DOB must not lie ahead", F.col("DOB") > F.lit(as_of), "CRITICAL", ["DOB"]
        )
    )


def doctors_suite() -> list[Rule]:
    return (
        not_null(["DoctorID", "DoctorName", "Specialization", "Department"])
        + unique(["DoctorID"])
        + in_range("Experience", 0, MOST_EXPERIENCE)
    )


def appointments_suite(patients: DataFrame, doctors: DataFrame) -> list[Rule]:
    undiagnosed = F.coalesce(F.trim("Diagnosis"), F.lit("")) == ""
    return (
        not_null(["AppointmentID", "PatientID", "DoctorID", "AppointmentDate", "Status"])
        + unique(["AppointmentID"])
        + foreign_key("PatientID", patients, "PatientID")
        + foreign_key("DoctorID", doctors, "DoctorID")
        + business_rule(
            "completed_requires_diagnosis",
            "a completed appointment names a diagnosis",
            (F.col("Status") == "Completed") & undiagnosed,
            columns=["AppointmentID", "Status", "Diagnosis"],
        )
    )


def claims_suite(patients: DataFrame) -> list[Rule]:
    return (
        not_null(["ClaimID", "PatientID", "ClaimAmount", "ApprovalStatus"])
        + unique(["ClaimID"])
        + values_in("ApprovalStatus", CLAIM_STATUSES)
        + in_range("ClaimAmount", 0, LARGEST_CLAIM)
        + foreign_key("PatientID", patients, "PatientID")
    )


def billing_suite(patients: DataFrame, appointments: DataFrame) -> list[Rule]:
    return (
        not_null(["InvoiceID", "PatientID", "TotalAmount", "PaymentStatus"])
        + unique(["InvoiceID"])
        + values_in("PaymentStatus", PAYMENT_STATUSES)
        + in_range("TotalAmount", low=0)
        + foreign_key("PatientID", patients, "PatientID")
        + foreign_key("AppointmentID", appointments, "AppointmentID")
    )


def pharmacy_suite(patients: DataFrame) -> list[Rule]:
    return (
        not_null(["PrescriptionID", "PatientID", "Medicine", "Quantity", "Price"])
        + unique(["PrescriptionID"])
        + in_range("Quantity", low=1)
        + in_range("Price", low=0)
        + foreign_key("PatientID", patients, "PatientID")
    )


def labs_suite(patients: DataFrame) -> list[Rule]:
    return (
        not_null(["LabID", "PatientID", "TestName", "Result"])
        + unique(["LabID"])
        + foreign_key("PatientID", patients, "PatientID")
    )


SUITES: dict[str, Callable[[Mapping[str, DataFrame], dt.date], list[Rule]]] = {
    "patients": lambda silver, as_of: patients_suite(as_of),
    "doctors": lambda silver, as_of: doctors_suite(),
    "appointments": lambda silver, as_of: appointments_suite(silver["patients"], silver["doctors"]),
    "insurance_claims": lambda silver, as_of: claims_suite(silver["patients"]),
    "billing": lambda silver, as_of: billing_suite(silver["patients"], silver["appointments"]),
    "pharmacy_orders": lambda silver, as_of: pharmacy_suite(silver["patients"]),
    "laboratory_results": lambda silver, as_of: labs_suite(silver["patients"]),
}


def all_suites(silver: Mapping[str, DataFrame], as_of: dt.date) -> dict[str, list[Rule]]:
    """The full suite of every entity; ``patients`` holds current rows."""
    return {name: suite(silver, as_of) for name, suite in SUITES.items()}
