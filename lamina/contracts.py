"""Entity contracts: columns, keys, value sets, and how each entity is kept.

The engine reads these declarations instead of hard-coding one function per
entity; a new entity is a new ``Entity`` value.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Names and value sets that stored tables and queries depend on.
# ---------------------------------------------------------------------------
GENDERS = ("Male", "Female", "Other", "Unknown")
APPOINTMENT_STATUSES = ("Scheduled", "Completed", "Cancelled", "NoShow", "Rescheduled")
CLAIM_STATUSES = ("Pending", "Approved", "Denied", "Partial", "Appealed")
PAYMENT_STATUSES = ("Paid", "Pending", "Partial", "Overdue", "WrittenOff")
PROBLEM_LEVELS = ("ERROR", "WARNING", "CRITICAL")
EMAIL_PATTERN = r"^[^@]+@[^@]+\.[^@]+$"
NULL_TOKEN = "∅"
HASH_SEPARATOR = "||"

INGESTION_TIME = "_ingestion_time"
SOURCE_FILE = "_source_file"
LOAD_ID = "_load_id"
BATCH_ID = "_batch_id"
RECORD_HASH = "_record_hash"
RESCUED = "_rescued_data"
INGESTION_DATE = "ingestion_date"
LINEAGE = {
    INGESTION_TIME: "timestamp",
    SOURCE_FILE: "string",
    LOAD_ID: "string",
    BATCH_ID: "string",
    RECORD_HASH: "string",
    RESCUED: "string",
    INGESTION_DATE: "date",
}

START = "EffectiveStartDate"
END = "EffectiveEndDate"
CURRENT = "IsCurrent"
VERSION = "VersionNumber"
HISTORY = {START: "timestamp", END: "timestamp", CURRENT: "boolean", VERSION: "int"}


@dataclass(frozen=True)
class Domain:
    """Allowed values of a column and what anything else becomes."""

    values: tuple[str, ...]
    default: str
    fold_case: bool = False


@dataclass(frozen=True)
class Entity:
    name: str
    key: str
    columns: dict[str, str]
    latest_by: str | None = None
    modified_by: str | None = None
    domains: dict[str, Domain] = field(default_factory=dict)
    phones: tuple[str, ...] = ()
    emails: tuple[str, ...] = ()
    floors: dict[str, int] = field(default_factory=dict)
    at_least: dict[str, int] = field(default_factory=dict)
    above: dict[str, int] = field(default_factory=dict)
    reject_blank_key: bool = False
    references: dict[str, str] = field(default_factory=dict)
    tracked: tuple[str, ...] = ()
    compared: tuple[str, ...] = ()
    cluster_by: tuple[str, ...] = ()

    def ddl(self, *extra: dict[str, str]) -> str:
        """Schema text, optionally widened with lineage or history columns."""
        merged = dict(self.columns)
        for more in extra:
            merged.update(more)
        return ", ".join(f"`{name}` {kind}" for name, kind in merged.items())

    @property
    def text_columns(self) -> tuple[str, ...]:
        return tuple(c for c, kind in self.columns.items() if kind == "string")


MONEY = "decimal(12,2)"

ENTITIES: dict[str, Entity] = {
    e.name: e
    for e in (
        Entity(
            name="patients",
            key="PatientID",
            columns={
                "PatientID": "string",
                "FirstName": "string",
                "LastName": "string",
                "DOB": "date",
                "Gender": "string",
                "Phone": "string",
                "Email": "string",
                "Address": "string",
                "InsuranceID": "string",
                "CreatedDate": "timestamp",
                "ModifiedDate": "timestamp",
            },
            latest_by="ModifiedDate",
            modified_by="ModifiedDate",
            domains={"Gender": Domain(GENDERS, "Unknown", fold_case=True)},
            phones=("Phone",),
            emails=("Email",),
            reject_blank_key=True,
            tracked=("FirstName", "LastName", "Phone", "Email", "Address", "InsuranceID", "Gender"),
            cluster_by=("PatientID", "InsuranceID"),
        ),
        Entity(
            name="doctors",
            key="DoctorID",
            columns={
                "DoctorID": "string",
                "DoctorName": "string",
                "Specialization": "string",
                "Department": "string",
                "Hospital": "string",
                "Experience": "int",
            },
            floors={"Experience": 0},
            compared=("DoctorName", "Specialization", "Department", "Hospital", "Experience"),
            cluster_by=("DoctorID", "Department"),
        ),
        Entity(
            name="appointments",
            key="AppointmentID",
            columns={
                "AppointmentID": "string",
                "PatientID": "string",
                "DoctorID": "string",
                "AppointmentDate": "timestamp",
                "Status": "string",
                "Diagnosis": "string",
            },
            latest_by="AppointmentDate",
            domains={"Status": Domain(APPOINTMENT_STATUSES, "Scheduled")},
            references={"PatientID": "patients", "DoctorID": "doctors"},
            compared=("PatientID", "DoctorID", "AppointmentDate", "Status", "Diagnosis"),
            cluster_by=("AppointmentDate", "PatientID", "DoctorID"),
        ),
        Entity(
            name="insurance_claims",
            key="ClaimID",
            columns={
                "ClaimID": "string",
                "PatientID": "string",
                "InsuranceCompany": "string",
                "ClaimAmount": MONEY,
                "ApprovalStatus": "string",
                "ClaimDate": "date",
            },
            domains={"ApprovalStatus": Domain(CLAIM_STATUSES, "Pending")},
            at_least={"ClaimAmount": 0},
            references={"PatientID": "patients"},
            compared=("PatientID", "InsuranceCompany", "ClaimAmount", "ApprovalStatus", "ClaimDate"),
            cluster_by=("ClaimDate", "PatientID", "InsuranceCompany"),
        ),
        Entity(
            name="pharmacy_orders",
            key="PrescriptionID",
            columns={
                "PrescriptionID": "string",
                "PatientID": "string",
                "Medicine": "string",
                "Quantity": "int",
                "Price": MONEY,
            },
            above={"Quantity": 0},
            at_least={"Price": 0},
            references={"PatientID": "patients"},
            compared=("PatientID", "Medicine", "Quantity", "Price", "LineAmount"),
            cluster_by=("PatientID", "Medicine"),
        ),
        Entity(
            name="laboratory_results",
            key="LabID",
            columns={
                "LabID": "string",
                "PatientID": "string",
                "TestName": "string",
                "Result": "string",
                "NormalRange": "string",
            },
            references={"PatientID": "patients"},
            compared=("PatientID", "TestName", "Result", "NormalRange", "IsAbnormal"),
            cluster_by=("PatientID", "TestName"),
        ),
        Entity(
            name="billing",
            key="InvoiceID",
            columns={
                "InvoiceID": "string",
                "PatientID": "string",
                "AppointmentID": "string",
                "TotalAmount": MONEY,
                "PaymentStatus": "string",
                "PaymentDate": "date",
            },
            domains={"PaymentStatus": Domain(PAYMENT_STATUSES, "Pending")},
            at_least={"TotalAmount": 0},
            references={"PatientID": "patients", "AppointmentID": "appointments"},
            compared=("PatientID", "AppointmentID", "TotalAmount", "PaymentStatus", "PaymentDate"),
            cluster_by=("PaymentDate", "PatientID"),
        ),
    )
}


def entity(name: str) -> Entity:
    """Look an entity up; an unknown name is a caller error, not an empty frame."""
    try:
        return ENTITIES[name]
    except KeyError:
        raise ValueError(f"unknown entity {name!r}; known: {', '.join(ENTITIES)}") from None
