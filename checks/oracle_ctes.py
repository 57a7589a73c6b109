"""DuckDB text of the entities, raw and cleaned, as common table expressions.

Dates and timestamps are rendered as text and money as DOUBLE on both sides, so
that the comparison does not depend on how each engine hands such types over.
"""

from __future__ import annotations

AS_OF = "2025-06-30"

RAW: dict[str, str] = {
    "raw_doctors": """
        SELECT 'DOC' || s_suppkey AS DoctorID, s_name AS DoctorName, n_name AS Specialization,
               n_name AS Department, r_name AS Hospital, CAST(s_suppkey % 40 - 2 AS INTEGER) AS Experience
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "raw_patients": """
        SELECT 'PAT' || c_custkey AS PatientID,
               CASE WHEN c_custkey % 97 <> 0 THEN c_mktsegment END AS FirstName,
               c_name AS LastName,
               DATE '1930-01-01' + CAST(c_custkey * 37 % 30000 AS INTEGER) AS DOB,
               CASE c_custkey % 5 WHEN 0 THEN 'male' WHEN 1 THEN ' FEMALE ' WHEN 2 THEN 'Other' WHEN 3 THEN 'x' END AS Gender,
               '(+1) 555-' || (c_custkey + 1000000) AS Phone,
               CASE WHEN c_custkey % 10 = 0 THEN 'bad-email-' || c_custkey
                    ELSE '  USER' || c_custkey || '@Example.COM ' END AS Email,
               c_custkey || ' Main St' AS Address,
               'INS' || c_nationkey AS InsuranceID,
               TIMESTAMP '2020-01-01' + to_days(CAST(c_custkey % 1000 AS INTEGER)) AS CreatedDate,
               TIMESTAMP '2020-01-01' + to_days(CAST(c_custkey % 1000 + c_custkey % 365 AS INTEGER)) AS ModifiedDate
        FROM customer""",
    "raw_patient_updates": """
        SELECT p.PatientID, p.FirstName, p.LastName, p.DOB, p.Gender,
               '555-' || o_orderstatus || o_orderkey AS Phone, p.Email,
               ' ' || o_orderpriority || ' St ' AS Address, p.InsuranceID, p.CreatedDate,
               CAST(o_orderdate AS TIMESTAMP) AS ModifiedDate
        FROM orders JOIN raw_patients p ON 'PAT' || o_custkey = p.PatientID""",
    "raw_appointments": """
        SELECT 'APT' || o_orderkey AS AppointmentID,
               'PAT' || (o_custkey + CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 100000000 ELSE 0 END) AS PatientID,
               'DOC' || s AS DoctorID,
               CAST(o_orderdate AS TIMESTAMP) AS AppointmentDate,
               CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN ' Completed '
                    WHEN o_orderstatus = 'F' THEN 'Completed'
                    WHEN o_orderstatus = 'O' AND o_orderpriority = '2-HIGH' THEN 'scheduled'
                    WHEN o_orderstatus = 'O' THEN 'Scheduled'
                    WHEN o_orderpriority = '5-LOW' THEN 'NoShow' ELSE 'Cancelled' END AS Status,
               CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '  ' ELSE o_orderpriority END AS Diagnosis
        FROM orders LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS s FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""",
    "raw_billing": """
        SELECT 'INV' || l_orderkey || '-' || l_linenumber AS InvoiceID,
               'PAT' || o_custkey AS PatientID,
               'APT' || l_orderkey AS AppointmentID,
               CAST(CASE WHEN l_quantity = 49 THEN -l_extendedprice WHEN l_quantity <> 50 THEN l_extendedprice END AS DECIMAL(12,2)) AS TotalAmount,
               CASE WHEN l_returnflag = 'A' THEN 'Paid'
                    WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'Partial'
                    WHEN l_returnflag = 'N' THEN 'Pending'
                    WHEN l_linestatus = 'O' THEN 'overdue' ELSE 'Overdue' END AS PaymentStatus,
               CAST(l_shipdate AS DATE) AS PaymentDate
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "raw_insurance_claims": """
        SELECT 'CLM' || o_orderkey AS ClaimID, 'PAT' || o_custkey AS PatientID, c_mktsegment AS InsuranceCompany,
               CAST(o_totalprice AS DECIMAL(12,2)) AS ClaimAmount,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'Approved' WHEN '2-HIGH' THEN 'Denied'
                    WHEN '3-MEDIUM' THEN 'Partial' WHEN '4-NOT SPECIFIED' THEN 'unknown' ELSE 'Pending' END AS ApprovalStatus,
               CAST(o_orderdate AS DATE) AS ClaimDate
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "raw_pharmacy_orders": """
        SELECT 'RX' || l_orderkey || '-' || l_linenumber AS PrescriptionID, 'PAT' || o_custkey AS PatientID,
               p_name AS Medicine, CAST(l_quantity AS INTEGER) - 1 AS Quantity,
               CAST(p_retailprice AS DECIMAL(12,2)) AS Price
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey""",
    "raw_laboratory_results": """
        SELECT 'LAB' || event_id AS LabID, 'PAT' || user_id AS PatientID, event_type AS TestName,
               CASE WHEN event_type = 'purchase' AND value < 1 THEN 'pending'
                    ELSE ' ' || CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) END AS Result,
               CASE WHEN event_type = 'error' THEN 'n/a' ELSE '10 - 200' END AS NormalRange
        FROM events""",
    "status_changes": """
        SELECT user_id AS Key, event_type AS State, CAST(ts AS TIMESTAMP) AS ChangedAt, event_id AS Sequence FROM events""",
    "customer_orders": """
        SELECT o_custkey AS CustomerID, o_orderkey AS OrderID, o_orderstatus AS Status,
               CAST(o_totalprice AS DECIMAL(12,2)) AS Amount, CAST(o_orderdate AS TIMESTAMP) AS OrderedAt FROM orders""",
    "audit_rows": """
        SELECT event_id AS AuditID, event_type AS PipelineName, 'table_' || (user_id % 7) AS TableName,
               CAST(ts AS TIMESTAMP) AS StartTime,
               CAST(ts AS TIMESTAMP) + to_seconds(CAST(trunc(value) AS INTEGER)) AS EndTime,
               CASE WHEN event_type = 'error' OR value > 200 THEN 'FAILED' ELSE 'SUCCESS' END AS Status,
               user_id AS RowsRead, user_id % 11 AS RowsInserted, value AS ExecutionTimeSeconds FROM events""",
    "log_rows": """
        SELECT event_id AS LogID, 'job_' || (user_id % 5) AS PipelineName,
               CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'signup' THEN 'WARNING'
                    WHEN event_type = 'purchase' AND value > 100 THEN 'CRITICAL' ELSE 'INFO' END AS LogLevel,
               props AS Message, CAST(ts AS TIMESTAMP) AS LoggedAt FROM events""",
}


def _asc(*columns: str) -> str:
    return ", ".join(f"{c} ASC NULLS FIRST" for c in columns)


def _patients(source: str) -> str:
    return f"""
        SELECT * FROM (
          SELECT trim(PatientID) AS PatientID, trim(FirstName) AS FirstName, trim(LastName) AS LastName, DOB,
                 CASE lower(trim(Gender)) WHEN 'male' THEN 'Male' WHEN 'female' THEN 'Female' WHEN 'other' THEN 'Other'
                      ELSE 'Unknown' END AS Gender,
                 regexp_replace(trim(Phone), '[^0-9+]', '', 'g') AS Phone, lower(trim(Email)) AS Email,
                 trim(Address) AS Address, trim(InsuranceID) AS InsuranceID, CreatedDate, ModifiedDate
          FROM {source} WHERE trim(PatientID) <> '')
        QUALIFY row_number() OVER (PARTITION BY PatientID ORDER BY ModifiedDate DESC NULLS LAST,
          {_asc('FirstName', 'LastName', 'DOB', 'Gender', 'Phone', 'Email', 'Address', 'InsuranceID', 'CreatedDate')}) = 1"""


CLEAN: dict[str, str] = {
    "doctors": f"""
        SELECT * FROM (
          SELECT trim(DoctorID) AS DoctorID, trim(DoctorName) AS DoctorName, trim(Specialization) AS Specialization,
                 trim(Department) AS Department, trim(Hospital) AS Hospital,
                 CASE WHEN Experience < 0 THEN 0 ELSE Experience END AS Experience
          FROM raw_doctors WHERE DoctorID IS NOT NULL)
        QUALIFY row_number() OVER (PARTITION BY DoctorID ORDER BY
          {_asc('DoctorName', 'Specialization', 'Department', 'Hospital', 'Experience')}) = 1""",
    "patients": _patients("raw_patients"),
    "patient_updates": _patients("raw_patient_updates"),
    "appointments": f"""
        SELECT * FROM (
          SELECT trim(AppointmentID) AS AppointmentID, trim(PatientID) AS PatientID, trim(DoctorID) AS DoctorID,
                 AppointmentDate,
                 CASE WHEN trim(Status) IN ('Scheduled','Completed','Cancelled','NoShow','Rescheduled') THEN trim(Status)
                      ELSE 'Scheduled' END AS Status,
                 trim(Diagnosis) AS Diagnosis
          FROM raw_appointments WHERE AppointmentID IS NOT NULL)
        QUALIFY row_number() OVER (PARTITION BY AppointmentID ORDER BY AppointmentDate DESC NULLS LAST,
          {_asc('PatientID', 'DoctorID', 'Status', 'Diagnosis')}) = 1""",
    "billing": f"""
        SELECT * FROM (
          SELECT trim(InvoiceID) AS InvoiceID, trim(PatientID) AS PatientID, trim(AppointmentID) AS AppointmentID,
                 TotalAmount,
                 CASE WHEN PaymentStatus IN ('Paid','Pending','Partial','Overdue','WrittenOff') THEN PaymentStatus
                      ELSE 'Pending' END AS PaymentStatus, PaymentDate
          FROM raw_billing WHERE InvoiceID IS NOT NULL AND TotalAmount >= 0)
        QUALIFY row_number() OVER (PARTITION BY InvoiceID ORDER BY
          {_asc('PatientID', 'AppointmentID', 'TotalAmount', 'PaymentStatus', 'PaymentDate')}) = 1""",
    "insurance_claims": f"""
        SELECT * FROM (
          SELECT trim(ClaimID) AS ClaimID, trim(PatientID) AS PatientID, trim(InsuranceCompany) AS InsuranceCompany,
                 ClaimAmount,
                 CASE WHEN ApprovalStatus IN ('Pending','Approved','Denied','Partial','Appealed') THEN ApprovalStatus
                      ELSE 'Pending' END AS ApprovalStatus, ClaimDate
          FROM raw_insurance_claims WHERE ClaimID IS NOT NULL AND ClaimAmount >= 0)
        QUALIFY row_number() OVER (PARTITION BY ClaimID ORDER BY
          {_asc('PatientID', 'InsuranceCompany', 'ClaimAmount', 'ApprovalStatus', 'ClaimDate')}) = 1""",
    "pharmacy_orders": f"""
        SELECT *, CAST(Quantity * Price AS DECIMAL(23,2)) AS LineAmount FROM (
          SELECT * FROM raw_pharmacy_orders WHERE PrescriptionID IS NOT NULL AND Quantity > 0 AND Price >= 0
          QUALIFY row_number() OVER (PARTITION BY PrescriptionID ORDER BY
            {_asc('PatientID', 'Medicine', 'Quantity', 'Price')}) = 1)""",
    "laboratory_results": f"""
        SELECT *, coalesce(TRY_CAST(Result AS DOUBLE) < lo OR TRY_CAST(Result AS DOUBLE) > hi, false) AS IsAbnormal
        FROM (
          SELECT LabID, PatientID, TestName, trim(Result) AS Result, NormalRange,
                 TRY_CAST(regexp_extract(NormalRange, '^\\s*([0-9.]+)\\s*-', 1) AS DOUBLE) AS lo,
                 TRY_CAST(regexp_extract(NormalRange, '-\\s*([0-9.]+)\\s*$', 1) AS DOUBLE) AS hi
          FROM raw_laboratory_results
          QUALIFY row_number() OVER (PARTITION BY LabID ORDER BY {_asc('PatientID', 'TestName', 'Result', 'NormalRange')}) = 1)""",
}


def r2(expr: str) -> str:
    """Round half up on the printed digits of a double, as Spark's ``round`` does."""
    return f"CAST(round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38,12)), 2) AS DOUBLE)"


def r4(expr: str) -> str:
    return f"CAST(round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38,12)), 4) AS DOUBLE)"


def mean2(column: str) -> str:
    """Mean of money kept to six digits, then to two."""
    return f"CAST(round(round(CAST(CAST(avg({column}) AS VARCHAR) AS DECIMAL(38,12)), 6), 2) AS DOUBLE)"


def age(dob: str) -> str:
    return f"CAST(datesub('year', {dob}, DATE '{AS_OF}') AS INTEGER)"


def _band(dob: str) -> str:
    a = age(dob)
    return f"CASE WHEN {a} < 18 THEN '0-17' WHEN {a} < 40 THEN '18-39' WHEN {a} < 65 THEN '40-64' ELSE '65+' END"


def _count(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


def _money(condition: str, column: str = "TotalAmount") -> str:
    return f"CAST(sum(CASE WHEN {condition} THEN {column} ELSE 0 END) AS DOUBLE)"


def d(column: str) -> str:
    return f"CAST({column} AS VARCHAR)"


def ts(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


MARTS: dict[str, str] = {
    "patient_summary": f"""
        SELECT p.PatientID, FirstName, LastName, Gender, DOB, InsuranceID,
               coalesce(n, 0) AS TotalAppointments, coalesce(comp, 0) AS CompletedAppointments,
               coalesce(canc, 0) AS CancelledAppointments, LastVisitDate, FirstVisitDate,
               coalesce(billed, 0) AS LifetimeBilled, coalesce(paid, 0) AS LifetimePaid,
               coalesce(claims, 0) AS TotalClaims, coalesce(claimed, 0) AS TotalClaimAmount,
               coalesce(appr, 0) AS ApprovedClaims, {age('DOB')} AS Age
        FROM patients p
        LEFT JOIN (SELECT PatientID, count(*) AS n, {_count("Status = 'Completed'")} AS comp,
                          {_count("Status = 'Cancelled'")} AS canc, max(AppointmentDate) AS LastVisitDate,
                          min(AppointmentDate) AS FirstVisitDate FROM appointments GROUP BY 1) a ON a.PatientID = p.PatientID
        LEFT JOIN (SELECT PatientID, sum(TotalAmount) AS billed,
                          sum(CASE WHEN PaymentStatus = 'Paid' THEN TotalAmount ELSE 0 END) AS paid
                   FROM billing GROUP BY 1) b ON b.PatientID = p.PatientID
        LEFT JOIN (SELECT PatientID, count(*) AS claims, sum(ClaimAmount) AS claimed,
                          {_count("ApprovalStatus = 'Approved'")} AS appr
                   FROM insurance_claims GROUP BY 1) c ON c.PatientID = p.PatientID""",
    "doctor_performance": f"""
        SELECT DoctorID, DoctorName, Specialization, Department, Hospital, Experience,
               count(DISTINCT AppointmentID) AS TotalAppointments,
               {_count("Status = 'Completed'")} AS CompletedAppointments,
               {_count("Status = 'Cancelled'")} AS CancelledAppointments,
               {_count("Status = 'NoShow'")} AS NoShowAppointments,
               count(DISTINCT PatientID) AS UniquePatients,
               coalesce(sum(TotalAmount), 0) AS AttributedRevenue,
               {r2('''count(*) FILTER (WHERE Status = 'Completed') / CAST(count(DISTINCT AppointmentID) AS DOUBLE) * 100''')} AS CompletionRatePct
        FROM (SELECT a.*, d.* EXCLUDE (DoctorID), b.TotalAmount FROM appointments a JOIN doctors d ON a.DoctorID = d.DoctorID
              LEFT JOIN billing b ON b.AppointmentID = a.AppointmentID)
        GROUP BY ALL""",
    "revenue_analytics": """
        SELECT b.InvoiceID, b.PatientID, b.AppointmentID, b.TotalAmount, b.PaymentStatus, b.PaymentDate,
               d.Department, d.Hospital, d.DoctorID, d.DoctorName,
               year(b.PaymentDate) AS PaymentYear, month(b.PaymentDate) AS PaymentMonth,
               strftime(b.PaymentDate, '%Y-%m') AS PaymentYearMonth
        FROM billing b LEFT JOIN appointments a ON b.AppointmentID = a.AppointmentID
        LEFT JOIN doctors d ON a.DoctorID = d.DoctorID""",
    "hospital_revenue": f"""
        SELECT Hospital, CAST(sum(TotalAmount) AS DOUBLE) AS TotalRevenue,
               {_money("PaymentStatus = 'Paid'")} AS CollectedRevenue,
               {_money("PaymentStatus = 'Pending'")} AS PendingRevenue,
               count(DISTINCT InvoiceID) AS InvoiceCount, count(DISTINCT PatientID) AS PatientCount,
               {mean2('TotalAmount')} AS AvgInvoiceAmount
        FROM revenue_analytics GROUP BY 1""",
    "insurance_analytics": f"""
        SELECT InsuranceCompany, count(*) AS TotalClaims, CAST(sum(ClaimAmount) AS DOUBLE) AS TotalClaimAmount,
               {_count("ApprovalStatus = 'Approved'")} AS ApprovedCount,
               {_count("ApprovalStatus = 'Denied'")} AS DeniedCount,
               {_count("ApprovalStatus = 'Pending'")} AS PendingCount,
               {r2('''count(*) FILTER (WHERE ApprovalStatus = 'Approved') / CAST(count(*) AS DOUBLE) * 100''')} AS ApprovalRatePct,
               {mean2('ClaimAmount')} AS AvgClaimAmount
        FROM insurance_claims GROUP BY 1""",
    "appointment_analytics": """
        SELECT CAST(AppointmentDate AS DATE) AS AppointmentDay, Status, Department, Hospital,
               count(*) AS AppointmentCount, count(DISTINCT PatientID) AS UniquePatients,
               count(DISTINCT a.DoctorID) AS UniqueDoctors
        FROM appointments a LEFT JOIN doctors d ON a.DoctorID = d.DoctorID GROUP BY 1, 2, 3, 4""",
    "monthly_revenue": f"""
        SELECT PaymentYear, PaymentMonth, PaymentYearMonth, CAST(sum(TotalAmount) AS DOUBLE) AS TotalRevenue,
               {_money("PaymentStatus = 'Paid'")} AS CollectedRevenue,
               count(DISTINCT InvoiceID) AS InvoiceCount, {mean2('TotalAmount')} AS AvgInvoiceAmount
        FROM revenue_analytics GROUP BY 1, 2, 3""",
    "daily_revenue": """
        SELECT PaymentDate AS RevenueDate, CAST(sum(TotalAmount) AS DOUBLE) AS TotalRevenue,
               count(DISTINCT InvoiceID) AS InvoiceCount, count(DISTINCT PatientID) AS PatientCount
        FROM revenue_analytics GROUP BY 1""",
    "laboratory_trends": f"""
        SELECT TestName, count(*) AS TestCount, {_count('IsAbnormal')} AS AbnormalCount,
               {r2('count(*) FILTER (WHERE IsAbnormal) / CAST(count(*) AS DOUBLE) * 100')} AS AbnormalRatePct
        FROM laboratory_results GROUP BY 1""",
    "pharmacy_sales": f"""
        SELECT Medicine, CAST(sum(Quantity) AS BIGINT) AS TotalQuantity, CAST(sum(LineAmount) AS DOUBLE) AS TotalSales,
               count(DISTINCT PatientID) AS UniquePatients, count(DISTINCT PrescriptionID) AS PrescriptionCount,
               {mean2('Price')} AS AvgUnitPrice
        FROM pharmacy_orders GROUP BY 1""",
    "patient_visit_summary": f"""
        SELECT CAST(AppointmentDate AS DATE) AS VisitDate, Gender, {_band('DOB')} AS AgeGroup, Status, count(*) AS VisitCount
        FROM appointments a LEFT JOIN patients p ON a.PatientID = p.PatientID GROUP BY 1, 2, 3, 4""",
    "top_diseases": """
        SELECT Diagnosis, count(*) AS DiagnosisCount, count(DISTINCT PatientID) AS UniquePatients,
               count(DISTINCT DoctorID) AS UniqueDoctors
        FROM appointments WHERE trim(Diagnosis) <> '' GROUP BY 1""",
    "cancelled_appointments": """
        SELECT AppointmentID, AppointmentDate, a.PatientID, FirstName, LastName, a.DoctorID, DoctorName, Department,
               Hospital, Diagnosis
        FROM appointments a LEFT JOIN doctors d ON a.DoctorID = d.DoctorID
        LEFT JOIN patients p ON a.PatientID = p.PatientID WHERE Status = 'Cancelled'""",
}
MARTS["doctor_utilization"] = f"""
        SELECT DoctorID, DoctorName, Department, Hospital, TotalAppointments, CompletedAppointments,
               CancelledAppointments, NoShowAppointments, CompletionRatePct, UniquePatients, AttributedRevenue,
               {r2('CompletedAppointments / CAST(CASE WHEN TotalAppointments = 0 THEN 1 ELSE TotalAppointments END AS DOUBLE) * 100')} AS UtilizationPct
        FROM doctor_performance"""

ALL: dict[str, str] = {**RAW, **CLEAN, **MARTS}

# Which expressions each one needs, found by name once at import.
_NEEDS = {name: [n for n in ALL if n != name and n in body.replace("(", " ").replace(")", " ").split()] for name, body in ALL.items()}


def _closure(text: str) -> list[str]:
    words = set(text.replace("(", " ").replace(")", " ").replace(",", " ").split())
    wanted, queue = set(), [n for n in ALL if n in words]
    while queue:
        name = queue.pop()
        if name not in wanted:
            wanted.add(name)
            queue += _NEEDS[name]
    order: list[str] = []

    def place(name: str) -> None:
        if name not in order:
            for needed in _NEEDS[name]:
                place(needed)
            order.append(name)

    for name in ALL:
        if name in wanted:
            place(name)
    return order


def with_ctes(query: str, **extra: str) -> str:
    """Prefix a query with just the expressions it uses, in dependency order."""
    names = _closure(" ".join([query, *extra.values()]))
    parts = [f"{n} AS ({ALL[n]})" for n in names] + [f"{n} AS ({body})" for n, body in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + query
