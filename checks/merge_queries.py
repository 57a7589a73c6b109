"""Merge, history, point-in-time reads, change feeds and table layout."""

from __future__ import annotations

import datetime as dt

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.oracle_ctes import d, ts
from checks.registry import query
from checks.silver import silver, stored
from lamina.contracts import ENTITIES
from lamina.operators import history as h
from lamina.operators import layout
from lamina.operators.joins import broadcast_join
from lamina.operators.merge import merge, merge_between, merge_changed
from lamina.operators.quality import ConstraintViolated
from lamina.session import work_dir
from lamina.sources import snapshots
from lamina.sources.startables import customer_state, read_entity, status_changes

CUT = "1998-01-01"
FIRST_LOAD = dt.datetime(1998, 1, 1)
SECOND_LOAD = dt.datetime(2001, 9, 1)
KEY = "CustomerID"
TRACKED = ["Status"]

# The two loads: newest order per customer before the cut, and from it on.
_NEWEST = "QUALIFY row_number() OVER (PARTITION BY CustomerID ORDER BY OrderedAt DESC, OrderID, Status, Amount) = 1"
LOADS = {
    "t": f"SELECT * FROM customer_orders WHERE OrderedAt < TIMESTAMP '{CUT}' {_NEWEST}",
    "s": f"SELECT * FROM customer_orders WHERE OrderedAt >= TIMESTAMP '{CUT}' {_NEWEST}",
}
_COLUMNS = "CustomerID, OrderID, Status, CAST(Amount AS DOUBLE) AS Amount, " + ts("OrderedAt") + " AS OrderedAt"
_PAIRS = {
    **LOADS,
    "pairs": """SELECT coalesce(t.CustomerID, s.CustomerID) AS CustomerID,
                  t.OrderID AS t_id, t.Status AS t_st, t.Amount AS t_amt, t.OrderedAt AS t_at,
                  s.OrderID AS s_id, s.Status AS s_st, s.Amount AS s_amt, s.OrderedAt AS s_at
           FROM t FULL JOIN s ON t.CustomerID = s.CustomerID""",
}


def loads(spark, sf):
    return customer_state(spark, sf, None, CUT), customer_state(spark, sf, CUT, None)


def _side(side: str) -> str:
    return f"{side}_id AS OrderID, {side}_st AS Status, CAST({side}_amt AS DOUBLE) AS Amount, {ts(side + '_at')} AS OrderedAt"


@query(
    "d01_merge",
    f"""SELECT CustomerID, {_side('t')} FROM pairs WHERE s_id IS NULL
        UNION ALL SELECT CustomerID, {_side('s')} FROM pairs WHERE s_id IS NOT NULL AND NOT (t_id IS NOT NULL AND s_st = 'P' AND t_st = 'P')""",
    **_PAIRS,
)
def _(spark, sf):
    target, source = loads(spark, sf)
    return merge(target, source, KEY, delete_when="s.Status = 'P' AND t.Status = 'P'").snapshot


@query(
    "d01_merge_update_set",
    f"""SELECT CustomerID, coalesce(t_id, s_id) AS OrderID,
               CASE WHEN t_id IS NULL THEN s_st WHEN s_id IS NULL THEN t_st ELSE s_st END AS Status,
               CAST(CASE WHEN t_id IS NULL THEN s_amt WHEN s_id IS NULL THEN t_amt ELSE t_amt + s_amt END AS DOUBLE) AS Amount,
               {ts('coalesce(t_at, s_at)')} AS OrderedAt
        FROM pairs""",
    **_PAIRS,
)
def _(spark, sf):
    target, source = loads(spark, sf)
    return merge(target, source, KEY, update_set={"Status": "s.Status", "Amount": "t.Amount + s.Amount"}).snapshot


@query(
    "d01_merge_counts",
    """SELECT CASE WHEN t_id IS NOT NULL AND s_id IS NOT NULL AND s_st = 'P' AND t_st = 'P' THEN 'deleted'
                   WHEN t_id IS NOT NULL AND s_id IS NOT NULL THEN 'updated'
                   WHEN t_id IS NOT NULL THEN 'kept' ELSE 'inserted' END AS Action, count(*) AS Rows FROM pairs GROUP BY 1""",
    **_PAIRS,
)
def _(spark, sf):
    target, source = loads(spark, sf)
    return merge(target, source, KEY, delete_when="s.Status = 'P' AND t.Status = 'P'").counts()


_TARIFFS = """SELECT date_trunc('month', PaymentDate) AS FromDate, date_trunc('month', PaymentDate) + INTERVAL 1 MONTH AS ToDate,
                     CAST(month(PaymentDate) AS VARCHAR) AS Tariff
              FROM raw_billing WHERE PaymentDate IS NOT NULL AND month(PaymentDate) % 3 <> 0 GROUP BY 1, 2, 3
              UNION ALL SELECT TIMESTAMP '2300-01-01', NULL, 'later' UNION ALL SELECT NULL, TIMESTAMP '1900-01-01', 'earlier'"""


@query(
    "d01_merge_validity_interval",
    f"""SELECT InvoiceID, coalesce(PaymentStatus || '/' || Tariff, PaymentStatus) AS PaymentStatus, CAST(NULL AS VARCHAR) AS Tariff,
               CAST(NULL AS VARCHAR) AS FromDate, CAST(NULL AS VARCHAR) AS ToDate
        FROM raw_billing b LEFT JOIN tariffs f ON b.PaymentDate >= f.FromDate AND b.PaymentDate < f.ToDate
        UNION ALL SELECT NULL, NULL, Tariff, {d('CAST(FromDate AS DATE)')}, {d('CAST(ToDate AS DATE)')} FROM tariffs WHERE Tariff IN ('later', 'earlier')""",
    tariffs=_TARIFFS,
)
def _(spark, sf):
    """Invoices take the tariff in whose months they fall; tariffs that no invoice falls in are added."""
    bills = read_entity(spark, sf, "billing").select("InvoiceID", "PaymentStatus", F.col("PaymentDate").cast("date").alias("PaymentDate"))
    month = F.trunc("PaymentDate", "month")
    tariffs = bills.where(F.month("PaymentDate") % 3 != 0).select(month.alias("FromDate"), F.add_months(month, 1).alias("ToDate"), F.month("PaymentDate").cast("string").alias("Tariff")).distinct()
    open_ends = spark.createDataFrame([(dt.date(2300, 1, 1), None, "later"), (None, dt.date(1900, 1, 1), "earlier")], tariffs.schema)
    done = merge_between(bills, tariffs.unionByName(open_ends), "PaymentDate", "FromDate", "ToDate", update_set={"PaymentStatus": "concat(t.PaymentStatus, '/', s.Tariff)"})
    return done.snapshot.drop("PaymentDate")


_SCD1 = f"""SELECT CustomerID, {_side('t')} FROM pairs WHERE s_id IS NULL OR (t_id IS NOT NULL AND t_st IS NOT DISTINCT FROM s_st)
        UNION ALL SELECT CustomerID, {_side('s')} FROM pairs WHERE s_id IS NOT NULL AND (t_id IS NULL OR t_st IS DISTINCT FROM s_st)"""


@query("d02_scd1", _SCD1, **_PAIRS)
def _(spark, sf):
    target, source = loads(spark, sf)
    return merge_changed(target, source, KEY, TRACKED).snapshot


@query("d03_changed_rows", f"SELECT CustomerID, {_side('s')} FROM pairs WHERE t_id IS NOT NULL AND t_st <> s_st", **_PAIRS)
def _(spark, sf):
    target, source = loads(spark, sf)
    return h.detect_changes(h.open_versions(target, FIRST_LOAD), source, KEY, TRACKED)


@query("d04_new_keys", f"SELECT CustomerID, {_side('s')} FROM pairs WHERE t_id IS NULL", **_PAIRS)
def _(spark, sf):
    target, source = loads(spark, sf)
    return h.detect_new_keys(h.open_versions(target, FIRST_LOAD), source, KEY)


def _versions(start: str, end: str, current: str, number: int) -> str:
    end = f"'{end}'" if end else "CAST(NULL AS VARCHAR)"
    return (
        f"'{start}' AS EffectiveStartDate, {end} AS EffectiveEndDate, {current} AS IsCurrent, {number} AS VersionNumber"
    )


_T1, _T2 = f"{FIRST_LOAD}", f"{SECOND_LOAD}"
_EXPIRED = f"SELECT CustomerID, {_side('t')}, {_versions(_T1, _T2, 'false', 1)} FROM pairs WHERE t_st <> s_st"
_REOPENED = f"SELECT CustomerID, {_side('s')}, {_versions(_T2, '', 'true', 2)} FROM pairs WHERE t_st <> s_st"
_STAYED = f"SELECT CustomerID, {_side('t')}, {_versions(_T1, '', 'true', 1)} FROM pairs WHERE t_id IS NOT NULL AND (s_id IS NULL OR t_st = s_st)"
_INSERTED = f"SELECT CustomerID, {_side('s')}, {_versions(_T2, '', 'true', 1)} FROM pairs WHERE t_id IS NULL"
_HISTORY = " UNION ALL ".join([_EXPIRED, _REOPENED, _STAYED, _INSERTED])


def two_loads(spark, sf, **options):
    target, source = loads(spark, sf)
    first = h.apply_history(None, target, KEY, TRACKED, FIRST_LOAD)
    return h.apply_history(first, source, KEY, TRACKED, SECOND_LOAD, **options)


@query("d05_expired_versions", _EXPIRED, **_PAIRS)
def _(spark, sf):
    return two_loads(spark, sf).where(~h.is_current())


@query("d06_reopened_versions", _REOPENED, **_PAIRS)
def _(spark, sf):
    return two_loads(spark, sf).where("VersionNumber > 1")


@query("d07_inserted_keys", _INSERTED, **_PAIRS)
def _(spark, sf):
    return two_loads(spark, sf).where((F.col("VersionNumber") == 1) & (F.col("EffectiveStartDate") == F.lit(SECOND_LOAD)))


@query("d08_first_load", f"SELECT {_COLUMNS}, {_versions(_T1, '', 'true', 1)} FROM t", **LOADS)
def _(spark, sf):
    return h.apply_history(None, loads(spark, sf)[0], KEY, TRACKED, FIRST_LOAD)


@query("d03_d08_scd2", _HISTORY, **_PAIRS)
def _(spark, sf):
    return two_loads(spark, sf)


@query(
    "d05_close_missing",
    f"SELECT CustomerID, {_side('t')}, {_versions(_T1, _T2, 'false', 1)} FROM pairs WHERE s_id IS NULL OR t_st <> s_st",
    **_PAIRS,
)
def _(spark, sf):
    return two_loads(spark, sf, close_missing=True).where(~h.is_current())


@query("d09_filter_current", f"SELECT * FROM ({_HISTORY}) WHERE IsCurrent", **_PAIRS)
def _(spark, sf):
    # The flag stored as text, as a table written by other means may hold it.
    texts = two_loads(spark, sf).withColumn("IsCurrent", F.when(F.col("IsCurrent"), "Y").otherwise("no"))
    return h.filter_current(texts).withColumn("IsCurrent", h.is_current())


@query("d10_current_snapshot", f"SELECT CustomerID, Status, VersionNumber FROM ({_HISTORY}) WHERE IsCurrent", **_PAIRS)
def _(spark, sf):
    return stored(h.filter_current(two_loads(spark, sf)).select(KEY, "Status", "VersionNumber"), "current")


_LOG = """SELECT Key, State, ChangedAt AS start_at, lead(ChangedAt) OVER w AS end_at, row_number() OVER w AS n
     FROM (SELECT * FROM (SELECT *, lag(State) OVER v AS prior, row_number() OVER v AS rn FROM status_changes
                          WINDOW v AS (PARTITION BY Key ORDER BY ChangedAt, Sequence))
           WHERE rn = 1 OR State IS DISTINCT FROM prior)
     WINDOW w AS (PARTITION BY Key ORDER BY ChangedAt, Sequence)"""
_LOG_COLUMNS = f"""Key, State, {ts('start_at')} AS EffectiveStartDate, {ts('end_at')} AS EffectiveEndDate,
     end_at IS NULL AS IsCurrent, n AS VersionNumber"""


def from_log(spark, sf, **options):
    return h.history_from_log(status_changes(spark, sf), "Key", ["State"], "ChangedAt", "Sequence", **options)


@query("d11_scd2_changelog", f"SELECT {_LOG_COLUMNS} FROM versions", versions=_LOG)
def _(spark, sf):
    return from_log(spark, sf)


@query("d11_scd2_changelog_chunked", f"SELECT {_LOG_COLUMNS} FROM versions", versions=_LOG)
def _(spark, sf):
    """Same history with the log cut into ranges so that no window holds more than some rows of a key."""
    return from_log(spark, sf, max_rows=60)


_MOMENT = dt.datetime(2024, 1, 15, 12)


@query(
    "d12_valid_at",
    f"""SELECT {_LOG_COLUMNS} FROM versions
        WHERE start_at <= TIMESTAMP '{_MOMENT}' AND (end_at IS NULL OR end_at > TIMESTAMP '{_MOMENT}')""",
    versions=_LOG,
)
def _(spark, sf):
    return h.valid_at(from_log(spark, sf), _MOMENT)


@query(
    "d13_version_counts",
    """SELECT n AS VersionNumber, count(*) FILTER (WHERE n = 1) AS Inserted, count(*) FILTER (WHERE n > 1) AS Updated,
              count(*) FILTER (WHERE end_at IS NOT NULL) AS Closed, count(*) FILTER (WHERE end_at IS NULL) AS CurrentRows
       FROM versions GROUP BY 1 ORDER BY 1 DESC LIMIT 20""",
    versions=_LOG,
)
def _(spark, sf):
    return h.version_counts(from_log(spark, sf))


@query(
    "d13_all_version_counts",
    """SELECT n AS VersionNumber, count(*) FILTER (WHERE n = 1) AS Inserted, count(*) FILTER (WHERE n > 1) AS Updated,
              count(*) FILTER (WHERE end_at IS NOT NULL) AS Closed, count(*) FILTER (WHERE end_at IS NULL) AS CurrentRows
       FROM versions GROUP BY 1""",
    versions=_LOG,
)
def _(spark, sf):
    return h.version_counts(from_log(spark, sf), limit=None)


@query(
    "d12_stored_versions",
    f"""SELECT 'first' AS Read, {_COLUMNS} FROM t UNION ALL SELECT 'between', {_COLUMNS} FROM t
        UNION ALL SELECT 'second', {_COLUMNS} FROM s UNION ALL SELECT 'now', {_COLUMNS} FROM s""",
    **LOADS,
)
def _(spark, sf):
    """Two snapshots of one table, read by version and by moment."""
    base = work_dir(spark, "versions")
    snapshots.write_snapshot(customer_state(spark, sf, None, CUT), base, FIRST_LOAD)
    snapshots.write_snapshot(customer_state(spark, sf, CUT, None), base, SECOND_LOAD)
    reads = {"first": {"version": 1}, "between": {"at": SECOND_LOAD - dt.timedelta(seconds=1)}, "second": {"version": 2}, "now": {}}
    parts = [snapshots.read_snapshot(spark, base, **how).select(F.lit(name).alias("Read"), "*") for name, how in reads.items()]
    return reduce(DataFrame.unionByName, parts)


@query(
    "d14_change_feed",
    f"""SELECT CustomerID, {_side('t')}, 'delete' AS _change_type FROM pairs WHERE s_id IS NULL
        UNION ALL SELECT CustomerID, {_side('s')}, 'insert' FROM pairs WHERE t_id IS NULL
        UNION ALL SELECT CustomerID, {_side('t')}, 'update_preimage' FROM pairs WHERE t_id IS NOT NULL AND s_id IS NOT NULL AND (t_id, t_st, t_amt, t_at) IS DISTINCT FROM (s_id, s_st, s_amt, s_at)
        UNION ALL SELECT CustomerID, {_side('s')}, 'update_postimage' FROM pairs WHERE t_id IS NOT NULL AND s_id IS NOT NULL AND (t_id, t_st, t_amt, t_at) IS DISTINCT FROM (s_id, s_st, s_amt, s_at)""",
    **_PAIRS,
)
def _(spark, sf):
    return h.changes_between(*loads(spark, sf), KEY)


_IMAGE = f"CustomerID, OrderID, Status, CAST(Amount AS DOUBLE) AS Amount, {ts('OrderedAt')} AS OrderedAt"
_THREE = {
    **LOADS,
    "v2": """SELECT coalesce(s.CustomerID, t.CustomerID) AS CustomerID, coalesce(s.OrderID, t.OrderID) AS OrderID, coalesce(s.Status, t.Status) AS Status,
                  CASE WHEN s.CustomerID IS NULL THEN t.Amount ELSE s.Amount END AS Amount, coalesce(s.OrderedAt, t.OrderedAt) AS OrderedAt
           FROM t FULL JOIN s ON t.CustomerID = s.CustomerID WHERE s.CustomerID IS NULL OR t.CustomerID IS NULL OR t.Status IS DISTINCT FROM s.Status
           UNION ALL SELECT t.* FROM t JOIN s ON t.CustomerID = s.CustomerID WHERE t.Status IS NOT DISTINCT FROM s.Status""",
}


def three_loads(spark, sf, base):
    """A table loaded, merged with later orders, and merged with a third of itself anew: every fifth order voided, the P ones deleted."""
    first, second = loads(spark, sf)
    snapshots.write_snapshot(merge(None, first, KEY, images=True).actions, base, FIRST_LOAD, "merge")
    held = snapshots.read_snapshot(spark, base)
    snapshots.write_snapshot(merge_changed(held, second, KEY, TRACKED, images=True).actions, base, SECOND_LOAD, "merge")
    held = snapshots.read_snapshot(spark, base)
    third = held.where("OrderID % 3 = 0").withColumn("Status", F.when(F.col("OrderID") % 5 == 0, F.lit("V")).otherwise(F.col("Status")))
    done = merge(held, third, KEY, delete_when="t.Status = 'P'", update_when="t.Status <> s.Status", images=True)
    snapshots.write_snapshot(done.actions, base, SECOND_LOAD + dt.timedelta(days=1), "merge")


@query(
    "d14_feed_of_three_loads",
    f"""SELECT {_IMAGE}, 'insert' AS _change_type, 1 AS _commit_version FROM t
        UNION ALL SELECT {_IMAGE}, 'insert', 2 FROM s WHERE CustomerID NOT IN (SELECT CustomerID FROM t)
        UNION ALL SELECT {_IMAGE}, 'update_preimage', 2 FROM t WHERE EXISTS (SELECT 1 FROM s WHERE s.CustomerID = t.CustomerID AND s.Status IS DISTINCT FROM t.Status)
        UNION ALL SELECT {_IMAGE}, 'update_postimage', 2 FROM s WHERE EXISTS (SELECT 1 FROM t WHERE s.CustomerID = t.CustomerID AND s.Status IS DISTINCT FROM t.Status)
        UNION ALL SELECT {_IMAGE}, 'delete', 3 FROM v2 WHERE OrderID % 3 = 0 AND Status = 'P'
        UNION ALL SELECT {_IMAGE}, 'update_preimage', 3 FROM v2 WHERE OrderID % 15 = 0 AND Status <> 'P'
        UNION ALL SELECT {_IMAGE}, 'update_postimage', 3 FROM (SELECT * REPLACE ('V' AS Status) FROM v2 WHERE OrderID % 15 = 0 AND Status <> 'P')""",
    **_THREE,
)
def _(spark, sf):
    """What three loads changed, as the loads themselves stored it."""
    base = work_dir(spark, "feed")
    three_loads(spark, sf, base)
    return snapshots.read_changes(spark, base, 1).drop("_commit_timestamp")


@query(
    "d14_snapshot_beside_its_feed",
    f"""SELECT {_IMAGE} FROM (SELECT * REPLACE (CASE WHEN OrderID % 15 = 0 THEN 'V' ELSE Status END AS Status) FROM v2 WHERE NOT (OrderID % 3 = 0 AND Status = 'P'))""",
    **_THREE,
)
def _(spark, sf):
    base = work_dir(spark, "feed")
    three_loads(spark, sf, base)
    return snapshots.read_snapshot(spark, base)


@query(
    "d16_write_refused",
    f"""SELECT {_COLUMNS}, (SELECT 'amount_bound: ' || count(*) || ' rows; unique_CustomerID: ' || 2 * count(*) || ' rows'
                            FROM s WHERE Status = 'F' AND Amount > 100) AS Refused FROM t""",
    **LOADS,
)
def _(spark, sf):
    """A load that breaks the table's constraints is refused and the old version stays; a clean one goes in after it."""
    base, (first, second) = work_dir(spark, "constrained"), loads(spark, sf)
    snapshots.write_snapshot(first, base, FIRST_LOAD)
    snapshots.add_constraints(spark, base, {"amount_bound": "Amount IS NULL OR Amount > -1"}, ["CustomerID"])
    twice = second.where("Status = 'F' AND Amount > 100")
    bad = second.unionByName(twice.withColumn("Amount", -F.col("Amount")))
    try:
        snapshots.write_snapshot(bad, base, SECOND_LOAD)
    except ConstraintViolated as problem:
        refused = str(problem)
    left = stored(snapshots.read_snapshot(spark, base), "left").withColumn("Refused", F.lit(refused))
    snapshots.write_snapshot(second, base, SECOND_LOAD)
    if snapshots.last_version(spark, base) != 2:
        raise RuntimeError("the clean load was not committed as version 2")
    return left


@query(
    "d15_cluster",
    f"""SELECT InvoiceID, PatientID, AppointmentID, CAST(TotalAmount AS DOUBLE) AS TotalAmount, PaymentStatus,
               CAST(PaymentDate AS VARCHAR) AS PaymentDate FROM billing""",
)
def _(spark, sf):
    """Rewritten along the curve and read back: the same rows, in narrower files."""
    bills = stored(silver(spark, sf, "billing"), "billing")
    return stored(layout.cluster(bills, ENTITIES["billing"].cluster_by, file_bytes=1 << 20), "clustered")


@query(
    "d19_broadcast_join",
    """SELECT a.AppointmentID, a.DoctorID, d.DoctorName, d.Hospital
       FROM raw_appointments a LEFT JOIN raw_doctors d ON a.DoctorID = d.DoctorID""",
)
def _(spark, sf):
    visits = read_entity(spark, sf, "appointments").select("AppointmentID", "DoctorID")
    people = read_entity(spark, sf, "doctors").select("DoctorID", "DoctorName", "Hospital")
    return broadcast_join(visits, people, "DoctorID")
