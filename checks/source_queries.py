"""Sources, sinks, bronze lineage and streams, over files that Spark writes from the tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from checks.oracle_ctes import AS_OF, d, ts
from checks.registry import AS_OF_TIME, query
from lamina.contracts import ENTITIES, HASH_SEPARATOR, LINEAGE, NULL_TOKEN
from lamina.functions.text import record_hash
from lamina.operators.cleaning import drop_lineage
from lamina.operators.lineage import add_lineage, hashed_columns, lineage_report, with_ingestion_date
from lamina.session import freeing_shuffles, work_dir
from lamina.sources import inference, landing, tables
from lamina.sources.startables import READERS, read_entity
from lamina.streaming.files import ingest, stream_landing

LOAD, BATCH = "LOAD_20250630000000_checks", "BATCH_checks"
PADDED = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "timestampFormat": "yyyy-MM-dd HH:mm:ss"}


def land(spark, sf, name, fmt="csv", path=None, df=None, **more):
    """Write an entity as landing files and return their folder; ``more`` goes to the writer."""
    path = path or work_dir(spark, f"landing-{name}")
    df = read_entity(spark, sf, name) if df is None else df
    options = {"header": "true", **PADDED} if fmt == "csv" else {"timestampFormat": PADDED["timestampFormat"]}
    df.write.options(**options, **more).format(fmt).save(path)
    return path


_PATIENTS = f"""SELECT * REPLACE ({d('DOB')} AS DOB, {ts('CreatedDate')} AS CreatedDate, {ts('ModifiedDate')} AS ModifiedDate)
                FROM raw_patients"""
_CLAIMS = f"SELECT * REPLACE (CAST(ClaimAmount AS DOUBLE) AS ClaimAmount, {d('ClaimDate')} AS ClaimDate) FROM raw_insurance_claims"


@query("s01_csv_scan", _PATIENTS)
def _(spark, sf):
    scanned = landing.scan_csv(spark, land(spark, sf, "patients"), ENTITIES["patients"])
    return scanned.drop("_rescued_data", "_source_file")


@query("s02_json_scan", _CLAIMS)
def _(spark, sf):
    path = land(spark, sf, "insurance_claims", "json")
    return landing.scan_json(spark, path, ENTITIES["insurance_claims"], multi_line=False).drop("_rescued_data", "_source_file")


@query("s03_file_stream", "SELECT InsuranceCompany, ApprovalStatus, count(*) AS Claims FROM raw_insurance_claims GROUP BY 1, 2")
def _(spark, sf):
    """Landing files read as a stream, a few per trigger, until none are left."""
    files = read_entity(spark, sf, "insurance_claims").repartition(5)
    path, out = land(spark, sf, "insurance_claims", df=files), work_dir(spark, "stream")
    stream = stream_landing(spark, path, ENTITIES["insurance_claims"], files_per_trigger=2)
    writer = stream.writeStream.format("parquet").option("checkpointLocation", work_dir(spark, "checkpoint"))
    writer.trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out).groupBy("InsuranceCompany", "ApprovalStatus").agg(F.count("*").alias("Claims"))


@query("s04_stream_to_bronze", _CLAIMS)
def _(spark, sf):
    """Enriched micro-batches appended to bronze; then the stream starts anew and finds nothing to do."""
    spec = ENTITIES["insurance_claims"]
    path = land(spark, sf, spec.name, df=read_entity(spark, sf, spec.name).repartition(4))
    bronze, checkpoint = work_dir(spark, "bronze"), work_dir(spark, "checkpoint")
    for _ in range(2):
        run = ingest(spark, path, spec, bronze, checkpoint, LOAD, lambda: AS_OF_TIME, files_per_trigger=2)
        run.awaitTermination()
    return drop_lineage(spark.read.parquet(bronze))


ARRAY_ROWS = 10_000


def land_arrays(spark, df, path):
    """JSON files that each hold one array of about ``ARRAY_ROWS`` rows, however many rows there are."""
    arrays = max(4, -(-df.count() // ARRAY_ROWS))
    part = F.pmod(F.xxhash64(*df.columns), F.lit(arrays))
    whole = df.groupBy(part).agg(F.to_json(F.collect_list(F.struct(*df.columns)), {"timestampFormat": PADDED["timestampFormat"]}).alias("value"))
    whole.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


@query("s02_json_array", _CLAIMS)
def _(spark, sf):
    """Array files through the stream into bronze."""
    spec, bronze = ENTITIES["insurance_claims"], work_dir(spark, "bronze")
    path = land_arrays(spark, read_entity(spark, sf, spec.name), work_dir(spark, "arrays"))
    ingest(spark, path, spec, bronze, work_dir(spark, "checkpoint"), LOAD, lambda: AS_OF_TIME, "json").awaitTermination()
    return drop_lineage(spark.read.parquet(bronze))


@query("s02_json_lines_default", _CLAIMS)
def _(spark, sf):
    """Lines are found to be lines without being told."""
    path = land(spark, sf, "insurance_claims", "json")
    return landing.scan_json(spark, path, ENTITIES["insurance_claims"]).drop("_rescued_data", "_source_file")


@query("s02_json_mixed_forms", _CLAIMS)
def _(spark, sf):
    """Lines, arrays in one line, and arrays that span lines in one load."""
    spec, claims, base = ENTITIES["insurance_claims"], read_entity(spark, sf, "insurance_claims"), work_dir(spark, "forms")
    part = F.pmod(F.xxhash64("ClaimID"), F.lit(3))
    land(spark, sf, spec.name, "json", f"{base}/lines", claims.where(part == 0))
    land_arrays(spark, claims.where(part == 1), f"{base}/arrays")
    flat = spark.read.text(land_arrays(spark, claims.where(part == 2), f"{base}/flat"))
    flat.select(F.regexp_replace("value", r"(?<=[\[}])(,?)(?=[{\]])", "$1\n").alias("value")).write.text(f"{base}/tall")
    paths = [f"{base}/{form}" for form in ("lines", "arrays", "tall")]
    return landing.scan_json(spark, paths, spec).drop("_rescued_data", "_source_file")


def _two_orders(spark, sf):
    """Doctors in two halves whose files have their columns in opposite order."""
    path, doctors = work_dir(spark, "orders"), read_entity(spark, sf, "doctors")
    half = F.pmod(F.xxhash64("DoctorID"), F.lit(2))
    land(spark, sf, "doctors", path=f"{path}/a", df=doctors.where(half == 0))
    land(spark, sf, "doctors", path=f"{path}/b", df=doctors.where(half == 1).select(*reversed(doctors.columns)))
    return [f"{path}/a", f"{path}/b"]


@query("s01_mixed_headers", "SELECT * FROM raw_doctors")
def _(spark, sf):
    return landing.scan_csv(spark, _two_orders(spark, sf), ENTITIES["doctors"]).drop("_rescued_data", "_source_file")


def _widening_loads(spark, sf):
    """Claims in three loads whose undeclared column holds small numbers, then large ones, then amounts."""
    spec, claims = ENTITIES["insurance_claims"], read_entity(spark, sf, "insurance_claims")
    folder, checkpoint, bronze = work_dir(spark, "widening"), work_dir(spark, "checkpoint"), work_dir(spark, "bronze")
    types = f"{checkpoint}-types"
    month = F.month(F.col("ClaimDate").cast("date"))
    forms = (F.length("ClaimID").cast("string"), F.lit("3000000000"), F.col("ClaimAmount").cast("decimal(18,2)").cast("string"))
    for k, form in enumerate(forms):
        load = claims.where(F.pmod(month, F.lit(3)) == k).withColumn("Extra", form)
        load.write.mode("append").options(header="true", **PADDED).csv(folder)
        ingest(spark, folder, spec, bronze, checkpoint, f"{LOAD}{k}", lambda: AS_OF_TIME, types=types).awaitTermination()
    return spark.read.option("mergeSchema", "true").parquet(bronze), types


@query(
    "s03_widening_column",
    """SELECT ClaimID, CAST(CASE month(CAST(ClaimDate AS DATE)) % 3 WHEN 0 THEN length(ClaimID) WHEN 1 THEN 3000000000
                             ELSE CAST(ClaimAmount AS DECIMAL(18,2)) END AS DOUBLE) AS Extra FROM raw_insurance_claims WHERE ClaimDate IS NOT NULL""",
)
def _(spark, sf):
    """An undeclared column that widens twice, read under the type that all its loads fit."""
    stored, types = _widening_loads(spark, sf)
    rows = inference.apply_types(stored, inference.noted(spark, types)[1])
    if not dict(rows.dtypes)["Extra"].startswith("decimal"):
        raise RuntimeError(f"Extra was read as {dict(rows.dtypes)['Extra']}")
    return rows.select("ClaimID", "Extra")


@query(
    "s03_type_history",
    """SELECT 1 AS version, 'Extra' AS "column", 'int' AS type UNION ALL SELECT 2, 'Extra', 'bigint'
       UNION ALL SELECT 3, 'Extra', 'decimal(' || CAST(greatest(10, max(length(CAST(CAST(trunc(ClaimAmount) AS BIGINT) AS VARCHAR)))) + 2 AS VARCHAR) || ',2)'
       FROM raw_insurance_claims WHERE month(CAST(ClaimDate AS DATE)) % 3 = 2""",
)
def _(spark, sf):
    _, types = _widening_loads(spark, sf)
    return inference.type_history(spark, types).drop("noted_by")


@query("s08_stream_new_column", "SELECT *, NULL AS Pager FROM raw_doctors UNION ALL SELECT *, 'P' || DoctorID FROM raw_doctors")
def _(spark, sf):
    """Files that come later have a column more; the stream goes on from its checkpoint."""
    spec = ENTITIES["doctors"]
    path, bronze, checkpoint = work_dir(spark, "landing"), work_dir(spark, "bronze"), work_dir(spark, "checkpoint")
    for k, df in enumerate((read_entity(spark, sf, "doctors"), _widened(spark, sf))):
        options = {"header": "true", **PADDED}
        df.write.mode("append").options(**options).csv(path)
        ingest(spark, path, spec, bronze, checkpoint, f"{LOAD}{k}", lambda: AS_OF_TIME).awaitTermination()
    return drop_lineage(spark.read.option("mergeSchema", "true").parquet(bronze))


@query("s04_new_checkpoint_keeps_rows", "SELECT * FROM raw_doctors UNION ALL SELECT * FROM raw_doctors")
def _(spark, sf):
    """The same entity loaded again by a stream that begins anew: both loads are in bronze."""
    spec, bronze = ENTITIES["doctors"], work_dir(spark, "bronze")
    for _ in range(2):
        path = land(spark, sf, "doctors")
        ingest(spark, path, spec, bronze, work_dir(spark, "checkpoint"), LOAD, lambda: AS_OF_TIME).awaitTermination()
    return drop_lineage(spark.read.parquet(bronze))


def damaged_billing(spark, sf):
    """Invoices whose amount or date is not readable for some statuses."""
    bills = read_entity(spark, sf, "billing")
    return bills.withColumns(
        {
            "TotalAmount": F.when(F.col("PaymentStatus") == "Partial", "n.a.").otherwise(F.col("TotalAmount").cast("string")),
            "PaymentDate": F.when(F.col("PaymentStatus") == "Pending", "soon").otherwise(F.col("PaymentDate").cast("string")),
        }
    )


_DAMAGED = "PaymentStatus IN ('Partial', 'Pending')"


@query(
    "s06_rescued_rows",
    f"""SELECT InvoiceID, PaymentStatus, CASE WHEN PaymentStatus <> 'Partial' THEN CAST(TotalAmount AS DOUBLE) END AS TotalAmount
        FROM raw_billing WHERE {_DAMAGED}""",
)
def _(spark, sf):
    path = land(spark, sf, "billing", df=damaged_billing(spark, sf))
    rows = landing.rescued_rows(landing.scan_csv(spark, path, ENTITIES["billing"]))
    return rows.select("InvoiceID", "PaymentStatus", "TotalAmount")


@query(
    "s07_bad_record_split",
    f"""SELECT 'good' AS Part, count(*) AS Rows FROM raw_billing WHERE NOT ({_DAMAGED})
        UNION ALL SELECT 'bad', count(*) FROM raw_billing WHERE {_DAMAGED}""",
)
def _(spark, sf):
    path, base = land(spark, sf, "billing", df=damaged_billing(spark, sf)), work_dir(spark, "split")
    parts = landing.split_bad_records(landing.scan_csv(spark, path, ENTITIES["billing"]))
    out = []
    for name, part in zip(("good", "bad"), parts, strict=True):
        tables.write_table(part, f"{base}/{name}")
        out.append(tables.read_table(spark, f"{base}/{name}").agg(F.lit(name).alias("Part"), F.count("*").alias("Rows")))
    return out[0].unionByName(out[1])


@query(
    "s07_array_with_bad_element",
    f"""SELECT InvoiceID, 'good' AS Part FROM raw_billing WHERE NOT ({_DAMAGED})
        UNION ALL SELECT InvoiceID, 'bad' FROM raw_billing WHERE {_DAMAGED}""",
)
def _(spark, sf):
    """Bad elements among the good ones of an array: only they are put aside, each with its own text."""
    path = land_arrays(spark, damaged_billing(spark, sf), work_dir(spark, "arrays"))
    good, bad = landing.split_bad_records(landing.scan_json(spark, path, ENTITIES["billing"]))
    kept = bad.select(F.get_json_object("_rescued_data", "$.InvoiceID").alias("InvoiceID"), F.lit("bad").alias("Part"))
    return good.select("InvoiceID", F.lit("good").alias("Part")).unionByName(kept)


def _widened(spark, sf):
    return read_entity(spark, sf, "doctors").withColumn("Pager", F.concat(F.lit("P"), "DoctorID"))


@query(
    "s08_evolution_add_columns",
    """SELECT *, NULL AS Pager, 1 AS Load FROM raw_doctors UNION ALL SELECT *, 'P' || DoctorID, 2 FROM raw_doctors""",
)
def _(spark, sf):
    """A later load brings a new column: null before it, kept from then on."""
    base = work_dir(spark, "evolving")
    tables.write_table(read_entity(spark, sf, "doctors").withColumn("Load", F.lit(1)), base)
    later = landing.evolve(_widened(spark, sf).withColumn("Load", F.lit(2)), ENTITIES["doctors"].columns | {"Load": "int"})
    tables.write_table(later, base)
    return tables.read_table(spark, base, merge_schema=True)


@query("s08_evolution_rescue", "SELECT DoctorID, '{\"Pager\":\"P' || DoctorID || '\"}' AS _rescued_data FROM raw_doctors")
def _(spark, sf):
    path = land(spark, sf, "doctors", df=_widened(spark, sf))
    return landing.scan_csv(spark, path, ENTITIES["doctors"], "rescue").select("DoctorID", "_rescued_data")


@query("s08_evolution_none", "SELECT * FROM raw_doctors")
def _(spark, sf):
    path = land(spark, sf, "doctors", df=_widened(spark, sf))
    return landing.scan_csv(spark, path, ENTITIES["doctors"], "none").drop("_rescued_data", "_source_file")


@query("s09_table_round_trip", _CLAIMS)
def _(spark, sf):
    base = work_dir(spark, "table")
    tables.write_table(read_entity(spark, sf, "insurance_claims"), base, partition_by=["ApprovalStatus"], rebalance=True)
    return tables.read_table(spark, base)


@query(
    "s12_register_layer",
    "SELECT Hospital, count(*) AS Doctors, 'SUCCESS,SKIPPED' AS Status FROM raw_doctors GROUP BY 1",
)
def _(spark, sf):
    base = work_dir(spark, "layer")
    tables.write_table(read_entity(spark, sf, "doctors"), f"{base}/doctors")
    report = tables.register_layer(spark, {"layer_doctors": f"{base}/doctors", "layer_absent": f"{base}/absent"})
    status = ",".join(report.values())
    return spark.sql(f"SELECT Hospital, count(*) AS Doctors, '{status}' AS Status FROM layer_doctors GROUP BY Hospital")


@query("s12_register_again", "SELECT Hospital, count(*) AS Doctors, 'P' || max(DoctorID) AS Pager FROM raw_doctors GROUP BY 1")
def _(spark, sf):
    """A catalog entry follows its table to the next version, with the column that this brings."""
    base, database = work_dir(spark, "layer"), "lamina_checks"
    for version, df in enumerate((read_entity(spark, sf, "doctors"), _widened(spark, sf)), 1):
        tables.write_table(df, f"{base}/version={version}")
        report = tables.register_layer(spark, {"doctors_again": f"{base}/version={version}"}, database)
        if report != {"doctors_again": "SUCCESS"}:
            raise RuntimeError(report["doctors_again"])
    return spark.sql(f"SELECT Hospital, count(*) AS Doctors, max_by(Pager, DoctorID) AS Pager FROM {database}.doctors_again GROUP BY Hospital")


@query(
    "s14_dead_letters",
    f"""SELECT InvoiceID, 'billing' AS Entity, 'run-1' AS RunID, 'NegativeAmount' AS ErrorType,
               CAST(TotalAmount AS DOUBLE) AS Amount, '{AS_OF} 00:00:00' AS CreatedAt FROM raw_billing WHERE TotalAmount < 0""",
)
def _(spark, sf):
    bad = read_entity(spark, sf, "billing").where("TotalAmount < 0")
    letters = tables.dead_letters(bad, "billing", "run-1", "NegativeAmount", "amount below zero", AS_OF_TIME)
    return letters.select(
        F.get_json_object("Payload", "$.InvoiceID").alias("InvoiceID"),
        "Entity",
        "RunID",
        "ErrorType",
        F.get_json_object("Payload", "$.TotalAmount").cast("double").alias("Amount"),
        "CreatedAt",
    )


@query(
    "s15_json_payload",
    """SELECT '{"DoctorID":"' || DoctorID || '","DoctorName":"' || DoctorName || '","Specialization":"' || Specialization
              || '","Department":"' || Department || '","Hospital":"' || Hospital || '","Experience":' || Experience || '}' AS payload
       FROM raw_doctors""",
)
def _(spark, sf):
    return tables.json_payload(read_entity(spark, sf, "doctors"))


def bronze(spark, sf, name):
    return add_lineage(read_entity(spark, sf, name), LOAD, BATCH, AS_OF_TIME)


def _hash_sql(*columns: str) -> str:
    fields = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '{NULL_TOKEN}')" for c in columns)
    return f"sha256(concat_ws('{HASH_SEPARATOR}', {fields}))"


_BILL = ("InvoiceID", "PatientID", "AppointmentID", "TotalAmount", "PaymentStatus", "PaymentDate")


@query(
    "b01_lineage",
    f"""SELECT InvoiceID, {_hash_sql(*_BILL)} AS _record_hash, '{AS_OF} 00:00:00' AS _ingestion_time, 'unknown' AS _source_file,
               '{LOAD}' AS _load_id, '{BATCH}' AS _batch_id, CAST(NULL AS VARCHAR) AS _rescued_data, '{AS_OF}' AS ingestion_date
        FROM raw_billing""",
)
def _(spark, sf):
    return bronze(spark, sf, "billing").select("InvoiceID", *LINEAGE)


@query("b01_source_file", "SELECT count(*) AS Rows, true AS EveryRowHasItsFile FROM raw_doctors")
def _(spark, sf):
    """A scan names the file each row came from."""
    scanned = landing.scan_csv(spark, land(spark, sf, "doctors"), ENTITIES["doctors"])
    stamped = add_lineage(scanned, LOAD, BATCH, AS_OF_TIME)
    named = F.col("_source_file").endswith(".csv")
    return stamped.agg(F.count("*").alias("Rows"), F.every(named).alias("EveryRowHasItsFile"))


_DIRTY_PATIENT = ("PatientID", "FirstName", "LastName", "DOB", "Gender", "Phone", "Email", "Address", "InsuranceID", "CreatedDate", "ModifiedDate")


@query("b02_record_hash", f"SELECT PatientID, {_hash_sql(*_DIRTY_PATIENT)} AS Digest FROM raw_patients")
def _(spark, sf):
    people = read_entity(spark, sf, "patients")
    return people.select("PatientID", record_hash(people.columns).alias("Digest"))


@query(
    "b02_record_hash_length_prefixed",
    "SELECT DoctorID, sha256(concat_ws('||', length(DoctorID) || ':' || DoctorID, length(Hospital) || ':' || Hospital)) AS Digest FROM raw_doctors",
)
def _(spark, sf):
    return read_entity(spark, sf, "doctors").select(
        "DoctorID", record_hash(["DoctorID", "Hospital"], length_prefixed=True).alias("Digest")
    )


@query(
    "b03_hashed_columns",
    f"SELECT DoctorID, {_hash_sql('DoctorID', 'Hospital')} AS Chosen, {_hash_sql('DoctorID', 'DoctorName', 'Specialization', 'Department', 'Hospital', 'Experience')} AS AllOfThem FROM raw_doctors",
)
def _(spark, sf):
    people = read_entity(spark, sf, "doctors").withColumn("_note", F.lit("not hashed"))
    return people.select(
        "DoctorID",
        record_hash(hashed_columns(people, ["DoctorID", "Hospital"])).alias("Chosen"),
        record_hash(hashed_columns(people)).alias("AllOfThem"),
    )


@query("b04_ingestion_date", f"SELECT AppointmentID, {d('CAST(AppointmentDate AS DATE)')} AS ingestion_date FROM raw_appointments")
def _(spark, sf):
    visits = read_entity(spark, sf, "appointments").select("AppointmentID", "AppointmentDate")
    return with_ingestion_date(visits, "AppointmentDate").drop("AppointmentDate")


@query(
    "b06_lineage_report",
    f"""SELECT '{LOAD}' AS _load_id, count(*) AS Rows, 0 AS RowsMissingLineage, count(DISTINCT h) AS DistinctHashes,
               count(*) - count(DISTINCT h) AS RepeatedRows FROM (SELECT {_hash_sql('PatientID', 'AppointmentID')} AS h FROM raw_billing)""",
)
def _(spark, sf):
    bills = read_entity(spark, sf, "billing")
    return lineage_report(add_lineage(bills, LOAD, BATCH, AS_OF_TIME, ["PatientID", "AppointmentID"]))


def land_all(spark, sf, lake, fmt="csv"):
    """All entities side by side; packed at the level that costs the fewest seconds."""
    packed = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
    with freeing_shuffles(spark), ThreadPoolExecutor(len(READERS)) as pool:
        list(pool.map(lambda name: land(spark, sf, name, fmt, lake.path("landing", name), **packed), READERS))
