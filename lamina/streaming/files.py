"""Landing files as a stream: each file read once, each micro-batch written once."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lamina.contracts import BATCH_ID, INGESTION_DATE, LINEAGE, RESCUED, Entity
from lamina.functions.times import moment
from lamina.operators.lineage import add_lineage, batch_id
from lamina.operators.monitoring import counting
from lamina.session import PACKED, remove
from lamina.sources import inference
from lamina.sources.landing import csv_options, json_elements, located, records, scan, split_bad_records, typed_json

# How much one trigger takes, and how often a continuous one fires.
FILES_PER_TRIGGER = 1000
TRIGGER_INTERVAL = "10 seconds"

Clock = Callable[[], dt.datetime]


def stream_landing(
    spark: SparkSession,
    path: str,
    spec: Entity,
    fmt: str = "csv",
    files_per_trigger: int = FILES_PER_TRIGGER,
    multi_line: bool | None = None,
    types: str | None = None,
) -> DataFrame:
    """Landing files, present and future, as a streaming frame with their names.

    The CSV files already there give the column order; a file that later departs
    from it fails the batch rather than shifting values between columns.  ``ingest`` takes files of any header.
    JSON files may each have their form and are read whole, unless ``multi_line`` is false: then
    all have a value a line.  Columns of CSV files that ``spec`` does not declare have the types noted at ``types``
    when the stream starts, else they are text.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
    if fmt == "csv":
        header = spark.read.option("header", "true").csv(path).columns
        declared = ", ".join(f"`{c}` {spec.columns.get(c, 'string')}" for c in header)
        reader = reader.options(**csv_options()).option("enforceSchema", "false")
    elif fmt == "json":
        lines = multi_line is False
        texts = reader.text(path, wholetext=not lines)
        texts = texts.select("value", F.col("_metadata.file_path").alias("file"))
        return typed_json(json_elements(texts if lines or multi_line else records(texts)), spec.ddl())
    else:
        raise ValueError(f"unsupported landing format {fmt!r}")
    raw = reader.schema(f"{declared}, `{RESCUED}` string").format(fmt).load(path)
    return inference.apply_types(located(raw), inference.noted(spark, types)[1] if types else {})


def stream_file_names(spark: SparkSession, path: str, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """Names of landing files as they come, each once; their content is not read."""
    reader = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", files_per_trigger)
    reader = reader.schema("path string, modificationTime timestamp, length long, content binary")
    return reader.load(path).select("path")


def write_batch(df: DataFrame, target: str, batch: str, at: dt.datetime | None = None) -> int:
    """Write one batch to its own partition folder, replacing an earlier attempt; returns its rows.

    Rows that were all stamped with the moment ``at`` share one ingestion date and go straight to its folder.  Else Spark
    divides them by date, for which every task sorts its rows.
    """
    counted, seen = counting(df.drop(BATCH_ID))
    folder = f"{target}/{BATCH_ID}={batch}"
    if at is None:
        counted.write.options(**PACKED).mode("overwrite").partitionBy(INGESTION_DATE).parquet(folder)
    else:
        day = df.sparkSession.sql("SELECT 1").select(F.to_date(moment(at)).cast("string")).first()[0]
        remove(df.sparkSession, folder)  # an earlier attempt may be of another day
        counted.drop(INGESTION_DATE).write.options(**PACKED).mode("overwrite").parquet(f"{folder}/{INGESTION_DATE}={day}")
    return seen.get.get("rows") or 0


def write_typed(df: DataFrame, target: str, batch: str, spec: Entity, types: str | None, at: dt.datetime | None = None) -> int:
    """``write_batch``; with ``types`` what undeclared columns hold is noted there, seen in the same pass."""
    extra = [c for c in df.columns if c not in spec.columns and c not in LINEAGE]
    if types is None or not extra:
        return write_batch(df, target, batch, at)
    df, watch = inference.watching(df, extra)
    written = write_batch(df, target, batch, at)
    inference.note(df.sparkSession, types, inference.watched(watch, extra), batch)
    return written


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream keeps in its checkpoint; a new checkpoint means a new id."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def ingest(
    spark: SparkSession,
    path: str,
    spec: Entity,
    target: str,
    checkpoint: str,
    load_id: str,
    clock: Clock,
    fmt: str = "csv",
    files_per_trigger: int = FILES_PER_TRIGGER,
    continuous: bool = False,
    bad_target: str | None = None,
    counts: dict[str, int] | None = None,
    note: Callable[[DataFrame], None] | None = None,
    types: str | None = None,
    **options: object,
) -> StreamingQuery:
    """Start appending new landing files to a bronze table.

    The stream hands over file names; each batch is scanned like any other files, with ``options`` of
    ``landing.scan``, so headers may differ, arrays of JSON are read and new columns evolve.  Batch names hold the
    stream's id from its checkpoint and a number, so a batch that is replayed after a failure overwrites what
    it wrote before, and a stream with a new checkpoint, or another stream into the same table,
    never does.  With ``bad_target`` rows that do not fit the schema go there instead.  ``counts`` gets the rows
    ``read`` and ``inserted`` added; ``note`` is called with each batch before it is written.  ``types`` is where
    the types of undeclared columns are kept (see ``inference``).
    """

    def handle(batch: DataFrame, number: int) -> None:
        files = [r["path"] for r in batch.collect()]  # at most files_per_trigger names
        if not files:
            return
        name = batch_id(f"{spec.name}_{stream_id(spark, checkpoint)[:8]}", number)
        at = clock()
        stamped = add_lineage(scan(spark, files, spec, fmt, **options), load_id, name, at)
        bad_rows = 0
        if note is not None:
            note(stamped)
        if bad_target is None:
            written = write_typed(stamped, target, name, spec, types, at)
        else:
            good, bad = split_bad_records(stamped)
            written = write_typed(good, target, name, spec, types, at)
            counted, seen = counting(bad)
            counted.write.options(**PACKED).mode("overwrite").parquet(f"{bad_target}/{BATCH_ID}={name}")
            bad_rows = seen.get.get("rows") or 0
        if counts is not None:
            counts["read"] = counts.get("read", 0) + written + bad_rows
            counts["inserted"] = counts.get("inserted", 0) + written

    stream = stream_file_names(spark, path, files_per_trigger)
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if continuous:
        return writer.trigger(processingTime=TRIGGER_INTERVAL).start()
    return writer.trigger(availableNow=True).start()
