"""Bronze lineage columns: where a row came from, when, and its hash."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.contracts import (
    BATCH_ID,
    INGESTION_DATE,
    INGESTION_TIME,
    LOAD_ID,
    RECORD_HASH,
    RESCUED,
    SOURCE_FILE,
)
from lamina.functions.text import record_hash
from lamina.functions.times import moment

REQUIRED = (INGESTION_TIME, SOURCE_FILE, LOAD_ID, BATCH_ID, RECORD_HASH)


def batch_id(stem: str, number: int | None = None) -> str:
    return f"BATCH_{stem}" if number is None else f"BATCH_{stem}_{number}"


def hashed_columns(df: DataFrame, chosen: Sequence[str] | None = None) -> list[str]:
    """The chosen columns, or every column that is not bookkeeping."""
    return list(chosen) if chosen else [c for c in df.columns if not c.startswith("_")]


def add_lineage(
    df: DataFrame,
    load_id: str,
    batch: str,
    at: dt.datetime | dt.date,
    hash_columns: Sequence[str] | None = None,
    length_prefixed: bool = False,
) -> DataFrame:
    """Add the lineage columns.  Scans put the true file name in ``_source_file``."""
    columns = hashed_columns(df, hash_columns)
    source = F.col(SOURCE_FILE) if SOURCE_FILE in df.columns else F.lit("unknown")
    rescued = F.col(RESCUED) if RESCUED in df.columns else F.lit(None).cast("string")
    digest = record_hash(columns, length_prefixed) if columns else F.lit(None).cast("string")
    stamped = df.withColumns(
        {
            INGESTION_TIME: moment(at),
            SOURCE_FILE: source,
            LOAD_ID: F.lit(load_id),
            BATCH_ID: F.lit(batch),
            RECORD_HASH: digest,
            RESCUED: rescued,
        }
    )
    return with_ingestion_date(stamped)


def with_ingestion_date(df: DataFrame, moment: str = INGESTION_TIME) -> DataFrame:
    return df.withColumn(INGESTION_DATE, F.to_date(moment))


def lacks_lineage() -> Column:
    """True for a row that lacks a lineage value."""
    return reduce(Column.__or__, [F.col(name).isNull() for name in REQUIRED])


def lineage_report(bronze: DataFrame) -> DataFrame:
    """Per load: rows, rows lacking a lineage value, distinct and repeated hashes.

    Rows are first counted per (load, hash), so a load with many copies of one
    row moves a single count for it.
    """
    per_hash = bronze.groupBy(LOAD_ID, RECORD_HASH).agg(F.count("*").alias("_n"), F.count_if(lacks_lineage()).alias("_absent"))
    return per_hash.groupBy(LOAD_ID).agg(
        F.sum("_n").alias("Rows"),
        F.sum("_absent").alias("RowsMissingLineage"),
        F.count(RECORD_HASH).alias("DistinctHashes"),
        F.sum(F.when(F.col(RECORD_HASH).isNotNull(), F.col("_n") - 1).otherwise(0)).alias("RepeatedRows"),
    )
