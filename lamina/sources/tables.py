"""Write, read and register stored tables, and put failing rows aside as JSON."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.times import moment
from lamina.session import path_exists


def write_table(
    df: DataFrame, path: str, mode: str = "append", partition_by: Sequence[str] = (), rebalance: bool = False
) -> None:
    """Write parquet; ``rebalance`` lets Spark even out file sizes, hot partitions included."""
    if rebalance:
        df = df.hint("rebalance", *partition_by) if partition_by else df.hint("rebalance")
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_table(spark: SparkSession, path: str, merge_schema: bool = False) -> DataFrame:
    """Read parquet; with ``merge_schema`` columns added by later writes appear, null before."""
    return spark.read.option("mergeSchema", str(merge_schema).lower()).parquet(path)


def _catalogue(spark: SparkSession, database: str, name: str, path: str) -> None:
    """Make the external table ``database.name`` show what is stored at ``path`` now.

    An entry that points elsewhere or has another schema is dropped, which leaves its files alone, and made
    anew.  A table whose files the catalog owns is refused.
    """
    full = f"`{database}`.`{name}`"
    stored = spark.read.parquet(path)
    if spark.catalog.tableExists(f"{database}.{name}"):
        facts = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {full}").collect()}
        if facts.get("Type", "").upper() != "EXTERNAL":
            raise ValueError(f"{database}.{name} is not an external table")
        same = facts.get("Location", "").rstrip("/").endswith(path.rstrip("/").split(":", 1)[-1])
        if not same or sorted(stored.dtypes) != sorted(spark.table(full).dtypes):
            spark.sql(f"DROP TABLE {full}")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {full} USING parquet LOCATION '{path}'")
    if any(k.isPartition for k in spark.catalog.listColumns(f"{database}.{name}")):
        spark.sql(f"MSCK REPAIR TABLE {full}")
    spark.catalog.refreshTable(f"{database}.{name}")


def register_layer(spark: SparkSession, tables: Mapping[str, str], database: str | None = None) -> dict[str, str]:
    """Make stored tables readable by name and report each as SUCCESS, SKIPPED or FAILED.

    With a database they become external tables of the catalog, else temporary views.  Registering again after
    a later run shows its version, columns and partitions.  A table with nothing stored yet is skipped.
    """
    if database:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    report = {}
    for name, path in tables.items():
        if not path_exists(spark, path):
            report[name] = "SKIPPED"
            continue
        try:
            if database:
                _catalogue(spark, database, name, path)
            else:
                spark.read.parquet(path).createOrReplaceTempView(name)
            report[name] = "SUCCESS"
        except Exception as problem:  # reported per table; the others go on
            report[name] = f"FAILED: {str(problem).splitlines()[0]}"
    return report


def json_payload(df: DataFrame, name: str = "payload") -> DataFrame:
    """One JSON text per row, holding all its columns."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias(name))


def dead_letters(
    df: DataFrame, entity: str, run_id: str, error_type: str, message: str, at: dt.datetime
) -> DataFrame:
    """Every failing row as a dead-letter row; its id is a hash of run and payload."""
    return json_payload(df, "Payload").select(
        F.sha2(F.concat_ws("|", F.lit(run_id), F.lit(entity), "Payload"), 256).alias("DLQ_ID"),
        F.lit(entity).alias("Entity"),
        F.lit(run_id).alias("RunID"),
        F.lit(error_type).alias("ErrorType"),
        F.lit(message).alias("ErrorMessage"),
        "Payload",
        moment(at).alias("CreatedAt"),
    )
