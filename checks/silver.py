"""Cleaned entities built lazily from the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamina.operators.cleaning import clean
from lamina.session import work_dir
from lamina.sources.startables import read_entity


def silver(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return clean(name, read_entity(spark, sf_dir, name))


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """A frame written to the shared work folder and read back, for plans that read it often."""
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


class SilverTables(dict):
    """Cleaned entities by name, each stored the first time it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        self[name] = stored(silver(self.spark, self.sf_dir, name), name)
        return self[name]
