"""Quantiles from sketches that are kept per group, such as a day, and merged for any span of groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items a sketch keeps per level: a few tens of KB each, whatever it has seen.
SKETCH_ITEMS = 4096


def rank_error(k: int = SKETCH_ITEMS) -> float:
    """How far the rank of a quantile may be off, as a share of all rows, 99 times in 100.

    Fixed values: constants of the published error fit of this kind of sketch.
    """
    return 2.296 / k**0.9723


def quantile_sketches(df: DataFrame, by: Sequence[str], column: str, k: int = SKETCH_ITEMS) -> DataFrame:
    """One row per group: the columns ``by``, ``Sketch`` and ``Rows``.  Null values are not counted.

    Combined on the map side, so a group that holds a third of the rows sends one sketch per task.
    """
    value = F.col(column).cast("double")
    return df.where(value.isNotNull()).groupBy(*by).agg(F.kll_sketch_agg_double(value, F.lit(k)).alias("Sketch"), F.count("*").alias("Rows"))


def merged_quantiles(sketches: DataFrame, ranks: Sequence[float], by: Sequence[str] = (), k: int = SKETCH_ITEMS) -> DataFrame:
    """Rows (by, Rows, Quantiles) over stored sketches: an array with a value per rank."""
    wanted = F.array(*[F.lit(float(r)) for r in ranks])
    met = sketches.groupBy(*by).agg(F.kll_merge_agg_double("Sketch", F.lit(k)).alias("Sketch"), F.sum("Rows").alias("Rows"))
    return met.select(*by, "Rows", F.kll_sketch_get_quantile_double("Sketch", wanted).alias("Quantiles"))


def rank_span(column: str, value: Column) -> tuple[Column, Column]:
    """Shares of the rows below a value and up to it, as aggregates; the rank of the value lies between them."""
    number = F.col(column).cast("double")
    rows = F.count(number)
    return F.count_if(number < value) / rows, F.count_if(number <= value) / rows
