"""Exact quantiles without ever bringing one column into one task.

``percentile`` keeps every distinct value of a group in a single buffer, and an
ordered global window sends all rows to one task.  Here each pass is a plain
histogram with a fixed number of slots, so what leaves the executors is bounded
by ``slots`` whatever the table size, and each pass narrows the interval that
holds the wanted rank by a factor of ``slots``.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exact_median(df: DataFrame, column: str, scale: int = 2, slots: int = 4096) -> Decimal | None:
    """Exact median of a decimal column with ``scale`` digits (mean of the middle two)."""
    unit = 10**scale
    whole = df.select((F.col(column) * unit).cast("decimal(38,0)").cast("bigint").alias("_u")).where("_u IS NOT NULL")
    total, low, high = whole.agg(F.count("*"), F.min("_u"), F.max("_u")).first()
    if not total:
        return None
    lower = upper = _value_at_rank(whole, (total - 1) // 2, low, high, slots)
    if total % 2 == 0:
        upto, following = whole.agg(
            F.count_if(F.col("_u") <= lower), F.min(F.when(F.col("_u") > lower, F.col("_u")))
        ).first()
        upper = lower if upto > total // 2 else following
    return Decimal(lower + upper) / (2 * unit)


def _value_at_rank(whole: DataFrame, rank: int, low: int, high: int, slots: int) -> int:
    """Value with ``rank`` smaller rows before it, by repeated histogram narrowing."""
    while low < high:
        width = max(1, -(-(high - low + 1) // slots))
        slot = F.floor((F.col("_u") - F.lit(low)) / F.lit(width)).cast("int")
        histogram = (
            whole.where(F.col("_u").between(low, high)).groupBy(slot.alias("slot")).count().orderBy("slot").collect()
        )
        for index, count in histogram:
            if rank < count:
                low, high = low + index * width, min(high, low + (index + 1) * width - 1)
                break
            rank -= count
    return low
