"""Aggregate and ratio expressions shared by the marts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY_SUM = "decimal(22,2)"
MONEY_MEAN = "decimal(16,6)"


def rows_where(condition: Column) -> Column:
    """Rows meeting a condition; zero, not null, for a group with none."""
    return F.count_if(condition)


def amount_where(condition: Column, amount: Column) -> Column:
    return F.sum(F.when(condition, amount).otherwise(F.lit(0)))


def percent(part: Column, whole: Column) -> Column:
    """``part / whole`` as a percentage with two decimals; null for a zero whole."""
    return F.round(part / F.nullif(whole, F.lit(0)) * 100, 2)


def mean_amount(total: Column, n: Column) -> Column:
    """Mean of money from its sum and count, typed as ``avg`` would type it."""
    return F.round((total / F.nullif(n, F.lit(0))).cast(MONEY_MEAN), 2)


def money(total: Column) -> Column:
    """Bring a sum of sums back to the type of a single sum."""
    return total.cast(MONEY_SUM)
