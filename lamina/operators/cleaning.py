"""Standardise, type, filter and deduplicate an entity.

One projection does all column work, one filter applies the validity rules, and
one ranked window removes duplicates.  Spark pushes the ``rank = 1`` filter below
the exchange (a per-task group limit), so a key that owns a large share of the
rows shrinks to one row per task before any data moves.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.contracts import BATCH_ID, INGESTION_TIME, LINEAGE, Entity, entity
from lamina.functions.text import email_canonical, fit_domain, outside_range, phone_digits


def trim_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.trim(c) for c in columns if c in df.columns})


def cast_or_null(column: Column, have: str, want: str) -> Column:
    """Cast where an unreadable value becomes null instead of failing the query.

    A fractional text such as ``"12.7"`` still becomes the integer 12.
    """
    if have == want:
        return column
    if want == "int" and have == "string":
        return F.coalesce(column.try_cast("int"), column.try_cast("decimal(30,10)").try_cast("int"))
    return column.try_cast(want)


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    have = dict(df.dtypes)
    return df.withColumns({c: cast_or_null(F.col(c), have[c], want) for c, want in types.items() if c in have})


def drop_lineage(df: DataFrame) -> DataFrame:
    return df.drop(*LINEAGE)


def fill_nulls(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.fillna(dict(values))


def keep_latest(df: DataFrame, keys: Sequence[str], latest_by: str | Sequence[str] | None = None) -> DataFrame:
    """One row per key: the newest by ``latest_by``, or the smallest if not given.

    Several columns count one after the other.  Ties are settled by the remaining columns in order, bookkeeping
    left out, so the survivor depends only on the data and reruns agree.
    """
    newest = [latest_by] if isinstance(latest_by, str) else list(latest_by or ())
    rest = [c for c in df.columns if c not in keys and c not in newest and c not in LINEAGE]
    order = [F.col(f"`{c}`").desc_nulls_last() for c in newest]
    order += [F.col(f"`{c}`").asc_nulls_first() for c in rest]
    if not order:
        return df.dropDuplicates(list(keys))
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def one_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return keep_latest(df, keys)


def _standard_column(spec: Entity, name: str, have: str) -> Column:
    column = F.col(name)
    want = spec.columns[name]
    if want == "string":
        column = F.trim(column)
    if name in spec.emails:
        column = email_canonical(column)
    if name in spec.phones:
        column = phone_digits(column)
    if name in spec.domains:
        column = fit_domain(column, spec.domains[name])
    if want != "string":
        column = cast_or_null(column, have, want)
    if name in spec.floors:
        column = F.when(column < spec.floors[name], F.lit(spec.floors[name])).otherwise(column)
    return column.alias(name)


def valid_rows(spec: Entity) -> Column:
    """Rows worth keeping: key present, amounts in bounds (a null amount is out)."""
    checks = [F.col(spec.key).isNotNull()]
    if spec.reject_blank_key:
        checks.append(F.col(spec.key) != "")
    checks += [F.col(c) >= bound for c, bound in spec.at_least.items()]
    checks += [F.col(c) > bound for c, bound in spec.above.items()]
    return reduce(Column.__and__, checks)


def derived_columns(spec: Entity) -> dict[str, Column]:
    if spec.name == "pharmacy_orders":
        return {"LineAmount": F.col("Quantity") * F.col("Price")}
    if spec.name == "laboratory_results":
        return {"IsAbnormal": outside_range(F.col("Result"), F.col("NormalRange"))}
    return {}


def standardise(df: DataFrame, spec: Entity) -> DataFrame:
    """Column work only: trim, normalise, fit value sets, type, clamp."""
    have = dict(df.dtypes)
    return df.select(
        *[_standard_column(spec, c, have[c]) if c in spec.columns else F.col(f"`{c}`") for c in df.columns]
    )


def newest_first(spec: Entity, columns: Sequence[str]) -> list[str]:
    """What makes one row of a key newer than another, most telling first.

    A modification time says it itself.  Else the row that arrived later is newer, where arrival is
    known; an event time such as that of a visit, which a correction may move either way, only decides
    within one arrival.
    """
    arrival = [c for c in (INGESTION_TIME, BATCH_ID) if c in columns]
    order = [spec.modified_by, *arrival, spec.latest_by]
    return list(dict.fromkeys(c for c in order if c))


def clean(name: str, df: DataFrame, keep_lineage: bool = False) -> DataFrame:
    """Silver form of one entity; raises ``ValueError`` for an unknown entity.

    Lineage columns, where present, decide which row of a key is the newest before they are dropped.
    """
    spec = entity(name)
    rows = standardise(df, spec).where(valid_rows(spec))
    rows = keep_latest(rows, [spec.key], newest_first(spec, df.columns))
    rows = rows if keep_lineage else drop_lineage(rows)
    return rows.withColumns(derived_columns(spec)) if derived_columns(spec) else rows
