"""Compact a table and cluster it so that files cover narrow ranges of columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Bytes of rows, written out as JSON, that go to one file, about; as parquet they are a few times smaller.
FILE_BYTES = 512 * 1024 * 1024
#: Rows that the borders of ranges are taken from; borders only decide where rows are placed.
SAMPLE_ROWS = 20_000


def measured(df: DataFrame) -> tuple[int, int]:
    """Rows, and their size as JSON: text is measured and other values are taken at twelve bytes."""
    widths = [F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0)) if kind == "string" else F.lit(12) for name, kind in df.dtypes]
    names = sum(len(c) + 6 for c in df.columns)
    rows, size = df.agg(F.count("*"), F.sum(reduce(Column.__add__, widths, F.lit(names)).cast("long"))).first()
    return rows, size or 0


def range_splits(df: DataFrame, columns: Sequence[str], buckets: int, rows: int | None = None) -> list[list[object]]:
    """For each column, lower bounds of ``buckets`` ranges holding about equally many of its distinct values.

    One pass over these columns draws about ``SAMPLE_ROWS`` rows, whatever their types and number; its values give all bounds.
    """
    rows = df.count() if rows is None else rows
    picked = df.select(*[F.col(f"`{c}`") for c in columns])
    drawn = (picked.sample(SAMPLE_ROWS / rows, 17) if rows > SAMPLE_ROWS else picked).collect()
    out = []
    for i in range(len(columns)):
        values = sorted({row[i] for row in drawn if row[i] is not None})
        steps = [values[len(values) * k // buckets] for k in range(1, buckets)] if values else []
        out.append(sorted({v for v in steps if v != values[0]}))
    return out


def files_for(df: DataFrame, file_bytes: int = FILE_BYTES) -> int:
    """How many files the rows fill."""
    return _files(measured(df)[1], file_bytes)


def _files(size: int, file_bytes: int) -> int:
    return max(1, -(-size // file_bytes))


def _bucket(column: Column, splits: Sequence[object]) -> Column:
    above = [(column >= F.lit(s)).cast("int") for s in splits]
    return F.coalesce(reduce(Column.__add__, above, F.lit(0)), F.lit(0))


def z_value(columns: Sequence[str], splits: Sequence[Sequence[object]], bits: int) -> Column:
    """Interleave the bits of each column's range bucket, first column leading."""
    buckets = [_bucket(F.col(c), s) for c, s in zip(columns, splits, strict=True)]
    value = F.lit(0)
    for bit in range(bits - 1, -1, -1):
        for bucket in buckets:
            value = F.shiftleft(value, 1).bitwiseOR(F.shiftright(bucket, bit).bitwiseAND(F.lit(1)))
    return value


def cluster(
    df: DataFrame,
    columns: Sequence[str],
    files: int | None = None,
    bits: int = 4,
    file_bytes: int = FILE_BYTES,
    derived: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Rows arranged along a space-filling curve over ``columns``, in ``files`` ranges.

    By default the number of ranges follows from the size of the table.

    Reads the table twice before it is rewritten (its size, and a sample of the columns), so pass a stored
    table.  The columns themselves and a row hash follow the curve value in the range
    key, so a value shared by many rows is still divided over files.  ``derived`` are columns that follow from
    others, and how: they are not moved with the rows but made anew.
    """
    if derived:
        placed = cluster(df.drop(*derived), columns, files, bits, file_bytes)
        return placed.withColumns(dict(derived)).select(*[F.col(f"`{c}`") for c in df.columns])
    present = [c for c in columns if c in df.columns]
    if not present:
        raise ValueError("no clustering column is in the table")
    rows, size = measured(df)
    splits = range_splits(df, present, 2**bits, rows)
    digest = F.xxhash64(*df.columns)
    # A hash hardly packs, so it is found on both sides of the exchange instead of being moved with each row.
    placed = df.withColumn("_z", z_value(present, splits, bits)).repartitionByRange(files or _files(size, file_bytes), "_z", *present, digest)
    return placed.withColumn("_h", digest).sortWithinPartitions("_z", *present, "_h").drop("_z", "_h")
