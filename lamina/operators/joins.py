"""Join with a broadcast side, but only one whose size has been checked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 200_000
MAX_BYTES = 64 * 1024 * 1024


def fits_broadcast(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> bool:
    """Whether the whole frame is within both bounds.

    Reads at most ``max_rows + 1`` rows, and measures them as JSON text, which is
    wider than the rows Spark would send.
    """
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    seen = df.limit(max_rows + 1).select(F.octet_length(text).alias("b")).agg(F.count("*"), F.sum("b")).first()
    return seen[0] <= max_rows and (seen[1] or 0) <= max_bytes


def broadcast_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    max_rows: int = MAX_ROWS,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """Join with ``right`` sent to every executor if it fits, else an ordinary join."""
    side = F.broadcast(right) if fits_broadcast(right, max_rows, max_bytes) else right
    return left.join(side, on if isinstance(on, str) else list(on), how)
