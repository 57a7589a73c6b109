"""Moments as Spark values, whatever zone the driver's Python runs in."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def utc(at: dt.datetime | dt.date) -> dt.datetime:
    """The moment with its zone; a time without zone is UTC, a day is its midnight."""
    if not isinstance(at, dt.datetime):
        at = dt.datetime.combine(at, dt.time())
    return at.replace(tzinfo=dt.timezone.utc) if at.tzinfo is None else at


def moment(at: dt.datetime | dt.date | Column) -> Column:
    """A timestamp column of the moment; a column stays as it is."""
    if isinstance(at, Column):
        return at
    return F.timestamp_micros(F.lit((utc(at) - _EPOCH) // dt.timedelta(microseconds=1)))
