"""Age of a person on a given day, and the reporting band it falls in."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper limits (exclusive) and labels of the reporting bands.
BANDS = ((18, "0-17"), (40, "18-39"), (65, "40-64"))
OLDEST_BAND = "65+"


def age_years(dob: Column, as_of: dt.date | Column) -> Column:
    day = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return F.floor(F.months_between(day, dob) / 12).cast("int")


def age_band(age: Column, unknown_label: str | None = None) -> Column:
    """Band label of an age.

    An unknown age falls into the oldest band, as every comparison with null is
    null; pass ``unknown_label`` to report it on its own.
    """
    band = F.when(age.isNull(), F.lit(unknown_label)) if unknown_label else None
    for limit, label in BANDS:
        hit = age < limit
        band = F.when(hit, label) if band is None else band.when(hit, label)
    return band.otherwise(OLDEST_BAND)
