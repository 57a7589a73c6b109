"""Column expressions that standardise text, hash rows and read lab ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina.contracts import HASH_SEPARATOR, NULL_TOKEN, Domain

# What counts as the bounds of a "low - high" range, and which
# characters survive in a phone number.
LOW_BOUND = r"^\s*([0-9.]+)\s*-"
HIGH_BOUND = r"-\s*([0-9.]+)\s*$"
NOT_PHONE = r"[^0-9+]"


def phone_digits(column: Column) -> Column:
    return F.regexp_replace(column, NOT_PHONE, "")


def email_canonical(column: Column) -> Column:
    return F.lower(F.trim(column))


def fit_domain(column: Column, domain: Domain) -> Column:
    """The value if the domain has it, else the domain's default (null included)."""
    value = F.initcap(column) if domain.fold_case else column
    return F.when(value.isin(*domain.values), value).otherwise(F.lit(domain.default))


def record_hash(columns: Sequence[str], length_prefixed: bool = False) -> Column:
    """SHA-256 over the text of the columns, nulls marked by a token.

    Plain joining lets ``("a||b", "c")`` and ``("a", "b||c")`` collide; with
    ``length_prefixed`` every field carries its length, which rules that out.
    """
    fields = []
    for name in columns:
        text = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(NULL_TOKEN))
        if length_prefixed:
            text = F.concat(F.char_length(text).cast("string"), F.lit(":"), text)
        fields.append(text)
    return F.sha2(F.concat_ws(HASH_SEPARATOR, *fields), 256)


def outside_range(result: Column, normal_range: Column) -> Column:
    """True when a numeric result lies outside a readable ``low - high`` range.

    Anything that cannot be read as a number, on either side, counts as normal.
    """
    value = result.try_cast("double")
    low = F.regexp_extract(normal_range, LOW_BOUND, 1).try_cast("double")
    high = F.regexp_extract(normal_range, HIGH_BOUND, 1).try_cast("double")
    readable = value.isNotNull() & low.isNotNull() & high.isNotNull()
    return F.coalesce(readable & ~value.between(low, high), F.lit(False))
