"""Types of columns that no contract declares, found from their text and widened from load to load.

Such columns are stored as the text they came as.  Their type is a note beside the checkpoint that only ever
grows wider, and is applied when they are read: so a column that widens, even to text again, needs no
stored row rewritten and loses nothing, leading zeros included.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lamina.session import path_exists

#: Kinds a text can be of, each a bit, so that what a column holds is one bitwise or of them.
KINDS = ("int", "bigint", "decimal", "double", "boolean", "date", "timestamp", "string")
NUMBERS = frozenset(KINDS[:4])
MAX_DIGITS = 38
TYPE_LOG = "version int, noted_by string, types string"


@dataclass(frozen=True)
class Seen:
    """The kinds a column holds, and of its numbers the most digits before and after the point."""

    kinds: frozenset[str] = frozenset()
    whole: int = 0
    scale: int = 0

    def __or__(self, other: Seen) -> Seen:
        """What holds both: associative, and the same in any order."""
        return Seen(self.kinds | other.kinds, max(self.whole, other.whole), max(self.scale, other.scale))

    @property
    def type(self) -> str:
        """The narrowest type that every value seen fits; text where they have nothing in common."""
        if not self.kinds:
            return "string"
        if self.kinds <= NUMBERS:
            if "double" in self.kinds:
                return "double"
            if "decimal" in self.kinds:
                return f"decimal({self.whole + self.scale},{self.scale})" if self.whole + self.scale <= MAX_DIGITS else "double"
            return "bigint" if "bigint" in self.kinds else "int"
        if self.kinds <= {"date", "timestamp"}:
            return "timestamp" if "timestamp" in self.kinds else "date"
        return next(iter(self.kinds)) if len(self.kinds) == 1 else "string"

    def to_note(self) -> dict:
        return {"kinds": sorted(self.kinds), "whole": self.whole, "scale": self.scale}

    @staticmethod
    def from_note(note: Mapping) -> Seen:
        return Seen(frozenset(note["kinds"]), note["whole"], note["scale"])


def kind_bit(text: Column) -> Column:
    """The bit of the narrowest kind that a text is of; null where it is null or blank."""
    text = F.trim(text)
    bits = {kind: F.lit(1 << i) for i, kind in enumerate(KINDS)}
    digits = F.length(F.regexp_replace(text, "[^0-9]", ""))
    return (
        F.when(text.isNull() | (text == ""), F.lit(None).cast("int"))
        .when(text.rlike(r"^[+-]?(0|[1-9]\d*)$") & text.try_cast("int").isNotNull(), bits["int"])
        .when(text.rlike(r"^[+-]?(0|[1-9]\d*)$") & text.try_cast("bigint").isNotNull(), bits["bigint"])
        .when(text.rlike(r"^[+-]?(0|[1-9]\d*)(\.\d+)?$") & (digits <= MAX_DIGITS), bits["decimal"])
        .when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$") & ~text.rlike(r"^[+-]?0\d"), bits["double"])
        .when(F.lower(text).isin("true", "false"), bits["boolean"])
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & text.try_cast("date").isNotNull(), bits["date"])
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}") & text.try_cast("timestamp").isNotNull(), bits["timestamp"])
        .otherwise(bits["string"])
    )


def _measures(columns: Sequence[str]) -> list[Column]:
    out = []
    for i, name in enumerate(columns):
        text = F.trim(F.col(f"`{name}`"))
        number = text.rlike(r"^[+-]?\d+(\.\d+)?$")
        out.append(F.bit_or(kind_bit(text)).alias(f"k{i}"))
        out.append(F.max(F.when(number, F.length(F.regexp_extract(text, r"^[+-]?(\d+)", 1)))).alias(f"w{i}"))
        out.append(F.max(F.when(number, F.length(F.regexp_extract(text, r"\.(\d+)$", 1)))).alias(f"s{i}"))
    return out


def _seen(values: Mapping, columns: Sequence[str]) -> dict[str, Seen]:
    found = {}
    for i, name in enumerate(columns):
        bits = values.get(f"k{i}") or 0
        found[name] = Seen(frozenset(k for b, k in enumerate(KINDS) if bits >> b & 1), values.get(f"w{i}") or 0, values.get(f"s{i}") or 0)
    return found


def observed(df: DataFrame, columns: Sequence[str]) -> dict[str, Seen]:
    """What the columns hold, from one aggregation combined on the map side."""
    return _seen(df.agg(*_measures(columns)).first().asDict(), columns) if columns else {}


def watching(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, Observation]:
    """The frame, and a measure of what the columns hold that rides along with its write."""
    watch = Observation()
    return df.observe(watch, *_measures(columns)), watch


def watched(watch: Observation, columns: Sequence[str]) -> dict[str, Seen]:
    return _seen(watch.get, columns)


def merged(old: Mapping[str, Seen], new: Mapping[str, Seen]) -> dict[str, Seen]:
    """The old columns first, each as wide as both say."""
    return {name: old.get(name, Seen()) | new.get(name, Seen()) for name in [*old, *[n for n in new if n not in old]]}


def type_log(spark: SparkSession, location: str) -> DataFrame:
    """(version, noted_by, types) of every widening noted at a location."""
    return spark.read.schema(TYPE_LOG).json(location) if path_exists(spark, location) else spark.createDataFrame([], TYPE_LOG)


def noted(spark: SparkSession, location: str) -> tuple[int, dict[str, Seen]]:
    """The newest version of the noted types, 0 and none at first."""
    newest = type_log(spark, location).agg(F.max_by(F.struct("version", "types"), "version").alias("n")).first()["n"]
    if newest is None:
        return 0, {}
    return newest["version"], {name: Seen.from_note(n) for name, n in json.loads(newest["types"]).items()}


def note(spark: SparkSession, location: str, found: Mapping[str, Seen], by: str) -> dict[str, Seen]:
    """Widen the noted types by what a load holds; writes only if something widened.  One writer per location.

    A load that is noted again widens nothing, so replays are harmless.
    """
    version, old = noted(spark, location)
    new = merged(old, found)
    if new != old:
        text = json.dumps({name: seen.to_note() for name, seen in new.items()})
        spark.createDataFrame([(version + 1, by, text)], TYPE_LOG).coalesce(1).write.mode("append").json(location)
    return new


def apply_types(df: DataFrame, types: Mapping[str, Seen]) -> DataFrame:
    """The frame with noted text columns under their types; a blank value becomes null, as it has no kind."""
    have = dict(df.dtypes)
    casts = {}
    for name, seen in types.items():
        if have.get(name) == "string" and seen.type != "string":
            casts[name] = F.trim(F.col(f"`{name}`")).try_cast(seen.type)
    return df.withColumns(casts) if casts else df


def type_history(spark: SparkSession, location: str) -> DataFrame:
    """(version, noted_by, column, type), one row per column and widening."""
    rows = [
        (r["version"], r["noted_by"], name, Seen.from_note(n).type)
        for r in type_log(spark, location).orderBy("version").collect()  # a row per widening
        for name, n in json.loads(r["types"]).items()
    ]
    return spark.createDataFrame(rows, "version int, noted_by string, column string, type string")
