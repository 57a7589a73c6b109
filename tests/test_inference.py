"""Types of undeclared columns: kinds of texts, the lattice, and widening over loads."""

from __future__ import annotations

import datetime as dt
import itertools
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lamina.contracts import ENTITIES
from lamina.plans import jobs
from lamina.sources import inference
from lamina.sources.inference import KINDS, Seen
from lamina.streaming.files import stream_landing

AT = dt.datetime(2025, 6, 30)
TEXTS = {
    "0": "int", "-12": "int", "+7": "int", " 5 ": "int", "2147483648": "bigint", "-9223372036854775808": "bigint", "9223372036854775808": "decimal",
    "1.50": "decimal", "-0.001": "decimal", "1" * 39: "double", "1e5": "double", ".5": "double", "1.": "double", "007": "string", "00.5": "string",
    "TRUE": "boolean", "2024-02-29": "date", "2023-02-29": "string", "2024-01-02 03:04:05": "timestamp", "2024-01-02T03:04": "timestamp", "x": "string", "1,5": "string", "NaN": "string",
}


def test_kinds_of_texts(spark):
    rows = spark.createDataFrame([(t,) for t in [*TEXTS, "", "  ", None]], "t string").select("t", inference.kind_bit(F.col("t")).alias("k")).collect()
    assert {r["t"]: KINDS[r["k"].bit_length() - 1] for r in rows if r["k"]} == TEXTS
    assert sum(r["k"] is None for r in rows) == 3


def test_lattice():
    of = lambda *kinds, whole=3, scale=2: Seen(frozenset(kinds), whole, scale)
    assert of().type == "string" and of("int").type == "int" and of("int", "bigint").type == "bigint"
    assert of("int", "decimal", whole=10).type == "decimal(12,2)" and of("decimal", whole=38).type == "double" and of("decimal", "double").type == "double"
    assert of("date").type == "date" and of("date", "timestamp").type == "timestamp" and of("boolean").type == "boolean"
    assert {of(*pair).type for pair in (("boolean", "int"), ("date", "int"), ("string", "double"), ("boolean", "date"))} == {"string"}
    some = [of("int", whole=1), of("decimal", whole=9, scale=4), of("date"), of()]
    for a, b, c in itertools.product(some, repeat=3):
        assert (a | b) | c == a | (b | c) and a | b == b | a and a | a == a and (a | b) | b == a | b


def test_observed_and_watched_agree(spark, folder):
    df = spark.createDataFrame([("1", None, "x"), ("22.75", " ", "2024-01-01"), ("-3", "", None)], "n string, `b.c` string, m string")
    columns = ["n", "b.c", "m"]
    seen = inference.observed(df, columns)
    assert [seen[c].type for c in columns] == ["decimal(4,2)", "string", "string"] and not seen["b.c"].kinds
    out, watch = inference.watching(df, columns)
    out.write.parquet(f"{folder}/t")
    assert inference.watched(watch, columns) == seen
    assert inference.observed(df, []) == {}


def load(folder, name, *lines):
    path = Path(folder) / "landing" / "doctors" / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")


@pytest.mark.parametrize("incremental", [True, False])
def test_bronze_column_that_widens_from_load_to_load(spark, folder, incremental):
    lake = jobs.Lake(folder)
    loads = [("5", "int"), ("3000000000", "bigint"), ("1.25", "decimal(12,2)"), ("", "decimal(12,2)"), ("soon", "string")]
    for k, (value, kind) in enumerate(loads):
        load(folder, f"{k}.csv", "DoctorID,DoctorName,Extra", f"D{k},Ann,{value}")
        run = jobs.Run(f"run{k}", AT)
        assert jobs.bronze_job(spark, lake, run, entities=["doctors"], incremental=incremental) == {"doctors": "SUCCESS"}
        assert dict(jobs.read_bronze(spark, lake, "doctors").dtypes)["Extra"] == kind
        if k == 2:
            values = {r["Extra"] for r in jobs.read_bronze(spark, lake, "doctors").collect()}
            assert values == {Decimal("5.00"), Decimal("3000000000.00"), Decimal("1.25")}
    values = {r["Extra"] for r in jobs.read_bronze(spark, lake, "doctors").collect()}
    assert values == {"5", "3000000000", "1.25", None, "soon"}
    history = inference.type_history(spark, lake.path("ops/bronze_types", "doctors")).collect()
    assert [(r["version"], r["type"]) for r in history] == [(1, "int"), (2, "bigint"), (3, "decimal(12,2)"), (4, "string")]


def test_noting_a_load_again_changes_nothing(spark, folder):
    place = f"{folder}/types"
    assert inference.noted(spark, place) == (0, {})
    first = inference.note(spark, place, {"a": Seen(frozenset({"int"}), 2, 0)}, "one")
    assert inference.note(spark, place, {"a": Seen(frozenset({"int"}), 1, 0)}, "two") == first
    assert inference.noted(spark, place)[0] == 1
    wider = inference.note(spark, place, {"b": Seen(frozenset({"date"}))}, "three")
    assert list(wider) == ["a", "b"] and inference.noted(spark, place) == (2, wider)


def test_stream_reads_noted_types(spark, folder):
    load(folder, "0.csv", "DoctorID,Extra", "D1,7")
    place = f"{folder}/types"
    inference.note(spark, place, {"Extra": Seen(frozenset({"int"}), 1, 0)}, "x")
    stream = stream_landing(spark, f"{folder}/landing/doctors", ENTITIES["doctors"], types=place)
    assert dict(stream.dtypes)["Extra"] == "int"
