"""Scan CSV and JSON landing files under a declared schema.

A declared schema spares the inference pass and makes rescue work: a row that
does not fit keeps its text in ``_rescued_data`` and whatever could be read.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import Literal
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.contracts import RESCUED, SOURCE_FILE, Entity
from lamina.session import first_line

# Fixed value: how many files are opened for their header side by side.
HEADERS_AT_ONCE = 8

Evolution = Literal["addNewColumns", "failOnNewColumns", "rescue", "none"]


class NewColumnsFound(ValueError):
    """Raised by ``failOnNewColumns`` when a file brings columns not declared."""


def csv_options() -> dict[str, str]:
    """Padding is kept; the cleaners trim it."""
    return {
        "header": "true",
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": RESCUED,
        "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false",
        "timestampFormat": "yyyy-MM-dd HH:mm:ss",
        "dateFormat": "yyyy-MM-dd",
    }


def json_options() -> dict[str, str]:
    return {
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": RESCUED,
        "timestampFormat": "yyyy-MM-dd HH:mm:ss",
        "dateFormat": "yyyy-MM-dd",
    }


def located(df: DataFrame) -> DataFrame:
    """Add the file name, and make rescue independent of what is read from the scan.

    Spark parses only the columns a query needs, so a bad value in another column
    would go unnoticed.  Tying the rescue column to all of them keeps them in the
    scan whenever rescue is looked at, and only then.
    """
    values = [c for c in df.columns if c != RESCUED]
    nulls = reduce(Column.__add__, [F.col(f"`{c}`").isNull().cast("int") for c in values])
    return df.withColumns(
        {RESCUED: F.when(nulls >= 0, F.col(RESCUED)), SOURCE_FILE: F.col("_metadata.file_path")}
    )


def _complete(df: DataFrame, spec: Entity) -> DataFrame:
    """Declared columns a file lacks become nulls."""
    absent = {c: F.lit(None).cast(kind) for c, kind in spec.columns.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df


def evolve(df: DataFrame, known: dict[str, str], mode: Evolution = "addNewColumns") -> DataFrame:
    """Treat columns outside ``known`` by mode: keep, refuse, fold into rescue, or drop."""
    extra = [c for c in df.columns if c not in known and not c.startswith("_")]
    absent = {c: F.lit(None).cast(kind) for c, kind in known.items() if c not in df.columns}
    df = df.withColumns(absent) if absent else df
    if not extra or mode == "addNewColumns":
        return df
    if mode == "failOnNewColumns":
        raise NewColumnsFound(f"columns not declared: {', '.join(extra)}")
    if mode == "rescue":
        # The JSON of null fields only is an empty object, which is no rescue.
        folded = F.nullif(F.to_json(F.struct(*extra)), F.lit("{}"))
        kept = F.coalesce(F.col(RESCUED), folded) if RESCUED in df.columns else folded
        df = df.withColumn(RESCUED, kept)
    return df.drop(*extra)


def csv_headers(spark: SparkSession, path: str | list[str]) -> dict[tuple[str, ...], list[str]]:
    """The files of each header.

    A file's header is its first line.  Only the head of each file is read, some files at a time, so the rows of the
    folder are read once, by the scan itself.  One line per file reaches the driver.
    """
    files = [unquote(f) for f in sorted(spark.read.text(path).inputFiles())]
    found: dict[tuple[str, ...], list[str]] = {}
    with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:
        for file, line in zip(files, pool.map(lambda f: first_line(spark, f), files), strict=True):
            if line is not None:
                header = tuple(next(csv.reader([line.lstrip("\ufeff")]), []))
                found.setdefault(header, []).append(file)
    return found


def _csv_of(spark: SparkSession, path: str | list[str], header: Sequence[str], spec: Entity) -> DataFrame:
    declared = ", ".join(f"`{c}` {spec.columns.get(c, 'string')}" for c in header)
    raw = spark.read.options(**csv_options()).option("enforceSchema", "false").schema(f"{declared}, `{RESCUED}` string").csv(path)
    return _complete(located(raw), spec)


def scan_csv(spark: SparkSession, path: str | list[str], spec: Entity, evolution: Evolution = "addNewColumns") -> DataFrame:
    """Read CSV files; columns are matched by name, file by file, whatever their order.

    Files are read together by header, so a folder of one header is one scan.  Columns that only some files
    have are null in the others.
    """
    headers = csv_headers(spark, path)
    if not headers:
        headers = {tuple(spec.columns): []}
    if len(headers) == 1:
        rows = _csv_of(spark, path, next(iter(headers)), spec)
    else:
        parts = [_csv_of(spark, files, header, spec) for header, files in headers.items()]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return evolve(rows, spec.columns, evolution)


#: Ends of a first line after which a JSON value goes on in the next one.
_GOES_ON = ("{", "[", ",", ":")


def _bare(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, "[\ufeff\r]", ""))


def _spans_lines(line: Column) -> Column:
    """Whether the value that a file's first line, made ``_bare``, begins goes on in the lines after it.

    A broken first line is taken for a record of its own, unless it begins an array or ends as only an unfinished object does.
    """
    unfinished = reduce(Column.__or__, [line.endswith(c) for c in _GOES_ON])
    return (line.startswith("[") | (line.startswith("{") & unfinished)) & F.try_parse_json(line).isNull()


def json_forms(spark: SparkSession, path: str | list[str]) -> dict[bool, list[str]]:
    """The files whose values span lines (True), and those with a value a line.

    Told by the first line of a file that is not blank, which one task sees first.  Blank files are in neither
    list.  Lines are told before they are grouped, so only flags move: a line may be a whole array, but most are
    seen by how they begin and end.  One flag per file reaches the driver, which lists the files for any scan anyway.
    """
    lines = spark.read.text(path).where("_metadata.file_block_start = 0 AND trim(value) <> ''")
    # A select of its own, so that long lines are made bare once.
    bare = lines.select(F.col("_metadata.file_path").alias("file"), _bare(F.col("value")).alias("line"))
    first = bare.groupBy("file").agg(F.first(_spans_lines(F.col("line"))).alias("spans"))
    found: dict[bool, list[str]] = {}
    for row in first.orderBy("file").collect():
        found.setdefault(row["spans"], []).append(unquote(row["file"]))
    return found


def records(files: DataFrame) -> DataFrame:
    """The lines of whole files (value, file) that have a value a line, and other files as they are."""
    first = F.regexp_extract("value", r"[^\r\n]*\S[^\r\n]*", 0)
    parts = F.when(_spans_lines(_bare(first)), F.array("value")).otherwise(F.split("value", r"\r?\n"))
    return files.select(F.explode(parts).alias("value"), "file")


def json_elements(texts: DataFrame) -> DataFrame:
    """(value, whole, file) with a row per JSON element of ``texts`` (value, file): objects, and the elements of arrays.

    A text may hold several values one after another.  ``whole`` is false where it is no JSON, or has something else after a
    value; such a text is one row.
    """
    text = F.trim(F.regexp_replace("value", "^[\ufeff\\s]+|\\s+$", ""))
    texts = texts.select(text.alias("value"), "file").where("value <> ''")
    # The usual text is one object, and typing it is parse enough.
    plain = F.col("value").startswith("{") & F.col("value").endswith("}") & ~F.col("value").rlike(r"\}\s*[{\[]")
    joined = F.regexp_replace("value", r"(?m)^(.*[}\]])\s*^(?=[{\[])", "$1,")
    listed = F.from_json(F.concat(F.lit("["), joined, F.lit("]")), "array<string>", {"mode": "PERMISSIVE"})
    values = F.when(plain, F.array("value")).otherwise(listed)
    found = texts.select(F.coalesce(values, F.array("value")).alias("values"), values.isNotNull().alias("whole"), "file")
    found = found.select(F.explode("values").alias("value"), "whole", "file")
    inner = F.from_json("value", "array<string>", {"mode": "PERMISSIVE"})
    elements = F.when(F.col("whole") & F.col("value").startswith("["), inner).otherwise(F.array("value"))
    return found.select(F.explode(elements).alias("value"), "whole", "file").withColumn("value", F.coalesce("value", F.lit("null")))


def typed_json(elements: DataFrame, declared: str) -> DataFrame:
    """Each element read under the declared columns; one that does not fit keeps its own text in the rescue column."""
    row = F.from_json("value", f"{declared}, `{RESCUED}` string", json_options())
    rows = elements.select(row.alias("row"), "value", "whole", F.col("file").alias(SOURCE_FILE)).select("row.*", "value", "whole", SOURCE_FILE)
    rescued = F.coalesce(F.col(RESCUED), F.when(~F.col("whole"), F.col("value")))
    return rows.withColumn(RESCUED, rescued).drop("value", "whole")


def json_texts(spark: SparkSession, path: str | list[str], multi_line: bool | None = None) -> DataFrame:
    """(value, file): the lines of files with a value a line, and other files whole.

    ``multi_line`` says the form of all files; else it is found file by file.  Lines are divided among tasks, a whole file is
    one row (2 GB at most), so prefer lines for large files.
    """
    forms = {multi_line: None} if multi_line is not None else json_forms(spark, path)
    parts = [spark.read.text(path if files is None or len(forms) == 1 else files, wholetext=spans) for spans, files in forms.items()]
    parts = parts or [spark.read.text(path)]
    return reduce(DataFrame.unionByName, [p.select("value", F.col("_metadata.file_path").alias("file")) for p in parts])


def scan_json(
    spark: SparkSession,
    path: str | list[str],
    spec: Entity,
    evolution: Evolution = "none",
    multi_line: bool | None = None,
) -> DataFrame:
    """Read JSON files: objects a line, arrays, or objects over several lines, whichever each file has.

    Elements of an array are typed one by one: a bad one is rescued with its own text and the others stay.  Any mode
    but ``none`` reads the files once more to find new fields.
    """
    elements = json_elements(json_texts(spark, path, multi_line))
    extra: list[str] = []
    if evolution != "none":
        names = elements.where("whole").select(F.explode(F.json_object_keys("value")).alias("name")).distinct().orderBy("name")
        extra = [r["name"] for r in names.collect() if r["name"] not in spec.columns and r["name"] != RESCUED]
    declared = ", ".join([spec.ddl(), *[f"`{c}` string" for c in extra]])
    return evolve(typed_json(elements, declared), spec.columns, evolution)


def scan(spark: SparkSession, path: str | list[str], spec: Entity, fmt: str, **options: object) -> DataFrame:
    readers = {"csv": scan_csv, "json": scan_json}
    if fmt not in readers:
        raise ValueError(f"unsupported landing format {fmt!r}")
    return readers[fmt](spark, path, spec, **options)


def rescued_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col(RESCUED).isNotNull())


def split_bad_records(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that fit the schema, and the text of those that do not with its file."""
    good = df.where(F.col(RESCUED).isNull())
    return good, rescued_rows(df).select(SOURCE_FILE, RESCUED)
