"""Named queries over the star-schema tables, each with its DuckDB counterpart."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.oracle_ctes import AS_OF, with_ctes

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

AS_OF_DATE = dt.date.fromisoformat(AS_OF)
AS_OF_TIME = dt.datetime.combine(AS_OF_DATE, dt.time())


def plain(df: DataFrame) -> DataFrame:
    """Types both engines hand over alike: text, BIGINT, DOUBLE and BOOLEAN."""
    out = []
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind.startswith("decimal") or kind == "float":
            column = column.cast("double")
        elif kind in ("int", "smallint", "tinyint"):
            column = column.cast("bigint")
        elif kind == "date":
            column = F.date_format(column, "yyyy-MM-dd")
        elif kind.startswith("timestamp"):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        out.append(column.alias(name))
    return df.select(*out)


def query(name: str, sql: str | None = None, **ctes: str) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may name any entity, cleaned table or mart."""

    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: plain(build(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = with_ctes(sql, **ctes)
        return build

    return register
