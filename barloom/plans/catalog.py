"""How queries are declared: a function of (spark, sf_dir) with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column | str, digits: int = 8, name: str | None = None) -> Column:
    c2 = F.round(F.col(c) if isinstance(c, str) else c, digits)
    return c2.alias(name or c) if (name or isinstance(c, str)) else c2


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """All double columns rounded, for comparison with the SQL."""
    return df.select(*(F.round(F.col(f.name), digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema.fields))
