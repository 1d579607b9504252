"""How queries are registered: name, plan, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to 9 places, without negative zeros, so that values compare across engines."""
    return df.select(*((F.round(c, 9) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def query(name: str, sql: str | None = None, doubles: str = ""):
    """doubles: the SQL's columns to be rounded likewise."""

    def add(f):
        QUERIES[name] = lambda spark, d: tidy(f(spark, d))
        if sql:
            rounded = ", ".join(f"round(({c})::double, 9) + 0.0::double as {c}" for c in doubles.split())
            ORACLES[name] = f"select * replace ({rounded}) from ({sql}) q_" if rounded else sql
        return f

    return add
