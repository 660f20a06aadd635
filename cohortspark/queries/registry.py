"""Query registry: a Spark callable and, where SQL can say the same, its text over the given tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6


def tidy(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded and negative zero removed, so that summation order cannot show."""
    return df.select(*[
        (F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema.fields])


def sql_round(expression: str, digits: int) -> str:
    """Half-up rounding of the printed decimal value, which is what Spark's ``round`` does to a double."""
    return f"CAST(round(CAST(CAST({expression} AS VARCHAR) AS DECIMAL(38, 15)), {digits}) AS DOUBLE)"


def query(name: str, sql: str | None = None, floats: Sequence[str] = (), digits: int = DIGITS):
    """Register a query; ``floats`` are the columns of the SQL text to round like the Spark result."""
    def register(build: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: tidy(build(spark, folder), digits)
        if sql is not None:
            if floats:
                swaps = ", ".join(sql_round(f'CAST("{c}" AS DOUBLE)', digits) + f' + 0.0 AS "{c}"' for c in floats)
                ORACLE[name] = f"SELECT * REPLACE ({swaps}) FROM (\n{sql}\n) AS q"
            else:
                ORACLE[name] = sql
        return build

    return register
