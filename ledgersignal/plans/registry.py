"""Named queries over the given tables, each with the SQL that must give the same rows.

A query is declared with its output columns by kind, so both sides get the same names and types:
``i`` whole numbers (BIGINT), ``d`` decimals (DOUBLE, rounded to six places), ``s`` text. Decimals go
through an exact decimal with two more places, so that both engines round halves alike.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS = 6


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    columns: tuple[tuple[str, str], ...]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(spark, sf_dir)
        return df.select(*[_spark_column(c, kind) for c, kind in self.columns])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        return f"SELECT {', '.join(_sql_column(c, k) for c, k in self.columns)} FROM ({self.sql}) AS result_rows"


def _spark_column(name: str, kind: str):
    c = F.col(name)
    if kind == "i":
        return c.cast("bigint").alias(name)
    if kind == "d":
        exact = c.cast("double").try_cast(f"decimal(38,{DIGITS + 2})")
        return (F.round(exact, DIGITS).cast("double") + F.lit(0.0)).alias(name)
    return c.cast("string").alias(name)


def _sql_column(name: str, kind: str) -> str:
    if kind == "i":
        return f"CAST({name} AS BIGINT) AS {name}"
    if kind == "d":
        exact = f"TRY_CAST(CAST({name} AS DOUBLE) AS DECIMAL(38, {DIGITS + 2}))"
        return f"CAST(round({exact}, {DIGITS}) AS DOUBLE) + 0.0 AS {name}"
    return f"CAST({name} AS VARCHAR) AS {name}"


REGISTRY: dict[str, Query] = {}


def query(name: str, i: str = "", d: str = "", s: str = "", sql: str | None = None):
    """Register a builder ``(spark, sf_dir) -> DataFrame`` under a name."""
    kinds = tuple((c, k) for k, names in (("i", i), ("d", d), ("s", s)) for c in names.split())

    def wrap(build):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, build, kinds, sql)
        return build

    return wrap
