"""Where queries register: a name, (spark, sf_dir) -> DataFrame, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column) -> Column:
    """Half-up at six digits, spelled alike in both engines."""
    return F.floor(x * 1e6 + 0.5).cast("double") / 1e6


def s6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5)::DOUBLE / 1e6"
