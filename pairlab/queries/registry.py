"""Registry of queries and of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers the function under its own name, with the SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def columns(name: str, source: str, key: str, made: dict[str, tuple[Callable[[], Column], str]], where: str | None = None) -> None:
    """A query of computed columns beside a key, and its SQL. ``made``: alias -> (what makes
    the column, once there is a session; SQL)."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = table(spark, folder, source)
        df = df.where(where) if where else df
        return df.select(key, *[c().alias(a) for a, (c, _) in made.items()])

    run.__name__ = name
    query(f"SELECT {key}, " + ", ".join(f"{s} AS {a}" for a, (_, s) in made.items()) + f" FROM {source}" + (f" WHERE {where}" if where else ""))(run)
