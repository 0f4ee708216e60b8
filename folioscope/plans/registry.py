"""Named queries and the SQL that their results are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import derived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Stored and derived tables as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return derived.load(self._spark, self._dir, name)


def query(name: str, sql: str | None = None, *uses: str):
    """Registers f(tables) -> DataFrame. uses: the derived tables that the SQL reads."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = f"WITH {derived.with_clause(*uses)} {sql}" if uses else sql
        return f

    return register
