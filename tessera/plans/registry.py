"""Queries by inventory number, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register f(t, spark) under name; t(table) reads a table of the folder."""

    def register(f):
        def run(spark, sf_dir):
            return f(lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet"), spark)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return register
