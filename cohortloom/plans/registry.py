"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortloom.sources.scratch import folder

from .adapters import adapted, with_adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, written: bool = False):  # noqa: ANN201
    """Registers a function of the adapters (``t(name)`` gives one) under its name; a ``written`` one gets a session and a new folder as well."""

    def register(f):  # noqa: ANN001, ANN202
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            t = lambda name: adapted(spark, sf_dir, name)
            return f(t, spark, folder(spark)) if written else f(t)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = with_adapters(sql.strip())
        return f

    return register


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]
