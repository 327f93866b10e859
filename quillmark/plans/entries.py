"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.steps import shared_folder  # noqa: F401
from quillmark.plans.fixtures import with_tables

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
BODIES: dict[str, str] = {}  # the SQL as it is written, for the SQL of queries that build on it


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of (spark, sf_dir) and, where there is any, its SQL over given and derived tables."""

    def register(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            BODIES[name], ORACLES[name] = sql, with_tables(sql)
        return f

    return register


def joined(df: DataFrame, *columns: str) -> DataFrame:
    """Lists as text, so that engines print them alike."""
    return df.withColumns({c: F.array_join(c, " | ") for c in columns})


def flat(c: str) -> Column:
    return F.array_join(c, " | ")
