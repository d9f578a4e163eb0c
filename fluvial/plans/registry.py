"""Names of queries, their functions and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under a name, with its SQL where SQL can say it."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is there already")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def r4(c: str | Column, name: str | None = None) -> Column:
    """A double rounded to four places, so that the order of sums doesn't show."""
    x = F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 4)
    return x.alias(name or c) if isinstance(c, str) or name else x


def signed4(c: str) -> Column:
    """r4 as SQL's round: what is negative and rounds to nothing stays negative, -0.0."""
    x = r4(F.col(c))
    return F.when((x == 0) & (F.col(c) < 0), F.lit(-0.0)).otherwise(x).alias(c)
