"""Registration of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import metrics as M
from marginalia.plans.proxy import CTE, units

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, cte: bool = True):
    """Registers a function under its name; sql goes behind the common table expressions."""

    def take(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (CTE if cte else "") + sql
        return f

    return take


def r9(x: Column, name: str) -> Column:
    return F.round(x, 9).alias(name)


def checked(spark: SparkSession, d: str) -> DataFrame:
    """Units with ok, dt, h, g, fail, ungr, state."""
    u = units(spark, d)
    return u.withColumns({"ok": M.correct(), "dt": M.dt(), "h": M.h(), "g": M.g(), "fail": M.failure(), "ungr": M.ungrounded(), "state": M.state()})


def n_if(c, name: str) -> Column:
    return F.count_if(F.col(c) if isinstance(c, str) else c).alias(name)
