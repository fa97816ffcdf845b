"""Verdicts over a stream of units, and running totals by model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import metrics as M


def verdicts(units: DataFrame) -> DataFrame:
    """Usable units of a batch or a stream with correct, failure and state."""
    return units.where(M.usable()).withColumns({"correct": M.correct(), "failure": M.failure(), "state": M.state()})


def running_totals(units: DataFrame, by: str = "model") -> DataFrame:
    """For the complete or update output mode; state is a row for each model."""
    return verdicts(units).groupBy(by).agg(F.count("*").alias("n"), F.count_if("correct").alias("correct"), F.count_if("failure").alias("failures"))
