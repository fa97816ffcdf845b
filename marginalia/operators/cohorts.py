"""Cohorts: common-correct groups and paired units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def complete_groups(df: DataFrame, keys: list[str], level: str, levels: int, holds: Column) -> DataFrame:
    """Keys of groups that have exactly `levels` different levels, once each, and where `holds` is true throughout."""
    sums = df.groupBy(*keys).agg(F.count_distinct(level).alias("_l"), F.count("*").alias("_n"), F.bool_and(holds).alias("_all"))
    return sums.where((F.col("_l") == levels) & (F.col("_n") == levels) & F.col("_all")).select(*keys)


def members(df: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(groups, keys, "left_semi")


def self_pairs(df: DataFrame, keys: list[str], split: str, a, b, columns: list[str]) -> DataFrame:
    """Rows with split = a beside those with split = b of the same key: columns as <c>_a and <c>_b. One pass, one shuffle:
    a conditional aggregation. A (keys, split) that stands twice is an error when the query runs, never a lost pair."""
    made = [F.max(F.when(F.col(split) == v, F.col(c))).alias(f"{c}_{s}") for c in columns for v, s in ((a, "a"), (b, "b"))]
    n_a, n_b = F.count_if(F.col(split) == a), F.count_if(F.col(split) == b)
    both = F.when((n_a > 1) | (n_b > 1), F.raise_error(F.lit(f"{', '.join(keys)}, {split} is no key")).cast("boolean")).otherwise((n_a == 1) & (n_b == 1))
    return df.where(F.col(split).isin(a, b)).groupBy(*keys).agg(both.alias("_both"), *made).where("_both").drop("_both")


def ordered_pairs(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Pairs i < j within small groups of fixed design (a few rows a group), by an equi-join with a range condition."""
    a = df.select(*keys, F.col(order).alias("i"), *[F.col(c).alias(f"{c}_a") for c in columns])
    b = df.select(*keys, F.col(order).alias("j"), *[F.col(c).alias(f"{c}_b") for c in columns])
    return a.join(b, keys).where("i < j")
