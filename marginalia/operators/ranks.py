"""Exact places in an order, without a window that holds the whole of it.

An order is cut at sampled values into BUCKETS ranges. Rows are counted by (group, range); the place of a row is the number of
rows in the ranges before its own, a prefix sum over at most BUCKETS counts a group, and its place in its range, which is a window
of about a BUCKETS-th of the rows, even for a single group. The sample are the SAMPLE values of least hash, which depends on
the values alone: whatever part of a plan is computed again makes the same cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS, SAMPLE = 64, 2048


def _cuts_of(drawn: DataFrame, keys: dict[str, str], buckets: int) -> DataFrame:
    """One row: at most buckets - 1 values in order for each name, cut from a sample's column."""
    held = drawn.agg(*[F.sort_array(F.collect_list(k)).alias(name) for name, k in keys.items()])
    places = F.sequence(F.lit(1), F.lit(buckets - 1))

    def made(name: str) -> Column:
        step = F.greatest(F.floor(F.size(name) / buckets), F.lit(1)).cast("int")
        return F.array_distinct(F.transform(F.filter(places, lambda i: i * step < F.size(name)), lambda i: F.get(name, i * step)))

    return held.select(*[made(name).alias(name) for name in keys])


def _cuts(rows: DataFrame, key: Column, buckets: int, weight: Column) -> DataFrame:
    """One row: _cuts, at most buckets - 1 values in order. The weight is read and nulls are told apart late, so that what is below
    stays the same plan as for the places, and is computed once; a null is nobody's cut."""
    drawn = rows.select(key.alias("key"), F.when(weight >= 0, F.xxhash64(key)).alias("hash")).orderBy(F.col("key").isNull(), "hash", "key").limit(SAMPLE)
    return _cuts_of(drawn, {"_cuts": "key"}, buckets)


def _searched(cuts: str, key: Column, buckets: int) -> Column:
    """How many of the ordered cuts are below the key, by halving: six comparisons for 64 buckets."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(buckets - 1, 1).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(cuts, at + step - 1) < key, step).otherwise(0))


def bucketed(rows: DataFrame, key: Column, buckets: int | None = None, weight: Column | None = None) -> DataFrame:
    """rows with _bucket: how many cuts are below the key. Equal keys share a bucket, a null key is in the first."""
    buckets = buckets or BUCKETS
    joined = rows.crossJoin(F.broadcast(_cuts(rows, key, buckets, F.lit(1) if weight is None else weight)))  # one row
    return joined.withColumn("_bucket", _searched("_cuts", key, buckets)).drop("_cuts")


def _placed(cut: DataFrame, sums: DataFrame, key: Column, weight: Column, by: list[str], bucket: str, name: str, total: str | None = None) -> DataFrame:
    """cut with the weights before each row, from those of the ranges, sums (by, bucket, _n). Join and window have one key, the group
    with its range (null groups are equal in it), so rows are dealt once."""
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    # at most as many rows a group as there are buckets
    bases = sums.select(F.struct(*by, bucket).alias("_of_bucket"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(Window.partitionBy(*by)).alias("_total"))
    own = Window.partitionBy("_in_bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    joined = cut.withColumn("_in_bucket", F.struct(*by, bucket)).join(bases, F.col("_in_bucket") == F.col("_of_bucket"))
    placed = joined.withColumn(name, (F.col("_base") + F.coalesce(F.sum(weight).over(own), F.lit(0))).cast("long"))
    placed = placed.withColumn(total, F.col("_total").cast("long")) if total else placed
    return placed.drop(bucket, "_in_bucket", "_of_bucket", "_base", "_total")


def below(rows: DataFrame, key: Column, weight: Column, by: list[str], name: str, buckets: int | None = None, total: str | None = None) -> DataFrame:
    """rows with `name`: the weights of the group's rows of lesser keys, and with `total`: those of all its rows. Keys differ within
    a group, or tie among equals."""
    cut = bucketed(rows, key, buckets, weight)
    return _placed(cut, cut.groupBy(*by, "_bucket").agg(F.sum(weight).alias("_n")), key, weight, by, "_bucket", name, total)


def numbered(rows: DataFrame, order: list[str], name: str, by: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """rows with their place from 0, by group, in ascending order of these columns; equal rows are told apart at will."""
    return below(rows, F.struct(*order), F.lit(1), by or [], name, buckets)


def numbered_twice(rows: DataFrame, orders: dict[str, list[str]], by: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """rows with their places from 0 by two orders (name -> columns), as numbered() one after the other. Both are cut by one sample and
    counted in one pass before rows are dealt by either, so what is below is read three times, and no place twice."""
    by, buckets = by or [], buckets or BUCKETS
    keys = {name: F.struct(*order) for name, order in orders.items()}
    drawn = rows.select(*[k.alias(f"_key_{i}") for i, k in enumerate(keys.values())]).withColumn("_hash", F.xxhash64(*[f"_key_{i}" for i in range(len(keys))]))
    drawn = drawn.orderBy("_hash", *[f"_key_{i}" for i in range(len(keys))]).limit(SAMPLE)
    cut = rows.crossJoin(F.broadcast(_cuts_of(drawn, {f"_cuts_{i}": f"_key_{i}" for i in range(len(keys))}, buckets)))  # one row
    for i, key in enumerate(keys.values()):
        cut = cut.withColumn(f"_bucket_{i}", _searched(f"_cuts_{i}", key, buckets)).drop(f"_cuts_{i}")
    pairs = cut.groupBy(*by, *[f"_bucket_{i}" for i in range(len(keys))]).agg(F.count("*").alias("_pairs"))  # ranges by ranges a group
    for i, (name, key) in enumerate(keys.items()):
        cut = _placed(cut, pairs.groupBy(*by, f"_bucket_{i}").agg(F.sum("_pairs").alias("_n")), key, F.lit(1), by, f"_bucket_{i}", name)
    return cut
