"""From long score rows to units, one for each condition and model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot_views(scores: DataFrame, keys: list[str], view: str = "view", value: str = "margin", carried: list[str] | None = None, arrays: bool = False) -> DataFrame:
    """One row a key: mf, mt, mj_min, mj_max, n_rivals (and mj, sorted, if arrays), in one aggregation.

    Views are `full`, `remove_target` and `remove_off_*`. carried columns are read off the full view.
    """
    v, m = F.col(view), F.col(value)
    rival = v.startswith("remove_off_")
    made = [
        F.max(F.when(v == "full", m)).alias("mf"), F.max(F.when(v == "remove_target", m)).alias("mt"),
        F.min(F.when(rival, m)).alias("mj_min"), F.max(F.when(rival, m)).alias("mj_max"), F.count_if(rival).alias("n_rivals"),
    ]
    made += [F.max(F.when(v == "full", F.col(c))).alias(c) for c in carried or []]
    made += [F.array_sort(F.collect_list(F.when(rival, m))).alias("mj")] if arrays else []
    return scores.groupBy(*keys).agg(*made)


def in_order(df: DataFrame, column: str, order: tuple[str, ...]) -> DataFrame:
    """df with `place`, the value's place from 1 in a fixed order of presentation, sorted by it; a value without a place is an
    error when the query runs. For result tables."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    place = F.when(F.coalesce(at, F.lit(0)) > 0, at).otherwise(F.raise_error(F.concat(F.lit("no place for "), F.coalesce(F.col(column).cast("string"), F.lit("null")))).cast("bigint"))
    return df.withColumn("place", place).orderBy("place")


def explode_views(manifest: DataFrame, views: str = "views") -> DataFrame:
    """A row for each condition and view; the view's fields stand beside the condition's."""
    return manifest.select(*[c for c in manifest.columns if c != views], F.inline(views))


def shard(df: DataFrame, key: str | Column, shards: int, index: int) -> DataFrame:
    """Rows of one of `shards` parts, by an ordinal or any integer key (files have no order in Spark)."""
    if shards < 1 or not 0 <= index < shards:
        raise ValueError(f"shard {index} of {shards}")
    return df.where(F.pmod(F.col(key) if isinstance(key, str) else key, F.lit(shards)) == index)


def select_ids(df: DataFrame, key: str, ids: list | None = None, limit: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Rows of the wanted ids in their order (column pos), or the first `limit` rows by `order`; unknown ids are an error."""
    if ids is None:
        df = df.orderBy(*(order or [key]))
        return df if limit is None else df.limit(limit)
    wanted = df.sparkSession.createDataFrame([(i, n) for n, i in enumerate(ids)], f"{key} {df.schema[key].dataType.simpleString()}, pos long")
    if unknown := wanted.join(df, key, "left_anti").limit(5).collect():
        raise KeyError(f"unknown ids: {[r[0] for r in unknown]}")
    return df.join(F.broadcast(wanted), key).orderBy("pos")  # the caller's list
