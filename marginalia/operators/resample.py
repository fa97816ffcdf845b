"""Cluster bootstrap and permutation over a table of draws.

Statistics are reduced to counts by cluster first; a draw then is a join of cluster numbers with those counts, whatever the
number of units. Draws come from md5, which any engine computes alike, or from a PCG64 generator that jumps ahead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEED = 20260907
DRAWS = 10_000
LEVELS = (0.025, 0.975)


def md5_int(*parts: Column) -> Column:
    """The first 32 bits of the md5 of the parts, joined by |."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("long")


def md5_draws(spark: SparkSession, clusters: int, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """draw, pos, cluster_idx; made where it is used, in parallel."""
    ids = spark.range(draws * clusters)
    ids = ids.select(F.expr(f"id div {clusters}").alias("draw"), F.pmod("id", F.lit(clusters)).alias("pos"))
    return ids.select("draw", "pos", F.pmod(md5_int(F.lit(seed), F.col("draw"), F.col("pos")), F.lit(clusters)).alias("cluster_idx"))


def _bounded(start: int, n: int, clusters: int, seed: int) -> np.ndarray:
    """Numbers below clusters from 2 * n 32-bit words of numpy's default generator, from word 2 * start on: the low half of each
    64-bit output, then the high one, times clusters, less those that the method rejects to be fair."""
    words = np.random.PCG64(seed).advance(start).random_raw(n)
    words = np.stack((words & np.uint64(0xFFFFFFFF), words >> np.uint64(32)), 1).ravel() * np.uint64(clusters)
    fair = (words & np.uint64(0xFFFFFFFF)) >= np.uint64((1 << 32) % clusters)
    return (words[fair] >> np.uint64(32)).astype(np.int64)


def pcg64_draws(spark: SparkSession, clusters: int, draws: int = DRAWS, seed: int = SEED, slice_outputs: int = 1 << 18) -> DataFrame:
    """draw, cluster_idx, multiplicity of numpy's default generator, as default_rng(seed).integers(0, clusters, (draws, clusters)).

    The generator can jump ahead, so each task makes slices of the stream by itself. A word is rejected once in 2^32 / clusters at
    most; where that can happen, slices are counted first and the numbers of words they keep, one a slice, say where in the
    matrix each slice begins.
    """
    if not 0 < clusters < 1 << 32:
        raise ValueError(f"{clusters} clusters")
    wanted = draws * clusters
    if clusters == 1:  # no words are used
        return spark.range(draws).select(F.col("id").alias("draw"), F.lit(0).cast("long").alias("cluster_idx"), F.lit(1).cast("long").alias("multiplicity"))
    rejects = (1 << 32) % clusters
    words = wanted + (wanted * rejects >> 32) * 2 + (64 if rejects else 0)  # enough, but for a chance that is checked
    slices = -(-words // (2 * slice_outputs))
    tasks = min(slices, max(spark.sparkContext.defaultParallelism, 1) * 4)
    ids = spark.range(0, slices, 1, tasks)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "n": [len(_bounded(i * slice_outputs, slice_outputs, clusters, seed)) for i in batch["id"]]})

    if rejects:
        sizes = [r.n for r in ids.mapInPandas(counted, "id long, n long").orderBy("id").collect()]
        if sum(sizes) < wanted:
            raise RuntimeError("too many words were rejected")
        first = [0, *np.cumsum(sizes)[:-1].tolist()]
    else:
        first = None

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in batch["id"]:
                values = _bounded(i * slice_outputs, slice_outputs, clusters, seed)
                at = (first[i] if first else i * 2 * slice_outputs) + np.arange(len(values))
                draw = at // clusters
                keys, n = np.unique((draw * clusters + values)[draw < draws], return_counts=True)
                yield pd.DataFrame({"draw": keys // clusters, "cluster_idx": keys % clusters, "multiplicity": n})

    # a draw that two slices share is put together
    return ids.mapInPandas(made, "draw long, cluster_idx long, multiplicity long").groupBy("draw", "cluster_idx").agg(F.sum("multiplicity").alias("multiplicity"))


def indexed(counts: DataFrame, cluster: str) -> DataFrame:
    """cluster_idx from 0 by cluster. One task numbers the clusters, which are a design's, not the data's."""
    return counts.withColumn("cluster_idx", (F.row_number().over(Window.orderBy(cluster)) - 1).cast("long"))


def drawn_sums(counts: DataFrame, cluster: str, columns: list[str], draws: DataFrame | None = None, n_draws: int = DRAWS) -> DataFrame:
    """draw and the columns' sums over the clusters of each draw; all statistics share the draws."""
    own = indexed(counts, cluster)
    if draws is None:
        # md5_draws of as many clusters as there are; made from the clusters themselves, so no job has to count them first
        sized = own.select(F.col("cluster_idx").alias("pos"), F.count("*").over(Window.partitionBy()).alias("k"))
        sized = sized.select("pos", "k", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))).alias("draw"))
        draws = sized.select("draw", F.pmod(md5_int(F.lit(SEED), F.col("draw"), F.col("pos")), F.col("k")).alias("cluster_idx"))
    weight = F.col("multiplicity") if "multiplicity" in draws.columns else F.lit(1)
    return draws.join(own, "cluster_idx").groupBy("draw").agg(*[F.sum(F.col(c) * weight).alias(c) for c in columns])


def ratio(num: str, den: str, empty: str = "clamp") -> Column:
    """num / den of a draw. empty: clamp (den is 1 at least), drop or null (no value without den)."""
    d = F.col(den).cast("double")
    if empty == "clamp":
        return F.col(num) / F.greatest(d, F.lit(1.0))
    if empty in ("drop", "null"):
        return F.try_divide(F.col(num).cast("double"), d)
    raise ValueError(empty)


def interval(drawn: DataFrame, values: dict[str, Column]) -> DataFrame:
    """name, lo, hi for each value; draws without one do not count. Exact percentiles."""
    made = drawn.select(*[v.alias(k) for k, v in values.items()])
    wide = made.agg(*[F.percentile(k, F.lit(q)).alias(f"{k}__{i}") for k in values for i, q in enumerate(LEVELS)])
    rows = F.array(*[F.struct(F.lit(k).alias("name"), F.col(f"{k}__0").alias("lo"), F.col(f"{k}__1").alias("hi")) for k in values])
    return wide.select(F.inline(rows))


def cluster_bootstrap(counts: DataFrame, cluster: str, pairs: dict[str, tuple[str, str]], empty: str = "clamp", draws: DataFrame | None = None, n_draws: int = DRAWS) -> DataFrame:
    """name, point, lo, hi, num, den of each (num, den) pair of count columns."""
    columns = sorted({c for pair in pairs.values() for c in pair})
    drawn = drawn_sums(counts, cluster, columns, draws, n_draws)
    ends = interval(drawn, {k: ratio(n, d, empty) for k, (n, d) in pairs.items()})
    total = counts.agg(*[F.sum(c).alias(c) for c in columns])
    point = total.select(F.inline(F.array(*[F.struct(F.lit(k).alias("name"), F.col(n).cast("long").alias("num"), F.col(d).cast("long").alias("den")) for k, (n, d) in pairs.items()])))
    return point.join(ends, "name").select("name", F.try_divide(F.col("num").cast("double"), F.col("den").cast("double")).alias("point"), "lo", "hi", "num", "den")


def permutation_p(df: DataFrame, x: str, y: str, key: str, n_draws: int, seed: int = SEED) -> DataFrame:
    """observed, p of corr(x, y) against shuffled y: (1 + draws at or above) / (draws + 1). For dimension tables: each draw
    numbers their rows by a hash."""
    own = df.select(x, y, key, F.row_number().over(Window.orderBy(key)).alias("_at"))
    # draw -1 keeps the order
    drawn = own.withColumn("draw", F.explode(F.sequence(F.lit(-1), F.lit(n_draws - 1))))
    order = Window.partitionBy("draw").orderBy(F.when(F.col("draw") >= 0, md5_int(F.lit(seed), F.col("draw"), F.col(key))), key)
    shuffled = drawn.select("draw", y, F.row_number().over(order).alias("_at"))
    r = own.select(x, "_at").join(shuffled, "_at").groupBy("draw").agg(F.corr(x, y).alias("r"))
    r = r.withColumn("observed", F.max(F.when(F.col("draw") < 0, F.col("r"))).over(Window.partitionBy()))
    above = F.count_if((F.col("draw") >= 0) & (F.col("r") >= F.col("observed") - 1e-12))
    return r.agg(F.max("observed").alias("observed"), ((above + 1) / F.lit(n_draws + 1.0)).alias("p"))
