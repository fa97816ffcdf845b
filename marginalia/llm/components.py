"""Connected components by alternating large-star and small-star steps, over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import join_hubs, stash

#: Star steps halve what is left at least; a graph that needs more rounds than this is an error, not an answer.
MAX_ROUNDS = 60


def _star(pairs: DataFrame, total: int) -> DataFrame:
    """pairs (a, b), both ways round as the step needs, `total` at most: links each b to the least of a's neighbours and a."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("k")).select("a", F.least("a", "m").alias("m"), "k")
    return join_hubs(pairs, least, "a", "k", total)


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs, in any direction; repeats and loops do no harm. Returns (node, component), the least node
    that can be reached, for every node of an edge; null ends are no edges, and no edges give no rows. No step gathers a
    node's links: they are aggregated and joined back, those of hubs by broadcast."""
    now = stash(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        # large star: neighbours above a go to the least; small star: a and its neighbours below go to the least
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = stash(_star(both, 2 * state[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        small = _star(large, 2 * state[0])
        linked = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        now, before = stash(linked.where("a <> b").distinct(), "edges"), state
        state = _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components have not settled in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).distinct()


def _state(now: DataFrame) -> tuple[int, ...]:
    """How many links there are, and two hashes of them."""
    return tuple(now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)), F.coalesce(F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31))), F.lit(0))).first())
