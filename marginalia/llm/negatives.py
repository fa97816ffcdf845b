"""Hard-negative mining by norm-bucketed search.

Scores are integer inner products. Candidates are sorted by norm and taken in buckets, the longest first: by Cauchy-Schwarz no
score in a bucket is over the anchor's norm times the bucket's largest, so a bucket is skipped for an anchor whose windows all
have a higher lower limit or a higher running k-th score, and the rest of the run once that holds for all anchors.

Anchors are dealt in blocks and candidates in stripes, a task for each pair of them, so that neither side is ever held whole.
Blocks are cut along the norm an anchor's windows need; a candidate is sent only to blocks that its norm can serve. What a
task keeps are k rows a window; the tasks' rows are merged by a window function that is limited before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import join_hubs, small_batches, stash
from marginalia.llm.vectors import finite_rows, one_row_per_id, stacked, widened

SCALE, ANCHORS, POSITIVES, NEGATIVES = 256, 100, 5, 10
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 30, 90
#: Rows with an id divisible by the first number get the next label of so many.
RELABEL = (7, 10)
#: Candidates in a bucket; anchors, and candidates, that a task takes at most (about: rows are dealt by hash).
BUCKET, BLOCK, STRIPE = 4096, 16384, 65536
#: Anchors multiplied with a bucket at once.
ROWS = 256
#: Norms within this ratio are one band, so there are fewer than 15,000 of them for any double.
RATIO = 1.05
_ROW = "vec_id long, label long, norm double, band int, vec binary"


def quantised(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, norm, band, vec (doubles of whole numbers) of rows (vec_id, label, embedding) that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, _ = finite_rows(batch.column(2))
            at = [i for i, v in enumerate(found) if v is not None]
            whole = [np.floor(scale * found[i]) + 0.0 for i in at]
            norms = [float(np.sqrt(v @ v)) for v in whole]
            columns = [pa.array(norms, pa.float64()), pa.array([_band(n) for n in norms], pa.int32()), pa.array([v.tobytes() for v in whole], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at, pa.int64())) for c in (0, 1)), *columns], ("vec_id", "label", "norm", "band", "vec"))

    small_batches(rows.sparkSession)
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    return own.where("vec_id is not null and label is not null and embedding is not null").mapInArrow(run, _ROW)


def _band(norm: float) -> int:
    """Bands rise with the norm; that of zero is below all others."""
    return math.floor(math.log(norm) / math.log(RATIO)) if 0 < norm < math.inf else -20_000 if norm == 0 else 20_000


def _limits(scores: list[int], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers n with low * s <= 100 * n <= high * s."""
    return (np.array(v, np.int64).astype(np.longdouble) for v in ([-(-low * s // 100) for s in scores], [high * s // 100 for s in scores]))


class _Block:
    """Anchors with their windows, and the best so far of each window. Scores are exact: doubles hold them below 2^53, long
    doubles beyond."""

    def __init__(self, rows: list[tuple], k: int, same: bool, low: int, high: int) -> None:
        self.ids, self.labels = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
        self.norms, self.vectors = np.array([r[2] for r in rows]), stacked([r[3] for r in rows])
        self.k, self.same = k, same
        scores = [[0] if same else r[4] for r in rows]
        self.slots = np.array([len(s) for s in scores], np.int64)
        self.first = np.cumsum(self.slots) - self.slots
        n = int(self.slots.sum())
        if same:
            self.low, self.high = np.full(n, -np.inf, np.longdouble), np.full(n, np.inf, np.longdouble)
        else:
            self.low, self.high = _limits([int(s) for row in scores for s in row], low, high)
        self.best = np.full((n, k), -np.inf, np.longdouble)
        self.who = np.full((n, k), np.iinfo(np.int64).max, np.int64)
        self.owner = np.repeat(np.arange(len(rows)), self.slots)

    def needs(self) -> np.ndarray:
        """The least score that still counts for an anchor."""
        needs = np.full(len(self.ids), np.inf, np.longdouble)
        np.minimum.at(needs, self.owner, np.maximum(self.low, self.best[:, -1]))
        return needs

    def take(self, ids: np.ndarray, labels: np.ndarray, norms: np.ndarray, vectors: np.ndarray) -> bool:
        """One bucket; False if its largest norm serves no anchor, and so none after it does."""
        reach = float(norms.max()) * self.norms
        served = np.flatnonzero(reach * (1 + 1e-9) >= self.needs())
        if not len(served):
            return False
        width = max(self.vectors.shape[1], vectors.shape[1])
        if self.vectors.shape[1] < width:
            self.vectors = widened(self.vectors, width)
        vectors = widened(vectors, width)
        exact = np.longdouble if reach.max() >= 1 << 53 else np.float64
        if reach.max() >= 1 << 63:
            raise OverflowError("scores of these vectors do not fit in 64 bits")
        for at in range(0, len(served), ROWS):
            own = served[at : at + ROWS]
            scores = self.vectors[own].astype(exact, copy=False) @ vectors.astype(exact, copy=False).T
            fits = (self.labels[own][:, None] == labels) == self.same
            if self.same:
                fits &= self.ids[own][:, None] != ids
            for slot in range(int(self.slots[own].max(initial=0))):
                has = self.slots[own] > slot
                self._merge(self.first[own[has]] + slot, scores[has], fits[has], ids)
        return True

    def _merge(self, windows: np.ndarray, scores: np.ndarray, fits: np.ndarray, ids: np.ndarray) -> None:
        least = np.maximum(self.low[windows], self.best[windows, -1])
        within = fits & (scores >= least[:, None]) & (scores <= self.high[windows][:, None])
        many = np.flatnonzero(within.sum(1) > self.k)
        if len(many):  # whatever ties with the k-th stays
            cut = np.where(within[many], scores[many], -np.inf)
            kth = np.partition(cut, cut.shape[1] - self.k, axis=1)[:, -self.k]
            within[many] &= scores[many] >= kth[:, None]
        row, col = np.nonzero(within)
        if not len(row):
            return
        touched, place = np.unique(row, return_inverse=True)
        of = np.concatenate((np.repeat(np.arange(len(touched)), self.k), place))
        value = np.concatenate((self.best[windows[touched]].ravel(), scores[row, col].astype(np.longdouble)))
        who = np.concatenate((self.who[windows[touched]].ravel(), ids[col]))
        order = np.lexsort((who, -value, of))
        starts = np.searchsorted(of[order], np.arange(len(touched)))
        keep = order[(starts[:, None] + np.arange(self.k)).ravel()].reshape(-1, self.k)
        self.best[windows[touched]], self.who[windows[touched]] = value[keep], who[keep]

    def found(self) -> tuple[pa.Array, ...]:
        window, rank = np.nonzero(self.best > -np.inf)
        owner = self.owner[window]
        return tuple(pa.array(x, pa.int64()) for x in (self.ids[owner], window - self.first[owner], self.who[window, rank], self.best[window, rank].astype(np.int64)))


def _searched(batches: Iterator[pa.RecordBatch], k: int, same: bool, low: int, high: int, bucket: int) -> Iterator[pa.RecordBatch]:
    """Sorted (key, kind, vec_id, label, norm, vec, scores) rows, a key's anchors (kind 0) before its candidates, those by falling
    norm; the best k of each anchor's windows in this key as (anchor_id, slot, vec_id, score)."""
    now, anchors, block, rows, open_ = None, [], None, [], True

    def step() -> None:
        nonlocal rows, open_, block
        if rows and anchors and open_:
            block = block or _Block(anchors, k, same, low, high)
            open_ = block.take(*(np.array([r[i] for r in rows], t) for i, t in ((0, np.int64), (1, np.int64), (2, np.float64))), stacked([r[3] for r in rows]))
        rows = []

    def end() -> Iterator[pa.RecordBatch]:
        step()
        if block is not None:
            yield pa.RecordBatch.from_arrays(list(block.found()), ("anchor_id", "slot", "vec_id", "score"))

    for batch in batches:
        for key, kind, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != now:
                yield from end()
                now, anchors, block, rows, open_ = key, [], None, [], True
            if not kind:
                anchors.append(row)
            elif open_:
                rows.append(row)
                if len(rows) >= bucket:
                    step()
    yield from end()


def _search(anchors: DataFrame, candidates: DataFrame, k: int, same: bool, low: int = 0, high: int = 0, bucket: int = BUCKET) -> DataFrame:
    """anchors (key, vec_id, label, norm, vec, scores) and candidates (key, vec_id, label, norm, vec) that meet in a key."""
    n = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = anchors.select("key", F.lit(0).alias("kind"), "vec_id", "label", "norm", "vec", "scores")
    rows = rows.unionByName(candidates.select("key", F.lit(1).alias("kind"), "vec_id", "label", "norm", "vec", F.lit(None).cast("array<bigint>").alias("scores")))
    dealt = rows.repartition(n, "key").sortWithinPartitions("key", "kind", F.desc("norm"))
    return dealt.mapInArrow(lambda batches: _searched(batches, k, same, low, high, bucket), "anchor_id long, slot long, vec_id long, score long")


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _numbers(n) -> Column:
    """0 to n - 1, as rows."""
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def _share(rows: Column, size: int) -> Column:
    return F.greatest(F.ceil(rows / size), F.lit(1)).cast("long")


def positives(rows: DataFrame, of: Column, k: int, stripe: int, block: int, bucket: int) -> DataFrame:
    """anchor_id, rank, vec_id, score: the first k other rows of the anchor's label. A label's anchors are dealt in blocks and its
    rows in stripes, so no label is one task's."""
    facts = rows.groupBy("label").agg(F.count("*").alias("n"), F.count(F.when(of, 1)).alias("anchors")).where("anchors > 0")
    facts = stash(facts.select("label", _share(F.col("n"), stripe).alias("stripes"), _share(F.col("anchors"), block).alias("blocks"), "n"), "labels")
    total = rows.count()
    own = join_hubs(rows, facts, "label", "n", total)
    # a task for each pair of a block and a stripe of a label
    sent = own.where(of).withColumn("b", F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).withColumn("s", _numbers(F.col("stripes")))
    met = own.withColumn("s", F.pmod(F.xxhash64(F.lit("stripe"), "vec_id"), F.col("stripes"))).withColumn("b", _numbers(F.col("blocks")))
    key = F.xxhash64("label", "b", "s").alias("key")
    sent = sent.select(key, "vec_id", "label", "norm", "vec", F.lit(None).cast("array<bigint>").alias("scores"))
    found = _search(sent, met.select(key, "vec_id", "label", "norm", "vec"), k, True, bucket=bucket)
    return _first(found, ["anchor_id"], k).select("anchor_id", "rank", "vec_id", "score")


def _dealt_blocks(anchors: DataFrame, low: int, block: int) -> tuple[DataFrame, DataFrame]:
    """anchors with their block, and (least, block): the least band whose rows can serve a block. Blocks are cut along that band."""
    least = F.expr(f"aggregate(scores, 9223372036854775807L, (m, s) -> least(m, s)) * {low / 100}D")
    # a band lower than the quotient's, for rounding
    band = F.floor(F.ln(least / F.col("norm")) / math.log(RATIO)).cast("int") - 1
    needed = F.when((least <= 0) | (F.col("norm") <= 0), F.lit(-20_000)).otherwise(band)
    anchors = stash(anchors.withColumn("least", needed), "anchors")
    counts = anchors.groupBy("least").agg(F.count("*").alias("n"))  # fewer rows than there are bands
    counts = counts.select("least", "n", (F.sum("n").over(Window.orderBy("least")) - F.col("n")).alias("before"))
    share = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) / float(1 << 20)
    anchors = anchors.join(F.broadcast(counts), "least").withColumn("block", F.floor((F.col("before") + share * F.col("n")) / block).cast("long"))
    return anchors, anchors.groupBy("block").agg(F.min("least").alias("least"))


def mine(
    rows: DataFrame, anchors: int = ANCHORS, n_positives: int = POSITIVES, k: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    relabel: tuple[int, int] | None = RELABEL, scale: int = SCALE, block: int = BLOCK, stripe: int | None = None, bucket: int = BUCKET,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over rows (vec_id, label, embedding).

    Anchors are rows whose vec_id is divisible by `anchors`; their positives the first `n_positives` other rows of their label; for
    each the first `k` rows of other labels whose score lies within `low` and `high` hundredths of the positive's. Scores fall,
    ties go by vec_id. Rows with a null id, label or vector, or any null or non-finite component, take no part. A repeated
    vec_id counts once (the least row); other columns are not carried; shorter vectors are filled up with zeros; scores that
    64 bits don't hold raise; an anchor without positives, and a window without rows, have none here; an empty table gives
    an empty result.
    """
    spark = rows.sparkSession
    ready = quantised(rows, scale)
    if relabel:
        changed = F.when(F.col("vec_id") % relabel[0] == 0, (F.col("label") + 1) % relabel[1]).otherwise(F.col("label"))
        ready = ready.withColumn("label", changed)
    ready = one_row_per_id(stash(ready, "vectors"))
    total = ready.count()
    if stripe is None:
        stripe = min(max(total // max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), BUCKET), STRIPE)
    of = F.col("vec_id") % anchors == 0
    near = stash(positives(ready, of, n_positives, stripe, block, bucket), "positives")
    windows = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("positives"))
    own = ready.where(of).join(windows.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    own, blocks = _dealt_blocks(own.select("vec_id", "label", "norm", "vec", F.col("positives.score").alias("scores")), low, block)
    # which blocks a band's rows can serve: a row for each band that there is
    stripes = max(math.ceil(total / stripe), 1)
    served = ready.select("band").distinct().join(F.broadcast(blocks), F.col("band") >= F.col("least")).groupBy("band").agg(F.collect_list("block").alias("blocks"))
    met = ready.join(F.broadcast(served), "band").withColumn("b", F.explode("blocks")).withColumn("s", F.pmod(F.xxhash64(F.lit("stripe"), "vec_id"), F.lit(stripes)))
    sent = own.withColumnRenamed("block", "b").withColumn("s", _numbers(F.lit(stripes).cast("long")))
    key = F.xxhash64("b", "s").alias("key")
    found = _search(sent.select(key, "vec_id", "label", "norm", "vec", "scores"), met.select(key, "vec_id", "label", "norm", "vec"), k, False, low, high, bucket)
    best = _first(found, ["anchor_id", "slot"], k)
    out = best.join(near.select("anchor_id", (F.col("rank") - 1).cast("long").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor_id", "slot"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
