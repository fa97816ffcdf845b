"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(threshold_k - w . x): one weight vector over hashed text features for all grades, and ordered
thresholds. Grades come from the ratings: 0 for low quality, 1 for good quality that is toxic, 2 for good quality. The model
gives the expected grade and tail probabilities P(grade >= k); documents with P(grade >= 2) of KEEP at least are selected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.common import small_batches, stash

GRADES = 3
#: The fit uses at most so many rated documents, those with the least hashed ids: a bounded sample.
FIT_ROWS = 10_000
BITS = 20
#: Features in fewer documents of the sample have no weight.
MIN_DOCS = 20
#: Features whose share differs by fewer standard errors between grades have no weight.
MIN_CONTRAST = 5.0
#: Words also count by their first letters, which related forms share.
STEM = 4
KEEP = 0.5
#: Entries of a worker's word cache.
CACHE = 300_000
_STEPS, _RATE, _DECAY = 240, 0.5, 1e-4


class Features:
    """Words and their first letters by hash, valued by a slow growth of their count, and a text's shape in the last places."""

    SHAPES = 10

    def __init__(self, bits: int = BITS):
        import xxhash

        self.hash, self.size, self.known = xxhash.xxh32_intdigest, 1 << bits, {}

    def word(self, w: str) -> tuple[int, int]:
        i = self.known.get(w)
        if i is None:
            low, room = w.lower(), self.size - self.SHAPES
            i = tuple(self.hash(x.encode("utf-8", "surrogatepass"), 7) % room for x in (low.strip(".,;:!?()\"'"), "^" + low[:STEM]))
            if len(w) <= 64:
                if len(self.known) >= CACHE:
                    self.known.clear()
                self.known[w] = i
        return i

    def shape(self, text: str, words: list[str]) -> list[float]:
        n, c = max(len(words), 1), max(len(text), 1)
        letters = sum(map(str.isalpha, words))
        signs = sum(map(text.count, "|%*#$&!"))
        upper = sum(map(str.isupper, words))
        same = sum(a == b for a, b in zip(words, words[1:], strict=False))
        return [1.0, min(1.0, 12 * signs / c), upper / n, same / n, letters / n, len(set(words)) / n, min(2.0, c / n / 10), float(len(words) < 20), text.count("\n") / n, min(3.0, float(np.log10(n)))]

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Indices and values."""
        text = text or ""
        words = text.split()
        i, n = np.unique(np.fromiter(chain.from_iterable(map(self.word, words)), np.int64, 2 * len(words)), return_counts=True)
        value = 0.3 * np.log1p(n)
        shape = np.arange(self.size - self.SHAPES, self.size)
        return np.concatenate((i, shape)), np.concatenate((value, self.shape(text, words)))


@dataclass(frozen=True)
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1, a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, size: int, n_grades: int = GRADES) -> Ordinal:
    """Weights and ordered thresholds by full-batch gradient steps with per-weight rates (AdaGrad); grades weigh alike.

    The thresholds are a first one and logarithms of the gaps, so they stay in order. With no rows, or one grade, all
    weights stay 0.
    """
    if not len(rows):
        return Ordinal(np.zeros(size), np.arange(n_grades - 1) - (n_grades - 1) / 2)
    index = np.concatenate([i for i, _ in rows])
    value = np.concatenate([v for _, v in rows])
    row = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    active = np.bincount(index, minlength=size) > 0  # the others have no weight
    place = np.cumsum(active) - 1
    index = place[index]
    whole, size = size, int(active.sum())
    count = np.bincount(grades, minlength=n_grades)
    share = (len(grades) / np.maximum(count, 1) / max((count > 0).sum(), 1))[grades] ** 0.5
    w, free = np.zeros(size), np.concatenate(([-1.0], np.zeros(n_grades - 2)))
    sum_w, sum_f = np.full(size, 1e-8), np.full(n_grades - 1, 1e-8)
    for _ in range(_STEPS):
        cuts = np.concatenate((free[:1], free[0] + np.cumsum(np.exp(free[1:]))))
        score = np.bincount(row, w[index] * value, len(rows))
        edge = np.concatenate(([-40.0], cuts, [40.0]))
        hi, lo = (1 / (1 + np.exp(-np.clip(edge[grades + k] - score, -40, 40))) for k in (1, 0))
        p = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = hi * (1 - hi) / p * share, lo * (1 - lo) / p * share
        g_score = (d_hi - d_lo) / len(rows)  # of the negative log-likelihood
        g = np.bincount(index, g_score[row] * value, size) + _DECAY * w
        sum_w += g * g
        w -= _RATE * g / np.sqrt(sum_w)
        g_cut = np.zeros(n_grades + 1)
        np.add.at(g_cut, grades + 1, -d_hi / len(rows))
        np.add.at(g_cut, grades, d_lo / len(rows))
        g_cut = g_cut[1:-1]
        g_free = np.concatenate(([g_cut.sum()], [g_cut[k:].sum() * np.exp(free[k]) for k in range(1, n_grades - 1)]))
        sum_f += g_free * g_free
        free = free - 0.2 * g_free / np.sqrt(sum_f)
    weights = np.zeros(whole)
    weights[active] = w
    return Ordinal(weights, np.concatenate((free[:1], free[0] + np.cumsum(np.exp(free[1:])))))


def grades_of(labels: DataFrame) -> DataFrame:
    """doc_id, grade; rows without an id or a rating are no ratings, of several for an id the least counts."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(grade).alias("grade"))


def rated_sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, grade, i, v: the features of at most `rows` rated documents, as a table in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            made = [features.of(t) for t in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array([i.astype(np.int32) for i, _ in made], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in made], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, ("doc_id", "grade", "i", "v"))

    few = grades_of(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # at most `rows` rows, so it may be broadcast
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(few), "doc_id").select("doc_id", "grade", "text")
    return stash(own.mapInArrow(run, "doc_id long, grade int, i array<int>, v array<float>"), "rated")


def telling_features(sample: DataFrame, n_grades: int = GRADES, min_docs: int = MIN_DOCS, min_contrast: float = MIN_CONTRAST) -> list[int]:
    """Features of enough sample rows whose share differs, by min_contrast standard errors, over a cut between grades or
    for a grade alone; a text's shape always counts. At most as many as there are hash places."""
    grade = F.col("grade")
    sides = [grade >= k for k in range(1, n_grades)] + [grade == k for k in range(1, n_grades - 1)]
    n, *n_side = sample.agg(F.count("*"), *[F.count_if(s) for s in sides]).first()
    seen = sample.select("grade", F.explode("i").alias("f")).groupBy("f").agg(F.count("*").alias("seen"), *[F.count_if(s).alias(f"k{j}") for j, s in enumerate(sides)])
    share, contrast = F.col("seen") / F.lit(max(n, 1)), [F.lit(0.0)]
    for j, n1 in enumerate(n_side):
        if 0 < n1 < n:
            spread = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / n1 + 1 / (n - n1)))
            contrast.append(F.abs(F.col(f"k{j}") / n1 - (F.col("seen") - F.col(f"k{j}")) / (n - n1)) / spread)
    telling = (F.col("seen") >= min(min_docs, n)) & (F.greatest(*contrast, F.lit(0.0)) >= min_contrast)
    return sorted(r["f"] for r in seen.where(telling | (F.col("f") >= (1 << BITS) - Features.SHAPES)).select("f").collect())


def sample_rows(sample: DataFrame, telling: list[int]) -> list[tuple[tuple[np.ndarray, np.ndarray], int]]:
    """Features among the telling ones, and grade, of each sample row; of repeated ids the one with the fewest features."""
    kept = np.array(telling, np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i.values.to_numpy(), v.values.to_numpy()) for i, v in zip(batch.column(2), batch.column(3), strict=True)]
            rows = [(i[m], v[m]) for i, v in rows for m in (np.isin(i, kept),)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([i for i, _ in rows], pa.list_(pa.int32())), pa.array([v for _, v in rows], pa.list_(pa.float32()))], ("doc_id", "grade", "i", "v"))

    got = sample.mapInArrow(run, "doc_id long, grade int, i array<int>, v array<float>").toArrow()
    by_id = {}
    for doc, grade, i, v in zip(*(got[c].combine_chunks() for c in ("doc_id", "grade", "i", "v")), strict=True):
        i, v = i.values.to_numpy(), v.values.to_numpy()
        held = by_id.get(doc.as_py())
        if held is None or (len(i), float(v.sum())) < (len(held[0][0]), float(held[0][1].sum())):
            by_id[doc.as_py()] = (i, v), grade.as_py()
    return [by_id[doc] for doc in sorted(by_id)]


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Ordinal:
    """The model of at most `rows` rated documents (doc_id, text) by labels (doc_id, quality, toxic).

    A null text is empty; rows without an id, and ratings without an id, quality or toxic, are not used; of several ratings of
    an id the least grade counts, of several documents the one with the fewest features; other columns are not read. Without
    rated documents all weights are 0.
    """
    small_batches(docs.sparkSession)
    rated = rated_sample(docs, labels, rows)
    sample = sample_rows(rated, telling_features(rated))
    return fit_ordinal([x for x, _ in sample], np.array([g for _, g in sample], np.int64), 1 << BITS)


def _scores(model: Ordinal, texts: list[str | None], features: Features) -> np.ndarray:
    return np.array([float(model.weights[i] @ v) for i, v in map(features.of, texts)])


def _probabilities(model: Ordinal, texts: list[str | None], features: Features) -> np.ndarray:
    return model.tails(_scores(model, texts, features)) if texts else np.zeros((0, len(model.thresholds)))


def score(docs: DataFrame, model: Ordinal, keep: float = KEEP) -> DataFrame:
    """docs with expected_grade, p_usable (grade 1 or more), p_good (grade 2) and selected; all rows and columns are kept.

    A null text is empty and scored as such; an empty table gives an empty result. A column that docs has under one of these
    names is replaced.
    """
    added = {"expected_grade": pa.float64(), "p_usable": pa.float64(), "p_good": pa.float64(), "selected": pa.bool_()}
    own = docs.drop(*added)
    names = own.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            tails = _probabilities(model, batch.column(at).to_pylist(), features)
            columns = [tails.sum(1), tails[:, 0], tails[:, -1], tails[:, -1] >= keep]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(columns, added.values(), strict=True))], [*names, *added])

    small_batches(docs.sparkSession)
    fields = [T.StructField(k, T.BooleanType() if k == "selected" else T.DoubleType()) for k in added]
    return own.mapInArrow(run, T.StructType([*own.schema.fields, *fields]))


def select(docs: DataFrame, model: Ordinal, keep: float = KEEP) -> DataFrame:
    """The rows of docs whose tail probability of the best grade is `keep` at least, as they are, whatever columns docs has.

    A null text is empty and scored as such; null ids, repeated rows and ties are judged each for itself; an empty table
    gives an empty result.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            yield batch.filter(pa.array(_probabilities(model, batch.column(at).to_pylist(), features)[:, -1] >= keep))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
