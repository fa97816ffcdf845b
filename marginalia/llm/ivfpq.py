"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, table-lookup distances, exact rerank.

The index (coarse centres in two levels, and code books of the residuals' subspaces) is fitted on a bounded sample; every vector
is indexed. A vector stands in the list of its nearest centre and asks other lists as well. If x and y are within DELTA of each
other and stand in different lists, one of them is within DELTA / 2 of the plane half-way between the two centres, measured
along the line that joins them. So a vector asks every list whose plane is that near; as a displacement spreads over all
directions, the share of it along one line that counts is SIGMAS / sqrt(d); in up to SIGMAS^2 dimensions the rule loses nothing.
Between centres within DELTA of each other, as in a crowd of near copies that fills several lists, the whole of DELTA / 2 counts.
Recall is measured in the tests. A pair is looked at in exactly one list.

In a list, the asking vector's distances to all codes come from a table of its residual's distances to the code words. A stored
vector's own distance from its code, e, is known, so one within DELTA of x has a code within DELTA + e of x: the codes drop no
pair. What is left is compared exactly, in double precision. Equal vectors are one node of known size. Lists of any length are
dealt in blocks; what leaves a task are numbers of links and a spanning forest, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from marginalia.llm.common import join_hubs, small_batches, stash
from marginalia.llm.components import components
from marginalia.llm.vectors import finite_rows, one_row_per_id

SIMILARITY, SEED = 0.95, 42
#: Vectors a list has on average, until there are LIST_VALUES numbers in centres (16 MB, which every task gets).
LIST_ROWS, LIST_VALUES = 256, 1 << 22
#: About how many vectors the index is fitted on, at most and for each list.
SAMPLE, SAMPLE_LIST = 1 << 18, 32
#: Subspaces and words of a code; rounds of k-means; cells of the upper level whose centres a vector is compared with.
PARTS, WORDS, ROUNDS, CELLS = 8, 256, 8, 8
SIGMAS = 3.0
#: Stored, and asking, vectors of a list that meet in one task (about: rows are dealt by hash); asking vectors compared at once.
BLOCK, ROWS = 8192, 64


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (centres * centres).sum(1) / 2
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = (x[at : at + 4096] @ centres.T - half).argmax(1)
    return out


def _means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means; a centre that loses all its vectors stays where it was."""
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        near = _nearest(x, centres)
        order = np.argsort(near, kind="stable")
        there, starts = np.unique(near[order], return_index=True)
        centres[there] = np.add.reduceat(x[order], starts) / np.diff(np.append(starts, len(x)))[:, None]
    return centres


@dataclass
class Index:
    """centres of the lists, those of a cell of the upper level together; words[p]: the code words of subspace p."""

    cells: np.ndarray
    starts: np.ndarray
    centres: np.ndarray
    words: np.ndarray
    width: int

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int) -> Index:
        """sample: unit vectors as float32."""
        rng = np.random.default_rng(SEED)
        lists = max(1, min(lists, len(sample)))
        cells = _means(sample, math.ceil(math.sqrt(lists)) if lists > 256 else 1, rng)
        cell, centres = _nearest(sample, cells), []
        for c in range(len(cells)):
            own = sample[cell == c]
            centres.append(_means(own, max(1, round(lists * len(own) / len(sample))), rng) if len(own) else cells[c : c + 1])
        starts, centres = np.cumsum([0, *map(len, centres)]), np.concatenate(centres)
        index = cls(cells, starts, centres, np.zeros(0), sample.shape[1])
        rest = index.parts(sample - centres[index.places(sample)[0]])
        index.words = np.zeros((rest.shape[1], min(WORDS, len(sample)), rest.shape[2]), np.float32)
        for p in range(rest.shape[1]):
            index.words[p] = _means(rest[:, p], index.words.shape[1], rng)
        return index

    def parts(self, x: np.ndarray) -> np.ndarray:
        """Rows, subspaces, components; filled up with zeros."""
        n = min(PARTS, x.shape[1])
        return np.pad(x, ((0, 0), (0, -x.shape[1] % n))).reshape(len(x), n, -1)

    def places(self, x: np.ndarray, margin: float = 0.0, delta: float = 0.0) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each vector's list, and the other lists that it asks: by the margin, or half of delta for centres within delta."""
        out, asked = np.empty(len(x), np.int64), []
        width = np.diff(self.starts)
        for at in range(0, len(x), 256):
            rows = x[at : at + 256]
            cells = np.argpartition(((self.cells * self.cells).sum(1) - 2 * rows @ self.cells.T), min(CELLS, len(self.cells)) - 1, axis=1)[:, :CELLS]
            ok = np.zeros((len(rows), len(self.centres)), bool)
            if len(self.cells) <= CELLS:
                ok[:] = True
            else:
                for i, own in enumerate(cells):
                    for c in own:
                        ok[i, self.starts[c] : self.starts[c] + width[c]] = True
            some = np.flatnonzero(ok.any(0))
            centres = self.centres[some]
            far = np.where(ok[:, some], (centres * centres).sum(1) - 2 * rows @ centres.T, np.inf)
            near = far.argmin(1)
            more = far - far[np.arange(len(rows)), near][:, None]
            # no two centres are farther apart than 2, as they are means of unit vectors
            i, j = np.nonzero(more <= max(4 * margin, delta * delta))
            apart = np.sqrt(((centres[j] - centres[near[i]]) ** 2).sum(1))
            ask = (more[i, j] <= 2 * apart * np.where(apart <= delta, max(delta / 2, margin), margin)) & (j != near[i])
            out[at : at + 256] = some[near]
            asked += np.split(some[j[ask]], np.searchsorted(i[ask], np.arange(1, len(rows))))
        return out, asked

    def codes(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code words of the residuals, and how far each vector is from what its code says."""
        rest = self.parts(x - self.centres[lists])
        codes = np.stack([_nearest(rest[:, p], self.words[p]) for p in range(rest.shape[1])], 1).astype(np.uint8)
        lost = sum(((rest[:, p] - self.words[p][codes[:, p]]) ** 2).sum(1) for p in range(rest.shape[1]))
        return codes, np.sqrt(lost)

    def distances(self, x: np.ndarray, one: int, codes: np.ndarray) -> np.ndarray:
        """Distances of asking vectors from a list's codes, by table lookup."""
        rest = self.parts(x - self.centres[one]).transpose(1, 0, 2)
        tables = (rest**2).sum(2)[:, :, None] - 2 * rest @ self.words.transpose(0, 2, 1) + (self.words**2).sum(2)[:, None, :]
        total = np.zeros((len(x), len(codes)), np.float32)
        for p, table in enumerate(tables):
            total += table[:, codes[:, p]]
        return np.sqrt(np.maximum(total, 0))


def _units(values: list[bytes], kind: str, width: int) -> np.ndarray:
    """Stored components as unit vectors in double precision; shorter ones are filled up with zeros."""
    size = np.dtype(kind).itemsize
    if {len(v) for v in values} == {size * width}:
        out = np.frombuffer(b"".join(values), kind).reshape(len(values), width).astype(np.float64)
    else:
        out = np.zeros((len(values), width))
        for i, v in enumerate(values):
            out[i, : len(v) // size] = np.frombuffer(v, kind)
    out /= np.abs(out).max(1, initial=0)[:, None]  # squares neither overflow nor vanish
    return out / np.sqrt((out * out).sum(1))[:, None]


def _packed(rows: DataFrame, kind: str) -> DataFrame:
    """vec_id, vec: the components as bytes, without zeros at the end; null if the vector links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if v is None else np.trim_zeros(v + 0.0, "b") for v in finite_rows(batch.column(1))[0]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.astype(kind).tobytes() if v is not None and len(v) else None for v in found], pa.binary())], ("vec_id", "vec"))

    small_batches(rows.sparkSession)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, vec binary")


def _encoded(nodes: DataFrame, index, kind: str, margin: float, delta: float) -> DataFrame:
    """nodes (id, n, vec) with their list, the lists they ask, their code and its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            if not len(batch):
                continue
            x = _units(batch.column(2).to_pylist(), kind, own.width).astype(np.float32)
            lists, asked = own.places(x, margin, delta)
            codes, lost = own.codes(x, lists)
            columns = [pa.array(lists, pa.int32()), pa.array([a.tolist() for a in asked], pa.list_(pa.int32())), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(lost, pa.float32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], ("id", "n", "vec", "list", "asks", "code", "lost"))

    return nodes.mapInArrow(run, "id long, n long, vec binary, list int, asks array<int>, code binary, lost float")


class _Stored:
    """A block of a list: what asks it is held against its codes, and what is near those against its vectors."""

    def __init__(self, one: int, rows: list[tuple], index: Index, kind: str, similarity: float) -> None:
        self.one, self.index, self.kind, self.similarity = one, index, kind, similarity
        self.delta = math.sqrt(max(0.0, 2 - 2 * similarity))
        self.ids, self.n = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
        self.units = _units([r[3] for r in rows], kind, index.width)
        self.codes = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), -1)
        self.reach = self.delta + np.array([r[5] for r in rows]) + 1e-4  # codes are in single precision
        asks = [np.array(r[6], np.int64) for r in rows]
        self.asks = np.sort(np.concatenate([a * len(rows) + i for i, a in enumerate(asks)])) if rows else np.zeros(0, np.int64)
        self.links = np.zeros(len(rows), np.int64)
        self.part, self.found, self.asked = np.full(len(rows), -1, np.int64), [], []

    def _asks(self, home: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Whether the stored vectors i ask these lists."""
        wanted = home * len(self.ids) + i
        at = np.minimum(np.searchsorted(self.asks, wanted), max(len(self.asks) - 1, 0))
        return self.asks[at] == wanted if len(self.asks) else np.zeros(len(i), bool)

    def ask(self, ids: np.ndarray, n: np.ndarray, home: np.ndarray, units: np.ndarray, inner: bool = False) -> None:
        """inner: these are the stored ones themselves, and a pair counts once."""
        for at in range(0, len(ids), ROWS):
            part = slice(at, at + ROWS)
            row, i = np.nonzero(self.index.distances(units[part].astype(np.float32), self.one, self.codes) <= self.reach)
            if inner:
                row, i = row[i > row + at], i[i > row + at]
            else:
                # two lists that both vectors ask look at the pair in the first of them
                once = (home[part][row] == self.one) | (home[part][row] > self.one) | ~self._asks(home[part][row], i)
                row, i = row[once], i[once]
            near = np.zeros(len(row), bool)
            for some in range(0, len(row), 65536):
                of = slice(some, some + 65536)
                near[of] = np.einsum("ij,ij->i", units[part][row[of]], self.units[i[of]]) >= self.similarity
            row, i = row[near], i[near]
            count = np.bincount(row, self.n[i], min(ROWS, len(ids) - at)).astype(np.int64)
            if inner:
                self.links[at : at + len(count)] += count
            else:
                self.asked += [(int(a), int(c)) for a, c in zip(ids[part], count, strict=True) if c]
            self.links += np.bincount(i, n[part][row], len(self.ids)).astype(np.int64)
            edges = np.searchsorted(row, np.arange(len(count) + 1))
            for r in np.flatnonzero(np.diff(edges)):
                self._join(int(ids[at + r]), i[edges[r] : edges[r + 1]], at + r if inner else None)

    def _join(self, x: int, near: np.ndarray, place: int | None) -> None:
        """Links of a forest: from x to one vector of each part that it touches, which are one part then."""
        own = near if place is None else np.append(near, place)
        parts = self.part[own]
        alone, old = own[parts < 0], np.unique(parts[parts >= 0])
        ends = [int(self.ids[j]) for j in alone] + [int(self.ids[p]) for p in old]
        self.found += [(x, e) for e in ends if e != x]
        now = int(old[0]) if len(old) else int(own[0])
        for p in old[1:]:
            self.part[self.part == p] = now
        self.part[alone] = now

    def result(self) -> Iterator[pa.RecordBatch]:
        rows = [*((0, a, c) for a, c in self.asked), *((0, int(a), int(c)) for a, c in zip(self.ids, self.links, strict=True) if c), *((1, a, b) for a, b in self.found)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ("kind", "a", "b"))


def _linked(batches: Iterator[pa.RecordBatch], index, kind: str, similarity: float) -> Iterator[pa.RecordBatch]:
    """Sorted (key, role, id, n, list, vec, code, lost, asks, one, first) rows, a key's stored vectors (role 0) before those that ask:
    (0, id, its links here) and (1, a, b) of a forest."""
    now, stored, block, asking = None, [], None, []

    def step() -> None:
        nonlocal block, asking
        if stored and block is None:
            block = _Stored(stored[0][7], stored, index.value, kind, similarity)
            if stored[0][8]:
                block.ask(block.ids, block.n, np.full(len(stored), block.one), block.units, inner=True)
        if block is not None and asking:
            block.ask(*(np.array([r[i] for r in asking], np.int64) for i in (0, 1, 2)), _units([r[3] for r in asking], kind, index.value.width))
        asking = []

    def end() -> Iterator[pa.RecordBatch]:
        step()
        if block is not None:
            yield from block.result()

    for batch in batches:
        for key, role, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != now:
                yield from end()
                now, stored, block, asking = key, [], None, []
            (asking if role else stored).append(row)
            if len(asking) >= 1024:
                step()
    yield from end()


def _pairs(encoded: DataFrame, index, kind: str, similarity: float, block: int) -> DataFrame:
    """kind, a, b as _linked returns them, over all lists."""
    visits = encoded.withColumn("one", F.explode("asks")).select("one", F.lit(0).alias("home"), F.lit(1).alias("visit"))
    sizes = encoded.select(F.col("list").alias("one"), F.lit(1).alias("home"), F.lit(0).alias("visit")).unionByName(visits).groupBy("one").agg(F.sum("home").alias("home"), F.sum("visit").alias("visit"))
    stores = F.ceil(F.col("home") / block).cast("int").alias("stores")
    # those that stand in a list of several blocks ask the blocks before their own
    askers = F.greatest(F.ceil((F.col("visit") + F.when(F.col("home") > block, F.col("home")).otherwise(0)) / block), F.lit(1)).cast("int").alias("askers")
    sizes = F.broadcast(stash(sizes.where("home > 0").select("one", stores, askers), "lists"))  # a row a list: LIST_VALUES at most
    s, a = F.pmod(F.xxhash64("id"), F.col("stores")).cast("int"), F.pmod(F.xxhash64(F.lit("asks"), "id"), F.col("askers")).cast("int")
    at_home = encoded.withColumn("one", F.col("list")).join(sizes, "one").withColumn("s", s)
    numbers = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("code", "binary"), ("lost", "float"), ("asks", "array<int>"))]
    key = F.xxhash64("one", "s", "a").alias("key")
    columns = ["id", "n", "list", "vec"]
    stored = at_home.withColumn("a", numbers(F.col("askers"))).select(key, F.lit(0).alias("role"), *columns, "code", "lost", "asks", "one", (F.col("a") == 0).alias("first"))
    before = at_home.where("s > 0").withColumn("a", a).withColumn("s", numbers(F.col("s")))
    visiting = encoded.withColumn("one", F.explode("asks")).join(sizes, "one").withColumn("a", a).withColumn("s", numbers(F.col("stores")))
    asking = [x.select(key, F.lit(1).alias("role"), *columns, *none, "one", F.lit(False).alias("first")) for x in (before, visiting)]
    n = int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored.unionByName(asking[0]).unionByName(asking[1])
    rows = rows.repartition(n, "key").sortWithinPartitions("key", "role").select("key", "role", "id", "n", "list", "vec", "code", "lost", "asks", "one", "first")
    return rows.mapInArrow(lambda batches: _linked(batches, index, kind, similarity), "kind long, a long, b long")


def near_vectors(
    rows: DataFrame, similarity: float = SIMILARITY, list_rows: int = LIST_ROWS, block: int = BLOCK, sigmas: float = SIGMAS, sample_rows: int = SAMPLE
) -> DataFrame:
    """vec_id, n_links, component_id, kept of each vector of rows (vec_id, embedding): links are pairs found with a cosine of
    `similarity` or more, in double precision.

    Vectors that are null, zero or hold null or non-finite components link with nothing and are kept. A repeated vec_id counts
    once (the least row); rows without a vec_id are one row each, without links or component and not kept; equal vectors
    link with each other; shorter vectors are filled up with zeros; other columns are not carried; an empty table gives an
    empty result.
    """
    spark = rows.sparkSession
    of = rows.schema["embedding"].dataType
    kind = "<f8" if isinstance(of, ArrayType) and isinstance(of.elementType, DoubleType) else "<f4"
    packed = stash(_packed(rows, kind), "packed")
    ready = one_row_per_id(packed.where("vec_id is not null"))
    marks = [F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit("second"), "vec").alias("h2")]
    able = ready.where("vec is not null").select("vec_id", "vec", *marks)
    nodes = stash(able.groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("vec").alias("vec")), "nodes")
    total, size = nodes.agg(F.count("*"), F.coalesce(F.max(F.length("vec")), F.lit(0))).first()
    alone = packed.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"), F.lit(False).alias("kept"))
    own = ready.select("vec_id", *(F.when(F.col("vec").isNotNull(), m).alias(a) for m, a in zip(marks, ("h1", "h2"), strict=True)))
    if not total:
        return own.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")).unionByName(alone)
    width = size // np.dtype(kind).itemsize
    lists = max(1, min(math.ceil(total / list_rows), LIST_VALUES // width))
    wanted = min(sample_rows, SAMPLE_LIST * max(lists, WORDS), max(1, 64 * LIST_VALUES // width))
    share = min(1.0, wanted / total)
    drawn = nodes.where(F.pmod(F.xxhash64("h1"), F.lit(1 << 30)) < max(1, round(share * (1 << 30)))).select("vec").collect() or nodes.select("vec").limit(1).collect()
    index = spark.sparkContext.broadcast(Index.fit(_units([bytes(r.vec) for r in drawn], kind, width).astype(np.float32), lists))
    delta = math.sqrt(max(0.0, 2 - 2 * similarity))
    margin = delta / 2 * min(1.0, sigmas / math.sqrt(width)) + 1e-6
    encoded = stash(_encoded(nodes.select("id", "n", "vec"), index, kind, margin, delta), "encoded")
    met = stash(_pairs(encoded, index, kind, similarity, block), "links")
    links = met.where("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("links"))
    of_component = components(met.where("kind = 1").select("a", "b")).select(F.col("node").alias("id"), "component")
    facts = nodes.select("h1", "h2", "id", "n").join(links, "id", "left").join(of_component, "id", "left")
    facts = facts.select(F.struct("h1", "h2").alias("mark"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"), "n")
    out = join_hubs(own.where("h1 is not null").select("vec_id", F.struct("h1", "h2").alias("mark")), stash(facts, "facts"), "mark", "n", ready.count())
    out = out.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    unable = own.where("h1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(unable).unionByName(alone)
