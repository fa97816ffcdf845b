"""Best-fit packing of tokenised documents by linear grouping.

Lengths are integers up to the capacity, so their histogram has at most `capacity` entries however many documents there
are. The plan is made from that histogram on the driver; documents only look up their place in it by their rank among
documents of the same length.

1. Large lengths (over a fraction of the capacity) are sorted and cut into groups of equal cardinality; each length counts as
   its group's largest (linear grouping).
2. The few sizes that remain are packed by configurations: a linear programme over bin patterns, solved by column
   generation with a knapsack for pricing; multiplicities are rounded down.
3. Actual documents take the places of their group's size, which leaves slack in the bins.
4. What is left over, and all small documents, go by best fit, longest first, into the tightest bin that has room.
"""

from __future__ import annotations

import json
import logging
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import small_batches, stash

CAPACITY = 4096
END_ID = 1
#: Equal-cardinality groups of the large lengths.
GROUPS = 40
#: A length is large if it is over capacity / k; the plan with the fewest sequences over these k is taken.
LARGE_PARTS = (2, 3, 8)
#: Words whose ids a worker keeps, besides the latest batch's; over that, those not met again go.
CACHE_WORDS = 600_000
_MAX_ROUNDS = 1500
_LOG = logging.getLogger(__name__)
_KEY_SHIFT = 44  # a rank within a length stays below 2^44

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


# --- tokens -----------------------------------------------------------------------------------------------------------


class WordIds:
    """The ids of texts by their words without white space; ids of words seen lately are kept.

    The tokenizer drops white space and no rule of it reaches across, so a text's ids are its words' ids in a row. Words are
    split, told apart and looked up in Arrow. Those that are new are encoded together, by the same merges over pre-tokens that
    are made here: a pre-token's last id, and no other, ends a word, so the ids of a row of words can be told apart. Words of
    unusual signs, and texts that hold the string of a special token, take the tokenizer's whole path.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        # fixed values: the pre-tokens of this tokenizer's file
        self.pre_tokens = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        # letters of these scripts stay one letter each when lower-cased and composed
        self.plain = re.compile(r"[\x21-\x7e\u00a1-\u012f\u0132-\u024f]{1,64}")
        # byte-level letters: printable bytes stand for themselves, the others for the letters from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.letters = {b: 256 + i for i, b in enumerate(others)} | {32: 32}
        made = json.loads(self.tokenizer.to_str())
        self.special = "|".join(re.escape(t["content"]) for t in made["added_tokens"])
        self.merges = Tokenizer.from_str(json.dumps(made | {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}))
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        # what is kept: words, each one's start and length in the pool of ids, and whether it was met again
        self.known = pa.array([], pa.string())
        self.start, self.length, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")
        self.again = np.zeros(0, bool)

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and length of each word's ids, and the ids."""
        start, length = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        plain, odd = [], []
        for i, word in enumerate(words):
            (plain if self.plain.fullmatch(word) else odd).append(i)
        ascii_words = [i for i in plain if words[i].isascii()]  # printable ASCII stands for itself, the others are mapped
        n_ascii = len(ascii_words)
        plain = ascii_words + [i for i in plain if not words[i].isascii()]
        pre, parts = [], []
        for word in " ".join([words[i] for i in plain]).lower().split(" ") if plain else ():
            if word.isalpha():
                pre.append(word)
                parts.append(1)
            else:
                own = self.pre_tokens.findall(word)
                pre += own
                parts.append(len(own))
        n = sum(parts[:n_ascii])
        text = " ".join(pre[:n]) + " " + " ".join(pre[n:]).encode().decode("latin-1").translate(self.letters)
        ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1 if len(ids) else np.zeros(0, np.int64)
        if len(ends) != len(pre):  # a tokenizer of another make: each word for itself
            odd, plain, ids = odd + plain, [], ids[:0]
        if plain:
            cuts = np.concatenate(([0], ends[np.cumsum(parts) - 1]))
            start[plain], length[plain] = cuts[:-1], np.diff(cuts)
        pool, at = [ids], len(ids)
        for i in odd:
            own = np.frombuffer(self.encode(words[i]), "<u4")
            start[i], length[i] = at, len(own)
            at += len(own)
            pool.append(own)
        return start, length, np.concatenate(pool).astype("<u4")

    def texts(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, as little-endian 32-bit bytes."""
        texts = pc.fill_null(texts, "")
        whole: dict[int, str] = {}
        if self.special:
            held = pc.match_substring_regex(texts, self.special)
            whole = {int(i): texts[int(i)].as_py() for i in np.flatnonzero(held.to_numpy(zero_copy_only=False))}
            texts = pc.if_else(held, "", texts) if whole else texts
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        place = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.again[place[place >= 0]] = True
        new = coded.dictionary.filter(pa.array(place < 0))
        place[place < 0] = len(self.known) + np.arange(len(new))
        start, length, pool = self.encode_words(new.to_pylist())
        self.start, self.length = np.concatenate((self.start, start + len(self.pool))), np.concatenate((self.length, length))
        self.known, self.pool = pa.concat_arrays([self.known, new]), np.concatenate((self.pool, pool))
        self.again = np.concatenate((self.again, np.zeros(len(new), bool)))
        start, length, pool = self.start[place], self.length[place], self.pool
        if len(self.known) > CACHE_WORDS:  # words that were not met again go
            self.known = self.known.filter(pa.array(self.again))
            self.pool = _taken(self.pool, self.start[self.again], self.length[self.again])
            self.length = self.length[self.again]
            self.start = np.cumsum(self.length) - self.length
            self.again = np.zeros(len(self.known), bool)
        at = coded.indices.to_numpy()
        cuts = split.offsets.to_numpy() - split.offsets[0].as_py()
        for lo in range(0, len(cuts) - 1, 64):  # so that what is made of some texts stays in the processor's cache
            own = cuts[lo : lo + 65]
            word = at[own[0] : own[-1]]
            ids = _taken(pool, start[word], length[word])
            edges = np.concatenate(([0], np.cumsum(length[word])))[own - own[0]].tolist()
            for row, (a, b) in enumerate(zip(edges, edges[1:], strict=False), lo):
                yield self.encode(whole[row]) if row in whole else ids[a:b].tobytes()


def _taken(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The pool's stretches in a row."""
    ends = np.cumsum(length)
    return pool[np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)]


_words: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most `capacity` tokens of each document, with their checksum; nth counts a task's pieces of a length."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seen = word_ids(tokenizer_path), TaskContext.get().partitionId(), {}
        for batch in batches:
            out: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), words.texts(batch.column(1)), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    nth = seen.get(n, 0)
                    seen[n] = nth + 1
                    out.append((doc, piece, at // 4, n, zlib.crc32(own), part, nth))
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                names = ("doc_id", "piece", "start", "length", "ids_crc32", "part", "nth")
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


# --- the plan ---------------------------------------------------------------------------------------------------------


def group_sizes(hist: dict[int, int], groups: int) -> list[tuple[int, list[list[int]]]]:
    """(size, [[length, count], ...] longest first) of each equal-cardinality group; groups of one size are merged."""
    total = sum(hist.values())
    per, out, room = max(1, -(-total // groups)), [], 0
    for length in sorted(hist, reverse=True):
        count = hist[length]
        while count:
            if not room:
                if out and out[-1][0] == length:
                    room = count  # a size once opened takes all of its length
                else:
                    out.append((length, []))
                    room = per
            take = min(room, count)
            own = out[-1][1]
            if own and own[-1][0] == length:
                own[-1][1] += take
            else:
                own.append([length, take])
            room, count = room - take, count - take
    return out


def knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern of any multiplicities within the capacity."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    sizes, worth = sizes[order], worth[order]
    fits = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(int(sizes[0]), capacity + 1):
        n = fits[c]
        value = best[c - sizes[:n]] + worth[:n]
        i = int(value.argmax())
        if value[i] > best[c - 1] + 1e-12:
            best[c], pick[c] = value[i], i
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[order[pick[c]]] += 1
            c -= int(sizes[pick[c]])
    return float(best[capacity]), counts


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns (copies of each size) and how many bins have each: the linear programme's basis, rounded down."""
    s, need = np.array(sizes), np.array(demand, float)
    basis = np.diag((capacity // s).astype(float))
    x = need / np.diag(basis)
    for _ in range(_MAX_ROUNDS):  # what is then best packs everything as well, only less tightly
        prices = np.linalg.solve(basis.T, np.ones(len(s)))
        value, pattern = knapsack(s, np.maximum(prices, 0), capacity)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, pattern)
        ratio = np.where(step > 1e-10, x / np.where(step > 1e-10, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = pattern
        x = np.maximum(np.linalg.solve(basis, need), 0)
    else:
        _LOG.warning("column generation stopped after %d rounds for %d sizes: the plan may be less tight", _MAX_ROUNDS, len(s))
    plan, left = [], np.array(demand, dtype=np.int64)
    for j in np.argsort(-x):
        pattern = np.rint(basis[:, j]).astype(np.int64)
        used = pattern > 0
        bins = int(min(np.floor(x[j] + 1e-7), (left[used] // pattern[used]).min())) if used.any() else 0
        if bins > 0:
            left -= pattern * bins
            plan.append((pattern, bins))
    return plan


def plan_packing(hist: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[dict[str, np.ndarray], int]:
    """The plan of the fewest sequences over the bounds of LARGE_PARTS."""
    return min((_plan(hist, capacity, groups, capacity // k) for k in LARGE_PARTS), key=lambda plan: plan[1])


def _plan(hist: dict[int, int], capacity: int, groups: int, bound: int) -> tuple[dict[str, np.ndarray], int]:
    """Runs that place every piece, and the number of sequences.

    A run says of the ranks from `rank` on among pieces of `length`: `per` of them lie side by side in each sequence from
    `sequence` on, the first at `offset`.
    """
    left = {k: v for k, v in hist.items() if v}
    large = {k: v for k, v in left.items() if k > bound}
    bins: dict[int, list[tuple[int, list]]] = {}  # free room -> [(bins, [(length, copies), ...])]

    def add(free: int, n: int, items: list) -> None:
        bins.setdefault(free, []).append((n, items))

    if large:
        grouped = group_sizes(large, groups)
        members = [own for _, own in grouped]
        for pattern, n in configurations([size for size, _ in grouped], [sum(c for _, c in own) for own in members], capacity):
            # each place of the pattern takes n documents of its group; a stretch of bins with the same lengths is kept as one
            places, cuts = [], {0, n}
            for g in np.repeat(np.arange(len(pattern)), pattern):
                took, need = [], n
                while need:
                    length, count = members[g][0]
                    take = min(need, count)
                    need -= take
                    members[g][0][1] -= take
                    if not members[g][0][1]:
                        members[g].pop(0)
                    left[length] -= take
                    took.append((n - need, length))
                    cuts.add(n - need)
                places.append(took)
            at = [0] * len(places)
            edges = sorted(cuts)
            for lo, hi in zip(edges, edges[1:], strict=False):
                own: dict[int, int] = {}
                for k, took in enumerate(places):
                    while took[at[k]][0] <= lo:
                        at[k] += 1
                    own[took[at[k]][1]] = own.get(took[at[k]][1], 0) + 1
                add(capacity - sum(a * b for a, b in own.items()), hi - lo, list(own.items()))
    for length in sorted((k for k, v in left.items() if v), reverse=True):
        count, free = left[length], length
        while count:
            while free <= capacity and not bins.get(free):
                free += 1
            if free > capacity:
                n, items, free = count, [], capacity
            else:
                n, items = bins[free].pop()
            per = free // length
            full = min(n, count // per)
            if full:
                add(free - per * length, full, [*items, (length, per)])
                n, count = n - full, count - full * per
            if n and 0 < count < per:
                add(free - count * length, 1, [*items, (length, count)])
                n, count = n - 1, 0
            if n and items:
                add(free, n, items)
    runs, rank, sequence = [], {}, 0
    for free in sorted(bins):
        for n, items in bins[free]:
            offset = 0
            for length, per in items:
                runs.append((length, rank.get(length, 0), sequence, per, offset))
                rank[length] = rank.get(length, 0) + n * per
                offset += length * per
            sequence += n
    runs.sort()
    columns = np.array(runs, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "sequence", "per", "offset"), columns, strict=True)), sequence


# --- the operator -----------------------------------------------------------------------------------------------------


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, groups: int = GROUPS) -> DataFrame:
    """Pack every document into sequences of at most `capacity` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is one piece that
    holds only the end id; a null doc_id stays null; repeated rows and ties are packed each for itself; other columns are
    not carried; an empty table gives an empty result. Only the histogram of lengths (at most `capacity` rows) comes to the
    driver, and the plan's runs, which number a few times the capacity whatever the input, go out with the tasks.
    """
    pieces = stash(token_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    counts = stash(pieces.groupBy("part", "length").count(), "lengths")
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    runs, _ = plan_packing(hist, capacity, groups)
    key = (runs["length"] << _KEY_SHIFT) + runs["rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            i = np.searchsorted(key, (length << _KEY_SHIFT) + rank, "right") - 1
            into = rank - runs["rank"][i]
            sequence = runs["sequence"][i] + into // runs["per"][i]
            offset = runs["offset"][i] + into % runs["per"][i] * length
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"))

    # the rank of a task's first piece of a length: a running sum over tasks, of at most one row for each task and length
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(first.hint("shuffle_hash"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
