"""SimHash near-duplicates by multi-index hashing.

A fingerprint's bit is 1 if it is set in over half of the XXH64 values (seed 42) of the text's word shingles. Two
fingerprints within 3 differing bits differ in at most one bit in one of their 32-bit halves. So each different fingerprint
is filed under both its halves and under each half with one set bit cleared: of two halves that differ in one bit, one has
it set and meets the other there. Within a bucket whole distances are verified; links of a spanning forest leave it, never
all pairs.

A bucket grows only with the different fingerprints that share a half. Halves shared by more than HOT of them, and the
buckets these reach, are dealt again by a 16-bit half of the other side (same argument: at most 3 bits there, so at most one
in one of its halves), which bounds a bucket by the fingerprints within a few bits of 48 given ones.

Wider links, for near-duplicates by five-word shingles at an estimated similarity of 0.8 (10 bits), go by pairs of fifths:
each fingerprint is filed under any two of its five blocks (26 bits) and under those with one bit changed, on both sides, so
two that differ in at most 2 bits of some two blocks meet. That is certain up to 7 bits, and so for most pairs of 8 to 10.
Pairs of blocks that over HOT fingerprints share are dealt again by a third block in the same manner, which is as certain.

For near-duplicates these links, equal fingerprints and bands of least values are candidates only; what counts is the shingle
sets' similarity. In a bucket of candidates that fits a task, sets are compared there. In a larger one all members, dealt out,
are held against a pivot's set, and what is not alike against the next one's; what is left then is dealt in blocks of sets
that a task holds, each against all members. So memory is bounded, every link of a bucket is found, and a group of copies,
however large, costs its members once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import fresh, join_hubs, small_batches, stash
from marginalia.llm.components import components

SHINGLE = 3
DISTANCE = 3
SEED = 42
#: The same for near-duplicates of 0.8: equal shares of a and b in cos = 2 s / (1 + s), and 64 acos(cos) / pi = 9.7 bits.
WIDE_SHINGLE, WIDE_DISTANCE = 5, 10
#: Start and width of the five blocks.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Near-duplicates share so much of their shingles (Jaccard). Pairs at just that meet in none of the BANDS bands of ROWS least
#: values with p = (1 - 0.8^4)^24 = 3e-6.
SIMILARITY, BANDS, ROWS = 0.8, 24, 4
#: Different fingerprints that share a 32-bit half or a pair of blocks, above which the second level takes over.
HOT = 4096
#: Sets, and their hashes, that a task holds at once; larger buckets go by pivots, PIVOTS of them before blocks.
BUCKET_SETS, BUCKET_HASHES, PIVOTS = 512, 4_000_000, 2
#: Rows of a bucket up to which neighbours in sorted order are compared by shifts.
SHORT = 12

# fixed values: what separates words, and the letters that are lower-cased
_SPACE = bytes([0x20, *range(0x09, 0x0E)])
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_TO_SPACE = bytes(0x20 if c in _SPACE else c for c in _LOWER)
# odd factors, which order the hashes anew
_ORDERS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 values of the text's word shingles, in order; of all its words where they are fewer; none without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_TO_SPACE).split(b" ")
    words = [w for w in words if w] if b"" in words else words
    if not words:
        return np.zeros(0, np.uint64)
    line, n = b" ".join(words), len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return np.array([digest(line, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends[:n] - np.array([len(w) + 1 for w in words[:n]])).tolist()
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes; 0 without any."""
    n = len(hashes)
    if n <= 1:
        return int(hashes[0]) if n else 0
    h = hashes.astype(">u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        counts += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint; 0 without words."""
    return majority(shingle_hashes(text, shingle))


def band_keys(distinct: np.ndarray) -> np.ndarray:
    """A key for each band: a hash of the least values of the shingle hashes under the band's ROWS orders."""
    least = np.full(len(_ORDERS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(distinct), 1024):
        least = np.minimum(least, (distinct[at : at + 1024, None] * _ORDERS).min(0))
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * _MIX
        keys ^= keys >> np.uint64(29)
    return keys


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and bits (the fingerprint as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = _signed([simhash(t, shingle) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), bits], ("doc_id", "bits"))

    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, bits long")


# --- links ------------------------------------------------------------------------------------------------------------


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= distance


def _forest(bits: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join whatever of these is joined by near pairs: at most one less than there are."""
    a, b, left = [], [], bits
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = _near(left, x, distance)
            found = left[near]
            a.append(np.full(len(found), x, np.uint64))
            b.append(found)
            front += list(found)
            left = left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (bits[:0], bits[:0])


def bucket_links(keys: np.ndarray, bits: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys (rows sorted by key)."""
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    size = np.diff(edge)
    length = np.repeat(size, size)
    a, b = [], []
    short = length <= SHORT
    for shift in range(1, min(SHORT, int(size.max(initial=0)))):
        i = np.flatnonzero(short[:-shift] & (keys[:-shift] == keys[shift:]))
        i = i[_near(bits[i], bits[i + shift], distance)]
        a.append(bits[i])
        b.append(bits[i + shift])
    for k in np.flatnonzero(size > SHORT):
        x, y = _forest(np.unique(bits[edge[k] : edge[k + 1]]), distance)
        a.append(x)
        b.append(y)
    return (np.concatenate(a), np.concatenate(b)) if a else (bits[:0], bits[:0])


def _links_of_buckets(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Sorted (key, bits) rows to links; a bucket that runs past a batch's end waits for the next. Links already sent by
    this task are not sent again while they are remembered."""
    keys, bits, sent = np.zeros(0, np.int64), np.zeros(0, np.uint64), set()

    def send(k: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = bucket_links(k, v, distance)
        new = set(zip(np.maximum(a, b).tolist(), np.minimum(a, b).tolist(), strict=True)) - sent
        if len(sent) > 200_000:
            sent.clear()
        sent.update(new)
        if new:
            yield pa.RecordBatch.from_arrays([_signed([x for x, _ in new]), _signed([y for _, y in new])], ("a", "b"))

    for batch in batches:
        keys = np.concatenate((keys, batch.column(0).to_numpy(zero_copy_only=False)))
        bits = np.concatenate((bits, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
        if len(keys) < 50_000:
            continue
        done = int(np.searchsorted(keys, keys[-1], "left"))
        yield from send(keys[:done], bits[:done])
        keys, bits = keys[done:], bits[done:]
    yield from send(keys, bits)


def _bucketed(rows: DataFrame, distance: int = DISTANCE) -> DataFrame:
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(lambda batches: _links_of_buckets(batches, distance), "a long, b long")


def _ball(half, side: int, width: int):
    """Keys of a half: itself and itself with one set bit cleared, tagged with the side."""
    tag = F.lit(side << width).cast("long")
    cleared = F.array(*[F.when(half.bitwiseAND(F.lit(1 << i).cast("long")) != 0, half.bitwiseXOR(F.lit(1 << i).cast("long")).bitwiseOR(tag)) for i in range(width)])
    return F.concat(F.array(half.bitwiseOR(tag)), F.array_compact(cleared))


def links(different: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b) links between different fingerprints (a column bits) that join whatever near pairs join. Null bits and repeated
    rows do no harm; an empty table gives no links."""
    low = F.col("bits").bitwiseAND(F.lit((1 << 32) - 1).cast("long"))
    high = F.shiftrightunsigned("bits", 32)
    halves = different.select("bits", F.explode(F.array(low, high.bitwiseOR(F.lit(1 << 32).cast("long")))).alias("half"))
    counts = halves.groupBy("half").count().where(F.col("count") > hot).select("half")
    crowded = stash(counts, "crowded")
    filed = different.select("bits", F.explode(F.concat(_ball(low, 0, 32), _ball(high, 1, 32))).alias("key"))
    if not crowded.take(1):
        return _bucketed(filed.select("key", "bits"))
    side, own = F.shiftright("half", 32), F.col("half").bitwiseAND(F.lit((1 << 32) - 1).cast("long"))
    reached = crowded.select(F.explode(F.concat(F.when(side == 0, _ball(own, 0, 32)).otherwise(_ball(own, 1, 32)))).alias("key")).distinct()
    first = _bucketed(filed.join(reached, "key", "left_anti").select("key", "bits"))
    # the second level: the key's own half is known up to a bit, the other half is filed by its 16-bit halves
    there = filed.join(reached, "key", "left_semi")
    other = F.when(F.shiftright("key", 32) == 0, high).otherwise(low)
    there = there.select("key", "bits", other.alias("other"))
    low16, high16 = F.col("other").bitwiseAND(F.lit(65535).cast("long")), F.shiftright("other", 16)
    again = there.select("bits", "key", F.explode(F.concat(_ball(low16, 0, 16), _ball(high16, 1, 16))).alias("part"))
    # the key and its part make 50 bits
    second = _bucketed(again.select((F.shiftleft("key", 17).bitwiseOR(F.col("part"))).alias("key"), "bits"))
    return first.unionByName(second)


_PAIRS = tuple(combinations(range(len(BLOCKS)), 2))


def _block(i: int):
    return F.shiftrightunsigned("bits", BLOCKS[i][0]).bitwiseAND(F.lit((1 << BLOCKS[i][1]) - 1).cast("long"))


def _pair(n: int):
    """The key of the n-th pair of blocks."""
    i, j = _PAIRS[n]
    return F.shiftleft(_block(i), BLOCKS[j][1]).bitwiseOR(_block(j)).bitwiseOR(F.lit(n << 26).cast("long"))


def _changes(width: int):
    """Masks of no bit and of each one bit."""
    return F.array(*[F.lit(m).cast("long") for m in (0, *(1 << b for b in range(width)))])


def _pair_width(n: int) -> int:
    return sum(BLOCKS[i][1] for i in _PAIRS[n])


def wide_keys(different: DataFrame) -> DataFrame:
    """key, bits: each fingerprint under each pair of its blocks, and under those with one bit changed."""
    keys = [F.transform(_changes(_pair_width(n)), _pair(n).bitwiseXOR) for n in range(len(_PAIRS))]
    return different.select("bits", F.explode(F.concat(*keys)).alias("key")).select("key", "bits")


def wide_links(different: DataFrame, distance: int = WIDE_DISTANCE, hot: int = HOT) -> DataFrame:
    """(a, b) links between different fingerprints (a column bits) up to `distance` bits apart, by pairs of fifths.

    Null bits and repeated rows do no harm; an empty table gives no links.
    """
    pairs = different.select(F.explode(F.array(*map(_pair, range(len(_PAIRS))))).alias("pair"))
    crowded = stash(pairs.groupBy("pair").count().where(F.col("count") > hot).select("pair"), "crowded")
    filed = wide_keys(different)
    if not crowded.take(1):
        return _bucketed(filed, distance)
    number = F.shiftright("pair", 26)
    widths = sorted({_pair_width(n) for n in range(len(_PAIRS))})
    masks = F.coalesce(*[F.when(number.isin([n for n in range(len(_PAIRS)) if _pair_width(n) == w]), _changes(w)) for w in widths])
    reached = crowded.select(F.explode(F.transform(masks, lambda m: F.col("pair").bitwiseXOR(m))).alias("key")).distinct()
    first = _bucketed(filed.join(reached, "key", "left_anti").select("key", "bits"), distance)
    # the second level: up to 2 bits of the pair differ, so of 7 bits in all at most 2 in one of the other three blocks
    others = F.array(*[F.array(*[F.lit(k) for k in range(len(BLOCKS)) if k not in pair]) for pair in _PAIRS])
    there = filed.join(reached, "key", "left_semi")
    there = there.select("key", "bits", F.explode(F.element_at(others, (F.shiftright("key", 26) + 1).cast("int"))).alias("k"))
    value = F.element_at(F.array(*map(_block, range(len(BLOCKS)))), F.col("k") + 1)
    masks = F.coalesce(*[F.when(F.col("k").isin([k for k in range(len(BLOCKS)) if BLOCKS[k][1] == w]), _changes(w)) for w in sorted({w for _, w in BLOCKS})])
    again = there.select("bits", F.explode(F.transform(masks, lambda m: F.xxhash64("key", "k", value.bitwiseXOR(m)))).alias("key"))
    return first.unionByName(_bucketed(again.select("key", "bits"), distance))


# --- verified links ---------------------------------------------------------------------------------------------------


def _alike(marks: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join whatever of these sets is joined by pairs of the similarity: each set met is held against all left."""
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum([len(x) for x in sets])
    starts = ends - np.array([len(x) for x in sets])
    has, so_far = np.zeros(len(ids) + 1, bool), np.zeros(len(ids) + 1, np.int64)
    out, left = [], np.arange(len(sets))
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            own = ids[starts[x] : ends[x]]
            has[own] = True
            np.cumsum(has[ids], out=so_far[1:])
            has[own] = False
            both = so_far[ends[left]] - so_far[starts[left]]
            near = both / np.maximum(len(own) + ends[left] - starts[left] - both, 1) >= similarity
            out += [(int(marks[y]), int(marks[x])) for y in left[near]]
            front += list(left[near])
            left = left[~near]
    return out


def _verified(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Sorted (key, mark, hashes) rows to links; a bucket that runs past a batch's end waits for the next."""
    key, held = None, {}

    def send() -> Iterator[pa.RecordBatch]:
        if len(held) > 1:
            marks = sorted(held)
            found = _alike(np.array(marks), [np.frombuffer(held[m], np.uint64) for m in marks], similarity)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ("a", "b"))

    for batch in batches:
        for k, mark, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                yield from send()
                key, held = k, {}
            held[mark] = hashes
    yield from send()


def _held_against(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Sorted (key, part, member, mark, hashes) rows, the held sets of a (key, part) before its members: key, mark, other of
    members that are alike a held set (of several, those that join what this part has not joined yet), and key, mark, null of
    the others."""
    now, held, ready = None, [], None
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def prepare() -> tuple[np.ndarray, ...]:
        """All held hashes in order, the set each is of, and the sets' sizes."""
        sizes = np.array([len(h) for _, h in held], np.int64)
        every = np.concatenate([h for _, h in held]) if held else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        return every[order], np.repeat(np.arange(len(held)), sizes)[order], sizes

    for batch in batches:
        out: list[tuple[int, int, int | None]] = []
        for key, part, member, mark, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (key, part) != now:
                now, held, ready, parent = (key, part), [], None, {}
            own = np.frombuffer(hashes, np.uint64)
            if not member:
                held.append((mark, own))
                continue
            ready = ready or prepare()
            every, owner, sizes = ready
            lo, hi = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
            n = hi - lo
            ends = np.cumsum(n)
            both = np.bincount(owner[np.repeat(hi - ends, n) + np.arange(ends[-1] if len(ends) else 0)], minlength=len(held))
            near = np.flatnonzero(both / np.maximum(len(own) + sizes - both, 1) >= similarity)
            alike = False
            for i in near.tolist():
                other = held[i][0]
                if other != mark:
                    alike = True
                    a, b = root(mark), root(other)
                    if a != b:
                        parent[a] = b
                        out.append((key, mark, other))
            if not alike:
                out.append((key, mark, None))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ("key", "mark", "other"))


def _compared(held: DataFrame, members: DataFrame, sets: DataFrame, similarity: float, label: str) -> DataFrame:
    """held and members (key, part, mark) with their sets, part by part; a table of (key, mark, other)."""
    rows = held.select("key", "part", F.lit(0).alias("member"), "mark").unionByName(members.select("key", "part", F.lit(1).alias("member"), "mark"))
    rows = rows.join(sets, "mark").select("key", "part", "member", "mark", "hashes")
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "key", "part").sortWithinPartitions("key", "part", "member", "mark")
    return stash(dealt.mapInArrow(lambda batches: _held_against(batches, similarity), "key long, mark long, other long"), label)


def _large_bucket_links(members: DataFrame, sets: DataFrame, similarity: float, size: int, pivots: int) -> DataFrame:
    """(a, b) links that join whatever alike pairs join in buckets of any size: members (key, mark, size, parts: how many tasks may
    share the bucket), sets (mark, hashes)."""
    own = F.pmod(F.xxhash64("mark"), F.col("parts"))
    every = lambda: F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    left, found = members, []
    for _ in range(pivots):
        pivot = left.groupBy("key").agg(F.min("mark").alias("mark"), F.max("parts").alias("parts"))
        seen = _compared(pivot.select("key", "mark", every()), left.select("key", "mark", own.alias("part")), sets, similarity, "pivoted")
        found.append(seen.where("other is not null"))
        alone = seen.where("other is null").join(pivot.select("key", "mark"), ["key", "mark"], "left_anti").select("key", "mark")
        left = stash(left.join(alone, ["key", "mark"], "left_semi"), "unlike")
        if not left.take(1):
            break
    else:
        # blocks of what is left, each against all members of its bucket
        blocks = left.groupBy("key").agg(_tasks(F.count("*"), F.sum("size"), size).alias("blocks"))
        block = left.join(blocks, "key").select("key", "mark", "parts", F.pmod(F.xxhash64("mark", F.lit("block")), F.col("blocks")).alias("block"))
        held = block.select(F.xxhash64("key", "block").alias("key"), "mark", every())
        against = members.join(blocks, "key").select("key", "mark", own.alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        seen = _compared(held, against.select(F.xxhash64("key", "block").alias("key"), "mark", "part"), sets, similarity, "blocks")
        found.append(seen.where("other is not null"))
    links_ = found[0]
    for more in found[1:]:
        links_ = links_.unionByName(more)
    return links_.select(F.col("mark").alias("a"), F.col("other").alias("b"))


def _tasks(sets, hashes, size: int):
    """Among how many tasks so many sets, of so many hashes, are dealt."""
    return F.ceil(F.greatest(sets / size, hashes / BUCKET_HASHES)).cast("long")


def _text_hash():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_hash, mark (a hash of the set of shingles), its size, bits and band keys of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            marks, sizes, bits, keys = [], [], [], []
            for text in batch.column(2).to_pylist():
                hashes = shingle_hashes(text, shingle)
                distinct = np.unique(hashes)
                marks.append(xxhash.xxh64_intdigest(distinct.tobytes(), SEED))
                sizes.append(len(distinct))
                bits.append(majority(hashes))
                keys.append(band_keys(distinct).view(np.int64))
            columns = [_signed(marks), pa.array(sizes, pa.int64()), _signed(bits), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ("doc_id", "text_hash", "mark", "size", "bits", "keys"))

    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("text_hash"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, text_hash long, mark long, size long, bits long, keys array<bigint>")


def _filed(nodes: DataFrame, distance: int) -> DataFrame:
    """key, mark, size: candidates share a key. Keys are a set's bands, its fingerprint, and of links between fingerprints the
    least neighbour, under which it stands itself too; so a set has few keys, however large its group."""
    bands = nodes.select(F.explode("keys").alias("key"), "mark", "size")
    same = nodes.select(F.xxhash64(F.lit("bits"), "bits").alias("key"), "mark", "size")
    of = stash(nodes.groupBy("bits").agg(F.min(F.struct("mark", "size")).alias("set")), "marks")
    wide = stash(wide_links(of.select("bits"), distance).groupBy(F.greatest("a", "b").alias("bits")).agg(F.min(F.least("a", "b")).alias("to")), "wide")
    ends = wide.unionByName(wide.select(F.col("to").alias("bits"), "to").distinct())
    linked = ends.join(of, "bits").select(F.xxhash64(F.lit("link"), "to").alias("key"), "set.mark", "set.size")
    return bands.unionByName(same).unionByName(linked)


def _least_rows(docs: DataFrame, shingle: int, distance: int, similarity: float, size: int, pivots: int) -> DataFrame:
    """doc_id, text_hash, n: the least row of each component and how often it stands there (ids come before none)."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signed = stash(_signatures(docs, shingle), "signed")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    nodes = stash(signed.groupBy("mark").agg(F.min(row).alias("row"), F.min("size").alias("size"), F.min("bits").alias("bits"), F.min("keys").alias("keys")), "nodes")
    filed = stash(_filed(nodes, distance), "filed")
    # buckets of the same members are looked at once
    buckets = filed.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("hashes"), F.bit_xor(F.xxhash64("mark")).alias("members")).where("n > 1")
    buckets = buckets.groupBy("n", "hashes", "members").agg(F.min("key").alias("key"))
    parts = _tasks(F.col("n"), F.col("hashes"), size)
    wanted = stash(filed.join(buckets.select("key", parts.alias("parts")), "key").select("key", "mark", "size", "parts").distinct(), "wanted")
    asked = wanted.groupBy("mark").agg(F.collect_set(F.when(F.col("parts") == 1, F.col("key"))).alias("keys"), (F.max("parts") > 1).alias("large"))
    asked = asked.join(nodes.select("mark", "row.doc_id", "row.text_hash"), "mark").select(F.col("doc_id").alias("_of"), F.col("text_hash").alias("_hash"), "mark", "keys", "large")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("text_hash"), F.col("text").cast("string").alias("text"))
    texts = texts.join(asked, F.col("doc_id").eqNullSafe(F.col("_of")) & (F.col("text_hash") == F.col("_hash"))).select("mark", "keys", "large", "text")

    def spread(batches: Iterator[pa.RecordBatch], of_large: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mark, keys, _, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes = np.unique(shingle_hashes(text, shingle)).tobytes()
                keys = [0] if of_large else keys
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([mark] * len(keys), pa.int64()), pa.array([hashes] * len(keys), pa.binary())], ("key", "mark", "hashes"))

    sets = texts.where(F.size("keys") > 0).mapInArrow(lambda batches: spread(batches, False), "key long, mark long, hashes binary")
    found = sets.repartition(n, "key").sortWithinPartitions("key").mapInArrow(lambda batches: _verified(batches, similarity), "a long, b long")
    large = wanted.where("parts > 1")
    if large.take(1):
        whole = texts.where("large").mapInArrow(lambda batches: spread(batches, True), "key long, mark long, hashes binary")
        # the same set may stand on several rows of an id and text
        whole = stash(whole.groupBy("mark").agg(F.first("hashes").alias("hashes")), "sets")
        found = found.unionByName(_large_bucket_links(large, whole, similarity, size, pivots))
    of = components(found).withColumnRenamed("node", "mark")
    least = nodes.select("mark", "row").join(of, "mark", "left").groupBy(F.coalesce("component", "mark").alias("component")).agg(F.min("row").alias("row"))
    return _counted(signed, least.select("row.doc_id", "row.text_hash"))


def _counted(signed: DataFrame, least: DataFrame) -> DataFrame:
    """doc_id, text_hash, n: these rows and how often each stands in signed."""
    times = signed.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    same = F.col("l.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("l.text_hash") == F.col("t.text_hash"))
    return stash(least.alias("l").join(times.alias("t"), same).select("l.doc_id", "l.text_hash", "n"), "kept")


def _keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs that kept (doc_id, text_hash, n) names, once each, whatever columns docs has. The kept rows grow with the
    documents, so they are dealt out at every size; only they are hashed in memory."""
    of, hashed, times = (fresh(c, docs) for c in ("_of", "_hash", "_times"))
    named = kept.select(F.col("doc_id").alias(of), F.col("text_hash").alias(hashed), F.col("n").alias(times))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & (_text_hash() == F.col(hashed))
    once = docs.join(named.where(F.col(times) == 1).hint("shuffle_hash"), same, "left_semi")
    repeated = named.where(F.col(times) > 1)
    if not repeated.take(1):
        return once
    more = docs.join(repeated, same, "left_semi").withColumn(hashed, _text_hash()).dropDuplicates(["doc_id", hashed]).drop(hashed)
    return once.unionByName(more)


# --- the operator -----------------------------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, hot: int = HOT, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the least doc_id that can be reached by links, a row for each row.

    A text that is null, empty or without words has fingerprint 0 and is linked like any other. Copies meet in their
    fingerprint, which is filed once however many they are. Repeated rows give repeated rows; a null doc_id is no
    component's least, and where a component has no other its id is null; other columns are not carried; an empty table
    gives an empty result. distance is 3, or more for links by pairs of fifths.
    """
    prints = stash(fingerprints(docs, shingle), "prints")
    different = stash(prints.groupBy("bits").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "different")
    # nodes are ordered by fingerprint; which document is a component's least is aggregated after
    made = links(different.select("bits"), hot) if distance <= DISTANCE else wide_links(different.select("bits"), distance, hot)
    of = components(made).withColumnRenamed("node", "bits")
    grouped = stash(different.join(of, "bits", "left").select("bits", "least", "n", F.coalesce("component", "bits").alias("component")), "grouped")
    total = grouped.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    first = grouped.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("k"))
    by_bits = stash(join_hubs(grouped, first, "component", "k", total[0]).select("bits", "component_id", "n"), "by_bits")
    out = join_hubs(prints, by_bits, "bits", "n", total[1])
    return out.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(
    docs: DataFrame, shingle: int = WIDE_SHINGLE, distance: int = WIDE_DISTANCE, similarity: float = SIMILARITY, size: int = BUCKET_SETS, pivots: int = PIVOTS
) -> DataFrame:
    """The rows of docs whose doc_id is their component's least, one for each component; all columns are kept, whatever their names.

    Components are made of pairs that share so much of their sets of shingles (links of fingerprints are candidates only). A
    null text is empty, and all texts without words are copies of each other; a text of fewer words is one shingle. Of rows
    with the same id and text one is kept; rows without a doc_id are kept only where their component has no doc_id at all,
    one for each component then; an empty table gives an empty result.
    """
    return _keep_rows(docs, _least_rows(docs, shingle, distance, similarity, size, pivots))
