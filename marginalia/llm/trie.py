"""The trie of conversations' turn prefixes, by rolling fingerprints.

A prefix of turns has a polynomial fingerprint: the sum of turn hashes times powers of a base, modulo a prime, for two primes.
Numpy scans it over turns that are dealt by range of (conversation, turn), so that a conversation of any length is spread over
tasks; a few carries, two a task at most, join the pieces. As prefixes are sums, the fingerprints of a rebuilt conversation (the
first turns of another one, then its own) follow from those of the two by arithmetic.

Equal depth and fingerprint make a group, the candidate of a node. Its turn is held against that of its representative: the
SHA-256 digests and lengths of all members' turns must have one value. If that holds for all groups, so do, from the root on,
whole prefixes. If not, all groups are split by another pair of fingerprints, with other turn hashes, until it does.

A node belongs to its smallest member, and so a member's nodes are a chain, from some depth down to its end. Sums over subtrees
are those of chains that hang on chains, rolled up to parents by pointer doubling (as many rounds as the logarithm of how
deep chains hang), and then running sums along each chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import join_hubs, small_batches, stash

#: Primes below 2^31, so that products fit in 64 bits; a base for each pair of fingerprints is drawn from the seed.
PRIMES, SEED = (2147483647, 2147483629), 42
#: Pairs of fingerprints after which collisions are an error.
MAX_PAIRS = 8
#: A conversation c takes its first turns, fewer than TAKEN, from c - c % GROUP.
GROUP, TAKEN = 5, 9
#: Depths of a chain that are summed together; ids of a node's ends that are put together at once.
STRETCH, CHUNK = 1024, 4096
MAX_ROUNDS = 60
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _bases(pairs: int) -> list[tuple[int, int]]:
    """(base, prime) of each fingerprint."""
    drawn = np.random.default_rng(SEED).integers(1 << 16, 1 << 30, pairs * len(PRIMES))
    return [(int(b) % (p - 2) + 2, p) for b, p in zip(drawn, PRIMES * pairs, strict=True)]


def _prints(n: int, letter: str = "f") -> list[str]:
    return [f"{letter}{k}" for k in range(n)]


def _hashed(turns: DataFrame, n: int) -> DataFrame:
    """conv_id, turn, g0, g1 (128 bits of the turn's SHA-256), size (its text's bytes) and n hashes of role and text."""
    names = ("conv_id", "turn", "g0", "g1", "size", *_prints(n, "t"))
    primes = [p for _, p in _bases(n // len(PRIMES))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            digests, sizes, hashes = [], [], []
            for role, text in zip(*(c.fill_null("").to_pylist() for c in batch.columns[2:]), strict=True):
                role, text = role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass")
                content = b"%d:%b%b" % (len(role), role, text)
                digests.append(hashlib.sha256(content).digest()[:16])
                sizes.append(len(text))
                hashes.append([xxhash.xxh64_intdigest(content, k) % p for k, p in enumerate(primes)])
            g = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            t = np.array(hashes, np.int64).reshape(-1, n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c) for c in g.T), pa.array(sizes, pa.int64()), *(pa.array(c) for c in t.T)], names)

    small_batches(turns.sparkSession)
    own = turns.select(*(F.col(c).cast("long").alias(c) for c in ("conv_id", "turn")), *(F.col(c).cast("string").alias(c) for c in ("role", "text")))
    return own.where("conv_id is not null").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _scanned(batches: Iterator[pa.RecordBatch], bases: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, g0, g1, size, t..) in order of turns, to those with the task, the place in the task's run of the conversation
    and the run's prefix fingerprints, with (f) and without (e) the turn."""
    task = TaskContext.get().partitionId()
    now, before, carry, powers = None, 0, [0] * len(bases), [1] * len(bases)
    tables = [np.ones(1, np.int64)] * len(bases)
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        conv = batch.column(0).to_numpy(zero_copy_only=False)
        new = np.concatenate(([conv[0] != now], conv[1:] != conv[:-1]))
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        place = np.arange(n) - start
        going = np.cumsum(new) == 0  # the run of the batch before goes on
        with_, without = [], []
        for k, (base, prime) in enumerate(bases):
            while len(tables[k]) < n:
                tables[k] = np.concatenate((tables[k], tables[k] * pow(base, len(tables[k]), prime) % prime))
            x = batch.column(4 + k).to_numpy(zero_copy_only=False) * tables[k][place] % prime
            x = np.where(going, x * powers[k] % prime, x)
            total = np.cumsum(x)
            f = (total - (total - x)[start] + np.where(going, carry[k], 0)) % prime
            with_.append(f)
            without.append((f - x) % prime)
        place = place + np.where(going, before, 0)
        columns = [pa.array(np.full(n, task), pa.int64()), pa.array(place), *map(pa.array, with_), *map(pa.array, without)]
        names = ["part", "place", *_prints(len(bases)), *_prints(len(bases), "e")]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], *columns], ["conv_id", "g0", "g1", "size", *names])
        now, before = conv[-1], int(place[-1]) + 1
        carry, powers = [int(f[-1]) for f in with_], [pow(b, before, p) for b, p in bases]


def _carries(pieces: list[tuple], bases: list[tuple[int, int]]) -> list[tuple]:
    """(conv_id, part, turns before, fingerprints before.., powers..) of the pieces (conv_id, part, n, f..) of conversations that
    several tasks share."""
    out, now = [], None
    for conv, part, n, *prints in sorted(pieces):
        if conv != now:
            now, before, carry = conv, 0, [0] * len(bases)
        powers = [pow(b, before, p) for b, p in bases]
        out.append((conv, part, before, *carry, *powers))
        carry = [(c + f * w) % p for c, f, w, (_, p) in zip(carry, prints, powers, bases, strict=True)]
        before += n
    return out


def prefixes(turns: DataFrame, pairs: int = 1) -> DataFrame:
    """conv_id, pos (from 0), g0, g1, size, and the fingerprints of the conversation's turns with (f0..) and without (e0..) this one."""
    spark, bases = turns.sparkSession, _bases(pairs)
    n = len(bases)
    rows = stash(_hashed(turns, n).withColumn("row", F.monotonically_increasing_id()), "turns")
    order = ["conv_id", "turn", "g0", "g1", "row"]  # equal rows may be dealt apart
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", "g0", "g1", "size", *_prints(n, "t"))
    schema = ", ".join(f"{c} long" for c in ("conv_id", "g0", "g1", "size", "part", "place", *_prints(n), *_prints(n, "e")))
    scanned = stash(dealt.mapInArrow(lambda batches: _scanned(batches, bases), schema), "scanned")
    pieces = scanned.groupBy("conv_id", "part").agg(F.max(F.struct("place", *_prints(n))).alias("last"))
    shared = pieces.groupBy("conv_id").count().where("count > 1").select("conv_id")
    # a task has at most two conversations that others have too
    pieces = [tuple(r) for r in pieces.join(shared, "conv_id", "left_semi").select("conv_id", "part", F.col("last.place") + 1, *(f"last.{f}" for f in _prints(n))).collect()]
    names = ["conv_id", "part", "before", *_prints(n, "c"), *_prints(n, "w")]
    carries = spark.createDataFrame(_carries(pieces, bases), ", ".join(f"{c} long" for c in names))
    joined = scanned.join(F.broadcast(carries), ["conv_id", "part"], "left")
    whole = lambda x, k: F.pmod(F.coalesce(f"c{k}", F.lit(0)) + F.col(f"{x}{k}") * F.coalesce(f"w{k}", F.lit(1)), F.lit(bases[k][1])).alias(f"{x}{k}")
    pos = (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos")
    return joined.select("conv_id", pos, "g0", "g1", "size", *(whole(x, k) for x in "fe" for k in range(n)))


def _facts(turns: DataFrame, n: int, group: int, taken: int) -> DataFrame:
    """What a conversation is rebuilt from, a row each: n turns of its own, all but the first h of which it keeps, the m turns it
    takes (heads), the fingerprints of those (b..), of its own first h (o..) and of all its turns (l..)."""
    prints = _prints(n)
    heads = turns.where(F.col("pos") < taken - 1).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "g0", "g1", "size", *prints, *_prints(n, "e")))).alias("heads"))
    own = turns.groupBy("conv_id").agg(F.max(F.struct("pos", *prints)).alias("last")).join(heads, "conv_id", "left")
    own = stash(own, "heads")
    other = own.select(F.col("conv_id").alias("source"), F.col("heads").alias("given"))
    own = own.withColumn("h", F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(taken)).cast("int")).withColumn("source", F.col("conv_id") - F.col("conv_id") % group)
    own = own.join(other, "source", "left").withColumn("m", F.least("h", F.coalesce(F.size("given"), F.lit(0))))
    at = lambda array, i, f: F.coalesce(F.when(i > 0, F.try_element_at(array, i)[f]), F.lit(0)).cast("long")
    return own.select(
        "conv_id", (F.col("last.pos") + 1).alias("n"), "h", "m", F.when(F.col("m") > 0, F.slice("given", 1, F.greatest("m", F.lit(1)))).alias("heads"),
        *(at(F.col("given"), F.col("m"), f).alias(f"b{k}") for k, f in enumerate(prints)), *(at(F.col("heads"), F.col("h"), f).alias(f"o{k}") for k, f in enumerate(prints)),
        *(F.col(f"last.{f}").alias(f"l{k}") for k, f in enumerate(prints)),
    )


def _moved(f: Column, k: int, bases: list[tuple[int, int]], taken: int) -> Column:
    """The fingerprint of a rebuilt prefix, from that of the conversation's own one."""
    base, prime = bases[k]
    shift = F.array(*[F.lit(pow(base, -i, prime)) for i in range(taken)])[F.col("h") - F.col("m")]
    return F.pmod(F.col(f"b{k}") + F.pmod(f - F.col(f"o{k}"), F.lit(prime)) * shift, F.lit(prime))


def _rebuilt(turns: DataFrame, facts: DataFrame, bases: list[tuple[int, int]], taken: int) -> DataFrame:
    """conv_id, depth, g0, g1, size and fingerprints f.., e.. of the turns of rebuilt conversations."""
    n = len(bases)
    heads = facts.select("conv_id", F.explode("heads").alias("x")).select("conv_id", (F.col("x.pos") + 1).alias("depth"), *(f"x.{c}" for c in ("g0", "g1", "size", *_prints(n), *_prints(n, "e"))))
    total = facts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rest = join_hubs(turns, facts.drop("heads", *_prints(n, "l")).withColumn("weight", F.col("n")), "conv_id", "weight", total).where("pos >= h")
    rest = rest.select("conv_id", (F.col("m") + F.col("pos") - F.col("h") + 1).alias("depth"), "g0", "g1", "size", *(_moved(F.col(f"{x}{k}"), k, bases, taken).alias(f"{x}{k}") for x in "fe" for k in range(n)))
    return heads.unionByName(rest)


def _ends(facts: DataFrame, bases: list[tuple[int, int]], taken: int) -> DataFrame:
    """depth, f.., ends_sha256 of nodes where conversations end. Ids are put together by chunks first, and a node's chunks pass
    through a running digest, in order; none are held."""
    n, prints = len(bases), _prints(len(bases))
    keeps = F.col("n") > F.col("h")
    depth = (F.col("m") + F.when(keeps, F.col("n") - F.col("h")).otherwise(0)).cast("long").alias("depth")
    ends = facts.select("conv_id", depth, *(F.when(keeps, _moved(F.col(f"l{k}"), k, bases, taken)).otherwise(F.col(f"b{k}")).alias(f"f{k}") for k in range(n)))
    chunk = F.floor(F.col("conv_id") / CHUNK).alias("chunk")
    chunks = ends.groupBy("depth", *prints, chunk).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None

        def done(keys: list[tuple], digests: list[str]) -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*keys, strict=True)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.string())], ["depth", *prints, "ends_sha256"])

        for batch in batches:
            keys, digests = [], []
            for *key, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if now is not None:
                        keys.append(now)
                        digests.append(digest.hexdigest())
                    now, digest = key, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            if keys:
                yield done(keys, digests)
        if now is not None:
            yield done([now], [digest.hexdigest()])

    parts = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = chunks.repartition(parts, "depth", *prints).sortWithinPartitions("depth", *prints, "chunk").select("depth", *prints, "ids")
    return dealt.mapInArrow(run, ", ".join([*(f"{c} long" for c in ("depth", *prints)), "ends_sha256 string"]))


def _groups(rebuilt: DataFrame, n: int) -> DataFrame:
    """A row for each depth and fingerprint, with its representative (the smallest member) and whether all turns are the same."""
    same = F.lit(True)
    for c in ("g0", "g1", "size"):
        same &= F.min(c) == F.max(c)
    return rebuilt.groupBy("depth", *_prints(n)).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("size").alias("size"), *(F.min(e).alias(e) for e in _prints(n, "e")), same.alias("same")
    )


def _subtrees(chains: DataFrame, sums: list[str]) -> DataFrame:
    """chains (conv_id, above: the chain it hangs on, or null, and sums) with sums over all that hangs on them."""
    state = stash(chains.select("conv_id", "above", *sums), "chains")
    total = state.count()
    for _ in range(MAX_ROUNDS):
        if not state.where("above is not null").take(1):
            return state.drop("above")
        # whatever stands 2^i above gets the sums of the 2^i below, and then all look twice as far up
        given = state.where("above is not null").groupBy(F.col("above").alias("conv_id")).agg(*(F.sum(s).alias(f"more_{s}") for s in sums), F.count("*").alias("k"))
        up = stash(state.join(given, "conv_id", "left").select("conv_id", "above", *((F.col(s) + F.coalesce(f"more_{s}", F.lit(0))).alias(s) for s in sums), "k"), "chains")
        facts = up.where("k is not null").select(F.col("conv_id").alias("above"), F.col("above").alias("next"), "k")
        jumped = join_hubs(up.where("above is not null").select("conv_id", "above"), facts, "above", "k", total).select("conv_id", "next")
        state = stash(up.select("conv_id", *sums).join(jumped, "conv_id", "left").withColumnRenamed("next", "above"), "chains")
    raise RuntimeError(f"chains hang deeper than {MAX_ROUNDS} doublings")


def prefix_trie(turns: DataFrame, group: int = GROUP, taken: int = TAKEN) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node of the trie of rebuilt
    conversations of (conv_id, turn, role, text).

    Conversation c is rebuilt from the first crc32(c) % `taken` turns of c - c % `group` (as many as there are) and its own turns
    after as many. Turns are ordered by turn (null first), those of the same turn by a digest of role and text; repeated rows
    are repeated turns; a null role or text is empty; rows without a conv_id go; other columns are not carried; an empty table
    gives an empty result, without a root.
    """
    turns = turns.select("conv_id", "turn", "role", "text")
    for pairs in range(1, MAX_PAIRS + 1):
        bases = _bases(pairs)
        n, prints = len(bases), _prints(len(bases))
        rows = prefixes(turns, pairs)
        facts = stash(_facts(rows, n, group, taken), "facts")
        groups = stash(_groups(_rebuilt(rows, facts, bases, taken), n), "groups")
        if not groups.where("not same").take(1):
            break
    else:
        raise RuntimeError(f"{MAX_PAIRS} pairs of fingerprints don't tell prefixes apart")
    root = facts.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("depth"), *(F.lit(0).cast("long").alias(f) for f in prints), "conv_id", "n_convs", F.lit(0).cast("long").alias("size"), *(F.lit(None).cast("long").alias(e) for e in _prints(n, "e")))
    nodes = groups.drop("same").unionByName(root)
    key = F.struct("depth", *prints).alias("key")
    up = F.struct((F.col("depth") - 1).alias("depth"), *(F.col(f"e{k}").alias(f) for k, f in enumerate(prints))).alias("up")
    nodes = nodes.select(key, F.when(F.col("depth") > 0, up).alias("up"), "depth", "conv_id", "n_convs", "size")
    children = nodes.where("depth > 0").groupBy(F.col("up").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = stash(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    parents = nodes.where("n_children > 0").select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("weight"))
    below = join_hubs(nodes.where("depth > 0"), parents, "up", "weight", nodes.count())
    nodes = below.unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))).drop("up")
    sums = ["leaves", "saved"]
    nodes = nodes.withColumn("leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("size"))
    nodes = stash(nodes.drop("size"), "nodes")
    chains = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "parent_conv_id")).alias("top"), *(F.sum(s).alias(s) for s in sums))
    chains = stash(chains.select("conv_id", F.col("top.parent_conv_id").alias("above"), (F.col("top.depth") - 1).alias("depth"), *sums), "tops")
    whole = _subtrees(chains, sums)
    hanging = chains.where("above is not null").select("conv_id", "above", "depth").join(whole, "conv_id").groupBy(F.col("above").alias("conv_id"), "depth").agg(*(F.sum(s).alias(f"more_{s}") for s in sums))
    nodes = nodes.join(hanging, ["conv_id", "depth"], "left").select(*(c for c in nodes.columns if c not in sums), *((F.col(s) + F.coalesce(f"more_{s}", F.lit(0))).alias(s) for s in sums))
    # running sums from a chain's end up, by stretches
    nodes = nodes.withColumn("stretch", F.floor(F.col("depth") / STRETCH))
    down = Window.partitionBy("conv_id", "stretch").orderBy(F.desc("depth"))
    after = Window.partitionBy("conv_id").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    later = nodes.groupBy("conv_id", "stretch").agg(*(F.sum(s).alias(s) for s in sums)).select("conv_id", "stretch", *(F.sum(s).over(after).alias(f"later_{s}") for s in sums))
    nodes = nodes.join(later.where("later_leaves is not null"), ["conv_id", "stretch"], "left")
    nodes = nodes.select("key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *((F.sum(s).over(down) + F.coalesce(f"later_{s}", F.lit(0))).alias(a) for s, a in zip(sums, ("n_leaves", "saved_tokens"), strict=True)))
    ends = _ends(facts, bases, taken).select(key, "ends_sha256")
    out = nodes.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
