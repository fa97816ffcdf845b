"""The trie of conversations against brute force."""

import hashlib
import random
import zlib

import pytest
import xxhash

from marginalia.llm import trie

TURNS = "conv_id long, turn long, role string, text string, key string, depth int"


def table(spark, rows):
    """With columns whose names clash with the operator's own."""
    return spark.createDataFrame([(*r, "x", 5) for r in rows], TURNS)


def content_order(role, text):
    """Turns of one number go by their digest's two halves, as signed numbers."""
    role, text = role.encode(), text.encode()
    d = hashlib.sha256(b"%d:%b%b" % (len(role), role, text)).digest()
    return [int.from_bytes(d[i : i + 8], "little", signed=True) for i in (0, 8)]


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs.setdefault(c, []).append((turn is not None, turn or 0, content_order(role, text), (role, text)))
    convs = {c: [t[3] for t in sorted(turns)] for c, turns in convs.items()}
    rebuilt = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(convs.get(c - c % 5, [])[:h] + turns[h:])
    members, ends = {}, {}
    for c, path in rebuilt.items():
        ends.setdefault(path, []).append(c)
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    leaves, saved, children = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, own in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(own) - 1) * (len(path[-1][1].encode()) if path else 0)
    return {
        (min(own), len(path), min(members[path[:-1]]) if path else None, len(own), children[path], leaves[path], saved[path], hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest())
        for path, own in members.items()
    }


def conversations(seed=1, n=160):
    """Few different turns, so that prefixes are shared; some long ones, null turns, ties and repeated rows."""
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(2 * n), n):
        size = rng.choice((1, 2, 3, 5, 8, 12))
        shared = rng.random() < 0.4
        rows += [(c, t, rng.choice(("user", None, "")), "same" * t if shared else rng.choice(("a", "bé", None, "", "long one"))) for t in range(size)]
    long = 2 * n + 5
    rows += [(long, t, "user", f"line {t}") for t in range(130)]
    rows += [(long + 5, t, "user", f"line {t}" if t < 100 else "other") for t in range(118)]
    rows += [(rows[0][0], None, "user", x) for x in ("null", "turn", "null")] + [rows[5], rows[5], (None, 1, "user", "none")]
    rows += [(900_001 + c, 0, "user", "copy") for c in range(40)]
    rng.shuffle(rows)
    return rows


def found(df):
    rows = [tuple(r) for r in trie.prefix_trie(df).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_trie_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 16)
    monkeypatch.setattr(trie, "STRETCH", 16)
    rows = conversations()
    want = brute(rows)
    assert found(table(spark, rows)) == want and len(want) > 500


def test_collisions_are_split(spark, monkeypatch):
    """With fingerprints of a few values, groups that hold different turns are split until none does."""
    monkeypatch.setattr(trie, "PRIMES", (7, 11))
    rows = [r for r in conversations(seed=6, n=60) if r[1] is None or r[1] < 20]
    seen, prefixes = [], trie.prefixes
    monkeypatch.setattr(trie, "prefixes", lambda turns, pairs: seen.append(pairs) or prefixes(turns, pairs))
    assert found(table(spark, rows)) == brute(rows)
    assert len(seen) > 1


def test_long_conversations_are_dealt_out(spark):
    """One conversation over all tasks: places and fingerprints go on from task to task."""
    rows = [(3, t, "user", str(t % 7)) for t in range(5000)] + [(3, None, "user", "same")] * 500
    got = sorted((r.pos, r.f0, r.f1) for r in trie.prefixes(table(spark, rows)).collect())
    assert [p for p, _, _ in got] == list(range(5500)) and trie.prefixes(table(spark, rows)).select("conv_id").rdd.getNumPartitions() > 1
    h = [xxhash.xxh64_intdigest(b"4:user" + x, 0) for x in [b"same"] * 500 + [b"%d" % (t % 7) for t in range(5000)]]
    (base, prime), total = trie._bases(1)[0], 0
    for t, (pos, f0, _) in zip(h, got, strict=True):
        total = (total + t * pow(base, pos, prime)) % prime
        assert f0 == total


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")], [(7, None, None, None)], [(0, 1, "a", "b"), (1, 1, "a", "b"), (6, 4, "a", "b")]])
def test_trie_of_few_rows(spark, rows):
    assert found(table(spark, rows)) == brute(rows)
