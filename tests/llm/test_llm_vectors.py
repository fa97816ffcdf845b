"""Hard negatives and near-duplicate vectors against brute force."""

import math
import random

import numpy as np
import pytest

from marginalia.llm import ivfpq, negatives

ROWS = "vec_id long, label int, embedding array<float>, norm string, key int"


def table(spark, rows, schema=ROWS):
    """With columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, label, vec, "x", 3) for i, label, vec in rows], schema)


def labelled(seed=1, n=420, d=9, labels=3):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(labels), [float(np.float32(rng.gauss(0.3, 1) * rng.choice((0.1, 1, 1, 3)))) for _ in range(d)]) for i in range(n)]
    for i in range(40, 60):  # ties
        rows[i] = (i, rows[i][1], rows[39][2])
    return rows


def odd(rows):
    """Rows that take no part, a short vector, a zero one, a repeated row and a repeated id."""
    nan, inf = float("nan"), float("inf")
    extra = [(900, None, [1.0] * 9), (1000, 1, None), (1100, 1, [nan] * 9), (1200, 1, [1.0, None] + [1.0] * 7), (1300, 0, [inf] + [0.0] * 8), (None, 1, [1.0] * 9)]
    return [*rows, *extra, (1400, 1, [2.0, 1.0]), (1500, 2, [0.0] * 9), (1600, 1, []), rows[100], (200, 0, [9.0] * 9)]


def brute_negatives(rows, every, k=10, n_positives=5):
    kept = {}
    for i, label, vec in rows:
        if i is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        whole = tuple(math.floor(256 * x) for x in vec)
        label = (label + 1) % 10 if i % 7 == 0 else label
        mine = (label, math.sqrt(sum(x * x for x in whole)), whole)
        kept[i] = min(kept.get(i, mine), mine, key=lambda m: m[:2])
    out = set()
    for a, (label, _, vec) in kept.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(vec, o[2], strict=False)), i, o[0]) for i, o in kept.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:n_positives]:
            fits = [(-t, i) for t, i, other in scored if other != label and 30 * -s <= 100 * -t <= 90 * -s][:k]
            out |= {(a, p, r + 1, i, -s, t) for r, (t, i) in enumerate(fits)}
    return out


def mined(df, **how):
    rows = [tuple(r) for r in negatives.mine(df, **how).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("how", [{}, {"block": 3, "stripe": 50, "bucket": 16}])
def test_negatives_against_brute_force(spark, how):
    rows = odd(labelled())
    got = mined(table(spark, rows), anchors=20, **how)
    assert got == brute_negatives(rows, 20) and len({a for a, *_ in got}) > 10


def test_buckets_are_skipped_without_loss():
    """Rows by falling norm: once no anchor's limit can be reached, nothing more is taken."""
    rng = np.random.default_rng(5)
    anchors = [(i, 0, float(np.linalg.norm(v)), v.tobytes(), [int(4 * v @ v)]) for i, v in enumerate(np.floor(rng.normal(0, 50, (6, 4))))]
    block = negatives._Block(anchors, 2, False, 30, 90)
    long = np.floor(rng.normal(0, 80, (40, 4)))
    norms = np.linalg.norm(long, axis=1)
    assert block.take(np.arange(40), np.ones(40, np.int64), norms, long)
    assert not block.take(np.arange(40, 44), np.ones(4, np.int64), np.full(4, 1e-3), np.zeros((4, 4)))


def test_negatives_of_large_components(spark):
    """Scores beyond 2^53 stay exact; those beyond 64 bits raise."""
    rng = random.Random(4)
    rows = [(i, i % 2, [float(rng.randrange(-(1 << 21), 1 << 21)) for _ in range(3)]) for i in range(60)]
    assert mined(table(spark, rows), anchors=10) == brute_negatives(rows, 10)
    with pytest.raises(Exception, match="64 bits"):
        mined(table(spark, [(i, i % 2, [1e30]) for i in range(30)]), anchors=10)


def test_negatives_of_few_rows(spark):
    assert mined(table(spark, [])) == set()
    assert mined(table(spark, [(0, 1, [1.0])])) == set()
    assert mined(table(spark, [(100, 1, [1.0]), (1, 1, [1.0]), (2, 3, [0.5])])) == {(100, 1, 1, 2, 65536, 32768)}


# --- near-duplicate vectors -------------------------------------------------------------------------------------------


def crowded(seed=2, n=500, d=24):
    """Unit noise, groups of near copies (one large), equal and scaled copies, and pairs close to the threshold."""
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, d)).astype(np.float32)
    x[100:220] = x[0] + rng.normal(0, 0.1, (120, d))
    x[220:260] = x[1] + rng.normal(0, 0.12, (40, d))
    for i in range(260, 300):
        x[i] = x[i - 120] + rng.normal(0, 0.22, d)
    x[300:310], x[310] = x[2], 2 * x[2]
    return [(int(i), 0, [float(v) for v in row]) for i, row in zip(rng.permutation(3 * n)[:n], x, strict=True)]


def brute_links(rows, least=0.95):
    kept = {}
    for i, _, vec in rows:
        if i is not None:
            kept.setdefault(i, vec)
    ok = {i: v for i, v in kept.items() if v is not None and any(v) and all(x is not None and math.isfinite(x) for x in v)}
    ids, width = sorted(ok), max([len(v) for v in ok.values()], default=0)
    x = np.array([list(ok[i]) + [0.0] * (width - len(ok[i])) for i in ids]).reshape(len(ids), width)
    near = (x @ x.T) / np.outer(*[np.sqrt((x * x).sum(1))] * 2) >= least
    np.fill_diagonal(near, False)
    part = np.array(ids)
    while True:
        now = np.array([min([part[k], *part[near[k]]]) for k in range(len(ids))])
        if (now == part).all():
            break
        part = now
    out = {i: (0, i, True) for i in kept}
    return out | {i: (int(near[k].sum()), int(part[k]), bool(part[k] == i)) for k, i in enumerate(ids)}


def found_links(df, **how):
    rows = ivfpq.near_vectors(df, **how).collect()
    assert all((r.n_links, r.component_id, r.kept) == (0, None, False) for r in rows if r.vec_id is None)
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows if r.vec_id is not None}
    assert len(out) == len([r for r in rows if r.vec_id is not None])
    return out, len(rows)


@pytest.mark.parametrize("how", [{}, {"list_rows": 20, "sigmas": 5}, {"list_rows": 1, "block": 7, "sigmas": 5}])
def test_near_vectors_against_brute_force(spark, how):
    """With so wide a margin as loses nothing in 24 dimensions, all links are found, whatever the lists and blocks."""
    nan, width = float("nan"), 24
    extra = [(9000, 0, None), (9001, 0, [nan] * width), (9002, 0, [0.0] * width), (9003, 0, []), (9004, 0, [1.0, None]), (9005, 1, [3.0]), (9006, 1, [5.0]), (None, 0, [1.0] * width)]
    rows = [*crowded(), *extra]
    rows.append(rows[3])
    got, n = found_links(table(spark, rows), **how)
    assert got == brute_links(rows) and n == len(rows) - 1
    assert max(links for links, _, _ in got.values()) > 100


def test_recall_of_near_vectors(spark):
    """Short lists and the margin in use: at least 0.9 of links (all of them here), and none below the threshold."""
    rows = crowded(seed=9, n=600, d=64)
    got, _ = found_links(table(spark, rows), list_rows=12)
    want = brute_links(rows)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(v[0] for v in got.values()) >= 0.99 * sum(v[0] for v in want.values())


def test_codes_lose_no_neighbour():
    """A vector within delta is never farther from a code than delta and the code's own error."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (400, 13)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = ivfpq.Index.fit(x, 9)
    lists, _ = index.places(x)
    codes, lost = index.codes(x, lists)
    for one in range(len(index.centres)):
        own = lists == one
        if own.any():
            said = index.distances(x, one, codes[own])
            true = np.linalg.norm(x[:, None] - x[own][None], axis=2)
            assert (said <= true + lost[own] + 1e-4).all() and (said >= true - lost[own] - 1e-4).all()


def test_upper_level_of_lists():
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (3000, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = ivfpq.Index.fit(x, 400)
    lists, asked = index.places(x, 0.1)
    assert len(index.cells) == 20 and len(asked) == len(x) and all(a not in own for a, own in zip(lists, asked, strict=True))
    assert (lists == ivfpq._nearest(x, index.centres)).mean() > 0.98


def test_near_vectors_of_few_rows(spark):
    assert found_links(table(spark, [])) == ({}, 0)
    assert found_links(table(spark, [(4, 1, [0.0]), (5, 1, None)]))[0] == {4: (0, 4, True), 5: (0, 5, True)}
    doubles = ROWS.replace("float", "double")
    assert found_links(table(spark, [(7, 1, [1e300, 0.0]), (3, 1, [1e-300, 0.0]), (9, 1, [0.0, 1.0])], doubles))[0] == {3: (1, 3, True), 7: (1, 3, False), 9: (0, 9, True)}
