"""Verdict cases, guards, and the metrics' properties."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.functions import metrics as M
from marginalia.functions import text as T
from marginalia.operators import contracts as C

CASES = [  # mf, mt, mj -> correct, h, failure, ungrounded, confused
    (3, 0, [1, 2], (True, 1, False, False, False)),
    (3, 2, [1], (True, -1, True, False, True)),
    (1, 2, [3], (True, -1, True, True, False)),
    (2, 1, [1], (True, 0, True, False, True)),
    (0, 1, [-1], (False, -2, False, False, False)),
]
UNIT = "id long, mf double, mt double, mj_min double, mj_max double, n_rivals long"


def rows_of(cases):
    return [(i, float(mf), float(mt), float(min(mj)) if mj else None, float(max(mj)) if mj else None, len(mj)) for i, (mf, mt, mj) in enumerate(cases)]


def verdicts(spark, cases):
    df = spark.createDataFrame(rows_of(cases), UNIT).where(M.usable())
    out = df.select("id", M.correct().alias("c"), M.h().alias("h"), M.failure().alias("f"), M.ungrounded().alias("u"), M.confused().alias("k"), M.state().alias("s"), M.h_difference_form().alias("h2"))
    return {r["id"]: r for r in out.collect()}


def test_verdict_cases(spark):
    got = verdicts(spark, [c[:3] for c in CASES])
    for i, (_, _, _, want) in enumerate(CASES):
        assert tuple(got[i])[1:6] == want


def test_unusable_units_are_rejected(spark):
    cases = [(1, 0, []), (1, math.nan, [0]), (math.inf, 0, [1]), (1, 0, [math.nan, 1]), (1, 0, [0])]
    assert set(verdicts(spark, cases)) == {4}


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-48, 48)] * 2, st.lists(st.integers(-48, 48), min_size=1, max_size=3)), min_size=1, max_size=30))
def test_states_partition_and_forms_agree(spark, cases):
    cases = [(a / 16, b / 16, [x / 16 for x in c]) for a, b, c in cases]
    for i, r in verdicts(spark, cases).items():
        mf, mt, mj = cases[i]
        h = min(mf, *mj) - mt
        assert r["h"] == h == r["h2"]
        assert r["f"] == (mf > 0 and h <= 0) == (r["u"] or r["k"])
        assert (r["s"] is None) == (mf <= 0)
        assert r["f"] == (r["s"] in ("ungrounded", "confused"))


def test_half_even_bins(spark):
    xs = [0.25, 0.75, 1.25, -0.25, -0.75, -1.25, 0.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", M.half_even_bin("x").alias("b"))
    assert {r["x"]: r["b"] for r in df.collect()} == {x: round(x / 0.5) * 0.5 for x in xs}


def test_text(spark):
    df = spark.createDataFrame([(" a ", "remove_off_10", "x_snr1_snr5", 5, "NOISE", "top 3 of_all", -0.04, 0.25)], "a string, v string, c string, n int, t string, m string, z double, q double")
    r = df.select(
        T.normal_label(F.col("a")), T.rival_index(F.col("v")), T.design_id(F.col("c")), T.bit_mask(F.col("n")), T.title(F.col("t")), T.title(F.lit("dog bark")),
        T.macro_name(F.col("m")), T.fixed(F.col("z"), 1), T.fixed(F.col("q"), 1), T.signed(F.col("q"), 1), T.normal_label(F.lit("a b")), T.percent(F.col("q")), T.title(F.lit("12")),
    ).first()
    assert tuple(r) == ("a", 10, "x_snr1", "101", "NOISE", "Dog bark", "TopThreeOfAll", "0.0", "0.2", "+0.2", None, "25.0%", "12")


def test_guards(spark):
    reg = C.Registry()
    with pytest.raises(C.ContractError, match="9.*12.*-3"):
        C.assert_partition({"left": 4, "right": 5}, 12, "too few", reg)
    C.assert_partition({"left": 7, "right": 5}, 12, "parts", reg)
    C.assert_partition([0, 12], 12, "list", reg)
    for parts in ([13, -1], [6.5, 5.5], [True, 11]):
        with pytest.raises(C.ContractError):
            C.assert_partition(parts, 12, "no counts", reg)
    assert C.sum_matches((3, 9), 12) and not C.sum_matches((3, 8), 12)
    C.assert_total(40, 40, "sum", reg)
    C.assert_same_total(41, 41, "sums", reg)
    for f in (C.assert_total, C.assert_same_total):
        with pytest.raises(C.ContractError):
            f(40, 41, "differ", reg)
    assert reg.verified == ["parts", "list", "sum", "sums"]
    seats = spark.createDataFrame([(row, seat, 10 * row + seat) for row in (1, 2, 3) for seat in range(row)], "row int, seat int, price int")
    with pytest.raises(C.ContractError):
        C.bucket_unique(seats, ["row"], "rows have seats", reg)
    assert C.bucket_unique(seats, ["row", "seat"], "key", reg).count() == 6
    assert {r["row"]: r["count"] for r in C.bucket_multi(seats, ["row"], "multi", reg).collect()} == {1: 1, 2: 2, 3: 3}
    with pytest.raises(C.ContractError):
        C.assert_bounds(seats, "price", 10, 31, "bounds", reg)
    with pytest.raises(C.ContractError):
        C.assert_coverage(seats, seats.where("row < 3"), ["row"], "coverage", reg)
    C.assert_agree(seats, seats, ["row", "seat"], "price", "agree", reg)
    with pytest.raises(C.ContractError):
        C.assert_agree(seats, seats.where("price < 32"), ["row", "seat"], "price", "missing", reg)
