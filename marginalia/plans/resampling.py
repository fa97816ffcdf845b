"""Bootstrap intervals and permutation tests. Draws are md5 numbers, which SQL makes alike."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import resample as R
from marginalia.plans.base import checked, n_if, query
from marginalia.plans.proxy import CTE, units
from marginalia.plans.structure import Q1, Q5, _EIGHT, _IN, _MAPPED, _SUBST, _mapped, _ranked, paired_units
from marginalia.plans.structure import _CAT

S = SparkSession
N = R.DRAWS
PERMUTATIONS = 10_000


def draws_sql(counts: str, columns: list[str]) -> str:
    """Common table expressions counts, drawn: the sums of each draw."""
    sums = ", ".join(f"sum({c}) AS {c}" for c in columns)
    return f""", counts AS ({counts}), numbered AS (SELECT *, row_number() OVER (ORDER BY cluster) - 1 AS cluster_idx, count(*) OVER () AS k FROM counts),
draws AS (SELECT d.draw, ('0x' || substr(md5({R.SEED} || '|' || d.draw || '|' || p.pos), 1, 8))::BIGINT % (SELECT max(k) FROM numbered) AS cluster_idx
  FROM range({N}) d(draw), (SELECT unnest(range((SELECT max(k) FROM numbered))) AS pos) p),
drawn AS (SELECT draw, {sums} FROM draws JOIN numbered USING (cluster_idx) GROUP BY draw)
"""


def ends(expr: str, lo: str = "lo", hi: str = "hi") -> str:
    return f"round(quantile_cont({expr}, 0.025), 9) AS {lo}, round(quantile_cont({expr}, 0.975), 9) AS {hi}"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


_BY_TUPLE = "SELECT tuple AS cluster, count(*) FILTER (ok) AS den, count(*) FILTER (fail) AS num FROM checked GROUP BY tuple"


def _by_tuple(spark: S, d: str) -> DataFrame:
    return checked(spark, d).groupBy("tuple").agg(n_if("ok", "den"), n_if("fail", "num"))


@query(draws_sql(_BY_TUPLE, ["num", "den"]) + "SELECT cluster_idx, count(*) AS n FROM draws GROUP BY cluster_idx")
def boot_draws(spark: S, d: str) -> DataFrame:
    k = units(spark, d).select("tuple").distinct().count()
    return R.md5_draws(spark, k).groupBy("cluster_idx").agg(F.count("*").alias("n"))


@query(draws_sql(_BY_TUPLE, ["num", "den"]) + f"SELECT 'rankfail' AS name, (SELECT round(sum(num) / sum(den), 9) FROM counts) AS point, {ends('num / greatest(den, 1)')}, (SELECT sum(num)::BIGINT FROM counts) AS num, (SELECT sum(den)::BIGINT FROM counts) AS den FROM drawn")
def boot_ratio(spark: S, d: str) -> DataFrame:
    return _rounded(R.cluster_bootstrap(_by_tuple(spark, d), "tuple", {"rankfail": ("num", "den")}))


# fixed values: the multiplier of the generator, and the sizes of its state and words
PCG_MULTIPLIER, PCG_STATE, PCG_WORD = 0x2360ED051FC65DA44385DF649FCCF645, 1 << 128, 1 << 64


def pcg_sql(doublings: int = 19) -> str:
    """Common table expressions words: idx, w, the 32-bit words of 2^doublings outputs of numpy's default generator. States come by
    doubling: those of outputs 0 to 2^r - 1, moved 2^r on, are those of the next 2^r. Products are made of 64-bit halves."""
    state = np.random.PCG64(R.SEED).state["state"]
    first, jumps, a, c = (state["state"] * PCG_MULTIPLIER + state["inc"]) % PCG_STATE, [], PCG_MULTIPLIER, state["inc"]
    for r in range(doublings):
        jumps.append((r, a >> 64, a % PCG_WORD, c >> 64, c % PCG_WORD))
        a, c = a * a % PCG_STATE, (a + 1) * c % PCG_STATE
    big = lambda x: f"'{x}'::UHUGEINT"
    rows = ", ".join(f"({r}, {', '.join(map(big, own))})" for r, *own in jumps)
    m, powers = big(PCG_WORD), ", ".join(big(1 << k) for k in range(65))
    return f""", jumps(r, ahi, alo, chi, clo) AS (VALUES {rows}),
states AS (
  SELECT 0 AS r, 0::BIGINT AS n, {big(first >> 64)} AS hi, {big(first % PCG_WORD)} AS lo
  UNION ALL
  SELECT r + 1, n + far * (1::BIGINT << r), CASE far WHEN 0 THEN hi ELSE (nhi + chi + (nlo + clo) // {m}) % {m} END, CASE far WHEN 0 THEN lo ELSE (nlo + clo) % {m} END
  FROM (SELECT s.*, j.chi, j.clo, (alo * lo) % {m} AS nlo, ((alo * lo) // {m} + (ahi * lo) % {m} + (alo * hi) % {m}) % {m} AS nhi FROM states s JOIN jumps j USING (r)), (VALUES (0), (1)) f(far)
), mixed AS (SELECT n, (hi // {powers.split(", ")[58]})::INT AS rot, xor(hi, lo) AS x FROM states WHERE r = {doublings}
), outputs AS (SELECT n, x // [{powers}][rot + 1] + (x * [{powers}][65 - rot]) % {m} AS v FROM mixed
), words AS (SELECT 2 * n AS idx, (v % 4294967296)::UBIGINT AS w FROM outputs UNION ALL SELECT 2 * n + 1, (v // {big(1 << 32)})::UBIGINT FROM outputs)
"""


_PCG = f""", counts AS ({_BY_TUPLE}), numbered AS (SELECT *, row_number() OVER (ORDER BY cluster) - 1 AS cluster_idx FROM counts), k AS (SELECT count(*)::UBIGINT AS k FROM counts){pcg_sql()},
fair AS (SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, (w * k) >> 32 AS cluster_idx, k FROM words, k WHERE (w * k) % 4294967296 >= 4294967296 % k),
drawn AS (SELECT idx // k AS draw, sum(num) AS num, sum(den) AS den FROM fair f JOIN numbered n ON n.cluster_idx = f.cluster_idx WHERE idx < {N} * k GROUP BY draw)
"""


# the numbers of numpy's generator
@query(CTE.replace("WITH", "WITH RECURSIVE", 1) + _PCG + f"SELECT 'rankfail' AS name, (SELECT round(sum(num) / sum(den), 9) FROM counts) AS point, {ends('num / greatest(den, 1)')}, (SELECT sum(num)::BIGINT FROM counts) AS num, (SELECT sum(den)::BIGINT FROM counts) AS den FROM drawn", cte=False)
def boot_pcg64(spark: S, d: str) -> DataFrame:
    counts = _by_tuple(spark, d)
    return _rounded(R.cluster_bootstrap(counts, "tuple", {"rankfail": ("num", "den")}, draws=R.pcg64_draws(spark, counts.count())))


_LEVELS = "SELECT tuple AS cluster, " + ", ".join(f"count(*) FILTER (ok AND snr = {s}) AS d{i}, count(*) FILTER (fail AND snr = {s}) AS n{i}" for i, s in enumerate((5, -5))) + " FROM checked GROUP BY tuple"


def _difference(drawn: DataFrame, pairs: list[tuple[str, str]], empty: str = "clamp") -> DataFrame:
    value = R.ratio(*pairs[1], empty) - R.ratio(*pairs[0], empty)
    return R.interval(drawn, {"difference": value})


@query(draws_sql(_LEVELS, ["n0", "d0", "n1", "d1"]) + f"SELECT 'difference' AS name, {ends('n1 / greatest(d1, 1) - n0 / greatest(d0, 1)')} FROM drawn")
def boot_diff(spark: S, d: str) -> DataFrame:
    made = [n_if(F.col(c) & (F.col("snr") == s), f"{k}{i}") for i, s in enumerate((5, -5)) for c, k in (("ok", "d"), ("fail", "n"))]
    counts = checked(spark, d).groupBy("tuple").agg(*made)
    return _rounded(_difference(R.drawn_sums(counts, "tuple", ["n0", "d0", "n1", "d1"]), [("n0", "d0"), ("n1", "d1")]))


_GAP = "SELECT tuple AS cluster, " + ", ".join(f"count(*) FILTER (ok AND category IN ({_IN(q)})) AS d{i}, count(*) FILTER (fail AND category IN ({_IN(q)})) AS n{i}" for i, q in enumerate((Q5, Q1))) + " FROM checked GROUP BY tuple"


@query(draws_sql(_GAP, ["n0", "d0", "n1", "d1"]) + f"SELECT 'gap' AS name, {ends('100 * (n1 / greatest(d1, 1) - n0 / greatest(d0, 1))')} FROM drawn")
def boot_gap(spark: S, d: str) -> DataFrame:
    made = [n_if(F.col(c) & F.col("category").isin(*q), f"{k}{i}") for i, q in enumerate((Q5, Q1)) for c, k in (("ok", "d"), ("fail", "n"))]
    drawn = R.drawn_sums(checked(spark, d).groupBy("tuple").agg(*made), "tuple", ["n0", "d0", "n1", "d1"])
    return _rounded(R.interval(drawn, {"gap": 100 * (R.ratio("n1", "d1") - R.ratio("n0", "d0"))}))


@query(draws_sql("SELECT tuple AS cluster, count(*) FILTER (ungr) AS num, count(*) FILTER (fail) AS den FROM checked GROUP BY tuple", ["num", "den"]) + f"SELECT 'ungrounded' AS name, {ends('num / nullif(den, 0)')} FROM drawn")
def boot_interface(spark: S, d: str) -> DataFrame:
    counts = checked(spark, d).groupBy("tuple").agg(n_if("ungr", "num"), n_if("fail", "den"))
    return _rounded(R.interval(R.drawn_sums(counts, "tuple", ["num", "den"]), {"ungrounded": R.ratio("num", "den", "null")}))


_PAIRED = _MAPPED.replace("SELECT model, a.ok AS ok_a", "SELECT model, pair % 64 AS cluster, a.ok AS ok_a")


@query(_PAIRED + draws_sql("SELECT cluster, count(*) FILTER (ok_a AND ok_b) AS den, count(*) FILTER (ok_a AND ok_b AND fail_a) AS na, count(*) FILTER (ok_a AND ok_b AND fail_b) AS nb FROM mapped GROUP BY cluster", ["na", "nb", "den"]) + f"SELECT 'mapping' AS name, {ends('(na - nb) / den')} FROM drawn WHERE den > 0")
def boot_paired(spark: S, d: str) -> DataFrame:
    both = F.col("ok_a") & F.col("ok_b")
    counts = _mapped(spark, d).groupBy(F.pmod("pair", F.lit(64)).alias("cluster")).agg(n_if(both, "den"), n_if(both & F.col("fail_a"), "na"), n_if(both & F.col("fail_b"), "nb"))
    drawn = R.drawn_sums(counts, "cluster", ["na", "nb", "den"]).where("den > 0")
    return _rounded(R.interval(drawn, {"mapping": (F.col("na") - F.col("nb")) / F.col("den")}))


@query(draws_sql("SELECT tuple AS cluster, count(*) AS den, count(*) FILTER (state = 'grounded') AS num FROM checked WHERE ok GROUP BY tuple", ["num", "den"]) + f"SELECT 'grounded' AS name, {ends('num / den')} FROM drawn")
def boot_pooled(spark: S, d: str) -> DataFrame:
    counts = checked(spark, d).where("ok").groupBy("tuple").agg(F.count("*").alias("den"), n_if(F.col("state") == "grounded", "num"))
    return _rounded(R.interval(R.drawn_sums(counts, "tuple", ["num", "den"]), {"grounded": R.ratio("num", "den", "drop")}))


@query(""", x AS (SELECT *, overlap = 1 AS conflict FROM checked)""" + draws_sql("SELECT tuple AS cluster, count(*) FILTER (ok AND conflict) AS d1, count(*) FILTER (fail AND conflict) AS n1, count(*) FILTER (ok AND NOT conflict) AS d0, count(*) FILTER (fail AND NOT conflict) AS n0 FROM x GROUP BY tuple", ["n0", "d0", "n1", "d1"]) + f"SELECT 'raw' AS name, {ends('n1 / d1 - n0 / d0')} FROM drawn WHERE d0 > 0 AND d1 > 0")
def boot_matched(spark: S, d: str) -> DataFrame:
    conflict = F.col("overlap") == 1
    counts = checked(spark, d).groupBy("tuple").agg(n_if(F.col("ok") & conflict, "d1"), n_if(F.col("fail") & conflict, "n1"), n_if(F.col("ok") & ~conflict, "d0"), n_if(F.col("fail") & ~conflict, "n0"))
    drawn = R.drawn_sums(counts, "tuple", ["n0", "d0", "n1", "d1"]).where("d0 > 0 and d1 > 0")
    return _rounded(R.interval(drawn, {"raw": R.ratio("n1", "d1", "drop") - R.ratio("n0", "d0", "drop")}))


_SIX = [f"{k}_{q}" for q in ("q1", "q5") for k in ("itt_num", "itt_den", "b_itt_num", "b_itt_den")]
_GAPS = {"subst": "itt_num_q1 / nullif(itt_den_q1, 0) - itt_num_q5 / nullif(itt_den_q5, 0)", "base": "b_itt_num_q1 / nullif(b_itt_den_q1, 0) - b_itt_num_q5 / nullif(b_itt_den_q5, 0)"}


@query(_SUBST + draws_sql("SELECT tuple AS cluster, " + ", ".join(f"count(*) FILTER (({_EIGHT[c[:-3]]}) AND label = '{c[-2:].upper()}') AS {c}" for c in _SIX) + " FROM paired GROUP BY tuple", _SIX)
  + " UNION ALL ".join(f"SELECT '{k}' AS name, {ends(v)} FROM drawn" for k, v in (_GAPS | {"did": f"({_GAPS['subst']}) - ({_GAPS['base']})"}).items()))
def boot_subst(spark: S, d: str) -> DataFrame:
    counts = paired_units(spark, d).groupBy("tuple").agg(*[n_if(F.expr(_EIGHT[c[:-3]]) & (F.col("label") == c[-2:].upper()), c) for c in _SIX])
    gap = lambda k: R.ratio(f"{k}_num_q1", f"{k}_den_q1", "null") - R.ratio(f"{k}_num_q5", f"{k}_den_q5", "null")
    return _rounded(R.interval(R.drawn_sums(counts, "tuple", _SIX), {"subst": gap("itt"), "base": gap("b_itt"), "did": gap("itt") - gap("b_itt")}))


@query(_CAT + f""", own AS (SELECT category, rate AS x, n::DOUBLE AS y, row_number() OVER (ORDER BY category) AS place FROM rates),
shuffled AS (SELECT draw, y, row_number() OVER (PARTITION BY draw ORDER BY ('0x' || substr(md5({R.SEED} || '|' || draw || '|' || category), 1, 8))::BIGINT, category) AS place FROM own, range({PERMUTATIONS}) r(draw)),
perms AS (SELECT draw, corr(x, s.y) AS r FROM own JOIN shuffled s USING (place) GROUP BY draw), seen AS (SELECT corr(x, y) AS r FROM own)
SELECT round(max(seen.r), 9) AS observed, round((count(*) FILTER (perms.r >= seen.r - 1e-12) + 1) / {PERMUTATIONS + 1}, 9) AS p FROM perms, seen""")
def permutation_test(spark: S, d: str) -> DataFrame:
    own = _ranked(spark, d).select("category", F.col("rate").alias("x"), F.col("n").cast("double").alias("y"))
    return _rounded(R.permutation_p(own, "x", "y", "category", PERMUTATIONS))


