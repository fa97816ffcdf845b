"""Cohorts, paired comparisons, categories, correlations and standardised contrasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import metrics as M
from marginalia.functions.normal import d_prime, d_prime_sql
from marginalia.operators import cohorts as K
from marginalia.operators import stats as A
from marginalia.operators.resample import SEED, md5_int
from marginalia.plans.base import checked, n_if, query, r9
from marginalia.plans.proxy import scores, table, units

S = SparkSession
KEY = ["snr", "overlap", "question"]
#: Two groups of categories (of the proxy's brands), most and least affected.
Q1 = tuple(f"Brand#{i}{j}" for i in (1, 2) for j in range(1, 6))
Q5 = tuple(f"Brand#{i}{j}" for i in (4, 5) for j in range(1, 6))
_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)
_LABEL = f"CASE WHEN category IN ({_IN(Q1)}) THEN 'Q1' WHEN category IN ({_IN(Q5)}) THEN 'Q5' END"


def quintile(column: str = "category"):
    return F.when(F.col(column).isin(*Q1), "Q1").when(F.col(column).isin(*Q5), "Q5")


@query(f"SELECT category, {_LABEL} AS label, count(*) AS n FROM units GROUP BY ALL")
def quintile_label(spark: S, d: str) -> DataFrame:
    return units(spark, d).groupBy("category", quintile().alias("label")).agg(F.count("*").alias("n"))


# --- cohorts ----------------------------------------------------------------------------------------------------------


@query("""SELECT snr, count(*) AS n, count(*) FILTER (fail) AS failures FROM checked SEMI JOIN (
  SELECT model, overlap, question FROM checked GROUP BY ALL HAVING count(DISTINCT snr) = 3 AND count(*) = 3 AND bool_and(ok)) USING (model, overlap, question) GROUP BY snr""")
def common_correct(spark: S, d: str) -> DataFrame:
    u, keys = checked(spark, d), ["model", "overlap", "question"]
    own = K.members(u, K.complete_groups(u, keys, "snr", 3, F.col("ok")), keys)
    return own.groupBy("snr").agg(F.count("*").alias("n"), n_if("fail", "failures"))


@query("""SELECT n_rivals, count(*) AS n, count(*) FILTER (fail) AS failures FROM checked SEMI JOIN (
  SELECT model, snr, question FROM checked GROUP BY ALL HAVING count(DISTINCT n_rivals) = 2 AND bool_and(ok)) USING (model, snr, question) GROUP BY n_rivals""")
def distractor_contrast(spark: S, d: str) -> DataFrame:
    u, keys = checked(spark, d), ["model", "snr", "question"]
    groups = u.groupBy(*keys).agg(F.count_distinct("n_rivals").alias("k"), F.bool_and("ok").alias("all")).where("k = 2 and all")
    return K.members(u, groups, keys).groupBy("n_rivals").agg(F.count("*").alias("n"), n_if("fail", "failures"))


@query("""SELECT model, count(*) AS roles, count(*) FILTER (always_ok) AS always_correct, count(*) FILTER (always_ok AND ever) AS ever_failed, count(*) FILTER (always_ok AND always) AS always_failed FROM (
  SELECT model, question, bool_and(ok) AS always_ok, bool_or(fail) AS ever, bool_and(fail) AS always FROM checked GROUP BY ALL HAVING count(*) >= 5) GROUP BY model""")
def role_stability(spark: S, d: str) -> DataFrame:
    roles = checked(spark, d).groupBy("model", "question").agg(F.bool_and("ok").alias("ok"), F.bool_or("fail").alias("ever"), F.bool_and("fail").alias("always"), F.count("*").alias("n")).where("n >= 5")
    return roles.groupBy("model").agg(F.count("*").alias("roles"), n_if("ok", "always_correct"), n_if(F.col("ok") & F.col("ever"), "ever_failed"), n_if(F.col("ok") & F.col("always"), "always_failed"))


@query("SELECT snr, overlap, question, a.h AS h_a, b.h AS h_b, a.fail AS fail_a, b.fail AS fail_b FROM checked a JOIN checked b USING (snr, overlap, question) WHERE a.model = 'm3' AND b.model = 'm4' AND a.ok AND b.ok")
def model_pair(spark: S, d: str) -> DataFrame:
    return K.self_pairs(checked(spark, d).where("ok"), KEY, "model", "m3", "m4", ["h", "fail"])


@query(", t AS (SELECT a.state AS state_a, b.state AS state_b, count(*) AS n FROM checked a JOIN checked b USING (snr, overlap, question) WHERE a.model = 'm3' AND b.model = 'm4' AND a.ok AND b.ok GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY state_a), 9) AS share FROM t")
def transition_matrix(spark: S, d: str) -> DataFrame:
    pairs = K.self_pairs(checked(spark, d).where("ok"), KEY, "model", "m3", "m4", ["state"])
    return A.transitions(pairs, "state_a", "state_b").withColumn("share", F.round("share", 9))


@query("SELECT r.unit_id, f.unit_id AS frozen_id, r.fail AS fail_redrawn, f.fail AS fail_frozen FROM checked r JOIN checked f USING (model, snr, question) WHERE r.overlap = 1 AND f.overlap = 0 AND r.ok AND f.ok AND f.n_rivals = 2")
def repair_pairs(spark: S, d: str) -> DataFrame:
    u = checked(spark, d).where("ok")
    frozen = u.where("overlap = 0 and n_rivals = 2").select("model", "snr", "question", F.col("unit_id").alias("frozen_id"), F.col("fail").alias("fail_frozen"))
    return u.where("overlap = 1").join(frozen, ["model", "snr", "question"]).select("unit_id", "frozen_id", F.col("fail").alias("fail_redrawn"), "fail_frozen")


@query(""", nq AS (SELECT max(question) + 1 AS k FROM units), redraws AS (
  SELECT b.unit_id, r.ok, r.fail FROM checked b, nq, range(5) g(i) JOIN checked r ON r.model = b.model AND r.snr = b.snr AND r.overlap = b.overlap AND r.question = (b.question + 1 + i) % k)
SELECT unit_id, count(*) AS n, count(*) FILTER (ok) AS n_ok, count(*) FILTER (fail) AS n_fail FROM redraws GROUP BY unit_id""")
def redraw_join(spark: S, d: str) -> DataFrame:
    u = checked(spark, d).select("unit_id", "model", "snr", "overlap", "question", "ok", "fail")
    k = F.broadcast(table(spark, d, "lineitem").groupBy("l_orderkey").count().where("count >= 3").agg((F.expr("max(l_orderkey) div 48") + 1).alias("k")))  # one row
    # a unit goes to its own key and, as a redraw, to the five keys before it: one shuffle by key and no join of units
    nothing = F.lit(None).cast("long")
    own = F.array(F.struct(F.col("question").alias("at"), F.col("unit_id").alias("base"), F.lit(0).alias("redraws")))
    to = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.struct(F.pmod(F.col("question") - i, F.col("k")).alias("at"), nothing.alias("base"), F.lit(1).alias("redraws")))
    rows = u.crossJoin(k).select("model", "snr", "overlap", "ok", "fail", F.inline(F.concat(own, to)))
    redrawn = F.col("redraws") == 1
    sums = rows.groupBy("model", "snr", "overlap", "at").agg(F.max("base").alias("unit_id"), F.count("base").alias("bases"), n_if(redrawn, "n"), n_if(redrawn & F.col("ok"), "n_ok"), n_if(redrawn & F.col("fail"), "n_fail"))
    once = F.when(F.col("bases") > 1, F.raise_error(F.lit("model, snr, overlap, question is no key")).cast("boolean")).otherwise(F.col("bases") == 1)
    return sums.where(once & (F.col("n") > 0)).select("unit_id", "n", "n_ok", "n_fail")


_FACTORS = ", designed AS (SELECT *, question % 4 AS wording, (question // 4) % 2 AS mapping, question // 4 AS grp, question // 8 AS pair FROM checked)"


def _designed(spark: S, d: str) -> DataFrame:
    return checked(spark, d).withColumns({"wording": F.pmod("question", F.lit(4)), "mapping": F.pmod(F.expr("question div 4"), F.lit(2)), "grp": F.expr("question div 4"), "pair": F.expr("question div 8")})


_MAPPED = _FACTORS + ", mapped AS (SELECT model, a.ok AS ok_a, b.ok AS ok_b, a.fail AS fail_a, b.fail AS fail_b FROM designed a JOIN designed b USING (model, snr, overlap, pair, wording) WHERE a.mapping = 0 AND b.mapping = 1)"


def _mapped(spark: S, d: str) -> DataFrame:
    return K.self_pairs(_designed(spark, d), ["model", "snr", "overlap", "pair", "wording"], "mapping", 0, 1, ["ok", "fail"])


@query(_MAPPED + "SELECT model, count(*) AS n, count(*) FILTER (ok_a AND ok_b) AS both_correct, count(*) FILTER (fail_a = fail_b) AS agree FROM mapped GROUP BY model")
def mapping_pairs(spark: S, d: str) -> DataFrame:
    return _mapped(spark, d).groupBy("model").agg(F.count("*").alias("n"), n_if(F.col("ok_a") & F.col("ok_b"), "both_correct"), n_if(F.col("fail_a") == F.col("fail_b"), "agree"))


@query(_MAPPED + """, s AS (SELECT model, avg((ok_a = ok_b)::INT) AS po, avg(ok_a::INT) AS pa, avg(ok_b::INT) AS pb, count(*) AS n FROM mapped GROUP BY model)
SELECT model, n, round(po, 9) AS po, round(pa * pb + (1 - pa) * (1 - pb), 9) AS pe, round((po - (pa * pb + (1 - pa) * (1 - pb))) / nullif(1 - (pa * pb + (1 - pa) * (1 - pb)), 0), 9) AS kappa FROM s""")
def cohen_kappa(spark: S, d: str) -> DataFrame:
    out = A.cohen_kappa(_mapped(spark, d), F.col("ok_a"), F.col("ok_b"), ["model"])
    return out.select("model", "n", *[F.round(c, 9).alias(c) for c in ("po", "pe", "kappa")])


@query(_FACTORS + "SELECT a.wording AS i, b.wording AS j, count(*) AS n, count(*) FILTER (a.ok = b.ok) AS agree FROM designed a JOIN designed b USING (model, snr, overlap, grp) WHERE a.wording < b.wording GROUP BY ALL")
def wording_pairs(spark: S, d: str) -> DataFrame:
    pairs = K.ordered_pairs(_designed(spark, d), ["model", "snr", "overlap", "grp"], "wording", ["ok"])
    return pairs.groupBy("i", "j").agg(F.count("*").alias("n"), n_if(F.col("ok_a") == F.col("ok_b"), "agree"))


@query(_FACTORS + "SELECT model, count(*) AS groups, round(avg((lo = hi)::INT), 9) AS unanimous FROM (SELECT model, min(ok::INT) AS lo, max(ok::INT) AS hi FROM designed GROUP BY model, snr, overlap, grp HAVING count(*) = 4) GROUP BY model")
def wording_unanimity(spark: S, d: str) -> DataFrame:
    groups = _designed(spark, d).groupBy("model", "snr", "overlap", "grp").agg(F.bool_and("ok").alias("all"), F.bool_or("ok").alias("some"), F.count("*").alias("n")).where("n = 4")
    return groups.groupBy("model").agg(F.count("*").alias("groups"), r9(F.avg((F.col("all") == F.col("some")).cast("int")), "unanimous"))


# --- categories -------------------------------------------------------------------------------------------------------


_CAT = ", cats AS (SELECT category, count(*) AS n_all, count(*) FILTER (ok) AS n, count(*) FILTER (fail) AS failures FROM checked GROUP BY category), rates AS (SELECT *, failures / n AS rate FROM cats WHERE n > 0), ranked AS (SELECT *, row_number() OVER (ORDER BY rate DESC, category) AS rk, ntile(5) OVER (ORDER BY rate DESC, category) AS q FROM rates)"


def _categories(spark: S, d: str) -> DataFrame:
    return checked(spark, d).groupBy("category").agg(F.count("*").alias("n_all"), n_if("ok", "n"), n_if("fail", "failures"))


def _ranked(spark: S, d: str) -> DataFrame:
    """Categories with their rate; a dimension table, so one task may order it."""
    rates = _categories(spark, d).where("n > 0").withColumn("rate", F.col("failures") / F.col("n"))
    return A.near_equal_groups(rates.withColumn("rk", A.ordinal_rank(F.col("rate").desc(), ["category"])), [F.col("rate").desc(), F.col("category")], 5, "q")


@query(_CAT + "SELECT category, n_all, n, failures FROM cats")
def category_tally(spark: S, d: str) -> DataFrame:
    return _categories(spark, d)


@query(_CAT + "SELECT category, round(rate, 9) AS rate, rk FROM ranked")
def category_rank(spark: S, d: str) -> DataFrame:
    return _ranked(spark, d).select("category", F.round("rate", 9).alias("rate"), "rk")


@query(_CAT + "SELECT q, count(*) AS categories, sum(n)::BIGINT AS n, sum(failures)::BIGINT AS failures, round(sum(failures) / sum(n), 9) AS rate FROM ranked GROUP BY q")
def quintiles(spark: S, d: str) -> DataFrame:
    return _ranked(spark, d).groupBy("q").agg(F.count("*").alias("categories"), F.sum("n").alias("n"), F.sum("failures").alias("failures"), r9(F.sum("failures") / F.sum("n"), "rate"))


@query(_CAT + ", qs AS (SELECT q, sum(failures) / sum(n) AS rate FROM ranked GROUP BY q) SELECT bool_and(before IS NULL OR rate <= before) AS monotone, count(*) AS groups FROM (SELECT rate, lag(rate) OVER (ORDER BY q) AS before FROM qs)")
def quintile_monotone(spark: S, d: str) -> DataFrame:
    qs = _ranked(spark, d).groupBy("q").agg((F.sum("failures") / F.sum("n")).alias("rate"))
    steps = qs.select("rate", F.lag("rate").over(Window.orderBy("q")).alias("before"))
    return steps.agg(F.bool_and(F.col("before").isNull() | (F.col("rate") <= F.col("before"))).alias("monotone"), F.count("*").alias("groups"))


@query(_CAT + "(SELECT 'top' AS side, category, round(rate, 9) AS rate FROM rates ORDER BY rates.rate DESC, category DESC LIMIT 10) UNION ALL (SELECT 'bottom', category, round(rate, 9) FROM rates ORDER BY rates.rate, category LIMIT 10)")
def category_extremes(spark: S, d: str) -> DataFrame:
    rates = _categories(spark, d).where("n > 0").withColumn("rate", F.col("failures") / F.col("n"))
    top = rates.orderBy(F.col("rate").desc(), F.col("category").desc()).limit(10).withColumn("side", F.lit("top"))
    bottom = rates.orderBy("rate", "category").limit(10).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom).select("side", "category", F.round("rate", 9).alias("rate"))


@query("SELECT category, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM checked WHERE fail GROUP BY category")
def mix_share(spark: S, d: str) -> DataFrame:
    return A.mix(checked(spark, d).where("fail"), "category").withColumn("share", F.round("share", 9))


@query(", mc AS (SELECT model, category, count(*) FILTER (fail) / nullif(count(*) FILTER (ok), 0) AS rate FROM checked GROUP BY ALL) SELECT model, arg_max(category, (rate, category)) AS most, arg_min(category, (rate, category)) AS least FROM mc WHERE rate IS NOT NULL GROUP BY model")
def argmax_label(spark: S, d: str) -> DataFrame:
    rates = _model_categories(spark, d)
    return rates.groupBy("model").agg(F.max_by("category", F.struct("rate", "category")).alias("most"), F.min_by("category", F.struct("rate", "category")).alias("least"))


def _model_categories(spark: S, d: str) -> DataFrame:
    return checked(spark, d).groupBy("model", "category").agg(M.share(F.col("fail"), F.col("ok")).alias("rate")).where("rate is not null")


@query(""", mc AS (SELECT model, category, count(*) FILTER (fail) / count(*) FILTER (ok) AS rate FROM checked GROUP BY ALL HAVING count(*) FILTER (ok) > 0),
pairs AS (SELECT a.model AS model_a, b.model AS model_b, a.rate AS x, b.rate AS y FROM mc a JOIN mc b USING (category) WHERE a.model < b.model),
ranks AS (SELECT model_a, model_b, rank() OVER (PARTITION BY model_a, model_b ORDER BY x) + (count(*) OVER (PARTITION BY model_a, model_b, x) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY model_a, model_b ORDER BY y) + (count(*) OVER (PARTITION BY model_a, model_b, y) - 1) / 2 AS ry FROM pairs)
SELECT model_a, model_b, round(corr(rx, ry), 9) AS rho, count(*) AS n FROM ranks GROUP BY ALL""")
def pairwise_rank_corr(spark: S, d: str) -> DataFrame:
    mc = _model_categories(spark, d)
    other = mc.select(F.col("model").alias("model_b"), "category", F.col("rate").alias("y"))
    pairs = mc.select(F.col("model").alias("model_a"), "category", F.col("rate").alias("x")).join(other, "category").where("model_a < model_b")
    return A.spearman(pairs, "x", "y", ["model_a", "model_b"]).select("model_a", "model_b", F.round("rho", 9).alias("rho"), "n")


@query("SELECT model, round(corr(mf, mt), 9) AS r FROM units GROUP BY model")
def pearson(spark: S, d: str) -> DataFrame:
    return units(spark, d).groupBy("model").agg(r9(F.corr("mf", "mt"), "r"))


@query("SELECT model, round(corr(rx, ry), 9) AS rho, count(*) AS n FROM (SELECT model, row_number() OVER (PARTITION BY model ORDER BY mf, unit_id) AS rx, row_number() OVER (PARTITION BY model ORDER BY mt, unit_id) AS ry FROM units) GROUP BY model")
def spearman_ordinal(spark: S, d: str) -> DataFrame:
    return A.spearman_of_units(units(spark, d).select("model", "unit_id", "mf", "mt"), "mf", "mt", ["model"], ties=["unit_id"]).select("model", F.round("rho", 9).alias("rho"), "n")


@query("SELECT model, round(corr(rx, ry), 9) AS rho, count(*) AS n FROM (SELECT model, rank() OVER (PARTITION BY model ORDER BY mf) + (count(*) OVER (PARTITION BY model, mf) - 1) / 2 AS rx, rank() OVER (PARTITION BY model ORDER BY mt) + (count(*) OVER (PARTITION BY model, mt) - 1) / 2 AS ry FROM units) GROUP BY model")
def spearman_avg(spark: S, d: str) -> DataFrame:
    return A.spearman_of_units(units(spark, d).select("model", "mf", "mt"), "mf", "mt", ["model"]).select("model", F.round("rho", 9).alias("rho"), "n")


@query("SELECT unit_id, model, h, mf FROM checked WHERE fail ORDER BY h, mf DESC, unit_id LIMIT 12")
def top_cases(spark: S, d: str) -> DataFrame:
    return checked(spark, d).where("fail").orderBy("h", F.col("mf").desc(), "unit_id").limit(12).select("unit_id", "model", "h", "mf")


# --- contrasts --------------------------------------------------------------------------------------------------------


@query(", m AS (SELECT model, count(*) FILTER (fail AND snr = -5) / nullif(count(*) FILTER (ok AND snr = -5), 0) - count(*) FILTER (fail AND snr = 5) / nullif(count(*) FILTER (ok AND snr = 5), 0) AS delta FROM checked GROUP BY model) SELECT count(*) FILTER (delta > 0) AS positive, count(*) FILTER (delta < 0) AS negative, count(*) AS models FROM m")
def sign_consistency(spark: S, d: str) -> DataFrame:
    at = lambda s: M.share(F.col("fail") & (F.col("snr") == s), F.col("ok") & (F.col("snr") == s))
    deltas = checked(spark, d).groupBy("model").agg((at(-5) - at(5)).alias("delta"))
    return deltas.agg(n_if(F.col("delta") > 0, "positive"), n_if(F.col("delta") < 0, "negative"), F.count("*").alias("models"))


@query(_FACTORS + ", m AS (SELECT model, mapping, avg((mf > 0)::INT) AS rate FROM designed GROUP BY ALL), p AS (SELECT model, avg(rate) AS macro FROM m GROUP BY model) SELECT model, round(macro, 9) AS macro, round(pooled, 9) AS pooled FROM p JOIN (SELECT model, avg((mf > 0)::INT) AS pooled FROM units GROUP BY model) USING (model)")
def macro_average(spark: S, d: str) -> DataFrame:
    rates = _designed(spark, d).groupBy("model", "mapping").agg(F.count_if("ok").alias("k"), F.count("*").alias("n"))
    return rates.groupBy("model").agg(r9(F.avg(F.col("k") / F.col("n")), "macro"), r9(F.sum("k") / F.sum("n"), "pooled"))


_SUBST = f", paired AS (SELECT b.model, b.tuple, b.question, {_LABEL.replace('category', 'b.category')} AS label, b.ok AS okb, s.ok AS oks, b.fail AS fb, s.fail AS fs FROM checked b JOIN checked s USING (model, snr, question) WHERE b.overlap = 0 AND s.overlap = 1)"
_EIGHT = {"itt_den": "oks", "itt_num": "fs", "both_den": "okb AND oks", "both_num": "okb AND fs", "b_itt_den": "okb", "b_itt_num": "fb", "b_both_den": "okb AND oks", "b_both_num": "oks AND fb"}


def paired_units(spark: S, d: str) -> DataFrame:
    """model, tuple, question, label, okb, oks, fb, fs: a base unit beside its substitution."""
    u = checked(spark, d)
    subst = u.where("overlap = 1").select("model", "snr", "question", F.col("ok").alias("oks"), F.col("fail").alias("fs"))
    base = u.where("overlap = 0").select("model", "snr", "question", "tuple", quintile().alias("label"), F.col("ok").alias("okb"), F.col("fail").alias("fb"))
    return base.join(subst, ["model", "snr", "question"])


@query(_SUBST + "SELECT model, tuple, label, " + ", ".join(f"count(*) FILTER ({p}) AS {k}" for k, p in _EIGHT.items()) + " FROM paired WHERE label IS NOT NULL GROUP BY ALL")
def subst_cells(spark: S, d: str) -> DataFrame:
    return paired_units(spark, d).where("label is not null").groupBy("model", "tuple", "label").agg(*[n_if(F.expr(p), k) for k, p in _EIGHT.items()])


@query(_SUBST + "SELECT question AS role, " + ", ".join(f"count(*) FILTER ({_EIGHT[k]}) AS {k}" for k in ("itt_den", "itt_num", "b_itt_den", "b_itt_num")) + " FROM paired WHERE label IS NOT NULL GROUP BY question")
def subst_roles(spark: S, d: str) -> DataFrame:
    return paired_units(spark, d).where("label is not null").groupBy(F.col("question").alias("role")).agg(*[n_if(F.expr(_EIGHT[k]), k) for k in ("itt_den", "itt_num", "b_itt_den", "b_itt_num")])


@query(_SUBST + ", r AS (SELECT label, count(*) FILTER (fs) / count(*) FILTER (oks) AS s, count(*) FILTER (fb) / count(*) FILTER (okb) AS b FROM paired WHERE label IS NOT NULL GROUP BY label) SELECT round(max(s) FILTER (label = 'Q1') - max(s) FILTER (label = 'Q5') - (max(b) FILTER (label = 'Q1') - max(b) FILTER (label = 'Q5')), 9) AS did FROM r")
def diff_in_diff(spark: S, d: str) -> DataFrame:
    def rate(num: str, den: str, label: str):
        return M.share(F.col(num) & (F.col("label") == label), F.col(den) & (F.col("label") == label))

    did = (rate("fs", "oks", "Q1") - rate("fs", "oks", "Q5")) - (rate("fb", "okb", "Q1") - rate("fb", "okb", "Q5"))
    return paired_units(spark, d).where("label is not null").agg(r9(did, "did"))


@query(""", x AS (SELECT *, round_even(mf / 0.5, 0) * 0.5 AS bin, ok::BIGINT AS n_ok, fail::BIGINT AS n_fail FROM checked),
cells AS (SELECT model, bin, snr, sum(n_fail) / sum(n_ok) AS rate FROM x WHERE overlap = 0 GROUP BY ALL HAVING sum(n_ok) > 0 AND count(*) >= 3)
SELECT round(sum(n_fail - n_ok * rate) / sum(n_ok), 9) AS delta, sum(n_ok)::BIGINT AS den, count(*) AS n_units FROM x JOIN cells USING (model, bin, snr) WHERE overlap = 1 AND n_ok > 0""")
def matched_delta(spark: S, d: str) -> DataFrame:
    x = checked(spark, d).withColumns({"bin": M.half_even_bin("mf") + 0.0, "n_ok": F.col("ok").cast("long"), "n_fail": F.col("fail").cast("long")})
    return A.standardised_delta(x.where("overlap = 1"), x.where("overlap = 0"), ["model", "bin", "snr"], "n_fail", "n_ok").withColumn("delta", F.round("delta", 9))


@query(""", o AS (SELECT mf, row_number() OVER (ORDER BY mf) - 1 AS i, count(*) OVER () - 1 AS last, 1 - (SELECT avg((mf > 0)::INT) FROM units WHERE model = 'm4') AS q FROM units WHERE model = 'm3'),
t AS (SELECT max(mf) FILTER (i = floor(q * last)) + (max(mf) FILTER (i = ceil(q * last)) - max(mf) FILTER (i = floor(q * last))) * (max(q * last) - floor(max(q * last))) AS tau FROM o) SELECT round(tau, 9) AS tau, count(*) FILTER (mf > tau) AS n, count(*) FILTER (mf > tau AND least(mf, mj_min) <= mt) AS failures FROM units, t WHERE model = 'm3' GROUP BY tau""")
def tau_matched(spark: S, d: str) -> DataFrame:
    u = units(spark, d)
    share = u.where("model = 'm4'").agg((1 - F.coalesce(F.avg(M.correct().cast("int")), F.lit(0.0))).alias("q"))
    own = u.where("model = 'm3'")
    tau = A.quantiles(own.select("mf").crossJoin(F.broadcast(share)), "mf", [], {"tau": F.col("q")})  # one row each
    sums = own.crossJoin(F.broadcast(tau)).groupBy("tau").agg(n_if(M.correct(F.col("tau")), "n"), n_if(M.failure(F.col("tau")), "failures"))
    return sums.select(F.round("tau", 9).alias("tau"), "n", "failures")


@query(f""", k AS (SELECT *, CASE WHEN ('0x' || substr(md5({SEED} || '|' || unit_id), 1, 8))::BIGINT % 2 = 0 THEN mj_min ELSE mj_max END AS kept FROM checked WHERE n_rivals = 2 AND ok)
SELECT model, count(*) AS n, count(*) FILTER (least(mf, kept) <= mt) AS failures, count(*) FILTER (fail) AS failures_both FROM k GROUP BY model""")
def kept_rival(spark: S, d: str) -> DataFrame:
    own = checked(spark, d).where("n_rivals = 2 and ok")
    kept = F.when(F.pmod(md5_int(F.lit(SEED), F.col("unit_id")), F.lit(2)) == 0, F.col("mj_min")).otherwise(F.col("mj_max"))
    return own.withColumn("kept", kept).groupBy("model").agg(F.count("*").alias("n"), n_if(F.least("mf", "kept") <= F.col("mt"), "failures"), n_if("fail", "failures_both"))


@query(""", p AS (SELECT model, snr, question, arg_min(dt, overlap) AS dt, max(max_dj) AS max_dj, sum(n_rivals)::BIGINT AS rivals FROM checked GROUP BY ALL HAVING count(*) = 2 AND bool_and(ok))
SELECT model, count(*) AS n, count(*) FILTER (dt - greatest(0, max_dj) <= 0) AS failures, sum(rivals)::BIGINT AS rivals FROM p GROUP BY model""")
def pooled_rivals(spark: S, d: str) -> DataFrame:
    own = checked(spark, d).withColumn("max_dj", M.max_dj()).groupBy("model", "snr", "question")
    pooled = own.agg(F.min_by("dt", "overlap").alias("dt"), F.max("max_dj").alias("max_dj"), F.sum("n_rivals").alias("rivals"), F.count("*").alias("k"), F.bool_and("ok").alias("all")).where("k = 2 and all")
    return pooled.groupBy("model").agg(F.count("*").alias("n"), n_if(F.col("dt") - F.greatest(F.lit(0.0), "max_dj") <= 0, "failures"), F.sum("rivals").alias("rivals"))


@query(f", r AS (SELECT model, avg((mf > 0)::INT) AS hit, avg((mt > 0)::INT) AS fa FROM units GROUP BY model) SELECT model, round({d_prime_sql('hit', 'fa')}, 9) AS dprime FROM r")
def dprime(spark: S, d: str) -> DataFrame:
    rates = checked(spark, d).groupBy("model").agg(F.avg((F.col("mf") > 0).cast("double")).alias("hit"), F.avg((F.col("mt") > 0).cast("double")).alias("fa"))
    return rates.select("model", F.round(d_prime("hit", "fa"), 9).alias("dprime"))


_FLOOR = 1e-3
_PROBES = ("oracle", "shortcut", "loudness", "additive_a0.5", "additive_a1.0", "additive_a2.0", "normalize_c1.0", "normalize_c10.0")


def probe_scores_of(f, target, most, total):
    """name -> score of synthetic detectors, from a floor f, the target's energy and the rivals' greatest and total."""
    log = lambda z: F.log1p(F.greatest(z, F.lit(0.0)) / f)
    out = {"oracle": log(target), "shortcut": log(most), "loudness": log(target + total)}
    out |= {f"additive_a{a}": log(target) - a * log(most) for a in (0.5, 1.0, 2.0)}
    return out | {f"normalize_c{c}": target / (f + c * most) for c in (1.0, 10.0)}


@query(f""", e AS (SELECT o, max(margin + 5) FILTER (rn = 1) AS t, coalesce(max(margin + 5) FILTER (rn >= 3), 0) AS m, coalesce(sum(margin + 5) FILTER (rn >= 3), 0) AS s, max(margin + 5) AS peak FROM scores GROUP BY o),
f AS (SELECT *, {_FLOOR} * CASE WHEN peak = 0 THEN 1 ELSE peak END AS f FROM e),
p AS (SELECT unnest([{', '.join(f"'{p}'" for p in _PROBES)}]) AS probe, unnest([ln(1 + t / f), ln(1 + m / f), ln(1 + (t + s) / f),
  ln(1 + t / f) - 0.5 * ln(1 + m / f), ln(1 + t / f) - ln(1 + m / f), ln(1 + t / f) - 2 * ln(1 + m / f), t / (f + m), t / (f + 10 * m)]) AS score FROM f)
SELECT probe, count(*) AS n, round(avg(score), 4) AS mean, round(min(score), 4) AS least, round(max(score), 4) AS most FROM p GROUP BY probe""")
def probe_scores(spark: S, d: str) -> DataFrame:
    e, rn = F.col("margin") + 5, F.col("rn")
    zero = F.lit(0.0)
    units_ = scores(spark, d).groupBy("condition_id").agg(
        F.max(F.when(rn == 1, e)).alias("t"), F.coalesce(F.max(F.when(rn >= 3, e)), zero).alias("m"), F.coalesce(F.sum(F.when(rn >= 3, e)), zero).alias("s"), F.max(e).alias("peak")
    )
    floor = F.lit(_FLOOR) * F.when(F.col("peak") == 0, 1.0).otherwise(F.col("peak"))
    made = probe_scores_of(floor, F.col("t"), F.col("m"), F.col("s"))
    rows = units_.select(F.inline(F.array(*[F.struct(F.lit(k).alias("probe"), v.alias("score")) for k, v in made.items()])))
    return rows.groupBy("probe").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean"), F.round(F.min("score"), 4).alias("least"), F.round(F.max("score"), 4).alias("most"))
