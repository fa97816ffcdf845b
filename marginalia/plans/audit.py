"""Views, verdicts, states, rates and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import metrics as M
from marginalia.functions import text as T
from marginalia.operators import contracts as C
from marginalia.operators import units as U
from marginalia.operators.stats import quantiles, swept
from marginalia.operators.units import in_order
from marginalia.plans.base import checked, n_if, query, r9
from marginalia.plans.proxy import scores, table, units

S = SparkSession
_COUNTS = "count(*) AS n, count(*) FILTER (ok) AS correct, count(*) FILTER (fail) AS failures, count(*) FILTER (ungr) AS ungrounded, count(*) FILTER (fail AND NOT ungr) AS confused"


def _tallies() -> list[Column]:
    return [F.count("*").alias("n"), n_if("ok", "correct"), n_if("fail", "failures"), n_if("ungr", "ungrounded"), n_if(F.col("fail") & ~F.col("ungr"), "confused")]


@query(f"SELECT coalesce(model, 'pooled') AS model, {_COUNTS} FROM checked GROUP BY ROLLUP (model)")
def audit_totals(spark: S, d: str) -> DataFrame:
    return checked(spark, d).rollup("model").agg(*_tallies()).withColumn("model", F.coalesce("model", F.lit("pooled")))


@query("""SELECT coalesce(model, 'pooled') AS model, round(count(*) FILTER (ok) / count(*), 9) AS accuracy,
  round(count(*) FILTER (fail) / nullif(count(*) FILTER (ok), 0), 9) AS rankfail FROM checked GROUP BY ROLLUP (model)""")
def model_rollup(spark: S, d: str) -> DataFrame:
    out = checked(spark, d).rollup("model").agg(r9(F.avg(F.col("ok").cast("double")), "accuracy"), r9(M.share(F.col("fail"), F.col("ok")), "rankfail"))
    return out.withColumn("model", F.coalesce("model", F.lit("pooled")))


@query("SELECT model, " + ", ".join(f"round(count(*) FILTER (state = '{s}') / nullif(count(*) FILTER (ok), 0), 9) AS {s}" for s in M.STATES) + ", round(count(*) FILTER (ok) / count(*), 9) AS accuracy FROM checked GROUP BY model")
def per_model_table(spark: S, d: str) -> DataFrame:
    shares = [r9(M.share(F.col("state") == s, F.col("ok")), s) for s in M.STATES]
    return checked(spark, d).groupBy("model").agg(*shares, r9(F.avg(F.col("ok").cast("double")), "accuracy"))


@query("SELECT o AS condition_id, mf, mt, mj_min, mj_max, n_rivals, mj_min AS first_rival FROM wide")
def unit_pivot(spark: S, d: str) -> DataFrame:
    wide = U.pivot_views(scores(spark, d), ["condition_id"], arrays=True).where("n_rivals > 0")
    return wide.select("condition_id", "mf", "mt", "mj_min", "mj_max", "n_rivals", F.element_at("mj", 1).alias("first_rival"))


@query("SELECT view, count(*) AS n, count(*) FILTER (abs(margin - margin / 2 - margin / 2) < 1e-8) AS consistent, sum(margin) AS total FROM scores GROUP BY view")
def margin_calc(spark: S, d: str) -> DataFrame:
    own = scores(spark, d).withColumn("made", M.margin())
    return own.groupBy("view").agg(F.count("*").alias("n"), n_if(F.abs(F.col("margin") - F.col("made")) < 1e-8, "consistent"), F.sum("made").alias("total"))


@query("SELECT unit_id, ok AS correct, h, g, fail AS failure, ungr AS ungrounded, fail AND NOT ungr AS confused FROM checked")
def verdict(spark: S, d: str) -> DataFrame:
    return units(spark, d).select("unit_id", M.correct().alias("correct"), M.h().alias("h"), M.g().alias("g"), M.failure().alias("failure"), M.ungrounded().alias("ungrounded"), M.confused().alias("confused"))


@query("SELECT unit_id, mf - mt AS dt, mf - mj_min AS max_dj, greatest(mf - mj_min, mj_max - mf) AS max_abs, mf - mt - greatest(0, mf - mj_min) AS h_diff FROM units")
def deletion_effects(spark: S, d: str) -> DataFrame:
    return units(spark, d).select("unit_id", M.dt().alias("dt"), M.max_dj().alias("max_dj"), M.max_abs_dj().alias("max_abs"), M.h_difference_form().alias("h_diff"))


@query("SELECT unit_id, state FROM checked")
def attribution_state(spark: S, d: str) -> DataFrame:
    return checked(spark, d).select("unit_id", "state")


@query("SELECT state, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM checked WHERE ok GROUP BY state")
def state_shares(spark: S, d: str) -> DataFrame:
    from marginalia.operators.stats import mix

    return mix(checked(spark, d).where("ok"), "state").select("state", "n", r9(F.col("share"), "share"))


@query("""SELECT n_conditions, count(*) AS n FROM (
  SELECT (dt <= 0)::BIGINT + (dt > 0 AND h <= 0)::BIGINT + (dt > 0 AND g <= 0)::BIGINT + (h > 0 AND g > 0)::BIGINT AS n_conditions FROM checked WHERE ok) GROUP BY n_conditions""")
def equation_overlap(spark: S, d: str) -> DataFrame:
    return checked(spark, d).where("ok").groupBy(M.printed_conditions().alias("n_conditions")).agg(F.count("*").alias("n"))


@query("""SELECT model, count(*) FILTER (ok AND (mt > 0 OR mj_min <= 0)) AS answer_flip, count(*) FILTER (ok AND dt <= 0) AS target_only,
  count(*) FILTER (ok AND mt > 0) AS target_removed FROM checked GROUP BY model""")
def paradigm_checks(spark: S, d: str) -> DataFrame:
    return units(spark, d).groupBy("model").agg(n_if(M.answer_flip(), "answer_flip"), n_if(M.target_only_alarm(), "target_only"), n_if(M.target_removed_alarm(), "target_removed"))


_CHECKS = {"answer_flip": "ok AND (mt > 0 OR mj_min <= 0)", "target_only": "ok AND dt <= 0", "target_removed": "ok AND mt > 0"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS check_name, count(*) FILTER ({p}) AS flagged, count(*) FILTER (({p}) AND NOT fail) AS false_alarms, count(*) FILTER (fail AND NOT ({p})) AS missed FROM checked" for k, p in _CHECKS.items()))
def checks_table(spark: S, d: str) -> DataFrame:
    alarms = F.array(*[F.struct(F.lit(k).alias("check_name"), a.alias("alarm")) for k, a in (("answer_flip", M.answer_flip()), ("target_only", M.target_only_alarm()), ("target_removed", M.target_removed_alarm()))])
    rows = checked(spark, d).select("fail", F.inline(alarms))
    return rows.groupBy("check_name").agg(n_if("alarm", "flagged"), n_if(F.col("alarm") & ~F.col("fail"), "false_alarms"), n_if(F.col("fail") & ~F.col("alarm"), "missed"))


@query(" UNION ALL ".join(f"SELECT {t}::DOUBLE AS tau, count(*) FILTER (mf > {t}) AS n, count(*) FILTER (mf > {t} AND least(mf, mj_min) <= mt) AS failures FROM units" for t in M.THRESHOLDS))
def threshold_sweep(spark: S, d: str) -> DataFrame:
    own = swept(units(spark, d).select("mf", "mt", "mj_min"), "tau", M.THRESHOLDS)
    return own.groupBy("tau").agg(n_if(M.correct(F.col("tau")), "n"), n_if(M.failure(F.col("tau")), "failures"))


@query(" UNION ALL ".join(f"SELECT {e}::DOUBLE AS eps, round(avg((abs(h) < {e})::INT), 9) AS inside, round(avg((h <= -{e})::INT), 9) AS below FROM checked WHERE ok" for e in M.BANDS))
def h_bands(spark: S, d: str) -> DataFrame:
    own = swept(checked(spark, d).where("ok").select("h"), "eps", M.BANDS)
    return own.groupBy("eps").agg(r9(F.avg((F.abs("h") < F.col("eps")).cast("int")), "inside"), r9(F.avg((F.col("h") <= -F.col("eps")).cast("int")), "below"))


_Q = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


@query("SELECT model, " + ", ".join(f"round(quantile_cont(h, {q}), 9) AS {k}" for k, q in _Q.items()) + ", min(h) AS least, max(h) AS most FROM checked WHERE ok GROUP BY model")
def h_quantiles(spark: S, d: str) -> DataFrame:
    made = quantiles(checked(spark, d).where("ok"), "h", ["model"], _Q | {"least": 0.0, "most": 1.0})
    return made.select("model", *[F.round(k, 9).alias(k) for k in _Q], "least", "most")


_EDGES = (0.0, 0.5, 1.0, 1.5, 2.0, float("inf"))


@query("SELECT bin, count(*) AS n, count(*) FILTER (fail) AS failures FROM (SELECT *, CASE " + " ".join(f"WHEN mf >= {a} AND mf < {b if b < 99 else 1e9} THEN {i}::BIGINT" for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:], strict=False))) + " END AS bin FROM checked) WHERE bin IS NOT NULL GROUP BY bin")
def margin_bins(spark: S, d: str) -> DataFrame:
    made = F.lit(None).cast("long")
    for i, (a, b) in reversed(list(enumerate(zip(_EDGES, _EDGES[1:], strict=False)))):
        made = F.when((F.col("mf") >= a) & (F.col("mf") < b), F.lit(i).cast("long")).otherwise(made)
    return checked(spark, d).withColumn("bin", made).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), n_if("fail", "failures"))


@query("SELECT round_even(mf / 0.5, 0) * 0.5 AS bin, count(*) AS n FROM units GROUP BY 1")
def half_even_bins(spark: S, d: str) -> DataFrame:
    return units(spark, d).groupBy((M.half_even_bin("mf") + 0.0).alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT model, round(avg(CASE WHEN mf > 0 THEN 1.0 WHEN mf = 0 THEN 0.5 ELSE 0.0 END::DOUBLE), 9) AS rate FROM units GROUP BY model")
def tie_credit_rate(spark: S, d: str) -> DataFrame:
    return units(spark, d).groupBy("model").agg(r9(F.avg(M.tie_credit("mf")), "rate"))


@query("SELECT tuple, count(*) FILTER (ok) AS n, count(*) FILTER (fail) AS failures, count(*) FILTER (ungr) AS ungrounded FROM checked GROUP BY tuple")
def cluster_counts(spark: S, d: str) -> DataFrame:
    return checked(spark, d).groupBy("tuple").agg(n_if("ok", "n"), n_if("fail", "failures"), n_if("ungr", "ungrounded"))


@query("SELECT count(DISTINCT model) AS models, count(DISTINCT tuple) AS tuples, count(DISTINCT question) AS questions, count(DISTINCT category) AS categories, count(DISTINCT (model, snr, overlap, question)) AS keys FROM units")
def distinct_counts(spark: S, d: str) -> DataFrame:
    n = F.count_distinct
    return units(spark, d).agg(n("model").alias("models"), n("tuple").alias("tuples"), n("question").alias("questions"), n("category").alias("categories"), n("model", "snr", "overlap", "question").alias("keys"))


# --- scans and contracts ----------------------------------------------------------------------------------------------


@query("SELECT unit_id, mf FROM units WHERE unit_id % 8 = 3")
def shard_scan(spark: S, d: str) -> DataFrame:
    return U.shard(units(spark, d), "unit_id", 8, 3).select("unit_id", "mf")


@query("SELECT unit_id, mf FROM units ORDER BY unit_id LIMIT 25")
def select_ids(spark: S, d: str) -> DataFrame:
    return U.select_ids(units(spark, d), "unit_id", limit=25).select("unit_id", "mf")


@query("SELECT unit_id, model, h FROM checked WHERE fail AND snr = 0 AND n_rivals = 2 ORDER BY h, unit_id LIMIT 1")
def case_lookup(spark: S, d: str) -> DataFrame:
    return checked(spark, d).where("fail and snr = 0 and n_rivals = 2").orderBy("h", "unit_id").limit(1).select("unit_id", "model", "h")


@query("SELECT count(*) AS duplicate_keys, coalesce(sum(n - 1), 0)::BIGINT AS surplus_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) WHERE n > 1", cte=False)
def unique_key(spark: S, d: str) -> DataFrame:
    found = C.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])
    return found.agg(F.count("*").alias("duplicate_keys"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("surplus_rows"))


def _manifest(spark: S, d: str) -> DataFrame:
    view = lambda name, k: F.struct(F.lit(name).alias("view"), F.lit(k).cast("long").alias("removed_index"))
    views = F.array(view("full", None), view("remove_target", None), view("remove_off_1", 1), view("remove_off_2", 2))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("condition_id"), F.col("o_orderstatus").alias("y_present"), views.alias("views"))


_MANIFEST = ", manifest AS (SELECT o_orderkey AS o, v.view, v.removed_index FROM orders, (VALUES ('full', NULL), ('remove_target', NULL), ('remove_off_1', 1), ('remove_off_2', 2)) v(view, removed_index))"


@query(_MANIFEST + "SELECT view, coalesce(removed_index, 0)::BIGINT AS removed_index, count(*) AS n FROM manifest GROUP BY ALL")
def explode_views(spark: S, d: str) -> DataFrame:
    return U.explode_views(_manifest(spark, d)).groupBy("view", F.coalesce("removed_index", F.lit(0).cast("long")).alias("removed_index")).agg(F.count("*").alias("n"))


@query(_MANIFEST + "SELECT view, count(*) AS n, sum(margin) AS total FROM scores JOIN manifest USING (o, view) GROUP BY view")
def score_manifest_join(spark: S, d: str) -> DataFrame:
    joined = scores(spark, d).join(U.explode_views(_manifest(spark, d)), ["condition_id", "view"])
    return joined.groupBy("view").agg(F.count("*").alias("n"), F.sum("margin").alias("total"))


@query(_MANIFEST + """SELECT 'extra' AS side, count(*) AS n FROM (SELECT DISTINCT o, view FROM scores) s WHERE NOT EXISTS (SELECT 1 FROM manifest m WHERE m.o = s.o AND m.view = s.view)
UNION ALL SELECT 'missing', count(*) FROM manifest m WHERE NOT EXISTS (SELECT 1 FROM scores s WHERE m.o = s.o AND m.view = s.view)""")
def anti_unmatched(spark: S, d: str) -> DataFrame:
    return C.coverage(scores(spark, d), U.explode_views(_manifest(spark, d)), ["condition_id", "view"])


@query("""SELECT 'extra' AS side, count(*) AS n FROM (SELECT DISTINCT category FROM units) WHERE category NOT IN (SELECT p_brand FROM part)
UNION ALL SELECT 'missing', count(*) FROM (SELECT DISTINCT p_brand FROM part) WHERE p_brand NOT IN (SELECT category FROM units WHERE category IS NOT NULL)""")
def coverage_equal(spark: S, d: str) -> DataFrame:
    return C.coverage(units(spark, d), table(spark, d, "part").select(F.col("p_brand").alias("category")), ["category"])


@query("SELECT count(*) AS n, count(*) FILTER (a.mf = b.mf AND a.mt = b.mt AND a.mj_min = b.mj_min AND a.mj_max = b.mj_max) AS equal FROM wide a JOIN units b ON a.o = b.unit_id")
def reconcile(spark: S, d: str) -> DataFrame:
    raw = U.pivot_views(scores(spark, d), ["condition_id"]).select(F.col("condition_id").alias("unit_id"), *[F.col(c).alias(f"raw_{c}") for c in ("mf", "mt", "mj_min", "mj_max")])
    same = F.lit(True)
    for c in ("mf", "mt", "mj_min", "mj_max"):
        same = same & (F.col(c) == F.col(f"raw_{c}"))
    return units(spark, d).join(raw, "unit_id").agg(F.count("*").alias("n"), n_if(same, "equal"))


@query("SELECT o_orderstatus AS y_present, count(*) AS n, count(*) FILTER (ok) AS correct FROM checked LEFT JOIN orders ON o_orderkey = unit_id GROUP BY o_orderstatus")
def truth_enrich(spark: S, d: str) -> DataFrame:
    truth = table(spark, d, "orders").select(F.col("o_orderkey").alias("unit_id"), F.col("o_orderstatus").alias("y_present"))
    return checked(spark, d).join(truth, "unit_id", "left").groupBy("y_present").agg(F.count("*").alias("n"), n_if("ok", "correct"))


@query("SELECT count(*) AS missing FROM (SELECT DISTINCT question FROM units WHERE model = 'm1') WHERE question NOT IN (SELECT question FROM units WHERE model = 'm0')")
def subset_check(spark: S, d: str) -> DataFrame:
    u = units(spark, d)
    return u.where("model = 'm1'").select("question").distinct().join(u.where("model = 'm0'"), "question", "left_anti").agg(F.count("*").alias("missing"))


@query("SELECT DISTINCT category FROM units WHERE model = 'm0' INTERSECT SELECT DISTINCT category FROM units WHERE model = 'm1'")
def set_intersect(spark: S, d: str) -> DataFrame:
    u = units(spark, d)
    return u.where("model = 'm0'").select("category").intersect(u.where("model = 'm1'").select("category"))


@query("SELECT DISTINCT question FROM checked WHERE model = 'm0' AND fail EXCEPT SELECT DISTINCT question FROM checked WHERE model = 'm1' AND fail")
def set_difference(spark: S, d: str) -> DataFrame:
    failed = checked(spark, d).where("fail").select("model", "question")
    return failed.where("model = 'm0'").select("question").distinct().join(failed.where("model = 'm1'"), "question", "left_anti")


#: The order in which models are shown.
ORDER = ("m5", "m0", "m3", "m7", "m1", "m6", "m2", "m4")


@query("SELECT place, model, n, failures FROM (SELECT model, count(*) AS n, count(*) FILTER (fail) AS failures FROM checked GROUP BY model) JOIN (VALUES " + ", ".join(f"('{m}', {i}::BIGINT)" for i, m in enumerate(ORDER, 1)) + ") o(model, place) USING (model) ORDER BY place")
def presentation_order(spark: S, d: str) -> DataFrame:
    own = checked(spark, d).groupBy("model").agg(F.count("*").alias("n"), n_if("fail", "failures"))
    return in_order(own, "model", ORDER).select("place", "model", "n", "failures")


_EVERY = """, every AS (
  SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS rn, l_quantity FROM lineitem
), wider AS (
  SELECT o, max(m) FILTER (rn = 1) AS mf, max(m) FILTER (rn = 2) AS mt, min(m) FILTER (rn >= 3) AS mj_min, count(*) FILTER (rn >= 3) AS n_rivals
  FROM (SELECT o, rn, (CAST(l_quantity AS INTEGER) - 20)::DOUBLE / 16 + (CASE rn WHEN 1 THEN 1.0 WHEN 2 THEN -1.0 ELSE 0.5 END)::DOUBLE AS m FROM every) GROUP BY o HAVING count(*) >= 3
)
"""


@query(_EVERY + "SELECT n_rivals, count(*) AS n, count(*) FILTER (mf > 0) AS correct, count(*) FILTER (mf > 0 AND least(mf, mj_min) <= mt) AS failures FROM wider GROUP BY n_rivals")
def all_rivals(spark: S, d: str) -> DataFrame:
    """Every line item of an order is a view, so units have as many rivals as there are."""
    wide = U.pivot_views(scores(spark, d, None), ["condition_id"]).where(M.usable())
    return wide.groupBy("n_rivals").agg(F.count("*").alias("n"), n_if(M.correct(), "correct"), n_if(M.failure(), "failures"))


@query("SELECT lvl, count(*) AS n FROM (SELECT 'low' AS lvl FROM units WHERE snr = -5 UNION ALL SELECT 'mid' FROM units WHERE snr = 0 UNION ALL SELECT 'high' FROM units WHERE snr = 5) GROUP BY lvl")
def union_levels(spark: S, d: str) -> DataFrame:
    u = units(spark, d)
    parts = [u.where(F.col("snr") == s).select(F.lit(k).alias("lvl")) for k, s in (("low", -5), ("mid", 0), ("high", 5))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("lvl").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS shared FROM (SELECT question FROM units GROUP BY question HAVING count(DISTINCT tuple) > 1)")
def disjoint_groups(spark: S, d: str) -> DataFrame:
    return units(spark, d).groupBy("question").agg(F.count_distinct("tuple").alias("k")).where("k > 1").agg(F.count("*").alias("shared"))


# --- text -------------------------------------------------------------------------------------------------------------


@query(r"SELECT p_partkey, CASE WHEN trim(p_type) <> '' AND NOT regexp_matches(trim(p_type), '\s') THEN trim(p_type) END AS label, CASE WHEN NOT regexp_matches(trim(p_brand), '\s') THEN trim(p_brand) END AS brand FROM part", cte=False)
def normalize_label(spark: S, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.normal_label(F.col("p_type")).alias("label"), T.normal_label(F.col("p_brand")).alias("brand"))


@query("""SELECT DISTINCT view, CASE WHEN starts_with(view, 'remove_off_') THEN regexp_extract(view, '_([^_]*)$', 1)::BIGINT ELSE 0 END AS rival, lpad(bin(rn), 3, '0') AS mask,
  upper(view[1]) || view[2:] AS title, view AS design, upper(view) AS kept_title, regexp_replace('Part' || CASE rn WHEN 1 THEN 'One' WHEN 2 THEN 'Two' WHEN 3 THEN 'Three' ELSE 'Four' END, 'x', 'x') AS macro FROM scores""")
def string_ops(spark: S, d: str) -> DataFrame:
    v = F.col("view")
    return scores(spark, d).select("view", "rn").distinct().select(
        "view", F.coalesce(T.rival_index(v), F.lit(0).cast("long")).alias("rival"), T.bit_mask(F.col("rn")).alias("mask"), T.title(v).alias("title"), T.design_id(F.concat(v, F.lit("_snr5"))).alias("design"),
        T.title(F.upper(v)).alias("kept_title"), T.macro_name(F.concat(F.lit("part "), F.col("rn").cast("string"))).alias("macro"),
    )


@query("SELECT 'N' || n_nationkey AS name, n_name AS value FROM nation", cte=False)
def macro_parse(spark: S, d: str) -> DataFrame:
    from marginalia.sources.readers import parse_macros

    lines = table(spark, d, "nation").select(F.concat(F.lit("\\newcommand{\\N"), F.col("n_nationkey").cast("string"), F.lit("}{"), F.col("n_name"), F.lit("}")).alias("line"))
    return parse_macros(lines, "line")


@query("""SELECT model, replace(printf('%.1f', avg(dt)), '-0.0', '0.0') AS mean_dt, printf('%.1f', 100 * count(*) FILTER (fail) / count(*)) || '%' AS rate, format('{:,}', count(*)) AS n,
  CASE WHEN printf('%.1f', avg(mt)) = '-0.0' THEN '+0.0' ELSE printf('%+.1f', avg(mt)) END AS signed FROM checked GROUP BY model""")
def format_numbers(spark: S, d: str) -> DataFrame:
    rate = F.count_if("fail") * F.lit(100.0) / F.count("*")
    return checked(spark, d).groupBy("model").agg(T.fixed(F.avg("dt"), 1).alias("mean_dt"), F.concat(T.fixed(rate, 1), F.lit("%")).alias("rate"), T.thousands(F.count("*")).alias("n"), T.signed(F.avg("mt"), 1).alias("signed"))


@query("SELECT source, count(*) AS n, count(*) FILTER (regexp_matches(text, '" + "|".join(f"(?:{p})" for p in T.SENSITIVE) + "')) AS found FROM documents GROUP BY source", cte=False)
def pattern_scan(spark: S, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), n_if(T.sensitive(F.col("text")), "found"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents", cte=False)
def sha256_digest(spark: S, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
