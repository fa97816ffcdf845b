"""Units, scores and designs made from the driver's tables, and the same in SQL.

The line items of an order, numbered, are the views of a condition: the first is the full view, the second the one without
the target, the third and fourth the ones without a rival. Margins lie on a grid of sixteenths, so ties are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import metrics as M
from marginalia.operators.units import pivot_views

SNRS = (5, 0, -5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _div(x: str, n: int) -> Column:
    return F.expr(f"{x} div {n}")


def scores(spark: SparkSession, sf_dir: str, views: int | None = 4) -> DataFrame:
    """condition_id, rn, view, partkey, logp_present, logp_absent, margin: a row for each of the first `views` (None: all) views
    of each order. Designs have two rivals at most, so four views are all of a unit's in most plans."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", F.row_number().over(w).cast("long").alias("rn"))
    lines = lines if views is None else lines.where(F.col("rn") <= views)
    bonus = F.when(F.col("rn") == 1, 1.0).when(F.col("rn") == 2, -1.0).otherwise(0.5)
    margin = (F.col("l_quantity").cast("int") - 20) / F.lit(16.0) + bonus
    view = F.when(F.col("rn") == 1, "full").when(F.col("rn") == 2, "remove_target").otherwise(F.concat(F.lit("remove_off_"), (F.col("rn") - 2).cast("string")))
    rows = lines.select(F.col("l_orderkey").alias("condition_id"), "rn", view.alias("view"), F.col("l_partkey").alias("partkey"), margin.alias("margin"))
    return rows.withColumn("logp_present", F.col("margin") / 2).withColumn("logp_absent", -F.col("margin") / 2)


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit_id, model, snr, overlap, question, tuple, category, mf, mt, mj_min, mj_max, n_rivals."""
    wide = pivot_views(scores(spark, sf_dir), ["condition_id"], carried=["partkey"]).where(M.usable())
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("partkey"), F.col("p_brand").alias("category"))
    o = "condition_id"
    made = wide.join(part, "partkey", "left").select(
        F.col(o).alias("unit_id"), F.concat(F.lit("m"), F.pmod(o, F.lit(8)).cast("string")).alias("model"),
        F.element_at(F.array(*[F.lit(s).cast("long") for s in SNRS]), (F.pmod(_div(o, 8), F.lit(3)) + 1).cast("int")).alias("snr"),
        F.pmod(_div(o, 24), F.lit(2)).alias("overlap"), _div(o, 48).alias("question"), "category", "mf", "mt", "mj_min", "mj_max", "n_rivals",
    )
    return made.withColumn("tuple", F.pmod("question", F.lit(64)))


#: The same in SQL: lines, scores, units and, with every expression spelled out, checked.
CTE = """
WITH lines AS (
  SELECT l_orderkey AS o, l_partkey, l_quantity,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS rn
  FROM lineitem
), scores AS (
  SELECT o, rn, l_partkey, CASE rn WHEN 1 THEN 'full' WHEN 2 THEN 'remove_target' ELSE 'remove_off_' || (rn - 2) END AS view,
    (CAST(l_quantity AS INTEGER) - 20)::DOUBLE / 16 + (CASE rn WHEN 1 THEN 1.0 WHEN 2 THEN -1.0 ELSE 0.5 END)::DOUBLE AS margin
  FROM lines WHERE rn <= 4
), wide AS (
  SELECT o, max(margin) FILTER (rn = 1) AS mf, max(margin) FILTER (rn = 2) AS mt, min(margin) FILTER (rn >= 3) AS mj_min, max(margin) FILTER (rn >= 3) AS mj_max,
    count(*) FILTER (rn >= 3) AS n_rivals, max(l_partkey) FILTER (rn = 1) AS partkey
  FROM scores GROUP BY o HAVING count(*) >= 3
), units AS (
  SELECT o AS unit_id, 'm' || (o % 8) AS model, (CASE (o // 8) % 3 WHEN 0 THEN 5 WHEN 1 THEN 0 ELSE -5 END)::BIGINT AS snr, (o // 24) % 2 AS overlap, o // 48 AS question,
    (o // 48) % 64 AS tuple, p_brand AS category, mf, mt, mj_min, mj_max, n_rivals
  FROM wide LEFT JOIN part ON p_partkey = partkey
), checked AS (
  SELECT *, mf > 0 AS ok, mf - mt AS dt, mf - mj_min AS max_dj, least(mf, mj_min) - mt AS h, mf - mt - greatest(mf - mj_min, mj_max - mf) AS g,
    mf > 0 AND least(mf, mj_min) <= mt AS fail, mf > 0 AND mf <= mt AS ungr,
    CASE WHEN mf <= 0 THEN NULL WHEN mf - mt <= 0 THEN 'ungrounded' WHEN least(mf, mj_min) <= mt THEN 'confused'
      WHEN mf - mt - greatest(mf - mj_min, mj_max - mf) <= 0 THEN 'context' ELSE 'grounded' END AS state
  FROM units
)
"""
