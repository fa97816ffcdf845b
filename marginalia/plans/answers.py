"""Scores from logit tables and the shapes of batches, over orders: a line item is a token, and makes its position's logits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import tokens
from marginalia.plans.base import query
from marginalia.plans.proxy import scores

S = SparkSession
#: Tokens of the vocabulary; the one that stands for a sound; rows of a batch; tokens of a label at most.
VOCABULARY, SOUND, BATCH, LABEL = 16, 3, 32, 2
LABELS = (("absent", 5), ("present", 11))


def order_tokens(spark: S, d: str) -> DataFrame:
    """row, pos, token, mask, partkey: the mask hides every seventh part, but an order's first line."""
    lines = scores(spark, d, views=None)
    mask = F.when((F.col("rn") > 1) & (F.col("partkey") % 7 == 0), 0).otherwise(1)
    return lines.select(F.col("condition_id").alias("row"), (F.col("rn") - 1).alias("pos"), (F.col("partkey") % VOCABULARY).alias("token"), mask.alias("mask"), "partkey")


def order_logits(spark: S, d: str) -> DataFrame:
    rows = order_tokens(spark, d).withColumn("vocabulary", F.explode(F.array(*[F.lit(t).cast("long") for t in range(VOCABULARY)])))
    logit = ((F.col("partkey") * 7 + F.col("vocabulary") * 13 + F.col("pos") * 5) % 97) / 8.0
    return rows.select("row", "pos", F.col("vocabulary").alias("token"), logit.alias("logit"))


_TOKENS = f""", tokens AS (SELECT o AS row, rn - 1 AS pos, l_partkey % {VOCABULARY} AS token, CASE WHEN rn > 1 AND l_partkey % 7 = 0 THEN 0 ELSE 1 END AS mask, l_partkey AS partkey FROM lines),
logits AS (SELECT row, pos, t AS token, ((partkey * 7 + t * 13 + pos * 5) % 97) / 8.0::DOUBLE AS logit FROM tokens, range({VOCABULARY}) r(t)),
logps AS (SELECT row, pos, token, logit - ln(sum(exp(logit)) OVER (PARTITION BY row, pos)) AS logp FROM logits),
sizes AS (SELECT row, count(*) AS n FROM tokens GROUP BY row)
"""


@query(_TOKENS + f""", cut AS (SELECT row, greatest(n - {LABEL}, 1) AS prompt_len FROM sizes WHERE n > 1)
SELECT c.row, c.prompt_len, count(*) AS n_label, round(sum(p.logp), 9) AS logp
FROM cut c JOIN tokens t ON t.row = c.row AND t.pos >= c.prompt_len JOIN logps p ON p.row = t.row AND p.pos = t.pos - 1 AND p.token = t.token GROUP BY c.row, c.prompt_len""")
def forced_scores(spark: S, d: str) -> DataFrame:
    full = order_tokens(spark, d)
    sizes = full.groupBy("row").agg(F.count("*").alias("n")).where("n > 1")
    full = full.join(sizes, "row")
    prompts = full.where(F.col("pos") < F.greatest(F.col("n") - LABEL, F.lit(1)))
    made = tokens.teacher_forced(prompts.select("row", "pos", "token"), full.select("row", "pos", "token"), order_logits(spark, d))
    return made.withColumn("logp", F.round("logp", 9))


@query(_TOKENS + f""", lasts AS (SELECT row, sum(mask) - 1 AS pos FROM tokens GROUP BY row), labels(label, token) AS (VALUES {", ".join(map(str, LABELS))})
SELECT l.row, a.label, a.token::BIGINT AS token, round(p.logp, 9) AS logp FROM lasts l, labels a JOIN logps p ON p.row = l.row AND p.pos = l.pos AND p.token = a.token""")
def answer_scores(spark: S, d: str) -> DataFrame:
    labels = spark.createDataFrame([(x, 0, t) for x, t in LABELS], "label string, pos int, token long")
    return tokens.answer_only(order_tokens(spark, d), order_logits(spark, d), labels).withColumn("logp", F.round("logp", 9))


@query(_TOKENS + f""", placed AS (SELECT row, n, (row_number() OVER (ORDER BY n, row) - 1) // {BATCH} AS batch FROM sizes)
SELECT row, batch, n AS length, max(n) OVER (PARTITION BY batch) AS width FROM placed""")
def length_batches(spark: S, d: str) -> DataFrame:
    rows = order_tokens(spark, d).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "token")))["token"].alias("ids"))
    return tokens.padded_batches(rows, BATCH).select("row", "batch", "length", "width")


@query(_TOKENS + f""", sounds AS (SELECT row, pos, round_even((partkey % 40 + 6) / 10.0, 0)::BIGINT * {tokens.ROUNDED_TO} AS run FROM tokens WHERE token = {SOUND} AND mask = 1)
SELECT t.row, (count(*) + sum(coalesce(s.run - 1, 0)))::BIGINT AS length, (count(*) + sum(coalesce(s.run - 1, 0)) - 1)::BIGINT AS pos
FROM tokens t LEFT JOIN sounds s ON s.row = t.row AND s.pos = t.pos WHERE mask = 1 AND t.row IN (SELECT row FROM sounds) GROUP BY t.row""")
def expanded_lengths(spark: S, d: str) -> DataFrame:
    """Orders with a sound token; its chunk attends to so many embeddings as its part says."""
    rows = order_tokens(spark, d)
    sounds = rows.where((F.col("token") == SOUND) & (F.col("mask") == 1))
    attended = F.sequence(F.lit(1).cast("long"), F.col("partkey") % 40 + 6)
    chunks = sounds.select("row", F.col("pos").alias("chunk"), F.explode(attended).alias("pos"), F.lit(1).alias("mask"))
    inputs = rows.join(sounds.select("row").distinct(), "row", "left_semi")
    return tokens.expanded_last(inputs.select("row", "pos", "token", "mask"), chunks, SOUND)
