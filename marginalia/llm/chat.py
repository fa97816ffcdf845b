"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

A log often holds a conversation several times, each time with more turns. A rolling hash of every turn prefix is made by a
running exclusive or of two 64-bit hashes of (position, role, text). A conversation goes if its hash over all its turns is a
prefix hash of a longer one; of equal conversations the one with the least conv_id stays. Both are anti-joins over hashes that
are aggregated first, so common first turns and copies count once. What stays is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import stash

#: Turns of a conversation that are numbered and hashed together; longer ones are put together from several stretches.
STRETCH = 1024
#: A stretch of more rows than this (null turns, many rows of one turn) and than total / CROWDS is cut by ranges of its turns.
CROWD, CROWDS = 65_536, 40_000
#: The most ranges: Spark's sample for them, about 100 keys each, comes to the driver, so texts are ranged by their first characters.
RANGES, RANGED_BY = 1000, 256
#: How a turn is rendered; the role and the text take the braces' places.
TEMPLATE = ("<|im_start|>", "\n", "<|im_end|>\n")


def _render(role: Column, text: Column) -> Column:
    start, middle, end = TEMPLATE
    return F.concat(F.lit(start), role, F.lit(middle), text, F.lit(end))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), role, text, h1, h2: the hashes of the conversation up to and with this turn."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where("conv_id is not null").distinct()
    rows, part = _stretches(turns, rows)
    sizes = rows.groupBy("conv_id", *part).count()
    before = Window.partitionBy("conv_id").orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("conv_id", *part, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("conv_id", *part).orderBy("turn", "role", "text")
    rows = rows.join(sizes, ["conv_id", *part]).withColumn("pos", F.col("base") + F.row_number().over(own)).drop("base")
    rows = rows.withColumn("x1", F.xxhash64("pos", "role", "text")).withColumn("x2", F.xxhash64(F.lit("second"), "text", "role", "pos"))
    rolled = rows.withColumn("r1", F.bit_xor("x1").over(own)).withColumn("r2", F.bit_xor("x2").over(own))
    whole = rolled.groupBy("conv_id", *part).agg(F.bit_xor("x1").alias("w1"), F.bit_xor("x2").alias("w2"))
    whole = whole.select("conv_id", *part, *(F.coalesce(F.bit_xor(w).over(before), F.lit(0).cast("long")).alias(b) for w, b in (("w1", "b1"), ("w2", "b2"))))
    return rolled.join(whole, ["conv_id", *part]).select(
        "conv_id", "pos", "role", "text", F.col("r1").bitwiseXOR(F.col("b1")).alias("h1"), F.col("r2").bitwiseXOR(F.col("b2")).alias("h2")
    )


def _stretches(turns: DataFrame, rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows with the stretch that each is numbered in, and the columns that tell stretches of a conversation apart, in order."""
    stretch = F.floor(F.coalesce(F.col("turn").cast("long"), F.lit(-1)) / STRETCH).alias("stretch")
    rows = rows.select("*", stretch)
    counts = turns.select(F.col("conv_id").cast("long").alias("conv_id"), stretch).where("conv_id is not null").groupBy("conv_id", "stretch").count()
    crowds = stash(counts.where(F.col("count") > max(CROWD, turns.count() // CROWDS)), "crowds")  # fewer than CROWDS
    n = crowds.agg(F.sum("count")).first()[0]
    if n is None:
        return rows, ["stretch"]
    crowds = F.broadcast(crowds.drop("count"))
    keys = ["conv_id", "stretch"]
    ranged = rows.join(crowds, keys, "left_semi").repartitionByRange(min(RANGES, n // CROWD + 1), "conv_id", "turn", "role", F.substring("text", 1, RANGED_BY))
    dealt = stash(ranged.withColumn("part", F.spark_partition_id()), "dealt")  # so a range keeps its number
    return rows.join(crowds, keys, "left_anti").withColumn("part", F.lit(0)).unionByName(dealt), ["stretch", "part"]


def maximal_conversations(hashed: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that are no prefix of a longer one, the least conv_id of equal ones."""
    last = hashed.groupBy("conv_id").agg(F.max(F.struct("pos", "h1", "h2")).alias("last"))
    ends = last.groupBy("last").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies")).select("conv_id", "n_copies", "last.*")
    # a prefix that is shorter than its conversation: every turn but the last
    whole = last.select("conv_id", F.col("last.pos").alias("n"))
    inner = hashed.select("conv_id", "pos", "h1", "h2").join(whole, "conv_id").where("pos < n").select("pos", "h1", "h2").distinct()
    return ends.join(inner, ["pos", "h1", "h2"], "left_anti").select("conv_id", F.col("pos").alias("n_turns"), "n_copies")


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, rendered: the maximal conversations of (conv_id, turn, role, text).

    Turns are ordered by turn, role and text (null turns first) and repeated rows count once; a null role or text is empty;
    rows without a conv_id belong to no conversation and go; other columns are not carried; an empty table gives an empty
    result. A rendered conversation is one value, however long.
    """
    hashed = stash(prefix_hashes(turns), "hashed")  # it is read three times
    kept = maximal_conversations(hashed)
    parts = hashed.join(kept, "conv_id").select("conv_id", "n_turns", "n_copies", F.struct("pos", _render(F.col("role"), F.col("text")).alias("line")).alias("part"))
    lines = parts.groupBy("conv_id", "n_turns", "n_copies").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return lines.select("conv_id", "n_turns", "n_copies", F.concat_ws("", F.col("parts.line")).alias("rendered"))
