"""Scores of answers from tables of tokens and logits, and the shapes of batches, without a model.

A model's output is rows (row, pos, token, logit): a row for each entry of the vocabulary at a position; what was fed to it is
rows (row, pos, token), with a mask where there is padding. Everything is a DataFrame expression; what the reference's adapters
refuse is raised at the first offending row, inside the running plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.ranks import numbered

#: Frames of a spectrogram below which there is no token.
LEAST_FRAMES = 5
# fixed values: what a number of audio embeddings is rounded to
ROUNDED_TO = 10


def raised(wrong: Column, message: Column, value: Column) -> Column:
    """value, or an error with this message where it is wrong."""
    return F.when(wrong, F.raise_error(message).cast("string")).otherwise(value.cast("string"))


# --- guards -----------------------------------------------------------------------------------------------------------


def single_token_labels(labels: DataFrame) -> DataFrame:
    """label, token of labels (label, pos, token), the table of a tokenizer; a label of no or several tokens is an error."""
    sizes = labels.groupBy("label").agg(F.count("token").alias("n"), F.max("token").alias("token"))
    message = F.concat(F.lit("label "), F.coalesce("label", F.lit("null")), F.lit(" has "), F.col("n").cast("string"), F.lit(" tokens"))
    return sizes.select("label", raised(F.col("n") != 1, message, F.col("token")).cast("long").alias("token"))


def with_audio(inputs: DataFrame, features: DataFrame) -> DataFrame:
    """inputs (row, ...) with n_features of features (row, ...); a row without any is an error, so no text is scored alone."""
    counts = features.groupBy("row").agg(F.count("*").alias("n_features"))
    joined = inputs.join(counts, "row", "left")
    message = F.concat(F.lit("row "), F.col("row").cast("string"), F.lit(" has no audio features"))
    return joined.withColumn("n_features", raised(F.col("n_features").isNull(), message, F.col("n_features")).cast("long"))


# --- scores -----------------------------------------------------------------------------------------------------------


def _named(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts])


def _scored(asked: DataFrame, logits: DataFrame) -> DataFrame:
    """asked (row, wanted: array of structs (pos, token, ...), ...; no row twice) with an entry each instead of the array, and its
    logp. Logits meet what their row asks for once, by row, so a table that is dealt by row is not shuffled: other positions go, and
    each position's exponents are summed in groups of near logits (512 apart), so none overflows and no largest one is looked for
    first. What is asked for is smaller than the logits by a vocabulary, and is the side that is hashed. A null or NaN logit at a
    position that is asked for is an error, and so is a token without a logit; minus infinity counts as impossible."""
    own = [c for c in asked.columns if c != "row"]
    keyed = asked.withColumns({"_places": F.array_distinct(F.col("wanted")["pos"]), "_keys": F.transform("wanted", lambda w: F.struct(w["pos"], w["token"]))})
    seen = logits.select(F.col("row").alias("_row"), F.col("pos").cast("long").alias("_pos"), F.col("token").cast("long").alias("_token"), F.col("logit").cast("double").alias("_logit"))
    joined = keyed.hint("shuffle_hash").join(seen, (F.col("row") == F.col("_row")) & F.array_contains("_places", F.col("_pos")), "left")
    hit = F.when(F.array_contains("_keys", F.struct(F.col("_pos").alias("pos"), F.col("_token").alias("token"))), F.col("_token"))
    broken = (F.col("_row").isNotNull() & (F.col("_logit").isNull() | F.isnan("_logit"))).cast("int")
    scale = F.rint(F.col("_logit") / 512)
    term = F.when(F.col("_logit") == float("-inf"), 0.0).otherwise(F.exp(F.col("_logit") - scale * 512))
    sums = joined.groupBy("row", *own, F.col("_pos").alias("pos"), hit.alias("token"), scale.alias("scale")).agg(F.sum(term).alias("sum"), F.max("_logit").alias("logit"), F.max(broken).alias("broken"))
    parts = sums.groupBy("row", *own).agg(F.collect_list(F.struct("pos", "token", "scale", "sum", "logit", "broken")).alias("_parts"))
    entries = parts.select("row", *[c for c in own if c != "wanted"], F.explode("wanted").alias("_w"), "_parts").withColumn("_own", F.filter("_parts", lambda p: p["pos"] == F.col("_w")["pos"]))
    top = F.array_max(F.col("_own")["scale"])
    total = F.aggregate("_own", F.lit(0.0), lambda a, p: a + p["sum"] * F.exp((p["scale"] - F.col("_top")) * 512))
    logit = F.get(F.filter("_own", lambda p: p["token"] == F.col("_w")["token"]), 0)["logit"]
    scored = entries.withColumn("_top", top).withColumns({"_logit": logit, "_normaliser": F.col("_top") * 512 + F.log(total)})
    at = ("row", F.col("row"), ", position ", F.col("_w")["pos"])
    invalid = F.array_max(F.col("_own")["broken"]) == 1
    logp = F.when(invalid, F.raise_error(_named("no logit at row ", *at[1:])).cast("double")).when(F.col("_logit").isNull(), F.raise_error(_named("no logit of token ", F.col("_w")["token"], " at row ", *at[1:])).cast("double")).otherwise(F.col("_logit") - F.col("_normaliser"))
    return scored.select("row", *[c for c in own if c != "wanted"], "_w.*", logp.alias("logp"))


def teacher_forced(prompts: DataFrame, full: DataFrame, logits: DataFrame) -> DataFrame:
    """row, prompt_len, n_label, logp: the log-probability of the tokens that full (row, pos, token) has behind those of prompts
    (row, pos, token); a position's logits predict the next one. Positions are from 0. A label that adds no token is an error, and so
    is one whose addition changes the prompt's own tokens, for then the two don't align. A row is a model's context, so its tokens are
    held as an array; everything is grouped and joined by row."""
    held = lambda df, name: df.groupBy("row").agg(F.count("*").alias(f"{name}_rows"), F.count("token").alias(f"{name}_len"), F.sort_array(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), F.col("token").cast("long").alias("token")))).alias(name))
    both = held(prompts, "_before").withColumnRenamed("_before_rows", "prompt_len").join(held(full, "_full"), "row", "left")
    changed = F.array_min(F.zip_with("_full", "_before", lambda t, b: F.when((t["pos"] < F.col("prompt_len")) & ~t.eqNullSafe(b), t["pos"])))
    both = both.withColumn("_changed", changed)
    short = F.coalesce("_full_len", F.lit(0)) <= F.col("prompt_len")
    length = raised(F.col("_changed").isNotNull(), _named("row ", F.col("row"), ": the label changes the prompt's token ", F.col("_changed")), raised(short, _named("row ", F.col("row"), ": no label behind the prompt"), F.col("prompt_len"))).cast("long")
    behind = F.transform(F.filter("_full", lambda t: t["pos"] >= F.col("prompt_len")), lambda t: F.struct((t["pos"] - 1).alias("pos"), t["token"].alias("token")))
    asked = both.select("row", length.alias("prompt_len"), behind.alias("wanted"))
    return _scored(asked, logits).groupBy("row", "prompt_len").agg(F.count("*").alias("n_label"), F.sum("logp").alias("logp"))


def last_positions(inputs: DataFrame) -> DataFrame:
    """row, pos of inputs (row, pos, mask): the number of attended tokens, less one, which is right for padding behind. A row that
    attends to nothing is an error. A null mask counts as attended, so inputs without masks end at their last token."""
    sums = inputs.groupBy("row").agg(F.sum(F.coalesce("mask", F.lit(1))).alias("n"))
    message = F.concat(F.lit("row "), F.col("row").cast("string"), F.lit(" attends to no token"))
    return sums.select("row", raised(F.col("n") <= 0, message, F.col("n") - 1).cast("long").alias("pos"))


def answer_only(inputs: DataFrame, logits: DataFrame, labels: DataFrame) -> DataFrame:
    """row, label, token, logp of every single-token label at each row's last attended position; labels are few and broadcast."""
    held = single_token_labels(labels).agg(F.collect_list(F.struct("label", "token")).alias("_labels"))
    wanted = F.transform("_labels", lambda x: F.struct(F.col("pos").alias("pos"), x["token"].alias("token"), x["label"].alias("label")))
    asked = last_positions(inputs).crossJoin(F.broadcast(held)).select("row", wanted.alias("wanted"))
    return _scored(asked, logits).select("row", "label", "token", "logp")


# --- batches ----------------------------------------------------------------------------------------------------------


def padded_batches(rows: DataFrame, batch_rows: int, pad: int = 0, left: bool = False) -> DataFrame:
    """row, batch, length, width, ids, mask of rows (row, ids array): batches of rows of neighbouring lengths, which pads least for
    batches of that many rows. Rows are numbered by (length, row) in ranges, so no task orders them all; padding is behind, or
    before where `left`. A null or empty array is a row of padding; a repeated row is a row of its own."""
    own = rows.select("row", F.coalesce("ids", F.array().cast("array<long>")).cast("array<long>").alias("ids")).withColumn("length", F.size("ids").cast("long"))
    placed = numbered(own, ["length", "row"], "place").withColumn("batch", F.floor(F.col("place") / batch_rows))
    widths = placed.groupBy("batch").agg(F.max("length").alias("width"))
    joined = placed.join(widths, "batch")
    n = (F.col("width") - F.col("length")).cast("int")
    padding, hidden, seen = F.array_repeat(F.lit(pad).cast("long"), n), F.array_repeat(F.lit(0), n), F.array_repeat(F.lit(1), F.col("length").cast("int"))
    ids, mask = (F.concat(padding, "ids"), F.concat(hidden, seen)) if left else (F.concat("ids", padding), F.concat(seen, hidden))
    return joined.select("row", "batch", "length", "width", ids.alias("ids"), mask.alias("mask"))


def padding_waste(batches: DataFrame) -> DataFrame:
    """n_batches, n_tokens, n_padded, waste (the share of padding) of padded_batches, in one row."""
    sums = batches.agg(F.count_distinct("batch").alias("n_batches"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_tokens"), F.coalesce(F.sum(F.col("width") - F.col("length")), F.lit(0)).alias("n_padded"))
    return sums.withColumn("waste", F.try_divide(F.col("n_padded").cast("double"), (F.col("n_tokens") + F.col("n_padded")).cast("double")))


def audio_runs(chunks: DataFrame) -> DataFrame:
    """row, chunk, run: a chunk's attended embeddings (row, chunk, pos, mask), as a multiple of ROUNDED_TO, half to even."""
    sums = chunks.groupBy("row", "chunk").agg(F.sum("mask").alias("n"))
    return sums.select("row", "chunk", (F.rint(F.col("n") / float(ROUNDED_TO)) * ROUNDED_TO).cast("long").alias("run"))


def expanded_positions(inputs: DataFrame, chunks: DataFrame, placeholder: int) -> DataFrame:
    """row, pos, token, start, run: where each attended token of inputs (row, pos, token, mask) stands once the row's n-th placeholder
    has become its n-th chunk's run of embeddings; text tokens are runs of one. A row whose placeholders and chunks differ in
    number, or that has no embedding at all, is an error. A row is a model's context, so its window is bounded."""
    order = Window.partitionBy("row").orderBy("pos")
    is_sound = F.col("token") == placeholder
    kept = inputs.where(F.coalesce("mask", F.lit(1)) != 0).withColumn("n_before", F.sum(is_sound.cast("long")).over(order) - is_sound.cast("long"))
    runs = audio_runs(chunks).withColumn("n_before", F.row_number().over(Window.partitionBy("row").orderBy("chunk")).cast("long") - 1)
    totals = runs.groupBy("row").agg(F.count("*").alias("n_chunks"), F.sum("run").alias("n_audio"))
    held = kept.groupBy("row").agg(F.sum(is_sound.cast("long")).alias("n_sounds")).join(totals, "row", "full")
    named = lambda text: F.concat(F.lit("row "), F.col("row").cast("string"), F.lit(text))
    wrong = F.coalesce("n_sounds", F.lit(0)) != F.coalesce("n_chunks", F.lit(0))
    silent = F.coalesce("n_audio", F.lit(0)) <= 0
    ok = raised(wrong, named(": placeholders and chunks differ in number"), raised(silent, named(": no audio embeddings"), F.lit(1))).cast("int")
    checked = held.select("row", ok.alias("ok")).where("ok = 1")
    joined = kept.join(runs.select("row", "n_before", "run"), ["row", "n_before"], "left").join(checked, "row")
    run = F.when(is_sound, F.col("run")).otherwise(F.lit(1)).cast("long")
    joined = joined.withColumn("run", run)
    return joined.select("row", "pos", "token", (F.sum("run").over(order) - F.col("run")).alias("start"), "run")


def expanded_last(inputs: DataFrame, chunks: DataFrame, placeholder: int, left: bool = False) -> DataFrame:
    """row, length, pos: a row's expanded length and the place of its last token, in a batch padded to the longest before (`left`)
    or behind."""
    lengths = expanded_positions(inputs, chunks, placeholder).groupBy("row").agg(F.sum("run").alias("length"))
    if not left:
        return lengths.withColumn("pos", F.col("length") - 1)
    most = lengths.agg(F.max("length").alias("most"))
    return lengths.join(F.broadcast(most), F.lit(True)).select("row", "length", (F.col("most") - 1).alias("pos"))


# --- token counts -----------------------------------------------------------------------------------------------------


def token_count(frames: Column | str) -> Column:
    """Tokens of a spectrogram of so many frames: two frames are lost, then halved twice and once more by a window of three with
    a margin of one."""
    return F.expr(token_count_sql(frames, "div")) if isinstance(frames, str) else F.floor((F.floor(F.floor((frames - 1) / 2) / 2) - 1) / 2) + 1


def token_count_sql(frames: str, div: str = "//") -> str:
    return f"((({frames} - 1) {div} 2) {div} 2 - 1) {div} 2 + 1"
