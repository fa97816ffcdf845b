"""Scores from logit tables, guards, batches and expanded positions against plain numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.operators import tokens

RNG = np.random.default_rng(5)
VOCABULARY = 40


def log_softmax(x):
    x = x - x.max()
    return x - np.log(np.exp(x).sum())


def logit_rows(spark, arrays):
    """arrays: row -> positions x vocabulary."""
    rows = [(r, p, t, float(v)) for r, a in arrays.items() for p, own in enumerate(a) for t, v in enumerate(own)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "row long, pos long, token long, logit double")


def token_rows(spark, texts, masks=None):
    rows = [(r, p, t, None if masks is None else masks[r][p]) for r, ids in texts.items() for p, t in enumerate(ids)]
    return spark.createDataFrame(rows, "row long, pos long, token long, mask int")


def test_teacher_forced_sums(spark):
    prompts = {r: RNG.integers(0, VOCABULARY, n).tolist() for r, n in ((1, 4), (2, 1), (3, 7))}
    full = {r: p + RNG.integers(0, VOCABULARY, n).tolist() for (r, p), n in zip(prompts.items(), (1, 3, 2), strict=True)}
    arrays = {r: RNG.normal(0, 300, (len(f), VOCABULARY)) for r, f in full.items()}
    arrays[2][1, 5] = -np.inf
    arrays[3][:] = 7.0  # ties
    got = {r.row: r for r in tokens.teacher_forced(token_rows(spark, prompts), token_rows(spark, full), logit_rows(spark, arrays)).collect()}
    for r, f in full.items():
        n = len(prompts[r])
        want = sum(log_softmax(arrays[r][p - 1])[f[p]] for p in range(n, len(f)))
        assert (got[r].prompt_len, got[r].n_label) == (n, len(f) - n) and got[r].logp == pytest.approx(want)


def test_teacher_forced_errors(spark):
    prompts, arrays = {1: [3, 4]}, {1: np.zeros((4, VOCABULARY))}
    for full, message in (({1: [3, 4]}, "row 1: no label"), ({1: [3, 9, 9]}, "changes the prompt's token 1"), ({1: [3, 4, VOCABULARY]}, "no logit of token 40 at row 1")):
        with pytest.raises(Exception, match=message):
            tokens.teacher_forced(token_rows(spark, prompts), token_rows(spark, full), logit_rows(spark, arrays)).collect()
    arrays[1][1, 2] = np.nan
    with pytest.raises(Exception, match="no logit at row 1, position 1"):
        tokens.teacher_forced(token_rows(spark, prompts), token_rows(spark, {1: [3, 4, 5]}), logit_rows(spark, arrays)).collect()


def test_answers_at_the_last_attended_position(spark):
    ids = {r: RNG.integers(0, VOCABULARY, 6).tolist() for r in range(5)}
    masks = {r: [1] * (6 - r) + [0] * r for r in ids}
    arrays = {r: RNG.normal(0, 800, (6, VOCABULARY)) for r in ids}
    arrays[2][:, :] = 700.0
    labels = spark.createDataFrame([("yes", 0, 7), ("no", 0, 8)], "label string, pos int, token long")
    got = {(r.row, r.label): r.logp for r in tokens.answer_only(token_rows(spark, ids, masks), logit_rows(spark, arrays), labels).collect()}
    assert len(got) == 10
    for (r, label), logp in got.items():
        assert logp == pytest.approx(log_softmax(arrays[r][5 - r])[7 if label == "yes" else 8])
    unmasked = {r.row: r.pos for r in tokens.last_positions(token_rows(spark, ids)).collect()}
    assert set(unmasked.values()) == {5}


def _exploded(spark, n):
    """Tokens of rows dealt by row, and the logits made of them, an entry of the vocabulary each."""
    own = spark.range(n).selectExpr("id div 3 as row", "id % 3 as pos", "id % 5 as token").repartition(3, "row")
    return own, own.selectExpr("row", "pos", f"explode(sequence(0L, {VOCABULARY - 1}L)) as token").withColumn("logit", (F.col("row") * 3 + F.col("pos") + F.col("token")) % 7 * 1.0)


def _dealt_rows(df):
    """Rows that all exchanges of the plan have written, once it has run."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(p):
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(p.executedPlan())
        if "QueryStage" in name:
            return walk(p.plan())
        if name == "Exchange":
            found.append(p.metrics().apply("shuffleRecordsWritten").value())
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(plan)
    return sum(found)


def test_forced_logits_stay_with_their_rows(spark):
    """No entry of the vocabulary is shuffled where the logits are dealt by row: exchanges have rows of tokens only."""
    own, logits = _exploded(spark, 300)
    made = tokens.teacher_forced(own.where("pos < 1"), own, logits)
    assert made.count() == 100 and _dealt_rows(made) <= 300 * 4


def test_answer_logits_stay_with_their_rows(spark):
    """The same for answers, for which only the few labels are dealt beside the tokens."""
    own, logits = _exploded(spark, 300)
    labels = spark.createDataFrame([("yes", 0, 7), ("no", 0, 8)], "label string, pos int, token long")
    made = tokens.answer_only(own.withColumn("mask", F.lit(1)), logits, labels)
    assert made.count() == 200 and _dealt_rows(made) <= 300 * 3


def test_far_logits_and_missing_rows(spark):
    """Logits in many groups of scale, at their borders, and impossible ones, as numpy has them; a row without any is an error."""
    arrays = {1: np.array([[-1e300, 1e300, 0, 255.9], [256, 256.1, -256, 767.9], [-5000, -5001, -np.inf, -5600], [0, 0, 0, 0]])}
    for token in range(4):
        prompts, full = {1: [0]}, {1: [0, 1, token, token]}
        (got,) = tokens.teacher_forced(token_rows(spark, prompts), token_rows(spark, full), logit_rows(spark, arrays)).collect()
        want = sum(log_softmax(arrays[1][p - 1])[full[1][p]] for p in range(1, 4))
        assert got.n_label == 3 and got.logp == pytest.approx(want)
    with pytest.raises(Exception, match="no logit of token 3 at row 2, position 0"):
        tokens.teacher_forced(token_rows(spark, {2: [0]}), token_rows(spark, {2: [0, 3]}), logit_rows(spark, arrays)).collect()


def test_guards_name_the_row(spark):
    for rows, message in (([("yes", 0, 7), ("maybe", 0, 1), ("maybe", 1, 2)], "label maybe has 2 tokens"), ([("none", 0, None)], "label none has 0 tokens")):
        with pytest.raises(Exception, match=message):
            tokens.single_token_labels(spark.createDataFrame(rows, "label string, pos int, token long")).collect()
    inputs = spark.createDataFrame([(1, "a"), (2, "b")], "row long, key string")
    with pytest.raises(Exception, match="row 2 has no audio features"):
        tokens.with_audio(inputs, spark.createDataFrame([(1, 0.5), (1, 0.25)], "row long, x double")).collect()
    with pytest.raises(Exception, match="row 4 attends to no token"):
        tokens.last_positions(token_rows(spark, {4: [1, 2]}, {4: [0, 0]})).collect()


@pytest.mark.parametrize("left", [False, True])
def test_batches_pad_least(spark, left):
    rng = random.Random(3)
    rows = {r: [rng.randrange(1, 99) for _ in range(rng.choice((0, 1, 2, 3, 17, 40)))] for r in range(50)}
    df = spark.createDataFrame([*rows.items(), (50, None)], "row long, ids array<long>")
    got = tokens.padded_batches(df, 8, pad=-1, left=left)
    held = {}
    for r in got.collect():
        own = rows.get(r.row, [])
        blank = [-1] * (r.width - len(own))
        assert r.ids == (blank + own if left else own + blank)
        assert r.mask == ([0] * len(blank) + [1] * len(own) if left else [1] * len(own) + [0] * len(blank))
        held.setdefault(r.batch, []).append((len(own), r.row, r.width))
    assert sorted(len(b) for b in held.values()) == [3] + [8] * 6 and all(w == max(n for n, _, _ in b) for b in held.values() for _, _, w in b)
    sizes = sorted([*map(len, rows.values()), 0])
    least = sum(max(sizes[i : i + 8]) * len(sizes[i : i + 8]) - sum(sizes[i : i + 8]) for i in range(0, len(sizes), 8))
    waste = tokens.padding_waste(got).first()
    assert (waste.n_batches, waste.n_tokens, waste.n_padded) == (7, sum(sizes), least) and waste.waste == pytest.approx(least / (least + sum(sizes)))


def test_expanded_positions_go_back_to_masks(spark):
    """Placeholders become runs; the places they take are those that text tokens leave."""
    sound = 9
    ids = {1: [4, sound, 5, sound, 6], 2: [sound, 7, 8, 0, 0], 3: [1, sound]}
    masks = {1: [1] * 5, 2: [1, 1, 1, 0, 0], 3: [1, 1]}
    attended = {1: [[1] * 25, [1] * 14 + [0] * 6], 2: [[1] * 35], 3: [[1] * 15 + [0] * 5]}
    chunks = spark.createDataFrame([(r, c, p, m) for r, own in attended.items() for c, mask in enumerate(own) for p, m in enumerate(mask)], "row long, chunk int, pos int, mask int")
    inputs = token_rows(spark, ids, masks)
    runs = {1: [round(25 / 10) * 10, 10], 2: [round(35 / 10) * 10], 3: [round(15 / 10) * 10]}
    got = {}
    for r in tokens.expanded_positions(inputs, chunks, sound).collect():
        got.setdefault(r.row, []).append((r.start, r.pos, r.token, r.run))
    last = {r.row: (r.length, r.pos) for r in tokens.expanded_last(inputs, chunks, sound).collect()}
    ahead = {r.row: r.pos for r in tokens.expanded_last(inputs, chunks, sound, left=True).collect()}
    for r, rows in got.items():
        rows.sort()
        mask = [kind for _, _, t, n in rows for kind in ([1] * n if t == sound else [0])]
        assert [s for s, _, _, _ in rows] == list(np.cumsum([0, *[n for _, _, _, n in rows[:-1]]]))
        assert [n for _, _, t, n in rows if t == sound] == runs[r] and sum(mask) == sum(runs[r])
        assert [t for _, _, t, _ in rows] == [t for t, m in zip(ids[r], masks[r], strict=True) if m]
        assert last[r] == (len(mask), len(mask) - 1) and ahead[r] == max(n for n, _ in last.values()) - 1
    for changed, message in ((chunks.where("row <> 3"), "row 3: placeholders and chunks differ"), (chunks.withColumn("mask", chunks["mask"] * 0), "no audio embeddings")):
        with pytest.raises(Exception, match=message):
            tokens.expanded_positions(inputs, changed, sound).collect()


def test_token_counts_by_strides(spark):
    """Counted by moving windows: a convolution of stride 2, a pooling by 2, and one of three with a margin of one and stride 2."""

    def counted(n):
        first = len(range(0, n - 2 + 1 - 1, 2))  # places of a window of two with one more at the end
        second = len(range(0, first - 1, 2))
        padded = second + 2
        return len(range(0, padded - 2, 2))

    frames = list(range(tokens.LEAST_FRAMES, 400))
    df = spark.createDataFrame([(n,) for n in frames], "n long")
    got = [tuple(r) for r in df.select("n", tokens.token_count("n"), tokens.token_count(df["n"])).collect()]
    assert got == [(n, counted(n), counted(n)) for n in frames] and all(eval(tokens.token_count_sql(str(n))) == counted(n) for n in frames)
