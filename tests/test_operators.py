import gzip
import hashlib
import io
import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.functions import text
from marginalia.functions.normal import d_prime, normal_quantile
from marginalia.operators import audio, cohorts, contracts, probes, ranks, resample, scorer, stats, units
from marginalia.sources import readers, schemas, writers
from marginalia.streaming.verdicts import running_totals


def test_pivot_and_views(spark):
    rows = [(1, "full", 1.0), (1, "remove_target", 0.0), (1, "remove_off_10", 3.0), (1, "remove_off_2", 2.0), (2, "full", -1.0)]
    got = {r["c"]: r for r in units.pivot_views(spark.createDataFrame(rows, "c int, view string, margin double"), ["c"], arrays=True).collect()}
    assert (got[1]["mf"], got[1]["mt"], got[1]["mj_min"], got[1]["mj_max"], got[1]["n_rivals"], got[1]["mj"]) == (1.0, 0.0, 2.0, 3.0, 2, [2.0, 3.0])
    assert got[2]["n_rivals"] == 0 and got[2]["mj"] == []
    nested = spark.createDataFrame([(1, [("full", None), ("remove_off_1", 1)])], "c int, views array<struct<intervention:string,removed_index:int>>")
    assert units.explode_views(nested).count() == 2


def test_shard_and_selection(spark):
    df = spark.range(20).withColumnRenamed("id", "k")
    assert sorted(r.k for i in range(3) for r in units.shard(df, "k", 3, i).collect()) == list(range(20))
    with pytest.raises(ValueError):
        units.shard(df, "k", 3, 3)
    assert [r.k for r in units.select_ids(df, "k", [7, 3, 11]).collect()] == [7, 3, 11]
    with pytest.raises(KeyError):
        units.select_ids(df, "k", [7, 99])


def test_correlations_and_kappa(spark):
    x, y = [1, 2, 2, 3, 5], [2, 1, 4, 4, 5]
    df = spark.createDataFrame(list(zip(range(5), x, y, strict=True)), "i int, x int, y int")

    def avg(v):
        v = np.array(v)
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    assert stats.spearman(df, "x", "y").first()["rho"] == pytest.approx(np.corrcoef(avg(x), avg(y))[0, 1])
    a, b = [1, 1, 0, 0, 1, 0], [1, 0, 0, 0, 1, 1]
    k = stats.cohen_kappa(spark.createDataFrame(list(zip(a, b, strict=True)), "a int, b int"), F.col("a") == 1, F.col("b") == 1).first()
    po, pe = 4 / 6, 0.5
    assert (k["po"], k["kappa"]) == pytest.approx((po, (po - pe) / (1 - pe)))


def test_cohorts(spark):
    df = spark.createDataFrame([(1, 5, True), (1, 0, True), (2, 5, True), (2, 0, False), (3, 5, True), (4, 5, True), (4, 5, True)], "k int, lvl int, ok boolean")
    assert [r.k for r in cohorts.complete_groups(df, ["k"], "lvl", 2, F.col("ok")).collect()] == [1]
    with pytest.raises(Exception, match="no key"):
        cohorts.self_pairs(df, ["k"], "lvl", 5, 0, ["ok"]).collect()
    pairs = cohorts.self_pairs(df.distinct(), ["k"], "lvl", 5, 0, ["ok"]).orderBy("k").collect()
    assert [(r.k, r.ok_a, r.ok_b) for r in pairs] == [(1, True, True), (2, True, False)]


@pytest.mark.parametrize("empty", ["clamp", "drop"])
def test_bootstrap_equals_numpy(spark, empty):
    num, den = np.array([3, 0, 5, 1, 0]), np.array([10, 4, 9, 2, 0])
    counts = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(num, den, strict=True))], "c int, num long, den long")
    m = np.random.default_rng(7).integers(0, 5, (400, 5))
    d = den[m].sum(1)
    want = num[m].sum(1)[d > 0] / d[d > 0] if empty == "drop" else num[m].sum(1) / np.maximum(d, 1)
    got = resample.cluster_bootstrap(counts, "c", {"r": ("num", "den")}, empty, resample.pcg64_draws(spark, 5, 400, 7)).first()
    assert (got["point"], got["lo"], got["hi"]) == pytest.approx((9 / 25, *np.percentile(want, [2.5, 97.5])))


def test_d_prime(spark):
    r = spark.createDataFrame([(0.975, 0.5), (1.0, 0.0)], "h double, f double").select(d_prime("h", "f").alias("d")).collect()
    assert r[0].d == pytest.approx(1.959964, abs=1e-5) and r[1].d == pytest.approx(2 * 4.753424, abs=1e-4)


def test_probes(spark):
    df = spark.createDataFrame([(1, [0, 1, 2], 1, {"0": 0.5, "1": 1.0, "2": 0.25}, {"full": 1.0, "remove_off_0": 1.0, "remove_off_2": 1.0})], "unit_id int, included_indices array<int>, target_index int, stem_rms map<string,double>, view_total_rms map<string,double>")
    got = {r["view"]: r for r in probes.surviving(df).collect()}
    assert got["full"]["rivals"] == [0.5, 0.25] and got["remove_target"]["target"] == 0.0 and got["remove_off_0"]["rivals"] == [0.25]
    rates = {r["probe"]: r["rankfail"] for r in probes.probe_summary(df).collect()}
    assert rates["oracle"] == 0.0 and rates["shortcut"] == 1.0


def test_scorer(spark):
    df = spark.createDataFrame([("c", "full", "a.wav", "q", "A", "B")], "condition_id string, intervention string, audio string, question string, y_present string, y_absent string")
    got = scorer.score_views(df, lambda: scorer.MockScorer({"a.wav": [-0.5, -1.0]})).first()
    assert got["margin"] == 0.5
    with pytest.raises(ValueError):
        scorer.normal_scores([float("nan"), 1], ["A", "B"])
    with pytest.raises(KeyError):
        scorer.normal_scores({"A": 1}, ["A", "B"])
    with pytest.raises(ValueError):
        scorer.normal_scores({}, [])

    class Any:
        def score(self, view, labels, **more):
            return [len(more["question"]), 0.0]

    assert scorer.call(Any(), "a.wav", ["A", "B"], "who") == {"A": 3.0, "B": 0.0}


def test_audio(spark, tmp_path):
    x, y = np.linspace(-0.5, 0.5, 100), np.full(40, 0.25)
    content = audio.encode(audio.mix([(0, x, 0, 1.0), (1, y, 60, 2.0)], 100))
    rate, back = readers.decode_wav(content, 32767, mono16=True)
    want = x.copy()
    want[60:] += 0.5
    assert rate == audio.RATE and np.abs(back - np.clip(want, -1, 1)).max() < 1 / 32767
    assert (audio.mix([(0, x, 0, 1.0), (1, y, 60, 2.0)], 100, 1) == x).all()
    for at in (61, -1):
        with pytest.raises(ValueError):
            audio.mix([(1, y, at, 1.0)], 100)
    assert audio.corrected(x, 1.0, None, float("nan")) is x and (audio.corrected(x, 0.5, 3.0) == x * 0.5 * 3.0).all()
    b = io.BytesIO()
    with wave.open(b, "wb") as w:
        w.setnchannels(2), w.setsampwidth(1), w.setframerate(8000), w.writeframes(bytes([128, 228, 28, 128]))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/b.wav").write_bytes(b.getvalue())
    assert readers.wav_files(spark, str(tmp_path / "in")).first()["samples"] == [50 / 128, -50 / 128]


def plain_view(row, events, rate, view):
    """A view by the rules, a source at a time."""
    target, included = row["target_index"], row["included_indices"]
    out = np.zeros(int(4.0 * rate))
    rivals = [i for i in included if i != target]
    for i in included:
        start = 1.0
        if row["overlap"] != "full" and i != target:
            early = (rivals.index(i) == 0) == (row["y_present"] == "A")
            start = 0.25 if early else 1.75
        if i != view["removed_index"]:
            at = int(start * rate)
            out[at : at + len(events[i])] += (row["target_gain"] if i == target else row["distractor_gain"]) * events[i]
    for factor in (view["normalization_gain"], view["shared_safety_gain"]):
        out = out if factor in (None, 1.0) else out * factor
    return audio.encode(out, rate)


def test_panels(spark, tmp_path):
    """All rules of the panels against a plain version: stems, substitutes by design, other tuples' stems, copies."""
    rng, rate = np.random.default_rng(3), 800
    names = [f"audio_sources/stems/t{t}/subset_{bit}.wav" for t in "ab" for bit in ("001", "010", "100")]
    stored = {ref: rng.uniform(-0.3, 0.3, 2 * rate + 40) for ref in names} | {"audio_sources/other.wav": rng.uniform(-0.2, 0.2, 2 * rate)}
    gain = {ref: 0.5 + k / 8 for k, ref in enumerate(names)}
    clips = spark.createDataFrame([(r, rate, x.tolist()) for r, x in stored.items()], "ref string, rate int, samples array<double>")
    index = spark.createDataFrame(list(gain.items()), schemas.SOURCE_AUDIO)
    stem = lambda t, e: stored[f"audio_sources/stems/t{t}/subset_{1 << e:03b}.wav"][20 : 20 + 2 * rate] / gain[f"audio_sources/stems/t{t}/subset_{1 << e:03b}.wav"]
    for panel in ("baseline", "global_rms", "subst", "repair"):
        rows, want = [], {}
        for k, (overlap, answer, target, included) in enumerate((("full", "A", 0, [0, 1, 2]), ("partial", "A", 1, [0, 1, 2]), ("partial", "B", 2, [2, 0, 1]), ("partial", "B", 0, [0, 2]))):
            row = {"condition_id": f"c{k}_snr5", "source_tuple_id": "tb", "overlap": overlap, "y_present": answer, "target_index": target, "included_indices": included, "target_gain": 0.75, "distractor_gain": 0.5}
            row |= {"repair_target": ["ta", "1"], "repair_distractors": [["tb", "0"], ["ta", "2"]]}
            events = [stem("b", e) for e in range(3)]
            if panel == "subst":
                events[target] = stored["audio_sources/other.wav"] * (1.5 + k)
            elif panel == "repair":
                events = [stem("a", 1), stem("b", 0), stem("a", 2)]
            views = []
            for removed in (None, *included):
                view = {"intervention": "v", "removed_index": removed, "audio": f"{panel}/{k}_{removed}.wav", "normalization_gain": 0.9 if panel == "global_rms" else 1.0, "shared_safety_gain": None if removed else 0.8}
                want[view["audio"]] = plain_view(row, events, rate, view)
                views.append(view | {"audio_sha256": hashlib.sha256(want[view["audio"]]).hexdigest()})
            rows.append(row | {"views": views})
        schema = "condition_id string, source_tuple_id string, overlap string, y_present string, target_index int, included_indices array<int>, target_gain double, distractor_gain double, repair_target array<string>, repair_distractors array<array<string>>, views array<struct<intervention:string,removed_index:int,audio:string,audio_sha256:string,normalization_gain:double,shared_safety_gain:double>>"
        manifest = spark.createDataFrame(rows, schema)
        design = spark.createDataFrame([(f"c{k}", "audio_sources/other.wav", 1.5 + k) for k in range(4)], schemas.SUBST_DESIGN)
        made = audio.render_panel(panel, manifest, clips, index, design)
        assert {r.path: bytes(r.content) for r in made.collect()} == want
        if panel == "subst":
            with pytest.raises(Exception, match="no design row for c3_snr5"):
                audio.render_panel(panel, manifest, clips, index, design.where("rid <> 'c3'")).collect()
            with pytest.raises(Exception, match="digest"):
                audio.render_panel("baseline", manifest, clips, index).collect()
    with pytest.raises(AssertionError, match="no common rate"):
        audio.render_panel("baseline", manifest, clips.unionByName(clips.limit(1).withColumn("rate", F.lit(9))), index)
    files = spark.createDataFrame([(f"audio_sources/{p}", c) for p, c in want.items()], "ref string, content binary")
    assert {r.path: bytes(r.content) for r in audio.copy_panel(manifest, files).collect()} == want
    for bad in (files.where("ref not like '%0_None%'"), files.withColumn("content", F.lit(b"x"))):
        with pytest.raises(Exception, match="no file, or another digest"):
            audio.copy_panel(manifest, bad).collect()
    assert [r.state for r in writers.addressed(made, str(tmp_path / "out")).collect()] == ["written"] * len(want)
    assert {r.state for r in writers.addressed(made, str(tmp_path / "out"), True).collect()} == {"verified"}
    with pytest.raises(Exception, match="repair"):
        writers.addressed(made, str(tmp_path / "out")).collect()


def test_small_audio_rules():
    x = np.arange(1, 41, dtype=float)
    assert audio.centre_crop(x, 2.0, 10).tolist() == x[10:30].tolist() and audio.centre_crop(x, 2.0, 100).tolist() == x.tolist()
    assert audio.source_clip(x, 2.0, 10).tolist() == (x[10:30] / 2).tolist()
    assert audio.envelope(np.array([0.0, -3, 1, 2]), 2).tolist() == [3.0, 2.0] and audio.envelope(np.array([1.0]), 3).tolist() == [1.0, 0.0, 0.0]
    assert readers.decode_wav(audio.encode(np.array([0.5])), 32768)[1][0] == np.rint(0.5 * 32767) / 32768


def test_release_contracts(spark, tmp_path):
    files = spark.createDataFrame([("a", b"one", 3), ("b", b"two", 3), ("c", b"see /root/x", 200)], "path string, content binary, length long")
    sums = spark.createDataFrame([("a", hashlib.sha256(b"one").hexdigest()), ("b", "0"), ("d", "1")], "path string, sha256 string")
    assert sorted(r.path for r in contracts.checksum_mismatches(files, sums).collect()) == ["b", "c", "d"]
    found = contracts.release_problems(files, text.sensitive(F.col("text")), 100)
    assert [tuple(r) for r in found.collect()] == [("c", "oversized")] and contracts.release_problems(files, text.sensitive(F.col("text"))).first()[1] == "sensitive pattern"
    own = text.own_places(("corp.example",), ("/mnt/data",))
    checked = spark.createDataFrame([("x.corp.example",), ("/mnt/data/y",), ("corp example /mnt",)], "t string").select(text.sensitive(F.col("t"), own))
    assert [r[0] for r in checked.collect()] == [True, True, False]
    agree = spark.createDataFrame([(1, 1), (1, 2), (None, 2), (1, None)], "a int, b int").select(contracts.agrees_where_both(F.col("a"), F.col("b")))
    assert [r[0] for r in agree.collect()] == [True, False, True, True]
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/bad.py").write_text("(")
    (tmp_path / "good.py").write_text("x = 1")
    (tmp_path / "bad.py").write_text("x = (")
    (tmp_path / "link").symlink_to(tmp_path / "good.py")
    assert contracts.tree_problems(str(tmp_path)) == [("bad.py", "syntax"), ("link", "symbolic link")]
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b")], "k int, m string")
    contracts.assert_design(df, {"rows": 4, "k": 2, "m": 2}, "design")
    contracts.assert_group_size(df, ["k"], 2, "groups")
    for check in (lambda: contracts.assert_design(df, {"rows": 5}, "x"), lambda: contracts.assert_group_size(df.limit(3), ["k"], 2, "x")):
        with pytest.raises(contracts.ContractError):
            check()


def test_ranks_and_quantiles_by_numpy(spark):
    rng = np.random.default_rng(11)
    rows = [(int(rng.integers(3)), i, float(rng.integers(8)), float(rng.integers(6)) if i % 9 else float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, id int, x double, y double")
    for ties in (None, ["id"]):
        a = {r.g: (r.rho, r.n) for r in stats.spearman(df, "x", "y", ["g"], ties).collect()}
        b = {r.g: (r.rho, r.n) for r in stats.spearman_of_units(df, "x", "y", ["g"], ties).collect()}
        assert a.keys() == b.keys() and all(a[g] == pytest.approx(b[g]) for g in a)
    got = {r.g: r for r in stats.quantiles(df.withColumn("q", F.lit(0.37)), "x", ["g"], {"a": 0.05, "b": 1.0, "c": F.col("q")}).collect()}
    for g in range(3):
        own = [r[2] for r in rows if r[0] == g]
        assert (got[g].a, got[g].b, got[g].c) == pytest.approx(tuple(np.percentile(own, [5, 100, 37])))


def test_order_of_presentation(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "m string, n int")
    assert [tuple(r) for r in units.in_order(df, "m", ("c", "a", "b")).collect()] == [("c", 3, 1), ("a", 1, 2), ("b", 2, 3)]
    with pytest.raises(Exception, match="no place for b"):
        units.in_order(df, "m", ("c", "a")).collect()


def test_inverse_normal(spark):
    from statistics import NormalDist

    ps = [1e-300, 1e-12, 1e-6, 0.001, 0.02, 0.0749, 0.075, 0.3, 0.5, 0.7, 0.925, 0.99, 1 - 1e-9]
    got = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0, None, -1.0]], "p double").select("p", normal_quantile("p").alias("z")).collect()
    assert [r.z for r in got[: len(ps)]] == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-13, abs=1e-15)
    assert [r.z for r in got[len(ps) :]] == [None] * 4


def test_sources_and_sinks(spark, tmp_path):
    row = {"condition_id": "c", "model_id": "m", "intervention": "full", "logp_present": -1.0, "logp_absent": -2.0, "margin": 1.0}
    for panel in ("p", "q"):
        (tmp_path / panel).mkdir()
        with gzip.open(tmp_path / panel / "m.jsonl.gz", "wt") as f:
            f.write(json.dumps(row) + "\n\n")
    (tmp_path / "INDEX.json").write_text(json.dumps([{"panel": p, "model": "m", "conditions": 1, "views": 1, "file": f"{p}/m.jsonl.gz", "sha256": ""} for p in ("p", "q")]))
    index = readers.score_index(spark, str(tmp_path / "INDEX.json"))
    got = readers.indexed_scores(spark, str(tmp_path), index, schemas.SCORE)
    assert sorted((r.panel, r.model, r.margin) for r in got.collect()) == [("p", "m", 1.0), ("q", "m", 1.0)]
    assert readers.panel_scores(spark, str(tmp_path), index, "q", "m", schemas.SCORE).count() == 1
    (tmp_path / "doc.json").write_text(json.dumps({"panels": {"baseline": [{"model_id": "m", "mf": 1.0, "mt": 0.0, "mj": [0.5]}]}}, indent=1))
    assert readers.json_document(spark, str(tmp_path / "doc.json"), "panels.baseline", schemas.UNIT).first()["mj"] == [0.5]
    (tmp_path / "k.jsonl").write_text('{"rid": "a", "rms_scale": 1.0}\n{"rid": "a", "rms_scale": 2.0}\n')
    with pytest.raises(AssertionError):
        readers.keyed_lookup(spark, str(tmp_path / "k.jsonl"), "rid", schemas.SUBST_DESIGN)
    macros = spark.createDataFrame([("Rate", "6.3\\%")], "name string, value string")
    writers.macro_file(macros, str(tmp_path / "macros"))
    assert [tuple(r) for r in readers.macros(spark, str(tmp_path / "macros")).collect()] == [("Rate", "6.3\\%")]
    with pytest.raises(ValueError):
        writers.macro_lines(macros.withColumn("name", F.lit("Rate1")))
    assert writers.table_rows(macros, ["name", "value"]).startswith("Rate & 6.3")
    writers.json_lines(macros, str(tmp_path / "lines"))
    writers.json_result(macros, str(tmp_path / "r.json"))
    m = writers.RunManifest()
    assert m.step("one", lambda: 5, (str(tmp_path / "r.json"),), (str(tmp_path / "doc.json"),)) == 5 and m.steps[0]["code"] == 0
    assert list(m.steps[0]["inputs"]) == [str(tmp_path / "doc.json")] and len(m.steps[0]["outputs"]) == 1
    (tmp_path / "m.jsonl").write_text('{"condition_id": "c", "views": []}\n')
    assert readers.manifest(spark, str(tmp_path / "m.jsonl")) is readers.manifest(spark, str(tmp_path / "m.jsonl")) and readers.manifest(spark, str(tmp_path / "m.jsonl")).count() == 1
    readers.release_kept()
    assert not readers._kept


def test_stream(spark, tmp_path):
    schema = "model string, mf double, mt double, mj_min double, mj_max double, n_rivals long"
    spark.createDataFrame([("a", 1.0, 0.0, 2.0, 2.0, 1), ("a", 1.0, 2.0, 2.0, 2.0, 1), ("a", float("nan"), 0.0, 1.0, 1.0, 1)], schema).write.parquet(str(tmp_path / "in"))
    stream = running_totals(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("totals").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("totals").collect()] == [("a", 2, 2, 1)]


def test_split_places_of_one_group(spark):
    """Continuous values in a single group: equal to numpy, and no range holds much over its share of them."""
    rng = np.random.default_rng(2)
    x, y = rng.normal(0, 1, 4000), rng.exponential(1, 4000)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id int, x double, y double")
    got = stats.quantiles(df, "x", [], {"a": 0.025, "b": 0.5, "c": 0.999}, buckets=16).first()
    assert tuple(got) == pytest.approx(tuple(np.percentile(x, [2.5, 50, 99.9])))
    order = lambda v: np.argsort(np.argsort(v))
    for ties in (None, ["id"]):
        assert stats.spearman_of_units(df, "x", "y", [], ties, buckets=16).first()["rho"] == pytest.approx(np.corrcoef(order(x), order(y))[0, 1])
    sizes = [r["count"] for r in ranks.bucketed(df, F.col("x"), 16).groupBy("_bucket").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 1.5 * 4000 / 16


def test_windows_of_places_are_by_range(spark):
    """No window that orders values lies over a whole group: each has the range among its partition columns."""
    df = spark.createDataFrame([(1, 2.0, 3)], "g int, x double, id int")
    for made in (stats.quantiles(df, "x", ["g"], {"a": 0.5}), stats.spearman_of_units(df, "x", "x", ["g"], ["id"])):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "windowspecdefinition" in line]
        assert windows and all("_bucket" in line.split("windowspecdefinition")[1] or "_n" in line for line in windows)
        assert not [line for line in windows if "x#" in line.split("windowspecdefinition")[1].split("specified")[0] and "_bucket" not in line]


def test_two_orders_read_the_rows_a_few_times(spark):
    """Both orders are cut and counted before rows are dealt: the table stands in the plan for the rows, the cuts and the counts only."""
    df = spark.range(100).selectExpr("id % 3 as g", "id", "id * 7 % 11 as x", "id * 5 % 13 as y")
    plan = stats.spearman_of_units(df, "x", "y", ["g"], ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 100") <= 6


@pytest.mark.parametrize("buckets", [2, 3, 16, 64])
def test_places_by_two_orders(spark, buckets):
    rng = np.random.default_rng(4)
    rows = [(None if i % 5 == 0 else int(rng.integers(3)), i, None if i % 17 == 0 else float(rng.integers(6)), float(rng.normal())) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, id int, x double, y double")
    got = {r.id: (r.a, r.b) for r in ranks.numbered_twice(df, {"a": ["x", "id"], "b": ["y", "id"]}, ["g"], buckets).collect()}
    for g in (None, 0, 1, 2):
        own = [r for r in rows if r[0] == g]
        for k, at in ((2, 0), (3, 1)):
            ordered = sorted(own, key=lambda r: (r[k] is not None, r[k] or 0.0, r[1]))
            assert [got[r[1]][at] for r in ordered] == list(range(len(own)))
    cut = ranks.bucketed(df, F.col("y"), buckets)
    bounds = cut.groupBy("_bucket").agg(F.min("y").alias("lo"), F.max("y").alias("hi")).orderBy("_bucket").collect()
    assert len(bounds) == buckets and all(a.hi < b.lo for a, b in zip(bounds, bounds[1:]))
    assert ranks.numbered_twice(df.limit(0), {"a": ["x"], "b": ["y"]}).count() == 0


def test_numbered_rows(spark):
    rows = [(g, v, i) for i, (g, v) in enumerate([(1, 2.0), (1, None), (2, 2.0), (1, 2.0), (None, 1.0), (2, -1.0)])]
    df = spark.createDataFrame(rows, "g int, v double, id int")
    got = {r.id: r.at for r in ranks.numbered(df, ["v", "id"], "at", ["g"], buckets=3).collect()}
    assert got == {0: 1, 1: 0, 2: 1, 3: 2, 4: 0, 5: 0}
    assert ranks.numbered(df.limit(0), ["v"], "at").count() == 0


@pytest.mark.parametrize(("clusters", "slice_outputs"), [(64, 100), (1, 100), (37, 50), (3_000_000_000, 7)])
def test_pcg64_slices_are_numpys(spark, clusters, slice_outputs):
    """Jumping ahead gives the same matrix, also where words are rejected (a third of them for the last size)."""
    draws = 40 if clusters < 1000 else 0
    if draws:
        got = {(r.draw, r.cluster_idx): r.multiplicity for r in resample.pcg64_draws(spark, clusters, draws, seed=9, slice_outputs=slice_outputs).collect()}
        want = {}
        for d, own in enumerate(np.random.default_rng(9).integers(0, clusters, (draws, clusters)).tolist()):
            for c in own:
                want[d, c] = want.get((d, c), 0) + 1
        assert got == want
    parts = np.concatenate([resample._bounded(i * slice_outputs, slice_outputs, clusters, 9) for i in range(20)])
    assert (parts == np.random.default_rng(9).integers(0, clusters, len(parts))).all()


def test_only_few_rows_come_to_the_driver(spark, tmp_path, monkeypatch):
    df = spark.range(5)
    monkeypatch.setattr(readers, "MOST_ROWS", 5)
    assert len(readers.few_rows(df, "it")) == 5
    writers.json_result(df, str(tmp_path / "five.json"))
    assert json.loads((tmp_path / "five.json").read_text()) == [{"id": k} for k in range(5)]
    monkeypatch.setattr(readers, "MOST_ROWS", 4)
    for sink in (lambda: writers.json_result(df, str(tmp_path / "r.json")), lambda: writers.table_rows(df, ["id"])):
        with pytest.raises(ValueError, match="over 4 rows"):
            sink()


def test_a_third_rival_has_no_onset(spark):
    df = spark.createDataFrame([("partial", "A", 0, [0, 1, 2, 3])], "overlap string, y string, target int, included array<int>")
    with pytest.raises(Exception, match="no onset for rival 3"):
        df.select(audio.onsets(F.col("overlap"), F.col("y"), F.col("target"), F.col("included"), F.lit(100))).collect()
