"""Near-duplicates, chat, fingerprints, pages, URLs, quality and the pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from marginalia.llm import chat, common, components, htmltext, imatch, packing, quality, queries, simhash, urlrules
from marginalia.llm.common import stash

DOCS = "doc_id long, text string, lang string, bits string, component_id long"


def docs(spark, texts):
    """With columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "x", 7) for i, t in enumerate(texts)], DOCS)


def words_of(rng, n):
    return [rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa la mu nu xi omi pi rho".split()) + str(rng.randrange(30)) for _ in range(n)]


def near_texts(seed=3, groups=12, copies=6):
    rng, out = random.Random(seed), []
    for _ in range(groups):
        base = words_of(rng, rng.randint(40, 200))
        for _ in range(copies):
            own = list(base)
            own[rng.randrange(len(own))] = "changed"
            out += [" ".join(own)] * rng.choice((1, 1, 2))
    rng.shuffle(out)
    return [*out, None, "", " \n\t", "One", "one", "Two words", "three short words", "É É É É"]


# --- simhash ----------------------------------------------------------------------------------------------------------


def brute_simhash(text, size=3):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints, distance=3):
    """Least index reachable, by all pairs."""
    n = len(prints)
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(n)]


@pytest.mark.parametrize(("hot", "hubs"), [(simhash.HOT, 1000), (1, 3)])
def test_near_duplicates(spark, hot, hubs, monkeypatch):
    monkeypatch.setattr(common, "HUBS", hubs)
    texts = [*near_texts(), "very " * 100_000, "very long " * 60_000]
    prints = [brute_simhash(t) for t in texts]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, texts), hot=hot).collect()}
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in range(len(texts))] == classes(prints)


@pytest.mark.parametrize("hot", [simhash.HOT, 2])
def test_links_join_what_near_pairs_join(spark, hot):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    prints = set(base)
    for b in base:
        x = b
        for _ in range(60):  # walks of near steps, and bursts around one
            x ^= sum(1 << i for i in rng.sample(range(64), rng.randint(1, 5)))
            prints |= {x, b ^ sum(1 << i for i in rng.sample(range(rng.choice((16, 32, 64))), 3))}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "bits long")
    found = components.components(simhash.links(df, hot)).collect()
    parts = {}
    for r in found:
        parts.setdefault(r.component, set()).add(r.node)
    want = {}
    for i, c in enumerate(classes(prints)):
        want.setdefault(c, set()).add(signed[i])
    assert sorted(map(sorted, parts.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


@pytest.mark.parametrize("hot", [simhash.HOT, 1])
def test_wide_links(spark, hot):
    """All pairs of up to 7 bits are joined, no pair of over 10 is linked."""
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = sorted({b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 7))) for b in base for _ in range(4)} | set(base))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.wide_links(spark.createDataFrame([(p,) for p in signed], "bits long"), hot=hot).collect()
    assert all((((r.a ^ r.b) & ((1 << 64) - 1)).bit_count()) <= 10 for r in found)
    part = {r.node: r.component for r in components.components(spark.createDataFrame([tuple(r) for r in found], "a long, b long")).collect()}
    for i, p in enumerate(prints):
        for q, s in zip(prints[:i], signed, strict=False):
            if (p ^ q).bit_count() <= 7:
                assert part[signed[i]] == part[s]


def test_wide_keys_tell_fingerprints_apart(spark):
    keys = {}
    for r in simhash.wide_keys(spark.createDataFrame([(0x0123456789ABCDEF,), (0x7EDCBA9876543210,)], "bits long")).collect():
        keys.setdefault(r.bits, set()).add(r.key)
    a, b = keys.values()
    assert len(a) == len(b) == 6 * 27 + 4 * 26 and not a & b


def test_long_buckets_give_a_forest():
    bits = np.array([1 << i for i in range(20)] + [0xFF << 40, 0xFE << 40], np.uint64)
    keys = np.zeros(len(bits), np.int64)
    a, b = simhash.bucket_links(keys, np.sort(bits))
    assert len(a) == len(bits) - 2 and all((int(x) ^ int(y)).bit_count() <= 3 for x, y in zip(a, b, strict=True))


def shingle_set(text, size=5):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def alike_classes(texts):
    """Least index reachable by pairs with a Jaccard similarity of 0.8."""
    sets = [shingle_set(t) for t in texts]
    parent = list(range(len(texts)))
    links = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    for _ in texts:
        before = list(parent)
        for i, j in links:
            parent[i] = parent[j] = min(parent[i], parent[j])
        if parent == before:
            return parent
    return parent


def texts_about_the_threshold():
    rng = random.Random(6)
    texts = near_texts(5, 14, 5)
    for n in (50, 100, 300):  # one stretch changed, to a similarity of 0.8 and a little under and over
        for cut in range(n // 14, n // 7):
            base = words_of(rng, n)
            texts += [" ".join(base), " ".join(base[:cut] + base[2 * cut :])]
    base = words_of(rng, 120)  # a chain: neighbours are alike, its ends are not, and all share most bands
    for k in range(30):
        base = base[:k * 4] + words_of(rng, 2) + base[k * 4 + 2 :]
        texts.append(" ".join(base))
    return texts


CLASHING = "doc_id long, text string, mark string, _of string, _hash string, n string, keys string, bits string"


@pytest.mark.parametrize(("size", "pivots"), [(512, 2), (2, 2), (3, 0)])
def test_representatives(spark, size, pivots):
    """Components by brute-force Jaccard, buckets that a task holds and larger ones alike: pairs under 0.8 that fingerprints link
    stay, pairs at 0.8 that they miss go."""
    texts = texts_about_the_threshold()
    parent = alike_classes(texts)
    df = spark.createDataFrame([(i, t, "a", "b", "c", "d", "e", "f") for i, t in enumerate(texts)], CLASHING)
    keep = lambda x: simhash.keep_representatives(x, size=size, pivots=pivots)
    odd = df.unionByName(df.where("doc_id < 3")).unionByName(spark.createDataFrame([(None, "quite another text of its own here", *"abcdef")] * 2 + [(None, texts[0], *"abcdef")], CLASHING))
    got = keep(odd)
    assert got.columns == df.columns
    got = got.collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(set(parent)) and len(got) == len(set(parent)) + 1
    assert {tuple(r)[2:] for r in got} == {tuple("abcdef")}
    if size == 512:
        assert sorted(set(classes([brute_simhash(t, 5) for t in texts], 10))) != sorted(set(parent))
        assert keep(df.where("false")).count() == 0 and simhash.near_duplicates(df.where("false")).count() == 0


def test_ids_on_rows_of_different_texts(spark):
    """A clean text is not lost by its id, nor does a near-duplicate stay by it."""
    a, b, c = (" ".join(words_of(random.Random(i), 60)) for i in (1, 2, 3))
    rows = [(1, a, "", "", 0), (1, b, "", "", 0), (2, b, "", "", 0), (3, c, "", "", 0), (4, a, "", "", 0), (4, "alone " + c[::-1], "", "", 0)]
    got = simhash.keep_representatives(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted((r[0], r[1]) for r in (rows[0], rows[1], rows[3], rows[5]))


@pytest.mark.parametrize("hubs", [1000, 2])
def test_components_of_paths_and_stars(spark, hubs, monkeypatch):
    monkeypatch.setattr(common, "HUBS", hubs)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 180)] + [(200, 200), (300, 299), (299, 300)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 180)} | {299: 299, 300: 299}
    assert got == want
    assert components.components(spark.createDataFrame([(None, 1), (1, None)], "a long, b long")).count() == 0


def test_shared_folder(spark, tmp_path, monkeypatch):
    """spark.checkpoint.dir is where tables go; without it a cluster is an error."""

    class Session:
        def __init__(self, **conf):
            self.conf = {k.replace("_", "."): v for k, v in conf.items()}

    assert common.scratch_dir(Session(spark_checkpoint_dir="hdfs://x/y", spark_master="yarn")) == "hdfs://x/y"
    assert common.scratch_dir(Session(spark_master="local[3]")) == common.scratch_dir(Session(spark_master="local"))
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(RuntimeError):
            common.scratch_dir(Session(spark_master=master))


# --- chat -------------------------------------------------------------------------------------------------------------


CHAT = "conv_id long, turn long, role string, text string, pos long"


def brute_chats(rows):
    convs = {}
    for c, t, r, x, _ in set(rows):
        if c is not None:
            convs.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    lines = {c: tuple((r, x) for _, r, x in sorted(v)) for c, v in convs.items()}
    out = {}
    for c, v in sorted(lines.items()):
        if not any(len(w) > len(v) and w[: len(v)] == v for w in lines.values()) and v not in {lines[k] for k in out}:
            out[c] = (len(v), sum(w == v for w in lines.values()), "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in v))
    return out


def test_chats(spark, monkeypatch):
    rng, rows = random.Random(6), []
    for c in range(60):
        root = rng.randrange(5)
        n = rng.randint(1, 7)
        rows += [(c, t, "user" if t % 2 else "assistant", f"{root} {t}" if t < 4 or rng.random() < 0.7 else "other", 9) for t in range(n)]
    rows += [(70, None, None, None, 9), (70, 3, "user", "", 9), (70, 3, "user", "", 9), (None, 1, "user", "lost", 9), (71, 5, "user", "tie a", 9), (71, 5, "user", "tie b", 9), (72, 0, "user", "é" * 5000, 9)]
    df = spark.createDataFrame(rows, CHAT)
    for stretch in (1024, 2):
        monkeypatch.setattr(chat, "STRETCH", stretch)
        assert {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in chat.format_chats(df).collect()} == brute_chats(rows)
    assert chat.format_chats(df.where("false")).count() == 0


def test_chats_of_many_null_turns(spark, monkeypatch):
    """Null turns and rows of one turn, more than a task is to hold, are cut by ranges and put together again."""
    monkeypatch.setattr(chat, "CROWD", 40)
    rng = random.Random(8)
    null_turns = [(None, rng.choice(["user", "assistant"]), f"said {rng.randrange(1000)} é") for _ in range(400)]
    one_turn = [(3, "user", f"again {i}") for i in range(150)]
    talks = {1: null_turns, 2: null_turns + one_turn, 3: one_turn, 4: null_turns + [(5, "user", "end")], 5: [(1, "user", "hi")], 6: one_turn + one_turn, 7: [(None, None, None)]}
    rows = [(conv, *turn, 9) for conv, talk in talks.items() for turn in talk] + [(None, None, "user", "lost", 9)] * 100
    tables = []
    monkeypatch.setattr(chat, "stash", lambda df, label: tables.append((label, df)) or common.stash(df, label))
    df = spark.createDataFrame(rows, CHAT)
    assert {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in chat.format_chats(df).collect()} == brute_chats(rows)
    dealt = next(table for label, table in tables if label == "dealt")
    assert max(r["count"] for r in dealt.groupBy("part").count().collect()) < 200


def test_chat_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, 1, "user", "a", 1)], CHAT)
    assert not re.search("Python|Pandas|Arrow", chat.format_chats(df)._jdf.queryExecution().toString())


# --- I-Match ----------------------------------------------------------------------------------------------------------


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(imatch, "STRETCH", 7)
    rng = random.Random(9)
    texts = [" ".join(words_of(rng, rng.randint(30, 150))) for _ in range(60)]
    texts += [None, "", "é", "abc", texts[0], texts[0]]
    ids = rng.sample(range(-50, 500), len(texts))
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, prints string")
    got = {r.doc_id: r for r in imatch.fingerprint_documents(df, 0.02, 0.6).collect()}
    order = sorted(zip(ids, texts, strict=True))
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_next <= 1 and 0 <= got[i].near_edited <= 1
    same = [got[i].fingerprint for i, t in zip(ids, texts, strict=True) if t == texts[0]]
    assert len(set(same)) == 1 and len({r.fingerprint for r in got.values()}) > 50
    long = [r for r in got.values() if r.n_chars > 100]
    assert np.mean([r.near_edited for r in long]) > 3 * np.mean([r.near_next for r in long])
    assert imatch.fingerprint_documents(df.where("false")).count() == 0
    one = imatch.fingerprint_documents(df.where(f"doc_id = {order[0][0]}")).collect()
    assert len(one) == 1
    odd = df.unionByName(df.limit(3)).unionByName(spark.createDataFrame([(None, "no id", "x")], df.schema))
    out = imatch.fingerprint_documents(odd).collect()
    assert len(out) == len(texts) + 4 and [r.n_chars for r in out if r.doc_id is None] == [5]


def xx(*values):
    """xxhash64 of one value or an array, as signed 64 bits."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


def brute_prints(text, lexicon):
    every = sorted(xx(t) for t in set(re.split(r"[^\w]+|_", text.lower())) - {""})
    pool, out = [h for h in every if h in lexicon], []
    for level in range(imatch.LEVELS):
        for subset in range(imatch.SUBSETS):
            own = [h for h in pool if ((h & (1 << 64) - 1) >> 7 * level) % (imatch.SUBSETS << level) == subset] if level else [h for h in pool if h % imatch.SUBSETS == subset]
            out.append((xx(*own) if own else 0) if pool else xx(*every) if every else 0)
    return out


def brute_likeness(a, b):
    def share(pairs):
        some = [(x, y) for x, y in pairs if x or y]
        return sum(x == y != 0 for x, y in some) / len(some) if some else 1.0

    pairs, k = list(zip(a, b, strict=True)), imatch.SUBSETS
    full = max(level if sum(bool(x or y) for x, y in pairs[level * k : level * k + k]) >= k - 1 else 0 for level in range(imatch.LEVELS))
    return max(share(pairs), share(pairs[full * k :]))


def test_fingerprints_by_brute_force(spark, monkeypatch):
    """Lexicon, fingerprints, edited texts' fingerprints and likeness, a document at a time; short, empty and very long texts too."""
    monkeypatch.setattr(imatch, "STRETCH", 11)
    rng = random.Random(21)
    texts = [" ".join(words_of(rng, rng.randint(20, 200))) for _ in range(50)]
    texts += [None, "", "?!", "oneoff words", "oneoff Words!", "other oneoffs", texts[3], texts[3], " ".join(words_of(rng, 30_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n, counts = len(texts), Counter(t for x in texts for t in set(re.split(r"[^\w]+|_", (x or "").lower())) - {""})
    words = {t for t, c in counts.items() if max(2, 0.05 * n) <= c <= max(2, 0.3 * n)}
    assert {r.term for r in imatch.lexicon(df, 0.05, 0.3).collect()} == words and words
    lexicon = {xx(t) for t in words}
    show = lambda prints: "".join(f"{h & (1 << 64) - 1:016x}" for h in prints)
    got = {r.doc_id: r for r in imatch.fingerprint_documents(df, 0.05, 0.3).collect()}
    for i, text in enumerate(texts):
        text, after = text or "", texts[(i + 1) % n] or ""
        cut = len(text) // 4
        own, edited, following = (brute_prints(x, lexicon) for x in (text, text[: len(text) - cut] + after[:cut], after))
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (show(own), show(edited))
        assert (got[i].near_edited, got[i].near_next) == (pytest.approx(brute_likeness(own, edited)), pytest.approx(brute_likeness(own, following)))
    short = texts.index("oneoff words")
    assert got[short].near_next == 1.0 and got[short + 1].near_next == 0.0 and got[short - 1].near_next == 0.0


@pytest.mark.parametrize("crowds", [(None,), (None, 700), (1, 1399)])
def test_next_of_crowded_ids(spark, crowds):
    """Tens of thousands of rows of one id, or of none: each row is followed once, ids in order, and no slot holds an id's rows."""
    rows = [(i, f"own {i}") for i in range(1, 1400) if i not in crowds]
    rows += [(crowd, f"text {i % 9000} of {crowd}") for crowd in crowds for i in range(24_000)] + [(crowds[0], "copy")] * 26_000
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(24)
    got = imatch.with_next(df, []).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    assert Counter(r.next_text for r in got) == Counter(text for _, text in rows)
    # without what follows itself, the texts make one ring, and ids ascend along it
    ring = {r.text: r.next_text for r in got if r.text != r.next_text}
    ids = {text: -1 if i is None else i for i, text in rows}
    first = [text for text in ring if ids[text] == min(ids.values())]
    start = next(text for text in first if not any(ring[other] == text for other in first))
    way = [start]
    while ring[way[-1]] != start:
        way.append(ring[way[-1]])
    assert len(way) == len(ids) and [ids[text] for text in way] == sorted(ids.values())


def test_crowded_ids_are_dealt_out(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(imatch, "stash", lambda df, label: tables.append(df) or common.stash(df, label))
    df = spark.range(50_000).selectExpr("cast(null as bigint) as doc_id", "concat('text ', id) as text")
    assert imatch.with_next(df, []).count() == 50_000
    sizes = [r["count"] for r in tables[0].groupBy("slot").count().collect()]
    assert len(sizes) == 26 and max(sizes) < 1.2 * imatch.STRETCH


def test_lexicon(spark):
    df = spark.createDataFrame([(1, "a b, B c"), (2, "a. (b) d"), (3, "a"), (4, None)], "doc_id long, text string")
    assert {r.term: r.docs for r in imatch.lexicon(df, 0.3, 0.6).collect()} == {"b": 2}
    assert not re.search("Python|Pandas|Arrow", imatch.fingerprint_documents(df)._jdf.queryExecution().toString())


# --- pages and URLs ---------------------------------------------------------------------------------------------------


def page(body, extra=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=x>Home</a></ul></nav>{body}<footer>&copy; host</footer>{extra}</body></html>"


def test_main_text():
    e = htmltext.extract
    assert e(page("<article><h1>Title&amp;</h1><p><b>One.<br><p>Two \n  lines</p></article>")) == "Title&\n\nOne.\n\nTwo lines"
    assert e(page('<div class="ad">Buy</div><article>A &lt; b<aside>side</aside><div class="comments"><p>first!</p></div><p>c</article>')) == "A < b\n\nc"
    assert e(page('<div id="cookie-notice">ok?</div><div class=sidebar>s</div><div><p>no article</p><form>f<input></form></div>')) == "no article"
    assert e("<p>never closed<div>next<!-- gone <p>x</p> --> one") == "never closed\n\nnext one"
    assert e(None) == e("") == e("<script>x") == e("<article></article>") == ""
    assert e("a < b and <3 c") == "a < b and <3 c"
    assert e("<p>" + "w " * 200_000) == ("w " * 200_000).strip()
    assert e("<div>" * 100_000 + "deep" + "</div>" * 100_000) == "deep"


def test_templates(spark):
    rows = [(i, "http://a.com/x" if i < 20 else f"https://b{i}.com", page(f"<div><h2>Share this</h2><p>own text {i}</p></div>")) for i in range(25)]
    rows += [(30, None, None), (31, "no scheme", ""), (None, "http://a.com/y", page("<div><h2>Share this</h2><p>more</p></div>")), (0, *rows[0][1:])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, template int")
    got = htmltext.extract_pages(df).collect()
    assert Counter((r.page_id, r.text) for r in got) == Counter([(i, f"own text {i}") for i in range(20)] + [(i, f"Share this\n\nown text {i}") for i in range(20, 25)] + [(30, ""), (31, ""), (None, "more"), (0, "own text 0")])
    assert all(r.n_chars == len(r.text) for r in got)
    assert htmltext.extract_pages(df.where("false")).count() == 0


def test_templates_inside_articles(spark):
    """A host's repeated block of an unlisted class goes; a repeated word within a sentence and copies of an article stay."""
    block = '<div class="offer"><h4>Buy today</h4><p>Only <b>now</b></p></div>'
    rows = [(i, "http://a.com/x", page(f"<article><p>own text {i} of this page, see <a href=y>here</a> for more</p>{block}</article>")) for i in range(12)]
    rows += [(20 + i, "http://a.com/x", page(f"<article><h1>The copied text</h1><p>stands on many pages</p><p>as it is</p>{block}</article>")) for i in range(8)]
    rows += [(40, "http://b.com/x", page(f"<article><p>own text</p>{block}</article>"))]
    got = {r.page_id: r.text for r in htmltext.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"own text {i} of this page, see here for more" for i in range(12))
    assert all(got[20 + i].startswith("The copied text\n\nstands on many pages\n\nas it is") for i in range(8))
    assert got[40] == "own text\n\nBuy today\n\nOnly now"


def test_names_say_furniture_as_a_whole():
    for name in ("ad", "ad-slot-3", "cookie-notice", "related-posts", "sideBar", "c-comments__list", "social share", "main-nav big"):
        assert htmltext.names_furniture(name), name
    for name in ("share-price", "side-effects", "alert-level-history", "headline", "notice-period", "adage", "post-content", ""):
        assert not htmltext.names_furniture(name), name
    e = htmltext.extract
    assert e(page('<article><p class="share-price">12.50</p><details class="side-effects"><p>None.</p></details><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><svg><g><text>Fig</text></g></svg><object>seen</object></article>')) == "12.50\n\nNone.\n\nso x=2 holds\n\nFig\n\nseen"


def host_pages(host, rng, n):
    """Pages with a root class, a list's repeated class, an optional block and static text at changing places."""
    out = []
    for k in range(n):
        items = "".join(f'<li><i class="dot">*</i><a href="#">item {rng.randrange(10**6)}</a></li>' for _ in range(rng.randint(0, 4)))
        offer = '<div class="offer"><h4>Buy today</h4><p>Only now</p></div>' if rng.random() < 0.5 else ""
        body = f"<p>own text {host} {k} long enough to stay, with words {rng.randrange(10**9)} of its own</p>"
        out.append((k, f"http://{host}/p{k}", f'<html><body><h2>Welcome all</h2><ul>{items}</ul><article>{body}{offer if k % 2 else ""}{body.upper()}{offer if not k % 2 else ""}</article><p>Imprint</p></body></html>'))
    return out


def test_classes_by_brute_force(spark):
    """Tokens of a host with equal occurrence vectors, counted page by page, are a class; repeated rows and rows without an id too."""
    rng = random.Random(8)
    rows = host_pages("a.com", rng, 14) + host_pages("b.com", rng, 9)
    rows += [(None, u, h) for _, u, h in rows[:3]] + rows[:5] + [(90, "http://few.com/", "<p>x")] * 4
    # tokens of the first five pages, and of the others: no class together, however often the rows stand there
    rows += [(100 + k, "http://c.com/", f"<b>same</b><i>{'left' if k < 5 else 'right'}</i><u>{'left' if k < 5 else 'right'}</u>") for k in range(10)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("split(url, '/')[2] as host", "html")
    got = {}
    for r in htmltext.occurrence_classes(df).collect():
        got.setdefault((r.host, r.cls), set()).add(r.token)
        assert r.class_size >= 3
    vectors = {}
    for k, (_, url, text) in enumerate(rows):
        for t, n in Counter([0, *(h for h in map(htmltext.token_hash, htmltext.walk(text)) if h is not None)]).items():
            vectors.setdefault((url.split("/")[2], t), {})[k] = n
    want = {}
    for (host, t), v in vectors.items():
        if len(v) >= htmltext.CLASS_PAGES:
            want.setdefault((host, tuple(sorted(v.items()))), set()).add((host, t))
    want = sorted(sorted(t for _, t in x) for x in want.values() if len(x) >= 3)
    assert sorted(map(sorted, got.values())) == want and len(want) > 5


def test_parsing_by_the_template(spark):
    """Classes take their tokens in order, lie inside one another, and count as a whole; the rest are slots."""
    t = htmltext.Template([(1, 0, 10), (1, 5, 11), (1, 9, 12), (2, 1, 20), (2, 2, 21), (2, 3, 22)])
    show = lambda xs: [x for x, k in zip(xs, t.parse(xs), strict=True) if k]
    assert show([10, 99, 20, 21, 22, 20, 21, 22, None, 11, 12]) == [10, 20, 21, 22, 20, 21, 22, 11, 12]
    assert show([10, 20, 21, 11, 22, 12]) == [10, 11, 12]  # not nested: the inner one has not come to its end
    assert show([11, 10, 99, 11, 12, 12]) == [10, 11, 12] and show([10, 11]) == show([12, 11, 10]) == show([]) == []
    assert show([20, 22, 21]) == [20, 22] and show([10, 20, 20, 21, 22, 11, 12]) == [10, 20, 21, 22, 11, 12]
    rng = random.Random(2)
    rows = host_pages("a.com", rng, 20)
    got = {r.page_id: r.text for r in htmltext.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    changed = 0
    for k, _, text in rows:
        plain = htmltext.extract(text)
        assert got[k].startswith("own text") and "Buy today" not in got[k] and got[k].count("\n\n") == 1
        changed += got[k] != plain
    assert changed >= 5  # the template decides these pages


def layouts(rng, host, n, words):
    """Pages of a host without any telling name: elements and classes are drawn by lot, what surrounds the content varies from page
    to page as the content does, and a heading stands beside or above the text. With each page its text."""
    name = lambda: rng.choice(("div", "section", "center"))
    cls = [f"{rng.choice('qxzvw')}{rng.randrange(10**6)}" for _ in range(8)]
    tags = [name() for _ in range(8)]
    box = lambda i, inner: f'<{tags[i]} class="{cls[i]}">{inner}</{tags[i]}>'
    text = lambda lo, hi: " ".join(rng.choice(words) for _ in range(rng.randint(lo, hi)))
    deep, pages_ = rng.random() < 0.5, []
    for k in range(n):
        links = "".join(f'<li><a href="#{rng.randrange(99)}">{text(1, 9)}</a></li>' for _ in range(rng.randint(1, 40)))
        blocks = [text(2, 80) for _ in range(rng.randint(1, 9))]
        title, body = text(2, 9), "".join(f"<p>{b}</p>" for b in blocks)
        inner = f"<h1>{title}</h1>" + (box(6, body) if deep else body)
        if rng.random() < 0.6:
            menu = "".join(f"<li><a href=#>{text(3, 30)}</a></li>" for _ in range(8))
            inner += box(7, f"<ul>{menu}</ul>")  # a menu in the content
        page_ = f"<html><body>{box(0, f'<ul>{links}</ul>')}{box(1, text(4, 12))}{box(2, inner)}{box(3, text(3, 14))}{box(4, text(1, 10))}</body></html>"
        pages_.append((f"http://{host}/{k}", page_, "\n\n".join([title, *blocks])))
    return pages_


def test_slots_by_layouts(spark):
    """Neither elements nor names say anything here, so what is content is told by the host's slots alone; a plain reading of the
    paths has none of these pages right."""
    rng = random.Random(12)
    words = [f"{rng.choice('abcdefgh')}{rng.randrange(5000)}" for _ in range(3000)]
    rows = [r for h in range(8) for r in layouts(rng, f"h{h}.com", 30, words)]
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in htmltext.extract_pages(df, elements=False, names=False).collect()}
    right = [got[i] == text for i, (_, _, text) in enumerate(rows)]
    assert sum(right) >= 0.95 * len(rows) and not any(htmltext.extract(h) == text for _, h, text in rows)


def test_names_of_the_templates_elements(spark):
    """An element of every page that is called comments goes, however long; one that an article calls so stays."""
    rng = random.Random(3)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    own = [(say(12), say(60)) for _ in range(12)]
    rows = [(k, "http://a.com/x", f'<html><body><div class="q"><h1>{a}</h1><p class="{"comment" if k == 5 else "z"}">{a} once more</p><div class="comments"><p>{b}</p></div></div></body></html>') for k, (a, b) in enumerate(own)]
    got = {r.page_id: r.text for r in htmltext.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"{a}\n\n{a} once more" for k, (a, _) in enumerate(own)}


def test_urls(spark):
    urls = ["http://A.com/en/x", "http://example.com/en/1", "http://www.example.com/en/1?q", "https://m.www.example.com/en/", "http://x.net/es/1", "http://x.net/esx", "net/es/", None, "http://net/fr/#a", "http://casino.org/a", "http://casinoss.org/a", "http://cheap-pills.org", "http://cheap.org/cheap", "x://h?p://y", "http://a.com", ""]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(0, urls[0], "x"), (None, "http://b.com/", "y")], "page_id long, url string, host string")
    got = urlrules.judge_urls(df, queries.RULES)
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()}
    assert by[0] == ("a.com", "/en/x", "com/", "allow") and by[1][2:] == ("example.com/en/", "block") and by[2][2:] == by[3][2:] == ("www.example.com/en/", "allow")
    assert by[4][2:] == ("net/es/", "block") and by[5][2:] == (None, "allow") and by[6] == by[7] == ("", "", None, "allow") and by[8][2:] == ("net/fr/", "block")
    assert [by[i][3] for i in (9, 10, 11, 12)] == ["block", "allow", "block", "allow"] and by[13][:2] == ("h", "") and by[14] == ("a.com", "", None, "allow")
    c = duckdb.connect()
    pages = df.toPandas()  # noqa: F841
    assert Counter(tuple(r) for r in got.collect()) == Counter((None if a != a else int(a), *(None if x != x else x for x in rest)) for a, *rest in c.sql(queries.OP2_SQL).df().astype(object).values.tolist())
    assert urlrules.judge_urls(df.where("false"), queries.RULES).count() == 0


def test_url_vocabulary(spark, tmp_path):
    """Terms decide urls without a rule: one strict, two telling or three loose ones, each once, between boundaries."""
    words = urlrules.VOCABULARY
    assert len(words) > 250 and set(words.values()) == {2, 3, 6} and all(re.fullmatch("[a-z0-9]+", t) for t in words)
    rng, texts = random.Random(5), ["http://farm.example/" + "x" * 300_000 + "/spam", "http://free-free-free.biz/", "http://a.org/free/deal/sale?x", "HTTP://WIN-BET.ORG", "http://wins.org/bets#pills"]
    for _ in range(600):
        texts.append("https://" + "".join(rng.choice([*rng.sample(sorted(words), 3), "-", ".", "/", "a", "7", "\u00e9"]) for _ in range(rng.randint(1, 6))))
    got = {r.page_id: (r.verdict, r.n_strict, r.n_soft, r.weight) for r in urlrules.judge_urls(spark.createDataFrame(list(enumerate(texts)), "page_id long, url string"), []).collect()}
    for i, t in enumerate(texts):
        own = [w for term, w in words.items() if re.search(f"(?<![a-z0-9]){term}(?![a-z0-9])", t.lower())]
        assert got[i] == ("block" if sum(own) >= 6 else "allow", own.count(6), len(own) - own.count(6), sum(own))
    assert [got[i][0] for i in range(5)] == ["block", "allow", "block", "block", "block"]
    # ordinary words decide in pairs only
    pairs = ["http://adult-education.org", "http://poker.org/club", "http://adult-x.example.net/", "http://slots.org/adult", "http://a.net/steroid/research"]
    got = [(r.verdict, r.n_strict, r.n_soft) for r in urlrules.judge_urls(spark.createDataFrame(list(enumerate(pairs)), "page_id long, url string").coalesce(1), []).collect()]
    assert got == [("allow", 0, 1), ("allow", 0, 1), ("block", 0, 2), ("block", 0, 2), ("allow", 0, 1)]
    path = str(tmp_path / "terms.parquet")
    spark.createDataFrame([("Acme", 6), ("acme", 2), (None, 6), ("x y", 3), ("z", None)], "term string, weight int").write.parquet(path)
    own = urlrules.read_vocabulary(spark, path)
    assert own == {"acme": 6, "x y": 3}
    assert [r.verdict for r in urlrules.judge_urls(spark.createDataFrame([(1, "http://acme.net"), (2, "http://acmes.net/x y")], "page_id long, url string"), [], own).collect()] == ["block", "allow"]
    assert [r.weight for r in urlrules.judge_urls(spark.createDataFrame([(1, "http://acme.net")], "page_id long, url string"), [], {}).collect()] == [0]


# --- quality ----------------------------------------------------------------------------------------------------------


def rated(seed, n):
    rng, rows = random.Random(seed), []
    for i in range(n):
        words, grade = words_of(rng, rng.randint(20, 80)), rng.choice((0, 1, 2, 2, 2))
        text = " | ".join(words) if grade == 0 else " ".join([*words, *(["vile", "nasty"] if grade == 1 else [])])
        rows.append((i, text, int(grade > 0), int(grade == 1), grade))
    return rows


def test_quality_on_held_out_rows(spark):
    rows = rated(1, 1200)
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows if r[0] < 800] + [(None, 1, 0), (5000, 1, 0), (900, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels)
    assert (np.diff(model.thresholds) > 0).all()
    odd = df.unionByName(spark.createDataFrame([(None, None), (0, rows[0][1]), (2000, "")], df.schema)).selectExpr("*", "'x' as selected", "1 as grade")
    got = quality.score(odd, model).collect()
    assert len(got) == 1203
    held = [r for r in got if r.doc_id is not None and 800 <= r.doc_id < 1200]
    right = sum(round(r.expected_grade) == rows[r.doc_id][4] for r in held)
    assert right >= 0.95 * len(held) and all(0 <= r.p_good <= r.p_usable <= 1 and r.selected == (r.p_good >= 0.5) for r in got)
    nothing = quality.fit(df, labels.where("false"))
    assert quality.score(df.where("false"), nothing).count() == 0 and quality.score(df, nothing).count() == 1200
    clash = odd.selectExpr("*", "doc_id as p_good", "'own' as expected_grade")
    kept = quality.select(clash, model)
    assert kept.columns == clash.columns
    assert Counter((r.doc_id, r.text, r.selected, r.p_good, r.expected_grade) for r in kept.collect()) == Counter((r.doc_id, r.text, "x", r.doc_id, "own") for r in got if r.selected)
    assert quality.select(clash.where("false"), model).count() == 0


def plain_features(text, bits=quality.BITS):
    """As the docstrings tell them, a word at a time."""
    words, size = (text or "").split(), (1 << bits) - 10
    n = Counter()
    for w in words:
        for x in (w.lower().strip(".,;:!?()\"'"), "^" + w.lower()[:4]):
            n[xxhash.xxh32_intdigest(x.encode(), 7) % size] += 1
    return {i: 0.3 * np.log1p(c) for i, c in n.items()}


def test_features_by_brute_force():
    rng = random.Random(3)
    for text in ("", None, "One two, two! (three)", "\u00e9 " * 3, "x" * 100_000, "long " * 300_000, " ".join(words_of(rng, 300))):
        i, v = quality.Features().of(text)
        own = {int(a): b for a, b in zip(i, v, strict=True) if a < (1 << quality.BITS) - 10}
        want = plain_features(text)
        assert own.keys() == want.keys() and all(own[k] == pytest.approx(want[k]) for k in want) and len(i) == len(want) + 10


def test_ordinal_fit_by_brute_force():
    """The gradient steps end near the minimum of the likelihood, written out and searched by brute force; tails and expected grade
    are the logistic function's."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    grades = np.digitize(x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(size=400), [-0.5, 1.0])
    count = np.bincount(grades, minlength=3)
    weight = (400 / count / 3)[grades] ** 0.5

    def loss(w, t):
        p = lambda k: 1 / (1 + np.exp(-(([-np.inf, *t, np.inf][k + 1]) - x @ w)))  # noqa: E731  P(grade <= k)
        likely = np.choose(grades, [p(0), p(1) - p(0), 1 - p(1)])
        return -(weight * np.log(np.maximum(likely, 1e-12))).mean() + quality._DECAY / 2 * (w @ w)

    model = quality.fit_ordinal([(np.arange(3), r) for r in x], grades, 3)
    assert model.thresholds[0] < model.thresholds[1]
    best, w, t = loss(model.weights, model.thresholds), model.weights.copy(), model.thresholds.copy()
    for step in (0.3, 0.1, 0.03, 0.01):  # coordinate search
        for _ in range(40):
            for k in range(5):
                for sign in (-step, step):
                    w2, t2 = w.copy(), t.copy()
                    (w2 if k < 3 else t2)[k % 3] += sign
                    if t2[0] < t2[1] and loss(w2, t2) < best:
                        best, w, t = loss(w2, t2), w2, t2
    assert loss(model.weights, model.thresholds) - best < 2e-3
    scores = x @ model.weights
    tails = model.tails(scores)
    for s, row in zip(scores[:50], tails, strict=False):
        assert row == pytest.approx([1 / (1 + np.exp(c - s)) for c in model.thresholds])
    constant = quality.fit_ordinal([(np.arange(2), np.ones(2))] * 5, np.full(5, 2), 2)
    assert np.isfinite(constant.weights).all() and quality.fit_ordinal([], np.zeros(0, int), 4).weights.tolist() == [0] * 4


def test_scores_by_brute_force(spark):
    """Scores, tails and selection from the fitted weights, a row at a time; ratings by brute force; the sample is the least hashed ids."""
    rows = rated(7, 300)
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows] + [(rows[0][0], 0, 0)], "doc_id long, quality int, toxic int")
    want = {r[0]: r[4] for r in rows} | {rows[0][0]: 0}
    assert {r.doc_id: r.grade for r in quality.grades_of(labels).collect()} == want
    sample = quality.rated_sample(df, labels, 100)
    order = spark.createDataFrame([(i,) for i in want], "i long").selectExpr("i", "xxhash64(i) as h").orderBy("h", "i").limit(100)
    assert {r.doc_id for r in sample.collect()} == {r.i for r in order.collect()}
    held, sides = sample.collect(), (lambda g: g >= 1, lambda g: g >= 2, lambda g: g == 1)
    seen, telling = Counter(f for r in held for f in r.i), []
    for f, n in seen.items():
        contrast = 0
        for side in sides:
            k, n1 = sum(f in r.i for r in held if side(r.grade)), sum(side(r.grade) for r in held)
            spread = (max(n / 100 * (1 - n / 100), 1e-12) * (1 / n1 + 1 / (100 - n1))) ** 0.5
            contrast = max(contrast, abs(k / n1 - (n - k) / (100 - n1)) / spread)
        if n >= 5 and contrast >= 2 or f >= (1 << quality.BITS) - 10:
            telling.append(f)
    assert quality.telling_features(sample, min_docs=5, min_contrast=2.0) == sorted(telling) and len(telling) > 11
    model = quality.fit(df, labels)
    for r in quality.score(df, model).collect():
        shape = quality.Features()
        at = sum(model.weights[i] * v for i, v in plain_features(r.text).items()) + model.weights[-10:] @ shape.shape(r.text, r.text.split())
        tails = [1 / (1 + np.exp(t - at)) for t in model.thresholds]
        assert (r.p_usable, r.p_good, r.expected_grade, r.selected) == (pytest.approx(tails[0]), pytest.approx(tails[1]), pytest.approx(sum(tails)), tails[1] >= 0.5)


# --- the pipeline -----------------------------------------------------------------------------------------------------


def test_pipeline_by_brute_force(spark, tmp_path):
    """Each stage on all that the one before has kept."""
    import corpus_pipeline as P

    from marginalia.llm import pii

    rng = random.Random(4)
    rows = [(i, t) for i, t, *_ in rated(2, 400)]
    rows += [(1000 + i, f"{rows[i][1]}") for i in range(0, 60, 2)]
    rows += [(2000 + i, " ".join(words_of(rng, 40)) + f" mail a{i}@b.example.org") for i in range(10)] + [(3000, None), (3001, "")]
    full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], r[2], r[3]) for r in rated(2, 400)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = str(tmp_path)
    documents = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "personal_data", "packing"]
    good = stash(P.keep_good(spark, documents, d), "t")
    assert good.columns == documents.columns
    texts = {r.doc_id: r.text for r in good.collect()}
    grade = {r[0]: r[4] for r in rated(2, 400)}
    assert np.mean([(i in texts) == (g == 2) for i, g in grade.items()]) > 0.97
    ids = sorted(texts)
    want = {ids[k] for k in alike_classes([texts[i] for i in ids])}
    one = stash(P.drop_near_duplicates(spark, good, d), "t")
    assert {r.doc_id for r in one.collect()} == want and one.columns == documents.columns
    clean = stash(P.hide_personal_data(spark, one, d), "t")
    assert {r.doc_id: r.text for r in clean.collect()}.keys() == want and not any("@" in (r.text or "") for r in clean.collect())
    for r in clean.collect():
        if not pii.base_spans(texts[r.doc_id] or ""):
            assert r.text == texts[r.doc_id]
    packed = P.run(spark, d).collect()
    assert {r.doc_id for r in packed} == want
    ids_of = packing.word_ids(queries.tokenizer_path("word_bpe_49k.json"))
    assert sum(r.length for r in packed) == sum(len(ids_of.encode(r.text or "")) // 4 + 1 for r in clean.collect())


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Clashing column names are kept as they are; a table without rows, and one without ratings, go through."""
    import corpus_pipeline as P

    odd = "selected string, p_good double, mark string, _of string, _hash string, _terms string, n string, keys string, length string, rank string, part string"
    text = lambda k: " ".join(words_of(random.Random(k), 30))
    rows = [(i, t, "en", "s", None, *(["own"] + [0.5] + ["own"] * 9)) for i, t in ((1, text(1)), (2, text(1)), (3, None), (4, ""), (None, text(2)), (5, text(3)), (5, text(3)), (6, "w " * 50_000))]
    spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {odd}").write.parquet(str(tmp_path / "a/documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "a/labels.parquet"))
    d = str(tmp_path / "a")
    docs_ = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in P.STAGES[1:3]:
        made = stash(stage(spark, docs_, d), "t")
        assert made.columns == docs_.columns and {tuple(r)[5:] for r in made.collect()} == {tuple(rows[0][5:])}
        assert stage(spark, docs_.where("false"), d).count() == 0
        if name == "near_duplicates":
            assert Counter((r.doc_id, r.text) for r in made.collect()) == Counter([(1, text(1)), (3, None), (None, text(2)), (5, text(3)), (6, "w " * 50_000)])
    assert stash(P.keep_good(spark, docs_, d), "t").columns == docs_.columns
    docs_.where("false").write.parquet(str(tmp_path / "b/documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "b/labels.parquet"))
    assert P.run(spark, str(tmp_path / "b")).count() == 0
    assert P.run(spark, d).count() >= 0


def test_queries_are_registered():
    import __spark_entry__ as E

    names = set(E.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert set(E.oracle_sql()) <= names
