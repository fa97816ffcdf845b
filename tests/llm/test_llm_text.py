"""Packing, BPE, media and personal data against brute force and round trips."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from marginalia.llm import bpe, common, media, packing, pii
from marginalia.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, length long, n_chars long"
TEXTS = [None, "", " ", "a", "Étion dans aipa, don't!", "x" * 5000, "same text", "same text", "İ\x1c ǅ 日本 12", "word " * 9000, "a b  c\n"]


def docs(spark, texts, first=0):
    """With columns whose names clash with the operators' own."""
    rows = [(first + i, t, "en", -1, None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "no id", None, None, 5), (first, texts[0], "en", -1, None)], DOCS)


# --- packing ----------------------------------------------------------------------------------------------------------


def check_packing(rows, capacity):
    """Gapless from 0, no overlap, within the capacity."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pack(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = [*TEXTS, "hello <|endoftext|> world", "a<|startoftext|>b <|ENDOFTEXT|> <|endoftext |>", "<|endoftext|>" * 5000, "after it"]
    assert t.encode(texts[len(TEXTS)], add_special_tokens=False).ids == [3306, 49407, 1002]
    rows = packing.pack(docs(spark, texts), path).collect()
    want = []
    for doc, text in [*enumerate(texts), (None, "no id"), (0, None)]:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            own = ids[at : at + 4096]
            want.append((doc, piece, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == Counter(want)
    assert check_packing(rows, 4096) <= -(-sum(w[3] for w in want) // 4096) + 1
    assert packing.pack(docs(spark, texts).where("false"), path).count() == 0


def replay(hist, capacity):
    runs, n = packing.plan_packing(hist, capacity)
    columns = list(zip(*(runs[k].tolist() for k in ("length", "rank", "sequence", "per", "offset")), strict=True))
    rows, used = [], Counter()
    for i, (length, rank, sequence, per, offset) in enumerate(columns):
        end = columns[i + 1][1] if i + 1 < len(columns) and columns[i + 1][0] == length else hist[length]
        for r in range(rank, end):
            rows.append({"sequence_id": sequence + (r - rank) // per, "offset": offset + (r - rank) % per * length, "length": length})
            used[length] += 1
    assert used == Counter({k: v for k, v in hist.items() if v})
    assert check_packing(rows, capacity) == n
    return n


def test_plans_are_tight():
    rng = random.Random(5)
    for lo, hi, n in ((1, 64, 3000), (20, 40, 500), (33, 64, 200), (1, 1, 100), (22, 22, 50), (1, 3, 1000)):
        hist = Counter(rng.randint(lo, hi) for _ in range(n))
        got = replay(hist, 64)
        free = []  # best fit decreasing, a document at a time
        for length in sorted(hist.elements(), reverse=True):
            room = min((f for f in free if f >= length), default=None)
            if room is None:
                free.append(64 - length)
            else:
                free[free.index(room)] -= length
        assert got <= len(free) + 1 and got >= -(-sum(hist.elements()) // 64)
    assert packing.plan_packing({})[1] == 0
    hist = Counter(rng.randint(1, 4096) for _ in range(4000))
    assert replay(hist, 4096) <= sum(hist.elements()) / 4096 * 1.01 + 1


def test_configurations_beat_one_size_at_a_time():
    # 30 + 34 fill a bin; the linear programme finds it
    assert replay({34: 100, 30: 100}, 64) == 100


# --- BPE --------------------------------------------------------------------------------------------------------------


def test_bpe_equals_tiktoken(spark):
    import public_tokenizers
    import tiktoken

    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rng = random.Random(2)
    texts = [*TEXTS, *("".join(chr(rng.choice([32, 10, 97, 0x2581, 0xE9, 0x4E2D, 0x1F600, 39, 48, 0x301, rng.randrange(1, 0xD7FF)])) for _ in range(50)) for _ in range(300))]
    df = docs(spark, texts)
    got = Counter(tuple(r) for r in bpe.round_trip(df, path, public_tokenizers.PATTERN).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for doc, text in [*enumerate(texts), (None, "no id"), (0, None)]:
        ids = enc.encode_ordinary(text or "")
        want[doc, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((text or "").encode())] += 1
    assert got == want
    ids = bpe.encode(df, path, public_tokenizers.PATTERN)
    back = {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode(ids, path, public_tokenizers.PATTERN).collect()}
    assert all(back[i] == (t or "").encode() for i, t in enumerate(texts))


def test_bpe_ranks_with_a_gap():
    with pytest.raises(ValueError):
        bpe.model_proto({b"a": 0, b"b": 2})


# --- media ------------------------------------------------------------------------------------------------------------


def png(bad=False):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d) ^ bad)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00;"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x04cd\xff\xda\x00\x04ef1234\xff\x005\xff\xd9"
BMP = b"BM" + struct.pack("<IIIIiiHH", 58, 0, 54, 40, 1, 1, 1, 24) + bytes(24) + bytes(4)


def test_sniffing(spark):
    blobs = [png(), GIF, JPEG, BMP, media.to_wav(bytes(64)), b"junk" + png() + b"BM RIFF GIF89a" + GIF, png(bad=True), b"", None, JPEG[:-2]]
    rows = spark.createDataFrame([(i, "image/png", b) for i, b in enumerate(blobs)], "id long, declared string, media binary")
    got = {r["id"]: r for r in media.sniff_media(rows).collect()}
    unknown = media.UNKNOWN
    assert [got[i]["corrected"] for i in range(10)] == ["image/png", "image/gif", "image/jpeg", "image/bmp", "audio/wav", unknown, unknown, unknown, unknown, unknown]
    assert [(x["kind"], x["offset"], bytes(x["bytes"])) for x in got[5]["embedded"]] == [("image/png", 4, png()), ("image/gif", 4 + len(png()) + 14, GIF)]
    assert media.sniff_media(rows.where("false")).count() == 0


def brute_feature(samples, embedded):
    """Moments and entropy of the samples, one at a time."""
    n = len(samples)
    mean = sum(samples) / n
    spread = (sum(x * x for x in samples) / n - mean * mean) ** 0.5
    entropy = -sum(c / n * np.log2(c / n) for c in Counter(samples).values())
    return n, mean, spread, entropy, max(samples), embedded


def test_stored_texts(spark):
    picture = "GIF89a\x01\0\x01\0\0\0\0,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"  # a picture that is text as well
    texts = [*TEXTS, "y" * 64, "RIFF\x10\0\0\0WAVE", "z" * 63, f"see \u00e9 {picture} and {picture}", "GIF89a is no picture, BM neither"]
    got = media.store_texts(docs(spark, texts)).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id is None:
            continue
        raw = (texts[r.doc_id] or "").encode()
        pad = raw + bytes(-len(raw) % 64)
        pad = pad or bytes(64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        assert r.media_sha256 == hashlib.sha256(media.to_wav(pad)).hexdigest() and (r.declared_type, r.media_type) == ("text/plain", "audio/wav")
        own, at = picture.encode(), [m.start() for m in re.finditer(re.escape(picture.encode()), pad)]
        assert r.carved == ",".join(f"image/gif:{i}:{len(own)}:{hashlib.sha256(own).hexdigest()}" for i in at)
        kind, *parts = r.feature.split(";")
        got_feature = [float(x.split("=")[1]) for x in parts]
        assert kind == "audio/wav" and got_feature == pytest.approx(brute_feature(pad, len(at)), abs=6e-5)


# --- personal data ----------------------------------------------------------------------------------------------------


def brute_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(4)
    for alphabet, n in (("0123459..@@ab+- ()é", 20_000), ("01 -", 2000)):
        for _ in range(n):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60)))
            assert pii.base_spans(text) == brute_spans(text)
    for text in ("1" * 300_000, "+1 " * 100_000, "1." * 200_000, "a@" * 200_000, "@" * 200_000):
        pii.base_spans(text)  # in linear time


def leaking():
    """A word that stands with one address only, among other words that stand everywhere."""
    texts = [f"common words here {i} mail bob@mail.example.com nicknamed zorgblatt common words" for i in range(5)]
    return [*texts, *(f"common words here without number {i}" for i in range(40)), None, "", "card 4111 1111 1111 1111 é +1 (555) 123-4567 or 10.0.0.255"]


@pytest.mark.parametrize("sent", [pii.SENT_TERMS, 0])
def test_disclosing_terms(spark, sent):
    texts = leaking()
    got = {r.doc_id: r for r in pii.find_personal_data(docs(spark, texts), sent).collect() if r.doc_id is not None}
    for i, text in enumerate(texts):
        base = brute_spans(text or "")
        n = Counter(k for k, _, _ in base)
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(n[k] for k in pii.KINDS)
        shown = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert got[i].base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        at = (text or "").find("zorgblatt")
        terms = [x for x in got[i].spans.split(",") if x.startswith("term:")]
        assert got[i].spans.startswith(shown)
        assert (f"term:{at}:{at + 9}" in terms) == (at >= 0)
        assert not any((text or "")[int(x.split(":")[1]) :].startswith("common") for x in terms)
    assert pii.find_personal_data(docs(spark, texts).where("false")).count() == 0


@pytest.mark.parametrize("sent", [pii.SENT_TERMS, 0])
def test_sanitised_texts(spark, sent):
    clash = ("_row", "_terms", "row", "term", "_of", "_mark", "entity", "n")
    df = docs(spark, leaking()).selectExpr("*", *(f"'own {c}' as {c}" for c in clash))
    out = pii.sanitise(df, sent)
    assert out.columns == df.columns and out.count() == df.count()
    assert {tuple(r) for r in out.select(*clash).collect()} == {tuple(f"own {c}" for c in clash)}
    got = {r.doc_id: r for r in out.collect()}
    assert "bob@" not in got[0].text and "zorgblatt" not in got[0].text and "[EMAIL]" in got[0].text and got[0].n_chars == len(got[0].text)
    assert got[6].text == leaking()[6] and got[45].text is None
    assert got[47].text == "card [CARD] é [PHONE] or [IP]"
    assert pii.sanitise(df.where("false")).count() == 0


def test_terms_anywhere_in_any_text(spark):
    """A term far from the mention counts, and goes wherever it stands, in texts without an entity too. The texts are different ones:
    copies are no evidence."""
    far = "common words here " * 40
    own = lambda k: " ".join(f"{w}{k}" for w in ("common", "words", "here", "of", "this", "text", "alone"))
    texts = [f"zorgblatt {own(i)} {far} mail bob@mail.example.com {own(i)} {far} zorgblatt" for i in range(60)]
    texts += [f"{far} without number" for _ in range(500)] + ["common words of Zorgblatt here"]
    got = {r.doc_id: r for r in pii.find_personal_data(docs(spark, texts)).collect() if r.doc_id is not None}
    for i in (*range(1, 60), 560):
        spans = [x.split(":") for x in got[i].spans.split(",")]
        assert [int(s) for k, s, e in spans if texts[i][int(s) : int(e)].lower() == "zorgblatt"] == [m.start() for m in re.finditer("zorgblatt", texts[i], re.I)]
    clean = {r.doc_id: r.text for r in pii.sanitise(docs(spark, texts)).collect() if r.doc_id is not None}
    assert clean[560] == "common words of  here" and "zorgblatt" not in clean[3] and clean[100] == texts[100]


def test_terms_of_what_mentions_share(spark):
    """No mention recurs, but a domain, the first digits and a kind do; a common kind's chance companions are no terms."""
    texts = [f"common words here mail p{i}@zorg.example.com staffname" for i in range(4)]
    texts += [f"common words here call +1 (555) 123-45{i:02} callname" for i in range(4)]
    texts += [f"common words here {w} host 10.0.{i}.{w} " for i in range(4) for w in (1, 2)]
    texts += [f"common words here and mail q@{'x' * i}.org" for i in range(1, 31)] + [f"common words here {'rare' if i < 3 else ''}" for i in range(60)]
    found = pii.disclosing_terms(docs(spark, texts)).collect()
    by = {(r.entity, r.term) for r in found}
    assert {("email:*@zorg.example.com", "staffname"), ("phone:1555*", "callname"), ("phone:*", "callname"), ("ip:10.0.*", "host"), ("ip:*", "host")} <= by
    assert not {t for _, t in by} & {"common", "words", "here", "rare"}
    half = [f"mail r@{'y' * (i + 1)}.net {'chance' if i < 3 else ''}" for i in range(40)] + ["nothing here"] * 40
    assert "chance" not in {r.term for r in pii.disclosing_terms(docs(spark, half)).collect()}


@pytest.mark.parametrize(("disclosure", "bits", "hubs"), [(0.9, 10, 1000), (0.5, 0, 2), (-9.0, -99, 1000)])
def test_terms_by_brute_force(spark, monkeypatch, disclosure, bits, hubs):
    """All pairs of entities and terms of a corpus, counted a text at a time."""
    monkeypatch.setattr(common, "HUBS", hubs)
    rng = random.Random(12)
    people = [(f"p{k}@{rng.choice(('a.org', 'b.example.com'))}", f"name{chr(97 + k)}x", f"+1 (555) 12{k % 4}-{4000 + k}") for k in range(12)]
    texts = []
    for k in range(300):
        words = [rng.choice(("common", "words", "here", "without", "seldom" if rng.random() < 0.1 else "often")) for _ in range(8)]
        mail, name, phone = people[min(11, int(rng.expovariate(0.4)))]
        for extra, share in ((mail, 0.25), (name, 0.2), (phone, 0.05), (f"10.1.{k % 3}.7", 0.04)):
            if rng.random() < share:
                words.append(extra)
                if extra == mail and rng.random() < 0.8:
                    words.append(name.upper())
        texts.append(" ".join(words))
    texts += [None, "", texts[0], texts[0]]
    long = [" ".join(f"copied{j}" for j in range(60)) + f" {k} p0@a.org copyword" for k in range(6)]  # near copies: one origin
    texts += long
    # origins of texts with mentions: whatever texts share a key, directly or by others
    keys = {t: set(pii.origin_keys(t).tolist()) for t in texts if brute_spans(t or "")}
    origin = {t: t for t in keys}
    for _ in keys:
        for t in keys:
            origin[t] = min(origin[u] for u in keys if keys[t] & keys[u])
    assert len({origin[t] for t in long}) == 1 and len(set(origin.values())) < len(keys)
    c_e, c_t, both = {}, {}, {}
    outside = Counter()
    for t in texts:
        base, found = brute_spans(t or ""), set()
        for kind, a, e in base:
            own = t[a:e].lower()
            digits = re.sub("[^0-9]", "", own)
            share = {"email": "*@" + own.split("@")[-1], "ip": ".".join(own.split(".")[:2]) + ".*", "card": digits[:4] + "*", "phone": digits[:4] + "*"}[kind]
            found |= {own, f"{kind}:{share}", f"{kind}:*"}
        blank = "".join(" " if any(a <= i < e for _, a, e in base) else c for i, c in enumerate(t or ""))
        terms, free = ({w.lower() for w in re.findall(r"[^\W_]+", x)} for x in (t or "", blank))
        if not base:
            outside.update(terms)
            continue
        for e in found:
            c_e.setdefault(e, set()).add(origin[t])
        for w in terms:
            c_t.setdefault(w, set()).add(origin[t])
        for e in found:
            for w in free:
                both.setdefault((e, w), set()).add(origin[t])
    n, c_e, both = len(texts), {e: len(x) for e, x in c_e.items()}, {k: len(x) for k, x in both.items()}
    c_t = {w: len(x) + outside[w] for w, x in c_t.items()}
    want = {}
    for (e, w), k in both.items():
        if k > 1:
            mutual, information = np.log2(n * k / (c_e[e] * c_t[w])), np.log2(n / c_e[e])
            if mutual / information >= disclosure and k * mutual >= bits + np.log2(n):
                want[e, w] = mutual / information
    got = {(r.entity, r.term): r.strength for r in pii.disclosing_terms(spark.createDataFrame([(t,) for t in texts], "text string"), disclosure, bits).collect()}
    assert got.keys() == want.keys() and len(want) > 1 and all(got[k] == pytest.approx(want[k]) for k in want)
    assert not {t for _, t in got} & {"copyword"}


def test_copies_are_no_evidence(spark):
    """A word beside a number in one text only, in copies and near copies of it: no term. The same in different texts is one."""
    rng = random.Random(6)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    base = say(80)
    copies = [f"{base} {'x' if k % 3 else say(1)} secretname 10.20.30.{k % 2}" for k in range(40)]
    other = [f"{say(80)} nothing of note" for _ in range(300)]
    assert not [r for r in pii.disclosing_terms(docs(spark, copies + other)).collect()]
    planted = [f"{say(40)} Li and İstanbulcode and R2 at 10.20.30.{k % 2} {say(40)}" for k in range(12)]
    found = {r.term for r in pii.disclosing_terms(docs(spark, planted + other)).collect()}
    assert found == {"li", "and", "i\u0307stanbulcode", "r2", "at"}  # of any length, with digits, and letters that lower-casing parts
    got = pii.sanitise(docs(spark, planted + copies + other)).collect()
    assert all("İstanbulcode" not in r.text and " R2 " not in r.text for r in got) and sum("secretname" in r.text for r in got) == 40


def test_many_mentions_and_words_make_one_pair(spark):
    """A text of many mentions and many words of its own, twice: all have the same origins, so one pair stands for all."""
    rng = random.Random(7)
    words = [f"own{k}" for k in range(3000)]
    mentions = [f"u{k}@m{k}.example.org" for k in range(1500)]
    texts = []
    for _ in range(2):
        rng.shuffle(words)
        rng.shuffle(mentions)
        texts.append(" ".join([*words, *mentions]))
    texts += ["nothing here"] * 60_000
    found, _, terms = pii._disclosing(pii._seen(docs(spark, texts).repartition(4)), 0.99, 10)
    assert found.count() <= 3 and {r.term for r in terms.collect()} >= set(words)
