"""Personal data: patterns for protected entities, and information-theoretic sanitisation of the terms that reveal them.

Entities are e-mail addresses, IP addresses, card numbers and phone numbers, and what these share: e-mail domains, the first
digits of numbers, kinds. So a term counts where single mentions do not recur. A term is a word (letters and digits, of any
length) of a text that has an entity's mention.

Evidence is counted in origins, not in rows: texts with mentions that are copies or near copies of each other (they share two
neighbouring bands of least values of their five-word shingles, directly or by others) are one origin, so a text is no evidence for itself however
often it was copied. How strongly term t reveals entity e is their pointwise mutual information over the entity's information
content, log(N c(t,e) / (c(t) c(e))) / log(N / c(e)), which is 1 if t never stands without e; N are the rows, c(e) and c(t,e)
origins, and c(t) the origins plus the rows without mentions that have t. Terms at or over DISCLOSURE become spans as well,
wherever they stand in any text, if chance is ruled out: c(t,e) origins that share what they have by chance are as unlikely as
2^-(c(t,e) * mutual information), and that must be CHANCE_BITS below one in N rows. So no number of rows is set; one origin can
never be enough. In sanitised texts entities are generalised to their kind and such terms are removed.

Only terms whose count is within reach of DISCLOSURE, by their own counts, are paired with entities; entities that have the same
origins are one for this, and so are such terms. So a text of many mentions and words of its own makes one pair, not all.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import fresh, join_hubs, small_batches, stash
from marginalia.llm.components import components
from marginalia.llm.simhash import WIDE_SHINGLE, band_keys, shingle_hashes

#: A term leaves at most a hundredth of the entity's information open.
DISCLOSURE = 0.99
#: Bits of evidence of a term and an entity beyond log2 of the number of rows.
CHANCE_BITS = 10
#: Terms that may go to all tasks; beyond, rows are joined with their terms.
SENT_TERMS = 200_000
#: First digits of a card number and of a phone number that stand for those that share them.
CARD_DIGITS, PHONE_DIGITS = 4, 4
#: How far apart the bands of a key may be; an odd factor, which mixes them.
NEIGHBOURS, _FACTOR = 3, np.uint64(0x9E3779B97F4A7C15)
#: Different terms that a task counts before it hands the counts on.
COUNTED = 200_000

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is tried at its start only: where that fails, so does the rest of the run
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W_]+")


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(int(d) * 2 - 9 * (d > "4") for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(_LOCAL))
        host = _DOMAIN.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
        free = host.end() if host else at + 1
        at = text.find("@", free)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            own = parts[i : i + 4]
            end = at + sum(map(len, own)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in own):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = [("email", *x) for x in _emails(text)]
    if _DIGIT.search(text):
        out += [("ip", *x) for x in _ips(text)]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and _luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def show(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def merge(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans by start; those that overlap are one, of the first one's kind."""
    out: list[list] = []
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if out and start < out[-1][2]:
            out[-1][2] = max(out[-1][2], end)
        else:
            out.append([kind, start, end])
    return [tuple(x) for x in out]


def entities(text: str, spans: list[tuple[str, int, int]]) -> set[str]:
    """What a text's mentions count as: themselves, and what they share with others, which has a star."""
    out = set()
    for kind, start, end in spans:
        own = text[start:end].lower()
        if kind == "email":
            shared = "*" + own[own.index("@") :]
        elif kind == "ip":
            shared = ".".join(own.split(".")[:2]) + ".*"
        else:
            shared = "".join(_DIGIT.findall(own))[: CARD_DIGITS if kind == "card" else PHONE_DIGITS] + "*"
        out |= {own, f"{kind}:{shared}", f"{kind}:*"}
    return out


def words(text: str) -> set[str]:
    """All terms of a text, in spans or not."""
    return {w.lower() for w in set(_WORD.findall(text))}


def free_words(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of the words that lie in no span."""
    taken = merge(spans)
    at = 0
    for m in _WORD.finditer(text):
        while at < len(taken) and taken[at][2] <= m.start():
            at += 1
        if at == len(taken) or taken[at][1] >= m.end():
            yield m[0].lower(), m.start(), m.end()


def origin_keys(text: str) -> np.ndarray:
    """Keys of any two bands of least values that are NEIGHBOURS apart at most, in a ring. At a similarity of 0.8 about ten of the 24
    bands are shared, so that two such are; texts that share a tenth share no two (1 in 10^6)."""
    bands = band_keys(np.unique(shingle_hashes(text, WIDE_SHINGLE)))
    pairs = [(bands * _FACTOR + np.roll(bands, -d)) * _FACTOR + np.uint64(d) for d in range(1, NEIGHBOURS + 1)]
    return np.concatenate(pairs).view(np.int64)


_SEEN = {"what": pa.int32(), "row": pa.int64(), "entity": pa.string(), "term": pa.string(), "n": pa.int64()}
_SEEN_DDL = "what int, row long, entity string, term string, n long"
_ROWS, _ENTITY, _WITH, _TERM, _BAND = range(5)


def _see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over the texts: how many they are; for a text that has entities, a row for each of them, for each term (n: whether
    it stands in no span) and for each band; and partial counts of the other texts that have a term. Such a text is named by two
    hashes in one, so copies are one."""
    import xxhash

    counts: Counter[str] = Counter()

    def made(what: int, size: int, **columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([what] * size, pa.int32()), *(pa.array(columns[c], k) if c in columns else pa.nulls(size, k) for c, k in list(_SEEN.items())[1:])], list(_SEEN))

    def counted() -> Iterator[pa.RecordBatch]:
        terms = list(counts)
        for at in range(0, len(terms), 50_000):
            own = terms[at : at + 50_000]
            yield made(_TERM, len(own), term=own, n=[counts[t] for t in own])
        counts.clear()

    for batch in batches:
        yield made(_ROWS, 1, n=[batch.num_rows])
        for text in batch.column(0):
            text = text.as_py() or ""
            spans = base_spans(text)
            if not spans:
                counts.update(words(text))
            else:
                row = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)
                found, free, every = sorted(entities(text, spans)), {t for t, _, _ in free_words(text, spans)}, sorted(words(text))
                bands = origin_keys(text).tolist()
                yield made(_ENTITY, len(found), row=[row] * len(found), entity=found)
                yield made(_WITH, len(every), row=[row] * len(every), term=every, n=[int(t in free) for t in every])
                yield made(_BAND, len(bands), row=[row] * len(bands), n=bands)
            if len(counts) > COUNTED:
                yield from counted()
    yield from counted()


def _seen(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return stash(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_see, _SEEN_DDL), "seen")


def _origins(seen: DataFrame) -> DataFrame:
    """row, origin of the texts that have copies other than exact ones; an origin is named by one of its texts."""
    bands = stash(seen.where(F.col("what") == _BAND).select("row", F.col("n").alias("key")).distinct(), "bands")
    firsts = bands.groupBy("key").agg(F.min("row").alias("first"), F.count("*").alias("k")).where("k > 1")
    edges = join_hubs(bands, firsts, "key", "k", bands.count()).where("row <> first").select(F.col("row").alias("a"), F.col("first").alias("b")).distinct()
    return components(edges).select(F.col("node").alias("row"), F.col("component").alias("origin"))


def _alike(rows: DataFrame, what: str, extra: list[str]) -> DataFrame:
    """what, same, n of rows (origin, what, ...): things that have the same origins (and extra columns) share `same`, one of them."""
    marks = stash(rows.groupBy(what, *extra).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("origin")).alias("m1"), F.bit_xor(F.xxhash64(F.lit("second"), "origin")).alias("m2")), "marks")
    same = marks.groupBy("n", "m1", "m2", *extra).agg(F.min(what).alias("same"), F.count("*").alias("k"))
    return join_hubs(marks.withColumn("mark", F.struct("n", "m1", "m2", *extra)).drop("m1", "m2"), same.select(F.struct("n", "m1", "m2", *extra).alias("mark"), "same", "k"), "mark", "k", marks.count())


def _disclosing(seen: DataFrame, disclosure: float, chance_bits: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """entity, term, strength of things that stand for their likes; and what is like them: (entity, same), (term, same, n_term)."""
    total = float(max(seen.where(F.col("what") == _ROWS).agg(F.sum("n")).first()[0] or 0, 1))
    origins = stash(_origins(seen), "origins")
    of = lambda what: seen.where(F.col("what") == what).join(origins, "row", "left").withColumn("origin", F.coalesce("origin", "row"))
    mentions = stash(of(_ENTITY).select("origin", "entity").distinct(), "mentions")
    beside = stash(of(_WITH).groupBy("origin", "term").agg(F.max("n").alias("free")), "beside")
    # a pair in one origin has at most log2(N) bits, so entities of one origin and pairs in one need not be carried
    known = stash(_alike(mentions, "entity", []).where((F.col("n") > 1) & (F.col("n") < total)), "entities")
    there = beside.groupBy("term").agg(F.sum("free").alias("free"), F.count("*").alias("n")).where("free > 1")
    others = seen.where(F.col("what") == _TERM).groupBy("term").agg(F.sum("n").alias("more"))
    reach = total ** (1 - disclosure) * (1 + 1e-9)
    counts = there.join(others, "term", "left").select("term", "free", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n_term")).where(F.col("n_term") <= F.col("free") * reach)
    counts = stash(counts, "counts")
    free = join_hubs(beside.where("free = 1").select("origin", "term"), counts.withColumn("k", F.col("free")).drop("free"), "term", "k", beside.count())
    free = stash(free, "free")
    terms = stash(_alike(free, "term", ["n_term"]).select("term", "same", "n_term"), "likes")
    # what stands for its likes, by origin
    e = known.where("entity = same").select("entity", F.col("n").alias("n_entity"))
    own = join_hubs(mentions, e.withColumn("k", F.col("n_entity")), "entity", "k", mentions.count())
    with_ = free.join(terms.where("term = same").select("term"), "term", "left_semi")
    pairs = own.join(with_, "origin").groupBy("entity", "n_entity", "term", "n_term").agg(F.count("*").alias("both")).where("both > 1")
    information = F.log2(F.lit(total) / F.col("n_entity"))
    reveals = F.log2(F.lit(total) * F.col("both") / (F.col("n_term") * F.col("n_entity").cast("double")))
    found = pairs.where(F.col("both") * reveals >= F.lit(chance_bits) + F.log2(F.lit(total)))
    found = found.select("entity", "term", (reveals / information).alias("strength")).where(F.col("strength") >= disclosure)
    return stash(found, "disclosing"), known.select("entity", "same"), terms


def disclosing_terms(docs: DataFrame, disclosure: float = DISCLOSURE, chance_bits: float = CHANCE_BITS) -> DataFrame:
    """entity, term, strength of the terms that disclose an entity in documents (text).

    A null text is empty; repeated rows and near copies with mentions are one origin, other rows count as often as they stand
    there; other columns are not read; an empty table has no terms.
    """
    found, same_entity, same_term = _disclosing(_seen(docs), disclosure, chance_bits)
    found = found.withColumnsRenamed({"entity": "e", "term": "t"})
    found = found.join(same_entity.select("entity", F.col("same").alias("e")), "e").join(same_term.select("term", F.col("same").alias("t")), "t")
    return found.select("entity", "term", "strength")


def _with_terms(docs: DataFrame, sent: int) -> tuple[DataFrame, frozenset[str] | None, str | None]:
    """docs and the disclosing terms to look for: all of them if they are `sent` at most, else none and the name of a column that
    docs has got, with each row's own."""
    seen = _seen(docs)
    found, _, same_term = _disclosing(seen, DISCLOSURE, CHANCE_BITS)
    terms = stash(same_term.join(found.select(F.col("term").alias("same")).distinct(), "same", "left_semi").select("term", "n_term"), "terms")
    if terms.count() <= sent:
        return docs, frozenset(r["term"] for r in terms.select("term").collect()), None
    row, own = fresh("_row", docs), fresh("_terms", docs)
    numbered = stash(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = sorted(words(text.as_py() or ""))
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(found), pa.int64()), pa.array(found, pa.string())], ("row", "term"))

    rows = stash(numbered.select(F.col(row), F.col("text").cast("string")).mapInArrow(every, "row long, term string"), "words")
    found = join_hubs(rows, terms, "term", "n_term", rows.count()).groupBy(F.col("row").alias(row)).agg(F.collect_list("term").alias(own))
    return numbered.join(found, row, "left").drop(row), None, own


def _spans(text: str, known: frozenset[str]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    base = base_spans(text)
    return base, [("term", s, e) for t, s, e in free_words(text, base) if t in known] if known else []


def find_personal_data(docs: DataFrame, sent: int = SENT_TERMS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term: a row for each row of documents.

    spans lists all spans as kind:start:end (code points, end exclusive), the kinds as listed, then the disclosing terms. A
    null text is empty; null ids and repeated rows pass through; other
    columns are not carried; an empty table gives an empty result.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own, known, column = _with_terms(own, sent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shown, spans, n_term = [], [], [], []
            for i, text in enumerate(batch.column(1)):
                base, terms = _spans(text.as_py() or "", known if column is None else frozenset(batch.column(2)[i].as_py() or ()))
                n = Counter(k for k, _, _ in base)
                counts.append([n[k] for k in KINDS])
                shown.append(show(base))
                spans.append(show([*base, *terms]))
                n_term.append(len(terms))
            columns = [*(pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))), pa.array(shown, pa.string()), pa.array(spans, pa.string()), pa.array(n_term, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans", "n_term"])

    out = own.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_term long")
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_term")


def clean_text(text: str, known: frozenset[str]) -> str:
    base, terms = _spans(text, known)
    out, at = [], 0
    for kind, start, end in merge([*base, *terms]):
        out += [text[at:start], "" if kind == "term" else f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, sent: int = SENT_TERMS) -> DataFrame:
    """docs with entities generalised to their kind and disclosing terms removed; n_chars, if there, counts the new text.

    All columns, whatever their names, and all rows are kept; a null text stays null and an empty one empty; repeated rows and
    ties are treated alike; an empty table gives an empty result.
    """
    names, schema = docs.columns, docs.schema
    at = names.index("text")
    rows, known, column = _with_terms(docs, sent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(len(names)).to_pylist() if column else ()
            new = [t if t is None else clean_text(t, known if column is None else frozenset(own[i] or ())) for i, t in enumerate(batch.column(at).to_pylist())]
            columns = list(batch.columns)[: len(names)]
            columns[at] = pa.array(new, pa.string())
            if "n_chars" in names:
                i = names.index("n_chars")
                columns[i] = pa.array([None if t is None else len(t) for t in new], columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, schema)
