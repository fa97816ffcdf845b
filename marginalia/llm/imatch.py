"""I-Match document fingerprints over randomised lexicon subsets, in DataFrame functions only.

Terms are words, lower-cased, without punctuation at their ends. The lexicon holds the terms whose document frequency over the whole
corpus lies in a band of shares (so of inverse document frequencies). The band's lower end bounds it: at most mean terms a
document / LOW terms, however large the corpus, so it may come to the driver and stand in the plan as a set. From it
LEVELS x SUBSETS random subsets are drawn, each level half as dense as the one before. A fingerprint has a hash of a
document's sorted distinct terms in each subset; thin subsets survive edits of long documents, dense ones tell short ones apart.
A document without any of the lexicon's terms has, in all subsets, the hash of all its terms: it is like its copies only.
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import stash

#: Shares of documents between which a term is kept.
LOW, HIGH = 0.001, 0.05
#: Documents that a term needs at least (for small tables).
LEAST = 2
LEVELS, SUBSETS = 7, 4
#: Documents of a stretch of ids, and the most stretches: what one task orders to find next documents.
STRETCH, MOST_STRETCHES = 2000, 40_000


def terms(text: Column) -> Column:
    """The text's distinct words."""
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """term, docs: the terms in the band, of documents (doc_id, text): at most the mean number of different terms a document / low.

    A null text is empty; repeated rows count as often as they stand there; an empty table has no terms.
    """
    total = docs.count()
    counts = docs.select(F.explode(terms(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("docs"))
    return counts.where((F.col("term") != "") & (F.col("docs") >= max(LEAST, low * total)) & (F.col("docs") <= max(LEAST, high * total)))


def hash_table(hashes: list[int]) -> Column:
    """A constant array of buckets, each an array of the hashes that fall there: a set that is looked up in constant time.

    (A long IN list would do the same, but is walked by every rule of the optimizer.)
    """
    n = max(1, len(hashes))
    buckets: list[list[int]] = [[] for _ in range(n)]
    for h in hashes:
        buckets[h % n].append(h)
    return F.from_json(F.lit(json.dumps(buckets)), "array<array<bigint>>")


def term_hashes(text: Column) -> Column:
    """Sorted 64-bit hashes of the text's distinct terms."""
    return F.array_sort(F.transform(F.filter(terms(text), lambda t: t != ""), lambda t: F.xxhash64(t)))


def kept_hashes(hashes: Column, table: Column, size: int) -> Column:
    """Those of the hashes that are in the lexicon."""
    return F.filter(hashes, lambda h: F.array_contains(F.element_at(table, (F.pmod(h, F.lit(max(1, size)).cast("long")) + 1).cast("int")), h))


def subset_hashes(text: Column, table: Column, size: int) -> Column:
    """A hash for each subset, 0 for one without terms. Level l takes 1 in SUBSETS * 2^l terms into each of its subsets. Without
    terms of the lexicon it is the hash of all terms in each, and 0 without any."""
    zero = F.lit(0).cast("long")
    draws = F.array(*[F.struct(F.lit(7 * level).alias("shift"), F.lit(SUBSETS << level).cast("long").alias("of"), F.lit(subset).cast("long").alias("subset")) for level in range(LEVELS) for subset in range(SUBSETS)])

    def of(pool: Column, d: Column) -> Column:
        # other bits for every level, so that its subsets are drawn anew
        own = F.filter(pool, lambda h: F.pmod(F.call_function("shiftrightunsigned", h, d["shift"]), d["of"]) == d["subset"])
        return F.when(F.size(own) > 0, F.xxhash64(own)).otherwise(zero)

    def drawn(x: Column) -> Column:
        whole = F.when(F.size(x["every"]) > 0, F.xxhash64(x["every"])).otherwise(zero)
        return F.when(F.size(x["pool"]) > 0, F.transform(draws, lambda d: of(x["pool"], d))).otherwise(F.transform(draws, lambda d: whole))

    # hashes and pool are lambdas' variables so that they are computed once
    both = F.transform(F.array(term_hashes(text)), lambda every: F.struct(every.alias("every"), kept_hashes(every, table, size).alias("pool")))
    return F.transform(both, drawn)[0]


def fingerprint_text(hashes: Column) -> Column:
    return F.concat_ws("", F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))))


def likeness(a: Column, b: Column) -> Column:
    """The share of subsets with the same hash among those where either has terms; 1 for two documents without any term.

    The subsets are all of them, or those from the thinnest level on in which nearly all have terms, whichever agree more:
    of a long document an edit changes every dense subset.
    """

    def share(pairs: Column) -> Column:
        some = F.size(F.filter(pairs, lambda z: (z["x"] != 0) | (z["y"] != 0)))
        same = F.size(F.filter(pairs, lambda z: (z["x"] != 0) & (z["x"] == z["y"])))
        return F.when(some > 0, same / some).otherwise(F.lit(1.0))

    def best(pairs: Column) -> Column:
        size = lambda level: F.size(F.filter(F.slice(pairs, level * SUBSETS + 1, SUBSETS), lambda z: (z["x"] != 0) | (z["y"] != 0)))
        full = F.greatest(*[F.when(size(level) >= SUBSETS - 1, F.lit(level)).otherwise(F.lit(0)) for level in range(LEVELS)])
        return F.greatest(share(pairs), share(F.slice(pairs, full * SUBSETS + 1, F.lit(LEVELS * SUBSETS))))

    # the pairs are a lambda's variable so that they are computed once
    return F.transform(F.array(F.arrays_zip(a.alias("x"), b.alias("y"))), best)[0]


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """doc_id, text, carried columns (which the text determines), and next_<column> of the next document by ascending doc_id (null
    first); after the last comes the first. Rows of one id go by text, repeated rows next to each other; an id, or null, that
    holds more rows than a stretch orders its texts by a hash first, so that no task holds them all.

    Ids are cut at quantiles into stretches that tasks order for themselves; the first document of a stretch also goes, as
    its end, to the stretch before. Only the cuts, a number for each stretch, come to the driver; an id that several quantiles
    share is a crowded one.
    """
    ids = docs.agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    stretches = max(1, min(MOST_STRETCHES, ids["n"] // STRETCH))
    shares = [i / stretches for i in range(1, stretches)]
    found = (docs.agg(F.percentile_approx("doc_id", shares, 10 * stretches + 1000)).first()[0] if shares else None) or []
    cuts = sorted({c for c in found if c > ids["least"]})
    slots: dict[int | None, int] = {c: times + 1 for c, times in Counter(found).items() if times > 1}
    if stretches > 1 and ids["nulls"] > ids["n"] // stretches:
        slots[None] = ids["nulls"] * stretches // ids["n"] + 1
    rows = docs.select("doc_id", "text", *carried, F.lit(False).alias("is_mark"))
    columns = ["doc_id", "text", *carried, *(f"next_{c}" for c in ("text", *carried))]
    if slots:
        dealt = _dealt(rows, slots)
        inside, bounds = _crowded(dealt.where("slots is not null"), carried)
        rows = dealt.where("slots is null").drop("slots").unionByName(bounds)
    own, end_of = _places(F.col("doc_id"), cuts, None if ids["nulls"] else ids["least"])
    rows = rows.withColumn("at", F.explode(F.array_compact(F.array(own, end_of))))
    # an end stands after its stretch's own rows
    w = Window.partitionBy("at.place").orderBy("at.is_end", F.col("doc_id").asc_nulls_first(), F.col("is_mark").desc(), "text")
    led = rows.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in ("text", *carried)))
    led = led.where("not at.is_end and not is_mark").select(columns)
    return led.unionByName(inside.select(columns)) if slots else led


def _dealt(rows: DataFrame, slots: dict[int | None, int]) -> DataFrame:
    """The rows with the number of slots of their id, null where it is not crowded (at most MOST_STRETCHES ids are)."""
    named = rows.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps([{"id": i, "slots": n} for i, n in slots.items()])), "array<struct<id bigint, slots int>>")).alias("named"))
    named = F.broadcast(named.select(F.col("named.id").alias("crowded_id"), F.col("named.slots").alias("slots")))
    return rows.join(named, F.col("doc_id").eqNullSafe(F.col("crowded_id")), "left").drop("crowded_id")


def _crowded(rows: DataFrame, carried: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of the rows of crowded ids: those followed by a row of their id, with it, and the bounds of each id for the order of all ids
    (a mark with its first text, which stands for it as the next of the row before, and its last row).

    Texts are dealt to the id's slots by hash. Repeated rows are counted first: all but one are followed by themselves. The first
    text of a slot goes, as its end, to the slot before; there are at most about twice MOST_STRETCHES slots.
    """
    kept = ["text", *carried]
    slot = F.pmod(F.xxhash64("text"), F.col("slots").cast("long")).alias("slot")
    crowd = stash(rows.groupBy("doc_id", slot, *kept).agg(F.count("*").alias("copies")), "crowd")
    heads = crowd.groupBy("doc_id", "slot").agg(F.min(F.struct(*kept)).alias("head"))
    heads = heads.withColumn("before", F.lag("slot").over(Window.partitionBy("doc_id").orderBy("slot")))
    ends = heads.where("before is not null").select("doc_id", F.col("before").alias("slot"), "head.*", F.lit(True).alias("is_end"))
    w = Window.partitionBy("doc_id", "slot").orderBy("is_end", "text")
    led = crowd.drop("copies").withColumn("is_end", F.lit(False)).unionByName(ends)
    led = stash(led.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in kept)).where("not is_end").drop("is_end", "slot"), "led")
    again = crowd.where("copies > 1").select("doc_id", *kept, "copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies") - 1, F.lit(STRETCH).cast("long"))).alias("at"))
    again = again.repartition(F.xxhash64("text"), "at").select("doc_id", *kept, F.explode(F.sequence("at", F.least(F.col("at") + STRETCH, F.col("copies")) - 1)).alias("nth"))
    inside = led.where("next_text is not null").unionByName(again.drop("nth").select("*", *(F.col(c).alias(f"next_{c}") for c in kept)))
    marks = heads.where("before is null").select("doc_id", "head.*", F.lit(True).alias("is_mark"))
    return inside, marks.unionByName(led.where("next_text is null").select("doc_id", *kept, F.lit(False).alias("is_mark")))


def _places(doc_id: Column, cuts: list[int], least: int | None) -> tuple[Column, Column]:
    """The stretch of an id, and the stretch whose end it is, if any, as structs (place, is_end); least: the first id of all."""
    # two steps: among every k-th cut, then among the k that follow
    k = max(1, int(len(cuts) ** 0.5))
    coarse = cuts[::k]
    blocks = [cuts[i : i + k] for i in range(0, len(cuts), k)]
    long = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs]) if xs else F.array().cast("array<bigint>")
    below = lambda xs: F.size(F.filter(xs, lambda c: c <= doc_id))
    block = below(long(coarse))
    inside = F.element_at(F.array(*map(long, blocks)), F.greatest(block, F.lit(1))) if blocks else long([])
    number = F.when(doc_id.isNull() | (block == 0), F.lit(0)).otherwise((block - 1) * k + below(inside))
    is_cut = F.array_contains(inside, doc_id) & (block > 0)
    end = F.when(is_cut, number - 1).when(doc_id.eqNullSafe(F.lit(least)), F.lit(len(cuts)))
    place = lambda n, e: F.struct(n.cast("int").alias("place"), F.lit(e).alias("is_end"))
    return place(number, False), F.when(end.isNotNull(), place(end, True))


def fingerprint_documents(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: a row for each row.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document. A null text is empty. A null doc_id comes first in the order (see with_next); repeated rows stand next to each other
    and are each other's next; a single document is its own. Other columns are not carried; an empty table gives an empty result.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = stash(lexicon(own, low, high).select(F.xxhash64("term").alias("h")), "lexicon")
    hashes = sorted(r["h"] for r in words.distinct().collect())
    table = hash_table(hashes)
    first = own.withColumn("prints", subset_hashes(F.col("text"), table, len(hashes)))
    rows = with_next(first, ["prints"])
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.coalesce("next_text", "text"), F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "prints", F.coalesce("next_prints", "prints").alias("next_prints"))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "prints", "next_prints", subset_hashes(F.col("edited"), table, len(hashes)).alias("edited_prints"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint_text(F.col("prints")).alias("fingerprint"), fingerprint_text(F.col("edited_prints")).alias("edited_fingerprint"),
        likeness(F.col("prints"), F.col("edited_prints")).alias("near_edited"), likeness(F.col("prints"), F.col("next_prints")).alias("near_next"),
    )
