"""URL filters: host and path rules, and a weighted vocabulary found by Aho-Corasick.

A rule is an action for a host with all its subdomains and a path prefix; the longest that fits decides. Where none fits,
the url's lower-cased text is searched for the vocabulary's terms in one pass of an Aho-Corasick automaton. A hit counts only
between boundaries (no ASCII letter or digit on either side), and a term once. Terms have weights: a strict one reaches
BLOCK_AT by itself, of the soft ones it takes two or three different ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import small_batches

#: A url is blocked from this sum of weights on.
BLOCK_AT = 6
#: The default vocabulary's words by weight; each counts with its plural. Strict words alone are enough and are only that: words of
#: ordinary use (adult, poker, slots) are telling ones (3), of which it takes two; of loose ones (2) it takes three. Production
#: lists come from a table (read_vocabulary).
WORDS = {
    6: "casino gambling betting malware phishing porn porno xxx viagra cialis warez keygen hentai milf bdsm webcamsex sexcam camgirl pornstar nsfw sportsbook",
    3: "escort nude adult erotic slots poker roulette blackjack baccarat bingo payday ransomware botnet spyware trojan torrent pirated nulled "
    "cracked counterfeit replica steroid x spam farm cheap pill win bet jackpot bonus loan hack crack sexy sex dating hookup hot babe lottery wager odds stake prize winner rich debt casinos lender refinance "
    "forex crypto bitcoin token airdrop doubler binary serial patch activator leak dump carding proxy clickbait traffic popunder redirect ad track tracker affiliate "
    "weightloss diet detox miracle pharmacy rx meds drug tablet generic discount",
    2: "free deal sale offer coupon promo click buy order online shop best top1 earn money cash income guaranteed instant fast easy secret trick unlimited download "
    "mirror stream watch movie episode lyric ringtone wallpaper toolbar codec",
}


def vocabulary(words: Mapping[int, str] = WORDS) -> dict[str, int]:
    """Terms and weights of words by weight, each word with its plural; of several weights the greatest counts."""
    out: dict[str, int] = {}
    for weight in sorted(words):
        for word in words[weight].split():
            plural = word if word.endswith("s") else word[:-1] + "ies" if word.endswith("y") and word[-2] not in "aeiou" else word + ("es" if word.endswith(("x", "ch", "sh")) else "s")
            out |= {word: weight, plural: weight}
    return out


VOCABULARY = vocabulary()


def read_vocabulary(spark: SparkSession, path: str) -> dict[str, int]:
    """Terms and weights of a table (term, weight) in Parquet. It goes out with the tasks, so it is a list that people keep;
    null terms or weights are no terms, of a term's weights the greatest counts, A-Z are lower-cased."""
    rows = spark.read.parquet(path).where("term is not null and term <> '' and weight is not null").select(F.col("term").cast("string"), F.col("weight").cast("int")).collect()
    out: dict[str, int] = {}
    for term, weight in rows:
        term = term.translate(_LOWER)
        out[term] = max(weight, out.get(term, weight))
    return out


_LOWER = {c: c + 32 for c in range(65, 91)}
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ://."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[end:]
    return rest[:end].translate(_LOWER), tail[: min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))]


class Rules:
    """(action, host/path) rules by host."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for action, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, action, rule))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, action) of the longest rule that fits."""
        best, at = None, 0
        while True:
            for prefix, action, rule in self.by_host.get(host[at:], ()):
                if path.startswith(prefix) and (best is None or len(rule) > len(best[0])):
                    best = rule, action
            dot = host.find(".", at)
            if dot < 0:
                return best
            at = dot + 1


class Terms:
    """The vocabulary's automaton."""

    def __init__(self, weights: Mapping[str, int]):
        import ahocorasick

        self.weights = weights
        self.automaton = ahocorasick.Automaton()
        for term in weights:
            self.automaton.add_word(term, term)
        if weights:
            self.automaton.make_automaton()

    def find(self, url: str | None) -> set[str]:
        """The different terms that the url has between boundaries."""
        text, found = (url or "").translate(_LOWER), set()
        for end, term in self.automaton.iter(text) if self.weights else ():
            start = end - len(term) + 1
            if (start == 0 or text[start - 1] not in _WORD) and (end + 1 == len(text) or text[end + 1] not in _WORD):
                found.add(term)
        return found


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str]], weights: Mapping[str, int] = VOCABULARY, block_at: int = BLOCK_AT) -> DataFrame:
    """page_id, host, path, rule, verdict and the url's different strict and soft terms and their weight, a row for each row.

    A null url has an empty host and path, no rule and no term, and is allowed; null ids, repeated rows and ties pass
    through; other columns are not carried; an empty table gives an empty result. Rows are judged one by one, whole urls
    however long, so no host, however common, gathers anywhere.
    """
    rules, weights = list(rules), dict(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, terms = Rules(rules), Terms(weights)
        for batch in batches:
            out = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                own = [weights[t] for t in terms.find(url)]
                fits, weight, strict = known.find(host, path), sum(own), sum(w >= block_at for w in own)
                out.append((host, path, *(fits or (None, "block" if weight >= block_at else "allow")), strict, len(own) - strict, weight))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.string(),) * 4 + (pa.int32(),) * 3
            names = ("page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft", "weight")
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    small_batches(pages.sparkSession)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return own.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, n_strict int, n_soft int, weight int")
