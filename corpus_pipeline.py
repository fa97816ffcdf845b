"""A training corpus from documents: quality classifier, near-duplicates, personal data, packing.

Each stage takes what the one before has kept, as a table in the shared folder, and all but the last return the columns of
documents. Nulls, empty and repeated rows are treated as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import packing, pii, quality, simhash
from marginalia.llm.common import stash, table
from marginalia.llm.queries import tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model selects; its ratings are the table labels. A null text is an empty one, and is judged like it;
    null ids and repeated rows are judged like any; an empty table stays empty."""
    return quality.select(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by five-word shingles at a similarity of 0.8; links of fingerprints are verified.
    A null text is an empty one; rows without a doc_id are kept where their group has none with one; of repeated rows one is kept."""
    return simhash.keep_representatives(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data generalised and terms that disclose it removed. A null text stays null, an empty one empty;
    null ids and repeated rows pass through."""
    return pii.sanitise(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences. A null text is an empty one; null ids and repeated rows have
    places of their own."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", keep_good), ("near_duplicates", drop_near_duplicates), ("personal_data", hide_personal_data), ("packing", pack_sequences)]

#: No stage but the first can be told in SQL, so the result is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
