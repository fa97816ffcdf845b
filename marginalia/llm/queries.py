"""The subpackage's queries: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import bpe, chat, htmltext, imatch, ivfpq, media, negatives, packing, pii, quality, simhash, trie, urlrules
from marginalia.llm.common import table

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def tokenizer_path(name: str) -> str:
    """Where the installed package of public tokenizer files has a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge_urls(table(spark, sf_dir, "pages"), RULES)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_texts(table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_documents(table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_pages(table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select("doc_id", "text"), model).drop("text")


def op11_ivfpq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivfpq.near_vectors(table(spark, sf_dir, "embeddings"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_pack, op2_urls, op3_simhash, op4_bpe, op5_media, op6_chat, op7_pii, op8_imatch, op9_html, op10_quality, op11_ivfpq, op12_trie, op13_negatives, pipeline)
    return {f.__name__: f for f in own}


_VOCABULARY = ", ".join(f"('{term}', {weight})" for term, weight in urlrules.VOCABULARY.items())


def _rule_case(column: str) -> str:
    """The first rule that fits, the longest first, as SQL."""
    lines = []
    for action, rule in sorted(RULES, key=lambda r: -len(r[1])):
        host, _, path = rule.partition("/")
        lines.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}') THEN '{action if column == 'action' else rule}'")
    return f"CASE {' '.join(lines)} END"


OP2_SQL = f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), hosts AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), judged AS (
  SELECT *, {_rule_case('rule')} AS rule, {_rule_case('action')} AS action,
    list_filter([{_VOCABULARY}], lambda v: list_contains(regexp_extract_all(low, '[a-z0-9]+'), v[1])) AS hits
  FROM hosts
), weighed AS (
  SELECT *, coalesce(list_sum(list_transform(hits, lambda v: v[2])), 0)::INT AS weight, len(list_filter(hits, lambda v: v[2] >= {urlrules.BLOCK_AT})) AS strict FROM judged
)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN weight >= {urlrules.BLOCK_AT} THEN 'block' ELSE 'allow' END) AS verdict,
  strict::INT AS n_strict, (len(hits) - strict)::INT AS n_soft, weight
FROM weighed
"""

OP6_SQL = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), lines AS (
  SELECT conv_id, row_number() OVER w AS pos, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS line,
    string_agg(md5(length(role)::VARCHAR || ':' || role || ':' || text), '|') OVER (w ROWS UNBOUNDED PRECEDING) AS prefix
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), whole AS (
  SELECT conv_id, max(pos) AS n_turns, arg_max(prefix, pos) AS prefix, string_agg(line, '' ORDER BY pos) AS rendered FROM lines GROUP BY conv_id
), firsts AS (SELECT min(conv_id) AS conv_id, count(*) AS n_copies FROM whole GROUP BY prefix)
SELECT w.conv_id, w.n_turns, f.n_copies, w.rendered
FROM whole w JOIN firsts f ON w.conv_id = f.conv_id
WHERE NOT EXISTS (SELECT 1 FROM lines l JOIN whole o ON l.conv_id = o.conv_id WHERE l.pos < o.n_turns AND l.prefix = w.prefix)
"""

# all pairs: what the index finds is the same where its recall is 1, as measured
OP11_SQL = """
WITH RECURSIVE able AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM able a JOIN able b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95
), reached AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON r.other = l.a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT r.vec_id, coalesce(any_value(c.n), 0)::BIGINT AS n_links, min(r.other) AS component_id, r.vec_id = min(r.other) AS kept
FROM reached r LEFT JOIN counts c ON c.a = r.vec_id GROUP BY r.vec_id
"""

# crc32 by its table; a prefix is the digests of its turns; subtrees go by the prefixes of each node's smallest member
OP12_SQL = """
WITH step AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS rest FROM range(256) t(i)
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS source, n,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, rest[(xor(c, b) & 255) + 1])), 4294967295) % 9 AS h
  FROM (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id), step
), built AS (
  SELECT c.conv_id, pos + 1 AS depth, role, text FROM convs c JOIN turns t ON t.conv_id = c.source AND pos < h
  UNION ALL
  SELECT c.conv_id, pos - c.h + least(c.h, coalesce(b.n, 0)) + 1, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND pos >= c.h LEFT JOIN convs b ON b.conv_id = c.source
), paths AS (
  SELECT conv_id, depth, text, string_agg(md5(length(role)::VARCHAR || ':' || role || ':' || text), '/') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM built
  UNION ALL SELECT conv_id, 0, '', '' FROM convs
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(strlen(text)) AS size, CASE WHEN depth = 1 THEN '' WHEN depth > 1 THEN left(path, length(path) - 33) END AS up
  FROM paths GROUP BY path, depth
), children AS (SELECT up, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY up
), kept AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON n.path = c.up
), sums AS (
  SELECT p.path, sum(CASE WHEN k.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((k.n_convs - 1) * k.size) AS saved FROM kept k JOIN paths p ON p.conv_id = k.conv_id AND p.depth <= k.depth GROUP BY p.path
), ends AS (
  SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT * FROM paths QUALIFY depth = max(depth) OVER (PARTITION BY conv_id)) GROUP BY path
)
SELECT k.conv_id, k.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM kept k JOIN sums s USING (path) LEFT JOIN nodes u ON k.up = u.path LEFT JOIN ends e ON e.path = k.path
"""

OP13_SQL = """
WITH own AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM own a JOIN own c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id))::INT AS rank,
  s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
QUALIFY rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    """Whole-table SQL twins where SQL can express the operator; the others are held against brute force in tests/llm."""
    return {"op2_urls": OP2_SQL, "op6_chat": OP6_SQL, "op11_ivfpq": OP11_SQL, "op12_trie": OP12_SQL, "op13_negatives": OP13_SQL}
