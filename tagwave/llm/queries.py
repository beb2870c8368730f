"""The registered queries over the given tables.

Each is the thin query of one operator over its whole table. ``ORACLE`` holds DuckDB texts where SQL can
express an operator; the others are held against brute force in the tests.
"""

from __future__ import annotations

from . import decontaminate, fingerprints, html_extract, jaccard_join, language_id
from . import lexical_search, line_dedup, packing, prefix_trie, secret_scan, substring_dedup, tier_packing, toxicity
from .common import table


def op1_html_extract(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_line_dedup(spark, sf_dir):
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), length_col="n_chars")


def op3_substring_dedup(spark, sf_dir):
    return substring_dedup.repeats(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark, sf_dir):
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark, sf_dir):
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents")).drop("row_key")


def op10_decontaminate(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_tier_packing(spark, sf_dir):
    import public_tokenizers

    return tier_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_lexical_search(spark, sf_dir):
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_html_extract, op2_line_dedup, op3_substring_dedup, op4_secret_scan, op5_fingerprints, op6_toxicity, op7_packing,
    op8_language_id, op9_jaccard_join, op10_decontaminate, op11_prefix_trie,
    op12_tier_packing, op13_lexical_search)}

_TERMS = (r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

ORACLE: dict[str, str] = {
    "op11_prefix_trie": """
WITH turns AS (
  SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, list(t ORDER BY p) AS own FROM turns GROUP BY conv_id),
hashed AS (
  SELECT conv_id, own, CAST(xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
      string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [256 + ascii(c), 0, 0, 0, 0, 0, 0, 0, 0]))),
    lambda crc, x: CASE WHEN x >= 256 THEN xor(crc, x - 256) WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END),
    4294967295::BIGINT) % 6 AS BIGINT) AS h FROM convs),
rebuilt AS (
  SELECT c.conv_id, list_concat(list_slice(coalesce(a.own, []), 1, c.h), list_slice(c.own, c.h + 1, len(c.own))) AS path
  FROM hashed c LEFT JOIN convs a ON a.conv_id = c.conv_id - c.conv_id % 100),
members AS (
  SELECT conv_id, d, list_slice(path, 1, d) AS node, d = len(path) AS ends
  FROM (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
    CASE WHEN d > 0 THEN (count(*) - 1) * length(node[d].text) ELSE 0 END AS saved
  FROM members GROUP BY node, d),
children AS (SELECT list_slice(node, 1, d - 1) AS node, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
counted AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.d = n.d AND c.node = n.node),
below AS (
  SELECT list_slice(node, 1, up) AS node, up AS d, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT node, saved, n_children, unnest(range(0, d + 1)) AS up FROM counted) GROUP BY ALL)
SELECT c.conv_id, c.d AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, b.n_leaves,
  CAST(b.saved_tokens AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted c JOIN below b ON b.d = c.d AND b.node = c.node
LEFT JOIN nodes p ON c.d > 0 AND p.d = c.d - 1 AND p.node = list_slice(c.node, 1, c.d - 1)
""",
    "op13_lexical_search": f"""
WITH numbered AS (SELECT doc_id, text, row_number() OVER () AS row FROM documents),
terms AS (
  SELECT doc_id, row, t, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT doc_id, row, unnest({_TERMS}) AS t FROM numbered) GROUP BY ALL),
lengths AS (SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM terms GROUP BY row),
totals AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS total FROM lengths),
weights AS (
  SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM terms, totals GROUP BY t, n_docs),
items AS (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark),
scores AS (
  SELECT item_id, doc_id, row,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // total)))) AS BIGINT) AS score
  FROM items JOIN weights USING (t) JOIN terms USING (t) JOIN lengths USING (row), totals GROUP BY item_id, doc_id, row),
ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
""",
}
