"""The numbered queries: thin calls of the operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_quotes, decontaminate, exact_dedup, hard_negatives, license_scan, line_dedup, minhash_dedup, nearest, quality, token_counts, toxicity, whitening
from ._common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_components(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_token_counts(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), ["doc_id"])


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_quotes.link_quotes(chat_quotes.with_quotes(table(spark, sf_dir, "conversations")))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest_neighbours(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's labels: every seventh row's is moved on by one first."""
    vec_id, label = F.col("vec_id"), F.col("label")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved), anchor_every=100, positives=5, negatives=10)


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_minhash_dedup, op3_line_dedup, op4_token_counts, op5_byte_bpe, op6_quality, op7_license_scan,
        op8_exact_dedup, op9_toxicity, op10_chat_quotes, op11_whitening, op12_nearest, op13_hard_negatives,
    )
}

_SPACE = "[\\x20\\x09-\\x0D]"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SEPARATORS = license_scan.SEPARATORS
_VALUES = lambda pairs: ", ".join(f"('{label}', {words})" for label, words in pairs)
_PHRASES = _VALUES((label, phrase.split()) for phrase, label in license_scan.PHRASES.items())
_NOTICES = ", ".join(
    f"('{label}', '{label}/{i}', {sorted(set(license_scan.words_of(t)))}, {license_scan.needed(len(set(license_scan.words_of(t))), license_scan.THRESHOLD)}, {license_scan.span(t)})"
    for label, texts in license_scan.TEMPLATES.items() for i, t in enumerate(texts)
)

ORACLE_SQL = {
    "op7_license_scan": rf"""
WITH d AS (
  SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS text FROM documents
), w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '{_SEPARATORS}'), lambda x: x <> '') AS w FROM d
), places AS (
  SELECT doc_id, i - 1 AS place, label FROM w, unnest(range(1, len(w) + 1)) AS t(i), (VALUES {_PHRASES}) AS p(label, words) WHERE w[i : i + len(words) - 1] = words
), base AS (
  SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY 1
), notices AS (
  SELECT * FROM (VALUES {_NOTICES}) AS n(label, notice, words, need, span)
), spots AS (
  SELECT doc_id, i, w[i] AS token, label, notice, len(words) AS n, need, span
  FROM w, unnest(range(1, len(w) + 1)) AS t(i) JOIN (SELECT *, unnest(words) AS token FROM notices) ON token = w[i]
), blocks AS (
  SELECT a.doc_id, a.label, a.notice, a.i, count(DISTINCT b.token) / any_value(a.n) AS c
  FROM spots a JOIN spots b ON a.doc_id = b.doc_id AND a.notice = b.notice AND b.i >= a.i AND b.i < a.i + a.span GROUP BY ALL HAVING count(DISTINCT b.token) >= any_value(a.need)
), best AS (
  SELECT doc_id, max(c) AS best FROM blocks GROUP BY 1
), names AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM blocks) GROUP BY 1
)
SELECT w.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN names USING (doc_id)""",
    "op2_minhash_dedup": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '{_SPACE}+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g FROM w, unnest(range(1, greatest(len(w), 2))) AS t(i) WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)
), reach AS (
  SELECT doc_id, doc_id AS c FROM documents UNION SELECT links.b, c FROM reach JOIN links ON links.a = reach.doc_id
)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id, r.doc_id = min(c) AS kept
FROM reach r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id""",
    "op3_line_dedup": rf"""
WITH lines AS (
  SELECT doc_id, i, l[i] AS line,
         {_LOWER.format(rf"regexp_replace(regexp_replace(l[i], '^{_SPACE}+', ''), '{_SPACE}+$', '')")} AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS t(i)
), firsts AS (
  SELECT k, min(doc_id) AS first_id FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT lines.*, firsts.k IS NOT NULL AND doc_id <> first_id AS dropped FROM lines LEFT JOIN firsts USING (k)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op8_exact_dedup": rf"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}+', '', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)""",
    "op10_chat_quotes": r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) AS k FROM conversations
), p AS (
  SELECT m.conv_id, m.turn, m.role, m.text, q.turn IS NOT NULL AS quotes1, r.turn IS NOT NULL AND q.turn IS NOT NULL AS quotes2,
         (SELECT max(o.turn) FROM m o WHERE o.conv_id = m.conv_id AND o.k = q.k AND q.k <> '' AND o.turn < m.turn) AS parent_turn
  FROM m LEFT JOIN m q ON q.conv_id = m.conv_id AND q.turn = m.turn - 1 LEFT JOIN m r ON r.conv_id = m.conv_id AND r.turn = m.turn - 2
), d AS (
  SELECT conv_id, turn, turn AS thread_turn, 0 AS depth FROM p WHERE parent_turn IS NULL
  UNION ALL SELECT p.conv_id, p.turn, d.thread_turn, d.depth + 1 FROM p JOIN d ON d.conv_id = p.conv_id AND d.turn = p.parent_turn
)
SELECT p.conv_id, p.turn, p.role, CASE WHEN parent_turn IS NOT NULL THEN p.conv_id END AS parent_conv, parent_turn, p.conv_id AS thread_conv,
       d.thread_turn, d.depth, quotes1::INT + quotes2::INT AS n_quotes, quotes1::INT + quotes2::INT AS levels, p.text
FROM p JOIN d USING (conv_id, turn)""",
    "op12_nearest": """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_distance(q.x, v.x) AS score FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM d
WINDOW w AS (PARTITION BY query_id ORDER BY score, vec_id) QUALIFY row_number() OVER w <= 10""",
    "op13_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_inner_product(a.x, v.x) AS BIGINT) AS score
  FROM v a JOIN v ON v.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10""",
}
