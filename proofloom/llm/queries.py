"""The registered queries of this subpackage over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.llm import blocks, bytepair, chat, collocations, contamination, language, lmscore, neardup, negatives, repeats, search, tokencount, urls
from proofloom.llm.tables import bounded_batches, read_ranks, table


def bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bytepair.encode_texts(docs, ranks, public_tokenizers.PATTERN, spaced=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    found = urls.judged(pages, urls.rules_from(URL_RULES))
    return found.select("page_id", "host", "path", "rule", "verdict", "score")


def vector_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", search.scaled(F.col("embedding")).alias("vector"))
    return search.top_k(rows, rows.where(F.col("vec_id") % 50 == 0))


VECTOR_TOP = """
WITH scaled AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM scaled q JOIN scaled c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


BENCHMARK_HITS = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, array_to_string(w[k : k + 9], ' ') AS win, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM wins
), starts AS (
  SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)
), hits AS (SELECT s.doc_id, s.k, s.n, v.item_id FROM starts s JOIN wins v ON v.win = s.win AND v.n = s.n
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=2)


def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return repeats.without_repeats(docs).select(
        "doc_id",
        n_bytes.alias("n_bytes"),
        (n_bytes - F.octet_length("kept_bytes")).cast("long").alias("n_removed"),
        F.coalesce(F.octet_length("runs") / 16, F.lit(0)).cast("long").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    pieces = tokencount.spaced_pieces(read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    return tokencount.piece_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), *pieces).select("doc_id", "n_words", "n_tokens")


def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lmscore.scores(table(spark, sf_dir, "documents"), good)


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = language.held_out(F.col("doc_id"))
    model = language.fit(docs, F.col("doc_id").isNotNull() & ~held)
    return language.language(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rendered(table(spark, sf_dir, "conversations"))


CHATS = """
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
), conv AS (
  SELECT conv_id, list(struct_pack(turn := turn, role := role, text := text) ORDER BY turn, role, text) AS l FROM turns GROUP BY conv_id
), marked AS (SELECT conv_id, len(l) AS n, CAST(l AS VARCHAR) AS h, l FROM conv
), lens AS (SELECT DISTINCT n FROM marked
), pre AS (
  SELECT DISTINCT lens.n, CAST(m.l[1 : lens.n] AS VARCHAR) AS h FROM marked m JOIN lens ON lens.n < m.n
), kept AS (
  SELECT min(conv_id) AS conv_id FROM marked WHERE NOT EXISTS (SELECT 1 FROM pre WHERE pre.n = marked.n AND pre.h = marked.h) GROUP BY n, h
)
SELECT conv_id, CAST(floor(turn / 64) AS BIGINT) AS part, count(*) AS n_rows,
  string_agg('<|' || lower(coalesce(role, 'user')) || '|>' || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn, role, text) AS chat
FROM turns JOIN kept USING (conv_id) GROUP BY ALL
"""


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


PHRASES = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_extract_all(t, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM d)
), places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS k FROM pieces
), grams AS (
  SELECT lang, len(g) AS size, array_to_string(g, ' ') AS phrase, g, count(*) AS f
  FROM (SELECT lang, w[k : k + s - 1] AS g FROM places, (VALUES (1), (2), (3)) sizes(s) WHERE k + s - 1 <= len(w)) GROUP BY lang, g
), totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE size = 1 GROUP BY lang
), cuts AS (
  SELECT c.lang, c.phrase, c.g, c.size, c.f AS a, l.f AS l, r.f AS r, k,
    (1000000::HUGEINT * c.f * c.f) // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM grams WHERE size > 1 AND f >= 10) c
  JOIN grams l ON l.lang = c.lang AND l.phrase = array_to_string(c.g[:k], ' ')
  JOIN grams r ON r.lang = c.lang AND r.phrase = array_to_string(c.g[k + 1 :], ' ')
), candidates AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, a AS f, unnest([array_to_string(g[:2], ' '), array_to_string(g[2:], ' ')]) AS phrase FROM candidates WHERE size = 3) GROUP BY ALL
)
SELECT c.lang, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, c.phrase) AS rank, c.phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM candidates c JOIN totals USING (lang) LEFT JOIN longer ON longer.lang = c.lang AND longer.phrase = c.phrase
WHERE longer.f IS NULL OR 100 * longer.f < 50 * a QUALIFY rank <= 2000
"""


def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label, search.scaled(F.col("embedding")).alias("vector"))
    return negatives.hard_negatives(rows, rows.where(F.col("vec_id") % 100 == 0))


HARD_NEGATIVES = """
WITH scaled AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, o.vec_id, a.label = o.label AS same, CAST(list_dot_product(a.v, o.v) AS BIGINT) AS score
  FROM scaled a JOIN scaled o ON a.vec_id <> o.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


def repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blocks.without_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


REPEATED_WORDS = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, k, array_to_string(w[k : k + 49], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d)
), later AS (
  SELECT doc_id, k FROM (SELECT *, min(doc_id) OVER (PARTITION BY win) AS least FROM starts) WHERE doc_id > least
), gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS p FROM later
), words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": token_counts,
    "op2_bpe_roundtrip": bpe_roundtrip,
    "op3_url_verdicts": url_verdicts,
    "op4_vector_top": vector_top,
    "op5_benchmark_hits": benchmark_hits,
    "op6_lm_scores": lm_scores,
    "op7_repeated_passages": repeated_passages,
    "op8_near_copies": near_copies,
    "op9_languages": languages,
    "op10_chats": chats,
    "op11_phrases": phrases,
    "op12_hard_negatives": hard_negatives,
    "op13_repeated_words": repeated_words,
}
ORACLES: dict[str, str] = {"op4_vector_top": VECTOR_TOP, "op5_benchmark_hits": BENCHMARK_HITS, "op10_chats": CHATS, "op11_phrases": PHRASES, "op12_hard_negatives": HARD_NEGATIVES, "op13_repeated_words": REPEATED_WORDS}
