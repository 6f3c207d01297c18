"""Phrase verification, locations and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import tables as tb
from bindings.ctes import norm, title_case, token_set
from bindings.registry import Group
from proofloom.functions import text as tx
from proofloom.operators import export as ex
from proofloom.operators import fusion, onepass
from proofloom.operators import sections as se
from proofloom.operators import verify as v
from proofloom.plans import answer as plan
from proofloom.plans import retrieve
from proofloom.plans import verify as vp
from proofloom.session import stored

GROUP = Group()
query = GROUP.query
QUERIES, ORACLES = GROUP.queries, GROUP.oracles


def _sections(spark, d):
    return tb.split_request(plan.assemble_sections(plan.parse_analyses(tb.responses(spark, d), tb.sub_prompts(spark, d))))


def _phrases(spark, d, sections=None):
    sections = _sections(spark, d) if sections is None else sections
    quoted = se.section_phrases(sections, "doc_id").select("doc_id", "section_key", "phrase")
    return quoted.unionByName(tb.crossing_phrases(spark, d))


def _verified(spark, d, fuzzy=False, sections=None):
    return vp.verify_phrases(_phrases(spark, d, sections), tb.chunks(spark, d), fuzzy, written=True)


# Benchmark sentences sought in every document.
SOUGHT = f"""SELECT item_id, phrase, {norm('phrase')} AS norm_phrase FROM (
  SELECT item_id, unnest(string_split(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '([.!?]+) ', '\\1' || chr(30), 'g'), chr(30))) AS phrase FROM benchmark)"""


@query("j07_phrase_tiers", f"""
SELECT item_id, phrase, doc_id, chunk_index, CASE WHEN contains(norm_text, norm_phrase) THEN 1 ELSE 2 END AS match_tier FROM (
  SELECT p.item_id, p.phrase, p.norm_phrase, c.doc_id, c.chunk_index, c.norm_text
  FROM (SELECT *, {token_set('norm_phrase')} AS words FROM (SELECT DISTINCT item_id, phrase, norm_phrase FROM ({SOUGHT})) WHERE length(norm_phrase) > 0) p
  JOIN t_norm_chunks c ON contains(c.norm_text, p.norm_phrase) OR (len(p.words) > 0 AND list_has_all(c.words, p.words)))""")
def j07(spark, d):
    split = tb.table(spark, d, "benchmark").select("item_id", F.explode(tx.sentence_array(F.regexp_replace("text", r"\s+", " "))).alias("phrase"))
    phrases = split.distinct().withColumn("norm_phrase", tx.normalize("phrase"))
    return v.exact_matches(phrases, tb.chunks(spark, d)).select("item_id", "phrase", "doc_id", "chunk_index", "match_tier")


@query("p12_verify_exact", "SELECT doc_id, phrase, verified FROM t_verified")
def p12(spark, d):
    return _verified(spark, d).verification.select("doc_id", "phrase", "verified")


@query("p12_locations", "SELECT doc_id, phrase, chunk_index, page_num, method, x0, y0, x1, y1, offset_at FROM t_places")
def p12_locations(spark, d):
    rows = _verified(spark, d).locations
    return rows.select("doc_id", "phrase", "chunk_index", "page_num", "method", "rect.*", F.col("offset").alias("offset_at"))


@query("j09_pass_counts", """
SELECT 'single' AS pass, count(*) AS n FROM (SELECT DISTINCT doc_id, phrase FROM t_single)
UNION ALL SELECT 'crossed', count(*) FROM t_crossed UNION ALL SELECT 'open', count(*) FROM t_verified WHERE NOT verified""")
def j09(spark, d):
    chunks = tb.chunks(spark, d)
    phrases = stored(v.with_forms(v.phrases_to_verify(_phrases(spark, d))), "phrases")
    single, crossed, lenient = v.match_passes(phrases, chunks, fuzzy=False)
    parts = [("single", single), ("crossed", crossed), ("open", v.unmatched(phrases, single, crossed, lenient))]
    tag = lambda rows, name: rows.select("doc_id", "phrase").distinct().agg(F.count("*").alias("n")).select(F.lit(name).alias("pass"), "n")
    out = None
    for name, rows in parts:
        out = tag(rows, name) if out is None else out.unionByName(tag(rows, name))
    return out


@query("j15_occurrences", "SELECT doc_id, phrase, chunk_index, offset_at, x0, y0, x1, y1 FROM t_exact_places")
def j15(spark, d):
    rows = _verified(spark, d).locations.where(F.col("method") == v.METHOD_EXACT)
    return rows.select("doc_id", "phrase", "chunk_index", F.col("offset").alias("offset_at"), "rect.*")


@query("a10_verified", "SELECT doc_id, bool_or(verified) AS any_verified, bool_and(verified) AS all_verified FROM t_verified GROUP BY doc_id")
def a10(spark, d):
    return _verified(spark, d).verification.groupBy("doc_id").agg(F.bool_or("verified").alias("any_verified"), F.bool_and("verified").alias("all_verified"))


@query("a12_tally", "SELECT doc_id, count(*) AS n_phrases, count(*) FILTER (verified) AS n_verified FROM t_verified GROUP BY doc_id")
def a12(spark, d):
    return v.tally(_verified(spark, d).verification)


PRIORITY = """CASE method WHEN 'exact_cleaned_search' THEN 5 WHEN 'cross_page_fuzzy_match_part1' THEN 2 WHEN 'cross_page_fuzzy_match_part2' THEN 2
  WHEN 'fuzzy_chunk_fallback_individual' THEN 1 WHEN 'fuzzy_chunk_fallback' THEN 0 ELSE -1 END"""


@query("w07_best_location", f"""
SELECT doc_id, phrase, chunk_index, method, y0, y1 FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, phrase ORDER BY {PRIORITY} DESC, chunk_index, method, offset_at, y0, x0) AS r FROM t_places) WHERE r = 1""")
def w07(spark, d):
    return v.best_location(_verified(spark, d).locations).select("doc_id", "phrase", "chunk_index", "method", "rect.y0", "rect.y1")


@query("w08_best_by_score", "SELECT doc_id, phrase, chunk_index, method, y0, y1 FROM t_best_place")
def w08(spark, d):
    return v.best_location(_verified(spark, d).locations, by_method=False).select("doc_id", "phrase", "chunk_index", "method", "rect.y0", "rect.y1")


@query("w10_first_cross", "SELECT doc_id, phrase, chunk_index, method FROM t_crossed_places")
def w10(spark, d):
    rows = _verified(spark, d).locations.where(F.col("method").startswith(v.METHOD_CROSS))
    return rows.select("doc_id", "phrase", "chunk_index", "method")


@query("s10_highlights", """
SELECT doc_id, phrase, page_num, x0, y0, x1, y1, method, CASE WHEN contains(method, 'fallback') THEN 'blue' ELSE 'yellow' END AS color,
       'Verified (' || method || ', Score: 100): ' || substr(phrase, 1, 100) || '...' AS label
FROM t_places WHERE x1 > x0 AND y1 > y0""")
def s10(spark, d):
    chunks = tb.chunks(spark, d)
    rows = v.highlights(_verified(spark, d).locations, v.page_counts(chunks))
    return rows.select("doc_id", "phrase", "page_num", "rect.*", "method", "color", "label")


def _evidence(spark, d):
    """Sections are written once, for the phrases and for the rows that cite them."""
    sections = stored(_sections(spark, d), "sections")
    found = _verified(spark, d, sections=sections)
    best = v.best_location(found.locations, by_method=False)
    return ex.phrase_evidence(sections, found.verification, best)


NAME = "'doc_' || doc_id || '.pdf'"


@query("j12_evidence", "SELECT doc_id, section_no, phrase, verified, page_num, count(*) AS n FROM t_evidence GROUP BY ALL")
def j12(spark, d):
    return _evidence(spark, d).groupBy("doc_id", "section_no", "phrase", "verified", "page_num").agg(F.count("*").alias("n"))


EXPORT = f"""
SELECT {NAME} AS "Filename", {title_case("replace(section_key, '_', ' ')")} AS "Section", analysis AS "Analysis", context AS "Context",
  coalesce(phrase, 'No relevant phrase found.') AS "Supporting Phrase", CASE WHEN phrase IS NULL THEN 'N/A' WHEN verified THEN 'Yes' ELSE 'No' END AS "Verified",
  CASE WHEN phrase IS NULL THEN 'N/A' ELSE coalesce(CAST(page_num + 1 AS VARCHAR), 'Unknown') END AS "Page",
  CASE WHEN phrase IS NULL OR match_score IS NULL THEN 'N/A' ELSE '100.0%' END AS "Match Score" FROM t_evidence"""


def _name():
    return F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf"))


@query("p13_export", EXPORT)
def p13(spark, d):
    return ex.export_rows(_evidence(spark, d), _name())


@query("s06_flat_export", EXPORT)
def s06(spark, d):
    """Written as CSV to the shared folder and read back."""
    import uuid

    from proofloom.session import checkpoint_root

    path = f"{checkpoint_root(spark)}/export-{uuid.uuid4().hex}"
    ex.write_flat(ex.export_rows(_evidence(spark, d), _name()), path)
    schema = ", ".join(f"`{c}` string" for c in ex.EXPORT_COLUMNS)
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("nullValue", "\\N").schema(schema).csv(path)


@query("a18_needs_review", "SELECT doc_id, section_key, bool_or(phrase IS NOT NULL AND NOT verified) AS needs_review FROM t_evidence GROUP BY doc_id, section_key")
def a18(spark, d):
    return ex.needs_review(_evidence(spark, d))


@query("s11_outline", f"""
SELECT doc_id, level, text, count(*) AS n FROM (
  SELECT doc_id, 'heading1' AS level, 'Document: ' || {NAME} AS text FROM t_evidence WHERE phrase_no = 0 AND section_no = 1
  UNION ALL SELECT doc_id, 'heading2', {title_case("replace(section_key, '_', ' ')")} FROM t_evidence WHERE phrase_no = 0
  UNION ALL SELECT doc_id, 'analysis', 'Analysis: ' || analysis FROM t_evidence WHERE phrase_no = 0 AND length(trim(analysis)) > 0
  UNION ALL SELECT doc_id, 'context', 'Context: ' || context FROM t_evidence WHERE phrase_no = 0 AND length(trim(context)) > 0
  UNION ALL SELECT doc_id, 'heading3', 'Supporting Citations' FROM t_evidence WHERE phrase_no = 0 AND phrase IS NOT NULL
  UNION ALL SELECT doc_id, 'citation', CASE WHEN verified THEN '✓ ' || phrase || ' (Pg: ' || coalesce(CAST(page_num + 1 AS VARCHAR), 'Unknown') || ', Score: '
      || CASE WHEN match_score IS NULL THEN 'N/A' ELSE '100.0%' END || ')' ELSE '❓ ' || phrase || ' (Not verified in document)' END FROM t_evidence WHERE phrase IS NOT NULL)
GROUP BY doc_id, level, text""")
def s11(spark, d):
    rows = ex.report_outline(_evidence(spark, d), _name())
    return rows.groupBy("doc_id", "level", "text").agg(F.count("*").alias("n"))


CHAT = """
SELECT h.query_id, h.doc_id, h.chunk_index, b.page_num, b.x0, b.y0, b.x1, b.y1, round(h.score + 2e-10, 6) AS match_score, 'chat_rag' AS method, substr(c.text, 1, 120) AS phrase
FROM t_hybrid h JOIN t_chunks c USING (doc_id, chunk_index) JOIN t_boxes b ON b.doc_id = h.doc_id AND b.chunk_index = h.chunk_index"""


def _chat(spark, d, lose_ids):
    chunks = tb.chunks(spark, d)
    ranked = retrieve.hybrid(tb.vector_queries(spark, d), tb.vector_chunks(spark, d), tb.K, index=tb.index(spark, d), grouped=True)
    found = fusion.attach_text(ranked, chunks, "chunk_id", "text")
    if lose_ids:
        found = onepass.each(found, lambda h: h.withField("chunk_id", F.when(h["chunk_index"] % 2 == 0, h["chunk_id"])))
    return v.chat_highlights(found, chunks)


@query("p15_chat_highlights", CHAT)
def p15(spark, d):
    return _chat(spark, d, False).select("query_id", "doc_id", "chunk_index", "page_num", "rect.*", tb.show("match_score"), "method", "phrase")


@query("j10_chunk_by_text", """
SELECT h.query_id, h.doc_id, h.chunk_index, b.page_num, b.y0 FROM (
  SELECT h.query_id, h.doc_id, h.chunk_index, CASE WHEN h.chunk_index % 2 = 0 THEN h.chunk_index ELSE f.chunk_index END AS target
  FROM t_hybrid h JOIN t_chunks c USING (doc_id, chunk_index)
  JOIN (SELECT doc_id, text, min(chunk_index) AS chunk_index FROM t_chunks GROUP BY doc_id, text) f ON f.doc_id = h.doc_id AND f.text = c.text) h
JOIN t_boxes b ON b.doc_id = h.doc_id AND b.chunk_index = h.target""")
def j10(spark, d):
    """Every second chunk id is missing; those rows find their chunk by equal text."""
    return _chat(spark, d, True).select("query_id", "doc_id", "chunk_index", "page_num", "rect.y0")


@query("p12_verify_fuzzy")
def p12_fuzzy(spark, d):
    found = _verified(spark, d, fuzzy=True)
    return found.verification
