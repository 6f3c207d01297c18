"""Model answers: envelopes, sections, contexts, facts and events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from bindings import tables as tb
from bindings.ctes import title_case
from bindings.registry import Group
from proofloom.functions import parsing as ps
from proofloom.functions import text as tx
from proofloom.operators import export as ex
from proofloom.operators import facts as fa
from proofloom.operators import fusion
from proofloom.operators import log, onepass
from proofloom.operators import sections as se
from proofloom.plans import answer as plan
from proofloom.plans import retrieve
from proofloom.session import checkpoint_root, stored

GROUP = Group()
query = GROUP.query
QUERIES, ORACLES = GROUP.queries, GROUP.oracles
K = tb.K


@query("t09_strip_fence", "SELECT doc_id, chunk_index, attempt, body FROM t_stripped")
def t09(spark, d):
    rows = tb.split_request(tb.fact_responses(spark, d))
    return rows.select("doc_id", "chunk_index", "attempt", ps.strip_fence("response").alias("body"))


@query("t10_envelope", "SELECT doc_id, chunk_index, body, coalesce(json_valid(body), false) AS valid FROM t_envelopes")
def t10(spark, d):
    rows = tb.responses(spark, d).withColumn("body", ps.json_envelope("response"))
    return rows.select("doc_id", "chunk_index", "body", F.try_parse_json("body").isNotNull().alias("valid"))


def _analyses(spark, d):
    return tb.split_request(plan.parse_analyses(tb.responses(spark, d), tb.sub_prompts(spark, d)))


def _sections(spark, d):
    return plan.assemble_sections(plan.parse_analyses(tb.responses(spark, d), tb.sub_prompts(spark, d)))


@query("p10_parse_analyses", """
SELECT doc_id, chunk_index, number, title, sub_prompt, analysis, array_to_string(phrases, ' | ') AS phrase_list, context, is_fallback FROM t_analyses""")
def p10(spark, d):
    return _analyses(spark, d).select(
        "doc_id", "chunk_index", "number", "title", "sub_prompt", "analysis", F.array_join("phrases", " | ").alias("phrase_list"), "context", "is_fallback"
    )


@query("j13_missing", "SELECT doc_id, chunk_index, number, title FROM t_missing")
def j13(spark, d):
    return _analyses(spark, d).where("is_fallback").select("doc_id", "chunk_index", "number", "title")


@query("u05_with_fallbacks", "SELECT doc_id, count(*) FILTER (is_fallback) AS n_fallback, count(*) AS n_all FROM t_analyses GROUP BY doc_id")
def u05(spark, d):
    return _analyses(spark, d).groupBy("doc_id").agg(F.count_if("is_fallback").alias("n_fallback"), F.count("*").alias("n_all"))


@query("p11_sections", "SELECT doc_id, chunk_index, section_no, section_key, analysis, context FROM t_sections")
def p11(spark, d):
    return tb.split_request(_sections(spark, d)).select("doc_id", "chunk_index", "section_no", "section_key", "analysis", "context")


@query("a23_analysis_documents", """
SELECT doc_id, chunk_index, n_sections, '{"title":"Analysis of ' || doc_id || '-' || chunk_index || '","analysis_sections":{' || body || '}}' AS document FROM (
  SELECT doc_id, chunk_index, count(*) AS n_sections, string_agg('"' || section_key || '":{"Analysis":"' || analysis || '","Supporting_Phrases":["'
    || array_to_string(phrases, '","') || '"],"Context":"' || context || '"}', ',' ORDER BY section_no) AS body FROM t_sections GROUP BY doc_id, chunk_index)""")
def a23(spark, d):
    return tb.split_request(se.analysis_documents(_sections(spark, d))).select("doc_id", "chunk_index", "n_sections", "document")


@query("f06_phrases", "SELECT doc_id, phrase FROM t_phrases EXCEPT SELECT doc_id, trim(right(text_a, 60) || ' ' || left(text_b, 60)) FROM t_neighbours")
def f06(spark, d):
    from proofloom.operators import verify as v

    crossing = tb.crossing_phrases(spark, d).select("doc_id", "phrase")
    own = v.phrases_to_verify(tb.split_request(se.section_phrases(_sections(spark, d), "request_id")))
    return own.select("doc_id", "phrase").join(crossing, ["doc_id", "phrase"], "left_anti")


@query("a16_distinct_phrases", r"""
SELECT doc_id, count(*) AS n_phrases FROM (SELECT DISTINCT doc_id, regexp_replace(unnest(phrases), '^\s+|\s+$', '', 'g') AS p FROM t_sections)
WHERE length(p) > 0 AND p <> 'No relevant phrase found.' GROUP BY doc_id""")
def a16(spark, d):
    from proofloom.operators import verify as v

    own = v.phrases_to_verify(tb.split_request(se.section_phrases(_sections(spark, d), "request_id")))
    return own.groupBy("doc_id").agg(F.count("*").alias("n_phrases"))


def _with_errors(spark, d):
    """Sections in which a fallback stands as an error section."""
    rows = tb.split_request(_sections(spark, d))
    failed = F.col("context") == se.FAILED_CONTEXT
    return rows.withColumn("section_key", F.when(failed, tx.error_key("section_no", "title")).otherwise(F.col("section_key")))


KEYED = """SELECT *, CASE WHEN context = 'Analysis Error' THEN 'error_' || section_no || '_' || lower(replace(title, ' ', '_')) ELSE section_key END AS k FROM t_sections"""


@query("f07_usable_sections", f"""
SELECT doc_id, chunk_index, bool_and(starts_with(k, 'error_')) AS all_errors, count(*) FILTER (NOT starts_with(k, 'error_')) AS n_usable
FROM ({KEYED}) GROUP BY doc_id, chunk_index""")
def f07(spark, d):
    rows = _with_errors(spark, d).withColumn("key", F.concat_ws("-", "doc_id", "chunk_index"))
    flags = se.only_errors(rows, "key")
    counts = rows.groupBy("key", "doc_id", "chunk_index").agg(F.count_if(~F.col("section_key").startswith("error_")).alias("n_usable"))
    return counts.join(flags, "key").drop("key")


@query("f08_with_sections", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM t_sections)")
def f08(spark, d):
    rows = tb.split_request(_sections(spark, d))
    return se.documents_with_sections(tb.documents(spark, d, "doc_id"), rows, "doc_id").select("doc_id")


@query("a17_analysed_sections", "SELECT doc_id, count(*) FILTER (length(trim(analysis)) > 0) AS n_analysed FROM t_sections GROUP BY doc_id")
def a17(spark, d):
    return se.analysed_sections(tb.split_request(_sections(spark, d)), "doc_id")


@query("j11_result_context", """
SELECT a.doc_id, a.chunk_index, a.number, CASE WHEN a.number IN (1, 2) THEN c.text ELSE '' END AS context_text
FROM t_analyses a JOIN t_chunks c ON c.doc_id = a.doc_id AND c.chunk_index = a.chunk_index""")
def j11(spark, d):
    contexts = tb.chunks(spark, d).select(tb.request_id(), F.col("text").alias("context_text"), F.explode(F.array(F.lit(1), F.lit(2))).alias("number"))
    return se.attach_contexts(_analyses(spark, d), contexts).select("doc_id", "chunk_index", "number", "context_text")


# Decompositions: one per benchmark passage, with weights of every sort.
DECOMPOSITION_SQL = r"""
SELECT item_id, text, '{"decomposition":[{"title":"Topic one","sub_prompt":"' || q || '","rag_params":{"bm25_weight":' || (item_id % 4) * 0.25 || ',"semantic_weight":' || (item_id % 3) * 0.5
  || ',"reasoning":"r' || item_id || '"}},{"title":"Topic two","sub_prompt":"' || q || '","rag_params":{"bm25_weight":"high","semantic_weight":0.5}},{"title":"Topic three","sub_prompt":"More"},'
  || '{"title":" ","sub_prompt":"x"},{"title":5,"sub_prompt":"y"}]' || CASE item_id % 3 WHEN 2 THEN '' ELSE '}' END AS response
FROM (SELECT *, replace(replace(replace(text, '\', ''), '"', ''), chr(10), ' ') AS q FROM benchmark)"""


def _decompositions(spark, d):
    q = F.replace(F.replace(F.replace("text", F.lit("\\"), F.lit("")), F.lit('"'), F.lit("")), F.lit("\n"), F.lit(" "))
    item = F.col("item_id")
    response = F.concat(
        F.lit('{"decomposition":[{"title":"Topic one","sub_prompt":"'), q, F.lit('","rag_params":{"bm25_weight":'), ((item % 4) * 0.25).cast("string"),
        F.lit(',"semantic_weight":'), ((item % 3) * 0.5).cast("string"), F.lit(',"reasoning":"r'), item.cast("string"),
        F.lit('"}},{"title":"Topic two","sub_prompt":"'), q,
        F.lit('","rag_params":{"bm25_weight":"high","semantic_weight":0.5}},{"title":"Topic three","sub_prompt":"More"},{"title":" ","sub_prompt":"x"},{"title":5,"sub_prompt":"y"}]'),
        F.when(item % 3 == 2, "").otherwise("}"),
    )
    return tb.table(spark, d, "benchmark").select(item.alias("request_id"), F.col("text").alias("prompt"), response.alias("response"))


WEIGHT_B, WEIGHT_S = "((item_id % 4) * 0.25)::DOUBLE", "((item_id % 3) * 0.5)::DOUBLE"


@query("p08_decomposition", f"""
SELECT item_id AS request_id, n AS number, CASE n WHEN 1 THEN 'Topic one' WHEN 2 THEN 'Topic two' ELSE 'Topic three' END AS title,
  CASE n WHEN 3 THEN 'More' ELSE replace(replace(replace(text, '\\', ''), '"', ''), chr(10), ' ') END AS sub_prompt,
  CASE WHEN n > 1 OR {WEIGHT_B} + {WEIGHT_S} = 0 THEN 0.5 WHEN abs({WEIGHT_B} + {WEIGHT_S} - 1) > 0.01 THEN round({WEIGHT_B} / ({WEIGHT_B} + {WEIGHT_S}) + 2e-10, 6) ELSE {WEIGHT_B} END AS bm25_weight,
  CASE WHEN n > 1 OR {WEIGHT_B} + {WEIGHT_S} = 0 THEN 0.5 WHEN abs({WEIGHT_B} + {WEIGHT_S} - 1) > 0.01 THEN round({WEIGHT_S} / ({WEIGHT_B} + {WEIGHT_S}) + 2e-10, 6) ELSE {WEIGHT_S} END AS semantic_weight,
  CASE n WHEN 1 THEN 'r' || item_id WHEN 2 THEN 'Default balanced weights (invalid weight values from LLM)' ELSE 'Default balanced weights (rag_params missing from LLM response)' END AS reasoning
FROM benchmark CROSS JOIN (SELECT unnest([1, 2, 3]) AS n) WHERE item_id % 3 <> 2
UNION ALL SELECT item_id, 1, 'Overall Analysis', text, 0.5, 0.5, 'Default balanced weights due to decomposition failure' FROM benchmark WHERE item_id % 3 = 2""")
def p08(spark, d):
    rows = plan.parse_decomposition(_decompositions(spark, d))
    return rows.withColumn("bm25_weight", F.round(F.col("bm25_weight") + 2e-10, 6)).withColumn("semantic_weight", F.round(F.col("semantic_weight") + 2e-10, 6))


@query("f10_valid_items", "SELECT item_id AS request_id, 3 AS n_valid FROM benchmark WHERE item_id % 3 <> 2")
def f10(spark, d):
    rows = plan.parse_decomposition(_decompositions(spark, d)).where(F.col("title") != se.OVERALL_TITLE)
    return rows.groupBy("request_id").agg(F.count("*").alias("n_valid"))


# Batch scores: the numbers of one chunk's first five sentences' lengths, as numbered lines.
@query("t15_batch_scores", """
SELECT doc_id, chunk_index, CASE WHEN chunk_index % 4 = 3 THEN NULL ELSE '0.85|' || CASE WHEN page_num = 0 THEN '0.0' ELSE '1.0' END || '|0.3' END AS score_list FROM t_chunks""")
def t15(spark, d):
    extra = F.when(F.col("chunk_index") % 4 == 3, "\n0.9").otherwise("")
    response = F.concat(F.lit("1. 0.85\n\n2) "), F.col("page_num").cast("string"), F.lit("\nScore: 0.3"), extra)
    scores = ps.batch_scores(response, F.lit(3))
    return tb.chunks(spark, d).select("doc_id", "chunk_index", F.array_join(scores.cast("array<string>"), "|").alias("score_list"))


@query("t16_rerank_response", """
SELECT doc_id, chunk_index, CASE chunk_index % 4 WHEN 0 THEN '0.5|0.0|0.25' WHEN 1 THEN '0.5|0.75|1.0' ELSE '0.0|0.0|0.0' END AS score_list FROM t_chunks""")
def t16(spark, d):
    kind = F.col("chunk_index") % 4
    response = (
        F.when(kind == 0, '{"predictions":[{"score":0.5},{"label":"x"},{"score":"0.25"}]}')
        .when(kind == 1, '{"predictions":[0.5,"0.75",1]}')
        .when(kind == 2, '{"outputs":[0.5,0.75,1]}')
        .otherwise('{"predictions":[0.5,"abc",1]}')
    )
    scores = ps.rerank_scores(response, F.lit(3))
    return tb.chunks(spark, d).select("doc_id", "chunk_index", F.array_join(scores.cast("array<string>"), "|").alias("score_list"))


# Contexts.
LINE = "'Chunk ID: chunk_' || h.chunk_index || ', Page: ' || (c.page_num + 1) || ', Score: ' || printf('%.3f', h.score + 2e-10) || chr(10) || 'TEXT: ' || c.text"


def _retrieved(spark, d):
    """Results by document, beside the texts of their chunks."""
    found = retrieve.hybrid(tb.vector_queries(spark, d), tb.vector_chunks(spark, d), K, index=tb.index(spark, d), grouped=True)
    return fusion.attach_text(found, tb.chunks(spark, d), "chunk_id", "page_num", "text")


@query("p09_contexts", f"""
SELECT q.query_id, d.doc_id, coalesce(x.context, 'No relevant text found for this sub-prompt.') AS context FROM t_queries q CROSS JOIN documents d
LEFT JOIN (SELECT h.query_id, h.doc_id, string_agg({LINE}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY h.rank) AS context
           FROM t_hybrid h JOIN t_chunks c USING (doc_id, chunk_index) GROUP BY h.query_id, h.doc_id) x ON x.query_id = q.query_id AND x.doc_id = d.doc_id""")
def p09(spark, d):
    rows = onepass.each(_retrieved(spark, d), lambda h: h.withField("score", h["score"] + 2e-10))
    return plan.build_contexts(rows, tb.queries(spark, d), tb.documents(spark, d, "doc_id"))


@query("a22_analysis_request", f"""
SELECT r.doc_id, r.query_id AS number, '--- SUB-PROMPT ' || r.query_id || ' ---' || chr(10) || 'Title: ' || q.title || chr(10) || 'Sub-prompt: ' || q.query || chr(10) || chr(10)
  || 'Relevant Document Excerpts for Sub-prompt ' || r.query_id || ':' || chr(10) || r.context || chr(10) AS block
FROM (SELECT q.query_id, d.doc_id, coalesce(x.context, 'No relevant text found for this sub-prompt.') AS context FROM t_queries q CROSS JOIN documents d
  LEFT JOIN (SELECT h.query_id, h.doc_id, string_agg({LINE}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY h.rank) AS context
    FROM t_hybrid h JOIN t_chunks c USING (doc_id, chunk_index) GROUP BY h.query_id, h.doc_id) x ON x.query_id = q.query_id AND x.doc_id = d.doc_id) r
JOIN t_queries q ON q.query_id = r.query_id""")
def a22_request(spark, d):
    asked = tb.queries(spark, d).withColumn("number", F.col("query_id"))
    return se.analysis_request(p09(spark, d), asked).select("doc_id", "number", "block")


@query("a22_chat_context", """
SELECT h.query_id, h.doc_id, h.chunk_index, 'Source: doc_' || h.doc_id || '.pdf, Page: ' || (c.page_num + 1) || chr(10) || 'Score: ' || printf('%.3f', h.score + 2e-10) || chr(10) || 'Content: ' || c.text AS line
FROM t_hybrid h JOIN t_chunks c USING (doc_id, chunk_index)""")
def a22(spark, d):
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    rows = onepass.as_rows(_retrieved(spark, d)).withColumn("score", F.col("score") + 2e-10).withColumn("filename", name)
    return se.chat_context(rows).select("query_id", "doc_id", "chunk_index", "line")


# Events.
EVENT_ITEM = """'{"chunk_id":"chunk_' || h.chunk_index || '","page_num":' || c.page_num || ',"score":' || CAST(CAST(round(h.score + 2e-10, 3) AS DECIMAL(10, 3)) AS VARCHAR) || ',"text":'
  || to_json(CASE WHEN length(c.text) > 200 THEN substr(c.text, 1, 200) || '...' ELSE c.text END) || '}'"""


@query("s08_retrieval_events", f"""
SELECT h.query_id, h.doc_id, 'bm25_results' AS type, '{{"type":"bm25_results","prompt":' || to_json(any_value(q.query)) || ',"num_results":' || count(*) || ',"results":['
  || string_agg({EVENT_ITEM}, ',' ORDER BY h.rank) || ']}}' AS event
FROM t_hybrid h JOIN t_chunks c USING (doc_id, chunk_index) JOIN t_queries q ON q.query_id = h.query_id GROUP BY h.query_id, h.doc_id""")
def s08(spark, d):
    fixed = onepass.each(_retrieved(spark, d), lambda h: h.withField("score", F.bround(h["score"] + 2e-10, 3).cast("decimal(10,3)")))
    rows = fusion.join_checked(onepass.as_pairs(fixed), tb.queries(spark, d).select("query_id", "query"), ["query_id"], ["doc_id"], max_rows=20_000)
    return plan.retrieval_events(rows, "bm25_results")


@query("p17_parameter_events", """
SELECT query_id, 'rag_parameters' AS type, '{"type":"rag_parameters","source":"decomposition","sub_prompt_title":"' || title || '","sub_prompt":'
  || to_json(CASE WHEN length(query) > 200 THEN substr(query, 1, 200) || '...' ELSE query END) || ',"bm25_weight":' || bm25_weight || ',"semantic_weight":' || semantic_weight || ',"reasoning":"set"}' AS event
FROM t_queries""")
def p17(spark, d):
    return log.parameter_events(tb.queries(spark, d).withColumn("reasoning", F.lit("set")))


@query("p17_model_events", """
SELECT conv_id || '-' || turn AS request_id, 'llm_interaction' AS type, '{"type":"llm_interaction","interaction_type":"' || role || '","messages":[{"role":"' || role || '","content":' || to_json(text) || '}],"response":'
  || to_json(text) || '}' AS event FROM conversations""")
def p17_model(spark, d):
    return log.model_events(_calls(spark, d))


def _calls(spark, d):
    return tb.table(spark, d, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"), F.col("role").alias("kind"),
        F.array(F.struct("role", F.col("text").alias("content"))).alias("messages"), F.col("text").alias("response"),
    )


RANKED = "SELECT '{}', count(*), CAST(sum(n) AS BIGINT) FROM (SELECT query_id, doc_id, count(*) AS n FROM {} GROUP BY query_id, doc_id)"


@query("p17_interaction_log", f"""
SELECT *, '2024-05-01T10:30:00.000000' AS first_at, '2024-05-01T10:30:00.000000' AS last_at FROM (
  SELECT 'rag_parameters' AS type, count(*) AS n_events, CAST(0 AS BIGINT) AS n_results FROM t_queries UNION ALL {RANKED.format('bm25_results', 't_bm25')}
  UNION ALL {RANKED.format('semantic_search_results', 't_semantic')} UNION ALL {RANKED.format('reranker_results', 't_hybrid')}
  UNION ALL {RANKED.format('llm_ranking_results', 't_hybrid')} UNION ALL SELECT 'llm_interaction', count(*), 0 FROM conversations)""")
def p17_log(spark, d):
    """All six types of one run, written twice under the same name and read back."""
    q, chunks, index = tb.vector_queries(spark, d), tb.vector_chunks(spark, d), tb.index(spark, d)

    def rows(found, method=None):
        """Pairs with their results, whose texts are looked up beside the document's chunks."""
        shown = fusion.attach_text(found, tb.chunks(spark, d), "chunk_id", "page_num", "text")
        if method:
            shown = onepass.each(shown, lambda h: h.withField("retrieval_method", F.lit(method)))
        return fusion.join_checked(onepass.as_pairs(shown), q.select("query_id", "query"), ["query_id"], ["doc_id"], max_rows=20_000)

    hybrid = retrieve.hybrid(q, chunks, K, index=index, grouped=True)
    found = {
        "bm25_results": rows(retrieve.bm25(q, index, K, grouped=True)),
        "semantic_search_results": rows(retrieve.semantic(q, chunks, K, grouped=True)),
        "reranker_results": rows(hybrid, fusion.FUSED),
        "llm_ranking_results": rows(hybrid, "llm_ranking"),
    }
    at = F.lit("2024-05-01 10:30:00").cast("timestamp")
    events = stored(plan.interaction_log(q.withColumn("reasoning", F.lit("set")), found, _calls(spark, d), at), "events")
    path = f"{checkpoint_root(spark)}/log-{uuid.uuid4().hex}"
    for _ in range(2):
        log.write_events(events, path, "run-1")
    stamp = F.get_json_object("event", "$.timestamp")
    n = F.coalesce(F.get_json_object("event", "$.num_results").cast("long"), F.lit(0))
    return log.read_events(spark, path).groupBy("type").agg(
        F.count("*").alias("n_events"), F.sum(n).alias("n_results"), F.min(stamp).alias("first_at"), F.max(stamp).alias("last_at")
    )


# Facts.
def _chosen(spark, d):
    return plan.extract_facts(tb.fact_responses(spark, d))


def _facts(spark, d):
    return tb.split_request(fa.fact_rows(_chosen(spark, d)))


@query("w12_attempt", """
SELECT c.doc_id, c.chunk_index, CAST(c.attempt AS INTEGER) AS attempt, c.clean, a.parsed FROM t_chosen c
JOIN t_attempts a ON a.doc_id = c.doc_id AND a.chunk_index = c.chunk_index AND a.attempt = c.attempt""")
def w12(spark, d):
    return tb.split_request(_chosen(spark, d)).select("doc_id", "chunk_index", "attempt", "clean", F.col("error").isNull().alias("parsed"))


@query("f09_fact_checks", "SELECT doc_id, chunk_index, CAST(attempt AS INTEGER) AS attempt, parsed, CAST(n_built AS INTEGER) AS n_built, CAST(n_lost AS INTEGER) AS n_lost FROM t_attempts")
def f09(spark, d):
    rows = tb.split_request(fa.read_attempts(tb.fact_responses(spark, d)))
    return rows.select("doc_id", "chunk_index", "attempt", "parsed", "n_built", "n_lost")


@query("p16_facts", "SELECT doc_id, chunk_index, fact_no, fact_name, fact_value, fact_type, confidence FROM t_facts")
def p16(spark, d):
    return _facts(spark, d).select("doc_id", "chunk_index", "fact_no", "fact_name", "fact_value", "fact_type", "confidence")


@query("t27_fact_types", "SELECT fact_type, count(*) AS n FROM t_facts GROUP BY fact_type")
def t27(spark, d):
    return _facts(spark, d).groupBy("fact_type").agg(F.count("*").alias("n"))


@query("t28_legacy", """
SELECT doc_id, chunk_index, fact_no, fact_name AS text, fact_type AS category, fact_value AS definition, CAST(confidence AS VARCHAR) AS confidence FROM t_facts""")
def t28(spark, d):
    rows = fa.legacy_shape(_facts(spark, d))
    return rows.select(
        "doc_id", "chunk_index", "fact_no", "text", "category", F.col("attributes")["definition"].alias("definition"), F.col("attributes")["confidence"].alias("confidence")
    )


@query("a14_first_facts", """
SELECT doc_id, fact_name, fact_value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, fact_name ORDER BY chunk_index, fact_no) AS r FROM t_facts) WHERE r = 1""")
def a14(spark, d):
    return fa.first_facts(_facts(spark, d), ["doc_id", "fact_name"], ["chunk_index", "fact_no"]).select("doc_id", "fact_name", "fact_value")


@query("a15_by_category", """
SELECT doc_id, fact_type AS category, count(*) AS n_facts, string_agg(fact_name, ',' ORDER BY chunk_index, fact_no) AS names FROM t_facts GROUP BY doc_id, fact_type""")
def a15(spark, d):
    rows = fa.by_category(_facts(spark, d).withColumn("section_no", F.col("chunk_index")))
    return rows.select("doc_id", "category", "n_facts", F.array_join(F.col("facts.fact_name"), ",").alias("names"))


@query("s07_two_columns", 'SELECT fact_name AS "Fact", fact_value AS "Definition" FROM t_facts')
def s07(spark, d):
    return fa.two_columns(_facts(spark, d))


@query("o02_preview", 'SELECT doc_id, chunk_index, fact_no, fact_name FROM t_facts ORDER BY doc_id, chunk_index, fact_no LIMIT 10')
def o02(spark, d):
    return fa.preview_facts(_facts(spark, d), ["doc_id", "chunk_index", "fact_no"]).select("doc_id", "chunk_index", "fact_no", "fact_name")


@query("m06_fact_types", """
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'amount,date' WHEN 1 THEN 'definition' ELSE 'definition' END AS types, CASE turn % 4 WHEN 0 THEN 0.75 WHEN 1 THEN 0.5 ELSE 0.3 END::DOUBLE AS confidence FROM conversations""")
def m06(spark, d):
    kind = F.col("turn") % 4
    response = (
        F.when(kind == 0, '```json\n{"expected_fact_types":["amount","date"],"confidence":0.75,"extraction_hints":["h"]}\n```')
        .when(kind == 1, '{"reasoning":"none given"}')
        .when(kind == 2, '{"expected_fact_types":["mystery"],"confidence":0.9}')
    )
    rows = tb.table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("request_id"), response.alias("response"))
    found = fa.fact_types(rows)
    ids = F.split("request_id", "-")
    return found.select(
        F.get(ids, F.lit(0)).cast("long").alias("conv_id"), F.get(ids, F.lit(1)).cast("long").alias("turn"),
        F.array_join("expected_fact_types", ",").alias("types"), "confidence",
    )


@query("m01_embedded")
def m01(spark, d):
    from proofloom.sources.responses import embed_texts

    rows = embed_texts(tb.chunks(spark, d).select("doc_id", "chunk_index", "text"), ["doc_id", "chunk_index"])
    return rows.select("doc_id", "chunk_index", F.size("embedding").alias("dim"))


@query("s05_responses", """
SELECT CAST(doc_id AS VARCHAR) AS request_id, 'answer' AS kind, 1 AS attempt,
  CASE WHEN lang = 'fr' THEN NULL WHEN lang = 'es' THEN 'second ' || length(text) ELSE 'first ' || length(text) END AS response
FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL""")
def s05(spark, d):
    """Two rounds of calls: the first fails for two languages, the second is sent what is left and fails for one."""
    from proofloom.sources import responses as rs

    docs = tb.documents(spark, d, "doc_id", "lang", "text").where("text IS NOT NULL AND lang IS NOT NULL")
    requests = docs.select(F.col("doc_id").cast("string").alias("request_id"), F.lit(1).alias("attempt"), F.concat_ws("|", "lang", "text").alias("prompt"))

    def model(name, failing):
        def complete(prompts):
            parted = [p.split("|", 1) for p in prompts]
            if any(lang in failing for lang, _ in parted):
                raise RuntimeError("no answer")
            return [f"{name} {len(text)}" for _, text in parted]

        return complete

    path = f"{checkpoint_root(spark)}/responses-{uuid.uuid4().hex}"
    rs.store_responses(rs.call_model(requests, model("first", ("fr", "es")), "answer"), path)
    left = rs.pending(requests, rs.read_responses(spark, path), "answer")
    rs.store_responses(rs.call_model(left, model("second", ("fr",)), "answer"), path)
    return rs.responses_for(requests, rs.read_responses(spark, path), "answer")
