"""Sessions, retention, snapshots, tallies and chat messages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from bindings import evidence
from bindings import tables as tb
from bindings.registry import Group
from proofloom.operators import citations as ci
from proofloom.operators import corpus as co
from proofloom.operators import export as ex
from proofloom.session import checkpoint_root

GROUP = Group()
query = GROUP.query
QUERIES, ORACLES = GROUP.queries, GROUP.oracles

SESSIONS = """
SELECT user_id, min(ts) AS session_start, max(ts) AS last_access, count(*) AS n_events FROM (
  SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 5400 SECOND THEN 0 ELSE 1 END AS n FROM events))
GROUP BY user_id, s"""


def _sessions(spark, d):
    return co.sessions(tb.table(spark, d, "events").select("user_id", "ts"))


def _text(stamp):
    return F.date_format(stamp, "yyyy-MM-dd HH:mm:ss.SSSSSS")


@query("w14_sessions", f"""
SELECT user_id, strftime(session_start, '%Y-%m-%d %H:%M:%S.%f') AS session_start, strftime(last_access, '%Y-%m-%d %H:%M:%S.%f') AS last_access, n_events
FROM ({SESSIONS})""")
def w14(spark, d):
    rows = _sessions(spark, d)
    return rows.select("user_id", _text("session_start").alias("session_start"), _text("last_access").alias("last_access"), "n_events")


@query("x01_session_window", f"SELECT user_id, strftime(session_start, '%Y-%m-%d %H:%M:%S.%f') AS session_start, n_events FROM ({SESSIONS})")
def x01(spark, d):
    """The streaming plan run in batch over the same events."""
    from proofloom.streaming.jobs import stream_sessions

    rows = stream_sessions(tb.table(spark, d, "events").select("user_id", "ts"))
    return rows.select("user_id", _text("session_start").alias("session_start"), "n_events")


@query("x01_expired", f"""
SELECT user_id, count(*) AS n_expired FROM ({SESSIONS})
WHERE (SELECT max(ts) FROM events) > last_access + INTERVAL 5400 SECOND GROUP BY user_id""")
def x01_expired(spark, d):
    events = tb.table(spark, d, "events")
    latest = F.lit(events.agg(F.max("ts")).first()[0])
    return co.expired_sessions(_sessions(spark, d), latest).groupBy("user_id").agg(F.count("*").alias("n_expired"))


@query("f14_old_artefacts", "SELECT event_id FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 86400 SECOND")
def f14(spark, d):
    events = tb.table(spark, d, "events")
    latest = F.lit(events.agg(F.max("ts")).first()[0])
    return events.where(co.is_expired("ts", latest)).select("event_id")


@query("x02_retention", """
SELECT event_type, count(*) AS n_kept FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 86400 SECOND GROUP BY event_type""")
def x02(spark, d):
    events = tb.table(spark, d, "events")
    latest = F.lit(events.agg(F.max("ts")).first()[0])
    return events.where(~co.is_expired("ts", latest)).groupBy("event_type").agg(F.count("*").alias("n_kept"))


@query("x02_retention_stream", """
SELECT event_type, count(*) AS n_kept FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 86400 SECOND GROUP BY event_type""")
def x02_stream(spark, d):
    """The events replayed as a stream into a folder, by the clock of the latest one."""
    from proofloom.streaming.jobs import retain

    events = tb.table(spark, d, "events")
    latest = F.lit(events.agg(F.max("ts")).first()[0])
    root = f"{checkpoint_root(spark)}/retained-{uuid.uuid4().hex}"
    stream = tb.stream(spark, d, "events", events.schema)
    retain(stream, f"{root}/rows", f"{root}/log", as_of=latest).awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{root}/rows").groupBy("event_type").agg(F.count("*").alias("n_kept"))


def _snapshots(spark, d):
    """Two full snapshots that differ: documents of the corpus, and documents with labels plus new ones."""
    old = tb.documents(spark, d, "doc_id").select("doc_id")
    new = tb.table(spark, d, "labels").select("doc_id").unionByName(
        tb.table(spark, d, "pages").select((-F.col("page_id") - 1).alias("doc_id"))
    )
    return old, new


NEW = "SELECT doc_id FROM labels UNION ALL SELECT -page_id - 1 FROM pages"


@query("u02_added_removed", f"""
SELECT doc_id, 'added' AS change FROM (({NEW}) EXCEPT SELECT doc_id FROM documents)
UNION ALL SELECT doc_id, 'removed' FROM (SELECT doc_id FROM documents EXCEPT ({NEW}))""")
def u02(spark, d):
    old, new = _snapshots(spark, d)
    tag = lambda rows, word: rows.withColumn("change", F.lit(word))
    return tag(co.added(old, new), "added").unionByName(tag(co.removed(old, new), "removed"))


@query("p18_corpus_diff", f"""
SELECT doc_id, 'added' AS change FROM (({NEW}) EXCEPT SELECT doc_id FROM documents)
UNION ALL SELECT doc_id, 'removed' FROM (SELECT doc_id FROM documents EXCEPT ({NEW}))""")
def p18(spark, d):
    return co.changes(*_snapshots(spark, d))


@query("u03_purge", f"SELECT doc_id, chunk_index FROM t_chunks WHERE doc_id IN ({NEW})")
def u03(spark, d):
    old, new = _snapshots(spark, d)
    return co.purge(tb.chunks(spark, d), co.removed(old, new)).select("doc_id", "chunk_index")


@query("x03_ingest", """
SELECT doc_id, CASE WHEN lang = 'fr' THEN 'removed' WHEN lang = 'en' THEN 'changed' ELSE 'unchanged' END AS action,
  sha256(coalesce(text, '') || CASE WHEN lang = 'en' THEN ' (revised)' ELSE '' END) AS content FROM documents
UNION ALL SELECT -page_id - 1, 'added', sha256(coalesce(url, '')) FROM pages""")
def x03(spark, d):
    """What the ingest of a micro-batch does: one language is revised, one withdrawn, pages are new."""
    from proofloom.streaming.jobs import ingest_plan

    docs = tb.table(spark, d, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    held = docs.select("doc_id", F.sha2("text", 256).alias("content"))
    revised = F.when(F.col("lang") == "en", F.concat("text", F.lit(" (revised)"))).otherwise(F.col("text"))
    again = docs.select("doc_id", revised.alias("text"), F.coalesce(F.col("lang") == "fr", F.lit(False)).alias("removed"))
    new = tb.table(spark, d, "pages").select((-F.col("page_id") - 1).alias("doc_id"), F.col("url").alias("text"), F.lit(False).alias("removed"))
    return ingest_plan(held, again.unionByName(new)).select("doc_id", "action", "content")


@query("o04_new_files", f"SELECT 'doc_' || lpad(CAST(-doc_id AS VARCHAR), 8, '0') AS filename FROM (({NEW}) EXCEPT SELECT doc_id FROM documents) ORDER BY 1")
def o04(spark, d):
    name = F.concat(F.lit("doc_"), F.lpad((-F.col("doc_id")).cast("string"), 8, "0"))
    return co.added(*_snapshots(spark, d)).select(name.alias("filename")).orderBy("filename")


def _results(spark, d):
    events = tb.table(spark, d, "events")
    return events.withColumn("error", F.when(F.col("event_type") == "error", F.get_json_object("props", "$.k")))


@query("a13_run_tally", """
SELECT user_id, count(*) AS n_processed, count(*) FILTER (event_type <> 'error') AS n_succeeded, count(*) FILTER (event_type = 'error') AS n_failed
FROM events GROUP BY user_id""")
def a13(spark, d):
    return ex.run_tally(_results(spark, d), "user_id")


@query("f13_success", "SELECT event_id FROM events WHERE event_type <> 'error'")
def f13(spark, d):
    return _results(spark, d).where(F.col("error").isNull()).select("event_id")


@query("o06_submission_order", "SELECT event_id, user_id FROM events ORDER BY event_id")
def o06(spark, d):
    return ex.in_submission_order(_results(spark, d), "event_id").select("event_id", "user_id")


# Chat answers: each message cites the document of its conversation and, on odd turns, a second one.
ANSWERS = """
SELECT conv_id, turn, role, text, text || ' (Source: doc_' || conv_id || '.pdf, Page: ' || (turn + 1) || ')'
  || CASE WHEN turn % 2 = 1 THEN ' More on doc_' || turn || ' is stated there (Source:  doc_' || turn || '.docx , Page: ' || (turn * 3) || ').' ELSE '' END AS answer
FROM conversations"""


def _answers(spark, d):
    turn, conv = F.col("turn").cast("string"), F.col("conv_id").cast("string")
    second = F.concat(F.lit(" More on doc_"), turn, F.lit(" is stated there (Source:  doc_"), turn, F.lit(".docx , Page: "), (F.col("turn") * 3).cast("string"), F.lit(")."))
    answer = F.concat(
        "text", F.lit(" (Source: doc_"), conv, F.lit(".pdf, Page: "), (F.col("turn") + 1).cast("string"), F.lit(")"),
        F.when(F.col("turn") % 2 == 1, second).otherwise(""),
    )
    return tb.table(spark, d, "conversations").withColumn("answer", answer)


CITED = f"""
SELECT conv_id, turn, number, regexp_extract(m, 'Source:\\s*([^,]+?)\\s*,', 1) AS filename, CAST(regexp_extract(m, 'Page:\\s*([0-9]+)', 1) AS INTEGER) AS page
FROM (SELECT conv_id, turn, unnest(l) AS m, generate_subscripts(l, 1) AS number FROM (
  SELECT conv_id, turn, regexp_extract_all(answer, '\\(Source:\\s*[^,]+?\\s*,\\s*Page:\\s*[0-9]+\\)') AS l FROM ({ANSWERS})))"""

PROCESSED = f"""
SELECT conv_id, turn, regexp_replace(array_to_string(list_transform(pieces, lambda p, i: CASE WHEN i = 1 THEN p ELSE ' [' || (i - 1) || ']' || p END), ''), '^\\s+|\\s+$', '', 'g') AS processed_text
FROM (SELECT conv_id, turn, string_split(regexp_replace(answer, '\\(Source:\\s*[^,]+?\\s*,\\s*Page:\\s*[0-9]+\\)', chr(31), 'g'), chr(31)) AS pieces FROM ({ANSWERS}))"""


@query("t18_citations", f"SELECT conv_id, turn, number, filename, page FROM ({CITED})")
def t18(spark, d):
    rows = ci.number_answers(_answers(spark, d)).select("conv_id", "turn", F.explode("citations").alias("c"))
    return rows.select("conv_id", "turn", "c.*")


@query("t18_numbered_text", PROCESSED)
def t18_text(spark, d):
    return ci.number_answers(_answers(spark, d)).select("conv_id", "turn", "processed_text")


@query("w11_citation_numbers", f"SELECT conv_id, count(*) AS n_citations, max(number) AS max_number FROM ({CITED}) GROUP BY conv_id")
def w11(spark, d):
    rows = ci.citation_rows(ci.number_answers(_answers(spark, d)), "conv_id")
    return rows.groupBy("conv_id").agg(F.count("*").alias("n_citations"), F.max("number").alias("max_number"))


SNIPPETS = f"""
SELECT conv_id, turn, number, filename, page,
  CASE WHEN length(body) > 120 THEN CASE WHEN strpos(reverse(left(body, 120)), ' ') > 0 AND 120 - strpos(reverse(left(body, 120)), ' ') > 80
         THEN left(body, 120 - strpos(reverse(left(body, 120)), ' ')) ELSE left(body, 120) END || '...'
       WHEN length(body) > 15 THEN body ELSE 'Referenced content from ' || filename || ', Page ' || page END AS snippet
FROM (SELECT *, trim(regexp_replace(regexp_replace(list_filter(s, lambda x: contains(x, '[' || number || ']'))[1], '\\[[0-9]+\\]', '', 'g'), '\\s+', ' ', 'g')) AS body
  FROM (SELECT c.*, string_split(regexp_replace(p.processed_text, '[.!?]+(\\s|$)', chr(31), 'g'), chr(31)) AS s
        FROM ({CITED}) c JOIN ({PROCESSED}) p ON p.conv_id = c.conv_id AND p.turn = c.turn))"""


@query("t19_snippets", f"SELECT conv_id, turn, number, snippet FROM ({SNIPPETS})")
def t19(spark, d):
    return ci.citation_rows(ci.number_answers(_answers(spark, d)), "conv_id", "turn").select("conv_id", "turn", "number", "snippet")


@query("j14_citation_documents", f"""
SELECT c.conv_id, c.turn, c.number, c.filename, d.n_chars AS body FROM ({CITED}) c
LEFT JOIN documents d ON c.filename = 'doc_' || d.doc_id || '.pdf'""")
def j14(spark, d):
    docs = tb.documents(spark, d, "doc_id", "n_chars").select(
        "doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"), F.col("n_chars").alias("body")
    )
    rows = ci.citation_rows(ci.number_answers(_answers(spark, d)), "conv_id", "turn")
    return ci.attach_documents(rows, docs, ["conv_id", "turn"]).select("conv_id", "turn", "number", "filename", "body")


@query("p14_citations", f"""
SELECT s.conv_id, s.turn, s.number, s.filename, s.page, s.snippet, p.processed_text
FROM ({SNIPPETS}) s JOIN ({PROCESSED}) p ON p.conv_id = s.conv_id AND p.turn = s.turn""")
def p14(spark, d):
    numbered = ci.number_answers(_answers(spark, d))
    rows = ci.citation_rows(numbered.withColumn("shown", F.col("processed_text")), "conv_id", "turn", "shown")
    return rows.withColumnRenamed("shown", "processed_text")


@query("s09_manifest", """
SELECT NULL::BIGINT AS report_id, 0 AS part, doc_id AS seq, '{"kind":"document","key":"doc_' || doc_id || '.pdf"}' AS line FROM documents
UNION ALL
SELECT conv_id, 1, turn, '{"kind":"chat","prompt":"Review","role":"' || lower(role) || '","content_preview":' || to_json(substr(text, 1, 100) || '...') || '}' FROM conversations""")
def s09(spark, d):
    docs = tb.documents(spark, d, "doc_id").select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"))
    return ex.manifest_lines(tb.table(spark, d, "conversations"), docs, F.lit("Review"))


FOLLOW_UPS = """
SELECT 'Follow-up Q&A' AS "Filename", 'Question ' || (turn + 1) AS "Section", 'Q: ' || role || chr(10) || chr(10) || 'A: ' || text AS "Analysis", 'Asked on: Unknown' AS "Context",
       'Citations: ' || (CASE WHEN turn % 2 = 1 THEN 2 ELSE 1 END) || ' found' AS "Supporting Phrase", 'N/A' AS "Verified", 'N/A' AS "Page", 'N/A' AS "Match Score"
FROM conversations"""


def _follow_ups(spark, d):
    numbered = ci.number_answers(_answers(spark, d))
    return numbered.select(
        (F.col("turn") + 1).alias("number"), F.col("role").alias("question"), F.col("text").alias("answer"),
        F.lit(None).cast("string").alias("asked_at"), F.size("citations").alias("n_citations"),
    )


@query("u04_follow_ups", FOLLOW_UPS)
def u04(spark, d):
    return ex.follow_up_rows(_follow_ups(spark, d))


@query("p13_export_with_follow_ups", f"{evidence.EXPORT} UNION ALL {FOLLOW_UPS}")
def p13_follow(spark, d):
    return ex.with_follow_ups(evidence.p13(spark, d), _follow_ups(spark, d))
