"""Sources, text expressions and simple predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import tables as tb
from bindings.ctes import norm, title_case
from bindings.registry import Group
from proofloom.functions import parsing as ps
from proofloom.functions import text as tx
from proofloom.operators import chunking as ch
from proofloom.sources import documents as src

GROUP = Group()
query = GROUP.query
QUERIES, ORACLES = GROUP.queries, GROUP.oracles

NAME_SQL = """'/in/doc_' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.DOCX' WHEN 2 THEN '.txt' ELSE '.Pdf' END"""


def _names(spark, d):
    kind = F.col("doc_id") % 4
    suffix = F.when(kind == 0, ".pdf").when(kind == 1, ".DOCX").when(kind == 2, ".txt").otherwise(".Pdf")
    path = F.concat(F.lit("/in/doc_"), F.col("doc_id").cast("string"), suffix)
    return tb.documents(spark, d, "doc_id").select("doc_id", path.alias("path"))


@query("s01_catalogue", f"""
SELECT doc_id, path, suffix, CASE WHEN suffix IN ('.pdf', '.docx') THEN 'accepted' ELSE 'error' END AS status,
       CASE WHEN suffix IN ('.pdf', '.docx') THEN '' ELSE 'Unsupported file type: ' || suffix END AS message
FROM (SELECT doc_id, path, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS suffix FROM (SELECT doc_id, {NAME_SQL} AS path FROM documents))""")
def s01(spark, d):
    return src.with_accept_status(_names(spark, d), "path")


@query("s02_blocks", "SELECT doc_id, page_num, block_no, text, x0, y0, x1, y1 FROM t_blocks")
def s02(spark, d):
    return tb.blocks(spark, d).select("doc_id", "page_num", "block_no", "text", "bbox.*")


@query("w02_offsets", "SELECT doc_id, block_no, char_start, char_end FROM t_blocks")
def w02(spark, d):
    return tb.blocks(spark, d).select("doc_id", "block_no", "char_start", "char_end")


@query("s03_lines", """
SELECT doc_id, 0 AS part, line_no, text FROM t_lines
UNION ALL
SELECT doc_id, 1, doc_id, lang || ' | ' || source || ' | ' || CAST(n_chars AS VARCHAR) FROM documents""")
def s03(spark, d):
    docs = tb.documents(spark, d, "doc_id", "text", "lang", "source", "n_chars")
    rows = docs.select("doc_id", F.col("doc_id").alias("line_no"), F.array("lang", "source", F.col("n_chars").cast("string")).alias("cells"))
    return src.stack_lines(src.document_lines(docs), src.table_row_lines(rows))


@query("u06_line_stack", """
SELECT doc_id, part, count(*) AS n_lines, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM (
  SELECT doc_id, 0 AS part, text FROM t_lines UNION ALL SELECT doc_id, 1, trim(source) FROM documents WHERE length(trim(source)) > 0)
GROUP BY doc_id, part""")
def u06(spark, d):
    docs = tb.documents(spark, d, "doc_id", "text", "source")
    rows = docs.select("doc_id", F.col("doc_id").alias("line_no"), F.array("source").alias("cells"))
    stacked = src.stack_lines(src.document_lines(docs), src.table_row_lines(rows))
    return stacked.groupBy("doc_id", "part").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))


@query("s04_wrapped", "SELECT doc_id, block_no, CAST((block_no - 1) // 49 AS INTEGER) AS page_num, raw FROM t_wrapped")
def s04(spark, d):
    lines = src.explode_rows(src.page_arrays(tb.documents(spark, d)), F.col("page_lines"), "doc_id", position="page_num", alias="lines")
    rows = src.explode_rows(lines, F.col("lines"), "doc_id", "page_num", alias="raw")
    return rows.select("doc_id", (F.col("page_num") * src.PAGE_LINES + F.col("pos") + 1).cast("long").alias("block_no"), "page_num", "raw")


@query("w13_page_lines", """
SELECT doc_id, CAST((block_no - 1) // 49 AS INTEGER) AS page_num, count(*) AS n_lines FROM t_wrapped GROUP BY 1, 2""")
def w13(spark, d):
    pages = src.explode_rows(src.page_arrays(tb.documents(spark, d)), F.col("page_lines"), "doc_id", position="page_num", alias="lines")
    return pages.select("doc_id", "page_num", F.size("lines").cast("long").alias("n_lines"))


@query("o03_block_order", """
SELECT doc_id, page_num, string_agg(CAST(block_no AS VARCHAR), ',' ORDER BY y0, x0) AS block_order FROM t_blocks GROUP BY doc_id, page_num""")
def o03(spark, d):
    raw = tb.blocks(spark, d).select("doc_id", "page_num", "block_no", "text", "bbox.*")
    return src.pages_from_blocks(raw).select(
        "doc_id", "page_num", F.array_join(F.col("blocks.line_on_page").cast("array<string>"), ",").alias("block_order")
    )


@query("a02_page_text", "SELECT doc_id, page_num, text, n_blocks FROM t_pages")
def a02(spark, d):
    return tb.pages(spark, d).select("doc_id", "page_num", "text", F.size("blocks").cast("long").alias("n_blocks"))


@query("t01_clean", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS clean FROM documents")
def t01(spark, d):
    return tb.documents(spark, d).select("doc_id", tx.clean_spaces("text").alias("clean"))


@query("t02_normalize", f"SELECT doc_id, {norm('text')} AS norm FROM documents")
def t02(spark, d):
    return tb.documents(spark, d).select("doc_id", tx.normalize("text").alias("norm"))


@query("t03_markdown", r"""
SELECT doc_id, regexp_replace(q, '^\s+|\s+$', '', 'g') AS plain FROM (
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
         regexp_replace(regexp_replace(regexp_replace(text, '\*\*(.*?)\*\*?', '\1', 'g'), '\*_(.*?)_\*?', '\1', 'g'), '`(.*?)`', '\1', 'g'),
       '(?m)^#+\s+', '', 'g'), '(?m)^>\s+', '', 'g'), '(?m)^\s*[*\-+]\s+', '', 'g'), '(?m)^\s*\d+\.\s+', '', 'g'), '[''"]', ' ', 'g') AS q
FROM documents)""")
def t03(spark, d):
    return tb.documents(spark, d).select("doc_id", tx.strip_markdown("text").alias("plain"))


@query("t04_drop_quotes", """SELECT doc_id, regexp_replace(text, '[''"]', '', 'g') AS bare FROM documents""")
def t04(spark, d):
    return tb.documents(spark, d).select("doc_id", tx.drop_quotes("text").alias("bare"))


@query("t05_tokens", f"""
SELECT doc_id, len(w) AS n_tokens, array_to_string(list_sort(list_distinct(w)), ' ') AS vocabulary
FROM (SELECT doc_id, list_filter(string_split({norm('text')}, ' '), lambda x: x <> '') AS w FROM documents)""")
def t05(spark, d):
    tokens = tb.documents(spark, d).select("doc_id", tx.words("text").alias("w"))
    return tokens.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.array_join(F.array_sort(F.array_distinct("w")), " ").alias("vocabulary"))


@query("t06_sentences", "SELECT doc_id, page_num, CAST(sent_no AS INTEGER) AS sent_no, text, char_start, char_end FROM t_sentences")
def t06(spark, d):
    return ch.page_sentences(tb.pages(spark, d))


TRUNCATED = """CASE WHEN length(text) <= {n} THEN text
  WHEN strpos(reverse(left(text, {n})), '.') > 0 AND {n} - strpos(reverse(left(text, {n})), '.') > {n} * {r}
    THEN left(text, {n} - strpos(reverse(left(text, {n})), '.') + 1)
  WHEN strpos(reverse(left(text, {n})), ' ') > 0 AND {n} - strpos(reverse(left(text, {n})), ' ') > 0
    THEN left(text, {n} - strpos(reverse(left(text, {n})), ' '))
  ELSE left(text, {n}) END"""


@query("t07_truncate", f"SELECT doc_id, {TRUNCATED.format(n=1500, r=0.8)} AS cut_pair, {TRUNCATED.format(n=300, r=0.7)} AS cut_doc FROM documents")
def t07(spark, d):
    return tb.documents(spark, d).select(
        "doc_id", tx.truncate_at_boundary("text", 1500, 0.8).alias("cut_pair"), tx.truncate_at_boundary("text", 300, 0.7).alias("cut_doc")
    )


@query("t08_token_budget", """
SELECT doc_id, array_to_string(list_slice(q, 1, 500), ' ') AS query, array_to_string(list_slice(t, 1, greatest(501 - least(len(q), 500), 1)), ' ') AS document
FROM (SELECT doc_id, list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS t,
             list_filter(string_split(trim(regexp_replace(reverse(text), '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS q FROM documents)""")
def t08(spark, d):
    return tb.documents(spark, d).select("doc_id", tx.fit_token_budget(F.reverse("text"), "text").alias("p")).select("doc_id", "p.*")


TITLE_SQL = "upper(substr(lang, 1, 1)) || substr(lang, 2) || ' Part ' || source"


@query("t11_section_key", f"SELECT doc_id, 'section_' || (doc_id % 7 + 1) || '_' || lower(replace({TITLE_SQL}, ' ', '_')) AS section_key FROM documents")
def t11(spark, d):
    docs = tb.documents(spark, d, "doc_id", "lang", "source")
    title = F.concat(F.initcap("lang"), F.lit(" Part "), F.col("source"))
    return docs.select("doc_id", tx.section_key(F.col("doc_id") % 7 + 1, title).alias("section_key"))


@query("t12_section_title", f"""
SELECT doc_id, {title_case("replace(regexp_replace(k, '^section_[0-9]+_', ''), '_', ' ')")} AS shown, {title_case("replace(k, '_', ' ')")} AS exported
FROM (SELECT doc_id, 'section_' || (doc_id % 7 + 1) || '_' || lower(replace({TITLE_SQL}, ' ', '_')) AS k FROM documents)""")
def t12(spark, d):
    keys = t11(spark, d)
    return keys.select("doc_id", tx.section_title("section_key").alias("shown"), tx.section_title("section_key", True).alias("exported"))


@query("t13_preview", """
SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS log_preview, substr(text, 1, 100) || '...' AS chat_preview
FROM documents""")
def t13(spark, d):
    return tb.documents(spark, d).select("doc_id", tx.preview("text").alias("log_preview"), tx.preview("text", 100, always=True).alias("chat_preview"))


@query("t14_pair_score", """
SELECT event_id, CASE WHEN event_type = 'view' THEN 0.5 ELSE greatest(0, least(1, value / 20)) END AS score FROM events""")
def t14(spark, d):
    events = tb.table(spark, d, "events").select("event_id", "event_type", "value")
    raw = F.when(F.col("event_type") == "view", F.lit("not a number")).otherwise((F.col("value") / 20).cast("string"))
    return events.select("event_id", ps.pair_score(raw).alias("score"))


@query("t17_weights", """
SELECT event_id, CASE WHEN bad OR (abs(b + s - 1) > 0.01 AND b + s <= 0) THEN 0.5 WHEN abs(b + s - 1) > 0.01 THEN round(b / (b + s) + 2e-10, 6) ELSE b END AS bm25_weight,
       CASE WHEN bad OR (abs(b + s - 1) > 0.01 AND b + s <= 0) THEN 0.5 WHEN abs(b + s - 1) > 0.01 THEN round(s / (b + s) + 2e-10, 6) ELSE s END AS semantic_weight
FROM (SELECT *, b IS NULL OR s IS NULL OR b < 0 OR b > 1 OR s < 0 OR s > 1 AS bad FROM (
  SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE round(value / 25, 3) END AS b, round((event_id % 10) / 10.0::DOUBLE, 3) AS s FROM events))""")
def t17(spark, d):
    events = tb.table(spark, d, "events").select("event_id", "event_type", "value")
    b = F.when(F.col("event_type") == "error", F.lit("high")).otherwise(F.round(F.col("value") / 25, 3).cast("string"))
    s = F.round((F.col("event_id") % 10) / 10, 3).cast("string")
    w = ps.valid_weights(b, s)
    return events.select("event_id", F.round(w["bm25_weight"] + 2e-10, 6).alias("bm25_weight"), F.round(w["semantic_weight"] + 2e-10, 6).alias("semantic_weight"))


@query("t20_labels", """
SELECT event_id, 'Page ' || (event_id % 5 + 1) AS page, CASE WHEN value IS NULL OR value = 0 THEN 'N/A' ELSE printf('%.1f', value) END AS score,
       CASE WHEN value IS NULL OR value = 0 THEN 'N/A' ELSE printf('%.1f%%', value) END AS share
FROM (SELECT event_id, CAST(floor(value) AS DOUBLE) AS value FROM events)""")
def t20(spark, d):
    whole = F.floor("value").cast("double")
    return tb.table(spark, d, "events").select(
        "event_id", tx.page_label(F.col("event_id") % 5).alias("page"), tx.score_label(whole).alias("score"), tx.score_label(whole, percent=True).alias("share")
    )


@query("t21_sizes", """
SELECT doc_id, CASE WHEN s < 1024 THEN printf('%.2f B', s) WHEN s < 1048576 THEN printf('%.2f KB', s / 1024) WHEN s < 1073741824 THEN printf('%.2f MB', s / 1048576)
  WHEN s < 1099511627776 THEN printf('%.2f GB', s / 1073741824) ELSE printf('%.2f TB', s / 1099511627776) END AS size_text
FROM (SELECT doc_id, (n_chars * CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 1000000 END)::DOUBLE AS s FROM documents)""")
def t21(spark, d):
    factor = F.when(F.col("doc_id") % 3 == 0, 1).when(F.col("doc_id") % 3 == 1, 1000).otherwise(1000000)
    return tb.documents(spark, d, "doc_id", "n_chars").select("doc_id", tx.size_label(F.col("n_chars") * factor).alias("size_text"))


@query("t22_roles", """
SELECT conv_id, turn, CASE WHEN lower(r) IN ('system', 'user', 'assistant') THEN lower(r) ELSE 'user' END AS role
FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN upper(role) WHEN 1 THEN role ELSE role || '_tool' END AS r FROM conversations)""")
def t22(spark, d):
    kind = F.col("turn") % 3
    raw = F.when(kind == 0, F.upper("role")).when(kind == 1, F.col("role")).otherwise(F.concat("role", F.lit("_tool")))
    return tb.table(spark, d, "conversations").select("conv_id", "turn", tx.chat_role(raw).alias("role"))


@query("t23_base64", "SELECT doc_id, base64(encode(text)) AS body, text FROM documents")
def t23(spark, d):
    body = F.replace(F.replace(F.base64(F.encode("text", "UTF-8")), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(""))
    rows = tb.documents(spark, d).select("doc_id", body.alias("body"))
    return rows.withColumn("text", F.decode(F.unbase64("body"), "UTF-8"))


@query("t24_context_lines", """
SELECT doc_id, chunk_index, 'Chunk ID: chunk_' || chunk_index || ', Page: ' || (page_num + 1) || ', Score: ' || printf('%.3f', s) || chr(10) || 'TEXT: ' || text AS analysis_line,
       'Source: doc_' || doc_id || '.pdf, Page: ' || (page_num + 1) || chr(10) || 'Score: ' || printf('%.3f', s) || chr(10) || 'Content: ' || text AS chat_line
FROM (SELECT *, (chunk_index % 8) / 8.0::DOUBLE AS s FROM t_chunks)""")
def t24(spark, d):
    rows = tb.chunks(spark, d).withColumn("s", (F.col("chunk_index") % 8) / 8)
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return rows.select(
        "doc_id", "chunk_index", tx.analysis_line("chunk_id", "page_num", "s", "text").alias("analysis_line"), tx.chat_line(name, "page_num", "s", "text").alias("chat_line")
    )


@query("t25_names", f"""
SELECT doc_id, replace(replace(p, '.pdf', ''), '.docx', '') AS stem, replace(replace(p, '.pdf', ''), '.docx', '') || '_annotated.pdf' AS annotated
FROM (SELECT doc_id, lower({NAME_SQL}) AS p FROM documents)""")
def t25(spark, d):
    names = _names(spark, d).withColumn("path", F.lower("path"))
    return names.select("doc_id", tx.file_stem("path").alias("stem"), tx.annotated_name("path").alias("annotated"))


@query("t26_status", """
SELECT d.doc_id, coalesce(c.n, 0) AS n_chunks, CASE WHEN c.n IS NULL THEN 'warning' ELSE 'success' END AS status,
       CASE WHEN c.n IS NULL THEN 'No text chunks could be extracted' ELSE 'Preprocessed ' || c.n || ' chunks' END AS message
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM t_chunks GROUP BY doc_id) c ON c.doc_id = d.doc_id""")
def t26(spark, d):
    return ch.ingest_report(tb.documents(spark, d, "doc_id"), tb.chunks(spark, d))


@query("f01_blank_lines", r"""
SELECT doc_id, count(*) FILTER (length(regexp_replace(l, '^\s+|\s+$', '', 'g')) > 0) AS n_filled, count(*) AS n_all
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY doc_id""")
def f01(spark, d):
    lines = tb.documents(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    return lines.groupBy("doc_id").agg(F.count_if(tx.is_filled("l")).alias("n_filled"), F.count("*").alias("n_all"))


@query("f02_short_groups", f"""
SELECT doc_id, page_num, count(*) AS n_groups, count(*) FILTER (length({norm('text')}) >= 50) AS n_kept FROM t_groups GROUP BY doc_id, page_num""")
def f02(spark, d):
    groups = tb.pages(spark, d).select("doc_id", "page_num", ch.sentence_groups(tx.sentence_array("text")).alias("g"))
    kept = F.filter("g", lambda g: ch.long_enough(g["text"]))
    return groups.select("doc_id", "page_num", F.size("g").cast("long").alias("n_groups"), F.size(kept).cast("long").alias("n_kept"))
