"""Shared SQL steps. ``sql(body)`` prefixes the steps that ``body`` names, in dependency order."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def cte(name: str, text: str) -> None:
    CTES[name] = text.strip()


def sql(body: str) -> str:
    done: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in done and re.search(rf"\b{name}\b", text):
                visit(CTES[name])
                if name not in done:
                    done.append(name)

    visit(body)
    if not done:
        return body.strip()
    steps = ",\n".join(f"{n} AS MATERIALIZED (\n{CTES[n]}\n)" for n in done)
    return f"WITH {steps}\n{body.strip()}"


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '\\s+', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(string_split({norm(x)}, ' '), lambda w: w <> '')"


def show(x: str) -> str:
    """Six decimals, nudged off the tie so that both engines round alike."""
    return f"round({x} + 2e-10, 6)"


def token_set(x: str) -> str:
    return (
        "list_distinct(list_filter(string_split(regexp_replace(lower(regexp_replace("
        f"{x}, '[\\x{{80}}-\\x{{ff}}]', '', 'g')), '[^\\pL\\pN_]', ' ', 'g'), ' '), lambda w: w <> ''))"
    )


def title_case(x: str) -> str:
    return (
        f"array_to_string(list_transform(string_split({x}, ' '), "
        "lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')"
    )


cte("t_lines", r"""
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS line_no, line AS text
FROM (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS ord,
         regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS line
  FROM documents)
WHERE length(line) > 0""")

cte("t_wrapped", """
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, pos) AS block_no,
       substr(text, pos + 1, 82) AS raw
FROM (SELECT doc_id, line_no, text, unnest(range(0, length(text), 82)) AS pos FROM t_lines)""")

cte("t_placed", r"""
SELECT doc_id, block_no, CAST((block_no - 1) // 49 AS INTEGER) AS page_num,
       trim(regexp_replace(raw, '\s+', ' ', 'g')) AS text,
       50.0::DOUBLE AS x0, (50 + 15 * ((block_no - 1) % 49))::DOUBLE AS y0,
       (50 + 6 * length(raw))::DOUBLE AS x1, (65 + 15 * ((block_no - 1) % 49))::DOUBLE AS y1
FROM t_wrapped""")

cte("t_blocks", """
SELECT *, CAST(s AS INTEGER) AS char_start, CAST(s + length(text) AS INTEGER) AS char_end
FROM (
  SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, page_num ORDER BY block_no
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
  FROM t_placed WHERE length(text) > 0)""")

cte("t_pages", """
SELECT doc_id, page_num, string_agg(text, ' ' ORDER BY block_no) AS text, count(*) AS n_blocks
FROM t_blocks GROUP BY doc_id, page_num""")

cte("t_split", r"""
SELECT doc_id, page_num, string_split(regexp_replace(text, '([.!?]+) ', '\1' || chr(30), 'g'), chr(30)) AS s
FROM t_pages""")

cte("t_sentences", """
SELECT *, CAST(b AS INTEGER) AS char_start, CAST(b + length(text) AS INTEGER) AS char_end
FROM (
  SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, page_num ORDER BY sent_no
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
  FROM (SELECT doc_id, page_num, generate_subscripts(s, 1) AS sent_no, unnest(s) AS text FROM t_split))
WHERE length(text) > 0""")

cte("t_groups", """
SELECT doc_id, page_num, (sent_no - 1) // 6 AS g, string_agg(text, ' ' ORDER BY sent_no) AS text,
       min(char_start) AS char_start, max(char_end) AS char_end
FROM t_sentences GROUP BY doc_id, page_num, (sent_no - 1) // 6""")

cte("t_chunks", f"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_num, g) - 1 AS INTEGER) AS chunk_index,
       page_num, text, char_start, char_end
FROM t_groups WHERE length({norm('text')}) >= 50""")

cte("t_overlaps", """
SELECT c.doc_id, c.chunk_index, c.page_num, b.block_no, b.x0, b.y0, b.x1, b.y1,
       least(c.char_end, b.char_end) - greatest(c.char_start, b.char_start) AS overlap,
       b.char_end - b.char_start AS block_length
FROM t_chunks c JOIN t_blocks b ON c.doc_id = b.doc_id AND c.page_num = b.page_num
WHERE least(c.char_end, b.char_end) > greatest(c.char_start, b.char_start)""")

cte("t_best_blocks", """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY overlap DESC, block_no) AS rank
  FROM t_overlaps WHERE overlap > 0.05 * block_length) WHERE rank <= 5""")

cte("t_boxes", """
SELECT doc_id, chunk_index, page_num, count(*) AS n_boxes, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
FROM t_best_blocks GROUP BY doc_id, chunk_index, page_num""")

cte("t_queries", """
SELECT item_id AS query_id, text AS query, 'Passage ' || item_id AS title,
       CASE WHEN item_id % 2 = 1 THEN 0.7 ELSE 0.5 END::DOUBLE AS bm25_weight,
       CASE WHEN item_id % 2 = 1 THEN 0.3 ELSE 0.5 END::DOUBLE AS semantic_weight
FROM benchmark""")

cte("t_tokens", f"""
SELECT doc_id, chunk_index, {words('text')} AS tokens FROM t_chunks""")

cte("t_tf", """
SELECT doc_id, chunk_index, term, count(*) AS tf, any_value(n_tokens) AS n_tokens
FROM (SELECT doc_id, chunk_index, unnest(tokens) AS term, len(tokens) AS n_tokens FROM t_tokens)
GROUP BY doc_id, chunk_index, term""")

cte("t_df", "SELECT doc_id, term, count(*) AS df FROM t_tf GROUP BY doc_id, term")

cte("t_sizes", """
SELECT doc_id, count(*) AS n_chunks, sum(len(tokens))::DOUBLE / count(*) AS avg_tokens FROM t_tokens GROUP BY doc_id""")

cte("t_raw_idf", """
SELECT doc_id, term, df, n_chunks, ln(n_chunks - df + 0.5) - ln(df + 0.5) AS raw FROM t_df JOIN t_sizes USING (doc_id)""")

cte("t_mean_idf", "SELECT doc_id, avg(raw) AS mean_idf FROM t_raw_idf GROUP BY doc_id")

cte("t_idf", """
SELECT doc_id, term, df, CASE WHEN raw < 0 THEN 0.25 * mean_idf ELSE raw END AS idf
FROM t_raw_idf JOIN t_mean_idf USING (doc_id)""")

cte("t_query_terms", f"""
SELECT query_id, term, count(*) AS qtf
FROM (SELECT query_id, unnest({words('query')}) AS term FROM t_queries) GROUP BY query_id, term""")

cte("t_hit_scores", """
SELECT q.query_id, t.doc_id, t.chunk_index,
       round(sum(q.qtf * i.idf * t.tf * 2.5 / (t.tf + 1.5 * (0.25 + 0.75 * t.n_tokens / z.avg_tokens))), 9) AS score
FROM t_query_terms q JOIN t_tf t USING (term) JOIN t_idf i ON i.doc_id = t.doc_id AND i.term = t.term
JOIN t_sizes z ON z.doc_id = t.doc_id
GROUP BY q.query_id, t.doc_id, t.chunk_index""")

cte("t_bm25_all", """
SELECT q.query_id, c.doc_id, c.chunk_index, coalesce(h.score, 0.0) AS score
FROM t_queries q CROSS JOIN t_chunks c LEFT JOIN t_hit_scores h
  ON h.query_id = q.query_id AND h.doc_id = c.doc_id AND h.chunk_index = c.chunk_index""")

cte("t_bm25", """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_index) AS rank
  FROM t_bm25_all) WHERE rank <= 5""")

cte("t_vectors", """
SELECT c.doc_id, c.chunk_index, e.embedding
FROM t_chunks c JOIN embeddings e ON e.vec_id = (c.doc_id * 7 + c.chunk_index) % (SELECT count(*) FROM embeddings)""")

cte("t_cosines", """
SELECT q.query_id, v.doc_id, v.chunk_index,
       round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS score
FROM t_queries q JOIN embeddings e ON e.vec_id = q.query_id CROSS JOIN t_vectors v""")

cte("t_semantic", """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_index) AS rank
  FROM t_cosines) WHERE rank <= 5""")

cte("t_bm25_norm", """
SELECT *, coalesce(score / nullif(max(score) OVER (PARTITION BY query_id, doc_id), 0), 0) AS bm25_norm FROM t_bm25""")

cte("t_candidates", """
SELECT coalesce(b.query_id, s.query_id) AS query_id, coalesce(b.doc_id, s.doc_id) AS doc_id,
       coalesce(b.chunk_index, s.chunk_index) AS chunk_index, b.bm25_norm, s.score AS cosine
FROM t_bm25_norm b FULL JOIN t_semantic s
  ON b.query_id = s.query_id AND b.doc_id = s.doc_id AND b.chunk_index = s.chunk_index""")

cte("t_fused", """
SELECT *, round(coalesce(bm25_norm, 0) * bm25_weight + coalesce(cosine, 0) * semantic_weight, 9) AS score
FROM t_candidates JOIN t_queries USING (query_id)""")

cte("t_hybrid", """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_index) AS rank
  FROM t_fused) WHERE rank <= 5""")


# Model output built from chunks. ``first`` and ``last`` are the chunk's first and last sentence.
cte("t_parts", r"""
SELECT doc_id, chunk_index, page_num, text, s[1] AS first, s[len(s)] AS last, array_to_string(list_reverse(string_split(s[1], ' ')), ' ') AS turned
FROM (SELECT *, string_split(regexp_replace(replace(replace(text, '\', ''), '"', ''), '([.!?]+) ', '\1' || chr(30), 'g'), chr(30)) AS s FROM t_chunks)""")

cte("t_sub_prompts", """
SELECT doc_id, chunk_index, number, CASE number WHEN 1 THEN 'Main point' ELSE 'Evidence check' END AS title,
       CASE number WHEN 1 THEN 'What is said' ELSE 'What proves it' END AS sub_prompt
FROM t_chunks CROSS JOIN (SELECT unnest([1, 2]) AS number)""")

cte("t_answers", r"""
SELECT doc_id, chunk_index, page_num, first, last, turned, (doc_id + chunk_index) % 5 AS kind,
  '{"analyses":[{"sub_prompt_index":1,"sub_prompt_title":"Main point","sub_prompt_analyzed":"What is said","analysis_summary":"' || first
  || '","supporting_quotes":["' || first || '","' || turned || '"],"analysis_context":"chunk ' || chunk_index || '"}' AS head,
  ',{"sub_prompt_index":2,"analysis_summary":"' || last || '","supporting_quotes":["**' || last || '**","zzqx vvkw jjpf"],"analysis_context":""}' AS second,
  ',{"analysis_summary":"' || last || '","supporting_quotes":"' || last || '"},{"sub_prompt_index":7,"sub_prompt_title":"Extra","analysis_summary":"more"}' AS loose
FROM t_parts""")

cte("t_responses", r"""
SELECT doc_id, chunk_index, kind, CASE kind
    WHEN 0 THEN head || second || ']}'
    WHEN 1 THEN '```json' || chr(10) || head || second || ']}' || chr(10) || '```'
    WHEN 2 THEN 'Here is the result: ' || head || ']} I hope it helps.'
    WHEN 3 THEN left(head, length(head) - 20)
    ELSE head || loose || ']}' END AS response
FROM t_answers""")

cte("t_envelopes", r"""
SELECT *, CASE WHEN regexp_matches(response, '(?s)```json\s*(\{.*?\})\s*```') THEN regexp_extract(response, '(?s)```json\s*(\{.*?\})\s*```', 1)
    WHEN starts_with(response, '{') AND ends_with(response, '}') THEN response
    WHEN strpos(response, '{') > 0 AND strpos(response, '}') > 0 AND length(response) - strpos(reverse(response), '}') + 1 > strpos(response, '{')
      THEN substr(response, strpos(response, '{'), length(response) - strpos(reverse(response), '}') + 2 - strpos(response, '{')) END AS body
FROM t_responses""")

cte("t_read", """
SELECT doc_id, chunk_index, pos AS position, coalesce(CAST(json_extract_string(a, '$.sub_prompt_index') AS INTEGER), pos) AS number,
       json_extract_string(a, '$.sub_prompt_title') AS m_title, json_extract_string(a, '$.sub_prompt_analyzed') AS m_prompt,
       coalesce(json_extract_string(a, '$.analysis_summary'), 'No analysis provided') AS analysis,
       CASE WHEN json_extract(a, '$.supporting_quotes') IS NULL THEN ['No relevant phrase found.']
            WHEN json_type(a, '$.supporting_quotes') = 'ARRAY' THEN json_extract_string(a, '$.supporting_quotes[*]')
            ELSE [json_extract_string(a, '$.supporting_quotes')] END AS phrases,
       coalesce(json_extract_string(a, '$.analysis_context'), '') AS context
FROM (SELECT doc_id, chunk_index, unnest(l) AS a, generate_subscripts(l, 1) AS pos FROM (
  SELECT doc_id, chunk_index, json_extract(CASE WHEN json_valid(body) THEN body END, '$.analyses[*]') AS l FROM t_envelopes WHERE json_valid(body)))""")

cte("t_missing", """
SELECT s.doc_id, s.chunk_index, s.number, s.number AS position, s.title, s.sub_prompt, 'An error occurred while analyzing this sub-prompt.' AS analysis,
       ['No relevant phrase found.'] AS phrases, 'Analysis Error' AS context, true AS is_fallback
FROM t_sub_prompts s LEFT JOIN t_read r ON r.doc_id = s.doc_id AND r.chunk_index = s.chunk_index AND r.number = s.number WHERE r.doc_id IS NULL""")

cte("t_analyses", """
SELECT r.doc_id, r.chunk_index, r.number, r.position, coalesce(r.m_title, s.title, 'Unknown title') AS title,
       coalesce(r.m_prompt, s.sub_prompt, 'Unknown sub-prompt') AS sub_prompt, r.analysis, r.phrases, r.context, false AS is_fallback
FROM t_read r LEFT JOIN t_sub_prompts s ON s.doc_id = r.doc_id AND s.chunk_index = r.chunk_index AND s.number = r.number
UNION ALL SELECT * FROM t_missing""")

cte("t_sections", """
SELECT *, 'section_' || section_no || '_' || lower(replace(title, ' ', '_')) AS section_key FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY number, position, is_fallback) AS section_no FROM t_analyses)""")

cte("t_phrases", r"""
SELECT DISTINCT doc_id, phrase FROM (
  SELECT doc_id, regexp_replace(unnest(phrases), '^\s+|\s+$', '', 'g') AS phrase FROM t_sections
  UNION ALL SELECT doc_id, trim(right(text_a, 60) || ' ' || left(text_b, 60)) FROM t_neighbours)
WHERE length(phrase) > 0 AND phrase <> 'No relevant phrase found.'""")

cte("t_forms", r"""
SELECT doc_id, phrase, trim(regexp_replace(lower(q), '\s+', ' ', 'g')) AS norm_phrase, trim(regexp_replace(q, '\s+', ' ', 'g')) AS search_phrase FROM (
SELECT doc_id, phrase, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
         regexp_replace(regexp_replace(regexp_replace(phrase, '\*\*(.*?)\*\*?', '\1', 'g'), '\*_(.*?)_\*?', '\1', 'g'), '`(.*?)`', '\1', 'g'),
       '(?m)^#+\s+', '', 'g'), '(?m)^>\s+', '', 'g'), '(?m)^\s*[*\-+]\s+', '', 'g'), '(?m)^\s*\d+\.\s+', '', 'g'), '[''"]', ' ', 'g') AS q
FROM t_phrases)""")

cte("t_norm_chunks", f"""
SELECT doc_id, chunk_index, page_num, text, {norm('text')} AS norm_text, {token_set(norm('text'))} AS words FROM t_chunks""")

cte("t_norm_phrases", f"""
SELECT *, {token_set('norm_phrase')} AS words FROM t_forms WHERE length(norm_phrase) > 0""")

cte("t_single", """
SELECT p.doc_id, p.phrase, p.search_phrase, c.chunk_index, c.page_num, c.text FROM t_norm_phrases p JOIN t_norm_chunks c ON c.doc_id = p.doc_id
WHERE contains(c.norm_text, p.norm_phrase) OR (len(p.words) > 0 AND list_has_all(c.words, p.words))""")

cte("t_neighbours", """
SELECT a.doc_id, a.chunk_index, a.text AS text_a, b.text AS text_b
FROM t_chunks a JOIN t_chunks b ON b.doc_id = a.doc_id AND b.chunk_index = a.chunk_index + 1 WHERE b.page_num = a.page_num + 1""")

cte("t_pairs", f"""
SELECT *, {norm('text')} AS norm_text, {token_set(norm('text'))} AS words
FROM (SELECT doc_id, chunk_index, text_a || ' ' || text_b AS text FROM t_neighbours)""")

cte("t_crossed", """
SELECT p.doc_id, p.phrase, min(c.chunk_index) AS chunk_index FROM t_norm_phrases p JOIN t_pairs c ON c.doc_id = p.doc_id
WHERE (contains(c.norm_text, p.norm_phrase) OR (len(p.words) > 0 AND list_has_all(c.words, p.words)))
  AND NOT EXISTS (SELECT 1 FROM t_single s WHERE s.doc_id = p.doc_id AND s.phrase = p.phrase)
GROUP BY p.doc_id, p.phrase""")

cte("t_verified", """
SELECT f.doc_id, f.phrase, m.phrase IS NOT NULL AS verified FROM t_phrases f
LEFT JOIN (SELECT doc_id, phrase FROM t_single UNION SELECT doc_id, phrase FROM t_crossed) m ON m.doc_id = f.doc_id AND m.phrase = f.phrase""")

cte("t_found_text", """
SELECT s.doc_id, s.phrase, s.chunk_index, s.page_num, b.n_boxes, b.x0, b.y0, b.x1, b.y1, length(s.search_phrase) AS n,
       string_split(lower(s.text), lower(s.search_phrase)) AS pieces
FROM t_single s JOIN t_boxes b ON b.doc_id = s.doc_id AND b.chunk_index = s.chunk_index""")

cte("t_occurrences", """
SELECT doc_id, phrase, chunk_index, page_num, x0, y0, x1, y1, n,
       CAST(list_sum(list_transform(pieces[1:i], lambda p: length(p))) + (i - 1) * n AS INTEGER) AS offset_at
FROM (SELECT *, unnest(range(1, len(pieces))) AS i FROM t_found_text)""")

cte("t_exact_places", """
SELECT o.doc_id, o.phrase, o.chunk_index, o.page_num, b.x0, b.y0, b.x1, b.y1, 'exact_cleaned_search' AS method, o.offset_at
FROM t_occurrences o JOIN t_chunks c ON c.doc_id = o.doc_id AND c.chunk_index = o.chunk_index
JOIN t_blocks b ON b.doc_id = c.doc_id AND b.page_num = c.page_num
  AND b.char_end > c.char_start + o.offset_at AND b.char_start < c.char_start + o.offset_at + o.n
WHERE b.x0 < o.x1 AND o.x0 < b.x1 AND b.y0 < o.y1 AND o.y0 < b.y1""")

cte("t_inexact", """
SELECT * FROM t_found_text f WHERE NOT EXISTS (
  SELECT 1 FROM t_exact_places e WHERE e.doc_id = f.doc_id AND e.phrase = f.phrase AND e.chunk_index = f.chunk_index)""")

cte("t_box_places", """
SELECT f.doc_id, f.phrase, f.chunk_index, f.page_num, b.x0, b.y0, b.x1, b.y1, 'fuzzy_chunk_fallback_individual' AS method, CAST(b.rank - 1 AS INTEGER) AS offset_at
FROM t_inexact f JOIN t_best_blocks b ON b.doc_id = f.doc_id AND b.chunk_index = f.chunk_index WHERE f.n_boxes <= 3
UNION ALL
SELECT doc_id, phrase, chunk_index, page_num, x0, y0, x1, y1, 'fuzzy_chunk_fallback', 0 FROM t_inexact WHERE n_boxes > 3""")

cte("t_crossed_places", """
SELECT c.doc_id, c.phrase, b.chunk_index, b.page_num, b.x0, b.y0, b.x1, b.y1, 'cross_page_fuzzy_match_part' || (b.chunk_index - c.chunk_index + 1) AS method, 0 AS offset_at
FROM t_crossed c JOIN t_boxes b ON b.doc_id = c.doc_id AND b.chunk_index IN (c.chunk_index, c.chunk_index + 1)""")

cte("t_places", """
SELECT * FROM t_exact_places UNION ALL SELECT * FROM t_box_places UNION ALL SELECT * FROM t_crossed_places""")

cte("t_best_place", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, phrase ORDER BY chunk_index, method, offset_at, y0, x0) AS r FROM t_places) WHERE r = 1""")

cte("t_evidence", """
SELECT s.doc_id, s.chunk_index, s.section_no, s.section_key, s.analysis, s.context, s.phrase_no, s.phrase, coalesce(v.verified, false) AS verified, b.page_num,
       CASE WHEN b.doc_id IS NULL THEN NULL ELSE 100 END AS match_score
FROM (SELECT doc_id, chunk_index, section_no, section_key, analysis, context, unnest(p) AS phrase, generate_subscripts(p, 1) - 1 AS phrase_no
      FROM (SELECT *, CASE WHEN len(phrases) = 0 OR phrases = ['No relevant phrase found.'] THEN [NULL] ELSE phrases END AS p FROM t_sections)) s
LEFT JOIN t_verified v ON v.doc_id = s.doc_id AND v.phrase = trim(s.phrase)
LEFT JOIN t_best_place b ON b.doc_id = s.doc_id AND b.phrase = trim(s.phrase)""")


# Fact responses: three attempts per chunk, some broken in different ways.
cte("t_fact_responses", r"""
SELECT doc_id, chunk_index, attempt, k, CASE k
    WHEN 0 THEN '```json' || chr(10) || '{"extracted_facts":[' || good || ',{"fact_name":"Oddity","fact_value":"odd","fact_type":"mystery","confidence":0.4}],"fact_types_found":["amount"]}' || chr(10) || '```'
    WHEN 1 THEN NULL
    WHEN 2 THEN '{"extracted_facts":[' || good
    WHEN 3 THEN '{"extracted_facts":[' || good || ',{"fact_name":"Rate","fact_value":"unknown","fact_type":"percentage","confidence":0.7}],"fact_types_found":["percentage"]}'
    ELSE '{"extracted_facts":[' || good || '],"fact_types_found":["mystery"]}' END AS response
FROM (SELECT doc_id, chunk_index, attempt, (doc_id + 3 * chunk_index + attempt * attempt) % 5 AS k,
        '{"fact_name":"Length","fact_value":"' || length(text) || ' characters","fact_type":"amount","confidence":0.9,"metadata":{"page":"' || page_num || '"}},{"fact_name":" Opening ","fact_value":"' || first || '","confidence":0.8,"source_text":"chunk ' || chunk_index || '"}' AS good
      FROM t_parts CROSS JOIN (SELECT unnest([0, 1, 2]) AS attempt))""")

cte("t_stripped", r"""
SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(response, '^\s+|\s+$', '', 'g'), '^```(json)?', ''), '```$', ''), chr(10) || ' ') AS body FROM t_fact_responses""")

cte("t_attempts", """
SELECT r.doc_id, r.chunk_index, r.attempt, r.k, r.k IN (0, 3) AS parsed,
       CASE r.k WHEN 0 THEN 1 + least(n, 1) WHEN 3 THEN 2 + least(n, 1) ELSE 0 END AS n_built,
       CASE r.k WHEN 0 THEN 0 WHEN 3 THEN 1 ELSE 0 END + CASE WHEN r.k IN (0, 3) AND n = 1 THEN 1 ELSE 0 END AS n_lost
FROM t_fact_responses r JOIN (SELECT doc_id, chunk_index, length(trim(first)) AS n FROM t_parts) p ON p.doc_id = r.doc_id AND p.chunk_index = r.chunk_index""")

cte("t_chosen", """
SELECT doc_id, chunk_index, coalesce(min(attempt) FILTER (parsed AND n_built > 0 AND n_lost = 0), 2) AS attempt,
       bool_or(parsed AND n_built > 0 AND n_lost = 0) AS clean FROM t_attempts GROUP BY doc_id, chunk_index""")

cte("t_facts", r"""
SELECT c.doc_id, c.chunk_index, CAST(i - 1 AS INTEGER) AS fact_no, CASE i WHEN 1 THEN 'Length' ELSE 'Opening' END AS fact_name,
       CASE i WHEN 1 THEN length(p.text) || ' characters' ELSE trim(p.first) END AS fact_value, CASE i WHEN 1 THEN 'amount' ELSE 'other' END AS fact_type,
       CASE i WHEN 1 THEN 0.9 ELSE 0.8 END::DOUBLE AS confidence
FROM t_chosen c JOIN t_attempts a ON a.doc_id = c.doc_id AND a.chunk_index = c.chunk_index AND a.attempt = c.attempt AND a.parsed
JOIN t_parts p ON p.doc_id = c.doc_id AND p.chunk_index = c.chunk_index CROSS JOIN (SELECT unnest([1, 2]) AS i)
WHERE i = 1 OR length(trim(p.first)) >= 2""")
