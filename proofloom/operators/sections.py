"""Model answers to sub-prompts and sections; contexts that go into the model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proofloom.functions import parsing as ps
from proofloom.functions import text as tx
from proofloom.functions.spread import is_small, join_checked
from proofloom.operators import onepass
from proofloom.session import stored

# Texts of default and fallback answers.
OVERALL_TITLE = "Overall Analysis"
NO_ANALYSIS = "No analysis provided"
FAILED_ANALYSIS = "An error occurred while analyzing this sub-prompt."
FAILED_CONTEXT = "Analysis Error"
UNKNOWN_PROMPT = "Unknown sub-prompt"
UNKNOWN_TITLE = "Unknown title"


def _get(item: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(item, path, kind)


def _is(item: Column, path: str, kind: str) -> Column:
    found = F.schema_of_variant(_get(item, path, "variant"))
    return F.coalesce(found.startswith(kind), F.lit(False))


def parsed(response: Column) -> Column:
    """The response's JSON as a variant; null when it has none."""
    return F.try_parse_json(ps.json_envelope(response))


def _items(responses: DataFrame, path: str, *keep: str) -> DataFrame:
    """One row per object of a JSON list; invalid lists give no row."""
    listed = responses.select(*keep, parsed(F.col("response")).alias("_v")).select(
        *keep, _get(F.col("_v"), path, "array<variant>").alias("_a")
    )
    rows = listed.select(*keep, F.posexplode_outer("_a").alias("_pos", "_item"))
    return rows.where(F.col("_pos").isNotNull() & F.coalesce(F.schema_of_variant("_item").startswith("OBJECT"), F.lit(False)))


def parse_decomposition(responses: DataFrame) -> DataFrame:
    """Sub-prompts with valid weights; a request without any gets one row for the whole prompt.

    ``responses`` has request_id, prompt and response.
    """
    items = _items(responses, "$.decomposition", "request_id")
    item = F.col("_item")
    filled = _is(item, "$.title", "STRING") & _is(item, "$.sub_prompt", "STRING")
    named = items.where(filled).where(
        tx.is_filled(_get(item, "$.title")) & tx.is_filled(_get(item, "$.sub_prompt"))
    )
    has_params = _is(item, "$.rag_params", "OBJECT")

    def weight(name: str) -> Column:
        missing = _get(item, f"$.rag_params.{name}", "variant").isNull()
        return F.when(missing, F.lit("0.5")).otherwise(_get(item, f"$.rag_params.{name}"))

    b, s = weight("bm25_weight"), weight("semantic_weight")
    readable = ps.as_number(b).isNotNull() & ps.as_number(s).isNotNull()
    reason = F.when(_is(item, "$.rag_params.reasoning", "STRING"), _get(item, "$.rag_params.reasoning")).otherwise(
        F.lit(ps.REASON_NONE)
    )
    valid = named.select(
        "request_id",
        "_pos",
        _get(item, "$.title").alias("title"),
        _get(item, "$.sub_prompt").alias("sub_prompt"),
        F.when(has_params, ps.valid_weights(b, s)).otherwise(
            F.struct(F.lit(0.5).alias("bm25_weight"), F.lit(0.5).alias("semantic_weight"))
        ).alias("w"),
        F.when(~has_params, F.lit(ps.REASON_MISSING)).when(~readable, F.lit(ps.REASON_INVALID)).otherwise(reason).alias("reasoning"),
    )
    order = F.row_number().over(W.partitionBy("request_id").orderBy("_pos"))
    good = valid.select(
        "request_id", order.alias("number"), "title", "sub_prompt", "w.bm25_weight", "w.semantic_weight", "reasoning"
    )
    whole = responses.join(good.select("request_id").distinct(), "request_id", "left_anti").select(
        "request_id",
        F.lit(1).alias("number"),
        F.lit(OVERALL_TITLE).alias("title"),
        F.col("prompt").alias("sub_prompt"),
        F.lit(0.5).alias("bm25_weight"),
        F.lit(0.5).alias("semantic_weight"),
        F.lit(ps.REASON_FAILED).alias("reasoning"),
    )
    return good.unionByName(whole)


def quote_list(item: Column, path: str) -> Column:
    """Quotes as a list of strings: a scalar is wrapped, other values are written as text."""
    listed = _get(item, path, "array<variant>")
    many = F.transform(listed, lambda q: F.coalesce(_get(q, "$", "string"), F.to_json(q)))
    value = _get(item, path, "variant")
    return (
        F.when(value.isNull(), F.array(F.lit(tx.NO_PHRASE)))
        .when(listed.isNotNull(), many)
        .otherwise(F.array(F.coalesce(_get(item, path), F.lit("None"))))
    )


def parse_analyses(responses: DataFrame, sub_prompts: DataFrame) -> DataFrame:
    """One analysis per sub-prompt and request.

    An answer is tied to its sub-prompt by index (its position if it names none); an index out
    of range keeps the model's own values. Sub-prompts without an answer get a fallback row.
    ``sub_prompts`` has request_id, number, title, sub_prompt.
    """
    # An answer's place among its response's objects is known inside the response: nothing moves for it.
    listed = responses.select("request_id", _get(parsed(F.col("response")), "$.analyses", "array<variant>").alias("_a"))
    objects = F.filter("_a", lambda a: F.coalesce(F.schema_of_variant(a).startswith("OBJECT"), F.lit(False)))
    items = listed.select("request_id", F.posexplode_outer(objects).alias("_pos", "_item")).where(F.col("_pos").isNotNull())
    item = F.col("_item")
    read = items.withColumn("_spot", F.col("_pos") + 1).select(
        "request_id",
        F.coalesce(_get(item, "$.sub_prompt_index", "int"), F.col("_spot")).alias("number"),
        F.col("_spot").alias("position"),
        _get(item, "$.sub_prompt_title").alias("_title"),
        _get(item, "$.sub_prompt_analyzed").alias("_prompt"),
        F.coalesce(_get(item, "$.analysis_summary"), F.lit(NO_ANALYSIS)).alias("analysis"),
        quote_list(item, "$.supporting_quotes").alias("phrases"),
        F.coalesce(_get(item, "$.analysis_context"), F.lit("")).alias("context"),
    )
    # Written once: the answers and the search for missing ones both read it, and parsing is the dear part.
    read = stored(read, "read")
    answered = read.join(sub_prompts, ["request_id", "number"], "left").select(
        "request_id",
        "number",
        "position",
        F.coalesce("_title", "title", F.lit(UNKNOWN_TITLE)).alias("title"),
        F.coalesce("_prompt", "sub_prompt", F.lit(UNKNOWN_PROMPT)).alias("sub_prompt"),
        "analysis",
        "phrases",
        "context",
        F.lit(False).alias("is_fallback"),
    )
    return answered.unionByName(missing_analyses(read, sub_prompts))


def missing_analyses(read: DataFrame, sub_prompts: DataFrame) -> DataFrame:
    """Fallback rows for sub-prompts that no answer covers."""
    bare = sub_prompts.join(read.select("request_id", "number").distinct(), ["request_id", "number"], "left_anti")
    return bare.select(
        "request_id",
        "number",
        F.col("number").alias("position"),
        "title",
        "sub_prompt",
        F.lit(FAILED_ANALYSIS).alias("analysis"),
        F.array(F.lit(tx.NO_PHRASE)).alias("phrases"),
        F.lit(FAILED_CONTEXT).alias("context"),
        F.lit(True).alias("is_fallback"),
    )


def assemble_sections(analyses: DataFrame, *keep: str) -> DataFrame:
    """Sections of a request in sub-prompt order, with their keys."""
    order = F.row_number().over(W.partitionBy("request_id").orderBy("number", "position", "is_fallback"))
    return analyses.withColumn("section_no", order).select(
        "request_id",
        *keep,
        "section_no",
        tx.section_key("section_no", "title").alias("section_key"),
        "title",
        "analysis",
        "phrases",
        "context",
    )


def error_sections(failed: DataFrame) -> DataFrame:
    """Placeholder sections for sub-prompts whose answer could not be used at all."""
    return failed.select(
        "request_id",
        "section_no",
        tx.error_key("section_no", "title").alias("section_key"),
        "title",
        F.concat(F.lit("Error processing this section: "), F.col("error")).alias("analysis"),
        F.array(F.lit(tx.NO_PHRASE)).alias("phrases"),
        F.concat(F.lit("Error in sub-prompt: "), F.col("sub_prompt")).alias("context"),
    )


def analysis_documents(sections: DataFrame) -> DataFrame:
    """All sections of a request as one JSON document (a request has few sections)."""
    body = F.struct(
        F.col("analysis").alias("Analysis"), F.col("phrases").alias("Supporting_Phrases"), F.col("context").alias("Context")
    )
    entries = F.array_sort(F.collect_list(F.struct("section_no", "section_key", body.alias("body"))))
    grouped = sections.groupBy("request_id").agg(entries.alias("_e"), F.count("*").alias("n_sections"))
    as_map = F.map_from_entries(F.transform("_e", lambda e: F.struct(e["section_key"], e["body"])))
    document = F.struct(
        F.concat(F.lit("Analysis of "), F.col("request_id")).alias("title"), as_map.alias("analysis_sections")
    )
    return grouped.select("request_id", "n_sections", F.to_json(document).alias("document"))


def section_phrases(sections: DataFrame, *keep: str) -> DataFrame:
    """One row per quoted phrase of a section."""
    return sections.select(*keep, "section_key", F.posexplode("phrases").alias("phrase_no", "phrase"))


def documents_with_sections(results: DataFrame, sections: DataFrame, key: str = "request_id") -> DataFrame:
    """Results that have at least one section."""
    return results.join(sections.select(key).distinct(), key, "left_semi")


def only_errors(sections: DataFrame, key: str = "request_id") -> DataFrame:
    """Per request: does it hold nothing but error sections?"""
    return sections.groupBy(key).agg(F.bool_and(F.col("section_key").startswith("error_")).alias("all_errors"))


def analysed_sections(sections: DataFrame, key: str = "request_id") -> DataFrame:
    """Number of sections with analysis text per request."""
    return sections.groupBy(key).agg(F.count_if(tx.is_filled("analysis")).alias("n_analysed"))


def build_contexts(retrieved: DataFrame, queries: DataFrame, documents: DataFrame) -> DataFrame:
    """Excerpts for each (query, document): at most k formatted chunks, or a fixed notice.

    ``retrieved`` has query_id, doc_id, rank, chunk_id, page_num, score, text, as rows or grouped (see ``onepass``):
    grouped results meet their documents, so no context is shuffled.
    """
    if onepass.is_grouped(retrieved) and not is_small(queries, onepass.BLOCK):
        retrieved = onepass.as_rows(retrieved)
    if onepass.is_grouped(retrieved):
        lines = onepass.each(retrieved, lambda h: tx.analysis_line(h["chunk_id"], h["page_num"], h["score"], h["text"]))
        none = lines.schema["pairs"].dataType.simpleString()
        ids = queries.select(F.col("query_id").cast("long").alias("query_id")).distinct().agg(F.collect_list("query_id").alias("_ids"))
        met = documents.select("doc_id").join(lines.hint("merge"), "doc_id", "left").crossJoin(F.broadcast(ids))
        have = F.filter("pairs", lambda p: F.array_contains("_ids", p["query_id"]))
        rest = F.array_except("_ids", F.coalesce("pairs.query_id", F.expr("cast(array() AS array<bigint>)")))
        empty = F.transform(rest, lambda q: F.struct(q.alias("query_id"), F.expr("cast(array() AS array<string>)").alias("found"))).cast(none)
        pairs = met.select("doc_id", F.explode(F.concat(F.coalesce(have, F.expr(f"cast(array() AS {none})")), empty)).alias("p"))
        joined = F.when(F.size("p.found") > 0, F.array_join("p.found", tx.CONTEXT_SEPARATOR)).otherwise(F.lit(tx.NO_CONTEXT))
        return pairs.select("p.query_id", "doc_id", joined.alias("context"))
    line = tx.analysis_line("chunk_id", "page_num", "score", "text")
    found = retrieved.groupBy("query_id", "doc_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("_l")
    )
    asked = pairs_of(queries, documents)
    joined = F.array_join(F.transform("_l", lambda x: x["line"]), tx.CONTEXT_SEPARATOR)
    return asked.join(found, ["query_id", "doc_id"], "left").select(
        "query_id", "doc_id", F.coalesce(joined, F.lit(tx.NO_CONTEXT)).alias("context")
    )


def pairs_of(queries: DataFrame, documents: DataFrame) -> DataFrame:
    from proofloom.operators.lexical import every_pair

    return every_pair(documents.select("doc_id"), queries)


def analysis_request(contexts: DataFrame, queries: DataFrame) -> DataFrame:
    """The excerpts block of one document's request: all sub-prompts in order."""
    block = F.format_string(
        "--- SUB-PROMPT %d ---\nTitle: %s\nSub-prompt: %s\n\nRelevant Document Excerpts for Sub-prompt %d:\n%s\n",
        F.col("number"), F.col("title"), F.col("query"), F.col("number"), F.col("context"),
    )
    rows = join_checked(contexts, queries.select("query_id", "number", "title", "query"), ["query_id"], ["doc_id"], max_rows=20_000)
    return rows.select("doc_id", "number", block.alias("block"))


def chat_context(retrieved: DataFrame, name: str = "filename") -> DataFrame:
    """Chat excerpts as ordered rows. A question may draw on every document of a corpus, so the
    lines stay a sorted table; joining them with the separator gives the prompt text."""
    lines = retrieved.select("query_id", "score", "doc_id", "chunk_index", tx.chat_line(name, "page_num", "score", "text").alias("line"))
    return lines.orderBy("query_id", F.desc("score"), "doc_id", "chunk_index")


def attach_contexts(results: DataFrame, contexts: DataFrame) -> DataFrame:
    """Sub-prompt context for each result by index; none gives an empty text."""
    return results.join(contexts, ["request_id", "number"], "left").withColumn(
        "context_text", F.coalesce("context_text", F.lit(""))
    )
