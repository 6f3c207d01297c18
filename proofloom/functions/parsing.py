"""Expressions that read model output: JSON envelopes, scores, weights, citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofloom.functions import text as tx

# Envelope, number, citation and fact patterns and default texts.
FENCED_OBJECT = r"(?s)```json\s*(\{.*?\})\s*```"
SCORE_NUMBER = r"(0?\.\d+|[01]\.?\d*)"
LINE_NUMBER = r"^\d+[.)]\s+"
CITATION = r"\(Source:\s*([^,]+?)\s*,\s*Page:\s*(\d+)\)"
MARKER = r"\[\d+\]"
FACT_TYPES = (
    "definition", "percentage", "amount", "currency_amount", "date", "entity",
    "rate", "duration", "boolean", "list", "other",
)
NUMERIC_FACTS = ("percentage", "amount", "currency_amount")
REASON_NONE = "No reasoning provided"
REASON_MISSING = "Default balanced weights (rag_params missing from LLM response)"
REASON_INVALID = "Default balanced weights (invalid weight values from LLM)"
REASON_FAILED = "Default balanced weights due to decomposition failure"


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def as_number(value) -> Column:
    """Double or null; never an error."""
    return tx.trim_all(_col(value).cast("string")).try_cast("double")


def strip_fence(response) -> Column:
    """Remove an opening and a closing code fence around JSON."""
    opened = F.regexp_replace(tx.trim_all(_col(response)), r"^```(json)?", "")
    return tx.trim_all(F.regexp_replace(opened, r"```$", ""))


def json_envelope(response) -> Column:
    """The JSON object in a response: fenced, whole, or from the first to the last brace."""
    text = tx.trim_all(_col(response))
    fenced = F.regexp_extract(text, FENCED_OBJECT, 1)
    first = F.instr(text, "{")
    last = tx.last_index(text, "}") + 1
    return (
        F.when(fenced != "", fenced)
        .when(text.startswith("{") & text.endswith("}"), text)
        .when((first > 0) & (last > first), F.substring(text, first, last - first + 1))
    )


def clamp01(value: Column) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def pair_score(response) -> Column:
    """Score of one pair in [0, 1]; text that is no number gives the neutral 0.5."""
    return F.coalesce(clamp01(as_number(response)), F.lit(0.5))


def batch_scores(response, n_pairs) -> Column:
    """Scores of a batch answer, one per non-blank line; null unless their count fits."""
    lines = F.filter(F.transform(F.split(tx.trim_all(_col(response)), "\n"), lambda s: tx.trim_all(s)), lambda s: s != "")

    def read(line: Column) -> Column:
        body = F.regexp_replace(line, LINE_NUMBER, "")
        found = F.regexp_extract(body, SCORE_NUMBER, 1)
        return clamp01(F.coalesce(as_number(body), F.nullif(found, F.lit("")).try_cast("double")))

    scores = F.filter(F.transform(lines, read), lambda s: s.isNotNull())
    return F.when(F.size(scores) == _col(n_pairs), scores)


def rerank_scores(response, n_pairs) -> Column:
    """Scores of a rerank answer: objects with ``score``, plain numbers, or zeros when unusable."""
    objects = F.from_json(_col(response), "predictions array<struct<score:string>>")["predictions"]
    numbers = F.from_json(_col(response), "predictions array<string>")["predictions"]
    plain = F.transform(numbers, as_number)
    zeros = F.array_repeat(F.lit(0.0), _col(n_pairs))
    is_objects = F.size(F.filter(numbers, lambda n: n.startswith("{"))) == F.size(numbers)
    return (
        F.when(numbers.isNull() | (F.size(numbers) != _col(n_pairs)), zeros)
        .when(is_objects, F.transform(objects, lambda p: F.coalesce(as_number(p["score"]), F.lit(0.0))))
        .when(F.exists(plain, lambda s: s.isNull()), zeros)
        .otherwise(plain)
    )


def valid_weights(bm25, semantic) -> Column:
    """Both fusion weights made usable: in [0, 1], summing to 1, else balanced halves."""
    b, s = as_number(bm25), as_number(semantic)
    half = F.lit(0.5)
    bad = b.isNull() | s.isNull() | ~b.between(0.0, 1.0) | ~s.between(0.0, 1.0)
    total = b + s
    off = F.abs(total - 1.0) > 0.01

    def settle(w: Column) -> Column:
        return F.when(bad, half).when(off & (total <= 0), half).when(off, w / total).otherwise(w)

    return F.struct(settle(b).alias("bm25_weight"), settle(s).alias("semantic_weight"))


def citation_list(answer) -> Column:
    """All ``(Source: file, Page: n)`` marks of an answer, in order."""
    text = F.coalesce(_col(answer), F.lit(""))
    names = F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))
    pages = F.regexp_extract_all(text, F.lit(CITATION), F.lit(2))
    return F.zip_with(
        F.transform(names, lambda n, i: F.struct((i + 1).alias("number"), tx.trim_all(n).alias("filename"))),
        pages,
        lambda n, p: F.struct(n["number"].alias("number"), n["filename"].alias("filename"), p.cast("int").alias("page")),
    )


def number_citations(answer) -> Column:
    """The answer with its k-th citation replaced by `` [k]``."""
    text = F.coalesce(_col(answer), F.lit(""))
    pieces = F.split(text, CITATION)
    marked = F.transform(
        pieces, lambda piece, i: F.when(i == 0, piece).otherwise(F.concat(F.lit(" ["), i.cast("string"), F.lit("]"), piece))
    )
    return tx.trim_all(F.array_join(marked, ""))


def citation_snippet(answer, number, filename, page) -> Column:
    """Text shown for a citation: its sentence, else one that names the file, else a default."""
    answer, number, filename = _col(answer), _col(number), _col(filename)
    mark = F.concat(F.lit("["), number.cast("string"), F.lit("]"))
    sentences = F.split(answer, r"[.!?]+(?:\s|$)")
    stem = tx.file_stem(filename)
    marked = F.get(F.filter(sentences, lambda s: F.contains(s, mark)), F.lit(0))
    named = F.get(F.filter(sentences, lambda s: F.contains(F.lower(s), F.lower(stem))), F.lit(0))
    chosen = F.when(F.contains(answer, mark), marked).when(F.contains(answer, stem), named)
    body = tx.clean_spaces(F.regexp_replace(chosen, MARKER, ""))
    head = F.substring(body, 1, 120)
    space = tx.last_index(head, " ")
    cut = F.concat(F.when(space > 80, F.left(head, space)).otherwise(head), F.lit("..."))
    default = F.concat(F.lit("Referenced content from "), filename, F.lit(", Page "), _col(page).cast("string"))
    return F.coalesce(F.when(F.length(body) > 120, cut).when(F.length(body) > 15, body), default)
