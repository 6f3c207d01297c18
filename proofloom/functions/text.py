"""Text, formatting and label expressions: Column in, Column out, all JVM-side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sizes, patterns and labels that results depend on.
SENTENCES_PER_CHUNK = 6
MIN_CHUNK_CHARS = 50
RERANK_TOKENS = 512
RERANK_MARGIN = 8
RERANK_SPECIAL_TOKENS = 3
PAIR_TOKENS = RERANK_TOKENS - RERANK_MARGIN - RERANK_SPECIAL_TOKENS
SENTENCE_MARK = "\u001e"
CONTEXT_SEPARATOR = "\n\n---\n\n"
NO_PHRASE = "No relevant phrase found."
NO_CONTEXT = "No relevant text found for this sub-prompt."
NO_CHAT_CONTEXT = (
    "I couldn't find specific information related to your question in the provided documents. "
    "Could you try rephrasing or asking something else?"
)
SUFFIXES = (".pdf", ".docx")


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _named(text, use: Callable[[Column], Column]) -> Column:
    """``use`` of a text that is made once: inside a lambda Spark would make it again for every mention."""
    return use(F.col(text)) if isinstance(text, str) else F.get(F.transform(F.array(text), use), F.lit(0))


def trim_all(text) -> Column:
    """Strip every kind of white space at both ends. Texts that begin and end with a visible ASCII character stay."""

    def strip(t: Column) -> Column:
        bare = F.substring(t, 1, 1).between("!", "~") & F.substring(t, -1, 1).between("!", "~")
        return F.when(bare, t).otherwise(F.regexp_replace(t, r"(?U)^\s+|\s+$", ""))

    return _named(text, strip)


def clean_spaces(text) -> Column:
    """Collapse white-space runs to one space and strip. Printable ASCII without a double space is only stripped."""

    def collapse(t: Column) -> Column:
        single = ~F.contains(t, F.lit("  ")) & ~t.rlike("[^ -~]")
        return F.trim(F.when(single, t).otherwise(F.regexp_replace(t, r"(?U)\s+", " ")))

    return _named(text, collapse)


def is_filled(text) -> Column:
    """True for text with at least one visible character."""
    return F.coalesce(F.length(trim_all(text)) > 0, F.lit(False))


def normalize(text) -> Column:
    """Comparison form: null becomes empty, lower case, single spaces."""
    return clean_spaces(F.lower(F.coalesce(_col(text), F.lit(""))))


def strip_markdown(text) -> Column:
    """Drop emphasis, code ticks, headings, quotes and list marks; straight quotes become spaces."""
    given = F.coalesce(_col(text), F.lit(""))
    out = given
    for pattern, put in (
        (r"\*(\*|_)(.*?)\1\*?", "$2"),
        (r"`(.*?)`", "$1"),
        (r"(?m)^#+\s+", ""),
        (r"(?m)^>\s+", ""),
        (r"(?m)^\s*[*\-+]\s+", ""),
        (r"(?m)^\s*\d+\.\s+", ""),
        (r"['\"]", " "),
    ):
        out = F.regexp_replace(out, pattern, put)
    # Every pattern needs one of these characters; most texts have none.
    return trim_all(F.when(given.rlike(r"[*`#>+\-0-9'\"]"), out).otherwise(given))


def drop_quotes(text) -> Column:
    """Delete straight quotes (used by the lenient verification pass)."""
    return F.regexp_replace(_col(text), "['\"]", "")


def words(text) -> Column:
    """Lower-cased tokens split on white space, punctuation kept; blank text has none."""
    return F.filter(F.split(normalize(text), " "), lambda w: w != "")


def sentence_array(text) -> Column:
    """Rule-based sentences: a break after a run of ``.``, ``!`` or ``?`` followed by a space."""
    marked = F.regexp_replace(_col(text), "([.!?]+) ", "$1" + SENTENCE_MARK)
    return F.split(marked, SENTENCE_MARK)


def last_index(text: Column, char: str) -> Column:
    """0-based position of the last ``char``, -1 when it is missing."""
    back = F.instr(F.reverse(text), char)
    return F.when(back == 0, F.lit(-1)).otherwise(F.length(text) - back)


def truncate_at_boundary(text, limit: int, ratio: float = 0.8) -> Column:
    """Cut at ``limit`` characters, falling back to a late full stop, else the last space."""
    text = _col(text)
    head = F.substring(text, 1, limit)
    stop, space = last_index(head, "."), last_index(head, " ")
    return (
        F.when(F.length(text) <= limit, text)
        .when(stop > limit * ratio, F.left(head, stop + 1))
        .when(space > 0, F.left(head, space))
        .otherwise(head)
    )


def fit_token_budget(query, document, tokens: int = RERANK_TOKENS) -> Column:
    """Share a token budget over a pair: the query first, at least one token for the document."""
    room = tokens - RERANK_TOKENS + PAIR_TOKENS
    q = F.filter(F.split(clean_spaces(query), " "), lambda w: w != "")
    d = F.filter(F.split(clean_spaces(document), " "), lambda w: w != "")
    kept = F.least(F.size(q), F.lit(room - 1))
    left = F.greatest(F.lit(room) - kept, F.lit(1))
    return F.struct(
        F.array_join(F.slice(q, 1, F.greatest(kept, F.lit(1))), " ").alias("query"),
        F.array_join(F.slice(d, F.lit(1), left), " ").alias("document"),
    )


def section_key(number, title) -> Column:
    return F.concat(F.lit("section_"), _col(number).cast("string"), F.lit("_"), F.lower(F.replace(_col(title), F.lit(" "), F.lit("_"))))


def error_key(number, title) -> Column:
    return F.concat(F.lit("error_"), _col(number).cast("string"), F.lit("_"), F.lower(F.replace(_col(title), F.lit(" "), F.lit("_"))))


def section_title(key, keep_prefix: bool = False) -> Column:
    """Readable section title; the export variant keeps the ``section_N`` prefix."""
    body = _col(key) if keep_prefix else F.regexp_replace(_col(key), r"^section_\d+_", "")
    return F.initcap(F.replace(body, F.lit("_"), F.lit(" ")))


def preview(text, size: int = 200, always: bool = False) -> Column:
    """First characters plus dots: only when cut (logs) or always (summaries, chat)."""
    text = F.coalesce(_col(text), F.lit(""))
    cut = F.concat(F.substring(text, 1, size), F.lit("..."))
    return cut if always else F.when(F.length(text) > size, cut).otherwise(text)


def fixed(value, digits: int) -> Column:
    """Fixed-point text: ties go to the even digit, a negative number keeps its sign at zero."""
    value = _col(value).cast("double")
    body = F.format_string(f"%.{digits}f", F.bround(F.abs(value), digits))
    return F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("")), body)


def page_label(page) -> Column:
    return F.coalesce(F.concat(F.lit("Page "), (_col(page) + 1).cast("string")), F.lit("Page unknown"))


def score_label(score, percent: bool = False) -> Column:
    """One decimal, or N/A for a missing or zero score."""
    score = _col(score).cast("double")
    return F.when(score.isNull() | (score == 0), F.lit("N/A")).otherwise(
        F.concat(fixed(score, 1), F.lit("%" if percent else ""))
    )


def size_label(size) -> Column:
    """Bytes as text in steps of 1024 with two decimals."""
    size = _col(size).cast("double")
    out = F.concat(fixed(size / float(1024**5), 2), F.lit(" PB"))
    for power, unit in reversed(list(enumerate(["B", "KB", "MB", "GB", "TB"]))):
        scaled = size / float(1024**power)
        out = F.when(scaled < 1024, F.concat(fixed(scaled, 2), F.lit(" " + unit))).otherwise(out)
    return out


def chat_role(role) -> Column:
    """system, user and assistant are kept in lower case; anything else speaks as user."""
    low = F.lower(_col(role))
    return F.when(low.isin("system", "user", "assistant"), low).otherwise(F.lit("user"))


def file_stem(name) -> Column:
    out = _col(name)
    for suffix in SUFFIXES:
        out = F.replace(out, F.lit(suffix), F.lit(""))
    return out


def annotated_name(name) -> Column:
    return F.concat(file_stem(name), F.lit("_annotated.pdf"))


def file_suffix(path) -> Column:
    return F.lower(F.regexp_extract(_col(path), r"(\.[^./]+)$", 1))


def analysis_line(chunk_id, page, score, text) -> Column:
    return F.format_string(
        "Chunk ID: %s, Page: %d, Score: %s\nTEXT: %s",
        F.coalesce(_col(chunk_id), F.lit("unknown")),
        (F.coalesce(_col(page), F.lit(-1)) + 1).cast("long"),
        fixed(F.coalesce(_col(score), F.lit(0.0)), 3),
        F.coalesce(_col(text), F.lit("")),
    )


def chat_line(name, page, score, text) -> Column:
    return F.format_string(
        "Source: %s, Page: %d\nScore: %s\nContent: %s",
        F.coalesce(_col(name), F.lit("Unknown")),
        (F.coalesce(_col(page), F.lit(-1)) + 1).cast("long"),
        fixed(F.coalesce(_col(score), F.lit(0.0)), 3),
        F.coalesce(_col(text), F.lit("")),
    )


def ingest_status(n_chunks, n_valid, error=None) -> Column:
    """success, warning (no chunks, or none with text) or error."""
    failed = F.lit(False) if error is None else _col(error).isNotNull()
    return (
        F.when(failed, F.lit("error"))
        .when(F.coalesce(_col(n_chunks), F.lit(0)) == 0, F.lit("warning"))
        .when(F.coalesce(_col(n_valid), F.lit(0)) == 0, F.lit("warning"))
        .otherwise(F.lit("success"))
    )


def ingest_message(n_chunks, n_valid, error=None) -> Column:
    failed = F.lit(False) if error is None else _col(error).isNotNull()
    why = F.lit("") if error is None else F.coalesce(_col(error), F.lit(""))
    return (
        F.when(failed, F.concat(F.lit("Preprocessing failed: "), why))
        .when(F.coalesce(_col(n_chunks), F.lit(0)) == 0, F.lit("No text chunks could be extracted"))
        .when(F.coalesce(_col(n_valid), F.lit(0)) == 0, F.lit("No valid chunk texts found"))
        .otherwise(F.concat(F.lit("Preprocessed "), _col(n_chunks).cast("string"), F.lit(" chunks")))
    )
