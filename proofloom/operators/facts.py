"""Typed facts from model responses: validation, attempt choice, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.functions import parsing as ps
from proofloom.functions import text as tx

# The default type analysis and the number of retries.
DEFAULT_TYPE = "definition"
DEFAULT_CONFIDENCE = 0.3
DEFAULT_REASON = "Default to definition type due to JSON parsing error"
MAX_RETRIES = 2


def _get(item: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(item, path, kind)


def _text(item: Column, path: str) -> Column:
    """A JSON string as text; other JSON types are no text."""
    kind = F.schema_of_variant(_get(item, path, "variant"))
    return F.when(F.coalesce(kind == "STRING", F.lit(False)), _get(item, path))


def coerce_type(value: Column) -> Column:
    """Known fact type, ``other`` when absent, null when unknown."""
    named = F.coalesce(value, F.lit("other"))
    return F.when(named.isin(*ps.FACT_TYPES), named)


def is_built(name: Column, value: Column, fact_type: Column, confidence: Column) -> Column:
    """First check: a fact that fails it is dropped without a word."""
    return F.coalesce(
        (F.length(name) >= 2) & (F.length(value) >= 1) & fact_type.isNotNull() & confidence.between(0.0, 1.0), F.lit(False)
    )


def is_sound(value: Column, fact_type: Column) -> Column:
    """Second check: value of two characters or more, digits in numeric facts. Losing one here asks for a retry."""
    numeric = fact_type.isin(*ps.NUMERIC_FACTS)
    return (F.length(value) >= 2) & (~numeric | value.rlike(r"\p{Nd}"))


def read_attempts(responses: DataFrame) -> DataFrame:
    """Per response: parsed?, known fact types?, and its facts with both checks applied."""
    v = F.try_parse_json(ps.strip_fence("response"))
    types = F.coalesce(_get(F.col("_v"), "$.fact_types_found", "array<string>"), F.array().cast("array<string>"))
    listed = F.coalesce(_get(F.col("_v"), "$.extracted_facts", "array<variant>"), F.array().cast("array<variant>"))
    facts = F.transform(
        listed,
        lambda f: F.struct(
            tx.trim_all(F.coalesce(_text(f, "$.fact_name"), F.lit(""))).alias("fact_name"),
            tx.trim_all(F.coalesce(_text(f, "$.fact_value"), F.lit(""))).alias("fact_value"),
            coerce_type(_get(f, "$.fact_type")).alias("fact_type"),
            F.when(_get(f, "$.confidence", "variant").isNull(), F.lit(0.5)).otherwise(_get(f, "$.confidence", "double")).alias("confidence"),
            _text(f, "$.source_text").alias("source_text"),
            F.coalesce(_get(f, "$.metadata", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("metadata"),
        ),
    )
    built = F.filter("_f", lambda f: is_built(f["fact_name"], f["fact_value"], f["fact_type"], f["confidence"]))
    sound = F.filter("_built", lambda f: is_sound(f["fact_value"], f["fact_type"]))
    return (
        responses.withColumn("_v", v)
        .withColumn("_ok", F.col("_v").isNotNull() & F.forall(types, lambda t: t.isin(*ps.FACT_TYPES)))
        .withColumn("_f", facts)
        .withColumn("_built", F.when(F.col("_ok"), built))
        .withColumn("facts", F.when(F.col("_ok"), sound))
        .withColumn("n_built", F.coalesce(F.size("_built"), F.lit(0)))
        .withColumn("n_lost", F.when(F.col("_ok"), F.size("_built") - F.size("facts")).otherwise(F.lit(0)))
        .select("request_id", "attempt", F.col("_ok").alias("parsed"), "n_built", "n_lost", "facts")
    )


def choose_attempt(attempts: DataFrame) -> DataFrame:
    """The first clean attempt, else the last one made; with its facts (none if it failed).

    One pass: each response is parsed once, and all but one attempt per request fall map-side.
    """
    clean = F.col("parsed") & (F.col("n_built") > 0) & (F.col("n_lost") == 0)
    best = F.coalesce(clean, F.lit(False))
    turn = F.coalesce(F.when(best, F.col("attempt")).otherwise(-F.col("attempt")).cast("long"), F.lit(1 << 62))
    chosen = attempts.where(F.col("request_id").isNotNull()).groupBy("request_id").agg(
        F.min_by(F.struct("attempt", "parsed", "facts"), F.struct((~best).alias("late"), turn.alias("turn"))).alias("_a"),
        F.bool_or(clean).alias("clean"),
        F.count("*").alias("n_attempts"),
    )
    return chosen.select(
        "request_id",
        "_a.attempt",
        "n_attempts",
        "clean",
        F.when(F.col("_a.parsed"), F.lit(None).cast("string")).otherwise(F.lit("Extraction failed")).alias("error"),
        F.coalesce("_a.facts", F.array().cast(attempts.schema["facts"].dataType)).alias("facts"),
    )


def fact_rows(chosen: DataFrame, *keep: str) -> DataFrame:
    """One row per fact with its place in the answer."""
    return chosen.select("request_id", *keep, F.posexplode("facts").alias("fact_no", "f")).select(
        "request_id", *keep, "fact_no", "f.*"
    )


def first_facts(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key in source order, reduced map-side so that copies never gather."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return picked.select(*keys, "_first.*")


def two_columns(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("fact_name").alias("Fact"), F.col("fact_value").alias("Definition"))


def by_category(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Facts grouped by category inside each document."""
    item = F.struct("section_no", "fact_no", "fact_name", "fact_value")
    return rows.groupBy(key, F.coalesce("fact_type", F.lit("General")).alias("category")).agg(
        F.count("*").alias("n_facts"), F.array_sort(F.collect_list(item)).alias("facts")
    )


def legacy_shape(rows: DataFrame) -> DataFrame:
    """Older fact layout: text, category and an attribute map in which metadata keys win."""
    base = F.create_map(
        F.lit("fact"), F.col("fact_name"), F.lit("definition"), F.col("fact_value"),
        F.lit("confidence"), F.col("confidence").cast("string"),
    )
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(F.col("metadata"), k))
    return rows.withColumn("attributes", F.map_concat(kept, "metadata")).withColumn("text", F.col("fact_name")).withColumn(
        "category", F.col("fact_type")
    )


def fact_types(responses: DataFrame) -> DataFrame:
    """Expected fact types per request; unusable answers fall back to definitions."""
    v = F.col("_v")
    listed = F.coalesce(_get(v, "$.expected_fact_types", "array<string>"), F.array(F.lit(DEFAULT_TYPE)))
    usable = v.isNotNull() & F.forall(listed, lambda t: F.coalesce(t.isin(*ps.FACT_TYPES), F.lit(False)))
    hints = F.coalesce(_get(v, "$.extraction_hints", "array<string>"), F.array().cast("array<string>"))
    return (
        responses.withColumn("_v", F.try_parse_json(ps.strip_fence("response")))
        .withColumn("_usable", F.coalesce(usable, F.lit(False)))
        .select(
            "request_id",
            F.when(F.col("_usable"), listed).otherwise(F.array(F.lit(DEFAULT_TYPE))).alias("expected_fact_types"),
            F.when(F.col("_usable"), F.coalesce(_get(v, "$.reasoning"), F.lit(""))).otherwise(F.lit(DEFAULT_REASON)).alias("reasoning"),
            F.when(F.col("_usable"), F.coalesce(_get(v, "$.confidence", "double"), F.lit(0.5)))
            .otherwise(F.lit(DEFAULT_CONFIDENCE))
            .alias("confidence"),
            F.when(F.col("_usable"), hints).otherwise(F.array().cast("array<string>")).alias("hints"),
        )
    )


def preview_facts(rows: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """The first facts in a fixed order (a report preview)."""
    return rows.orderBy(*order).limit(n)
