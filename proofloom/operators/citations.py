"""Numbered citations of chat answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofloom.functions import parsing as ps
from proofloom.functions.spread import salted_join


def number_answers(answers: DataFrame) -> DataFrame:
    """Answers with their citation marks replaced by numbers, and the citations as an array."""
    return answers.withColumn("processed_text", ps.number_citations("answer")).withColumn(
        "citations", ps.citation_list("answer")
    )


def citation_rows(numbered: DataFrame, *keep: str) -> DataFrame:
    """One row per citation with the text shown for it."""
    rows = numbered.select(*keep, "processed_text", F.explode("citations").alias("c")).select(*keep, "processed_text", "c.*")
    return rows.withColumn("snippet", ps.citation_snippet("processed_text", "number", "filename", "page")).drop("processed_text")


def attach_documents(citations: DataFrame, documents: DataFrame, spread_by: list[str]) -> DataFrame:
    """Body of each cited file, first match by name, null when unknown.

    Only cited files move: the names pick them first. Most citations may point at one file, so the
    join is salted.
    """
    cited = documents.join(citations.select("filename").distinct(), "filename", "left_semi")
    bodies = cited.groupBy("filename").agg(F.min_by("body", "doc_id").alias("body"))
    return salted_join(citations, bodies, ["filename"], spread_by, "left")
