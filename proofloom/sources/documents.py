"""Where documents enter: file catalogue, line and block tables, page geometry.

Binary PDF and DOCX decoding stays outside; text lines or layout blocks are the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.functions import text as tx

# The page model used for line sources (points, characters).
PAGE_LEFT = 50
PAGE_TOP = 50
LINE_HEIGHT = 15
CHAR_WIDTH = 6
LINE_CHARS = 82
PAGE_LINES = 49


def read_documents(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Documents already held as text (Parquet), pruned to ``columns``.

    Parquet splits no finer than its row groups. Input with fewer splits than cores is spread by
    key once; large input keeps its own splits and pays no shuffle.
    """
    documents = spark.read.parquet(path)
    if columns:
        documents = documents.select(*columns)
    cores = spark.sparkContext.defaultParallelism
    if documents.rdd.getNumPartitions() < cores:
        documents = documents.repartition(cores, "doc_id")
    return documents


def file_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Uploaded files with name, suffix and an accept/reject status; bodies are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return with_accept_status(files.select("path", "length", "modificationTime"), "path")


def with_accept_status(files: DataFrame, name: str) -> DataFrame:
    """Accept ``.pdf`` and ``.docx`` by lower-cased suffix, flag the rest as errors."""
    suffix = tx.file_suffix(name)
    known = suffix.isin(*tx.SUFFIXES)
    return (
        files.withColumn("suffix", suffix)
        .withColumn("status", F.when(known, F.lit("accepted")).otherwise(F.lit("error")))
        .withColumn(
            "message",
            F.when(known, F.lit("")).otherwise(F.concat(F.lit("Unsupported file type: "), F.col("suffix"))),
        )
    )


def line_array(text) -> Column:
    """Trimmed non-blank lines of a text."""
    lines = F.transform(F.split(text if isinstance(text, Column) else F.col(text), "\n"), tx.trim_all)
    return F.filter(lines, lambda line: F.length(line) > 0)


def document_lines(documents: DataFrame) -> DataFrame:
    """One row per non-blank line, numbered from 1 inside its document; no shuffle."""
    return explode_rows(documents, line_array("text"), "doc_id", alias="text").select(
        "doc_id", (F.col("pos") + 1).cast("long").alias("line_no"), "text"
    )


def table_row_lines(rows: DataFrame, cells: str = "cells") -> DataFrame:
    """Table rows as lines: cells joined by a bar, all-blank rows dropped."""
    trimmed = F.transform(F.col(cells), lambda cell: tx.trim_all(F.coalesce(cell, F.lit(""))))
    return (
        rows.withColumn("_cells", trimmed)
        .where(F.exists("_cells", lambda cell: cell != ""))
        .withColumn("text", F.concat_ws(" | ", "_cells"))
        .drop("_cells")
    )


def stack_lines(paragraphs: DataFrame, table_rows: DataFrame, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """Paragraph lines first, then table lines; ``part`` and ``order`` fix the sequence."""
    first = paragraphs.select(key, F.lit(0).alias("part"), order, "text")
    second = table_rows.select(key, F.lit(1).alias("part"), order, "text")
    return first.unionByName(second)


def wrap_line(line: Column, width: int = LINE_CHARS) -> Column:
    """Hard cut of one line at ``width`` characters."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(line) - 1, F.lit(0)), F.lit(width))
    return F.transform(starts, lambda at: F.substring(line, at + 1, F.lit(width)))


def wrapped_array(text) -> Column:
    return F.flatten(F.transform(line_array(text), lambda line: wrap_line(line)))


def page_arrays(documents: DataFrame) -> DataFrame:
    """Documents with ``page_lines``: per page, its wrapped lines. Stays inside each row."""
    wrapped = documents.withColumn("_wrapped", wrapped_array("text"))
    n_pages = F.ceil(F.size("_wrapped") / F.lit(PAGE_LINES)).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), n_pages - 1),
        lambda page: F.slice("_wrapped", page * PAGE_LINES + 1, PAGE_LINES),
    )
    empty = F.array().cast("array<array<string>>")
    return wrapped.withColumn("page_lines", F.when(n_pages > 0, cut).otherwise(empty)).drop("_wrapped")


def page_blocks(lines: Column) -> Column:
    """Cleaned non-blank blocks of one page with their boxes, in reading order."""
    placed = F.transform(
        lines,
        lambda line, i: F.struct(
            (i + 1).cast("int").alias("line_on_page"),
            tx.clean_spaces(line).alias("text"),
            F.struct(
                F.lit(float(PAGE_LEFT)).alias("x0"),
                (F.lit(PAGE_TOP) + LINE_HEIGHT * i).cast("double").alias("y0"),
                (F.lit(PAGE_LEFT) + CHAR_WIDTH * F.length(line)).cast("double").alias("x1"),
                (F.lit(PAGE_TOP + LINE_HEIGHT) + LINE_HEIGHT * i).cast("double").alias("y1"),
            ).alias("bbox"),
        ),
    )
    return F.filter(placed, lambda b: F.length(b["text"]) > 0)


def with_offsets(blocks: Column) -> Column:
    """Add character spans of each block inside the page text (one space between blocks)."""
    placed = (
        "array<struct<line_on_page:int,text:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>,"
        "char_start:int,char_end:int>>"
    )

    def append(done: Column, b: Column) -> Column:
        start = done["at"]
        end = start + F.length(b["text"])
        block = F.struct(
            b["line_on_page"].alias("line_on_page"),
            b["text"].alias("text"),
            b["bbox"].alias("bbox"),
            start.alias("char_start"),
            end.alias("char_end"),
        )
        return F.struct((end + 1).alias("at"), F.array_append(done["out"], block).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(placed).alias("out"))
    return F.aggregate(blocks, begin, append, lambda done: done["out"])


def page_structs(documents: DataFrame) -> DataFrame:
    """Documents (doc_id, text) as doc_id and ``pages``: number, text and blocks per non-blank page.

    Stages are separate columns so that no step is computed twice.
    """
    numbered = F.transform(
        F.col("placed"), lambda blocks, page: F.struct(page.alias("page_num"), with_offsets(blocks).alias("blocks"))
    )
    texts = F.transform(
        F.filter("numbered", lambda p: F.size(p["blocks"]) > 0),
        lambda p: F.struct(
            p["page_num"].alias("page_num"),
            F.array_join(p["blocks"]["text"], " ").alias("text"),
            p["blocks"].alias("blocks"),
        ),
    )
    return (
        page_arrays(documents.select("doc_id", "text"))
        .select("doc_id", F.transform("page_lines", lambda p: page_blocks(p)).alias("placed"))
        .select("doc_id", numbered.alias("numbered"))
        .select("doc_id", texts.alias("pages"))
    )


def explode_rows(df: DataFrame, array: Column, *keep: str, alias: str = "item", position: str = "pos") -> DataFrame:
    """One row per array element with its position.

    The outer form is used on purpose: a plain explode lets the optimizer add a size filter
    below, which would evaluate the array twice.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(position, alias)).where(F.col(position).isNotNull())


def document_pages(documents: DataFrame) -> DataFrame:
    """One row per non-blank page: text and blocks with spans and boxes; no shuffle."""
    return explode_rows(page_structs(documents), F.col("pages"), "doc_id").select(
        "doc_id", "item.page_num", "item.text", "item.blocks"
    )


def document_blocks(documents: DataFrame) -> DataFrame:
    """One row per layout block, numbered inside its document by wrapped line."""
    flat = F.flatten(
        F.transform("pages", lambda p: F.transform(p["blocks"], lambda b: F.struct(p["page_num"].alias("page_num"), b.alias("b"))))
    )
    return explode_rows(page_structs(documents), flat, "doc_id").select(
        "doc_id",
        "item.page_num",
        (F.col("item.page_num") * PAGE_LINES + F.col("item.b.line_on_page")).cast("long").alias("block_no"),
        F.col("item.b.text").alias("text"),
        F.col("item.b.char_start").alias("char_start"),
        F.col("item.b.char_end").alias("char_end"),
        F.col("item.b.bbox").alias("bbox"),
    )


def pages_from_blocks(blocks: DataFrame) -> DataFrame:
    """Page text from a raw block table (doc_id, page_num, x0, y0, x1, y1, text).

    Blocks are read by y, then x; blank ones go. Only one page's blocks meet in a group.
    """
    ordered = (
        blocks.withColumn("text", tx.clean_spaces("text"))
        .where(F.length("text") > 0)
        .groupBy("doc_id", "page_num")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        F.col("y0").cast("double").alias("y0"),
                        F.col("x0").cast("double").alias("x0"),
                        F.col("block_no").cast("int").alias("line_on_page"),
                        "text",
                        F.struct(*[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]).alias("bbox"),
                    )
                )
            ).alias("placed")
        )
    )
    return ordered.select("doc_id", "page_num", with_offsets(F.col("placed")).alias("blocks")).withColumn(
        "text", F.array_join(F.col("blocks.text"), " ")
    )
