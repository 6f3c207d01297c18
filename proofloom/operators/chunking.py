"""Sentence-group chunks with page position and boxes."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from proofloom.functions import text as tx
from proofloom.functions.spread import join_checked, running_offset
from proofloom.session import stored
from proofloom.sources import documents as src

# Share of a block that must overlap, and blocks kept per chunk.
OVERLAP_FLOOR = 0.05
BLOCKS_KEPT = 5

Chunker = Callable[[DataFrame], DataFrame]


def sentence_groups(sentences: Column, size: int = tx.SENTENCES_PER_CHUNK) -> Column:
    """Groups of ``size`` sentences with their character span inside the page text."""

    def named(known: Column) -> Column:
        parts, lengths = known["parts"], known["lengths"]

        def part(at: Column) -> Column:
            before = F.aggregate(F.slice(lengths, F.lit(1), at * size), at * size, lambda total, n: total + n)
            body = F.array_join(F.slice(parts, at * size + 1, size), " ")
            return F.struct(body.alias("text"), before.alias("char_start"))

        last = F.floor((F.size(parts) - 1) / F.lit(size)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), part)

    def group(g: Column) -> Column:
        return F.struct(g["text"], g["char_start"], (g["char_start"] + F.length(g["text"])).alias("char_end"))

    # Sentences, texts and starts are each named, since every mention inside a lambda would make them again.
    measured = F.transform(F.array(sentences), lambda s: F.struct(s.alias("parts"), F.transform(s, F.length).alias("lengths")))
    return F.transform(F.flatten(F.transform(measured, named)), group)


def long_enough(text: Column, minimum: int = tx.MIN_CHUNK_CHARS) -> Column:
    """Whether the comparison form has ``minimum`` characters; the start of a text mostly shows it already."""
    start = F.length(tx.normalize(F.substring(text, 1, 2 * minimum))) >= minimum
    return start | (F.length(tx.normalize(text)) >= minimum)


def chunk_boxes(blocks: Column, start: Column, end: Column) -> Column:
    """Boxes of the blocks a chunk covers best; else of the block holding its start."""

    def overlap(b: Column) -> Column:
        return F.least(b["char_end"], end) - F.greatest(b["char_start"], start)

    def wanted(b: Column) -> Column:
        # A share of the block above the floor is above 0 too: no block is shorter than 0.
        return overlap(b) > OVERLAP_FLOOR * (b["char_end"] - b["char_start"])

    ranked = F.array_sort(
        F.transform(
            F.filter(blocks, wanted),
            lambda b: F.struct(
                (-overlap(b)).alias("rank"), b["line_on_page"].alias("line_on_page"), b["bbox"].alias("bbox")
            ),
        )
    )
    holding = F.filter(blocks, lambda b: (b["char_start"] <= start) & (start < b["char_end"]))
    first = F.transform(F.slice(holding, 1, 1), lambda b: b["bbox"])
    # An array of one names the ranked blocks, which would be made twice otherwise.
    named = F.transform(F.array(F.transform(F.slice(ranked, 1, BLOCKS_KEPT), lambda r: r["bbox"])), lambda best: F.when(F.size(best) > 0, best).otherwise(first))
    return F.get(named, F.lit(0))


def chunk_spans(blocks: Column, start: Column, end: Column) -> Column:
    """All blocks a chunk touches, in reading order, with their spans counted from the chunk's first character."""
    touched = F.filter(blocks, lambda b: (b["char_end"] > start) & (b["char_start"] < end))
    return F.transform(
        touched,
        lambda b: F.struct((b["char_start"] - start).alias("start"), (b["char_end"] - start).alias("stop"), b["bbox"].alias("bbox")),
    )


def _finish(numbered: DataFrame) -> DataFrame:
    return numbered.select(
        "doc_id",
        F.col("chunk_index").cast("int").alias("chunk_index"),
        F.concat(F.lit("chunk_"), F.col("chunk_index").cast("string")).alias("chunk_id"),
        F.col("page_num").cast("int").alias("page_num"),
        "text",
        "char_start",
        "char_end",
        "bboxes",
        "spans",
    )


def chunks_from_documents(
    documents: DataFrame, size: int = tx.SENTENCES_PER_CHUNK, minimum: int = tx.MIN_CHUNK_CHARS
) -> DataFrame:
    """Chunks of text documents. Everything happens inside the document's own row: no shuffle."""
    split = F.transform("pages", lambda p: tx.sentence_array(p["text"]))

    def placed(p: Column, g: Column) -> Column:
        # Few of a page's blocks lie near a group; an array of one names them for both uses.
        near = F.filter(p["blocks"], lambda b: (b["char_end"] > g["char_start"]) & (b["char_start"] <= g["char_end"]))
        row = F.transform(
            F.array(near),
            lambda blocks: F.struct(
                p["page_num"].alias("page_num"),
                g["text"].alias("text"),
                g["char_start"].alias("char_start"),
                g["char_end"].alias("char_end"),
                chunk_boxes(blocks, g["char_start"], g["char_end"]).alias("bboxes"),
                chunk_spans(blocks, g["char_start"], g["char_end"]).alias("spans"),
            ),
        )
        return F.get(row, F.lit(0))

    staged = src.page_structs(documents).select("doc_id", "pages", split.alias("sentences"))
    grouped = F.flatten(
        F.zip_with(
            "pages",
            "sentences",
            lambda p, s: F.transform(
                F.filter(sentence_groups(s, size), lambda g: long_enough(g["text"], minimum)),
                lambda g: placed(p, g),
            ),
        )
    )
    rows = src.explode_rows(staged, grouped, "doc_id", position="chunk_index")
    return _finish(rows.select("doc_id", "chunk_index", "item.*"))


def page_sentences(pages: DataFrame) -> DataFrame:
    """One row per sentence with its character span; ``sent_no`` counts from 1 on each page."""
    split = pages.select("doc_id", "page_num", tx.sentence_array("text").alias("_s"))
    numbered = F.transform(
        F.col("_s"),
        lambda s, i: F.struct(
            F.when(i > 0, F.length(F.array_join(F.slice("_s", F.lit(1), i), " ")) + 1)
            .otherwise(F.lit(0))
            .alias("char_start"),
            s.alias("text"),
        ),
    )
    return (
        src.explode_rows(split, numbered, "doc_id", "page_num")
        .select(
            "doc_id",
            "page_num",
            (F.col("pos") + 1).alias("sent_no"),
            "item.text",
            "item.char_start",
            (F.col("item.char_start") + F.length("item.text")).alias("char_end"),
        )
        .where(F.length("text") > 0)
    )


def chunks_from_pages(
    pages: DataFrame, size: int = tx.SENTENCES_PER_CHUNK, minimum: int = tx.MIN_CHUNK_CHARS
) -> DataFrame:
    """Chunks of a page table (doc_id, page_num, text, blocks).

    Numbering runs over a document's pages through a two-step offset of small per-page counts.
    """
    split = pages.select("doc_id", "page_num", "blocks", tx.sentence_array("text").alias("_s"))
    groups = F.filter(sentence_groups(F.col("_s"), size), lambda g: long_enough(g["text"], minimum))
    kept = split.select("doc_id", "page_num", "blocks", groups.alias("_kept")).withColumn("_n", F.size("_kept"))
    placed = running_offset(kept, "doc_id", "page_num", "_n", "_offset")
    rows = src.explode_rows(placed, F.col("_kept"), "doc_id", "page_num", "blocks", "_offset")
    return _finish(
        rows.select(
            "doc_id",
            "page_num",
            (F.col("_offset") + F.col("pos")).alias("chunk_index"),
            "item.text",
            "item.char_start",
            "item.char_end",
            chunk_boxes(F.col("blocks"), F.col("item.char_start"), F.col("item.char_end")).alias("bboxes"),
            chunk_spans(F.col("blocks"), F.col("item.char_start"), F.col("item.char_end")).alias("spans"),
        )
    )


def chunks_from_blocks(blocks: DataFrame, **options: int) -> DataFrame:
    """Chunks of a raw layout-block table."""
    return chunks_from_pages(src.pages_from_blocks(blocks), **options)


def block_overlaps(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Chunk spans against block spans of the same page: shared characters per pair that overlap."""
    b = blocks.select(
        "doc_id", "page_num", "block_no", F.col("char_start").alias("b_start"), F.col("char_end").alias("b_end"), "bbox"
    )
    shared = F.least("char_end", "b_end") - F.greatest("char_start", "b_start")
    return (
        chunks.select("doc_id", "page_num", "chunk_index", "char_start", "char_end")
        .join(b, ["doc_id", "page_num"])
        .where(shared > 0)
        .withColumn("overlap", shared)
    )


def wide_overlaps(overlaps: DataFrame, floor: float = OVERLAP_FLOOR) -> DataFrame:
    """Pairs that share more than ``floor`` of the block."""
    return overlaps.where(F.col("overlap") > floor * (F.col("b_end") - F.col("b_start")))


def best_blocks(overlaps: DataFrame, n: int = BLOCKS_KEPT) -> DataFrame:
    """The ``n`` widest overlaps per chunk, ties in reading order. A chunk meets one page at most."""
    window = W.partitionBy("doc_id", "chunk_index").orderBy(F.desc("overlap"), "block_no")
    return overlaps.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)


def holding_blocks(chunks: DataFrame, blocks: DataFrame, matched: DataFrame) -> DataFrame:
    """For chunks without a wide overlap: the block that holds the chunk's first character."""
    bare = chunks.select("doc_id", "page_num", "chunk_index", "char_start").join(
        matched.select("doc_id", "chunk_index").distinct(), ["doc_id", "chunk_index"], "left_anti"
    )
    b = blocks.select(
        "doc_id", "page_num", "block_no", F.col("char_start").alias("b_start"), F.col("char_end").alias("b_end"), "bbox"
    )
    return bare.join(b, ["doc_id", "page_num"]).where(
        (F.col("b_start") <= F.col("char_start")) & (F.col("char_start") < F.col("b_end"))
    )


def union_box(boxes: Column) -> Column:
    """Smallest box around an array of boxes; null for none."""

    def side(name: str, pick) -> Column:
        return pick(F.transform(boxes, lambda b: b[name])).alias(name)

    return F.when(
        F.size(boxes) > 0,
        F.struct(
            side("x0", F.array_min), side("y0", F.array_min), side("x1", F.array_max), side("y1", F.array_max)
        ),
    )


def box_is_filled(box: Column) -> Column:
    return F.coalesce((box["x1"] > box["x0"]) & (box["y1"] > box["y0"]), F.lit(False))


def boxes_meet(a: Column, b: Column) -> Column:
    """Whether two boxes share an area."""
    across = (a["x0"] < b["x1"]) & (b["x0"] < a["x1"])
    return F.coalesce(across & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"]), F.lit(False))


@F.pandas_udf(BooleanType())
def may_pair(doc: pd.Series, index: pd.Series, page: pd.Series, gap: pd.Series) -> pd.Series:
    """False where a neighbouring row of the batch is the chunk beside this one, on another page than ``gap`` asks.

    The neighbour is the next chunk for a gap above 0, else the one before. Rows whose neighbour is not beside them in
    the batch are let through, so the order of rows decides what is saved, not what is found.
    """
    step = -1 if len(gap) and gap.iloc[0] > 0 else 1
    beside = (doc == doc.shift(step)) & (index - step == index.shift(step))
    return ~(beside & (page.shift(step) - page != gap))


def next_page_pairs(chunks: DataFrame, page_gap: int = 1) -> DataFrame:
    """Neighbouring chunks where the second starts the next page, with their joined text.

    Each chunk is sent to its own position and to its predecessor's, so the pair meets on
    (doc_id, position) and no document has to sit in one task. Positions and pages meet first; texts
    and boxes follow only for the chunks at a page break. Chunks whose neighbour stands beside them on the
    wrong page are left out before anything moves.
    """
    here = chunks.select("doc_id", "chunk_index", F.col("page_num").alias("page_a"))
    there = chunks.select("doc_id", (F.col("chunk_index") - 1).alias("chunk_index"), F.col("page_num").alias("page_b"))
    breaks = here.join(there.hint("merge"), ["doc_id", "chunk_index"]).where(F.col("page_b") - F.col("page_a") == page_gap)
    at = stored(breaks.select("doc_id", "chunk_index").distinct(), "breaks")
    a = chunks.select(
        "doc_id",
        "chunk_index",
        F.col("page_num").alias("page_a"),
        F.col("text").alias("text_a"),
        F.col("bboxes").alias("bboxes_a"),
    )
    b = chunks.select(
        "doc_id",
        (F.col("chunk_index") - 1).alias("chunk_index"),
        F.col("page_num").alias("page_b"),
        F.col("text").alias("text_b"),
        F.col("bboxes").alias("bboxes_b"),
    )
    a, b = a.where(may_pair("doc_id", "chunk_index", "page_a", F.lit(page_gap))), b.where(may_pair("doc_id", "chunk_index", "page_b", F.lit(-page_gap)))
    a, b = (join_checked(side, at, ["doc_id", "chunk_index"], ["chunk_index"], "left_semi") for side in (a, b))
    return (
        a.join(b.hint("merge"), ["doc_id", "chunk_index"])
        .where(F.col("page_b") - F.col("page_a") == page_gap)
        .where(tx.is_filled("text_a") & tx.is_filled("text_b"))
        .withColumn("text", F.concat_ws(" ", "text_a", "text_b"))
    )


def document_text(chunks: DataFrame) -> DataFrame:
    """A document's chunks joined by blank lines; a document was one row before, so it fits one."""
    return chunks.groupBy("doc_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda c: c["text"]), "\n\n"
        ).alias("full_text")
    )


def document_counts(chunks: DataFrame) -> DataFrame:
    """Chunks and distinct pages per document, counted before the shuffle."""
    per_page = chunks.groupBy("doc_id", "page_num").agg(F.count("*").alias("n"))
    return per_page.groupBy("doc_id").agg(
        F.count("*").alias("n_pages"), F.sum("n").alias("n_chunks")
    )


def ingest_report(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Status and message per document from its chunk counts."""
    counts = chunks.groupBy("doc_id").agg(
        F.count("*").alias("n_chunks"), F.count_if(tx.is_filled("text")).alias("n_valid")
    )
    return (
        documents.select("doc_id")
        .join(counts, "doc_id", "left")
        .select(
            "doc_id",
            F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"),
            tx.ingest_status("n_chunks", "n_valid").alias("status"),
            tx.ingest_message("n_chunks", "n_valid").alias("message"),
        )
    )


def run_chunker(chunker: Chunker, documents: DataFrame) -> DataFrame:
    """Apply any chunker and check that it keeps the chunk contract."""
    out = chunker(documents)
    missing = {"doc_id", "chunk_index", "chunk_id", "page_num", "text", "bboxes"} - set(out.columns)
    if missing:
        raise ValueError(f"chunker output lacks {sorted(missing)}")
    return out
