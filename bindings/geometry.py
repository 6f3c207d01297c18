"""Chunks, their position and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import tables as tb
from bindings.registry import Group
from proofloom.operators import chunking as ch
from proofloom.sources import documents as src

GROUP = Group()
query = GROUP.query
QUERIES, ORACLES = GROUP.queries, GROUP.oracles


@query("p01_build_chunks", """
SELECT c.doc_id, c.chunk_index, 'chunk_' || c.chunk_index AS chunk_id, c.page_num, c.text, c.char_start, c.char_end,
       CAST(coalesce(b.n_boxes, 0) AS INTEGER) AS n_boxes, b.x0, b.y0, b.x1, b.y1
FROM t_chunks c LEFT JOIN t_boxes b ON b.doc_id = c.doc_id AND b.chunk_index = c.chunk_index""")
def p01(spark, d):
    rows = tb.fresh_chunks(spark, d).withColumn("n_boxes", F.size("bboxes")).withColumn("box", ch.union_box(F.col("bboxes")))
    return rows.select("doc_id", "chunk_index", "chunk_id", "page_num", "text", "char_start", "char_end", "n_boxes", "box.*")


@query("p01_chunks_from_blocks", "SELECT doc_id, chunk_index, page_num, text, char_start, char_end FROM t_chunks")
def p01_blocks(spark, d):
    raw = tb.blocks(spark, d).select("doc_id", "page_num", "block_no", "text", "bbox.*")
    return ch.chunks_from_blocks(raw).select("doc_id", "chunk_index", "page_num", "text", "char_start", "char_end")


@query("m05_chunker", """
SELECT doc_id, chunk_index, page_num, text FROM (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_num, sent_no) - 1 AS INTEGER) AS chunk_index, page_num, text
  FROM t_sentences WHERE length(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) >= 20)""")
def m05(spark, d):
    """A chunker of one sentence per chunk in place of the default."""
    by_sentence = lambda docs: ch.chunks_from_documents(docs, size=1, minimum=20)
    return ch.run_chunker(by_sentence, tb.documents(spark, d)).select("doc_id", "chunk_index", "page_num", "text")


@query("a01_sentence_groups", "SELECT doc_id, page_num, CAST(g AS INTEGER) AS g, text, char_start, char_end FROM t_groups")
def a01(spark, d):
    from proofloom.functions import text as tx

    split = tb.pages(spark, d).select("doc_id", "page_num", tx.sentence_array("text").alias("s"))
    return src.explode_rows(split, ch.sentence_groups(F.col("s")), "doc_id", "page_num", position="g").select("doc_id", "page_num", "g", "item.*")


@query("w01_chunk_numbers", "SELECT doc_id, count(*) AS n, max(chunk_index) AS last_index FROM t_chunks GROUP BY doc_id")
def w01(spark, d):
    return tb.chunks(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("chunk_index").alias("last_index"))


def _overlaps(spark, d):
    return ch.block_overlaps(tb.chunks(spark, d), tb.blocks(spark, d))


@query("j01_block_overlap", "SELECT doc_id, chunk_index, block_no, CAST(overlap AS INTEGER) AS overlap FROM t_overlaps")
def j01(spark, d):
    return _overlaps(spark, d).select("doc_id", "chunk_index", "block_no", "overlap")


@query("f04_wide_overlap", "SELECT doc_id, chunk_index, block_no FROM t_overlaps WHERE overlap > 0.05 * block_length")
def f04(spark, d):
    return ch.wide_overlaps(_overlaps(spark, d)).select("doc_id", "chunk_index", "block_no")


@query("w06_best_blocks", "SELECT doc_id, chunk_index, block_no, CAST(overlap AS INTEGER) AS overlap, rank FROM t_best_blocks")
def w06(spark, d):
    return ch.best_blocks(ch.wide_overlaps(_overlaps(spark, d))).select("doc_id", "chunk_index", "block_no", "overlap", "rank")


@query("j02_point_in_block", """
SELECT c.doc_id, c.chunk_index, b.block_no FROM t_chunks c JOIN t_blocks b ON b.doc_id = c.doc_id AND b.page_num = c.page_num
WHERE b.char_start <= c.char_start AND c.char_start < b.char_end
  AND NOT EXISTS (SELECT 1 FROM t_overlaps o WHERE o.doc_id = c.doc_id AND o.chunk_index = c.chunk_index AND o.overlap >= 0.999 * o.block_length)""")
def j02(spark, d):
    """Chunks that cover no block whole fall back to the block holding their start."""
    chunks, blocks = tb.chunks(spark, d), tb.blocks(spark, d)
    whole = ch.block_overlaps(chunks, blocks).where(F.col("overlap") >= 0.999 * (F.col("b_end") - F.col("b_start")))
    return ch.holding_blocks(chunks, blocks, whole).select("doc_id", "chunk_index", "block_no")


@query("a09_union_box", "SELECT doc_id, chunk_index, x0, y0, x1, y1 FROM t_boxes")
def a09(spark, d):
    boxed = tb.chunks(spark, d).select("doc_id", "chunk_index", ch.union_box(F.col("bboxes")).alias("box"))
    return boxed.where(F.col("box").isNotNull()).select("doc_id", "chunk_index", "box.*")


@query("f11_filled_box", "SELECT doc_id, chunk_index, page_num FROM t_boxes WHERE page_num >= 0 AND x1 > x0 AND y1 > y0")
def f11(spark, d):
    rows = tb.chunks(spark, d).where((F.col("page_num") >= 0) & ch.box_is_filled(ch.union_box(F.col("bboxes"))))
    return rows.select("doc_id", "chunk_index", "page_num")


PAIRS = """SELECT a.doc_id, a.chunk_index, a.page_num AS page_a, b.page_num AS page_b, a.text || ' ' || b.text AS text
FROM t_chunks a JOIN t_chunks b ON b.doc_id = a.doc_id AND b.chunk_index = a.chunk_index + 1 WHERE b.page_num = a.page_num + 1"""


@query("j08_cross_page", PAIRS)
def j08(spark, d):
    return ch.next_page_pairs(tb.chunks(spark, d)).select("doc_id", "chunk_index", "page_a", "page_b", "text")


@query("w09_next_chunk", """
SELECT doc_id, chunk_index, page_num, next_page FROM (
  SELECT doc_id, chunk_index, page_num, lead(page_num) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS next_page FROM t_chunks)""")
def w09(spark, d):
    """The next chunk's page by an equi join on position, so no document sits in one task."""
    chunks = tb.chunks(spark, d)
    following = chunks.select("doc_id", (F.col("chunk_index") - 1).alias("chunk_index"), F.col("page_num").alias("next_page"))
    return chunks.select("doc_id", "chunk_index", "page_num").join(following, ["doc_id", "chunk_index"], "left")


@query("a03_document_text", "SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY chunk_index) AS full_text FROM t_chunks GROUP BY doc_id")
def a03(spark, d):
    return ch.document_text(tb.chunks(spark, d))


@query("a24_counts", "SELECT doc_id, count(DISTINCT page_num) AS n_pages, count(*) AS n_chunks FROM t_chunks GROUP BY doc_id")
def a24(spark, d):
    return ch.document_counts(tb.chunks(spark, d))
