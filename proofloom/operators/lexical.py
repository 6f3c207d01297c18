"""BM25 over the chunks of each document, for many queries at once.

The index holds finished weights: a term's weight in a chunk depends on its document alone, not on a query. They are
written once, in blocks of one term, one document and one run of ``SEGMENT`` chunks, best weight first, with the
highest and lowest weight of the block beside them. The table is partitioned by a hash of the term, so a query set
reads the partitions of its own words, once. Documents are counted whole in one task and their blocks held in packed
pieces (``pieces``); those of very many chunks, or without whole numbers for ids, are counted term by term.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pyspark.sql.types import IntegralType

from proofloom.functions import text as tx
from proofloom.functions.spread import first_rows, is_small, join_checked, long_range, salted_join
from proofloom.operators import pieces as pc
from proofloom.session import checkpoint_root, stored
from proofloom.sources.documents import explode_rows

# Okapi parameters, the floor share for negative idf, digits that decide ranks.
K1 = 1.5
B = 0.75
EPSILON = 0.25
RANK_DIGITS = 9
TOP_K = 15
SEGMENT = 128
TERM_BUCKETS = 64
FILE_BLOCKS = 4_000_000
FILE_CHUNKS = 4_000_000
# Documents within so many chunk numbers are counted whole in one task.
SPAN = 4096
# Bounds are compared with more room than rounding of scores needs.
MARGIN = 1e-6


@dataclass(frozen=True)
class LexicalIndex:
    """Statistics and weights of a chunk table: build once, use for any number of query sets.

    ``impacts``: bucket, term, doc_id, segment, df, lead, top, low, entries (chunk_index, weight); ``lead`` marks the
    first block of a term in its document. ``doc_stats``: doc_id, n_chunks, avg_tokens, mean_idf. ``segments``:
    doc_id, segment, n_segments, members.
    """

    impacts: DataFrame
    doc_stats: DataFrame
    segments: DataFrame
    # Where blocks are packed: the pieces, and the blocks that are not (``impacts`` is both).
    packed: DataFrame | None = None
    loose: DataFrame | None = None

    @property
    def term_stats(self) -> DataFrame:
        names = ["doc_id", "term", "df"]
        if self.packed is None:
            return self.impacts.where("lead").select(*names)
        held = pc.unpacked(self.packed.where("bucket >= 0"), "doc_id long, term string, df long", lead=True)
        held = held.withColumn("doc_id", F.col("doc_id").cast(self.doc_stats.schema["doc_id"].dataType))
        return held if self.loose is None else held.unionByName(self.loose.where("lead").select(*names))

    def of(self, documents: DataFrame) -> LexicalIndex:
        """The same for the named documents only."""
        keep = lambda rows, *spread: join_checked(rows, documents, ["doc_id"], spread, "left_semi")
        return LexicalIndex(keep(self.impacts, "term", "segment"), keep(self.doc_stats, "doc_id"), keep(self.segments, "segment"))

    def write(self, path: str) -> LexicalIndex:
        """Keep the index under ``path`` for later jobs."""
        self.impacts.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/impacts")
        self.doc_stats.write.mode("overwrite").parquet(f"{path}/doc_stats")
        self.segments.write.mode("overwrite").parquet(f"{path}/segments")
        return LexicalIndex.read(self.impacts.sparkSession, path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> LexicalIndex:
        doc_stats, segments = (spark.read.parquet(f"{path}/{name}") for name in ("doc_stats", "segments"))
        key = doc_stats.schema["doc_id"].dataType.simpleString()
        number = segments.schema["members"].dataType.elementType.simpleString()
        # Named, since a table without rows has no partition to read a schema from.
        schema = (
            f"term string, doc_id {key}, segment bigint, df bigint, lead boolean, top double, low double, "
            f"entries array<struct<chunk_index:{number},weight:double>>, bucket int"
        )
        return LexicalIndex(spark.read.schema(schema).parquet(f"{path}/impacts"), doc_stats, segments)


def valid_chunks(chunks: DataFrame) -> DataFrame:
    """Only chunks with text take part in scoring."""
    return chunks.where(tx.is_filled("text"))


def token_table(chunks: DataFrame) -> DataFrame:
    """Distinct terms with frequencies per chunk, counted inside the chunk's own row: no shuffle.

    Sorted tokens stand in runs of one term; a run ends where the next one starts. One sort and one pass a chunk.
    """
    tokens = valid_chunks(chunks).select("doc_id", "chunk_index", F.sort_array(tx.words("text")).alias("_tokens"))
    size = F.size("_tokens")
    # ``get`` gives null before the first token, so the first run starts there.
    new = F.filter(F.transform("_tokens", lambda t, i: F.when(t.eqNullSafe(F.get("_tokens", i - 1)), F.lit(None)).otherwise(i)), lambda i: i.isNotNull())
    runs = tokens.select("doc_id", "chunk_index", size.alias("n_tokens"), "_tokens", new.alias("_starts"))
    counted = F.transform(
        "_starts",
        lambda at, n: F.struct(F.get("_tokens", at).alias("term"), (F.coalesce(F.get("_starts", n + 1), size) - at).alias("tf")),
    )
    return runs.select("doc_id", "chunk_index", "n_tokens", counted.alias("terms"))


def postings_of(tokens: DataFrame) -> DataFrame:
    return explode_rows(tokens, F.col("terms"), "doc_id", "chunk_index", "n_tokens").select(
        "doc_id", "chunk_index", "item.term", "item.tf", "n_tokens"
    )


def document_frequencies(postings: DataFrame) -> DataFrame:
    """Chunks holding each term, per document; counted map-side before the shuffle."""
    return postings.groupBy("doc_id", "term").agg(F.count("*").alias("df"))


def raw_idf(n_chunks: str = "n_chunks", df: str = "df"):
    n, d = F.col(n_chunks), F.col(df)
    return F.log(n - d + 0.5) - F.log(d + 0.5)


def document_lengths(chunk_lengths: DataFrame) -> DataFrame:
    return chunk_lengths.groupBy("doc_id").agg(
        F.count("*").alias("n_chunks"), F.sum("n_tokens").alias("sum_tokens")
    ).select("doc_id", "n_chunks", (F.col("sum_tokens") / F.col("n_chunks")).alias("avg_tokens"))


def document_statistics(chunk_lengths: DataFrame, term_stats: DataFrame) -> DataFrame:
    """Chunks, mean length and mean idf per document.

    Terms are first counted per (document, df): idf depends on df alone, so the join to the
    document size meets few rows per document, whatever its vocabulary.
    """
    sizes = document_lengths(chunk_lengths)
    spectrum = term_stats.groupBy("doc_id", "df").agg(F.count("*").alias("n_terms"))
    mean = (
        join_checked(spectrum, sizes.select("doc_id", "n_chunks"), ["doc_id"], ["df"])
        .groupBy("doc_id")
        .agg((F.sum(raw_idf() * F.col("n_terms")) / F.sum("n_terms")).alias("mean_idf"))
    )
    return sizes.join(mean.hint("merge"), "doc_id", "left")


def term_bucket(term: str = "term"):
    return F.pmod(F.crc32(F.col(term).cast("binary")), F.lit(TERM_BUCKETS)).cast("int")


def counted_blocks(chunks: DataFrame) -> DataFrame:
    """Postings in blocks (doc_id, term, segment, df, lead, entries): one shuffle by document and term."""
    words = valid_chunks(chunks).select("doc_id", "chunk_index", tx.words("text").alias("_words")).withColumn("n_tokens", F.size("_words"))
    rows = explode_rows(words, F.col("_words"), "doc_id", "chunk_index", "n_tokens", alias="term")
    laid = rows.select("doc_id", "chunk_index", "n_tokens", "term").repartition("doc_id", "term")
    counted = laid.groupBy("doc_id", "term", "chunk_index", "n_tokens").agg(F.count("*").alias("tf"))
    blocks = counted.groupBy("doc_id", "term", F.floor(F.col("chunk_index") / SEGMENT).alias("segment")).agg(
        F.collect_list(F.struct("chunk_index", "tf", "n_tokens")).alias("entries")
    )
    term = W.partitionBy("doc_id", "term")
    return blocks.withColumn("df", F.sum(F.size("entries")).over(term)).withColumn("lead", F.col("segment") == F.min("segment").over(term))


def with_weights(blocks: DataFrame, doc_stats: DataFrame) -> DataFrame:
    """Blocks with finished weights, best first, and their bounds."""
    joined = join_checked(blocks, doc_stats, ["doc_id"], ["term", "segment"])
    idf = F.when(raw_idf() < 0, EPSILON * F.col("mean_idf")).otherwise(raw_idf())

    def weight(e):
        length = F.lit(1 - B) + B * e["n_tokens"] / F.col("avg_tokens")
        return F.col("idf") * e["tf"] * (K1 + 1) / (e["tf"] + K1 * length)

    ranked = F.array_sort(F.transform("entries", lambda e: F.struct((-weight(e)).alias("minus"), e["chunk_index"].alias("chunk_index"))))
    entries = F.transform("ranked", lambda e: F.struct(e["chunk_index"].alias("chunk_index"), (-e["minus"]).alias("weight")))
    return (
        joined.withColumn("idf", idf)
        .withColumn("ranked", ranked)
        .withColumn("entries", entries)
        .select(
            term_bucket().alias("bucket"), "term", "doc_id", "segment", "df", "lead",
            F.get("entries", F.lit(0))["weight"].alias("top"), F.element_at("entries", -1)["weight"].alias("low"), "entries",
        )
    )


def build_index(chunks: DataFrame) -> LexicalIndex:
    """Index of ``chunks``, written once to the shared folder."""
    kinds = [chunks.schema[c].dataType for c in ("doc_id", "chunk_index")]
    if not all(isinstance(kind, IntegralType) for kind in kinds):
        return build_by_term(chunks)
    far = chunks.where((F.col("chunk_index") < 0) | (F.col("chunk_index") >= SPAN)).select("doc_id").distinct()
    some = not far.isEmpty()
    near = join_checked(chunks, far, ["doc_id"], ["chunk_index"], "left_anti") if some else chunks
    index = packed_index(near, *kinds)
    if not some:
        return index
    rest = build_by_term(join_checked(chunks, far, ["doc_id"], ["chunk_index"], "left_semi"))
    both = [getattr(index, name).unionByName(getattr(rest, name)) for name in ("impacts", "doc_stats", "segments")]
    return LexicalIndex(*both, index.packed, rest.impacts)


def packed_index(chunks: DataFrame, doc_kind, chunk_kind) -> LexicalIndex:
    """Index of documents that fit a task: a chunk moves once, to its document, and then only packed pieces move."""
    files = max(1, chunks.count() // FILE_CHUNKS)
    held = pc.pieces(valid_chunks(chunks), SEGMENT, TERM_BUCKETS, K1, B, EPSILON)
    path = f"{checkpoint_root(chunks.sparkSession)}/index-{uuid.uuid4().hex}"
    laid = held.repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(files)))
    laid.write.partitionBy("bucket").option("compression", "uncompressed").parquet(path)
    held = chunks.sparkSession.read.schema("doc_id long, piece binary, bucket int").parquet(path)
    doc = F.col("doc_id").cast(doc_kind).alias("doc_id")
    entries = F.col("entries").cast(f"array<struct<chunk_index:{chunk_kind.simpleString()},weight:double>>").alias("entries")
    impacts = pc.unpacked(held.where("bucket >= 0"), pc.BLOCK).select(
        "term", doc, "segment", "df", "lead", "top", "low", entries, term_bucket().alias("bucket")
    )
    stats = pc.unpacked(held.where(F.col("bucket") == pc.STATS), "doc_id long, n_chunks long, avg_tokens double, mean_idf double")
    runs = pc.unpacked(held.where(F.col("bucket") == pc.RUNS), "doc_id long, segment long, n_segments long, members array<int>")
    members = F.col("members").cast(f"array<{chunk_kind.simpleString()}>").alias("members")
    return LexicalIndex(
        impacts, stats.select(doc, "n_chunks", "avg_tokens", "mean_idf"), runs.select(doc, "segment", members, "n_segments"), held,
    )


def build_by_term(chunks: DataFrame) -> LexicalIndex:
    """Index of documents of any size: their words are shuffled by document and term."""
    lengths = stored(valid_chunks(chunks).select("doc_id", "chunk_index", F.size(tx.words("text")).alias("n_tokens")), "lengths")
    blocks = stored(counted_blocks(chunks), "blocks")
    doc_stats = stored(document_statistics(lengths, blocks.where("lead").select("doc_id", "term", "df")), "doc-stats")
    members = lengths.groupBy("doc_id", F.floor(F.col("chunk_index") / SEGMENT).alias("segment")).agg(
        F.array_sort(F.collect_list("chunk_index")).alias("members")
    )
    segments = members.withColumn("n_segments", F.count("*").over(W.partitionBy("doc_id")))
    files = max(1, -(-blocks.count() // (TERM_BUCKETS * FILE_BLOCKS)))
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(files))
    laid = with_weights(blocks, doc_stats).repartition("bucket", spread).sortWithinPartitions("bucket", "term")
    path = f"{checkpoint_root(chunks.sparkSession)}/index-{uuid.uuid4().hex}"
    return LexicalIndex(laid, doc_stats, segments).write(path)


def query_terms(queries: DataFrame) -> DataFrame:
    """Query tokens with multiplicity: a repeated word counts as often as it occurs."""
    return (
        queries.select("query_id", F.explode(tx.words("query")).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("qtf"))
    )


def wanted_blocks(index: LexicalIndex, terms: DataFrame) -> DataFrame:
    """The blocks of the wanted words; only partitions that hold one of them are read."""
    wanted = terms.select("term").distinct()
    buckets = [r[0] for r in wanted.select(term_bucket().alias("b")).distinct().limit(TERM_BUCKETS).collect()]

    def loose(impacts: DataFrame) -> DataFrame:
        return join_checked(impacts.where(F.col("bucket").isin(buckets)).drop("bucket"), wanted, ["term"], ["doc_id", "segment"])

    if index.packed is None or not is_small(wanted):
        return loose(index.impacts)
    held = pc.unpacked(index.packed.where(F.col("bucket").isin(buckets)), pc.BLOCK, wanted=sorted(r[0] for r in wanted.collect()))
    kinds = {f.name: f.dataType for f in index.impacts.schema}
    held = held.select(*[F.col(c).cast(kinds[c]).alias(c) if c in ("doc_id", "entries") else c for c in held.columns])
    return held if index.loose is None else held.unionByName(loose(index.loose))


def term_weights(index: LexicalIndex, terms: DataFrame) -> DataFrame:
    """BM25 weight of every wanted term in every chunk that holds it."""
    return wanted_blocks(index, terms).select("doc_id", "term", F.explode("entries").alias("e")).select(
        "doc_id", "e.chunk_index", "term", "e.weight"
    )


def _asked(blocks: DataFrame, terms: DataFrame) -> DataFrame:
    """Blocks with the queries that want them; the layout of ``blocks`` stays if the words are few."""
    return join_checked(blocks, terms, ["term"], ["doc_id", "segment"])


def _summed(asked: DataFrame) -> DataFrame:
    """Scores per (query, document, segment, chunk)."""
    rows = asked.select("query_id", "doc_id", "segment", "qtf", F.explode("entries").alias("e"))
    return rows.groupBy("query_id", "doc_id", "segment", "e.chunk_index").agg(
        F.round(F.sum(F.col("e.weight") * F.col("qtf")), RANK_DIGITS).alias("score")
    )


def hit_scores(index: LexicalIndex, queries: DataFrame, grouped: bool = False) -> DataFrame:
    """BM25 of every (query, chunk) pair that shares a term, scored document by document (``onepass``, also for
    ``grouped``); documents of very many chunks and very many queries meet by segment."""
    from proofloom.operators import onepass

    asked = queries.select("query_id", "query")
    found = onepass.ranked(asked, index, "hits", 0, grouped=grouped)
    kinds = {"query_id": queries.schema["query_id"].dataType, "doc_id": index.segments.schema["doc_id"].dataType, "chunk_index": index.segments.schema["members"].dataType.elementType}
    if grouped:
        plain = lambda rows: rows.select(*[F.col(c).cast(t) for c, t in (("query_id", "long"), ("doc_id", "long"), ("chunk_index", "int"))], "score")
        if found is None:
            return onepass.as_groups(plain(hits_by_segment(index, queries)), queries, index.segments.select("doc_id").distinct(), "chunk_index")
        rows, far = found
        return rows if far is None else rows.unionByName(onepass.as_groups(plain(hits_by_segment(index.of(far), queries)), queries, far, "chunk_index"))
    if found is None:
        return hits_by_segment(index, queries)
    rows, far = found
    rows = rows.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()], "score")
    return rows if far is None else rows.unionByName(hits_by_segment(index.of(far), queries))


def hits_by_segment(index: LexicalIndex, queries: DataFrame) -> DataFrame:
    """``hit_scores`` for documents of any size and any number of queries; blocks are laid out by segment once."""
    terms = query_terms(queries)
    blocks = wanted_blocks(index, terms).select("doc_id", "segment", "term", "entries").repartition("doc_id", "segment")
    return _summed(_asked(blocks, terms)).select("query_id", "doc_id", "chunk_index", "score")


def open_segments(blocks: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, segment) of long documents that can still hold one of the ``k`` best chunks.

    From block bounds alone: a segment's chunks score at most the sum of its highest weights (words may be
    missing, so no less than 0), and one of them scores at least the best single one plus all negative ones. The
    k-th of these floors, from k segments, is a bar that a segment's ceiling must reach.
    """
    bounds = _asked(blocks.select("doc_id", "segment", "term", "top", "low"), terms).groupBy("query_id", "doc_id", "segment").agg(
        F.sum(F.col("qtf") * F.greatest("top", F.lit(0.0))).alias("most"),
        (F.max(F.col("qtf") * F.col("top")) + F.sum(F.col("qtf") * F.least("low", F.lit(0.0)))).alias("floor"),
    )
    best = first_rows(bounds, ["query_id", "doc_id"], [F.desc("floor")], k, "_r").where(F.col("_r") == k)
    bars = best.select("query_id", "doc_id", F.col("floor").alias("bar"))
    keys = ["query_id", "doc_id"]
    held = salted_join(bounds.select(*keys, "segment", "most"), bars, keys, ["segment"], "left", salts=4)
    shut = (F.col("most") < F.col("bar") - MARGIN) & (F.col("bar") > MARGIN)
    return held.select(*keys, "segment", F.coalesce(~shut, F.lit(True)).alias("open"), F.coalesce(F.col("bar") > MARGIN, F.lit(False)).alias("full"))


def every_pair(left: DataFrame, queries: DataFrame, block: int = 1024) -> DataFrame:
    """Each row of ``left`` with each query id.

    Query ids travel in blocks of at most ``block`` per row and meet ``left`` by block number, so
    the shuffle (or checked broadcast) carries blocks, not pairs.
    """
    ids = queries.select("query_id").distinct()
    n_blocks = max(1, -(-ids.count() // block))
    blocks = ids.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).alias("_block")).agg(
        F.collect_list("query_id").alias("_ids")
    )
    spread = left.withColumn("_block", F.explode(long_range(n_blocks)))
    joined = join_checked(spread, blocks, ["_block"], left.columns, max_rows=1024)
    return joined.withColumn("query_id", F.explode("_ids")).drop("_block", "_ids")


EVERY = ""  # stands for a query's claim on all segments; no token is empty


def bm25_top_k(queries: DataFrame, index: LexicalIndex, k: int = TOP_K, scope: DataFrame | None = None) -> DataFrame:
    """The ``k`` best chunks per (query, document), ties by chunk number; ``best`` is the pair's highest score.

    Documents are scored and ranked whole in one task (``onepass``); those of very many chunks, few or very many queries and a
    ``scope`` (query_id, doc_id: which documents a query asks) go by segments."""
    from proofloom.operators import onepass

    asked = queries.select("query_id", "query")
    found = onepass.ranked(asked, index, "bm25", k) if scope is None else None
    if found is None:
        return with_best(by_segments(queries, index, k, scope))
    rows, far = found
    kinds = [F.col(c).cast(t).alias(c) for c, t in (("query_id", queries.schema["query_id"].dataType), ("doc_id", index.segments.schema["doc_id"].dataType), ("chunk_index", index.segments.schema["members"].dataType.elementType))]
    rows = rows.select(*kinds, "score", "rank", "best")
    return rows if far is None else rows.unionByName(with_best(by_segments(queries, index.of(far), k)))


def with_best(rows: DataFrame) -> DataFrame:
    return rows.withColumn("best", F.max("score").over(W.partitionBy("query_id", "doc_id")))


def by_segments(queries: DataFrame, index: LexicalIndex, k: int = TOP_K, scope: DataFrame | None = None) -> DataFrame:
    """``bm25_top_k`` for documents of any size and any number of queries.

    A chunk without any query term scores 0 and stays eligible, ahead of negative scores: each segment offers its
    ``k`` first chunks without a hit. Wanted blocks move once, to their segment; queries join them there, and
    only k rows per query and segment leave. In documents of more than ``k`` segments, segments whose block
    bounds cannot reach the k-th best floor are skipped unread. ``scope`` (query_id, doc_id) limits which
    documents a query asks.
    """
    terms = query_terms(queries)
    claims = terms.unionByName(queries.select("query_id", F.lit(EVERY).alias("term"), F.lit(0).cast("long").alias("qtf")).distinct())
    blocks = wanted_blocks(index, terms).select("doc_id", "segment", "term", "top", "low", "entries")
    entry = "array<struct<chunk_index:int,weight:double>>"
    whole = index.segments.select("doc_id", "segment", F.lit(EVERY).alias("term"), F.expr("array(struct(-1 AS chunk_index, 0D AS weight))").cast(entry).alias("entries"))
    laid = blocks.select("doc_id", "segment", "term", F.col("entries").cast(entry).alias("entries")).unionByName(whole).repartition("doc_id", "segment")
    asked = _asked(laid, claims)
    if scope is not None:
        asked = join_checked(asked, scope.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], ["segment", "term"], "left_semi")
    long = index.segments.where(F.col("n_segments") > k).select("doc_id").distinct()
    if not long.isEmpty():
        some = join_checked(blocks, long, ["doc_id"], ["segment", "term"], "left_semi")
        marked = stored(open_segments(some, terms, k), "open-segments")
        shut = marked.where(~F.col("open")).select("query_id", "doc_id", "segment")
        full = marked.where("full").select("query_id", "doc_id").distinct()
        met = marked.select("query_id", "doc_id", "segment")
        asked = join_checked(asked, shut, ["query_id", "doc_id", "segment"], ["term"], "left_anti")
        # Where k segments have a chunk above 0, segments without any hit offer nothing.
        idle = join_checked(asked.where(F.col("term") == EVERY).select("query_id", "doc_id", "segment"), full, ["query_id", "doc_id"], ["segment"], "left_semi")
        idle = idle.join(met.hint("merge"), ["query_id", "doc_id", "segment"], "left_anti")
        asked = join_checked(asked, idle, ["query_id", "doc_id", "segment"], ["term"], "left_anti")
    hits = _summed(asked).groupBy("query_id", "doc_id", "segment").agg(F.collect_list(F.struct("chunk_index", "score")).alias("hits"))
    free = F.slice(F.array_except("members", F.col("hits.chunk_index")), 1, k)
    offers = F.concat(
        F.filter("hits", lambda h: h["chunk_index"] >= 0),
        F.transform(free, lambda c: F.struct(c.alias("chunk_index"), F.lit(0.0).alias("score"))),
    )
    found = hits.join(index.segments.select("doc_id", "segment", "members").hint("merge"), ["doc_id", "segment"])
    flat = found.select("query_id", "doc_id", F.explode(offers).alias("o")).select("query_id", "doc_id", "o.*")
    return first_rows(flat, ["query_id", "doc_id"], [F.desc("score"), F.asc("chunk_index")], k)
