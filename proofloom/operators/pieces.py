"""The lexical index document by document, held as packed pieces.

A document's chunks move to one task once; there its words are counted and weighed in numpy. What leaves the task are
pieces: for each bucket of terms one compressed Arrow table of the blocks of a batch of documents. Only pieces are
shuffled and written, and a query set unpacks the blocks of its own words from the buckets that hold them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofloom.functions import text as tx

# Buckets below 0 hold the documents' statistics and the runs of their chunks.
STATS, RUNS = -1, -2
PIECE = "bucket int, doc_id long, piece binary"
BLOCK = "term string, doc_id long, segment long, df long, lead boolean, top double, low double, entries array<struct<chunk_index:int,weight:double>>"
WORDS = 400_000  # words weighed at once, at least one document


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _lists(values: dict[str, pa.Array] | pa.Array, starts: np.ndarray, size: int) -> pa.ListArray:
    held = pa.StructArray.from_arrays(list(values.values()), names=list(values)) if isinstance(values, dict) else values
    return pa.ListArray.from_arrays(pa.array(np.r_[starts, size].astype(np.int32)), held)


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys starts."""
    if not len(keys[0]):
        return np.zeros(0, dtype=np.int64)
    change = np.zeros(len(keys[0]), dtype=bool)
    change[0] = True
    for key in keys:
        change[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(change)


def _weighed(table: pa.Table, segment: int, buckets: int, k1: float, b: float, epsilon: float) -> Iterator[tuple[int, int, bytes]]:
    """Pieces of whole documents, whose rows come in document and chunk order."""
    docs, chunk = table["doc_id"].to_numpy(), table["chunk_index"].to_numpy().astype(np.int64)
    words = table["words"].combine_chunks()
    length = np.diff(words.offsets.to_numpy()).astype(np.int64)
    ids, doc = np.unique(docs, return_inverse=True)
    n_chunks = np.bincount(doc, minlength=len(ids))
    mean_length = np.bincount(doc, weights=length, minlength=len(ids)) / n_chunks
    coded = words.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    terms = coded.dictionary.take(pa.array(order))
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    size = max(1, len(terms))
    code = place[coded.indices.to_numpy()].astype(np.int64)
    # Distinct words of every chunk with their counts, then by document and word.
    key, tf = np.unique(np.repeat(np.arange(len(length)), length) * size + code, return_counts=True)
    row, term = key // size, key % size
    order = np.lexsort((row, term, doc[row]))
    row, term, tf = row[order], term[order], tf[order]
    of = doc[row]
    first = _firsts(of, term)
    df = np.diff(np.r_[first, len(row)])
    raw = np.log(n_chunks[of[first]] - df + 0.5) - np.log(df + 0.5)
    n_terms = np.bincount(of[first], minlength=len(ids))
    mean_idf = np.bincount(of[first], weights=raw, minlength=len(ids)) / np.maximum(n_terms, 1)
    idf = np.repeat(np.where(raw < 0, epsilon * mean_idf[of[first]], raw), df)
    weight = idf * tf * (k1 + 1) / (tf + k1 * ((1 - b) + b * length[row] / mean_length[of]))
    df = np.repeat(df, df)
    run = chunk[row] // segment
    order = np.lexsort((chunk[row], -weight, run, term, of))
    row, term, of, df, run, weight = (x[order] for x in (row, term, of, df, run, weight))
    first = _firsts(of, term, run)
    lead = np.zeros(len(first), dtype=bool)
    lead[np.searchsorted(first, _firsts(of, term))] = True
    blocks = pa.table(
        {
            "term": pa.array(term[first], pa.int32()), "doc_id": pa.array(ids[of[first]], pa.int64()), "segment": pa.array(run[first], pa.int64()),
            "df": pa.array(df[first], pa.int64()), "lead": pa.array(lead),
            "entries": _lists({"chunk_index": pa.array(chunk[row], pa.int32()), "weight": pa.array(weight)}, first, len(row)),
        }
    )
    bucket = np.array([zlib.crc32(t.encode()) % buckets for t in terms.to_pylist()], dtype=np.int64)[term[first]] if len(first) else first
    order = np.argsort(bucket, kind="stable")
    blocks, bucket = blocks.take(pa.array(order)), bucket[order]
    cuts = _firsts(bucket)
    for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)]):
        part = blocks.slice(a, z - a)
        own, at = np.unique(part["term"].to_numpy(), return_inverse=True)
        named = pa.DictionaryArray.from_arrays(pa.array(at, pa.int32()), terms.take(pa.array(own)))
        yield int(bucket[a]), int(ids[0]), _packed(part.set_column(0, "term", named))
    none = n_terms == 0
    stats = {"doc_id": pa.array(ids, pa.int64()), "n_chunks": pa.array(n_chunks, pa.int64()), "avg_tokens": pa.array(mean_length), "mean_idf": pa.array(mean_idf, mask=none)}
    yield STATS, int(ids[0]), _packed(pa.table(stats))
    run = chunk // segment
    order = np.lexsort((chunk, run, doc))
    first = _firsts(doc[order], run[order])
    owner = doc[order][first]
    runs = {
        "doc_id": pa.array(ids[owner], pa.int64()), "segment": pa.array(run[order][first], pa.int64()),
        "n_segments": pa.array(np.bincount(owner, minlength=len(ids))[owner], pa.int64()),
        "members": _lists(pa.array(chunk[order], pa.int32()), first, len(order)),
    }
    yield RUNS, int(ids[0]), _packed(pa.table(runs))


def _steps(table: pa.Table) -> Iterator[pa.Table]:
    """Whole documents of about WORDS words."""
    docs = table["doc_id"].to_numpy()
    starts = np.r_[_firsts(docs), len(docs)]
    total = np.r_[0, np.cumsum(np.diff(table["words"].combine_chunks().offsets.to_numpy()))]
    a = 0
    while a < len(starts) - 1:
        z = max(a + 1, int(np.searchsorted(total[starts], total[starts[a]] + WORDS, "right")) - 1)
        yield table.slice(starts[a], starts[z] - starts[a])
        a = z


def pieces(chunks: DataFrame, segment: int, buckets: int, k1: float, b: float, epsilon: float) -> DataFrame:
    """(bucket, doc_id, piece) of chunks with text: doc_id and chunk_index whole numbers, documents that fit a task."""
    from proofloom.operators.onepass import _whole_documents

    rows = chunks.select(F.col("doc_id").cast("long"), F.col("chunk_index").cast("int"), "text").repartition("doc_id").sortWithinPartitions("doc_id", "chunk_index")

    def weighed(batches):
        held, rows = [], 0
        for table in _whole_documents(batches):
            held.append(table)
            rows += table.num_rows
            if rows >= 10_000:
                yield from put(pa.concat_tables(held))
                held, rows = [], 0
        if held:
            yield from put(pa.concat_tables(held))

    def put(table):
        for step in _steps(table):
            for bucket, doc, piece in _weighed(step, segment, buckets, k1, b, epsilon):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([doc], pa.int64()), pa.array([piece], pa.binary())], names=["bucket", "doc_id", "piece"])

    return rows.select("doc_id", "chunk_index", tx.words("text").alias("words")).mapInArrow(weighed, PIECE)


def unpacked(held: DataFrame, schema: str, wanted: list[str] | None = None, lead: bool = False) -> DataFrame:
    """The rows of pieces; of blocks only those of ``wanted`` terms, or the first ones of their term and document."""
    names = [f.strip().split(" ")[0] for f in schema.replace("struct<chunk_index:int,weight:double>", "struct").split(",")]
    shared = held.sparkSession.sparkContext.broadcast(wanted) if wanted is not None else None

    def rows(batches):
        known = pa.array(shared.value, pa.string()) if shared is not None else None
        for batch in batches:
            for piece in batch.column("piece"):
                table = pa.ipc.open_stream(piece.as_buffer()).read_all()
                if "term" in table.column_names:
                    # Terms are numbered inside the piece, in document order; only numbers are compared.
                    term = table["term"].combine_chunks()
                    if known is not None:
                        table = table.filter(pc.is_in(term.dictionary, value_set=known).take(term.indices))
                    table = table.set_column(0, "term", table["term"].cast(pa.string()))
                if lead:
                    table = table.filter(table["lead"])
                if not table.num_rows:
                    continue
                if "top" in names:
                    entries = table["entries"].combine_chunks()
                    weight = entries.flatten().field("weight").to_numpy(zero_copy_only=False)
                    ends = np.cumsum(np.diff(entries.offsets.to_numpy()))
                    table = table.append_column("top", pa.array(weight[np.r_[0, ends[:-1]]])).append_column("low", pa.array(weight[ends - 1]))
                yield from table.select(names).to_batches(max_chunksize=16_384)

    return held.select("piece").mapInArrow(rows, schema)
