"""Near-duplicates by one-permutation hashing.

One hash of every shingle gives a whole signature: its high bits choose a bin, and each bin keeps its least
hash. Empty bins borrow from a bin that a fixed random order of their own names first, so that equal sets
borrow alike and unequal ones independently (optimal densification). Bands of bins make the buckets. Each
bucket yields a star, its members against the smallest one, never all pairs. Candidates are confirmed on the
full sets. Where a bucket still holds several components after that, its members are compared in tiles of bounded
size, and only links that join components leave a tile.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.llm.components import components
from proofloom.llm.tables import joined, mapped, release, stored

BANDS, ROWS = 40, 5
BROADCAST_IDS = 2_000_000
TILE, COLUMNS = 512, 4096
FEATURES = "struct<n:int,hi:bigint,lo:bigint,bands:array<bigint>>"


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, words: int = 2) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; with fewer words the whole sequence is one shingle.

    A-Z are lower-cased and words are parted by ASCII white space; null and blank texts give none."""
    found = text.encode().lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    each = mixed(np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)))
    size = min(words, len(found))
    out = np.full(len(found) - size + 1, size, np.uint64)
    for k in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + each[k : len(found) - size + 1 + k])
    return np.unique(out)


class Signatures:
    """Band keys of hash sets."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 7):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        order = np.random.default_rng(seed)
        self.lenders = np.stack([order.permutation(self.bins) for _ in range(self.bins)])
        self.places = mixed(np.arange(1, bands + 1, dtype=np.uint64))

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """The least hash of every bin, for a sorted set that is not empty."""
        bins = ((hashes >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(bins, prepend=-1))
        full = np.zeros(self.bins, bool)
        full[bins[first]] = True
        out = np.zeros(self.bins, np.uint64)
        out[bins[first]] = hashes[first]
        empty = np.flatnonzero(~full)
        turn = 0
        while len(empty):
            lender = self.lenders[empty, turn]
            able = full[lender]
            out[empty[able]] = out[lender[able]]
            empty = empty[~able]
            turn += 1
        return out

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        rows = self.signature(hashes).reshape(self.bands, self.rows)
        key = self.places
        for k in range(self.rows):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
        return key


def features(text: Column, words: int, bands: int, rows: int) -> Column:
    """(n, hi, lo, bands): the size of the shingle set, a 128-bit mark of it, and its band keys."""

    def make() -> Callable[[pa.Array], pa.Array]:
        signatures = Signatures(bands, rows)
        none = np.zeros(0, np.uint64)

        def one(batch: pa.Array) -> pa.Array:
            n, hi, lo, keys = [], [], [], []
            for text in batch.to_pylist():
                found = shingle_hashes(text, words)
                n.append(len(found))
                hi.append(np.bitwise_xor.reduce(mixed(found + np.uint64(1)), initial=np.uint64(0)))
                lo.append(np.add.reduce(mixed(found ^ np.uint64(0x5555)), dtype=np.uint64))
                keys.append((signatures.keys(found) if len(found) else none).tobytes())
            sums = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (hi, lo)]
            return pa.StructArray.from_arrays([pa.array(n, pa.int32()), *sums, joined(keys, pa.int64(), np.int64)], ["n", "hi", "lo", "bands"])

        return one

    return mapped(make, FEATURES)(text)


def hash_sets(text: Column, words: int) -> Column:
    def make() -> Callable[[pa.Array], pa.Array]:
        return lambda batch: joined([shingle_hashes(t, words).tobytes() for t in batch.to_pylist()], pa.int64(), np.int64)

    return mapped(make, "array<bigint>")(text)


def _within(a: Column, b: Column, percent: int) -> Column:
    """Set sizes that leave the similarity possible."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, set) of the wanted documents; a counted and small number of ids is broadcast."""
    wanted = stored(ids.select("id").distinct(), "wanted")
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    return docs.join(few, "id", "left_semi").select("id", hash_sets(F.col("text"), words).alias("set")).distinct()


def confirmed(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of (id, text) rows whose full shingle sets are similar enough."""
    sets = stored(_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")), words), "sets")
    left, right = sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    alike = shared * 100 >= (F.size("sa") + F.size("sb") - shared) * percent
    return pairs.join(left, "a").join(right, "b").where(alike).select("a", "b").distinct()


def joining_links(ids: list[int], comps: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between members of different components, as many as it takes to join what is linked.

    Sizes of intersections come from products of 0/1 matrices over the shingles that several members share."""
    values, at, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    shared = seen > 1
    place = np.cumsum(shared) - 1
    owner, column = owner[shared[at]], place[at[shared[at]]]
    size = np.array([len(x) for x in sets], np.float64)
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for start in range(0, int(shared.sum()), COLUMNS):
        low, high = np.searchsorted(column, (start, start + COLUMNS))
        block = np.zeros((len(sets), COLUMNS), np.float32)
        block[owner[low:high], column[low:high] - start] = 1
        common += block @ block.T
    alike = common.astype(np.float64) * 100 >= (size[:, None] + size[None, :] - common) * percent
    comp = np.array(comps)
    left, right = np.nonzero(np.triu(alike & (comp[:, None] != comp[None, :]), 1))
    root = {c: c for c in comps}
    out = []
    for x, y in zip(left.tolist(), right.tolist(), strict=True):
        cx, cy = comps[x], comps[y]
        while root[cx] != cx:
            cx = root[cx]
        while root[cy] != cy:
            cy = root[cy]
        if cx != cy:
            root[max(cx, cy)] = min(cx, cy)
            out.append((ids[x], ids[y]))
    return out


def _tile_links(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    release()
    found = joining_links(rows["id"].tolist(), rows["c"].tolist(), rows["set"].tolist(), percent) if rows["c"].nunique() > 1 else []
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def remaining_links(texts: DataFrame, members: DataFrame, comps: DataFrame, words: int, percent: int) -> DataFrame:
    """Links that the stars can't show: between components that still meet in a bucket.

    Buckets that meet form a family; its members are compared in tiles of bounded size, whatever their
    number, each pair of tiles by one task, and only the links that join components leave the task."""
    placed = members.join(comps, members["id"] == comps["node"], "left").select("key", "id", "hub", F.coalesce("component", "id").alias("c"))
    several = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high AND size > 2").select("key")
    open_ = stored(placed.join(several, "key").select("id", F.col("hub.id").alias("h"), "c").distinct(), "open")
    family = components(open_.select(F.col("id").alias("a"), F.col("h").alias("b")))
    rows = open_.select("id", "c").distinct().join(family, F.col("id") == F.col("node")).select("id", "c", F.col("component").alias("family"))
    rows = stored(rows, "families")
    tiles = rows.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    rows = rows.join(tiles, "family").withColumn("t", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    rows = rows.join(_sets(texts, rows.select("id"), words), "id")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.where((F.col("tiles") == 1) | (F.col("other") != F.col("t"))).withColumns({"i": F.least("t", "other"), "j": F.greatest("t", "other")})
    return rows.groupBy("family", "i", "j").applyInPandas(lambda x: _tile_links(x, percent), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for every row of ``docs``.

    Documents are linked if the Jaccard similarity of their shingle sets is at least ``percent`` in a
    hundred; a component's id is its smallest document id and only that document is kept. Equal sets are
    linked through their mark and travel as one. Empty sets (null or blank texts) are linked with nothing.
    Rows that share an id count as one document, which is linked with whatever one of them is linked with.
    A row without an id is kept and has no component. Other columns are left out, whatever their names.

    40 bands of 5 bins miss a pair of similarity 0.8 about once in eight million."""
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    base = stored(texts.select("id", features(F.col("text"), words, bands, rows).alias("f")).select("id", "f.*"), "features")
    some = base.where("id IS NOT NULL AND n > 0")
    reps = stored(some.groupBy("hi", "lo", "n").agg(F.min("id").alias("rep"), F.min("bands").alias("bands")), "sets-of-documents")
    entries = reps.select(F.col("rep").alias("id"), "n", F.explode("bands").alias("key")).distinct()
    hubs = entries.groupBy("key").agg(F.min(F.struct("id", "n")).alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1")
    members = stored(entries.join(hubs, "key"), "members")
    pairs = members.where((F.col("id") != F.col("hub.id")) & _within(F.col("n"), F.col("hub.n"), percent)).select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct()
    links = stored(confirmed(texts, stored(pairs, "pairs"), words, percent), "confirmed")
    comps = stored(components(links), "components")
    more = stored(remaining_links(texts, members, comps, words, percent), "confirmed")
    if not more.isEmpty():
        links = links.unionByName(more)
        comps = stored(components(links), "components")
    own = reps.select("hi", "lo", F.col("n").alias("size"), "rep")
    found = base.join(own, (base["hi"] == own["hi"]) & (base["lo"] == own["lo"]) & (base["n"] == own["size"]) & base["id"].isNotNull(), "left").select("id", "n", "rep")
    ids = found.select("id", "rep").where("id <> rep").unionByName(links.toDF("id", "rep")) if _repeats(found) else None
    if ids is not None:
        comps = stored(components(ids.toDF("a", "b")), "components")
        return found.join(comps, found["id"] == comps["node"], "left").select(*_result(F.coalesce("component", "id")))
    return found.join(comps, found["rep"] == comps["node"], "left").select(*_result(F.coalesce("component", "rep", "id")))


def _repeats(found: DataFrame) -> bool:
    """Whether an id has rows of different sets."""
    return not found.where("id IS NOT NULL").groupBy("id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x <> y").isEmpty()


def _result(component: Column) -> list[Column]:
    return [
        F.col("id").alias("doc_id"),
        F.col("n").cast("long").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    ]


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose document is the kept one of its component."""
    judged = near_duplicates(docs, words, percent, doc_id=doc_id, text=text)
    gone = judged.where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col(doc_id) == F.col("__gone"), "left_anti")
