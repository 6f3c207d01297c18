"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions only.

An item is cut into windows of ``size`` words. A document contains a window only if it contains every
shingle of it, so one shingle, the rarest of the window in the documents, is prefix enough: candidates come
from that shingle alone. Its place in the window fixes where the window would start (positional bound), the
start and end must lie inside the document (length bound), and the words are then compared one by one.

The documents are parsed once for that: places whose shingle occurs in an item are kept with the few words
around them, enough to hold any window there, so no text is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofloom.llm.tables import lower_ascii, stored, text_key

SIZE = 10
SHINGLE = 5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    """Lower-cased words; null and texts without a word give an empty array."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def windows(items: DataFrame, size: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, window): the word windows of each item, repeated ones once; a shorter item is one window."""
    found = items.select(F.col(item_id).alias("item"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (size - 1), F.lit(1)))
    return found.select("item", F.explode(F.transform(starts, lambda k: F.slice("words", k, F.lit(size)))).alias("window")).distinct()


def shingle_hash(words: Column, at: Column, length: int) -> Column:
    """Of the ``length`` words from the place ``at`` on, counted from 0."""
    return F.xxhash64(F.lit(length), *[F.get(words, at + k) for k in range(length)])


def _shingled(windows_of: DataFrame, lengths: list[int], shingle: int) -> DataFrame:
    """(window, offset, key): every shingle of every window; windows shorter than a shingle are one shingle."""
    parts = []
    for n in lengths:
        mine = windows_of.where(F.least(F.size("window"), F.lit(shingle)) == n)
        placed = mine.select("window", F.explode(F.sequence(F.lit(0), F.size("window") - n)).alias("offset"))
        parts.append(placed.withColumn("key", shingle_hash(F.col("window"), F.col("offset"), n)))
    return reduce(DataFrame.unionByName, parts)


def _matching(at: DataFrame, keys: DataFrame, n_keys: int) -> DataFrame:
    """Places whose key is among ``keys``. Few keys are broadcast; with many, the places are dealt out by key
    without their words, which the places that matched get back afterwards."""
    if n_keys <= BROADCAST_ROWS:
        return at.join(F.broadcast(keys), "key")
    hit = at.select("doc", "version", "pos", "key").join(keys, "key")
    texts = at.select(F.col("doc").alias("d"), F.col("version").alias("v"), "words", "n_words").dropDuplicates(["d", "v"])
    return hit.join(texts, F.col("doc").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v"))).drop("d", "v")


def places(docs: DataFrame, keys: DataFrame, n_keys: int, lengths: list[int], size: int, doc_id: str, text: str) -> DataFrame:
    """Where documents have a shingle of ``keys``: (doc, version, pos, n_words, key, around), where ``around``
    holds the words that a window over the shingle can reach and ``shift`` how many of them stand before it."""
    parsed = docs.select(F.col(doc_id).alias("doc"), text_key(F.col(text)).alias("version"), words_of(F.col(text)).alias("words"))
    parsed = parsed.withColumn("n_words", F.size("words"))
    parts = []
    for n in lengths:
        at = parsed.where(F.col("n_words") >= n).withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("n_words") - n)))
        hit = _matching(at.withColumn("key", shingle_hash(F.col("words"), F.col("pos"), n)), keys, n_keys)
        first = F.greatest(F.col("pos") - (size - n), F.lit(0))
        parts.append(
            hit.select(
                "doc",
                "version",
                "pos",
                "n_words",
                "key",
                (F.col("pos") - first).alias("shift"),
                F.slice("words", first + 1, F.lit(2 * size - n)).alias("around"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def occurrences(docs: DataFrame, items: DataFrame, size: int = SIZE, shingle: int = SHINGLE, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc, version, window, start, length) of every window found, and (item, window) of the items.

    ``version`` tells rows with the same id and other text apart; rows that agree in both are one."""
    wanted = stored(windows(items, size, item_id, text), "windows")
    lengths = sorted(r[0] for r in wanted.select(F.least(F.size("window"), F.lit(shingle))).distinct().collect())
    if not lengths:
        empty = docs.select(F.col(doc_id).alias("doc"), text_key(F.col(text)).alias("version")).where(F.lit(False))
        return empty.select("*", F.array().cast("array<string>").alias("window"), F.lit(0).alias("start"), F.lit(0).alias("length")), wanted
    shingles = stored(_shingled(wanted.select("window").distinct(), lengths, shingle), "shingles")
    keys = shingles.select("key").distinct()
    found = stored(places(docs, keys, keys.count(), lengths, size, doc_id, text), "places")
    counts = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rarest = shingles.join(counts, "key").groupBy("window").agg(F.count(F.lit(1)).alias("seen"), F.min(F.struct("n", "offset", "key")).alias("rare"))
    whole = F.size("window") - F.least(F.size("window"), F.lit(shingle)) + 1
    prefix = rarest.where(F.col("seen") == whole).select("window", "rare.offset", "rare.key")
    start = F.col("pos") - F.col("offset")
    length = F.size("window")
    fits = (start >= 0) & (start + length <= F.col("n_words"))
    same = F.slice("around", F.col("shift") - F.col("offset") + 1, length) == F.col("window")
    hits = found.join(prefix, "key").where(fits & (F.col("shift") >= F.col("offset"))).where(same)
    return hits.select("doc", "version", "window", start.alias("start"), length.alias("length")).distinct(), wanted


def spans(hits: DataFrame) -> DataFrame:
    """(doc, version, start, stop): the maximal runs of words that windows cover."""
    order = Window.partitionBy("doc", "version").orderBy("start", "length")
    before = F.max(F.col("start") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = hits.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1))
    numbered = opened.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc", "version", "run").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("stop")).drop("run")


def contamination(docs: DataFrame, items: DataFrame, size: int = SIZE, shingle: int = SHINGLE, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), a row for every row of ``docs``.

    A word is hit if it lies in an occurrence of a window. Null and wordless texts have no words and no hit;
    a null id is an id like any other; rows repeated in ``docs`` give repeated rows; items repeated, null or
    without words add nothing. Other columns of both tables are left out, whatever their names."""
    hits, wanted = occurrences(docs, items, size, shingle, doc_id, item_id, text)
    hits = stored(hits, "hits")
    run = spans(hits.select("doc", "version", "start", "length").distinct())
    n_hit = run.groupBy("doc", "version").agg(F.sum(F.col("stop") - F.col("start")).cast("long").alias("n_hit"))
    named = hits.select("doc", "version", "window").distinct().join(wanted, "window").select("doc", "version", F.col("item").cast("string").alias("item")).distinct()
    listed = named.groupBy("doc", "version").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("listed"))
    n_words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("n_words")
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("version"), n_words)
    judged = n_hit.join(listed, (n_hit["doc"].eqNullSafe(listed["doc"])) & (n_hit["version"] == listed["version"]), "left").select(n_hit["doc"], n_hit["version"].alias("v"), "n_hit", "n_items", "listed")
    out = rows.join(judged, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("version") == F.col("v")), "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("listed", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, size: int = SIZE, shingle: int = SHINGLE, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no window of an item."""
    hits, _ = occurrences(docs, items, size, shingle, doc_id, item_id, text)
    bad = hits.select(F.col("doc").alias("__doc"), F.col("version").alias("__version")).distinct()
    return docs.join(bad, F.col(doc_id).eqNullSafe(F.col("__doc")) & (text_key(F.col(text)) == F.col("__version")), "left_anti")
