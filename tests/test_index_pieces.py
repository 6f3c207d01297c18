"""The index made document by document holds what the one made term by term holds, and shuffles no words."""

from pyspark.sql import functions as F

from proofloom.operators import lexical, pieces

SIZES = [1, 3, 9]


def rows(spark):
    texts = [f"alpha beta word{doc % 3} " + "gamma " * (at % 4) + f"É{at}" for doc, n in enumerate(SIZES) for at in range(n)]
    keys = [(doc, at) for doc, n in enumerate(SIZES) for at in range(n)]
    made = [(doc, at, text) for (doc, at), text in zip(keys, texts)]
    made += [(1, 3, " \t"), (2, 20, None), (7, 5, "alpha alpha"), (8, 70_000, "alpha far"), (8, 1, "beta far")]
    return spark.createDataFrame(made, "doc_id long, chunk_index int, text string").repartition(3)


def content(df, *keys):
    def plain(v):
        if isinstance(v, list):
            return tuple(plain(x) for x in v)
        if hasattr(v, "asDict"):
            return tuple(plain(x) for x in v)
        return round(v, 9) if isinstance(v, float) else v

    names = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)


def test_pieces_hold_the_same_index(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SEGMENT", 4)
    monkeypatch.setattr(pieces, "WORDS", 20)
    chunks = rows(spark)
    packed, plain = lexical.build_index(chunks), lexical.build_by_term(chunks)
    assert packed.packed is not None and packed.loose is not None
    for name in ("impacts", "doc_stats", "segments", "term_stats"):
        assert content(getattr(packed, name)) == content(getattr(plain, name)), name
    terms = spark.createDataFrame([("alpha", 0), ("É1", 0), ("none", 0)], "term string, x int")
    assert content(lexical.wanted_blocks(packed, terms)) == content(lexical.wanted_blocks(plain, terms))


def test_words_are_not_shuffled(spark):
    chunks = rows(spark).where("chunk_index < 100")
    held = pieces.pieces(chunks.where(F.col("text").isNotNull()), 128, 64, 1.5, 0.75, 0.25)
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "HashAggregate" not in plan
    assert lexical.build_index(chunks.where("false")).term_stats.count() == 0
