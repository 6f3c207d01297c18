"""Registered queries against their SQL, and faults that once gave silent wrong results."""

import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from proofloom.llm import bytepair, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_phrases", "op12_hard_negatives", "op13_repeated_words", "op4_vector_top"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    found = queries.QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(found.columns)
    got = [tuple(row[c] for c in columns) for row in found.collect()]
    assert sorted(got, key=str) == sorted(want.fetchall(), key=str) and got


def test_vocabularies_that_differ_late_are_told_apart(spark):
    def ranks(last):
        tokens = [bytes([k]) for k in range(256)] + [b"a" * 3 + b"%04d" % k for k in range(1500)] + [last]
        return {t: k for k, t in enumerate(tokens)}

    one, other = ranks(b"bc"), ranks(b"cd")
    assert bytepair.vocabulary_mark(one) != bytepair.vocabulary_mark(other) == bytepair.vocabulary_mark(dict(reversed(other.items())))
    row = spark.createDataFrame([("abcd",)], "text string").coalesce(1)
    for vocabulary in (one, other, one):
        plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary, special_tokens={})
        ids = row.select(bytepair.encoded(spark, F.col("text"), vocabulary, public_tokenizers.PATTERN).alias("ids")).first().ids
        assert ids == plain.encode_ordinary("abcd")


def test_a_corpus_without_languages_stays_whole(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.keep_known_languages(spark, docs, SF)
    assert kept.count() == docs.count() and kept.columns == docs.columns
