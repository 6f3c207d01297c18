"""Cheap ways of the ingest step give what the plain ones give, and nothing is made twice."""

import random

from pyspark.sql import functions as F

from proofloom.functions import text as tx
from proofloom.operators import chunking as ch


def test_sentences_are_split_once_per_page(spark):
    pages = spark.createDataFrame([("One. Two! Three? Four. " * 4,)], "text string")
    groups = pages.select(ch.sentence_groups(tx.sentence_array("text"), 3).alias("g"))
    assert groups._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    rows = groups.first()["g"]
    text = "One. Two! Three? Four. " * 4
    assert len(rows) == 6 and all(text[g["char_start"] : g["char_end"]] == g["text"] for g in rows[:5])
    assert spark.range(1).select(ch.sentence_groups(F.lit(None).cast("array<string>"))).first()[0] is None


def test_white_space_as_by_the_plain_patterns(spark):
    rng = random.Random(4)
    signs = [" ", " ", "  ", "\t", "\n", " ", " ", "　", "\u0085", "\x1c", "​", "a", "b.", "é", "~", "!", "\x7f", "𝒳", "İ"]
    rows = [("".join(rng.choices(signs, k=rng.randint(0, 9))),) for _ in range(800)] + [(None,)]
    t = F.col("t")
    plain = F.regexp_replace(t, r"(?U)^\s+|\s+$", ""), F.trim(F.regexp_replace(t, r"(?U)\s+", " "))
    frame = spark.createDataFrame(rows, "t string").repartition(2)
    for r in frame.select(tx.trim_all("t"), tx.trim_all(t), plain[0], tx.clean_spaces("t"), tx.clean_spaces(t), plain[1]).collect():
        assert r[0] == r[1] == r[2] and r[3] == r[4] == r[5]


def test_length_by_the_start_of_a_text(spark):
    rng = random.Random(6)
    rows = [("".join(rng.choices([" ", "   ", "x", "İ", "\n"], k=rng.randint(0, 40))),) for _ in range(400)]
    frame = spark.createDataFrame(rows, "t string").select(ch.long_enough(F.col("t"), 10), F.length(tx.normalize("t")) >= 10)
    got = [tuple(r) for r in frame.collect()]
    assert all(a == b for a, b in got) and {a for a, _ in got} == {True, False}
