import pytest
from pyspark.sql import functions as F

from proofloom.functions import parsing as ps
from proofloom.functions import text as tx


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, plain",
    [
        ("**bold** x *_it_*", "bold x it"),
        ("`code` here", "code here"),
        ("# Head\n> quote\n- item\n12. third", "Head\nquote\nitem\nthird"),
        ("it's \"so\"", "it s  so"),
    ],
)
def test_markdown(spark, raw, plain):
    assert one(spark, tx.strip_markdown(F.lit(raw))) == plain


def test_truncate(spark):
    late = "a" * 85 + "." + "b" * 40
    early = "a" * 50 + ". " + "b" * 80
    assert one(spark, tx.truncate_at_boundary(F.lit(late), 100)) == "a" * 85 + "."
    assert one(spark, tx.truncate_at_boundary(F.lit(early), 100)) == "a" * 50 + "."
    assert one(spark, tx.truncate_at_boundary(F.lit("x" * 120), 100)) == "x" * 100


def test_tokens_of_blank_text(spark):
    assert one(spark, tx.words(F.lit("  "))) == []
    assert one(spark, tx.words(F.lit(None).cast("string"))) == []


def test_token_budget_keeps_one_document_token(spark):
    pair = one(spark, tx.fit_token_budget(F.lit("q " * 600), F.lit("d " * 600)))
    assert len(pair["query"].split()) == 500 and len(pair["document"].split()) == 1


def test_fixed_numbers(spark):
    assert one(spark, tx.fixed(F.lit(0.0625), 3)) == "0.062"
    assert one(spark, tx.fixed(F.lit(-0.0001), 3)) == "-0.000"
    assert one(spark, tx.size_label(F.lit(1536))) == "1.50 KB"
    assert one(spark, tx.score_label(F.lit(0))) == "N/A"


@pytest.mark.parametrize(
    "raw, body",
    [
        ('```json\n{"a":1}\n```', '{"a":1}'),
        ('{"a":1}', '{"a":1}'),
        ('see {"a":{"b":2}} there', '{"a":{"b":2}}'),
        ("no braces", None),
    ],
)
def test_envelope(spark, raw, body):
    assert one(spark, ps.json_envelope(F.lit(raw))) == body


def test_scores(spark):
    assert [one(spark, ps.pair_score(F.lit(s))) for s in ("0.8", "1.7", "abc", "-2")] == [0.8, 1.0, 0.5, 0.0]
    assert one(spark, ps.batch_scores(F.lit("1. 0.85\n\n2) 0.1"), F.lit(2))) == [0.85, 0.1]
    assert one(spark, ps.batch_scores(F.lit("0.85"), F.lit(2))) is None
    assert one(spark, ps.rerank_scores(F.lit('{"predictions":[{"score":0.5},{}]}'), F.lit(2))) == [0.5, 0.0]
    assert one(spark, ps.rerank_scores(F.lit("oops"), F.lit(2))) == [0.0, 0.0]


@pytest.mark.parametrize(
    "given, kept",
    [
        (("0.6", "0.4"), (0.6, 0.4)),
        (("0.8", "0.4"), (0.8 / 1.2, 0.4 / 1.2)),
        (("0", "0"), (0.5, 0.5)),
        (("2", "0.5"), (0.5, 0.5)),
        (("high", "0.5"), (0.5, 0.5)),
        ((None, "0.5"), (0.5, 0.5)),
    ],
)
def test_weights(spark, given, kept):
    b, s = (F.lit(v).cast("string") for v in given)
    assert tuple(one(spark, ps.valid_weights(b, s))) == pytest.approx(kept)


def test_citations(spark):
    answer = F.lit("Ten days (Source: a.pdf, Page: 2)(Source: b.docx , Page: 5). See a.pdf.")
    assert one(spark, ps.number_citations(answer)) == "Ten days  [1] [2]. See a.pdf."
    rows = one(spark, ps.citation_list(answer))
    assert [tuple(r) for r in rows] == [(1, "a.pdf", 2), (2, "b.docx", 5)]
    shown = one(spark, ps.citation_snippet(F.lit("The notice period is ten days [1]. End."), F.lit(1), F.lit("a.pdf"), F.lit(2)))
    assert shown == "The notice period is ten days"
    assert one(spark, ps.citation_snippet(F.lit("Hi [1]."), F.lit(1), F.lit("a.pdf"), F.lit(2))) == "Referenced content from a.pdf, Page 2"
