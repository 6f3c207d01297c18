"""What verification moves, and that the cheap tests before it lose nothing."""

import random

from pyspark.sql import functions as F

from proofloom.operators import chunking as ch
from proofloom.operators import verify as v

BOXES = "array<struct<x0:double,y0:double,x1:double,y1:double>>"


def test_phrases_move_to_their_document_once(spark, monkeypatch):
    monkeypatch.setattr(v, "CHUNK_SPAN", 2)
    phrases = spark.createDataFrame([(1, f"p {i}", f"p {i}") for i in range(150)], "doc_id long, phrase string, norm_phrase string")
    spans = spark.createDataFrame([(1, 3)], "doc_id long, last long")
    blocks = v.phrase_blocks(phrases, "norm_phrase", spans)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert sum(" Exchange " in line for line in plan.splitlines()) == 2  # phrases and spans
    assert sorted(blocks.select("_span", F.size("items")).collect()) == sorted((s, n) for s in range(4) for n in (64, 64, 22))


def test_forms_that_few_phrases_need_are_not_carried(spark):
    forms = v.with_forms(spark.createDataFrame([(1, "**A** b")], "doc_id long, phrase string"))
    assert forms.columns == ["doc_id", "phrase", "norm_phrase"] and forms.first()["norm_phrase"] == "a b"


def test_bits_lose_no_match(spark):
    rng = random.Random(5)
    words = ["a", "be", "été", "ça", "x-y", "k.l", "straße", "ȥu", "12", "𝒳z", "the", "of"]
    texts = [(1, i, " ".join(rng.choices(words, k=rng.randint(1, 30)))) for i in range(40)]
    cut = lambda t: t[(a := rng.randrange(len(t))) : a + rng.randint(1, 25)].strip()
    phrases = {cut(rng.choice(texts)[2]) for _ in range(80)} | {" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(80)} | {"--", "é"}
    phrases -= {""}
    rows = spark.createDataFrame([(1, p, p) for p in phrases], "doc_id long, phrase string, norm_phrase string")
    frame = spark.createDataFrame(texts, "doc_id long, chunk_index int, norm_text string")
    pairs = frame.crossJoin(rows.drop("doc_id")).withColumn("w", v.token_set(F.col("norm_phrase"))).withColumn("t", v.token_set(F.col("norm_text")))
    want = pairs.where(F.contains("norm_text", F.col("norm_phrase")) | ((F.size("w") > 0) & (F.size(F.array_except("w", "t")) == 0)))
    found = v.fuzzy_matches(rows, frame, "norm_phrase", 85, fuzzy=False)
    pick = lambda df: sorted(map(tuple, df.select("chunk_index", "phrase").collect()))
    assert pick(found) == pick(want) and len(pick(found)) > 200


def test_neighbours_of_the_same_page_do_not_move(spark):
    rows = [(d, i, i // 7, f"t{d}-{i}", [(0.0, 0.0, 1.0, 1.0)]) for d in range(3) for i in range(70)]
    chunks = spark.createDataFrame(rows, f"doc_id long, chunk_index int, page_num int, text string, bboxes {BOXES}")
    want = sorted((d, i, f"t{d}-{i} t{d}-{i + 1}") for d in range(3) for i in range(6, 69, 7))
    pick = lambda df: sorted(map(tuple, df.select("doc_id", "chunk_index", "text").collect()))
    for laid in (chunks.coalesce(1), chunks.repartition(5), chunks.orderBy(F.desc("chunk_index"))):
        assert pick(ch.next_page_pairs(laid)) == want
    left = chunks.coalesce(1).where(ch.may_pair("doc_id", "chunk_index", "page_num", F.lit(1)))
    assert 3 * 10 <= left.count() <= 3 * 10 + 4  # nine breaks, the document's last chunk, and the ends of batches


def test_markdown_is_dropped_as_before(spark):
    from proofloom.functions import text as tx

    rows = [(t,) for t in ("plain words ", "**a** b", "> q\n# h", "- x\n2. y", "don't", '"z"', "`c`", "+ p", None, "")]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(tx.strip_markdown("t")).collect()]
    assert got == ["plain words", "a b", "q\nh", "x\ny", "don t", "z", "c", "p", "", ""]


def test_answers_are_numbered_inside_their_response(spark, monkeypatch):
    from proofloom.operators import sections as se

    kept = []
    monkeypatch.setattr(se, "stored", lambda df, name="table": kept.append(df) or df)
    answers = spark.createDataFrame([("r", '{"analyses":[7,{"analysis_summary":"a"},null,{"analysis_summary":"b"}]}'), ("s", "no"), ("t", None)], "request_id string, response string")
    asked = spark.createDataFrame([(r, n, "t", "p") for r in "rst" for n in (1, 2)], "request_id string, number int, title string, sub_prompt string")
    rows = se.parse_analyses(answers, asked).orderBy("request_id", "number").collect()
    assert [(r["request_id"], r["number"], r["analysis"], r["is_fallback"]) for r in rows][:2] == [("r", 1, "a", False), ("r", 2, "b", False)]
    assert len(rows) == 6 and all(r["is_fallback"] for r in rows[2:])
    assert "Exchange" not in kept[0]._jdf.queryExecution().executedPlan().toString()
