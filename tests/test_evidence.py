import random

import pytest
from pyspark.sql import functions as F

from proofloom.functions import fuzzy
from proofloom.operators import chunking as ch
from proofloom.operators import export as ex
from proofloom.operators import facts as fa
from proofloom.operators import sections as se
from proofloom.operators import verify as v
from proofloom.plans.verify import verify_phrases

BOX = [(50.0, 50.0, 100.0, 65.0)]
CHUNKS = "doc_id long, chunk_index int, page_num int, text string, bboxes array<struct<x0:double,y0:double,x1:double,y1:double>>"


def brute_partial(a, b):
    def lcs(s, t):
        row = [0] * (len(t) + 1)
        for c in s:
            last = 0
            for j, d in enumerate(t):
                last, row[j + 1] = row[j + 1], last + 1 if c == d else max(row[j + 1], row[j])
        return row[-1]

    def best(s, t):
        m = len(s)
        spans = [t[max(0, i) : i + m] for i in range(1 - m, len(t))]
        return max(200 * lcs(s, w) / (m + len(w)) for w in spans if w)

    short, long = (a, b) if len(a) <= len(b) else (b, a)
    return max(best(short, long), best(long, short)) if len(a) == len(b) else best(short, long)


def test_partial_ratio_against_brute_force():
    random.seed(3)
    for _ in range(150):
        a = "".join(random.choice("abc ") for _ in range(random.randint(1, 14)))
        b = "".join(random.choice("abc ") for _ in range(random.randint(1, 25)))
        assert fuzzy.partial_ratio(a, b) == pytest.approx(brute_partial(a, b))


def near(rng, text, letters):
    """A stretch of the text with letters dropped, added and changed."""
    begin = rng.randrange(max(1, len(text) - 5))
    out = []
    for c in text[begin : begin + rng.randint(5, 60)]:
        roll = rng.random()
        out.append("" if roll < 0.1 else c + rng.choice(letters) if roll < 0.2 else c)
    return "".join(out) or "a"


def brute_edits(phrase, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(phrase, start=1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, start=1):
            last, row[j] = row[j], min(last + (c != d), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_edits_of_all_phrases_against_brute_force(monkeypatch):
    rng = random.Random(8)
    for limit in (4096, 7):
        monkeypatch.setattr(fuzzy, "EDIT_SLICE", limit)
        for _ in range(60):
            text = "".join(rng.choice("abc é") for _ in range(rng.randint(1, 50)))
            phrases = [near(rng, text, "abc") for _ in range(rng.randint(1, 5))]
            assert fuzzy.fewest_edits(phrases, text).tolist() == [brute_edits(p, text) for p in phrases]


def test_edit_bound_never_loses_a_match():
    rng = random.Random(11)
    passed = dropped = 0
    for letters in ("ab ", "abcdefghij klmno ", "aé\U0001f600 z"):
        for _ in range(150):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 120)))
            phrases = [near(rng, text, letters) for _ in range(4)] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 130)))]
            scores = [fuzzy.partial_ratio(p, text) for p in phrases]
            for floor in (79.5, 84.5, 95.0):
                for may, score in zip(fuzzy.may_reach(phrases, text, floor), scores):
                    assert may or score < floor
                    passed += bool(may) and score >= floor
                    dropped += not may
    assert passed > 300 and dropped > 300


def test_matcher_equals_plain_scores(spark):
    rng = random.Random(5)
    words = ["loan", "margin", "quarter", "interest", "the", "of", "a", "signing", "party", "firm", "rate"]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(12)] + ["", "x"]
    phrases = [near(rng, t, "abc ") for t in texts[:12] for _ in range(8)] + ["", "zq", "loan of the firm"]
    rows = spark.createDataFrame([(t, phrases) for t in texts], "text string, phrases array<string>")
    for threshold in (80, 85):
        for row in rows.select("text", fuzzy.phrase_matcher(threshold)("text", "phrases").alias("hits")).collect():
            want = {k: s for k, p in enumerate(phrases) if (s := fuzzy.phrase_score(p, row.text, threshold))}
            assert {h.pos: h.score for h in row.hits} == want


def test_token_set_scores():
    assert fuzzy.phrase_score("million ten loan", "the loan is ten million") == 100
    assert fuzzy.phrase_score("zzqx vvkw", "the loan is ten million", 85) == 0


def section_rows(spark, *phrases):
    return spark.createDataFrame([(1, "section_1_x", p) for p in phrases], "doc_id long, section_key string, phrase string")


def test_passes_and_places(spark):
    chunks = spark.createDataFrame(
        [
            (1, 0, 0, "The loan amount is ten million euros and the margin is low in", BOX),
            (1, 1, 1, "every quarter of the year while it lasts. Signing happens soon.", BOX * 4),
            (1, 2, 3, "A quote said 'firm terms' to all parties of the deal today.", BOX),
        ],
        CHUNKS,
    )
    found = verify_phrases(
        section_rows(
            spark, "**Loan amount** is ten million", "million ten loan amount", "loan amuont is ten milion euros",
            "margin is low in every quarter of the year", "nothing of this kind was ever written", "No relevant phrase found.", "  ",
        ),
        chunks,
    )
    verdict = {r["phrase"]: r["verified"] for r in found.verification.collect()}
    assert verdict == {
        "**Loan amount** is ten million": True, "million ten loan amount": True, "loan amuont is ten milion euros": True,
        "margin is low in every quarter of the year": True, "nothing of this kind was ever written": False,
    }
    methods = {(r["phrase"], r["method"]) for r in found.locations.collect()}
    assert ("**Loan amount** is ten million", "exact_cleaned_search") in methods
    assert ("million ten loan amount", "fuzzy_chunk_fallback_individual") in methods
    crossed = {m for p, m in methods if p.startswith("margin")}
    assert crossed == {"cross_page_fuzzy_match_part1", "cross_page_fuzzy_match_part2"}


def test_error_sections_are_not_verified(spark):
    rows = spark.createDataFrame(
        [(1, "error_1_x", "a phrase"), (1, "info_skipped_y", "b phrase"), (1, "section_1_z", " c phrase ")],
        "doc_id long, section_key string, phrase string",
    )
    assert [r["phrase"] for r in v.phrases_to_verify(rows).collect()] == ["c phrase"]


def test_best_location_on_screen_and_in_export(spark):
    rows = spark.createDataFrame(
        [(1, "p", 0, 0, 86, "exact_cleaned_search", BOX[0], 0), (1, "p", 1, 0, 99, "fuzzy_chunk_fallback", BOX[0], 0)],
        "doc_id long, phrase string, chunk_index int, page_num int, match_score int, method string, "
        "rect struct<x0:double,y0:double,x1:double,y1:double>, offset int",
    )
    assert v.best_location(rows).first()["match_score"] == 86
    assert v.best_location(rows, by_method=False).first()["match_score"] == 99
    assert v.highlights(rows, spark.createDataFrame([(1, 0)], "doc_id long, last_page int")).count() == 2


def test_exact_matches_with_short_phrases(spark):
    chunks = spark.createDataFrame([(1, 0, 0, "Alpha beta gamma", BOX), (2, 0, 0, "Unrelated words", BOX)], CHUNKS)
    phrases = spark.createDataFrame([("lpha be",), ("gamma",), ("a",), ("beta gamma alpha",)], "norm_phrase string")
    rows = {(r["norm_phrase"], r["doc_id"], r["match_tier"]) for r in v.exact_matches(phrases, chunks).collect()}
    assert rows == {("lpha be", 1, 1), ("gamma", 1, 1), ("a", 1, 1), ("a", 2, 1), ("beta gamma alpha", 1, 2)}


def fact(name="Amount", value="10 euros", kind="amount", confidence="0.9"):
    return f'{{"fact_name":"{name}","fact_value":"{value}","fact_type":"{kind}","confidence":{confidence}}}'


def answer(*facts, types='"amount"'):
    return f'{{"extracted_facts":[{",".join(facts)}],"fact_types_found":[{types}]}}'


@pytest.mark.parametrize(
    "attempts, attempt, names",
    [
        (["bad json", answer(fact())], 1, ["Amount"]),
        ([answer(fact(), fact("Rate", "none", "percentage")), answer(fact("Clean"))], 1, ["Clean"]),
        ([answer(fact(), fact("Rate", "none", "percentage")), None, "bad json"], 2, []),
        ([answer(), answer(), answer()], 2, []),
        ([answer(fact("X", "1", "mystery"), fact())], 0, ["Amount"]),
        ([answer(fact(), types='"mystery"'), answer(fact("Later"))], 1, ["Later"]),
        ([answer(fact(), fact("Bold", "11", "rate", "1.5"))], 0, ["Amount"]),
    ],
)
def test_attempt_choice(spark, attempts, attempt, names):
    rows = spark.createDataFrame([("r", i, a) for i, a in enumerate(attempts)], "request_id string, attempt int, response string")
    chosen = fa.choose_attempt(fa.read_attempts(rows)).first()
    assert chosen["attempt"] == attempt and [f["fact_name"] for f in chosen["facts"]] == names


def test_fallback_analyses_and_decomposition(spark):
    subs = spark.createDataFrame([("r", 1, "One", "p1"), ("r", 2, "Two", "p2")], "request_id string, number int, title string, sub_prompt string")
    got = spark.createDataFrame([("r", '{"analyses":[7,{"analysis_summary":"s","supporting_quotes":"q"}]}')], "request_id string, response string")
    rows = se.parse_analyses(got, subs).orderBy("number").collect()
    assert [(r["title"], r["phrases"], r["is_fallback"]) for r in rows] == [("One", ["q"], False), ("Two", ["No relevant phrase found."], True)]
    raw = spark.createDataFrame([("r", "ask", '{"decomposition":[{"title":3,"sub_prompt":"x"}]}')], "request_id string, prompt string, response string")
    assert se.parse_decomposition(raw).first()["title"] == "Overall Analysis"


def test_export_of_a_section_without_phrases(spark):
    from pyspark.sql import functions as F

    sections = spark.createDataFrame([(1, 1, "section_1_x", "a", "c", ["No relevant phrase found."])], "doc_id long, section_no int, section_key string, analysis string, context string, phrases array<string>")
    verdicts = spark.createDataFrame([], "doc_id long, phrase string, verified boolean")
    best = spark.createDataFrame([], "doc_id long, phrase string, page_num int, match_score int, method string")
    row = ex.export_rows(ex.phrase_evidence(sections, verdicts, best), F.lit("f.pdf")).first()
    assert row["Verified"] == "N/A" and row["Section"] == "Section 1 X" and row["Supporting Phrase"] == "No relevant phrase found."


def test_attempts_are_parsed_in_one_pass(spark):
    rows = spark.createDataFrame([("r", 0, None), ("r", 1, answer(fact())), (None, 0, answer(fact()))], "request_id string, attempt int, response string")
    chosen = fa.choose_attempt(fa.read_attempts(rows))
    assert "Join" not in chosen._jdf.queryExecution().executedPlan().toString()
    assert [(r["request_id"], r["attempt"], r["n_attempts"], r["clean"]) for r in chosen.collect()] == [("r", 1, 2, True)]


def test_occurrences_have_the_rectangles_of_their_blocks(spark):
    lines = ["The margin is low this year and", "stays so. The rest of the text is", "filler of no use to anyone here.", "The Margin is low again, at the", "very end of this page of text."]
    blocks, at = [], 0
    for k, line in enumerate(lines):
        blocks.append((at, at + len(line), (50.0, 50.0 + 15 * k, 50.0 + 6 * len(line), 65.0 + 15 * k)))
        at += len(line) + 1
    spans = CHUNKS.replace("bboxes array", "spans array<struct<start:int,stop:int,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>, bboxes array")
    whole = [b for *_, b in blocks]
    chunks = spark.createDataFrame([(1, 0, 0, " ".join(lines), blocks, whole), (2, 0, 0, " ".join(lines), blocks, whole[:3])], spans)
    rows = [(d, "section_1_x", p) for d in (1, 2) for p in ("margin is low", "year and stays so", "(low) \\E again", "again, at the very end")]
    found = verify_phrases(spark.createDataFrame(rows, "doc_id long, section_key string, phrase string"), chunks, fuzzy=False).locations.collect()
    places = {(r["doc_id"], r["phrase"]): [] for r in found}
    for r in found:
        places[r["doc_id"], r["phrase"]].append((r["method"], r["offset"], r["rect"]["y0"]))
    exact = "exact_cleaned_search"
    first, second = " ".join(lines).lower().index("margin"), " ".join(lines).lower().rindex("margin")
    assert sorted(places[1, "margin is low"]) == [(exact, first, 50.0), (exact, second, 95.0)]
    assert sorted(places[1, "year and stays so"]) == [(exact, 23, 50.0), (exact, 23, 65.0)]
    assert places[2, "margin is low"] == [(exact, first, 50.0)]
    assert {m for m, *_ in places[2, "again, at the very end"]} == {"fuzzy_chunk_fallback_individual"}
    plain = spark.createDataFrame([("a.b (c) \\E d*", "x A.B (c) \\e d* a.b (c) \\E d*"), ("-[^]", "q-[^]-[^]")], "p string, t string")
    assert [r[0] for r in plain.select(v.occurrences(F.col("t"), F.col("p"))).collect()] == [[2, 16], [1, 5]]


def test_only_long_documents_repeat_their_phrase_blocks(spark, monkeypatch):
    monkeypatch.setattr(v, "CHUNK_SPAN", 2)
    texts = spark.createDataFrame([(1, 0, "alpha beta")] + [(2, i, f"gamma number {i}") for i in range(5)], "doc_id long, chunk_index int, norm_text string")
    phrases = spark.createDataFrame([(1, "beta", "beta"), (2, "gamma", "gamma"), (2, "4 gamma", "4 gamma"), (3, "lost", "lost")], "doc_id long, phrase string, norm_phrase string")
    spans = texts.groupBy("doc_id").agg(v.text_span(F.max("chunk_index")).alias("last"))
    blocks = v.phrase_blocks(phrases, "norm_phrase", spans)
    assert sorted((r["doc_id"], r["_span"]) for r in blocks.collect()) == [(1, 0), (2, 0), (2, 1), (2, 2)]
    found = v.fuzzy_matches(phrases, texts, "norm_phrase", 85, fuzzy=False)
    assert sorted((r["doc_id"], r["chunk_index"], r["phrase"]) for r in found.collect()) == [
        (1, 0, "beta"), *[(2, i, "gamma") for i in range(4)], (2, 4, "4 gamma"), (2, 4, "gamma"),
    ]


def test_places_move_each_text_once(spark):
    chunks = spark.createDataFrame([(1, 0, 0, "one two", [(0.0, 0.0, 9.0, 9.0)])], "doc_id long, chunk_index int, page_num int, text string, bboxes array<struct<x0:double,y0:double,x1:double,y1:double>>")
    phrases = spark.createDataFrame([(1, "two", "two")], "doc_id long, phrase string, search_phrase string")
    matches = spark.createDataFrame([(1, 0, "two", 100)], "doc_id long, chunk_index int, phrase string, match_score int")
    rows = v.locate_single(matches, phrases, chunks)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if " Exchange " in line]
    assert len(moved) == 4  # matches, phrases, their join, and the texts
    assert [(r["method"], r["offset"]) for r in rows.collect()] == [("exact_cleaned_search", 4)]


def test_page_pairs_fetch_texts_for_page_breaks_only(spark):
    rows = [(1, 0, 0, "a", BOX), (1, 1, 0, "b", BOX), (1, 2, 1, "c", BOX), (1, 3, 3, "d", BOX), (2, 0, 0, "e", BOX)]
    pairs = ch.next_page_pairs(spark.createDataFrame(rows, CHUNKS))
    assert pairs._jdf.queryExecution().executedPlan().toString().count("LeftSemi") == 2
    assert [(r["doc_id"], r["chunk_index"], r["text"]) for r in pairs.collect()] == [(1, 1, "b c")]


def test_written_chunks_and_parsed_answers_are_stored_once(spark, monkeypatch):
    from proofloom.plans import verify as plan

    names = []
    keep = lambda df, name="table": names.append(name) or df
    for module in (plan, se):
        monkeypatch.setattr(module, "stored", keep, raising=False)
    monkeypatch.setattr(v, "match_passes", lambda phrases, chunks, fuzzy: (matches, matches, matches))
    chunks = spark.createDataFrame([(1, 0, 0, "one two", BOX)], CHUNKS)
    matches = spark.createDataFrame([(1, 0, "two", 100)], "doc_id long, chunk_index int, phrase string, match_score int")
    phrases = spark.createDataFrame([(1, "section_1_a", "two")], "doc_id long, section_key string, phrase string")
    plan.verify_phrases(phrases, chunks, False, written=True)
    assert names == ["phrases"]
    answers = spark.createDataFrame([("r", '{"analyses":[{"analysis_summary":"s"}]}')], "request_id string, response string")
    asked = spark.createDataFrame([("r", 1, "t", "p")], "request_id string, number int, title string, sub_prompt string")
    se.parse_analyses(answers, asked)
    assert names == ["phrases", "read"]
