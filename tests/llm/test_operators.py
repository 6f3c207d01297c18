"""Small and odd tables against brute force, for the operators on training text."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from proofloom.llm import bytepair, chat, contamination, language, lmscore, neardup, repeats, search, tokencount, urls
from proofloom.llm.tables import read_ranks

ODD = "doc_id long, text string, words string, n_tokens string, bucket string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau ypsilon".split()


def odd_rows():
    rnd = random.Random(5)
    base = [" ".join(rnd.choice(WORDS) + str(rnd.randrange(30)) for _ in range(rnd.randrange(5, 60))) for _ in range(12)]
    texts = [*base, base[0], base[1] + " more", base[2].upper(), "", None, " \n\t ", "x", "Ünï cödé Ω 漢字 " * 9, "a" * 700, base[3][:120] + " other words here", "12 34"]
    rows = [(k, t, "w", "n", "b") for k, t in enumerate(texts)]
    return [*rows, rows[4], rows[4], (None, base[5], None, None, None), (3, base[6], "w", None, "b")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD)


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_bpe_equals_the_public_library(spark, odd, ranks):
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for row in bytepair.encode_texts(odd, ranks, public_tokenizers.PATTERN, spaced=True).collect():
        assert row.ids == want.encode_ordinary(row.text or "") and bytes(row.decoded) == (row.text or "").encode()
    for row in bytepair.encode_checked(odd, ranks, public_tokenizers.PATTERN, spaced=True).collect():
        assert row.ids == want.encode_ordinary(row.text or "") and row.round_trip is True
    encoder = bytepair.TextEncoder(ranks, public_tokenizers.PATTERN, spaced=True)
    long = "".join(f"{'x' * (k % 7)}{k % 91} {' ' * (k % 3)}é\n" for k in range(30_000))
    assert len(long) > 4 * bytepair.SLICE and encoder.encode(long) == want.encode_ordinary(long)
    decoder = bytepair.Decoder(ranks)
    ids = np.array(encoder.encode(long))
    assert decoder.gives(ids, long.encode())
    assert not decoder.gives(ids, long.encode() + b"x") and not decoder.gives(ids[:-1], long.encode()) and not decoder.gives(ids, b"y" + long.encode()[1:])
    rnd = random.Random(2)
    for _ in range(300):
        old = "".join(rnd.choice("ab c\n.,'s12é  ") for _ in range(rnd.randrange(60)))
        k = rnd.randrange(len(old) + 1)
        new = old[:k] + rnd.choice(["", "x", " yz ", "\n\n"]) + old[k + rnd.randrange(3) :]
        assert encoder.encode(old) == want.encode_ordinary(old)
        assert encoder.reencode(old, encoder.encode(old), new) == want.encode_ordinary(new)
    table = bytepair.PrefixTable(encoder.vocabulary, b"appen")
    table.append(b"dable")
    table.replace(2, 4, b"xy")
    assert table.ids() == want._encode_single_piece(b"apxyndable")
    back = spark.createDataFrame([([1, None, 10**6],), (None,)], "ids array<int>").select(bytepair.decoded(spark, F.col("ids"), ranks).alias("b")).collect()
    assert bytes(back[0].b).count("�".encode()) == 2 and bytes(back[1].b) == b""


def test_piece_counts_equal_greedy_matching(odd):
    pieces = [b"a", b"b", b"ab", b"abc", b"bca", b"c", b"cab"]
    automaton = tokencount.Automaton(pieces, [b"b", b"a", b"bb", b"abab", b"c"])
    rnd = random.Random(1)
    for _ in range(500):
        word = bytes(rnd.choice(b"abcd"[: rnd.choice([3, 3, 3, 4])]) for _ in range(rnd.randrange(12)))
        at, n, known = 0, 0, pieces
        while at < len(word):
            size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in known), 0)
            at, n, known = (at + size, n + 1, [b"b", b"a", b"bb", b"abab", b"c"]) if size else (len(word), -1, known)
            if n == -1:
                n = 1
                break
        assert automaton.length(word) == n, word
    rows = tokencount.piece_counts(odd, [b"x"], [b"x"]).collect()
    assert {r.n_tokens for r in rows if not (r.text or "").strip()} == {0} and len(rows) == odd.count()


def test_url_rules_and_model(spark):
    rows = [(1, "http://A.Example.ORG/es/1?x"), (2, "https://b.org"), (3, None), (4, "no host"), (5, "http://x.com/de/#a"), (6, "http://x.com/fr/?q=/de/"), (7, "http://Éx.net#p"), (7, "http://x.com/de/2")]
    rules = urls.rules_from({"org/": "allow", "example.org/es/": "block", "com/fr/": "allow", "com/de/": "block"})
    found = {(r.page_id, r.url): r for r in urls.judged(spark.createDataFrame(rows, "page_id int, url string"), rules).collect()}
    want = [("a.example.org", "/es/1", "example.org/es/"), ("b.org", "", None), ("", "", None), ("", "", None), ("x.com", "/de/", "com/de/"), ("x.com", "/fr/", "com/fr/"), ("Éx.net", "", None), ("x.com", "/de/2", "com/de/")]
    assert [(found[r].host, found[r].path, found[r].rule) for r in rows] == want
    assert urls.judged(spark.createDataFrame([], "url string"), rules).count() == 0
    good, bad = [(f"site{k}.net", f"/news/{k}", 0) for k in range(40)], [(f"pills{k}.net", f"/buy/{k}", 1) for k in range(40)]
    model = urls.UrlModel(rounds=10).fit(spark.createDataFrame([*good, *bad, ("n", "/", None)], "host string, path string, label int"))
    new = spark.createDataFrame([("site99.net", "/news/99"), ("pills99.net", "/buy/99")], "host string, path string")
    assert [r.score > 0.5 for r in model.score(new).collect()] == [False, True]


def test_url_model_counts_copies_as_weight(spark):
    rows = [(f"site{k}.net", f"/news/{k}", 0) for k in range(15)] + [(f"pills{k}.net", f"/buy/{k}", 1) for k in range(15)]
    labelled = spark.createDataFrame(rows, "host string, path string, label int")
    hot = tuple(labelled.orderBy(F.xxhash64("host", "path")).first())
    model = urls.UrlModel(rounds=10).fit(spark.createDataFrame([*rows, *[hot] * 50], labelled.schema), most=30)
    assert model.model is not None
    new = spark.createDataFrame([("site99.net", "/news/99"), ("pills99.net", "/buy/99")], "host string, path string")
    low, high = (r.score for r in model.score(new).collect())
    assert low < high


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_ROWS", 7)
    monkeypatch.setattr(search, "QUERY_ROWS", 3)
    monkeypatch.setattr(search, "FAN_IN", 2)
    rnd = random.Random(3)
    rows = [(k, [rnd.randrange(-3, 4) / 256 for _ in range(4)]) for k in range(60)]
    rows += [(60, None), (61, [1.0, None, 0.0, 0.0]), (62, [math.nan] * 4), (63, [math.inf] * 4), (64, [1.0]), (None, [0.0] * 4), (65, [1e12] * 4), (66, [1e12] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, e array<double>").select("vec_id", search.scaled(F.col("e")).alias("vector"))
    got = sorted(tuple(r) for r in search.top_k(df, df.where("vec_id % 5 = 0"), 5).collect())
    whole = {k: [math.floor(256 * x) for x in v] for k, v in rows if k is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q, v in whole.items():
        if q % 5 == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), k) for k, w in whole.items() if k != q and len(w) == len(v) and max(map(abs, v + w)) < 1e9)[:5]
            want += [(q, r + 1, k, -s) for r, (s, k) in enumerate(near)]
    small = [g for g in got if abs(g[3]) < 10**9 and g[0] != 65]
    assert [w for w in sorted(want) if w[0] != 65 and not any(g[0] == w[0] and abs(g[3]) >= 10**9 for g in got)] == [g for g in small if not any(x[0] == g[0] and abs(x[3]) >= 10**9 for x in got)]
    assert search.top_k(df.where("false"), df).count() == 0


def test_top_k_deals_by_the_row_alone(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_ROWS", 7)
    monkeypatch.setattr(search, "QUERY_ROWS", 3)
    rnd = random.Random(6)
    rows = [(k, [rnd.randrange(-9, 10) for _ in range(3)]) for k in range(40)]
    rows += [rows[3]] * 30 + [(3, [9, 9, 9])] * 2 + [(70, [1, 1, 1])] * 9
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    asked = sorted({(k, tuple(v)) for k, v in rows if k % 4 == 0})
    want = []
    for q, v in asked:
        near = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), k) for k, w in rows if k != q)[:5]
        want += [(q, r + 1, k, -s) for r, (s, k) in enumerate(near)]
    for parts in (1, 5):
        found = search.top_k(df.repartition(parts), df.where("vec_id % 4 = 0"))
        assert "monotonically_increasing_id" not in found._jdf.queryExecution().toString()
        assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_contamination_equals_brute_force(spark, odd):
    items = [(1, odd_rows()[2][1]), (2, "alpha"), (3, None), (4, ""), (5, odd_rows()[2][1]), (6, "Ünï cödé Ω"), (None, "12 34")]
    got = contamination.contamination(odd, spark.createDataFrame(items, "item_id int, text string"))
    import re

    cut = lambda t: re.findall("[^\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+", (t or "").translate({k: k + 32 for k in range(65, 91)}))
    wins = defaultdict(set)
    for item, text in items:
        w = cut(text)
        for k in range(max(len(w) - 9, 1) if w else 0):
            wins[tuple(w[k : k + 10])].add(item)
    want = []
    for doc, text, *_ in odd_rows():
        w, hit, named = cut(text), set(), set()
        for win, found in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    named |= found - {None}
        text_ = ",".join(sorted(map(str, named)))
        want.append((doc if doc is not None else -1, len(w), len(hit), hashlib.sha256(text_.encode()).hexdigest(), bool(hit)))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_hit, r.items_sha256, r.contaminated) for r in got.collect()) == sorted(want)
    none = spark.createDataFrame([], "item_id int, text string")
    assert contamination.contamination(odd, none).where("contaminated").count() == 0
    assert contamination.decontaminated(odd.where("false"), none).columns == odd.columns


def test_repeats_equal_brute_force(odd):
    rnd = random.Random(1)
    for _ in range(60):
        strings = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 25))).encode() for _ in range(rnd.randrange(1, 8))]
        got = sorted((n, tuple(sorted(zip(o.tolist(), f.tolist(), strict=True)))) for n, o, f in repeats.maximal_repeats(strings, 4))
        seen = defaultdict(list)
        for k, s in enumerate(strings):
            for a in range(len(s)):
                for b in range(a + 4, len(s) + 1):
                    seen[s[a:b]].append((k, a))
        want = []
        for w, at in seen.items():
            left = {strings[k][a - 1] if a else (k, a) for k, a in at}
            right = {strings[k][a + len(w)] if a + len(w) < len(strings[k]) else (k, a) for k, a in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                want.append((len(w), tuple(sorted(at))))
        assert got == sorted(want)
    first = {}
    rows = odd_rows()
    for doc, text, *_ in rows:
        data = (text or "").encode()
        for k in range(len(data) - 49):
            if doc is not None:
                first[data[k : k + 50]] = min(first.get(data[k : k + 50], doc), doc)
    want = []
    for doc, text, *_ in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 49):
            if doc is not None and first[data[k : k + 50]] < doc:
                gone[k : k + 50] = b"\1" * 50
        want.append((str(doc), bytes(b for b, g in zip(data, gone, strict=True) if not g)))
    got = repeats.without_repeats(odd).collect()
    assert sorted((str(r.doc_id), bytes(r.kept_bytes)) for r in got) == sorted(want)
    assert repeats.deduplicated_text(odd).columns == odd.columns and repeats.without_repeats(odd.where("false")).count() == 0


def test_a_hot_minimizer_is_split(spark, monkeypatch):
    rnd = random.Random(4)
    letters = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    passage = letters(45)
    rows = [(k, letters(60) + passage + letters(60)) for k in range(400)]
    rows += [(500, rows[7][1][30:130]), (501, "z" * 300 + passage + "z" * 300), (502, letters(9) + "z" * 130), (502, "z" * 70 + passage), (3, "z" * 90 + passage + rows[9][1][105:140])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def largest():
        groups = defaultdict(dict)
        for sent in repeats.sent_segments(docs, 50, "doc_id", "text").where("not known").collect():
            value, strings, _, _ = repeats._unpacked(sent.packed)
            for key, string in zip(value.tolist(), strings, strict=True):
                groups[key][string] = len(string) - 49
        return max(sum(g.values()) for g in groups.values())

    assert largest() > 2_000
    monkeypatch.setattr(repeats, "HOT", 200)
    monkeypatch.setattr(repeats, "ONE_OF", 1)
    assert largest() < 200
    first = {}
    for doc, text in rows:
        for k in range(len(text) - 49):
            first[text[k : k + 50]] = min(first.get(text[k : k + 50], doc), doc)
    for most in (200, 1):
        monkeypatch.setattr(repeats, "HOT", most)
        want = []
        for doc, text in rows:
            gone = {j for k in range(len(text) - 49) if first[text[k : k + 50]] < doc for j in range(k, k + 50)}
            want.append((doc, "".join(c for k, c in enumerate(text) if k not in gone).encode()))
        assert sorted((r.doc_id, bytes(r.kept_bytes)) for r in repeats.without_repeats(docs).collect()) == sorted(want)
        assert any(len(w) < len(t) for (_, w), (_, t) in zip(want, rows, strict=True))


def test_near_copies_equal_brute_force(spark, odd):
    rnd = random.Random(8)
    base = [rnd.choice(WORDS) + str(rnd.randrange(50)) for _ in range(40)]
    rows = [(k, " ".join(w if rnd.random() > 0.05 else "q" + str(k) for w in base)) for k in range(60)]
    rows += [(100 + k, t) for k, t in enumerate(["", None, "one", "ONE", "one two", "a b c d e f", "a b c d e g"])] + [(0, rows[0][1]), (None, base[0])]
    sets = {}
    for k, t in rows:
        w = (t or "").encode().lower().split()
        sets[k] = set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)} if w else set()
    root = {k: k for k in sets if k is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted((str(k), len(sets[k]), str(find(k)) if k is not None else "None") for k, _ in rows)
    assert neardup.near_duplicates(odd.where("false")).count() == 0 and neardup.deduplicated(odd).columns == odd.columns


def test_languages_and_mixtures(spark, odd):
    one, two = "the of and that with this from have ", "der die und nicht ein wird sich auch "
    rows = [(k, (one if k % 2 else two) * 5, "en" if k % 2 else "de") for k in range(20)] + [(50, one * 9 + two * 6, None), (51, None, "en"), (52, "12 !?", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, F.col("doc_id") < 15)
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.language(docs, model).collect()}
    assert all(found[k][0] == ("en" if k % 2 else "de") for k in range(20))
    assert found[51] == found[52] == ("und", 0.0)
    shares = model.shares(rows[20][1])
    assert set(shares) == {"en", "de"} and abs(shares["en"] - 0.6) < 0.1
    nothing = language.fit(docs.where("false"), F.lit(True))
    assert {r.lang_pred for r in language.language(odd, nothing).collect()} == {"und"}


def test_lm_scores(spark, odd):
    rows = [(k, ("good words here " if k < 10 else "zq xj kv ") * 10) for k in range(20)] + [(30, None), (31, "")]
    got = {r.doc_id: r for r in lmscore.scores(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k,) for k in range(8)], "doc_id long")).collect()}
    assert got[9].target_loss_minus_background < 0 < got[15].target_loss_minus_background and got[30].target_loss_minus_background is None
    code = lmscore.codes("ab")
    assert code.tolist() == [10 << 16 | 10 << 8 | 97, 10 << 16 | 97 << 8 | 98]
    logs = lmscore.log_probabilities(np.array(code), np.array([3, 1]))
    assert abs(math.exp(logs[0]) - (0.7 + 0.2 + 0.1 * 4 / 260)) < 1e-9
    assert lmscore.scores(odd, odd.select("doc_id")).count() == odd.count()


@pytest.mark.parametrize("left_out", [True, False])
def test_lm_scores_tell_words_of_the_same_bytes_apart(spark, left_out):
    rows = [(k, ("ab cd ef gh" if k % 2 else "ab ef cd gh") + " ab" * (k % 3)) for k in range(12)] + [(3, "x y"), (None, "ab"), (20, " \n"), (21, None)] + [(1, "ab cd ef gh ab")]
    good = [1, 3, 5]
    counts = [defaultdict(int), defaultdict(int)]
    for k, text in rows:
        w = (text or "").split()
        if w:
            own = counts[k in good]
            for pair in zip(["^", *w], [*w, "$"], strict=True):
                own[pair] += 1
                own[pair[0], None] += 1
                own[None, pair[1]] += 1
                own[None, None] += 1
    size = len({p[1] for c in counts for p in c if p[0] is None and p[1] is not None})

    def loss(c, own, a, b):
        pair, before, word, whole = (c[k] - own[k] for k in ((a, b), (a, None), (None, b), (None, None)))
        return -math.log(0.7 * (pair / before if before else 0) + 0.2 * word / whole + 0.1 / size)

    want = []
    for k, text in rows:
        w = (text or "").split()
        own = [defaultdict(int), defaultdict(int)]
        for a, b in zip(["^", *w], [*w, "$"], strict=True) if left_out and w else ():
            for key in ((a, b), (a, None), (None, b), (None, None)):
                own[k in good][key] += 1
        gaps = [loss(counts[1], own[1], a, b) - loss(counts[0], own[0], a, b) for a, b in zip(["^", *w], [*w, "$"], strict=True)] if w else []
        want.append((str(k), len(w), round(sum(gaps) / len(gaps), 5) if w else None))
    got = lmscore.scores(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k,) for k in good], "doc_id long"), left_out=left_out)
    found = [(str(r.doc_id), r.n_tokens, None if r[2] is None else round(r[2], 5)) for r in got.collect()]
    key = lambda r: (r[0], r[1], r[2] or 0)
    for a, b in zip(sorted(found, key=key), sorted(want, key=key), strict=True):
        assert a[:2] == b[:2] and (a[2] is None) == (b[2] is None) and abs((a[2] or 0) - (b[2] or 0)) < 3e-5


def test_chats_collapse(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (3, 200, "USER", None), (4, 0, "user", "other"), (5, 0, "user", "other"), (5, 0, "user", "other"), (None, 0, "user", "x"), (6, None, None, "n")]
    got = chat.rendered(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "part").collect()
    assert [(r.conv_id, r.part, r.n_rows) for r in got] == [(3, 0, 2), (3, 3, 1), (4, 0, 1), (6, -1, 1)]
    assert got[0].chat == "<|user|>\nhi\n<|assistant|>\nyo\n" and got[1].chat == "<|user|>\n\n"
    assert chat.rendered(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
