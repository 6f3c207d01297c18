"""Fuzzy phrase scores (0-100) as an Arrow UDF; only matches leave the task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

MATCHES = "array<struct<pos:int,score:int>>"
# Characters dropped before token comparison (the upper Latin-1 half).
_DROPPED = {code: None for code in range(128, 256)}
EDIT_SLICE = 4096


def _lcs(masks: dict[str, int], width: int, text: str) -> int:
    """Length of the longest common subsequence, one bit per pattern character."""
    full = (1 << width) - 1
    state = full
    for char in text:
        hit = state & masks.get(char, 0)
        state = ((state + hit) | (state - hit)) & full
    return width - state.bit_count()


def _masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, char in enumerate(pattern):
        out[char] = out.get(char, 0) | (1 << i)
    return out


def ratio(a: str, b: str) -> float:
    """Share of characters in common order, 0-100."""
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * _lcs(_masks(a), len(a), b) / total


def _window_scores(masks: dict[str, int], m: int, long: str) -> int:
    """Best common length of the pattern with any window of its own length.

    All windows advance together: each owns a lane of a long integer, and because window i+1
    reads at step j what window i reads at step j+1, one table of lanes serves every step.
    """
    lane_bytes = m // 8 + 1
    lane_bits = 8 * lane_bytes
    windows = len(long) - m + 1
    lanes = {c: masks.get(c, 0).to_bytes(lane_bytes, "little") for c in set(long)}
    table = int.from_bytes(b"".join([lanes[c] for c in long]), "little")
    full = int.from_bytes(((1 << m) - 1).to_bytes(lane_bytes, "little") * windows, "little")
    state = full
    for _ in range(m):
        hit = state & table
        state = ((state + hit) | (state - hit)) & full
        table >>= lane_bits
    left = np.frombuffer(state.to_bytes(lane_bytes * windows, "little"), dtype=np.uint8).reshape(windows, lane_bytes)
    return m - int(np.bitwise_count(left).sum(axis=1).min())


def _edge_score(pattern: str, text: str) -> float:
    """Best ratio of the pattern against beginnings of ``text`` shorter than itself."""
    m = len(pattern)
    masks, full = _masks(pattern), (1 << m) - 1
    state, best = full, 0.0
    for size, char in enumerate(text[: m - 1], start=1):
        hit = state & masks.get(char, 0)
        state = ((state + hit) | (state - hit)) & full
        best = max(best, 200.0 * (m - state.bit_count()) / (m + size))
    return best


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text against any stretch of the longer one, 0-100."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    m, n = len(short), len(long)
    if m == 0:
        return 100.0 if n == 0 else 0.0
    if short in long:
        return 100.0
    best = 100.0 * _window_scores(_masks(short), m, long) / m
    best = max(best, _edge_score(short, long), _edge_score(short[::-1], long[::-1]))
    if m == n:
        best = max(best, _edge_score(long, short), _edge_score(long[::-1], short[::-1]))
    return best


def fewest_edits(phrases: list[str], text: str) -> np.ndarray:
    """Per phrase its fewest edits (letters dropped, added or changed) from any stretch of ``text``.

    Bit-vector edit distance with a free start. Each phrase owns a lane of one long integer, and a spare bit
    above it takes the carry, so all phrases advance together with every letter of the text.
    """
    sizes = np.array([len(p) for p in phrases])
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    masks: dict[str, int] = {}
    full = tops = 0
    for phrase, start in zip(phrases, starts.tolist()):
        full |= ((1 << len(phrase)) - 1) << start
        tops |= 1 << (start + len(phrase) - 1)
        for char, bits in _masks(phrase).items():
            masks[char] = masks.get(char, 0) | bits << start
    last = starts + sizes - 1
    width = int(last[-1]) // 8 + 1

    def lasts(steps: list[int]) -> np.ndarray:
        rows = np.frombuffer(b"".join([x.to_bytes(width, "little") for x in steps]), np.uint8).reshape(-1, width)
        return (rows[:, last // 8] >> (last % 8).astype(np.uint8) & 1).astype(np.int32)

    more, less = full, 0
    now, fewest = sizes.astype(np.int64), sizes.astype(np.int64)
    for begin in range(0, len(text), EDIT_SLICE):
        ups, downs = [], []
        for char in text[begin : begin + EDIT_SLICE]:
            same = masks.get(char, 0)
            level = same | less
            cross = ((same & more) + more ^ more) | same
            up, down = less | full ^ ((cross | more) & full), more & cross
            ups.append(up & tops)
            downs.append(down & tops)
            up, down = up << 1 & full, down << 1 & full
            more, less = down | full ^ ((level | up) & full), up & level
        change = np.cumsum(lasts(ups) - lasts(downs), axis=0)
        fewest = np.minimum(fewest, now + change.min(axis=0))
        now = now + change[-1]
    return fewest


def may_reach(phrases: list[str], text: str, floor: float) -> np.ndarray:
    """False only where ``partial_ratio`` is below ``floor``.

    A stretch no longer than a phrase of m letters scores ``floor`` with at most 2m(1 - floor/100) letters left
    over on both sides, each of them one edit. Phrases that are not shorter than the text are let through.
    """
    may = np.ones(len(phrases), bool)
    some = [k for k, p in enumerate(phrases) if 0 < len(p) < len(text)]
    if some:
        edits = fewest_edits([phrases[k] for k in some], text)
        may[some] = [e <= 2 * len(phrases[k]) * (1 - floor / 100) + 1e-6 for e, k in zip(edits.tolist(), some)]
    return may


def token_form(text: str) -> str:
    """Lower-case letters and digits with single spaces; the upper Latin-1 half is dropped."""
    text = text.translate(_DROPPED).lower()
    return "".join(c if c.isalnum() or c == "_" else " " for c in text).strip()


def token_set_ratio(a: frozenset[str], b: frozenset[str], floor: float = 0.0) -> float:
    """Similarity of two token sets: shared tokens against each side's remainder, 0-100."""
    if not a or not b:
        return 0.0
    shared, only_a, only_b = a & b, a - b, b - a
    if shared and (not only_a or not only_b):
        return 100.0
    left, right = " ".join(sorted(only_a)), " ".join(sorted(only_b))
    base = len(" ".join(sorted(shared)))
    gap = base + bool(base)
    size_a, size_b = gap + len(left), gap + len(right)
    best = 0.0
    if shared:
        best = max(200.0 * base / (base + size_a), 200.0 * base / (base + size_b))
    total = size_a + size_b
    # The remainders cannot share more than the shorter one holds.
    if total and 100.0 - 100.0 * abs(len(left) - len(right)) / total > max(best, floor - 1):
        distance = len(left) + len(right) - 2 * _lcs(_masks(left), len(left), right)
        best = max(best, 100.0 - 100.0 * distance / total)
    return best


def phrase_score(phrase: str, text: str, threshold: int = 0) -> int:
    """Best of the stretch and the token-set score, each rounded; 0 when below ``threshold``."""
    if not phrase or not text:
        return 0
    if phrase in text:
        return 100
    return _score(phrase, frozenset(token_form(phrase).split()), text, frozenset(token_form(text).split()), threshold)


def _score(phrase: str, phrase_set: frozenset, text: str, text_set: frozenset, threshold: int) -> int:
    score = _word_score(phrase, phrase_set, text, text_set, threshold)
    if score < 100:
        score = max(score, round(partial_ratio(phrase, text)))
    return score if score >= threshold else 0


def _word_score(phrase: str, phrase_set: frozenset, text: str, text_set: frozenset, threshold: int) -> int:
    return 100 if phrase in text else round(token_set_ratio(phrase_set, text_set, threshold - 0.5))


def matches(text: str, phrases: list[str], words: list[frozenset], threshold: int) -> list[dict[str, int]]:
    """Places and scores of the phrases that reach ``threshold``; only those that may are aligned."""
    own = frozenset(token_form(text).split())
    scores = [_word_score(p, w, text, own, threshold) if p and text else 0 for p, w in zip(phrases, words)]
    left = [k for k, p in enumerate(phrases) if p and text and scores[k] < 100]
    for k, may in zip(left, may_reach([phrases[k] for k in left], text, threshold - 0.5)):
        if may:
            scores[k] = max(scores[k], round(partial_ratio(phrases[k], text)))
    return [{"pos": k, "score": s} for k, s in enumerate(scores) if s >= threshold and s > 0]


def phrase_matcher(threshold: int):
    """UDF (text, phrases) -> positions and scores of the phrases that reach ``threshold``."""

    @F.pandas_udf(MATCHES)
    def match(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        sets: dict[str, frozenset] = {}

        def words(phrase: str) -> frozenset:
            if phrase not in sets:
                if len(sets) > 50_000:
                    sets.clear()
                sets[phrase] = frozenset(token_form(phrase).split())
            return sets[phrase]

        for texts, lists in batches:
            yield pd.Series([matches(text, list(phrases), [words(p) for p in phrases], threshold) for text, phrases in zip(texts, lists)])

    return match
