"""Few phrases sought in every text: candidates by one telling word, in numpy over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _codes(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Text and number of every word, and the distinct words."""
    coded = words.flatten().dictionary_encode()
    text = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
    return text, coded.indices.to_numpy(), coded.dictionary


def _holding(text: np.ndarray, code: np.ndarray, wanted: np.ndarray, phrases: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(text, phrases) for texts that hold a word; ``wanted`` gives a word's place in ``phrases``, -1 for none."""
    at = np.flatnonzero(wanted[code] >= 0)
    pairs = np.unique(text[at].astype(np.int64) * (len(phrases) + 1) + wanted[code[at]])
    owner, place = pairs // (len(phrases) + 1), pairs % (len(phrases) + 1)
    cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]][: len(owner)])
    for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(owner)]):
        yield int(owner[a]), np.concatenate([phrases[p] for p in place[a:z].tolist()])


def _by_key(keys: list[str | None]) -> tuple[pa.Array, list[np.ndarray]]:
    held: dict[str, list[int]] = {}
    for i, key in enumerate(keys):
        if key is not None:
            held.setdefault(key, []).append(i)
    return pa.array(list(held), pa.string()), [np.array(v) for v in held.values()]


def tiers(norm_text: pa.Array, own_words: pa.ListArray, forms: list[str], sets: list[frozenset], keys: list[str | None], longest: list[str | None]):
    """(text, phrase, tier): 1 where the text contains the form, or else 2 where it holds all words of a set that is not empty.

    ``keys``: a whole word of any text that contains the form, None for forms of one or two words. Those
    are looked for among the distinct words of the batch, which a text's word must contain or end with.
    """
    size = len(forms)
    texts, words = norm_text, pc.split_pattern(norm_text, " ")
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    found: dict[int, int] = {}
    text, code, distinct = _codes(words)
    vocabulary, phrases = _by_key(keys)

    def wanted(values: pa.Array, known: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(values, value_set=known), -1).to_numpy().astype(np.int64)

    def test(t: int, some: np.ndarray) -> None:
        whole = texts[t].as_py()
        for p in some.tolist():
            if forms[p] in whole:
                found[t * size + p] = 1

    if len(distinct):
        for t, some in _holding(text, code, wanted(distinct, vocabulary), phrases):
            test(t, some)
        for p, (form, key) in enumerate(zip(forms, keys)):
            if key is None:
                first = form.split(" ")
                fits = pc.match_substring(distinct, form) if len(first) == 1 else pc.ends_with(distinct, first[0])
                if pc.any(fits).as_py():
                    for t in np.unique(text[fits.to_numpy(zero_copy_only=False)[code]]).tolist():
                        test(t, np.array([p]))
    text, code, distinct = _codes(own_words)
    vocabulary, phrases = _by_key(longest)
    if len(distinct):
        for t, some in _holding(text, code, wanted(distinct, vocabulary), phrases):
            own = None
            for p in some.tolist():
                if t * size + p not in found:
                    own = own if own is not None else frozenset(own_words[t].as_py())
                    if sets[p] <= own:
                        found[t * size + p] = 2
    cell = np.fromiter(found, dtype=np.int64, count=len(found))
    return cell // size, cell % size, np.fromiter(found.values(), dtype=np.int64, count=len(found))
