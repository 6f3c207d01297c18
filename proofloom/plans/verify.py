"""Phrase verification end to end."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from proofloom.operators import verify as v
from proofloom.session import stored


class Verified(NamedTuple):
    verification: DataFrame
    locations: DataFrame


def verify_phrases(section_phrases: DataFrame, chunks: DataFrame, fuzzy: bool = True, written: bool = False) -> Verified:
    """Verdict per (document, phrase) and every place found.

    Chunks and phrases are each written once: all passes and the locations read them. ``written`` says that
    ``chunks`` is read from files already, so that no second copy is made.
    """
    chunks = chunks if written else stored(chunks, "chunks")
    phrases = stored(v.with_forms(v.phrases_to_verify(section_phrases)), "phrases")
    single, crossed, lenient = v.match_passes(phrases, chunks, fuzzy)
    locations = v.locate(single, crossed, lenient, chunks)
    return Verified(v.verification(phrases, single, crossed, lenient), locations)
