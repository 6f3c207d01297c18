"""Language ID as a mixture: EM finds the share of each language in a document.

Languages are distributions over hashed byte trigrams of the lower-cased text, learned from labelled rows.
A document's language set grows from its best single language by the one that raises the likelihood most,
as long as the gain beats a penalty in the logarithm of the document's length; EM sets the shares.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.llm.tables import mapped, release

FEATURES = 1 << 16
MOST_LANGUAGES = 256
UNKNOWN = "und"


def trigrams(text: str) -> np.ndarray:
    data = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    return ((data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(16)


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    tables: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if lang not in tables:
                if len(tables) == MOST_LANGUAGES:
                    raise ValueError(f"more than {MOST_LANGUAGES} languages")
                tables[lang] = np.zeros(FEATURES, np.int64)
            tables[lang] += np.bincount(trigrams(text), minlength=FEATURES)
    for lang, table in tables.items():
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(table[at])], ["lang", "feature", "n"])


class Mixture:
    """Log-probabilities of the features in each language, languages in the order of their names."""

    def __init__(self, names: list[str], logs: np.ndarray, penalty: float = 6.0, rounds: int = 12):
        self.names, self.logs, self.penalty, self.rounds = names, logs, penalty, rounds

    def shares(self, text: str) -> dict[str, float]:
        """The chosen languages with their shares; none if there is nothing to choose."""
        feature, times = np.unique(trigrams(text), return_counts=True)
        logs = self.logs[:, feature]
        top = logs.max(axis=0)
        likely = np.exp(logs - top)
        total = times.sum()
        chosen = [int(np.argmax(logs @ times))]
        share, fit = np.ones(1), float(np.log(likely[chosen[0]]) @ times)
        while len(chosen) < len(self.names):
            slope = likely @ (times / (share @ likely[chosen])) - total
            slope[chosen] = -1
            more = int(np.argmax(slope))
            if slope[more] <= 0:
                break
            trial = [*chosen, more]
            found, gain = self._em(likely[trial], times, np.r_[share * 0.9, 0.1])
            if gain - fit <= self.penalty * np.log(total):
                break
            chosen, share, fit = trial, found, gain
        return {self.names[k]: float(s) for k, s in zip(chosen, share, strict=True)}

    def _em(self, likely: np.ndarray, times: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
        for _ in range(self.rounds):
            share = share * (likely @ (times / (share @ likely)))
            share = share / share.sum()
        return share, float(np.log(share @ likely) @ times)

    def judge(self, text: str | None) -> tuple[str, float]:
        if not text or not self.names or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        shares = self.shares(text)
        best = max(shares, key=lambda name: (shares[name], name))
        return best, min(1.0, shares[best])


def fit(docs: DataFrame, learn: Column, lang: str = "lang", text: str = "text") -> Mixture:
    """Counts over all rows that ``learn`` names and that have a language and a text; a model has 65,536
    numbers for each of at most 256 languages (more raise an error), whatever the corpus."""
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counted = rows.mapInArrow(_counts, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    found = counted.toPandas()
    names = sorted(found["lang"].unique())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    table = np.full((len(names), FEATURES), 0.5)
    place = {name: k for k, name in enumerate(names)}
    table[found["lang"].map(place).to_numpy(int), found["feature"].to_numpy()] += found["n"].to_numpy()
    return Mixture(names, np.log(table / table.sum(axis=1, keepdims=True)))


def language(docs: DataFrame, model: Mixture, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the language of the largest share and that share. Null texts and texts without a letter
    are ``und`` with score 0; columns of these names are replaced; rows stay as they are, repeated or not."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[pa.Array], pa.Array]:
        judge = sent.value.judge

        def one(batch: pa.Array) -> pa.Array:
            found = [judge(t) for t in batch.to_pylist()]
            return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang", "score"])

        return one

    judged = docs.withColumn("__judged", mapped(make, "struct<lang:string,score:double>")(F.col(text)))
    return judged.withColumns({pred: F.col("__judged.lang"), score: F.col("__judged.score")}).drop("__judged")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; one without an id is, but isn't counted as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
