"""Small helpers shared by the text operators."""

from __future__ import annotations

import base64
import ctypes
import gc
import sys
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.session import checkpoint_root, stored

BATCH_BYTES = str(4 << 20)
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

__all__ = ["ASCII_UPPER", "bounded_batches", "checkpoint_root", "joined", "kept_for", "lower_ascii", "mapped", "read_ranks", "release", "stored", "table", "text_key"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches end after 4 MB of input, so that long texts do not pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a tiktoken file; read on the driver, a few MB at most."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and no other letter changed; pure ASCII takes the fast way."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_UPPER.lower()))


def text_key(text: Column) -> Column:
    """Tells rows that share an id but not a text apart; null and empty differ."""
    return F.xxhash64(text.isNull(), text)


KEPT: dict[object, object] = {}


def kept_for(key: object, build: Callable[[], object]) -> object:
    """What a Python worker keeps for later tasks of the same kind; it keeps one thing at a time."""
    if key not in KEPT:
        release()
        KEPT[key] = build()
    return KEPT[key]


def release() -> None:
    """Tasks of another kind give back what their worker kept, to the system where it can take it. Big tasks do so
    again at their end, since an idle worker's memory counts too."""
    KEPT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def mapped(make: Callable[[], Callable[[pa.Array], pa.Array]], returns: str, keeps: bool = False) -> Callable[..., Column]:
    """An Arrow function of one column; ``make`` runs once per task and gives the batch function."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not keeps:
            release()
        one, batch = make(), None
        for batch in batches:
            yield one(batch)
        if not keeps:
            one = batch = None
            release()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, returns)


def joined(parts: list[bytes], kind: pa.DataType, dtype: type) -> pa.Array:
    """A list array whose rows are the given packed numbers."""
    size = np.dtype(dtype).itemsize
    offsets = np.fromiter(chain((0,), (len(p) // size for p in parts)), np.int64, len(parts) + 1).cumsum()
    values = pa.array(np.frombuffer(b"".join(parts), dtype), kind)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
