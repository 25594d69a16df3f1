"""Helpers shared by the operators here: bounded Arrow chunks, word hashes, tables."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

CHUNK_BYTES = 4 << 20


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, changed where ``df`` has a column of that name (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(batches, column: str, limit: int = CHUNK_BYTES):
    """Slices of the batches whose ``column`` holds at most ``limit`` bytes of
    text (or one row): memory in a task follows the chunk, not the batch."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        end = np.cumsum(size.astype(np.int64))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(end, (end[i - 1] if i else 0) + limit, "right")))
            yield b.slice(i, j - i)
            i = j


def texts(batch, column: str) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def release() -> None:
    """Give freed memory back to the system, where the allocator can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run):
    """``run`` for mapInArrow, giving its memory back when the task ends: Spark keeps
    Python workers for later stages, and what idle ones hold counts for the executor."""

    def task(batches):
        yield from run(batches)
        release()

    return task


def ship(spark: SparkSession, path: str) -> str:
    """Send a file of the driver to the executors; SparkFiles.get finds it under
    the name returned."""
    spark.sparkContext.addFile(path)
    return path.rstrip("/").rsplit("/", 1)[-1]


@contextlib.contextmanager
def sharing(spark: SparkSession):
    """A function that broadcasts values; on leaving, all of them are released.
    For tables that are written before the end, as nothing may read them later."""
    held = []

    def share(value):
        held.append(spark.sparkContext.broadcast(value))
        return held[-1]

    try:
        yield share
    finally:
        for b in held:
            b.destroy()


class WordHash(dict):
    """64-bit hash of a word, remembered up to a bounded number of words."""

    LIMIT = 200_000

    def __missing__(self, w: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        v = self[w] = xxhash.xxh64_intdigest(w)
        return v

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * M2
    return h ^ (h >> np.uint64(32))


def shingle_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit hash per k-word shingle in order; a shorter, non-empty text
    is one shingle of all its words (its length is part of the hash)."""
    n = len(word_hashes)
    if n == 0:
        return word_hashes
    m = min(k, n)
    h = np.full(n - m + 1, m, np.uint64)
    for i in range(m):
        h = (h + word_hashes[i : n - m + 1 + i]) * M1
        h ^= h >> np.uint64(31)
    return mix(h)


