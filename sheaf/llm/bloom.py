"""A Bloom filter over 64-bit hashes, of bounded size, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 12
MOST_BITS = 1 << 28
"""32 MB at most. Beyond a few hundred million keys more and more others pass too."""
_PROBES = 4


@dataclass(frozen=True)
class Bloom:
    """What is in it always passes; of the rest about 1 in 100, as long as it is not full."""

    words: np.ndarray

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), dtype=bool)
        for place, bit in _places(hashes, len(self.words)):
            found &= self.words[place] & bit != 0
        return found


def _places(hashes: np.ndarray, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word and bit of each probe; words are a power of two."""
    first, step = hashes.view("u8"), (hashes.view("u8") >> np.uint64(32)) | np.uint64(1)
    for k in range(_PROBES):
        at = first + step * np.uint64(k)
        yield (at >> np.uint64(6)) & np.uint64(words - 1), np.uint64(1) << (at & np.uint64(63))


def bloom_of(hashes: DataFrame, column: str, keys: int) -> Bloom:
    """The filter of a column of hashes, of which there are about ``keys``."""
    bits = min(MOST_BITS, max(1 << 12, keys * BITS_PER_KEY))
    words = 1 << ((bits - 1).bit_length() - 6)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(words, dtype="u8")
        for batch in batches:
            for place, bit in _places(batch.column(0).to_numpy(zero_copy_only=False), words):
                np.bitwise_or.at(own, place, bit)
        at = np.flatnonzero(own)
        for start in range(0, len(at), 1 << 16):
            some = at[start : start + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(own[some].view("i8"))], names=["word", "bits"])

    marks = hashes.select(F.col(column).cast("bigint")).mapInArrow(mark, "word bigint, bits bigint")
    table = marks.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(words, dtype="u8")
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy().view("u8")
    return Bloom(out)
