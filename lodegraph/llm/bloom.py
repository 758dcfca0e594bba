"""A Bloom filter of bounded size over ids, built and tested in Arrow tasks.

It only thins what a scan sends on: an exact join always follows. With more ids than its
largest size is meant for it lets more through, so callers never need another plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm import textkernel as K

#: 2**28 bits (32 MB) hold 16 million ids at 16 bits each.
MAX_BITS, BITS_PER_ID = 28, 16
_U = np.uint64


def _places(words: np.ndarray, bits: int) -> np.ndarray:
    """Three bits of the filter for each id."""
    with np.errstate(over="ignore"):
        h = K.mix(words.astype(np.int64).view(_U) + _U(0x9E3779B97F4A7C15))
        return np.stack([(h >> _U(s)) & _U((1 << bits) - 1) for s in (0, 18, 36)])


class Bloom:
    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def has(self, words: np.ndarray) -> np.ndarray:
        out = np.ones(len(words), dtype=bool)
        for at in _places(words, self.bits):
            out &= (self.words[(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1) == 1
        return out


def _set(column: str, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(_places(np.asarray(b[column]), bits).reshape(-1))
            word, first = np.unique(at >> _U(6), return_index=True)
            value = np.bitwise_or.reduceat(_U(1) << (at & _U(63)), first) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], names=["word", "bits"])

    return run


def build(ids: DataFrame, column: str, max_bits: int = MAX_BITS) -> Bloom:
    """A filter over longs that are not null."""
    bits = min(max(12, int(ids.count() * BITS_PER_ID).bit_length()), max_bits)
    found = ids.select(column).mapInArrow(_set(column, bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), dtype=_U)
    words[found["word"].to_numpy()] = found["bits"].to_numpy().view(_U)
    return Bloom(words, bits)
