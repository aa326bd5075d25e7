"""Bloom filters over keys that are pairs of 64-bit hashes: built by Spark, probed in numpy.

A partition's keys become words of 64 bits, words of one place are joined by `bit_or` with partial sums
map-side, and the driver receives the filter itself: at most MOST_BITS / 64 rows, whatever the number of keys.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.llm.common import U64, mix, salt

MOST_BITS = 1 << 28  # 32 MB; who needs more parts the keys


def shape(n: int, p: float) -> tuple[int, int]:
    """Bits, a multiple of 64, and number of hashes of a filter for n keys at a false-positive rate of p."""
    hashes = max(1, round(-math.log2(p)))
    return max(64, math.ceil(n * -math.log2(p) / math.log(2) / 64) * 64), hashes


def _place(a: np.ndarray, b: np.ndarray, which: int, bits: int, number: int) -> np.ndarray:
    """The keys' bit by one hash function of filter `number`."""
    step = mix(b + salt(2 * number + 2)) | U64(1)
    return (mix(a + salt(2 * number + 1)) + U64(which) * step) % U64(bits)


@dataclass(frozen=True)
class Bloom:
    words: np.ndarray
    hashes: int
    number: int

    @property
    def bits(self) -> int:
        return 64 * len(self.words)

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """True for every key put in, and for others with the filter's false-positive rate."""
        out = np.ones(len(a), bool)
        left = np.arange(len(a))
        for k in range(self.hashes):
            place = _place(a[left], b[left], k, self.bits, self.number)
            hit = (self.words[(place >> U64(6)).astype(np.int64)] >> (place & U64(63))) & U64(1) == 1
            out[left[~hit]] = False
            left = left[hit]
        return out


def _words(bits: int, hashes: int, number: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).to_numpy().view(U64) for k in (0, 1))
            places = np.unique(np.concatenate([_place(a, b, k, bits, number) for k in range(hashes)]))
            word = (places >> U64(6)).astype(np.int64)
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            if len(starts):
                joined = np.bitwise_or.reduceat(U64(1) << (places & U64(63)), starts)
                yield pa.RecordBatch.from_arrays([pa.array(word[starts]), pa.array(joined.view(np.int64))], ["word", "bits"])

    return run


def built(keys: DataFrame, n: int, p: float, number: int = 0) -> Bloom:
    """A filter of the n rows of keys (two columns of longs); filters of other numbers have other hash functions."""
    bits, hashes = shape(n, p)
    if bits > MOST_BITS:
        raise ValueError(f"a filter of {bits} bits is above {MOST_BITS}; part the keys")
    found = keys.mapInArrow(_words(bits, hashes, number), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(bits // 64, U64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(U64)
    return Bloom(words, hashes, number)
