"""Hashes of word n-grams, and a Bloom filter that tells which of them are worth leaving a scan."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Bits of the filter, as powers of two: 64 for each hash, 32 MB at most; and probes of a hash.
LEAST_BITS, MOST_BITS = 16, 28
PROBES = [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93]


class WordHashes(dict):
    """64-bit hashes of words, remembered; emptied when it has grown large."""

    MOST = 1 << 20

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = self[word] = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter((self[w] for w in words), dtype=np.uint64, count=len(words))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` of the word hashes ``h``, as signed numbers."""
    out = np.zeros(max(0, len(h) - n + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ h[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
    return out.astype(np.int64)


def _bit_of(h: np.ndarray, probe: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((h.astype(np.uint64) * np.uint64(probe)) >> np.uint64(65 - bits.bit_length())).astype(np.int64)


def bloom_filter(hashes: DataFrame, column: str) -> np.ndarray:
    """A filter of all hashes of a column.  It is or-ed in eight tasks, so the driver gets eight filters at most."""
    n = hashes.count()
    bits = 1 << min(MOST_BITS, max(LEAST_BITS, (64 * n).bit_length()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(bits // 8, dtype=np.uint8)
        for b in batches:
            for probe in PROBES:
                at = _bit_of(b[column].to_numpy(), probe, bits)
                np.bitwise_or.at(held, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pd.DataFrame({"m": [held.tobytes()]})

    total = np.zeros(bits // 8, dtype=np.uint8)
    for r in hashes.select(column).coalesce(8).mapInPandas(run, "m binary").toLocalIterator():
        total |= np.frombuffer(r["m"], dtype=np.uint8)
    return total


def passing(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes that the filter knows; each probe looks only at what the ones before it let pass."""
    left = np.arange(len(hashes))
    for probe in PROBES:
        at = _bit_of(hashes[left], probe, len(held) * 8)
        left = left[((held[at >> 3] >> (at & 7)) & 1).astype(bool)]
    return left
