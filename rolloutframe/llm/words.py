"""Words of whole texts as arrays: places, 64-bit hashes and n-gram hashes.

A word border is always an ASCII byte, so UTF-8 bytes are classified directly.
A word's hash is a polynomial in random byte values, read off a running sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_MULTIPLIER, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_BYTES = np.arange(256)
#: Bytes that belong to words.
NOT_SPACE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
ALPHANUMERIC = (
    ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
)
_LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of the public splitmix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))
_powers = {_MULTIPLIER: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        values = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        values[0] = 1
        _powers[base] = np.multiply.accumulate(values)
    return _powers[base][:n]


@dataclass
class Words:
    """Words of consecutive documents; ``first`` has a border more than there are documents."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def room(self) -> np.ndarray:
        """Words from each word to the end of its document, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))

    def ngrams(self, n: int, seed: int = 0) -> np.ndarray:
        """Hash of the n words from each word on; those that cross a document's end mean nothing."""
        own = self.hashes if not seed else mix(self.hashes ^ np.uint64(seed))
        size = max(0, len(own) - n + 1)
        total = own[:size].copy()
        for j in range(1, n):
            total *= np.uint64(_MULTIPLIER)
            total += own[j : j + size]
        return mix(total)


def words_of(texts: pa.Array, word_bytes: np.ndarray = NOT_SPACE, lower: bool = False) -> Words:
    """Words of string values (null: none); A-Z lower-cased where asked for."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    base, size = int(offsets[0]), int(offsets[-1] - offsets[0])
    if not size:
        none = np.empty(0, np.int64)
        return Words(np.empty(0, np.uint8), none, none, np.zeros(len(texts) + 1, np.int64), none.astype(np.uint64))
    data = np.frombuffer(texts.buffers()[2], np.uint8)[base : base + size]
    offsets = offsets - base
    if lower:
        data = _LOWER[data]
    inside = word_bytes[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    borders = offsets[(offsets > 0) & (offsets < size)]
    before[borders] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[borders - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    sums = np.empty(size + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_VALUE[data] * _power(_MULTIPLIER, size), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _power(_INVERSE, size)[starts])
    return Words(data, starts, ends, np.searchsorted(starts, offsets), hashes)


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of about ``most`` bytes of text at most (a longer text comes alone)."""
    for batch in batches:
        if not len(batch):
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        total = np.cumsum(sizes)
        at = 0
        while at < len(batch):
            base = int(total[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    span, best = 1, values
    while span * 2 <= width:
        best = np.minimum(best[: len(best) - span], best[span:])
        span *= 2
    rest = width - span
    return np.minimum(best[: len(best) - rest], best[rest:]) if rest else best
