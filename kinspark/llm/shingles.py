"""Hashes of words and word shingles of whole Arrow batches, without a Python object per word.

Words are maximal runs of anything but ASCII white space. A word's hash takes its bytes eight at a time and mixes
after each, so that no two spellings cancel out; a shingle's hash combines those of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a little-endian number; zeros follow the last byte."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))


def first_bytes(eight: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of eight bytes the first n (1 to 8; more count as 8), the others zero."""
    return eight & (~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * np.clip(n, 1, 8).astype(np.uint64)))


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (nulls: empty) and the offsets of each."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a batch of texts: ``hashes``, byte ``starts`` and ``ends``, and ``offsets`` per text."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        self.data, self.text_offsets = buffer_of(texts)
        data, offsets = self.data, self.text_offsets
        inside = ~_SPACE[data]
        begins = np.zeros(len(data) + 1, dtype=bool)
        begins[offsets] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | begins[1:-1]
        last[:-1] &= ~inside[1:] | begins[1:-1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.offsets = np.searchsorted(self.starts, offsets)
        eight = eights(_LOWER[data] if lower else data)
        lengths = self.ends - self.starts
        self.hashes = mix(lengths.astype(np.uint64))
        left, done = np.arange(len(lengths)), 0
        while len(left):
            part = first_bytes(eight[self.starts[left] + done], lengths[left] - done)
            self.hashes[left] = mix(self.hashes[left] ^ part)
            done += 8
            left = left[lengths[left] > done]

    def shingles(self, size: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``size`` words, and their offsets per text.

        ``short``: a text with fewer words (but one at least) has its whole sequence as one.
        """
        counts = np.diff(self.offsets)
        own = np.maximum(counts - size + 1, 0)
        total = np.zeros(max(len(self.hashes) - size + 1, 0), dtype=np.uint64)
        for j in range(size):
            total += self.hashes[j : j + len(total)] * np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64))
        text = np.repeat(np.arange(len(counts)), own)
        first = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(self.offsets[:-1], own)
        del text
        found = mix(total[first])
        offsets = np.r_[0, np.cumsum(own)]
        if short and ((counts > 0) & (counts < size)).any():
            few = np.flatnonzero((counts > 0) & (counts < size))
            whole = np.zeros(len(few), dtype=np.uint64)
            for j in range(size - 1):
                has = counts[few] > j
                h = self.hashes[np.where(has, self.offsets[few] + j, 0)]
                whole += np.where(has, h * np.uint64(pow(0xA0761D6478BD642F, j + 1, 1 << 64)), np.uint64(0))
            found = np.insert(found, offsets[few], mix(whole ^ counts[few].astype(np.uint64)))
            own[few] = 1
            offsets = np.r_[0, np.cumsum(own)]
        return found, offsets


def distinct(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, and their offsets."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    keep = np.ones(len(hashes), dtype=bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    hashes, text = hashes[keep], text[keep]
    return hashes, np.searchsorted(text, np.arange(len(offsets)))


def slices(batch: pa.RecordBatch, column: int, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``size`` bytes of text each (a longer text is a part of its own)."""
    texts = batch.column(column)
    if len(texts) == 0:
        return
    _, offsets = buffer_of(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
