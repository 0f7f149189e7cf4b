"""Word and shingle hashes of whole Arrow batches, vectorised over all their texts.

A word is a maximal run of bytes other than space and 0x09-0x0D, with A-Z lower-cased. Its 64-bit hash is
read off prefix sums of a polynomial modulo 2**64, so no Python object is made for a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

K = 5  # words in a shingle
BLOCK = 1 << 21  # bytes hashed at once

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Separators for words of letters and digits only: every other ASCII byte.
LETTERS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint64)
_KEPT = _LOWER + np.uint64(1)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Scramble 64-bit words (splitmix finaliser)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        m = max(n, BLOCK + 1)
        _powers[:] = [np.concatenate([[np.uint64(1)], np.full(m - 1, v, np.uint64)]).cumprod(dtype=np.uint64) for v in (_BASE, pow(_BASE, -1, 2**64))]
    return _powers[0][:n], _powers[1][:n]


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def blocks(batches, column: str = "text", size: int = 2 * BLOCK):
    """The batches cut so that each holds about ``size`` bytes of text; a longer text is whole. Hashing takes several times a text's bytes."""
    for batch in batches:
        block = np.cumsum(np.diff(text_buffers(batch.column(column))[1])) // size
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for at, end in zip(edges[:-1], edges[1:], strict=True):
            if end > at:
                yield batch.slice(at, end - at)


def word_spans(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word; a text's end also ends its word."""
    solid = ~separators[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    before = np.empty(len(raw), bool)
    if len(raw):
        before[0] = False
        before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | first[:-1]))
    after = np.zeros(len(raw), bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    return starts, ends


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each word, block by block, so memory stays bounded for long texts; ``lower`` makes A-Z and a-z one."""
    code = _LOWER if lower else _KEPT
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + BLOCK, "right")))
        hi = ends[j - 1]
        power, inverse = _pow(int(hi - lo) + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(code[raw[lo:hi]] * power[:-1], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def batch_words(column, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where each text's words begin (one more entry at the end)."""
    raw, offsets = text_buffers(column)
    starts, ends = word_spans(raw, offsets, separators)
    return word_hashes(raw, starts, ends), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hash of every k consecutive words, in order; of fewer than k words, one hash of them all."""
    n = len(words)
    width = min(k, n)
    if not n:
        return words
    total = np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        total += words[j : n - width + 1 + j] * np.uint64(pow(0xD1342543DE82EF95, j + 1, 2**64))
    return mix(total, width)


def batch_shingles(column, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in order, and where each text's begin."""
    words, at = batch_words(column)
    counts = np.diff(at)
    sizes = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(first[-1], np.uint64)
    if len(words) >= k:
        whole = shingle_hashes(words, k)
        long = np.flatnonzero(counts >= k)
        if len(long):
            target = np.repeat(first[long] - np.concatenate([[0], np.cumsum(sizes[long])[:-1]]), sizes[long]) + np.arange(sizes[long].sum())
            source = np.repeat(at[long] - np.concatenate([[0], np.cumsum(sizes[long])[:-1]]), sizes[long]) + np.arange(sizes[long].sum())
            out[target] = whole[source]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        out[first[i]] = shingle_hashes(words[at[i] : at[i + 1]], k)[0]
    return out, first
