"""Tokens and their hashes for whole Arrow batches, in numpy, without a Python object per word.

A text's UTF-8 bytes are read in place. Runs of bytes of one class are tokens; a token's hash
comes from differences of one prefix sum over the bytes, so every token costs the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE, WORD, MARK = 0, 1, 2
CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(20240611)
_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

CLASSES = np.full(256, MARK, np.uint8)
CLASSES[128:] = WORD
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    CLASSES[_c] = WORD
for _c in b" \t\n\v\f\r":
    CLASSES[_c] = SPACE
#: Every byte but white space in one class.
SOLID = np.where(CLASSES == SPACE, SPACE, WORD).astype(np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit over all others."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    size = max(CHUNK_BYTES + 1, 1 << max(0, n - 1).bit_length())
    if size not in _powers:
        made = []
        for base in (BASE, _INVERSE):
            p = np.empty(size, np.uint64)
            p[0], k = 1, 1
            while k < size:
                m = min(k, size - k)
                p[k : k + m] = p[:m] * np.uint64(pow(base, k, 1 << 64))
                k += m
            made.append(p)
        if size > CHUNK_BYTES + 1:  # made for one very long text; not kept
            return made[0], made[1]
        _powers[size] = (made[0], made[1])
    return _powers[size]


def prefix(data: np.ndarray) -> np.ndarray:
    """sums[i] is the weighted sum of the first i bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * powers(len(data))[0][: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span that doesn't depend on where it lies."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def chunks(texts: pa.Array, lower: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of its texts in them) for pieces of about CHUNK_BYTES of whole texts.

    Nulls count as empty texts.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        last = int(np.searchsorted(bounds, bounds[row] + CHUNK_BYTES, "right")) - 1
        last = min(len(texts), max(row + 1, last))
        yield row, whole[bounds[row] : bounds[last]], (bounds[row : last + 1] - bounds[row]).astype(np.int64)
        row = last


def tokens(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray = CLASSES) -> tuple[np.ndarray, ...]:
    """(start, end, class, text number) of the tokens: runs of bytes of one class within a text, but white space."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint8), none
    kind = classes[data]
    edge = np.empty(len(data), bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    inner = offsets[1:-1]
    edge[inner[inner < len(data)]] = True
    start = np.flatnonzero(edge)
    end = np.append(start[1:], len(data))
    kinds = kind[start]
    solid = kinds != SPACE
    start, end, kinds = start[solid], end[solid], kinds[solid]
    return start, end, kinds, np.searchsorted(offsets, start, "right") - 1


def grams(h: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each n consecutive tokens of one text."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = out * np.uint64(BASE) + h[k : len(h) - n + 1 + k]
    same = text[: len(h) - n + 1] == text[n - 1 :]
    return mix(out[same]), text[: len(h) - n + 1][same]
