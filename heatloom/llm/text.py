"""Texts of a record batch as numpy arrays: bytes, words, hashes and word shingles."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _power(base: np.uint64, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        grown = np.full(max(n, 1 << 20), base, np.uint64)
        grown[0] = 1
        _powers[base] = np.multiply.accumulate(grown)
    return _powers[base][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the n + 1 offsets of its rows; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, at, data = column.buffers()
    if not len(column) or at is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes, or one longer row."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, min(end, n)
        row = end


class Words(NamedTuple):
    """Words of a block in order: hash, row within the block, byte range."""

    hash: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words are runs of ASCII letters (A-Z lower-cased), digits and bytes from 0x80 on, within one row."""
    n = len(data)
    low = _LOWER[data]
    inside = _IN_WORD[low]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | first[:n]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | first[1:])) + 1
    return Words(span_hash(low, start, end), np.searchsorted(offsets, start, "right") - 1, start, end)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: a polynomial over random byte values, then mixed with the length."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=total[1:])
    inverse = _power(_INVERSE, len(data) + 1)
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries; entry i covers i to i + k - 1."""
    n = max(0, len(hashes) - k + 1)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = mix(out * _BASE + hashes[j : j + n])
    return out


class Shingles(NamedTuple):
    """Distinct shingles of each row, in order of row and hash, with their counts."""

    hash: np.ndarray
    row: np.ndarray
    count: np.ndarray


def shingles(found: Words, rows: int, k: int) -> Shingles:
    """Bags of runs of k words. A row of fewer words, but not none, has one shingle of all of them."""
    size = np.bincount(found.row, minlength=rows)
    first = np.cumsum(size) - size
    whole = grams(found.hash, k)
    keep = found.row[: len(whole)] == found.row[k - 1 : k - 1 + len(whole)]
    hashes, row = [whole[keep]], [found.row[: len(whole)][keep]]
    for n in range(1, k):
        short = np.flatnonzero(size == n)
        if len(short):
            hashes.append(grams(found.hash, n)[first[short]])
            row.append(short)
    h, r = np.concatenate(hashes), np.concatenate(row)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    return Shingles(h[at], r[at], np.diff(np.append(at, len(h))))


def range_mix(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of ranges of entries, by a polynomial over the entries."""
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _power(_BASE, len(hashes)), out=total[1:])
    inverse = _power(_INVERSE, len(hashes) + 1)
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
