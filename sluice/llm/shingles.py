"""Word shingles of whole texts as 64-bit hashes, computed on Arrow's own byte buffers with numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased; a shingle is five words in a row.
The hash of a word is a polynomial over its bytes modulo 2**64, taken from running sums, so that a block of texts
costs a few passes over its bytes whatever its words are. Blocks are cut at about BLOCK bytes, between documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SHINGLE = 5
BLOCK = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)

_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, BLOCK + (BLOCK >> 1))
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def blocks(texts: pa.Array):
    """(first row, end row, bytes, offsets from 0) of runs of rows; null texts are empty."""
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    n = len(texts)
    if not n:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of every word of a block, and each text's first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = _IS_WORD[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[data] if lower else data).astype(np.uint64) * up[:n], out=total[1:])
    value = (total[end] - total[begin]) * down[begin]
    value = mix(value + (end - begin).astype(np.uint64))
    return value, begin, end, np.searchsorted(begin, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Each text's distinct shingles, ascending. Fewer than five words make one shingle; no words make none."""
    value, _, _, first = words(data, offsets)
    if len(value) >= SHINGLE:
        rows = len(value) - SHINGLE + 1
        rolled = value[:rows].copy()
        for k in range(1, SHINGLE):
            rolled *= _STEP
            rolled += value[k : k + rows]
        rolled = mix(rolled)
    out = []
    for i in range(len(offsets) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= SHINGLE:
            out.append(np.unique(rolled[a : b - SHINGLE + 1]))
        elif b > a:
            short = np.array([b - a], np.uint64)
            for w in value[a:b]:
                short = mix(short * _STEP + w)
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
