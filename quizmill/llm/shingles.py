"""Distinct word-shingle sets as sorted 64-bit hashes, computed over Arrow text buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quizmill.llm.common import CHUNK_BYTES, blocks, mixed

SHINGLE_WORDS = 5

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_IS_SEPARATOR = np.zeros(256, bool)
_IS_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
#: A code for every byte, the same for both cases of A-Z.
_CODES = mixed(np.arange(256, dtype=np.uint64), 11)
_CODES[65:91] = _CODES[97:123]
_PLACE = [np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(SHINGLE_WORDS)]


def _powers_of(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base & _MASK, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_INVERSE = pow(_BASE, -1, 1 << 64)
_KEPT = (_powers_of(_BASE, 1 + CHUNK_BYTES), _powers_of(_INVERSE, 1 + CHUNK_BYTES))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers up to n; only those for a block of usual size are kept."""
    return _KEPT if n <= len(_KEPT[0]) else (_powers_of(_BASE, n), _powers_of(_INVERSE, n))


def word_hashes(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of each text's first word and the end)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    power, inverse = _power_tables(n + 1)
    word = ~_IS_SEPARATOR[raw]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    full = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    first[heads] = word[heads]
    last[tails] = word[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODES[raw] * power[:n], out=prefix[1:])
    return mixed((prefix[ends] - prefix[starts]) * inverse[starts]), np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes) for every row; fewer than five words make one shingle, none make none."""
    for row, _, offsets, raw in blocks(texts):
        words, at = word_hashes(offsets, raw)
        whole = np.zeros(0, np.uint64)
        if len(words) >= SHINGLE_WORDS:
            end = len(words) - SHINGLE_WORDS + 1
            whole = words[:end] * _PLACE[0]
            for k in range(1, SHINGLE_WORDS):
                whole = whole + words[k : end + k] * _PLACE[k]
            whole = mixed(whole)
        for i in range(len(at) - 1):
            a, b = int(at[i]), int(at[i + 1])
            if b - a >= SHINGLE_WORDS:
                found = np.sort(whole[a : b - SHINGLE_WORDS + 1])
                if len(found) > 1:
                    found = found[np.concatenate(([True], found[1:] != found[:-1]))]
            elif b > a:
                short = (words[a:b] * np.array(_PLACE[: b - a], np.uint64)).sum(dtype=np.uint64)
                found = mixed(np.array([short], np.uint64), 20 + b - a)
            else:
                found = whole[:0]
            yield row + i, found


def set_tags(found: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """A 128-bit identity of a set: two sums of mixed members."""
    return mixed(found, 1).sum(dtype=np.uint64), mixed(found, 2).sum(dtype=np.uint64)
