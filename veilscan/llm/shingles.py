"""Hashes of word shingles for whole batches of texts.

A word is a run of bytes other than ASCII white space, as it stands.  A text of
fewer words than a shingle has one shingle of all its words; a text without
words has none.  Words and shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np

from .common import mix, ragged, span_hashes

WIDTH = 5
CHUNK = 1 << 19
STEP = np.uint64(0xD6E8FEB86659FD93)


def word_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and the first word of each row (one more than rows)."""
    word = (data != 32) & ((data < 9) | (data > 13))
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = starts[(starts > 0) & (starts < len(data))]
    first[inner] = word[inner]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[inner - 1] = word[inner - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(begin, starts)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word; the bytes are taken in chunks so that arrays stay small."""
    out = np.empty(len(begin), np.uint64)
    lo = 0
    while lo < len(begin):
        hi = max(lo + 1, int(np.searchsorted(end, begin[lo] + CHUNK, side="right")))
        a, b = int(begin[lo]), int(end[hi - 1])
        out[lo:hi] = span_hashes(data[a:b], begin[lo:hi] - a, end[lo:hi] - a)
        lo = hi
    return out


def shingle_hashes(data: np.ndarray, starts: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all rows end to end, and where each row's begin."""
    begin, end, rows = word_spans(data, starts)
    words = word_hashes(data, begin, end)
    n_words = np.diff(rows)
    n = np.where(n_words > 0, np.maximum(n_words - width + 1, 1), 0)
    at, limit = ragged(rows[:-1], n), np.repeat(rows[1:], n)
    out = np.zeros(len(at), np.uint64)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    for k in range(width):
        out = out * STEP + np.where(at + k < limit, padded[at + k], np.uint64(0))
    return mix(out), np.concatenate([[0], np.cumsum(n)])
