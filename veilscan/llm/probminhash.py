"""Near-duplicates by ProbMinHash: sketches of weighted shingles.

A shingle's weight is how often it occurs in the text.  Every shingle is a
Poisson process whose rate is its weight: its arrivals come at times drawn from
the shingle's own hash, divided by the weight, and each falls on one of
``SLOTS`` registers.  A register keeps the shingle of its earliest arrival, so
two texts agree in a register with the probability Jaccard likeness of their
weights.  Arrivals later than a text's slowest register cannot change it, so
the shingle is dropped then; most shingles need a few arrivals only.

Registers are cut into bands of ``BAND``; equal bands make candidates, whose
probability Jaccard likeness is then computed exactly from all their shingles.
With 42 bands of 6 a pair at 0.8 is missed twice in a million.

Edge cases are those of ``linking.near_classes``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import mix
from .fingerprints import band_values
from .linking import Bands, near_classes, one_of_each
from .shingles import WIDTH, shingle_hashes

SLOTS = 256
BAND = 6
GOLDEN = 0x9E3779B97F4A7C15


def weighted(shingles: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row: row, shingle, how often."""
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    order = np.lexsort((shingles, row))
    row, shingle = row[order], shingles[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])
    at = np.flatnonzero(new)
    return row[at], shingle[at], np.diff(np.append(at, len(row)))


def sketches(shingles: np.ndarray, rows: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """For each row the shingle each register kept; zeros for a row without shingles.

    Round ``i`` draws the i-th arrival of every shingle still running.
    """
    n = len(rows) - 1
    row, shingle, weight = weighted(shingles, rows)
    first = np.full((n, slots), np.inf)
    kept = np.zeros((n, slots), np.uint64)
    time = np.zeros(len(row))
    i = 0
    while len(row):
        i += 1
        draw = mix(shingle + np.uint64(i * GOLDEN % (1 << 64)))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / weight
        slot = (mix(draw) % np.uint64(slots)).astype(np.int64)
        flat = row * slots + slot
        np.minimum.at(first.reshape(-1), flat, time)
        won = first.reshape(-1)[flat] == time
        kept.reshape(-1)[flat[won]] = shingle[won]
        slowest = first.max(axis=1)
        go = time < slowest[row]
        row, shingle, weight, time = row[go], shingle[go], weight[go], time[go]
    return kept


def probability_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Exact likeness of two texts from all their shingles.

    The sum over shared shingles d of 1 / sum over all e of
    max(a[e] / a[d], b[e] / b[d]).  Ordered by a[e] / b[e], the first term is
    larger from d on and the second one before it.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    (one, n), (two, m) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    shared, i, j = np.intersect1d(one, two, assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    x, y = n[i].astype(np.float64), m[j].astype(np.float64)
    if n.max() == 1 and m.max() == 1:
        return len(shared) / (len(one) + len(two) - len(shared))
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    only_a, only_b = len(a) - x.sum(), len(b) - y.sum()
    above = only_a + np.cumsum(x[::-1])[::-1]
    below = only_b + np.cumsum(y) - y
    return float((1 / (above / x + below / y)).sum())


def bands(width: int) -> Bands:
    def of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shingles, rows = shingle_hashes(data, starts, width)
        # Bands are made of the bytes that are compared later, so both agree on who shares a band.
        kept = (mix(sketches(shingles, rows)) & np.uint64(0xFF)).astype(np.uint8)
        return band_values(kept, BAND), np.diff(rows) > 0, kept

    return of


def near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = WIDTH) -> DataFrame:
    """``doc_id, class_id`` of ``docs(doc_id, text)``; see ``linking.near_classes``."""
    return near_classes(docs, bands(width), BAND, probability_jaccard, threshold, width)


def without_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = WIDTH) -> DataFrame:
    """One row of each class of ``docs``; see ``linking.one_of_each``."""
    return one_of_each(docs, bands(width), BAND, probability_jaccard, threshold, width)
