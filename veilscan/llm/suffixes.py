"""Sorting suffixes one bucket at a time, with a difference cover for long ties.

The texts of a block are laid out in slots, so that positions which may start
equal strings have equal residues modulo ``PERIOD``.  Positions whose residue
is in the cover are ranked first: by their next ``PERIOD`` bytes, then by
doubling, since ``PERIOD`` further on there is a cover position again.  Then
one bucket (the starts of one residue) at a time is sorted: a start is ordered
by the few bytes before the next cover position and, where these tie, by the
rank of that position, however long the tie is.  Memory holds the ranks of the
cover and one bucket.
"""

from __future__ import annotations

import numpy as np

from .common import ragged

#: A difference cover: every number modulo PERIOD is a difference of two of these.
PERIOD, COVER = 31, np.array([1, 5, 11, 24, 25, 27])


def distances() -> np.ndarray:
    """How far it is from each residue to the next one in the cover."""
    return np.array([min((c - r) % PERIOD for c in COVER.tolist()) for r in range(PERIOD)])


DISTANCE = distances()


def all_words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as numbers that sort like them."""
    return np.ndarray(len(text) - 7, ">u8", text, strides=(1,)).astype(np.uint64)


def words(every: np.ndarray, at: np.ndarray, keep: int = 8) -> np.ndarray:
    """Those of ``all_words`` at some places; only the first ``keep`` bytes of each."""
    return every[at] if keep >= 8 else (every[at] >> np.uint64(64 - 8 * keep)) if keep else np.zeros(len(at), np.uint64)


def dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks from 1 on of rows in the order of their keys; equal rows share one."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) + 1
    return rank


class Block:
    """Short texts in slots, ready to sort their starts.

    ``data`` holds the texts end to end, ``size`` their sizes; ``fix`` is a
    place in each text that gets residue 0.
    """

    def __init__(self, data: np.ndarray, size: np.ndarray, fix: np.ndarray) -> None:
        pad = -fix % PERIOD
        rows = -(-(pad + size + PERIOD) // PERIOD)
        first = np.cumsum(rows) - rows
        self.begin = first * PERIOD + pad
        self.text = np.zeros(int(rows.sum()) * PERIOD + 256, np.uint8)
        self.text[ragged(self.begin, size)] = data
        self.words = all_words(self.text)
        self.ranks = self.cover_ranks(np.repeat(np.arange(len(size)), rows), int(size.max(initial=0)))

    def cover_ranks(self, slot: np.ndarray, longest: int) -> np.ndarray:
        """Ranks of the cover positions, by period and place in the cover, to the end of their slot."""
        at = (np.arange(len(slot))[:, None] * PERIOD + COVER).reshape(-1)
        keys = [words(self.words, at), words(self.words, at + 8), words(self.words, at + 16), words(self.words, at + 24, PERIOD - 24)]
        rank = dense(*keys).reshape(-1, len(COVER))
        step = 1
        while step * PERIOD < longest:
            after = np.zeros_like(rank)
            after[:-step] = np.where((slot[step:] == slot[:-step])[:, None], rank[step:], 0)
            rank = dense(rank.reshape(-1), after.reshape(-1)).reshape(rank.shape)
            step *= 2
        return rank

    def buckets(self, group: np.ndarray, starts: np.ndarray, length: int):
        """For each bucket the starts that share their next ``length`` bytes within a group.

        ``starts[i]`` is how many starts text ``i`` has, from its first byte
        on.  Yields for each bucket ``text, start, run``: equal runs are equal
        strings, in sorted order.
        """
        text = np.repeat(np.arange(len(starts)), starts)
        start = ragged(np.zeros(len(starts), np.int64), starts)
        at = self.begin[text] + start
        residue = at % PERIOD
        by_residue = np.argsort(residue, kind="stable")
        edges = np.searchsorted(residue[by_residue], np.arange(PERIOD + 1))
        for r in range(PERIOD):
            own = by_residue[edges[r] : edges[r + 1]]
            if not len(own):
                continue
            place, far = at[own], int(DISTANCE[r])
            tie = self.ranks[(place + far) // PERIOD, int(np.searchsorted(COVER, (r + far) % PERIOD))]
            mine = group[text[own]]
            order = np.lexsort((tie, words(self.words, place + 8, max(far - 8, 0)), words(self.words, place, far), mine))
            own, place, mine = own[order], place[order], mine[order]
            new = np.ones(len(own), bool)
            new[1:] = mine[1:] != mine[:-1]
            for done in range(0, length, 8):
                content = words(self.words, place + done, length - done)
                new[1:] |= content[1:] != content[:-1]
            yield text[own], start[own], np.cumsum(new) - 1
