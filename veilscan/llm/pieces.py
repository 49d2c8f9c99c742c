"""Cutting text where no token can cross, and encoding each distinct piece once.

A byte-pair tokenizer first splits a text by a pattern; no token crosses such a
split.  Splits between plain classes of bytes (white space, Latin letters,
digits, ASCII punctuation) can be seen in the bytes alone, so numpy cuts whole
batches there.  Real corpora repeat their words, so every distinct piece is
encoded once per worker and remembered.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pandas as pd

from .common import ragged, span_hashes

SPACE, LETTER, DIGIT, MARK, OTHER = range(5)
BLOCK = 1 << 19


def byte_classes() -> np.ndarray:
    """The class of each ASCII byte; apostrophes and bytes from 128 on are OTHER."""
    kinds = np.full(256, OTHER, np.uint8)
    kinds[33:127] = MARK
    kinds[ord("'")] = OTHER
    kinds[[9, 10, 11, 12, 13, 32]] = SPACE
    kinds[ord("0") : ord("9") + 1] = DIGIT
    kinds[ord("A") : ord("Z") + 1] = LETTER
    kinds[ord("a") : ord("z") + 1] = LETTER
    return kinds


CLASSES = byte_classes()


def classes(data: np.ndarray) -> np.ndarray:
    """Class of each byte, with both bytes of a Latin-1 letter as letters."""
    kinds = CLASSES[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    tail = data[lead + 1]
    lead = lead[(tail != 0x97) & (tail != 0xB7)]  # the signs for times and divided by
    kinds[lead] = LETTER
    kinds[lead + 1] = LETTER
    return kinds


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case, everything else as it is."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    tail = np.flatnonzero(data[:-1] == 0xC3) + 1
    tail = tail[(data[tail] >= 0x80) & (data[tail] <= 0x9E) & (data[tail] != 0x97)]
    out[tail] += 32
    return out


def cuts(data: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """True where a piece may begin.

    Before a run of ASCII white space, unless wider white space may stand
    there, and between letters, digits and marks.  An apostrophe or another
    character of two bytes or more is cut off from neither side.
    """
    at = np.zeros(len(data), bool)
    if not len(data):
        return at
    a, b = kinds[:-1], kinds[1:]
    at[1:] = (a != b) & (a != SPACE) & (a != OTHER) & (b != OTHER)
    # After OTHER a cut before white space is right unless that OTHER is itself white space.
    odd = np.flatnonzero((a == OTHER) & (b == SPACE)) + 1
    last, second, third = data[odd - 1], data[np.maximum(odd - 2, 0)], data[np.maximum(odd - 3, 0)]
    wide = ((second == 0xC2) & ((last == 0x85) | (last == 0xA0))) | ((third >= 0xE1) & (third <= 0xE3) & (last >= 0x80))
    at[odd[~wide]] = True
    return at


class Memory:
    """Ids of the pieces met so far, by their hash; forgets all beyond ``limit``."""

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.sorted = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * 2  # a large part and a recent one
        self.begin, self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.uint32)
        self.used = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        found = np.full(len(keys), -1, np.int64)
        order = np.argsort(keys)  # searching in order is kind to the cache
        asked = keys[order]
        for known, entry in self.sorted:
            if len(known):
                at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
                hit = known[at] == asked
                found[order[hit]] = entry[at[hit]]
        return found

    def add(self, keys: np.ndarray, flat: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Remember the ids of each key, given end to end; their entries."""
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        entry = np.arange(len(self.begin), len(self.begin) + len(keys))
        self.begin = np.concatenate([self.begin, self.used + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.used += len(flat)
        (old, old_entry), recent = self.sorted[0], self.merged(self.sorted[1], (keys, entry))
        if 4 * len(recent[0]) > len(old):
            self.sorted = [self.merged((old, old_entry), recent), (np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        else:
            self.sorted = [(old, old_entry), recent]
        return entry

    @staticmethod
    def merged(one, two):
        keys, entry = np.concatenate([one[0], two[0]]), np.concatenate([one[1], two[1]])
        order = np.argsort(keys)
        return keys[order], entry[order]


class PieceEncoder:
    """Ids of whole texts from the ids of their distinct pieces.

    ``encode_new`` gets pieces as bytes, and for each whether it is a plain
    word of Latin letters; it returns their ids end to end and the number of ids
    of each.  ``drop_space``
    leaves white space out of pieces, ``lower`` folds Latin letters first, for
    tokenizers that do both.  ``special`` strings are pieces of their own.
    Pieces are told apart by a 64-bit hash of their bytes and length.
    """

    def __init__(
        self,
        encode_new: Callable[[list[bytes], np.ndarray], tuple[np.ndarray, np.ndarray]],
        lower: bool,
        drop_space: bool,
        special: tuple[bytes, ...],
        limit: int = 250_000,
    ) -> None:
        self.encode_new, self.lower, self.drop_space, self.special = encode_new, lower, drop_space, special
        self.memory = Memory(limit)

    def special_spans(self, data: np.ndarray) -> list[tuple[int, int]]:
        if not np.any((data[:-1] == ord("<")) & (data[1:] == ord("|"))):
            return []
        raw, found = data.tobytes(), []
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                found.append((at, at + len(s)))
                at = raw.find(s, at + len(s))
        return sorted(found)

    def encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the number of ids of each row."""
        counts = np.zeros(len(starts) - 1, np.int64)
        parts, lo, n = [], int(starts[0]), int(starts[-1])
        while lo < n:
            hi = min(lo + BLOCK, n)
            if hi < n:
                row_start = int(starts[np.searchsorted(starts, hi, side="right") - 1])
                hi = row_start if row_start > lo else self.cut_after(data, lo, hi, n, starts)
            ids, begin, lengths = self.encode_block(data[lo:hi], starts[(starts > lo) & (starts < hi)] - lo)
            before = np.zeros(len(lengths) + 1, np.int64)
            np.cumsum(lengths, out=before[1:])
            counts += np.diff(before[np.searchsorted(begin, starts - lo)])
            parts.append(ids)
            lo = hi
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), counts

    def cut_after(self, data, lo: int, hi: int, n: int, starts) -> int:
        """Inside a long row: the last white space before ``hi`` after which to go on, or a later one, or the row's end."""
        end = int(starts[np.searchsorted(starts, lo, side="right")])
        while True:
            part = data[lo:hi]
            at = np.flatnonzero(cuts(part, classes(part)) & (CLASSES[part] == SPACE))
            if len(at):
                return lo + int(at[-1])
            if hi >= end:
                return end
            hi = min(hi + BLOCK, end)

    def encode_block(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        spans = self.special_spans(data)
        kinds = classes(data)
        at = cuts(data, kinds)
        at[0] = True
        at[rows] = True
        if self.drop_space:
            edge = (kinds[1:] != SPACE) & (kinds[:-1] == SPACE)
            at[1:] |= edge
        for a, b in spans:
            at[a:b] = False
            at[a] = True
            if b < len(at):
                at[b] = True
        text = lowered(data) if self.lower else data
        begin = np.flatnonzero(at)
        end = np.append(begin[1:], len(data))
        if self.drop_space:
            keep = kinds[begin] != SPACE
            begin, end = begin[keep], end[keep]
        if not len(begin):
            return np.zeros(0, np.uint32), begin, np.zeros(0, np.int64)
        keys = span_hashes(text, begin, end)
        code, distinct = pd.factorize(keys)
        entry = self.memory.find(distinct)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            if len(self.memory.begin) + len(missing) > self.memory.limit:
                self.memory.clear()
                missing = np.arange(len(distinct))
            first = np.full(len(distinct), -1, np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            chosen = first[missing]
            raw, plain = text.tobytes(), self.plain(kinds, begin[chosen], end[chosen])
            new = [raw[a:b] for a, b in zip(begin[chosen].tolist(), end[chosen].tolist(), strict=True)]
            entry = entry if len(missing) < len(entry) else np.empty(len(entry), np.int64)
            entry[missing] = self.memory.add(distinct[missing], *self.encode_new(new, plain))
        entry = entry[code]
        lengths = self.memory.length[entry]
        return self.memory.ids[ragged(self.memory.begin[entry], lengths)], begin, lengths

    def plain(self, kinds: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether a piece is letters only, after one blank where blanks are kept."""
        odd = np.zeros(len(kinds) + 1, np.int64)
        np.cumsum(kinds != LETTER, out=odd[1:])
        return odd[end] == odd[np.minimum(begin + (not self.drop_space), end)]


def in_order(place: np.ndarray, flat: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ids given in some order, where run ``k`` belongs at ``place[k]``."""
    begin = np.cumsum(length) - length
    order = np.argsort(place)
    return flat[ragged(begin[order], length[order])], length[order]


def library_encoder(path: str, **settings) -> PieceEncoder:
    """Ids by the tokenizers library for the vocabulary file at ``path``.

    Ids equal those of ``encode(text, add_special_tokens=False)``.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    drop = settings["drop_space"]

    def encode_new(pieces: list[bytes], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # A plain word is one word to the tokenizer, so many go in one text.
        one = plain if drop else plain & np.array([p[:1] == b" " for p in pieces])
        words, rest = np.flatnonzero(one), np.flatnonzero(~one)
        parts, counts = [], []
        for lo in range(0, len(words), 1000):
            part = words[lo : lo + 1000].tolist()
            got = tokenizer.encode((b" " if drop else b"").join(pieces[i] for i in part).decode(), add_special_tokens=False)
            parts.append(np.array(got.ids, np.uint32))
            counts.append(np.bincount(np.array(got.word_ids), minlength=len(part)))
        for lo in range(0, len(rest), 1000):
            texts = [pieces[i].decode("utf-8", "replace") for i in rest[lo : lo + 1000].tolist()]
            for got in tokenizer.encode_batch_fast(texts, add_special_tokens=False):
                parts.append(np.array(got.ids, np.uint32))
                counts.append([len(parts[-1])])
        return in_order(np.concatenate([words, rest]), np.concatenate(parts), np.concatenate(counts).astype(np.int64))

    special = tuple(x.content.encode() for x in tokenizer.get_added_tokens_decoder().values())
    return PieceEncoder(encode_new, special=special, **settings)


ENCODERS: dict[tuple, PieceEncoder] = {}


def word_encoder(path: str) -> PieceEncoder:
    """For a vocabulary with word ends that folds case and drops white space; one per worker."""
    key = ("word", path)
    if key not in ENCODERS:
        ENCODERS[key] = library_encoder(path, lower=True, drop_space=True)
    return ENCODERS[key]


def byte_encoder(path: str) -> PieceEncoder:
    """For a byte-level vocabulary that keeps white space; one per worker."""
    key = ("byte", path)
    if key not in ENCODERS:
        ENCODERS[key] = library_encoder(path, lower=False, drop_space=False)
    return ENCODERS[key]
