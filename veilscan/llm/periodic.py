"""Stretches of a text that repeat a period of words, found by block convolution.

A run is a maximal stretch of words of smallest period ``q`` and of at least
``max(6, 4 * q)`` words.  At the scale ``B``, a power of two, runs of periods
``B`` to ``2 * B - 1`` are sought.  Such a run holds a whole aligned block of
``B`` words and, one period on, its copy.  For each block, an integer
number-theoretic transform modulo a prime gives the sum of squared differences
of word numbers between the block and each place of the following window.  A
place without mismatch has the sum zero, so none is missed; its distance is the
seed of a period.  Neighbouring blocks of equal distance are one seed, which is
extended to both sides by binary search over prefix hashes, and what is
reported is then compared word by word.

A block is transformed only if each of its words occurs again within
``2 * B - 1`` words, which a zero needs; in prose few blocks are left.  The work
is at most n log(n)**2 per text, whatever it repeats.

If a stretch has a smaller period than its seed, that one divides it, and the
stretch was found at a lower scale with equal ends; the smallest period of
equal ends is kept.

Many texts go through together: words get numbers of their own in each text, so
nothing matches across texts.  Words are told apart by 62-bit hashes.

Edge cases: a null text and one without words have no runs, and the joined text
is empty; a null doc_id is never rewritten by the contract's rule; repeated rows
give equal rows; an empty table gives no rows; other columns are ignored; a
text of up to 2**27 words is one unit of work.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import PRIMES, blocks, prefix_sums, powers, ragged, text_bytes, whole_text
from .shingles import word_hashes, word_spans

#: A prime of 31 bits with a root of unity of order 2**27, and a generator.
PRIME, GENERATOR = 2013265921, 31
P = np.uint64(PRIME)
TEXT_BYTES = 2 << 20
#: Numbers in one array of a transform.
CELLS = 1 << 19
LEAST, TIMES = 6, 4

TWIDDLES: dict[tuple[int, bool], np.ndarray] = {}


def twiddles(half: int, inverse: bool) -> np.ndarray:
    """The first ``half`` powers of the root of unity of order ``2 * half``."""
    if (half, inverse) not in TWIDDLES:
        root = pow(GENERATOR, (PRIME - 1) // (2 * half), PRIME)
        out = np.ones(1, np.uint64)
        step = pow(root, -1, PRIME) if inverse else root
        while len(out) < half:
            out = np.concatenate([out, out * np.uint64(pow(step, len(out), PRIME)) % P])
        TWIDDLES[half, inverse] = out
    return TWIDDLES[half, inverse]


def transformed(x: np.ndarray) -> np.ndarray:
    """The transform of each row, in bit-reversed order."""
    rows, n = x.shape
    half = n // 2
    while half:
        x = x.reshape(rows, -1, 2, half)
        a, b = x[:, :, 0], x[:, :, 1]
        x = np.stack([(a + b) % P, (a + (P - b)) % P * twiddles(half, False) % P], axis=2)
        half //= 2
    return x.reshape(rows, n)


def restored(x: np.ndarray) -> np.ndarray:
    """The rows whose transform, in bit-reversed order, is given."""
    rows, n = x.shape
    half = 1
    while half < n:
        x = x.reshape(rows, -1, 2, half)
        a, b = x[:, :, 0], x[:, :, 1] * twiddles(half, True) % P
        x = np.stack([(a + b) % P, (a + (P - b)) % P], axis=2)
        half *= 2
    return x.reshape(rows, n) * np.uint64(pow(n, -1, PRIME)) % P


def mismatches(block: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Sums of squared differences, modulo the prime, of each row's block at the places of its window.

    Blocks of ``B`` numbers, windows of ``2 * B``, places 0 to ``B - 1``; the
    last number of a window is never met.
    """
    rows, size = block.shape
    turned = np.zeros_like(window)
    turned[:, :size] = block[:, ::-1]
    # A cycle of 2 * B is enough: what wraps around falls on places below B - 1.
    meet = restored(transformed(turned) * transformed(window) % P)[:, size - 1 : 2 * size - 1]
    squares = np.zeros((rows, 2 * size + 1), np.uint64)
    np.cumsum(window * window % P, axis=1, out=squares[:, 1:])
    own = (block * block % P).sum(axis=1)
    total = own[:, None] + squares[:, size : 2 * size] - squares[:, :size]
    return (total % P + np.uint64(2) * (P - meet)) % P


class Repeats:
    """Equal stretches of a list of word numbers at a distance, by prefix hashes."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes, self.n = codes, len(codes)
        digits = codes.astype(np.uint64) + np.uint64(1)
        self.tables = []
        for which, p in enumerate(PRIMES):
            up, _ = powers(which, self.n + 1)
            self.tables.append((prefix_sums(digits % np.uint64(p) * up[: self.n] % np.uint64(p), p), up, np.uint64(p)))

    def same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the words from ``a`` and from ``b > a`` on are equal, ``length`` of them."""
        out = np.ones(len(a), bool)
        for sums, up, p in self.tables:
            first, second = (sums[a + length] + p - sums[a]) % p, (sums[b + length] + p - sums[b]) % p
            out &= first * up[b - a] % p == second
        return out

    def reach(self, most: np.ndarray, holds: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """The largest length up to ``most`` that holds, for each row; all smaller ones hold too."""
        low, high = np.zeros(len(most), np.int64), most.copy()
        while len(rows := np.flatnonzero(low < high)):
            middle = (low[rows] + high[rows] + 1) // 2
            good = holds(rows, middle)
            low[rows[good]] = middle[good]
            high[rows[~good]] = middle[~good] - 1
        return low

    def extended(self, at: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the longest stretch around ``at`` in which words ``distance`` apart are equal."""
        right = self.reach(self.n - at - distance, lambda rows, k: self.same(at[rows], at[rows] + distance[rows], k))
        left = self.reach(at.copy(), lambda rows, k: self.same(at[rows] - k, at[rows] - k + distance[rows], k))
        return at - left, at + distance + right


def next_equal(codes: np.ndarray) -> np.ndarray:
    """How many words on the same word occurs next; very many if never."""
    order = np.argsort(codes, kind="stable")
    out = np.full(len(codes), np.iinfo(np.int64).max, np.int64)
    again = codes[order[1:]] == codes[order[:-1]]
    out[order[:-1][again]] = order[1:][again] - order[:-1][again]
    return out


def seeds(codes: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each scale, the blocks' begins and the distances at which they occur again, one of a chain.

    ``longest`` is the number of words of the longest text.
    """
    again, size, n = next_equal(codes), 1, len(codes)
    while TIMES * size <= longest and len(again):
        live = np.flatnonzero(again < 2 * size) * size
        found = []
        step = max(1, CELLS // (2 * size))
        for lo in range(0, len(live), step):
            begin = live[lo : lo + step]
            places = begin[:, None] + np.arange(3 * size)
            # Beyond the end stands a number that no word has.
            words = np.where(places < n, codes[np.minimum(places, n - 1)] + 1, 0).astype(np.uint64)
            row, place = np.nonzero(mismatches(words[:, :size], words[:, size:]) == 0)
            found.append((begin[row], place + size))
        if found:
            at, distance = (np.concatenate(x) for x in zip(*found, strict=True))
            inside = at + distance + size <= n
            at, distance = at[inside], distance[inside]
            order = np.lexsort((at, distance))
            at, distance = at[order], distance[order]
            chained = np.zeros(len(at), bool)
            chained[1:] = (distance[1:] == distance[:-1]) & (at[1:] == at[:-1] + size)
            yield at[~chained], distance[~chained]
        even = len(again) // 2 * 2
        again, size = again[:even].reshape(-1, 2).max(axis=1), 2 * size


def runs(codes: np.ndarray, longest: int) -> np.ndarray:
    """Rows ``start, length, period`` of all runs, in this order.

    ``codes`` are numbers of words; texts end to end have no number in common.
    """
    known, parts = Repeats(codes), [np.zeros((0, 3), np.int64)]
    for at, distance in seeds(codes, longest):
        begin, end = known.extended(at, distance)
        enough = end - begin >= np.maximum(LEAST, TIMES * distance)
        parts.append(np.unique(np.stack([begin, end, distance], axis=1)[enough], axis=0))
    every = np.concatenate(parts)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    smallest = np.ones(len(every), bool)
    smallest[1:] = (every[1:, :2] != every[:-1, :2]).any(axis=1)
    every = every[smallest]
    for begin, end, period in every.tolist():
        if not np.array_equal(codes[begin : end - period], codes[begin + period : end]):
            raise ArithmeticError("words of equal hashes differ")
    out = np.stack([every[:, 0], every[:, 1] - every[:, 0], every[:, 2]], axis=1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def kept(n: int, found: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay: those that no run holds after its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, found[:, 0] + found[:, 2], 1)
    np.add.at(depth, found[:, 0] + found[:, 1], -1)
    return np.cumsum(depth[:-1]) == 0


def periodic_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place of a text that is made periodic; None if it stays."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    return order


def found_in(texts: pa.Array, orders: Callable[[int, int], np.ndarray | None]) -> Iterator[tuple[int, np.ndarray, list[bytes]]]:
    """For each text its row, its runs, and its words, both as they stand after ``orders(row, n)``.

    ``orders`` tells which original word stands at each place; None for no change.
    """
    data, starts = text_bytes(texts)
    for lo, hi in blocks(starts, TEXT_BYTES):
        part, inner = data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo]
        begin, end, rows = word_spans(part, inner)
        n_words = np.diff(rows)
        hashes = word_hashes(part, begin, end)
        order = {i: o for i, n in enumerate(n_words.tolist()) if n and (o := orders(lo + i, n)) is not None}
        for i, o in order.items():
            hashes[rows[i] : rows[i + 1]] = hashes[rows[i] : rows[i + 1]][o]
        # A number for each word of each text: sort by hash within the text.
        text = np.repeat(np.arange(hi - lo), n_words)
        number = pd.factorize(hashes)[0]
        codes = pd.factorize(text * (int(number.max(initial=0)) + 1) + number)[0]
        every = runs(codes, int(n_words.max(initial=0)))
        cut = np.searchsorted(every[:, 0], rows)
        for i in range(hi - lo):
            own = every[cut[i] : cut[i + 1]] - np.array([rows[i], 0, 0])
            words = part[inner[i] : inner[i + 1]].tobytes().split()
            if i in order:
                words = [words[k] for k in order[i].tolist()]
            yield lo + i, own, words


def longest(found: np.ndarray) -> list[int] | None:
    """Start, length and period of the longest run, the first of equals."""
    return found[int(np.argmax(found[:, 1]))].tolist() if len(found) else None


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def run_digests(docs: DataFrame, orders: Callable[[int | None, int], np.ndarray | None] = periodic_order) -> DataFrame:
    """``SCHEMA`` for ``docs(doc_id, text)``, each text's words rearranged by ``orders(doc_id, n)`` first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(x, pa.string() if x.endswith("sha256") else pa.int64()) for x in (c.split()[0] for c in SCHEMA.split(", "))])
        for batch in batches:
            ids, rows = batch["doc_id"].to_pylist(), []
            for i, own, words in found_in(batch["text"], lambda row, n, ids=ids: orders(ids[row], n)):
                best = longest(own) or [None] * 3
                listed = "".join(f"{a},{b},{c}\n" for a, b, c in own.tolist())
                if len(own):
                    words = [words[k] for k in np.flatnonzero(kept(len(words), own)).tolist()]
                milli = 1000 * best[1] // best[2] if len(own) else None
                digests = [hashlib.sha256(x).hexdigest() for x in (listed.encode(), b" ".join(words))]
                rows.append((ids[i], len(own), *best, milli, *digests))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, SCHEMA)


def collapsed(docs: DataFrame) -> DataFrame:
    """``doc_id, runs, text`` of ``docs(doc_id, text)`` as it is: its runs, and its words without their repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))
        for batch in batches:
            lists, texts = [], []
            for _, own, words in found_in(batch["text"], lambda row, n: None):
                lists.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own.tolist()])
                texts.append(b" ".join([words[k] for k in np.flatnonzero(kept(len(words), own)).tolist()]).decode())
            yield pa.record_batch([batch["doc_id"].cast(pa.int64()), pa.array(lists, shape), pa.array(texts, pa.string())], names=["doc_id", "runs", "text"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, text string")
