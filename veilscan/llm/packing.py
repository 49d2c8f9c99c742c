"""Packing token runs into sequences of fixed length, as few as possible.

How many pieces there are of each length is all that packing needs to know, and
lengths are at most the capacity, so the packing itself works on a histogram of
bounded size, in three steps over the lengths from the longest down:

1. a hash of single lengths and of the sums of pairs gives combinations of one,
   two or three further pieces that fill the gap exactly; as many sequences are
   made of a combination as the counts allow;
2. what is left goes best-fit: into the open sequence with the smallest gap that
   holds it;
3. the result is a list of slots: the pieces of length L numbered a to b go to
   the sequences s, s + 1, ... at offset o.

Combinations of many short pieces can use up what the best fit would need later,
so plans are made with combinations of up to three, two and one further pieces
and with none, and the one with fewest sequences is taken: it never has more
than best fit by falling length.

Spark numbers the pieces of each length (numbers within a task plus what the
tasks before it have) and every piece finds its slot by its number.

Edge cases: a null text is empty, an empty text has only its end id, repeated
rows are packed each, an empty table gives no sequences, null doc_ids are kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, ragged, stored, text_bytes, whole_text
from .idplanes import with_end
from .pieces import byte_encoder

TEXT_BYTES = 8 << 20
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of rows with ``counts`` tokens: ``row, piece, start, length``.

    A row longer than the capacity is cut into full pieces; the first one takes
    what is left over.
    """
    n = -(-counts // capacity)
    row = np.repeat(np.arange(len(counts)), n)
    piece = ragged(np.zeros(len(counts), np.int64), n)
    first = (counts - (n - 1) * capacity)[row]
    start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
    return row, piece, start, np.where(piece == 0, first, capacity)


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """The pieces of ``docs(doc_id, text)``, and their number among those of equal length in a task."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, seen = byte_encoder(vocabulary), np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            data, starts = text_bytes(batch["text"])
            for lo, hi in blocks(starts, TEXT_BYTES):
                ids, counts = with_end(*encoder.encode(data, starts[lo : hi + 1]), end_id)
                row, piece, start, length = cut(counts, capacity)
                at = (np.cumsum(counts) - counts)[row] + start
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                # Number within the length: sort by length, then count along each run.
                order = np.argsort(length, kind="stable")
                runs = length[order]
                place = np.arange(len(runs)) - np.searchsorted(runs, runs)
                number = np.empty(len(runs), np.int64)
                number[order] = seen[runs] + place
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.record_batch(
                    {
                        "doc_id": batch["doc_id"][lo:hi].take(pa.array(row)).cast(pa.int64()),
                        "piece": pa.array(piece, pa.int32()),
                        "start": pa.array(start, pa.int64()),
                        "length": pa.array(length, pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64()),
                        "part": pa.array(np.full(len(row), part), pa.int64()),
                        "number": pa.array(number, pa.int64()),
                    }
                )

    schema = PIECE + ", part long, number long"
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(encode, schema)


class Slots:
    """Collects slots and hands out numbers of pieces and sequences."""

    def __init__(self, count: np.ndarray) -> None:
        self.left = count.astype(np.int64).copy()
        self.used = np.zeros_like(self.left)
        self.sequences = 0
        self.rows: list[tuple[int, int, int, int]] = []

    def put(self, length: int, sequence: int, offset: int, n: int) -> None:
        self.rows.append((length, int(self.used[length]), sequence, offset))
        self.used[length] += n
        self.left[length] -= n

    def fill(self, lengths: tuple[int, ...], n: int) -> None:
        """``n`` new sequences, each of pieces with these lengths."""
        offset = 0
        for length in lengths:
            self.put(length, self.sequences, offset, n)
            offset += length
        self.sequences += n


def available(left: np.ndarray, lengths: tuple[int, ...]) -> int:
    """How many times a combination can be taken."""
    return min(int(left[x]) // lengths.count(x) for x in lengths)


def exact(left: np.ndarray, longest: int, gap: int, most: int) -> tuple[int, ...] | None:
    """Up to ``most`` (three at most) lengths that fill ``gap`` beside one piece ``longest``; long ones first.

    The counts are the hash of single lengths; a pair sum is looked up by its
    complement.
    """

    def enough(*lengths: int) -> bool:
        return available(left, (longest, *lengths)) > 0

    if most and left[gap] and enough(gap):
        return (gap,)
    if most < 2:
        return None
    there = np.flatnonzero(left[: gap + 1])
    there = there[there > 0][::-1]
    for a in there[2 * there >= gap].tolist():
        if a < gap and left[gap - a] and enough(a, gap - a):
            return (a, gap - a)
    if most < 3:
        return None
    for a in there[3 * there >= gap].tolist():
        rest = gap - a
        b = there[(there <= a) & (2 * there >= rest) & (there < rest)]
        for x in b[left[rest - b] > 0].tolist():
            if enough(a, x, rest - x):
                return (a, x, rest - x)
    return None


def plan(count: np.ndarray, capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Slots ``length, first number, sequence of that one, offset`` and the number of sequences.

    ``count[L]`` is the number of pieces of length L, for L from 1 to the
    capacity.  Of the plans by size of combination that with fewest sequences,
    of equals that with the largest combinations.
    """
    return min((combined(count, capacity, most) for most in (3, 2, 1, 0)), key=lambda made: made[1])


def combined(count: np.ndarray, capacity: int, most: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """The plan whose exact combinations have up to ``most`` further pieces; the rest goes best-fit."""
    slots = Slots(count)
    if slots.left[capacity]:
        slots.fill((capacity,), int(slots.left[capacity]))
    for length in range(capacity - 1, 0, -1) if most else ():
        while slots.left[length]:
            found = exact(slots.left, length, capacity - length, most)
            if found is None:
                break
            lengths = (length, *found)
            slots.fill(lengths, available(slots.left, lengths))
    # Best fit of the rest, by groups of open sequences with equal gaps.
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: first sequence, how many

    def place(length: int, gap: int, first: int, there: int) -> None:
        """Fill the ``there`` sequences from ``first`` on, one after the other, while pieces last."""
        offset, n = capacity - gap, int(slots.left[length])
        each = gap // length
        full = min(n // each, there)
        over = n % each if full < there and n // each == full else 0
        for first_one, m, k in ((first, full, each), (first + full, min(over, 1), over)):
            if m:
                for j in range(k):
                    slots.put(length, first_one, offset + j * length, m)
                if gap > k * length:
                    gaps.setdefault(gap - k * length, []).append((first_one, m))
        filled = full + min(over, 1)
        if filled < there:
            gaps.setdefault(gap, []).append((first + filled, there - filled))

    for length in range(capacity - 1, 0, -1):
        while n := int(slots.left[length]):
            gap = min((g for g in gaps if g >= length), default=None)
            if gap is None:
                new = -(-n // (capacity // length))
                slots.sequences += new
                place(length, capacity, slots.sequences - new, new)
                continue
            first, there = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
            place(length, gap, first, there)
    return slots.rows, slots.sequences


def pack(made: DataFrame, capacity: int = 1024) -> DataFrame:
    """Give every piece of a stored table from ``pieces`` its ``sequence_id`` and ``offset``."""
    sizes = made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    sizes = stored(sizes, "lengths")
    total = np.zeros(capacity + 1, np.int64)
    for row in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most one row per length
        total[row.length] = row.n
    rows, _ = plan(total, capacity)
    rows.sort()
    key = np.array([r[0] << 44 | r[1] for r in rows], np.int64)
    first = np.array([r[1] for r in rows], np.int64)
    sequence = np.array([r[2] for r in rows], np.int64)
    offset = np.array([r[3] for r in rows], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch["length"].to_numpy(), batch["number"].to_numpy()
            at = np.searchsorted(key, length << 44 | number, side="right") - 1
            done = [batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            done += [pa.array(sequence[at] + number - first[at], pa.int64()), pa.array(offset[at], pa.int64())]
            yield pa.record_batch(done, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = sizes.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = made.join(base, ["part", "length"]).withColumn("number", F.col("number") + F.col("before"))
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number")
    return numbered.mapInArrow(place, PIECE + ", sequence_id long, offset long")


def packed(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """All documents cut into pieces and packed."""
    return pack(stored(pieces(docs, vocabulary, end_id, capacity), "pieces"), capacity)
