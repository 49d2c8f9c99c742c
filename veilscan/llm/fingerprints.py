"""Document fingerprints: MinHash under many universal hash functions.

A text's five-word shingles are hashed to 64 bits; ``SLOTS`` functions of the
multiply-and-shift family permute them, and the smallest value of each is kept.
The share of equal slots of two fingerprints estimates the Jaccard likeness of
the texts.  ``near_duplicates`` cuts the slots into bands, joins equal bands in
Spark and verifies the Jaccard likeness of what meets on the shingles
themselves.

Edge cases: a null text is empty; a text without words has the fingerprint of
all ones, which is like itself (1.0) and like no other (0.0); a null doc_id
comes last in descending order; rows of equal doc_id are ordered by text; the
only row of a table is its own successor; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, mix, stored, text_bytes, whole_text
from .linking import near_classes
from .shingles import WIDTH, shingle_hashes

SLOTS = 128
TEXT_BYTES = 2 << 20
PART = 1 << 16
#: Rows of a band, and so 32 bands: a pair at 0.8 is missed once in ten million.
BAND = 4


def functions(slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and addends of the hash functions."""
    seed = mix(np.arange(1, 2 * slots + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seed[:slots] | np.uint64(1), seed[slots:]


def signatures(shingles: np.ndarray, rows: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The 16-bit slots of each row, from shingles end to end and where each row's begin."""
    out = np.full((len(rows) - 1, slots), 0xFFFF, np.uint16)
    factor, addend = functions(slots)
    for lo, hi in blocks(rows, PART):
        full = np.full((slots, hi - lo), 0xFFFF_FFFF, np.uint32)
        there = np.flatnonzero(np.diff(rows[lo : hi + 1]))
        if not len(there):
            continue
        for a in range(int(rows[lo]), int(rows[hi]), PART):  # more than once only for one long row
            part = shingles[a : min(a + PART, int(rows[hi]))]
            first = np.maximum(rows[lo:hi][there] - a, 0)
            for k in range(slots):
                hashed = ((part * factor[k] + addend[k]) >> np.uint64(32)).astype(np.uint32)
                full[k, there] = np.minimum(full[k, there], np.minimum.reduceat(hashed, first))
        out[lo + there] = (full[:, there].T & np.uint32(0xFFFF)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal slots, row by row."""
    return (a == b).mean(axis=1)


def of_texts(texts: list[bytes], slots: int = SLOTS) -> np.ndarray:
    """Fingerprints of texts, in blocks of a few megabytes."""
    starts = np.concatenate([[0], np.cumsum(list(map(len, texts)))]).astype(np.int64)
    out = [np.zeros((0, slots), np.uint16)]
    for lo, hi in blocks(starts, TEXT_BYTES):
        data = np.frombuffer(b"".join(texts[lo:hi]), np.uint8)
        out.append(signatures(*shingle_hashes(data, starts[lo : hi + 1] - starts[lo]), slots))
    return np.concatenate(out)


def characters(text: bytes, n: int) -> int:
    """Where the first ``n`` code points of a UTF-8 text end."""
    return len(text.decode("utf-8", "surrogatepass")[:n].encode("utf-8", "surrogatepass"))


def edited(text: bytes, following: bytes) -> tuple[bytes, int]:
    """``text`` with its last third replaced by the start of ``following``, and its number of code points."""
    own = text.decode()
    n = len(own)
    return (own[: n - n // 3] + following.decode()[: n // 3]).encode(), n


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, mark binary, edited_mark binary, near_edited double, near_next double"


def compared(doc_id: list, texts: list[bytes], marks: np.ndarray, part: int | None = None) -> pa.RecordBatch:
    """Rows for all but the last text, each against the one after it."""
    pairs = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
    other = of_texts([e for e, _ in pairs])
    made = {
        "doc_id": pa.array(doc_id[:-1], pa.int64()),
        "n_chars": pa.array([n for _, n in pairs], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(e).hexdigest() for e, _ in pairs], pa.string()),
        "mark": pa.array([m.astype("<u2").tobytes() for m in marks[:-1]], pa.binary()),
        "edited_mark": pa.array([m.astype("<u2").tobytes() for m in other], pa.binary()),
        "near_edited": pa.array(likeness(marks[:-1], other), pa.float64()),
        "near_next": pa.array(likeness(marks[:-1], marks[1:]), pa.float64()),
    }
    return pa.RecordBatch.from_pydict(made)


def against_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of ``docs(doc_id, text)`` and of their edited texts; see ``SCHEMA``.

    Rows are dealt to tasks by ranges of descending doc_id.  A task compares
    each row with the one after it; its first and last rows are kept with their
    texts, and the last rows meet the first ones of the following ranges in a
    second, small step.  So texts are shuffled once and no order is imposed on
    the whole table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        schema = pa.schema([*SCHEMA_FIELDS, ("part", pa.int64()), ("edge", pa.string()), ("text", pa.binary())])
        last: tuple | None = None

        def edge(kind: str, doc_id: int | None, text: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"doc_id": doc_id, "part": part, "edge": kind, "text": text}], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch["doc_id"].cast(pa.int64()).to_pylist()
            data, starts = text_bytes(batch["text"])
            for lo, hi in blocks(starts, TEXT_BYTES):
                raw = data[starts[lo] : starts[hi]].tobytes()
                at = (starts[lo : hi + 1] - starts[lo]).tolist()
                texts, names = [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], ids[lo:hi]
                marks = of_texts(texts)
                if last is None:
                    yield edge("first", names[0], texts[0])
                else:
                    names, texts, marks = [last[0], *names], [last[1], *texts], np.concatenate([last[2], marks])
                made = compared(names, texts, marks)
                empty = [pa.array([part] * len(made), pa.int64()), pa.nulls(len(made), pa.string()), pa.nulls(len(made), pa.binary())]
                yield pa.record_batch([*made.columns, *empty], schema=schema)
                last = names[-1], texts[-1], marks[-1:]
        if last is not None:
            yield edge("last", last[0], last[1])

    rows = docs.select("doc_id", whole_text().alias("text")).withColumn("tie", F.xxhash64("text"))
    order = [F.desc("doc_id"), F.asc("tie"), F.asc("text")]
    ranged = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order).select("doc_id", "text")
    made = stored(ranged.mapInArrow(run, SCHEMA + ", part long, edge string, text binary"), "fingerprints")
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    inner = made.where("edge IS NULL").select(names)

    # One row per range: its number and that of the next range, around the end.
    parts = sorted(r.part for r in made.where("edge = 'first'").select("part").collect())
    after = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part long, after long")
    ends = made.where("edge = 'last'").select("doc_id", "text", "part").join(after, "part")
    heads = made.where("edge = 'first'").select(F.col("part").alias("after"), F.col("text").alias("following"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, following in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "following")), strict=True):
                yield compared([doc_id, None], [text, following], of_texts([text, following]))

    outer = ends.join(heads, "after").select("doc_id", "text", "following").mapInArrow(join, SCHEMA)
    return inner.unionByName(outer)


SCHEMA_FIELDS = [
    ("doc_id", pa.int64()),
    ("n_chars", pa.int64()),
    ("edited_sha256", pa.string()),
    ("mark", pa.binary()),
    ("edited_mark", pa.binary()),
    ("near_edited", pa.float64()),
    ("near_next", pa.float64()),
]


def fingerprinted(docs: DataFrame) -> DataFrame:
    """``against_next`` with fingerprints as hexadecimal strings."""
    made = against_next(docs)
    hexed = {"fingerprint": F.lower(F.hex("mark")), "edited_fingerprint": F.lower(F.hex("edited_mark"))}
    return made.withColumns(hexed).drop("mark", "edited_mark")


def band_values(marks: np.ndarray, rows: int = BAND) -> np.ndarray:
    """One 64-bit value per band and row, different from band to band."""
    n = marks.shape[1] // rows
    grouped = marks[:, : n * rows].reshape(len(marks), n, rows).astype(np.uint64)
    value = np.broadcast_to(np.arange(1, n + 1, dtype=np.uint64), grouped.shape[:2]).copy()
    for k in range(rows):
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, k])
    return value


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two arrays of shingles; two texts without words are alike."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = WIDTH) -> DataFrame:
    """``doc_id, class_id`` of ``docs(doc_id, text)``: classes linked by Jaccard likeness.

    Links are pairs of equal bands whose likeness, computed on all their
    shingles, is at least the threshold.
    """

    def bands(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shingles, rows = shingle_hashes(data, starts, width)
        marks = signatures(shingles, rows).astype(np.uint8)
        return band_values(marks), np.diff(rows) > 0, marks

    return near_classes(docs, bands, BAND, jaccard, threshold, width)
