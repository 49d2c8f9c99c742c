"""Small helpers that several operators share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` written to the shared folder and read back.

    Cuts lineage: what follows reads files that every executor can reach.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(*tables: DataFrame) -> None:
    """Remove the files of tables made by ``stored`` that nothing will read again.

    On a file system that only Spark reaches they stay.
    """
    for df in tables:
        files = df.inputFiles()
        if files:
            folder = re.sub("^file:/+", "/", files[0].rpartition("/")[0])
            try:
                system, inner = opened(folder)
                system.delete_dir(inner)
            except (OSError, pa.ArrowInvalid):
                continue


def whole_text(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and where each row begins.

    A null counts as an empty text; there is one more start than rows.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[starts[0] : starts[-1]], starts - starts[0]


def blocks(starts: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each; a longer row is a range of its own."""
    lo, n = 0, len(starts) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + size, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: nearby inputs give unrelated outputs."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, for hashes whose hits are compared."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 19)
            for name, base in (("up", self.BASE), ("down", pow(self.BASE, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up, self.down


POWERS = Powers()


#: Two primes of 31 bits and a base for each: hashes of spans are remainders by both.
PRIMES = (2147483647, 2147483629)
BASES = (1597334677, 1084773251)
FIELD_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of a base and of its inverse, modulo its prime."""
    if which not in FIELD_POWERS or len(FIELD_POWERS[which][0]) < n:
        p, found = PRIMES[which], []
        for base in (BASES[which], pow(BASES[which], -1, p)):
            out = np.ones(1, np.uint64)
            while len(out) < max(n, 1 << 19):
                out = np.concatenate([out, out * np.uint64(pow(base, len(out), p)) % np.uint64(p)])
            found.append(out)
        FIELD_POWERS[which] = (found[0], found[1])
    return FIELD_POWERS[which]


def prefix_sums(values: np.ndarray, p: int) -> np.ndarray:
    """Sums of the first 0, 1, 2, ... values of less than 2**40, modulo ``p``."""
    out, step = np.zeros(len(values) + 1, np.uint64), 1 << 23
    for lo in range(0, len(values), step):
        part = values[lo : lo + step]
        out[lo + 1 : lo + 1 + len(part)] = (np.cumsum(part) + out[lo]) % np.uint64(p)
    return out


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of 62 bits, mixed to 64, of each span of bytes; equal bytes give equal hashes.

    Polynomials over two prime fields, where a fixed pattern such as a
    Thue-Morse word has no power of two to vanish by.
    """
    digits, both = data.astype(np.uint64) + np.uint64(1), np.zeros(len(begin), np.uint64)
    for which, prime in enumerate(PRIMES):
        p = np.uint64(prime)
        up, down = powers(which, len(data) + 1)
        sums = prefix_sums(digits * up[: len(data)], prime)
        both = (both << np.uint64(31)) | ((sums[end] + p - sums[begin]) % p * down[begin] % p)
    return mix(both)


def ragged(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Positions ``begin[i], begin[i] + 1, ...``, ``length[i]`` of them, end to end."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(length) - length
    return np.arange(total, dtype=np.int64) + np.repeat(begin.astype(np.int64) - first, length)


def opened(uri: str):
    """The file system of a path or URI, and the path inside it."""
    from pyarrow import fs as pafs

    if ":" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def attempt_suffix() -> str:
    """Tells the files of one task attempt from those of another."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return f"{context.stageId()}-{context.partitionId()}-{context.taskAttemptId()}" if context else "local"
