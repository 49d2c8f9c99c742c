"""Token-id files: blocks of ids as compressed planes, with an index of blocks.

A file holds the ids of some documents end to end.  They are cut into blocks of
``BLOCK`` ids; a block is transposed into planes (its first bytes, its second
bytes, ..., or single bits) and each plane is compressed by itself, which
brings the nearly constant high planes to almost nothing.  After the blocks
stands an index: offset, number of ids and plane sizes of every block, and the
documents with their numbers of ids.  One block is in memory at a time.

Edge cases: a null text is empty, an empty text has only the end id, a null
doc_id sorts first, rows of equal doc_id sort by text, repeated rows are all
kept, an empty table gives no files and no rows, other columns are ignored.
"""

from __future__ import annotations

import io
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import attempt_suffix, blocks, opened, stored, text_bytes, whole_text
from .pieces import word_encoder

MAGIC = b"IDPLANE1"
BLOCK = 1 << 16
TEXT_BYTES = 8 << 20


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block of 32-bit ids, least significant first."""
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [rows[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        rows = np.stack([np.frombuffer(p, np.uint8, n) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        rows = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(rows).view("<u4").reshape(-1)


class PlaneWriter:
    """Writes one file to an open binary stream."""

    def __init__(self, stream, kind: str = "byte", level: int = 1, block: int = BLOCK) -> None:
        self.stream, self.kind, self.block = stream, kind, block
        self.pack = zstandard.ZstdCompressor(level=level)
        self.waiting: list[np.ndarray] = []
        self.held, self.at, self.total = 0, len(MAGIC), 0
        self.index: list[list] = []
        self.docs: list[pa.RecordBatch] = []
        stream.write(MAGIC)

    def add(self, doc_id: pa.Array, counts: np.ndarray, ids: np.ndarray) -> None:
        """Append documents: their ids end to end, and how many each has."""
        self.docs.append(pa.record_batch({"doc_id": doc_id.cast(pa.int64()), "n_tokens": pa.array(counts, pa.int64())}))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            flat = np.concatenate(self.waiting)
            whole = len(flat) - len(flat) % self.block
            for lo in range(0, whole, self.block):
                self.put(flat[lo : lo + self.block])
            self.waiting, self.held = [flat[whole:]], len(flat) - whole

    def put(self, ids: np.ndarray) -> None:
        planes = [self.pack.compress(p) for p in to_planes(ids, self.kind)]
        self.index.append([self.at, len(ids), [len(p) for p in planes]])
        for p in planes:
            self.stream.write(p)
            self.at += len(p)
        self.total += len(ids)

    def close(self) -> None:
        if self.held:
            self.put(np.concatenate(self.waiting))
        sink = io.BytesIO()
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])
        with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for batch in self.docs:
                out.write_batch(batch)
        head = json.dumps({"planes": self.kind, "block": self.block, "blocks": self.index}).encode()
        for part in (head, sink.getvalue()):
            self.stream.write(part)
        self.stream.write(struct.pack("<QQQ", self.at, len(head), sink.tell()) + MAGIC)


class PlaneReader:
    """Reads one file from a stream that can seek; any block by itself."""

    def __init__(self, stream) -> None:
        self.stream = stream
        tail = 24 + len(MAGIC)
        stream.seek(0, 2)
        stream.seek(stream.tell() - tail)
        end = stream.read(tail)
        if end[24:] != MAGIC:
            raise ValueError("not a file of id planes, or cut off")
        at, head, docs = struct.unpack("<QQQ", end[:24])
        stream.seek(at)
        self.head = json.loads(stream.read(head))
        self.docs = pa.ipc.open_stream(stream.read(docs)).read_all()
        self.unpack = zstandard.ZstdDecompressor()

    def block(self, k: int) -> np.ndarray:
        at, n, sizes = self.head["blocks"][k]
        self.stream.seek(at)
        planes = [self.unpack.decompress(self.stream.read(size)) for size in sizes]
        return from_planes(planes, n, self.head["planes"])

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        """``doc_id, n_tokens, crc32`` of each document, one block in memory at a time."""
        ids, used, k = np.zeros(0, "<u4"), 0, 0
        for batch in self.docs.to_batches():
            for doc_id, n in zip(batch["doc_id"].to_pylist(), batch["n_tokens"].to_pylist(), strict=True):
                crc, left = 0, n
                while left:
                    if used == len(ids):
                        ids, used, k = self.block(k), 0, k + 1
                    part = ids[used : used + left]
                    crc = zlib.crc32(part, crc)
                    used, left = used + len(part), left - len(part)
                yield doc_id, n, crc


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of each row followed by the end id."""
    return np.insert(ids, np.cumsum(counts), np.uint32(end_id)), counts + 1


def write_ids(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 1, planes: str = "byte") -> DataFrame:
    """Write the ids of ``docs(doc_id, text)`` in doc_id order; ``part, path, n_ids, n_docs`` of each file.

    Documents are dealt to tasks by ranges of doc_id and each task writes one
    file, under a name of its own that is made final by a rename, so a lost
    task simply writes again.  The result holds one row per file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        files, base = opened(folder)
        made, done = f"{base}/.{part:06d}-{attempt_suffix()}.tmp", f"{base}/ids-{part:06d}.planes"
        encoder, writer, rows = word_encoder(vocabulary), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                files.create_dir(base, recursive=True)
                stream = files.open_output_stream(made)
                writer = PlaneWriter(stream, planes)
            data, starts = text_bytes(batch["text"])
            for lo, hi in blocks(starts, TEXT_BYTES):
                ids, counts = with_end(*encoder.encode(data, starts[lo : hi + 1]), end_id)
                writer.add(batch["doc_id"][lo:hi], counts, ids)
            rows += batch.num_rows
        if writer:
            writer.close()
            stream.close()
            files.move(made, done)
            yield pa.record_batch({"part": [part], "path": [done], "n_ids": [writer.total], "n_docs": [rows]})

    rows = docs.select("doc_id", whole_text().alias("text")).withColumn("tie", F.xxhash64("text"))
    ranged = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    return ranged.select("doc_id", "text").mapInArrow(write, "part long, path string, n_ids long, n_docs long")


def read_ids(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """Each document of the files in ``manifest``: ``doc_id, start, n_tokens, ids_crc32``.

    The manifest has one row per file; where a file begins among all ids is a
    running sum over those rows.
    """
    found, base = [], 0
    for row in sorted(manifest.collect()):
        found.append((row.path, base))
        base += row.n_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = opened(folder)
        for batch in batches:
            for path, start in zip(batch["path"].to_pylist(), batch["base"].to_pylist(), strict=True):
                rows: list[tuple] = []
                with files.open_input_file(path) as stream:
                    for doc_id, n, crc in PlaneReader(stream).documents():
                        rows.append((doc_id, start, n, crc))
                        start += n
                        if len(rows) == 50_000:
                            yield columns(rows)
                            rows = []
                yield columns(rows)

    names = ("doc_id", "start", "n_tokens", "ids_crc32")

    def columns(rows: list[tuple]) -> pa.RecordBatch:
        made = list(zip(*rows, strict=True)) or [()] * 4
        return pa.record_batch([pa.array(c, pa.int64()) for c in made], names=list(names))

    listed = spark.createDataFrame(found, "path string, base long")
    return listed.repartition(max(1, len(found))).mapInArrow(read, ", ".join(f"{c} long" for c in names))


def token_files(docs: DataFrame, vocabulary: str, end_id: int = 1, planes: str = "byte") -> DataFrame:
    """Write all documents as id files in the shared folder and read them back."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "ids")
    manifest = stored(write_ids(docs, folder, vocabulary, end_id, planes), "ids-manifest")
    return read_ids(spark, manifest, folder)
