"""WARC archives in which repeated payloads are revisit records.

*Resolve*: headers (digest, page_id) are grouped by payload digest; of the
records with one payload, large enough, that with the largest page_id is the
response and the others revisit it.  Headers are counted per task first, so one
payload may own a third of all records.

*Bring to the payloads*: a bitmap of at most ``MARKS`` bits says which digests
occur more than once.  Pages whose digest it does not hold are responses and
stay where they are; the others, repeated or mistaken for such, meet their
verdict by page_id and digest, so payloads are never shuffled by digest.  With
far more repeated digests than bits all pages take that way.

*Write*: each task writes one archive, a gzip member per record, with fresh
headers; a revisit has no payload but names the response it refers to.

*Read back*: a response's digest and size are computed from its payload again;
a revisit takes the size from the response with its digest, by a join of headers.

Edge cases: a null payload is empty; a null page_id is kept and counts as smaller
than any other; rows that share page_id and payload with the response are
responses too; line breaks in a URL are escaped, a null URL has no target;
an empty table gives no archives; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import attempt_suffix, opened, stored

#: Payloads below this size are always stored in full.
LEAST_BYTES = 1000
#: Bits of the map of repeated digests, 8 MB of them.
MARKS = 1 << 26
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The archives' date unless one is given: results do not depend on the clock.
DATE = "2000-01-01T00:00:00Z"
NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:veilscan:warc")


def record_id(page_id: int | None, digest: str) -> str:
    """The same page and payload always get the same record id."""
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id}/{digest}')}>"


def resolved(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """``page_id, url, payload, digest, refers_to`` of ``pages(page_id, url, html)``; ``revisit`` says which."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    df = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload.cast("binary")).alias("digest"))
    headers = stored(df.where(F.octet_length("payload") >= least).select("page_id", "digest"), "headers")
    first = headers.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies"))
    first = stored(first.where("copies > 1 AND refers_to IS NOT NULL").select("digest", "refers_to"), "repeated")
    revisits = headers.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()
    revisits = revisits.select(F.col("page_id").alias("r_page_id"), F.col("digest").alias("r_digest"), "refers_to")
    rows = with_marks(df, first)
    single = rows.where("NOT marked").withColumn("refers_to", F.lit(None).cast(first.schema["refers_to"].dataType))
    same = (F.col("digest") == F.col("r_digest")) & F.col("page_id").eqNullSafe(F.col("r_page_id"))
    others = rows.where("marked").join(revisits, same, "left")
    names = ["page_id", "url", "payload", "digest", "refers_to"]
    return single.select(names).unionByName(others.select(names)).withColumn("revisit", F.col("refers_to").isNotNull())


def with_marks(rows: DataFrame, digests: DataFrame) -> DataFrame:
    """``rows`` with ``marked``: true for every digest among ``digests``, and by chance for few others."""
    place = F.pmod(F.xxhash64("digest"), F.lit(MARKS)) + 1
    bucket, bit = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    marks = digests.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    byte = F.conv(F.hex(F.substr("bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1
    # A row per 32,768 bits that hold a mark: never more than MARKS / 32,768 of 4 KB.
    joined = rows.withColumn("bucket", bucket).join(F.broadcast(marks), "bucket", "left")
    return joined.withColumn("marked", F.coalesce(is_set, F.lit(False))).drop("bucket", "bits")


def head(fields: list[tuple[str, str | None]]) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None)]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record as a gzip member of its own."""
    body = b"" if revisit else payload
    label = base64.b32encode(bytes.fromhex(digest)).decode()
    target = url.replace("\r", "%0D").replace("\n", "%0A") if url is not None else None
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{label}"),
        ("WARC-Refers-To", record_id(refers_to, digest) if revisit else None),
        ("WARC-Profile", PROFILE if revisit else None),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Page-ID", None if page_id is None else str(page_id)),
        ("Refers-To-Page-ID", str(refers_to) if revisit else None),
        ("Content-Length", str(len(body))),
    ]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(head(fields) + body + b"\r\n\r\n") + pack.flush()


def write_archives(records: DataFrame, folder: str, date: str = DATE) -> DataFrame:
    """One archive per task of ``records`` as made by ``resolved``; ``path, records, bytes`` of each.

    A task writes under a name of its own and renames at the end, so a lost
    task leaves no half archive and simply runs again.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, base = opened(folder)
        part = TaskContext.get().partitionId()
        made, done = f"{base}/.{part:06d}-{attempt_suffix()}.tmp", f"{base}/part-{part:06d}.warc.gz"
        stream, n, size = None, 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = [c[i].as_py() for c in batch.columns]
                if stream is None:
                    files.create_dir(base, recursive=True)
                    stream = files.open_output_stream(made)
                raw = record(*row, date)
                stream.write(raw)
                n, size = n + 1, size + len(raw)
        if stream is not None:
            stream.close()
            files.move(made, done)
            yield pa.record_batch({"path": [done], "records": [n], "bytes": [size]})

    rows = records.select("page_id", "url", F.col("payload").cast("binary").alias("payload"), "digest", "refers_to", "revisit")
    return rows.mapInArrow(write, "path string, records long, bytes long")


def members(stream) -> Iterator[bytes]:
    """The contents of the gzip members of a stream, one at a time."""
    unpack, parts, raw = zlib.decompressobj(31), [], b""
    while raw := raw or stream.read(1 << 20):
        parts.append(unpack.decompress(raw))
        raw = b""
        if unpack.eof:
            yield b"".join(parts)
            raw, parts, unpack = unpack.unused_data, [], zlib.decompressobj(31)
    if parts:
        raise ValueError("archive is cut off")


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and content of one record."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def read_headers(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """``page_id, size, digest, record_type, refers_to`` of every record in the archives.

    The size and digest of a response are those of its payload as read.
    """
    schema = pa.schema([("page_id", pa.int64()), ("size", pa.int64()), ("digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def number(x: str | None) -> int | None:
        return None if x is None else int(x)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = opened(folder)
        for batch in batches:
            for path in batch["path"].to_pylist():
                rows: list[dict] = []
                with files.open_input_stream(path, compression=None) as stream:
                    for raw in members(stream):
                        fields, body = parsed(raw)
                        kind = fields["WARC-Type"]
                        said = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        found = hashlib.sha1(body).hexdigest() if kind == "response" else said
                        if found != said:
                            raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
                        size = len(body) if kind == "response" else None
                        refers = number(fields.get("Refers-To-Page-ID"))
                        rows.append({"page_id": number(fields.get("Page-ID")), "size": size, "digest": found, "record_type": kind, "refers_to": refers})
                        if len(rows) == 20_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    n = max(1, manifest.count())
    return manifest.select("path").repartition(n).mapInArrow(read, "page_id long, size long, digest string, record_type string, refers_to long")


def archived(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Write all pages to archives in the shared folder and describe every record from them."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    manifest = stored(write_archives(resolved(pages, least), folder), "warc-manifest")
    records = stored(read_headers(spark, manifest, folder), "warc-headers")
    # A revisit's size is that of the response it refers to.
    revisits = records.where("record_type = 'revisit'")
    originals = records.where("record_type = 'response'").select("digest", F.col("page_id").alias("refers_to"), F.col("size").alias("full_size"))
    originals = originals.join(revisits.select("digest", "refers_to").distinct(), ["digest", "refers_to"], "left_semi").distinct()
    out = revisits.join(originals, ["digest", "refers_to"]).withColumn("size", F.col("full_size"))
    names = ["page_id", "size", "digest", "record_type", "refers_to"]
    out = records.where("record_type = 'response'").select(names).unionByName(out.select(names))
    return out.select(
        "page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to"
    )
