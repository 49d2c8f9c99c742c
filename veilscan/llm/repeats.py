"""Removing passages that occurred before, anywhere in the corpus.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts earlier:
in a document of smaller doc_id, or earlier in the same one.

1. Equal texts become one (of smallest doc_id); all of a later copy goes.
2. *Candidates*: a string's *anchor* is the smallest hash among its runs of
   ``GRAM`` bytes, leftmost of equals.  Equal strings have equal anchors at the
   same place, so only strings whose anchor hash occurs twice in the corpus can
   repeat.  Hashes, not texts, are shuffled to find those.
3. The surroundings of repeated anchors are dealt to tasks by anchor hash.  Of
   equal surroundings all but the earliest are marked whole.  Each task sorts
   the suffixes that start in the others block by block (``suffixes``), and of
   equal strings all but the earliest are marked.
4. Marks go back to their documents, which are cut.

An anchor that very many documents share is found from a bounded sample and
dealt to several tasks, with a second step for what they leave; which anchors
are treated so does not change the result.  Texts lie in a table bucketed by
their digest, so steps 3 and 4 read them without shuffling them again.

Edge cases: a null text is empty; a text shorter than ``LENGTH`` stays; a null
doc_id comes before all others; texts of equal doc_id are ordered by digest;
of repeated rows one counts as the first; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import Powers, POWERS, blocks, mix, ragged, stored, text_bytes, whole_text
from .suffixes import Block

LENGTH = 100
GRAM = 32
#: Strings per anchor at most.
REACH = LENGTH - GRAM + 1
CHUNK = 1 << 18
INDEX_BITS = np.uint64((1 << 20) - 1)
#: Surroundings sorted at a time, about.
CONTEXTS = 8192
#: Documents looked at to find very common anchors, and how often they must occur there.
SAMPLE_DOCS, COMMON, MOST_COMMON = 20_000, 20, 100_000
#: Occurrences of a common anchor for one task, about.
SHARE = 4096


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width + width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each position on."""
    up, down = POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    n = len(data) - GRAM + 1
    return mix((sums[GRAM:] - sums[:-GRAM]) * down[:n])


def anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of each row's strings: ``row, first, n, place, hash``.

    An anchor stands for the ``n`` strings of the row from ``first`` on and lies
    at ``place``, counted from there.
    """
    found = []
    for lo, hi in blocks(starts, CHUNK):
        a, b = int(starts[lo]), int(starts[hi])
        # More than once only for one long row: its strings in steps, each with the bytes it needs.
        for at in range(a, b, CHUNK) if hi - lo == 1 else (a,):
            stop = min(at + CHUNK + LENGTH - 1, b) if hi - lo == 1 else b
            if stop - at >= LENGTH:
                found.append(anchors_of(data[at:stop], np.clip(starts[lo : hi + 1] - at, 0, stop - at), lo, at - a if hi - lo == 1 else 0))
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (empty, empty, empty, empty, empty.astype(np.uint64))


def anchors_of(data: np.ndarray, starts: np.ndarray, row: int, skipped: int):
    hashes = gram_hashes(data)
    key = (hashes & ~INDEX_BITS) | np.arange(len(hashes), dtype=np.uint64)
    at = (sliding_least(key, REACH) & INDEX_BITS).astype(np.int64)
    size = np.diff(starts)
    string = ragged(starts[:-1], np.maximum(size - LENGTH + 1, 0))
    owner = np.repeat(np.arange(len(size)), np.maximum(size - LENGTH + 1, 0))
    at = at[string]
    new = np.ones(len(string), bool)
    new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(string)))
    begin = string[first]
    return owner[first] + row, begin - starts[owner[first]] + skipped, n, at[first] - begin, hashes[at[first]]


def distinct_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts of at least ``LENGTH`` bytes once each, and their numbers.

    The first table, ``node, rid, doc_id, text``, is bucketed by ``node``; the
    second one is ``rid, node, doc_id``.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", whole_text().alias("text")).where(F.octet_length("text") >= LENGTH)
    once = rows.groupBy(digest(F.col("text")).alias("node")).agg(F.min(F.struct("doc_id")).alias("first"), F.first("text").alias("text"))
    once = once.select("node", F.monotonically_increasing_id().alias("rid"), F.col("first.doc_id").alias("doc_id"), "text")
    name, parts = f"texts_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    once.write.bucketBy(parts, "node").format("parquet").option("path", scratch_path(spark, "texts")).saveAsTable(name)
    texts = spark.table(name)
    return texts, stored(texts.select("rid", "node", "doc_id"), "numbers")


def digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def anchor_rows(texts: DataFrame) -> DataFrame:
    """``rid, k, hash``: the k-th anchor of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch["text"])
            row, _, _, _, found = anchors(data, starts)
            at = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.record_batch([batch["rid"], pa.ListArray.from_arrays(at, pa.array(found.view(np.int64)))], names=["rid", "hashes"])

    packed = texts.select("rid", "text").mapInArrow(run, "rid long, hashes array<long>")
    return packed.select("rid", F.posexplode("hashes").alias("k", "hash"))


def common_anchors(texts: DataFrame, n: int) -> DataFrame:
    """``hash, shares`` of anchors that very many texts hold; at most ``MOST_COMMON`` rows.

    From a sample of about ``SAMPLE_DOCS`` of the ``n`` texts.
    """
    share = SAMPLE_DOCS / max(n, 1)
    some = texts.where(F.pmod(F.xxhash64("rid"), F.lit(1 << 30)) / F.lit(float(1 << 30)) < share)
    counts = anchor_rows(some).groupBy("hash").count().where(F.col("count") >= COMMON)
    shares = F.ceil(F.col("count") / F.lit(min(share, 1.0)) / SHARE).cast("int")
    return counts.orderBy(F.desc("count"), "hash").limit(MOST_COMMON).select("hash", shares.alias("shares"))


def repeated_anchors(texts: DataFrame, common: DataFrame) -> DataFrame:
    """``rid, k, shares`` of the anchors whose hash occurs more than once."""
    rows = anchor_rows(texts).join(F.broadcast(common), "hash", "left")
    often = F.count(F.lit(1)).over(Window.partitionBy("hash"))
    rare = rows.where("shares IS NULL").withColumn("often", often).where("often > 1")
    return rows.where("shares IS NOT NULL").select("rid", "k", "shares").unionByName(rare.select("rid", "k", F.lit(1).alias("shares")))


CONTEXT = "hash long, share int, shares int, doc_id long, rid long, first int, n int, place int, context binary"


def contexts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes around the wanted anchors, see ``CONTEXT``; and marks, as rows with a null context.

    Equal surroundings later in one text are marked at once.
    """
    schema = pa.schema([("hash", pa.int64()), ("share", pa.int32()), ("shares", pa.int32()), ("doc_id", pa.int64()), ("rid", pa.int64())])
    schema = pa.schema([*schema, ("first", pa.int32()), ("n", pa.int32()), ("place", pa.int32()), ("context", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch["text"])
            for lo, hi in blocks(starts, CHUNK):
                part = batch.slice(lo, hi - lo)
                raw, begin = data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo]
                row, first, n, place, found = anchors(raw, begin)
                ks = part["ks"].flatten()
                owner = np.repeat(np.arange(hi - lo), pc.list_value_length(part["ks"]).to_numpy())
                shares = ks.field("shares").to_numpy()
                own = np.searchsorted(row, np.arange(hi - lo))[owner] + ks.field("k").to_numpy()
                first, n, place, found = first[own], n[own], place[own], found[own]
                at, whole = begin[owner] + first, raw.tobytes()
                context = [whole[a:b] for a, b in zip(at.tolist(), (at + n + LENGTH - 1).tolist(), strict=True)]
                seen: set[tuple[int, int, bytes]] = set()
                for j, key in enumerate(zip(owner.tolist(), place.tolist(), context, strict=True)):
                    if key in seen:
                        context[j] = None
                    seen.add(key)
                share = mix(part["rid"].to_numpy().astype(np.uint64))[owner] % shares.astype(np.uint64)
                # A long text's surroundings are several times its size.
                for a in range(0, len(own), CONTEXTS):
                    b = a + CONTEXTS
                    yield pa.record_batch(
                        [
                            pa.array(found[a:b].view(np.int64)),
                            pa.array(share[a:b].astype(np.int32)),
                            pa.array(shares[a:b], pa.int32()),
                            part["doc_id"].take(pa.array(owner[a:b])),
                            part["rid"].take(pa.array(owner[a:b])),
                            pa.array(first[a:b], pa.int32()),
                            pa.array(n[a:b], pa.int32()),
                            pa.array(place[a:b], pa.int32()),
                            pa.array(context[a:b], pa.binary()),
                        ],
                        schema=schema,
                    )

    return texts.join(wanted, "node").select("doc_id", "rid", "text", "ks").mapInArrow(run, CONTEXT)


def runs(text: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of successive starts of a text: text, first, last."""
    order = np.lexsort((start, text))
    text, start = text[order], start[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(text)) - 1
    return text[at], start[at], start[last] if len(at) else start[:0]


OTHER = Powers()
OTHER.BASE = 0xC2B2AE3D27D4EB4F


def string_hashes(content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each row of bytes."""
    out = []
    for powers in (POWERS, OTHER):
        up, _ = powers.upto(LENGTH + 1)
        out.append(mix((content.astype(np.uint64) + np.uint64(1)) @ up[: content.shape[1]]))
    return out[0], out[1]


def copies(context: pa.ChunkedArray, group: np.ndarray, place: np.ndarray, age: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which surroundings are later copies of whole others; and the rows whose strings are yet to be sorted.

    All strings of a later copy occurred before.  Strings of one surrounding
    differ, so one that is left alone in its group has no more to find, unless
    its strings are in other tasks as well (``open_``).
    """
    if isinstance(context, pa.ChunkedArray):
        context = context.combine_chunks()
    content = context.dictionary_encode().indices.to_numpy()
    order = np.lexsort((age, content, place, group))
    copy = np.zeros(len(order), bool)
    same = [x[order][1:] == x[order][:-1] for x in (content, place, group)]
    copy[order[1:]] = same[0] & same[1] & same[2]
    left = np.bincount(group, ~copy)
    return copy, np.flatnonzero(~copy & ((left[group] > 1) | open_))


MARK = "rid long, first int, last int, high long, low long, doc_id long"


def marked(around: DataFrame) -> DataFrame:
    """Runs of strings that occurred before, ``rid, first, last``; see ``MARK``.

    For an anchor dealt to several tasks, also the earliest of each string a
    task has, with the string's 128-bit hash.
    """
    schema = pa.schema([("rid", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("high", pa.int64()), ("low", pa.int64()), ("doc_id", pa.int64())])

    def sort(part: pa.Table) -> Iterator[pa.RecordBatch]:
        get = {c: part[c].to_numpy() for c in ("hash", "share", "shares", "rid", "first", "n", "place")}
        doc_id, null = part["doc_id"].fill_null(0).to_numpy(), part["doc_id"].is_null().to_numpy()
        group = np.cumsum(np.append(False, (get["hash"][1:] != get["hash"][:-1]) | (get["share"][1:] != get["share"][:-1])))
        order = np.lexsort((get["first"], get["rid"], doc_id, ~null))
        age = np.empty(len(order), np.int64)
        age[order] = np.arange(len(order))
        copy, rest = copies(part["context"], group, get["place"], age, get["shares"] > 1)
        if copy.any():
            first, no = get["first"][copy], pa.nulls(int(copy.sum()), pa.int64())
            yield pa.record_batch([pa.array(get["rid"][copy]), pa.array(first), pa.array(first + get["n"][copy] - 1), no, no, no], schema=schema)
        if not len(rest):
            return
        part, group, age = part.take(pa.array(rest)), group[rest], age[rest]
        get = {c: x[rest] for c, x in get.items()}
        data, starts = text_bytes(part["context"])
        block = Block(data, np.diff(starts), get["place"].astype(np.int64))
        texts, places = [], []
        for text, start, run in block.buckets(group, get["n"].astype(np.int64), LENGTH):
            oldest = np.minimum.reduceat(age[text], np.searchsorted(run, np.arange(run[-1] + 1)))
            later = age[text] > oldest[run]
            texts.append(text[later])
            places.append(start[later])
            open_ = ~later & (get["shares"][text] > 1)
            if open_.any():
                t, s = text[open_], start[open_]
                at = block.begin[t] + s
                high, low = string_hashes(block.text[at[:, None] + np.arange(LENGTH)])
                where = pa.array(get["first"][t] + s, pa.int32())
                ids = part["doc_id"].combine_chunks().take(pa.array(t))
                yield pa.record_batch([pa.array(get["rid"][t]), where, where, pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), ids], schema=schema)
        text, first, last = runs(np.concatenate(texts), np.concatenate(places))
        if len(text):
            base, no = get["first"][text], pa.nulls(len(text), pa.int64())
            yield pa.record_batch([pa.array(get["rid"][text]), pa.array(base + first, pa.int32()), pa.array(base + last, pa.int32()), no, no, no], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CONTEXTS:
                whole = pa.Table.from_batches(held).combine_chunks()
                key, share = whole["hash"].to_numpy(), whole["share"].to_numpy()
                changes = np.flatnonzero((key[1:] != key[:-1]) | (share[1:] != share[:-1])) + 1
                if len(changes):  # the last group may go on
                    yield from sort(whole.slice(0, int(changes[-1])).combine_chunks())
                    whole = whole.slice(int(changes[-1]))
                held, rows = whole.to_batches(), whole.num_rows
        if rows:
            yield from sort(pa.Table.from_batches(held).combine_chunks())

    dealt = around.where("context IS NOT NULL").repartition("hash", "share").sortWithinPartitions("hash", "share")
    return dealt.mapInArrow(run, MARK)


def across_shares(marks: DataFrame) -> DataFrame:
    """Of strings that several tasks have, all but the earliest: ``rid, first, last``."""
    rows = marks.where("high IS NOT NULL").select("rid", "first", "last", "high", "low", F.struct("doc_id", "rid", "first").alias("age"))
    oldest = rows.groupBy("high", "low").agg(F.min("age").alias("oldest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return rows.join(oldest, ["high", "low"]).where("age != oldest OR NOT age <=> oldest").select("rid", "first", "last")


def removed_ranges(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """Maximal ranges of bytes under the strings that start from ``first`` to ``last``."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(first.tolist(), (last + LENGTH).tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def repeated_ranges(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The texts of ``docs(doc_id, text)``, and for each the runs of starts that occurred before.

    The texts are ``node, rid, doc_id, text``, of at least ``LENGTH`` bytes and
    once each; the runs ``node, marks`` with an array of ``(first, last)``.
    """
    texts, numbers = distinct_texts(docs)
    common = stored(common_anchors(texts, numbers.count()), "common")
    wanted = repeated_anchors(texts, common).groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("k", "shares"))).alias("ks"))
    wanted = wanted.join(numbers.select("rid", "node"), "rid").select("node", "ks")
    around = stored(contexts(texts, wanted), "contexts")
    marks = stored(marked(around), "marks")
    inside = around.where("context IS NULL").select("rid", "first", (F.col("first") + F.col("n") - 1).alias("last"))
    every = inside.unionByName(marks.where("high IS NULL").select("rid", "first", "last")).unionByName(across_shares(marks))
    by_text = every.groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("marks"))
    return texts, by_text.join(numbers.select("rid", "node"), "rid").select("node", "marks")


def whole_characters(raw: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges of UTF-8 bytes without the parts of characters at their ends."""
    out = []
    for a, b in ranges:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        out.append((a, b))
    return out


def cut_texts(docs: DataFrame, characters: bool = False) -> DataFrame:
    """``node, first_id, n_removed, n_spans, kept`` of each distinct text of ``docs``, the bytes kept as binary.

    With ``characters`` only whole characters are removed.
    """
    texts, marks = repeated_ranges(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, bytes]] = []
            for text, found in zip(batch["text"], batch["marks"], strict=True):
                raw = text.as_py().encode()
                if not found.is_valid:
                    rows.append((0, 0, raw))
                    continue
                gone = removed_ranges(found.values.field("first").to_numpy(), found.values.field("last").to_numpy())
                gone = whole_characters(raw, gone) if characters else gone
                edges = [0, *(x for r in gone for x in r), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(raw) - len(kept), len(gone), kept))
            made = list(zip(*rows, strict=True)) or [()] * 3
            types = (pa.int64(), pa.int64(), pa.binary())
            yield pa.record_batch(
                [batch["node"], batch["doc_id"], *(pa.array(c, t) for c, t in zip(made, types, strict=True))],
                names=["node", "first_id", "n_removed", "n_spans", "kept"],
            )

    both = texts.join(marks, "node", "left").select("node", "doc_id", "text", "marks")
    return both.mapInArrow(run, "node binary, first_id long, n_removed long, n_spans long, kept binary")


def cut_rows(docs: DataFrame, cut: DataFrame, names: list[str]) -> DataFrame:
    """Every row of ``docs`` with what is kept of it: the first copy of a text as cut, later ones empty.

    ``names`` are the columns of ``cut`` to take; they are null for short texts
    (nothing is cut) and for later copies (all is); ``later`` tells those.
    """
    rows = docs.groupBy("doc_id", "node", "n_bytes", "whole").agg(F.count(F.lit(1)).alias("copies"))
    joined = rows.join(cut.select("node", "first_id", F.lit(True).alias("long"), *names), "node", "left")
    joined = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("copy") == 1)
    return joined.withColumn("later", F.coalesce("long", F.lit(False)) & ~first)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row of ``docs(doc_id, text)``."""
    text = whole_text()
    rows = docs.select("doc_id", digest(text).alias("node"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("whole"))
    cut = cut_texts(docs).select("node", "first_id", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha"))
    out = cut_rows(rows, cut, ["n_removed", "n_spans", "sha"])
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(F.col("later"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("later"), F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("later"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("sha", "whole")).alias("kept_sha256"),
    )


def shortened(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, lang, source, n_chars)`` with repeats cut from ``text``; every row stays.

    Only whole characters are cut.  A null text stays null.
    """
    text = whole_text()
    long = F.octet_length(text) >= LENGTH
    rows = docs.select("doc_id", "lang", "source", digest(text).alias("node"), long.alias("long"), F.when(~long, F.col("text")).alias("short"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    first = rows.where("long").groupBy("node").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    cut = cut_texts(docs, characters=True).select("node", "kept")
    cut = cut.join(first.select("node", F.col("first.row").alias("row")), "node").select("row", F.col("kept").cast("string").alias("kept"))
    out = rows.join(cut, "row", "left").withColumn("text", F.when(F.col("long"), F.coalesce("kept", F.lit(""))).otherwise(F.col("short")))
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
