"""Classes of near-duplicate texts from equal bands.

Equal texts are one node.  Nodes with an equal band value form a group.  First
all members of a group are compared with one of them, its leader, and what is
alike is joined into classes; that settles groups of copies at one comparison
per member.  Only groups that still hold several classes are looked into, large
ones in blocks: a member outside a block's largest class is compared with the
members of other classes, by sketch and, unless the sketches put the pair five
standard errors below the threshold, by all shingles.  A pair is compared in
the first band that it shares, and a member names one link to a class.

So pairs are neither listed nor shuffled, only links are, and no pair that
shares a band is left out but those of one class.

Links and classes stay in Spark: classes come from passing the smallest label
along links with pointer jumping, one written table per round, and later links
are joined on classes instead of members.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, free, stored, text_bytes, whole_text
from .shingles import WIDTH, shingle_hashes

TEXT_BYTES = 1 << 20
#: Members compared with each other in one block.
BLOCK = 1024

#: From texts end to end and where they begin: band values, which texts have any, and one byte per
#: register.  Bands are equal if and only if their bytes are.
Bands = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
Similarity = Callable[[np.ndarray, np.ndarray], float]


def node(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(text.cast("binary")))


def nodes_of(docs: DataFrame, bands: Bands) -> DataFrame:
    """``doc_id, node, bands, sketch`` of every document; null bands for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch["text"])
            for lo, hi in blocks(starts, TEXT_BYTES):
                values, has, registers = bands(data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo])
                flat = pa.array(values.view(np.int64).reshape(-1))
                at = pa.array(np.arange(0, (hi - lo) * values.shape[1] + 1, values.shape[1]), pa.int32())
                listed = pa.ListArray.from_arrays(at, flat, mask=pa.array(~has))
                sketch = pa.array([r.tobytes() for r in registers], pa.binary())
                made = [batch["doc_id"][lo:hi].cast(pa.int64()), batch["node"][lo:hi], listed, sketch]
                yield pa.record_batch(made, names=["doc_id", "node", "bands", "sketch"])

    rows = docs.select("doc_id", whole_text().alias("text")).withColumn("node", node(F.col("text")))
    return rows.mapInArrow(run, "doc_id long, node binary, bands array<long>, sketch binary")


def verified(pairs: DataFrame, texts: DataFrame, similar: Similarity, threshold: float, width: int) -> DataFrame:
    """The ``pairs(a, b)`` whose texts are similar enough.

    Rows are joined to their texts one side at a time; a side with many pairs
    is split by the skew join.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [text_bytes(batch[c]) for c in ("text_a", "text_b")]
            # A block of pairs is bounded by the bytes of both sides.
            for lo, hi in blocks(sides[0][1] + sides[1][1], TEXT_BYTES):
                found = []
                for data, starts in sides:
                    part = data[starts[lo] : starts[hi]]
                    found.append(shingle_hashes(part, starts[lo : hi + 1] - starts[lo], width))
                (a, at), (b, bt) = found
                good = [similar(a[at[i] : at[i + 1]], b[bt[i] : bt[i + 1]]) >= threshold for i in range(hi - lo)]
                yield pa.record_batch([batch["a"][lo:hi].filter(pa.array(good)), batch["b"][lo:hi].filter(pa.array(good))], names=["a", "b"])

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """``node, label`` of all ends of ``links(a, b)``: the smallest node they are connected with."""
    ways = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ways = stored(ways.where("a != b").distinct(), "ways")
    labels = stored(ways.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        # The smallest label next door, then the label of that label.
        near = ways.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").withColumn("low", F.least("label", "near")).select("node", "label", "low")
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("further"))
        new = low.join(jump, "low", "left").select("node", F.least("low", "further").alias("new"), F.col("label").alias("old"))
        new = stored(new, "labels")
        labels = new.select("node", F.col("new").alias("label"))
        if new.where("new != old").isEmpty():
            return labels


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The classes after further links between their members."""
    of = labels.select(F.col("node"), F.col("label"))
    ends = links
    for side in ("a", "b"):
        named = of.select(F.col("node").alias(side), F.col("label").alias("to"))
        ends = ends.join(named, side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
    merged = components(ends.where("a != b"))
    to = merged.select(F.col("node").alias("label"), F.col("label").alias("to"))
    old = labels.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    new = merged.join(labels.select("node"), "node", "left_anti")
    return stored(old.unionByName(new), "labels")


def members_of(group: pa.Table, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sketches and shingles of the rows of a group."""
    sketch = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint8).reshape(group.num_rows, -1)
    data, starts = text_bytes(group["text"])
    shingles: list[np.ndarray] = []
    for lo, hi in blocks(starts, TEXT_BYTES):
        found, rows = shingle_hashes(data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo], width)
        shingles += [found[a:b] for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]
    return sketch, shingles


def links_in(group: pa.Table, similar: Similarity, threshold: float, rows: int, width: int) -> list[tuple[int, int]]:
    """Links between classes of a block, as positions; ``rows`` registers make a band."""
    label = group["label"].combine_chunks().dictionary_encode().indices.to_numpy()
    own, band = group["own"].to_numpy(), int(group["band"][0].as_py())
    apart = group["low"][0].as_py() != group["high"][0].as_py()  # two blocks: only pairs across them
    sketch, shingles = members_of(group, width)
    least = threshold - 5 * (threshold * (1 - threshold) / sketch.shape[1]) ** 0.5
    asking, links = np.flatnonzero(label != np.bincount(label).argmax()), []
    for lo in range(0, len(asking), 32):
        mine = asking[lo : lo + 32]
        same = sketch[mine][:, None, :] == sketch[None, :, :]
        agree = same.mean(axis=2)
        agree[label[mine][:, None] == label[None, :]] = 0
        if apart:
            agree[own[mine][:, None] == own[None, :]] = 0
        if band:
            before = same[:, :, : band * rows].reshape(len(mine), len(label), band, rows)
            agree[before.all(axis=3).any(axis=2)] = 0
        for row, shares in zip(mine.tolist(), agree, strict=True):
            linked: set[int] = set()
            found = np.flatnonzero(shares >= least)
            for other in found[np.argsort(-shares[found], kind="stable")].tolist():
                if label[other] not in linked and similar(shingles[row], shingles[other]) >= threshold:
                    linked.add(label[other])
                    links.append((row, other))
    return links


def cross_links(rest: DataFrame, similar: Similarity, threshold: float, rows: int, width: int) -> DataFrame:
    """Links ``a, b`` between members of different classes in a group.

    ``rest`` has ``value, band, node, label, size, sketch, text``.  Members of
    a block's largest class ask for nothing: the others ask them.
    """

    def links_of(group: pa.Table) -> Iterator[pa.RecordBatch]:
        found = links_in(group, similar, threshold, rows, width)
        if found:
            node = group["node"].combine_chunks()
            one, two = (node.take(pa.array(x)) for x in zip(*found, strict=True))
            yield pa.record_batch([one, two], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([*held, batch]).combine_chunks()
            keys = [whole[c].to_numpy() for c in ("value", "low", "high")]
            changes = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            edges = [0, *changes.tolist()]
            for a, b in zip(edges, edges[1:], strict=False):
                yield from links_of(whole.slice(a, b - a))
            held = whole.slice(edges[-1]).combine_chunks().to_batches()  # the last group may go on
        if held:
            yield from links_of(pa.Table.from_batches(held))

    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = rest.withColumn("own", F.pmod(F.xxhash64("node", "value"), parts).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    dealt = dealt.select("value", "low", "high", "own", "band", "node", "label", "sketch", "text")
    dealt = dealt.repartition("value", "low", "high").sortWithinPartitions("value", "low", "high")
    return dealt.mapInArrow(run, "a binary, b binary")


def near_labels(docs: DataFrame, bands: Bands, rows: int, similar: Similarity, threshold: float = 0.8, width: int = WIDTH) -> DataFrame:
    """``doc_id, node, label`` of ``docs(doc_id, text)``; documents of one class share the label."""
    signed = stored(nodes_of(docs, bands), "signed")
    distinct = signed.where("bands IS NOT NULL").groupBy("node").agg(F.first("bands").alias("bands"))
    values = distinct.select("node", F.posexplode("bands").alias("band", "value"))
    groups = values.groupBy("value").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("size")).where("size > 1")
    # Both sides grow with the corpus, so neither is ever broadcast: one plan at every size.
    members = stored(values.join(groups.hint("merge"), "value"), "members")

    wanted = stored(members.select("node").distinct(), "wanted")
    texts = docs.select(whole_text().alias("text")).withColumn("node", node(F.col("text")))
    texts = stored(texts.join(wanted.hint("merge"), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "texts")

    pairs = members.where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    labels = components(stored(verified(pairs, texts, similar, threshold, width), "links"))
    marked = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = marked.groupBy("value").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
    rest = marked.select("value", "band", "node", "label", "size").join(several.select("value"), "value", "left_semi")
    rest = stored(rest, "open")
    if not rest.isEmpty():
        mine = signed.join(rest.select("node").distinct(), "node", "left_semi")
        sketches = mine.groupBy("node").agg(F.first("sketch").alias("sketch"))
        links = cross_links(rest.join(sketches, "node").join(texts, "node"), similar, threshold, rows, width)
        labels = joined(labels, stored(links, "links"))
    named = signed.select("doc_id", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = stored(named.select("doc_id", "node", "label"), "named")
    free(signed, members, wanted, texts, rest)
    return named


def near_classes(docs: DataFrame, bands: Bands, rows: int, similar: Similarity, threshold: float = 0.8, width: int = WIDTH) -> DataFrame:
    """``doc_id, class_id`` of ``docs(doc_id, text)``; a class is named by its smallest doc_id.

    Edge cases: a null text is empty; a text without words is alike only to
    equal ones; null doc_ids get a class and name one only if nothing else does;
    repeated rows give repeated rows; an empty table gives none.
    """
    named = near_labels(docs, bands, rows, similar, threshold, width)
    least = named.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    return named.join(least, "label").select("doc_id", "class_id")


def one_of_each(docs: DataFrame, bands: Bands, rows: int, similar: Similarity, threshold: float = 0.8, width: int = WIDTH) -> DataFrame:
    """One row of each class of ``docs``, with all its columns.

    It is one of smallest doc_id (null last), of several the first by digest of
    the text, and of rows that share both any one.
    """
    named = near_labels(docs, bands, rows, similar, threshold, width)
    best = named.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("best"))
    own, key = f"node_{uuid.uuid4().hex}", f"id_{uuid.uuid4().hex}"  # names that no column of docs has
    best = best.select(F.col("best.node").alias(own), F.col("best.doc_id").alias(key))
    kept = docs.withColumn(own, node(whole_text())).join(best, own).where(F.col("doc_id").eqNullSafe(F.col(key)))
    return kept.dropDuplicates([own]).drop(own, key)
