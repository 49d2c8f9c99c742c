"""A Merkle tree over a dataset, and the proof of every row by a recursive query.

Rows are leaves of the tree of their language, in order of doc_id; the tops of
these trees are the leaves of one more tree, whose top is the root.

*Build*: leaves are numbered by a range sort and counts per partition.  Blocks
of ``2**HEIGHT`` nodes are brought together, their inner levels are computed
within the row, and block tops are the nodes of the next hop, until each tree
has one.  What is stored are parent-linked node rows: ``tree, hop, at, parent,
path``, where ``path`` has the siblings met on the way to the parent.

*Climb*: a recursive SQL query starts at every leaf's node row, folds the
(possibly tampered) hash with the siblings on it, and goes on with the parent,
joining its node row, appending the siblings and folding again.  A leaf's row
holds its hashes, so the first hop joins nothing.  Above it every block of
leaves has its own copy of the rows, so no key has more than ``2**HEIGHT``
climbers however large a tree is, and the rounds are the logarithm to the base
of a block.

Edge cases: nulls in any column are hashed as ``-``; null languages and null
doc_ids come first; rows of equal doc_id are ordered by their leaf, and equal
rows are leaves of their own; a tree of one leaf has that leaf as its top; an
empty table gives no rows and no root; other columns are ignored; texts are
hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Levels of a tree that one hop of the climb spans.
HEIGHT = 10
LEFT, RIGHT, LONE = "<", ">", "-"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit(LONE))


def leaf_hash(n_chars: Column) -> Column:
    parts = [field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, tree, leaf, tampered`` of every row; trees sort as their languages do."""
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(LONE))
    leaf = leaf_hash(F.col("n_chars"))
    return docs.select("doc_id", tree.alias("tree"), leaf.alias("leaf"), F.when(changed, leaf_hash(more)).otherwise(leaf).alias("tampered"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``pos``, the place within ``tree``, and ``n``, the size of the tree.

    Rows are cut by range over all partitions and written; one small row per
    partition and tree then tells how many come before.
    """
    rows = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    rows = stored(rows.withColumn("seat", F.monotonically_increasing_id()), "ordered").withColumn("part", F.shiftright("seat", 33))
    counts = rows.groupBy("tree", "part").agg(F.min("seat").alias("first"), F.count(F.lit(1)).alias("k"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("k").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("k").over(tree).alias("n"))
    return rows.join(counts, ["tree", "part"]).withColumn("pos", F.col("seat") + F.col("shift")).drop("seat", "part", "shift")


def joined(*parts: Column) -> Column:
    """H of digests, which count as lower-case hex text."""
    return F.unhex(F.sha2(F.lower(F.concat(*[F.hex(p) for p in parts])), 256))


def blocks(nodes: DataFrame, keep: list[str]) -> DataFrame:
    """``tree, pos, path, parent, n, top`` of ``nodes(tree, pos, n, hash)``, and the columns to ``keep``.

    ``path`` has an entry for each level up to the node's block top ``top``:
    a side and the sibling, or no sibling.  ``parent`` numbers the blocks of a
    tree, of which there are ``n``.
    """
    block = F.shiftright("pos", HEIGHT)
    members = F.sort_array(F.collect_list(F.struct("pos", "hash", *[c for c in keep if c != "hash"])))
    rows = nodes.groupBy("tree", block.alias("parent"), "n").agg(members.alias("members"))
    tall = F.col("n") > (1 << HEIGHT)

    def above(level: Column) -> Column:
        """The next level; an empty one lies above the top of a tree."""

        def one(i: Column) -> Column:
            second = F.get(level, 2 * i + 1)
            return F.when(second.isNull(), joined(F.get(level, 2 * i))).otherwise(joined(F.get(level, 2 * i), second))

        pairs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int"))
        more = (F.size(level) > 1) | (tall & (F.size(level) > 0))
        return F.when(more, F.transform(pairs, one)).otherwise(F.array().cast("array<binary>"))

    # One fold, since each level is used several times in the next.
    levels = F.aggregate(
        F.sequence(F.lit(1), F.lit(HEIGHT)), F.array(F.col("members.hash")), lambda done, _: F.concat(done, F.array(above(F.element_at(done, -1))))
    )
    rows = rows.withColumn("levels", F.filter(levels, lambda level: F.size(level) > 0))

    def path(member: Column, i: Column) -> Column:
        def entry(level: Column, k: Column) -> Column:
            at = F.floor(i / F.pow(F.lit(2), k)).cast("int")
            sibling = F.get(level, F.when(at % 2 == 1, at - 1).otherwise(at + 1))
            side = F.when(at % 2 == 1, F.lit(LEFT)).otherwise(F.lit(RIGHT)).cast("binary")
            return F.when(sibling.isNull(), F.lit(LONE).cast("binary")).otherwise(F.concat(side, sibling))

        below = F.slice("levels", F.lit(1), F.size("levels") - 1)
        return F.struct(member["pos"].alias("pos"), F.transform(below, entry).alias("path"), *[member[c].alias(c) for c in keep])

    size = F.shiftright(F.col("n") + ((1 << HEIGHT) - 1), HEIGHT)
    rows = rows.withColumn("paths", F.transform("members", path)).withColumn("top", F.element_at("levels", -1)[0]).withColumn("blocks", size)
    # An outer generator, since for an inner one the optimizer adds a test of size that folds the levels anew for every member.
    return rows.select("tree", F.inline_outer("paths"), "parent", F.col("blocks").alias("n"), "top")


def hops(nodes: DataFrame, keep: list[str]) -> list[DataFrame]:
    """What ``blocks`` gives for the nodes of each hop; the last has one block per tree.

    Rows of the first hop also have the columns to ``keep``.
    """
    largest, found = nodes.agg(F.max("n")).first()[0] or 0, []
    while True:
        found.append(stored(blocks(nodes, [] if found else keep), "merkle"))
        largest = -(-largest >> HEIGHT)
        if largest <= 1:
            return found
        # One member of each block brings its top; trees of one block are done.
        first = (F.col("pos") % (1 << HEIGHT) == 0) & (F.col("n") > 1)
        nodes = found[-1].where(first).select("tree", F.col("parent").alias("pos"), "n", F.col("top").alias("hash"))


def tops(found: list[DataFrame]) -> DataFrame:
    """``tree, hash``: the top of each tree."""
    every = [h.where("n = 1 AND pos = 0").select("tree", F.col("top").alias("hash")) for h in found]
    out = every[0]
    for more in every[1:]:
        out = out.unionByName(more)
    return out


def root_paths(subroots: DataFrame) -> DataFrame:
    """``tree, path, root``: the siblings from each tree's top to the root."""
    rows = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash"), ["name"])
    rows = stored(rows, "subroots")
    out = rows.select("name", "pos", F.array().cast("array<binary>").alias("path"))
    for hop in hops(rows.select("tree", "pos", "n", "hash"), []):
        step = hop.select("pos", F.col("path").alias("more"), "parent", "top")
        out = out.drop("top").join(step, "pos").select("name", F.col("parent").alias("pos"), F.concat("path", "more").alias("path"), "top")
    return out.select(F.col("name").alias("tree"), "path", F.col("top").alias("root"))


#: What the node row of a leaf keeps of it.
LEAF = ["hash", "doc_id", "tampered"]
LINK = ["tree", "hop", "at", "parent", "path", "subroot", "root"]


def links(found: list[DataFrame]) -> DataFrame:
    """The stored node rows above the first hop: ``LINK``, the last hop of each tree leading to the root.

    ``at`` is the number of the block of leaves that climbs; so is ``parent``.
    """
    none, rows = F.lit(None).cast("binary"), []
    ended = F.when(F.col("n") == 1, F.col("top"))
    up = stored(root_paths(tops(found)), "root-paths")
    climbers = found[0].where(F.col("pos") % (1 << HEIGHT) == 0).select("tree", F.col("parent").alias("at"), F.col("parent").alias("pos"), "n")
    for hop in range(1, len(found) + 1):
        done = climbers.where("n = 1").join(up, "tree")
        rows.append(done.select("tree", F.lit(hop).alias("hop"), "at", F.col("at").alias("parent"), "path", none.alias("subroot"), "root"))
        if hop < len(found):
            climbers = climbers.where("n > 1").drop("n").join(found[hop], ["tree", "pos"])
            rows.append(climbers.select("tree", F.lit(hop).alias("hop"), "at", F.col("at").alias("parent"), "path", ended.alias("subroot"), none.alias("root")))
            climbers = climbers.select("tree", "at", F.col("parent").alias("pos"), "n")
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def folded(path: str, start: str) -> str:
    """SQL for the hash that ``start`` becomes on its way past the siblings of ``path``."""
    left, right = (f"startswith(s, X'{side.encode().hex()}')" for side in (LEFT, RIGHT))
    other = "hex(substr(s, 2))"
    pair = f"CASE WHEN {left} THEN concat({other}, hex(h)) WHEN {right} THEN concat(hex(h), {other}) ELSE hex(h) END"
    return f"aggregate({path}, {start}, (h, s) -> unhex(sha2(lower({pair}), 256)))"


def siblings(path: str, before: str) -> str:
    """SQL for the siblings of ``path`` after those of ``before``."""
    return f"aggregate({path}, {before}, (p, s) -> concat(p, substr(s, 2)))"


CLIMB = f"""
WITH RECURSIVE climb AS (
    SELECT doc_id, hash AS leaf, tree, parent AS at, 1 AS hop, {folded("path", "tampered")} AS folded, {siblings("path", "X''")} AS proof,
        CASE WHEN n = 1 THEN top END AS subroot, CAST(NULL AS BINARY) AS root
    FROM {{leaves}}
    UNION ALL
    SELECT c.doc_id, c.leaf, c.tree, l.parent, c.hop + 1, {folded("l.path", "c.folded")}, {siblings("l.path", "c.proof")},
        coalesce(c.subroot, l.subroot), l.root
    FROM climb c JOIN {{links}} l ON l.tree = c.tree AND l.hop = c.hop AND l.at = c.at
)
SELECT doc_id, leaf, subroot, root, proof, folded FROM climb WHERE root IS NOT NULL
"""
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def climbed(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof, folded`` of the node rows of leaves, which keep ``LEAF``.

    A round of the recursion has as many rows as there are leaves, so Spark's
    limit on rows is lifted while the result is written.
    """
    spark = leaves.sparkSession
    limit = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        return stored(spark.sql(CLIMB, leaves=leaves, links=nodes), "climbed")
    finally:
        spark.conf.set(ROW_LIMIT, limit)


def proofs(docs: DataFrame) -> DataFrame:
    """Leaf, roots and proof of every row, and what its tampered leaf folds to, as digests."""
    placed = numbered(leaves(docs), ["doc_id", "leaf"]).withColumnRenamed("leaf", "hash")
    found = hops(stored(placed.select("tree", "pos", "n", *LEAF), "leaves"), LEAF)
    return climbed(found[0], stored(links(found), "links"))


def verified(docs: DataFrame) -> DataFrame:
    """``proofs`` in hex, with a digest for the proof and the verdict on the tampered leaf."""
    out = proofs(docs)
    names = {"leaf": "leaf", "subroot": "subroot", "root": "root", "folded": "folded_root"}
    shown = [F.lower(F.hex(c)).alias(name) for c, name in names.items()]
    proof = F.sha2(F.lower(F.hex("proof")), 256)
    return out.select("doc_id", *shown, proof.alias("proof_sha256"), (F.col("folded") == F.col("root")).alias("verified"))
