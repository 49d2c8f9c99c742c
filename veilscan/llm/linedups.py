"""Lines that an earlier document holds already, by levelled sorted runs of line hashes.

Documents come in batches of ascending doc_id.  A *run* is a table of
``hash, doc``: the lines first met in one batch and the document that owns
each, bucketed and sorted by hash.  A new batch brings its lines together by
hash, keeps the smallest document of each, takes away what any run holds by
merging with it (buckets meet buckets, runs are not shuffled again), and what
is left becomes a run of level 0.  When a level has ``FANOUT`` runs and a batch
follows, they are compacted into one run of the next level, so a batch meets
few runs however many came before.

A document keeps a line only if it owns it.  So the verdict on a line is found
by ``(doc, hash)``, and a line that a third of all documents hold is no hot
key: map-side partial aggregation leaves one row per task of it, and one row
owns it.  Texts are shuffled once, to meet the verdicts on their own lines.

All of it is built-in column functions.  Lines are told apart by 128 bits of
SHA-256.

Edge cases: a null or empty text is one empty line; lines whose key has fewer
than ten code points always stay; a null doc_id counts as the smallest one;
rows of equal doc_id are one document, whose rows keep or lose a line alike;
repeated rows count each in the result; an empty table gives no rows; other
columns are ignored; a text may be of any length.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import stored, whole_text

WHITE = "\t\n\x0b\x0c\r "
LEAST = 10
#: Batches that a whole table is cut into, and runs of one level that are compacted into one.
BATCHES, FANOUT = 4, 2
FIRST = -(1 << 63)


def bare(line: Column) -> Column:
    """The line without white space at its ends."""
    return F.btrim(line, F.lit(WHITE))


def line_hash(line: Column) -> Column:
    """128 bits of a line without white space at its ends, A-Z in lower case."""
    key = bare(line)
    plain = F.octet_length(key) == F.char_length(key)
    key = F.when(plain, F.lower(key)).otherwise(F.translate(key, string.ascii_uppercase, string.ascii_lowercase))
    return F.unhex(F.substring(F.sha2(key, 256), 1, 32))


def is_long(line: Column) -> Column:
    return F.char_length(bare(line)) >= LEAST


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with ``doc``, never null, and ``row``, equal for equal texts."""
    rows = docs.select("doc_id", whole_text().alias("text"))
    return rows.withColumns({"doc": F.coalesce("doc_id", F.lit(FIRST)), "row": F.xxhash64("text"), "lines": F.split("text", "\n", -1)})


def line_hashes(docs: DataFrame) -> DataFrame:
    """``doc, row, nth, hash`` of every line of at least ``LEAST`` code points; ``nth`` counts these."""
    found = F.transform(F.filter("lines", is_long), line_hash)
    return keyed(docs).select("doc", "row", F.posexplode(found).alias("nth", "hash"))


class LineRuns:
    """The runs of all batches so far, by level; the newest batch is in level 0.

    Batches must come in ascending order of document.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.batches: list[str] = []

    def written(self, pairs: DataFrame) -> tuple[str, str]:
        """A run of these rows: its table, and where its files are."""
        name, path = f"line_run_{uuid.uuid4().hex}", scratch_path(self.spark, "line-run")
        pairs.write.bucketBy(self.buckets, "hash").sortBy("hash").format("parquet").option("path", path).saveAsTable(name)
        return name, path

    def compact(self) -> None:
        """Merge full levels into the next ones, from the lowest up."""
        for level, names in enumerate(self.levels):
            if len(names) < self.fanout:
                break
            runs = [self.spark.table(n) for n in names]
            merged = runs[0]
            for run in runs[1:]:
                merged = merged.unionByName(run)
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self.written(merged.repartition(self.buckets, "hash"))[0])
            self.drop(names)
            names.clear()

    def add(self, pairs: DataFrame) -> None:
        """Take in ``doc, hash`` of the lines of one more batch."""
        self.compact()
        new = pairs.groupBy("hash").agg(F.min("doc").alias("doc"))
        for name in [n for names in self.levels for n in names]:
            new = new.join(self.spark.table(name).select("hash").hint("merge"), "hash", "left_anti")
        name, path = self.written(new)
        self.levels[0].append(name)
        self.batches.append(path)

    def owned(self) -> DataFrame:
        """``doc, hash``: who owns each line, over all batches; readable after ``close``."""
        if not self.batches:
            return self.spark.createDataFrame([], "doc long, hash binary")
        return self.spark.read.schema("hash binary, doc long").parquet(*self.batches).select("doc", "hash")

    def drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def close(self) -> None:
        """Take the runs out of the session's catalogue."""
        self.drop([n for names in self.levels for n in names])
        self.levels = [[]]


def cut_points(pairs: DataFrame, batches: int) -> list[int]:
    """Documents after which a batch ends, so that batches have about equally many lines."""
    shares = [k / batches for k in range(1, batches)]
    cuts = pairs.agg(F.percentile_approx("doc", shares, 1000)).first()[0] if shares else None
    return sorted(set(cuts or []))


def owners(pairs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``doc, hash``: the smallest document of every line, found batch by batch."""
    runs, low = LineRuns(pairs.sparkSession, fanout), None
    try:
        for high in [*cut_points(pairs, batches), None]:
            after = F.lit(True) if low is None else F.col("doc") > low
            runs.add(pairs.where(after if high is None else after & (F.col("doc") <= high)))
            low = high
        return runs.owned()
    finally:
        runs.close()


def kept_lines(lines: Column, verdicts: Column) -> Column:
    """The short lines and those whose verdict is true, in order; verdicts are those of the long lines."""
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    short = F.filter(numbered, lambda c: ~is_long(c["line"]))
    long = F.filter(F.filter(numbered, lambda c: is_long(c["line"])), lambda c, j: F.get(verdicts, j)["keep"])
    return F.transform(F.sort_array(F.concat(short, long)), lambda c: c["line"])


def without_known_lines(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_text`` of ``docs(doc_id, text)``."""
    pairs = stored(line_hashes(docs), "line-hashes")
    own = owners(pairs, batches, fanout).withColumn("keep", F.lit(True))
    judged = pairs.join(own, ["doc", "hash"], "left").select("doc", "row", F.struct("nth", F.coalesce("keep", F.lit(False)).alias("keep")).alias("v"))
    verdicts = judged.groupBy("doc", "row").agg(F.sort_array(F.collect_set("v")).alias("verdicts"))
    out = keyed(docs).join(verdicts, ["doc", "row"], "left").withColumn("kept", kept_lines(F.col("lines"), F.col("verdicts")))
    n, left = F.size("lines").cast("long"), F.size("kept").cast("long")
    return out.select("doc_id", n.alias("n_lines"), (n - left).alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text"))


def line_digests(docs: DataFrame) -> DataFrame:
    """``without_known_lines`` with a digest for the text."""
    return without_known_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
