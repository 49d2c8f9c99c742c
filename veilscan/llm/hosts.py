"""Quality rules whose verdict is given by host.

Every document is measured by plain rules.  Failures of each rule are counted
by host; a host's rate of failures is shrunk towards the rate of all documents
by a beta prior, fitted for each rule to the counts of all hosts, so that a host
with few documents is not condemned for them; a host of which any shrunk rate is
too high is turned down, and that verdict goes to its documents.

The prior's strength comes from the variance between hosts in excess of what
chance gives hosts of their sizes.  Where nothing shows such an excess (every
host has one document, say), hosts are taken to be alike.

All of it is built-in column functions: measures are arrays within a row, so
nothing is exploded, and only counts by host are shuffled before the join.
Verdicts on hosts with more than one in ``SHARE`` of all documents, of which
there are fewer than ``SHARE``, are broadcast; the documents of other hosts are
joined by host, so no host of that join is hot.

Equal word triples are found by a 64-bit hash within one document.

Edge cases: a null or blank text has no words and fails; a document without
host is judged by its own rules alone; repeated rows count each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, whole_text

SPACES = r"[\x20\x09-\x0D]+"
NO_SPACE = r"[^\x20\x09-\x0D]"
NO_SYMBOL = r"[^#*$%&|<>]+"
#: A host is turned down when more than this share of its documents is thought to fail a rule.
HOST_LIMIT = 0.5
#: A host with more than one in so many documents is joined by broadcast.
SHARE = 10_000


def repeat_pairs(triples: Column) -> Column:
    """Start positions of triples found twice or more, from ``array<(hash, at)>`` in order of hash."""
    pairs = F.arrays_zip(triples.alias("one"), F.slice(triples, F.lit(2), F.greatest(F.size(triples), F.lit(1))).alias("two"))
    same = F.filter(pairs, lambda p: p["one"]["hash"] == p["two"]["hash"])
    return F.sort_array(F.array_distinct(F.flatten(F.transform(same, lambda p: F.array(p["one"]["at"], p["two"]["at"])))))


def covered(starts: Column, width: int) -> Column:
    """How many positions the windows of ``width`` from sorted ``starts`` cover."""
    begin = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(acc: Column, at: Column) -> Column:
        return F.struct((at + width).alias("end"), (acc["n"] + at + width - F.greatest(acc["end"], at)).alias("n"))

    return F.aggregate(starts, begin, add, lambda acc: acc["n"])


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, source`` and the measures of ``docs(doc_id, text, source)``."""
    df = docs.select("doc_id", "source", whole_text().alias("text"))
    df = df.withColumns(
        {
            "words": F.array_remove(F.split("text", SPACES), ""),
            "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(NO_SPACE)),
            "n_symbols": F.length(F.regexp_replace("text", NO_SYMBOL, "")).cast("long"),
        }
    ).drop("text")
    df = df.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_lines": F.size("lines").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "second": F.slice("words", F.lit(2), F.greatest(F.size("words"), F.lit(1))),
            "third": F.slice("words", F.lit(3), F.greatest(F.size("words"), F.lit(1))),
        }
    )
    threes = F.arrays_zip("words", "second", "third")
    numbered = F.transform(threes, lambda t, i: F.struct(F.xxhash64(t["words"], t["second"], t["third"]).alias("hash"), i.alias("at")))
    df = df.withColumn("triples", F.sort_array(F.slice(numbered, F.lit(1), F.greatest(F.size("words") - 2, F.lit(0)))))
    df = df.withColumn("repeats", repeat_pairs(F.col("triples")))
    repeated = covered(F.col("repeats"), 3).cast("long").alias("n_repeat_words")
    return df.select("doc_id", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", repeated)


def rules() -> dict[str, Column]:
    """The rules by name, each true for a document that fails it; the first two are the base ones."""
    n = F.col("n_words")
    return {
        "short": n < 50,
        "repeats": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "word_length": (F.col("word_chars") < 3 * n) | (F.col("word_chars") > 10 * n),
        "dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
    }


BASE = ("short", "repeats")


def priors(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """The mean rate of each rule, and how alike two documents of one host are in it: 0 not at all, 1 wholly.

    ``hosts`` has ``n`` and, by the name of a rule, how many of them fail it.
    With ``r`` for the likeness a beta prior weighs ``1 / r - 1`` documents.
    """
    size = F.col("n").cast("double")
    sums = [F.count(F.lit(1)).alias("k"), F.sum(size).alias("all"), F.sum(size * size).alias("squares")]
    for name in rules():
        sums += [F.sum(F.col(name).cast("double")).alias(name), F.sum(F.col(name) * F.col(name) / size).alias(f"{name}_pure")]
    row, found = hosts.agg(*sums).first(), {}
    for name in rules():
        if not row.k:
            found[name] = (0.0, 0.0)
            continue
        mean, pure = row[name] / row["all"], row[f"{name}_pure"]
        like = 0.0
        if 1 < row.k < row["all"]:
            # Analysis of variance: between hosts, and within them.
            between = (pure - row[name] * mean) / (row.k - 1)
            within = (row[name] - pure) / (row["all"] - row.k)
            typical = (row["all"] - row.squares / row["all"]) / (row.k - 1)
            total = between + (typical - 1) * within
            like = min(max((between - within) / total, 0.0), 1.0) if total > 0 else 0.0
        found[name] = (mean, like)
    return found


def host_rates(judged: DataFrame) -> DataFrame:
    """``source, n`` and the shrunk rate of each rule, of ``judged`` with ``source`` and the rules' verdicts."""
    hosts = judged.where("source IS NOT NULL").groupBy("source")
    hosts = hosts.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(name).cast("long")).alias(name) for name in rules()])
    shrunk = {}
    for name, (mean, like) in priors(hosts).items():
        weight = F.col("n") * like / (1 + (F.col("n") - 1) * like)
        shrunk[name] = mean + weight * (F.col(name) / F.col("n") - mean)
    return hosts.withColumns(shrunk)


def with_verdicts(judged: DataFrame, limit: float) -> DataFrame:
    """``judged`` with ``bad_host``: whether the document's host was turned down; false without a host."""
    bad = F.greatest(*[F.col(name) > limit for name in rules()])
    verdicts = stored(host_rates(judged).select("source", "n", bad.alias("bad_host")), "verdicts")
    total = verdicts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy = verdicts.where(F.col("n") * SHARE > total).select("source", "bad_host")
    rows = judged.join(F.broadcast(heavy), "source", "left")
    settled = F.col("bad_host").isNotNull() | F.col("source").isNull()
    light = verdicts.where((F.col("n") * SHARE <= total) & F.col("bad_host")).select("source", "bad_host")
    open_rows = rows.where(~settled).drop("bad_host").join(light, "source", "left")
    return rows.where(settled).unionByName(open_rows).withColumn("bad_host", F.coalesce("bad_host", F.lit(False)))


def judged_by_host(docs: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """The measures of every document with ``base_failed`` and ``kept``."""
    judged = stored(measured(docs).withColumns(rules()), "measures")
    base_failed = F.col(BASE[0]) | F.col(BASE[1])
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = with_verdicts(judged, limit)
    return out.select(*names, base_failed.alias("base_failed"), (~base_failed & ~F.col("bad_host")).alias("kept"))
