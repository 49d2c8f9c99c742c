"""Commit history as tables: diffs to added lines to commit findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hof import let
from ..functions.regexes import SPACE
from ..functions.text import split_lines
from ..options import ScanOptions
from ..rules import RuleSet
from ..session import checkpointed
from .detect import KIND_ENTROPY, KIND_RULE, scan_lines
from .joins import BROADCAST_ROWS, semi_join

MAX_JUMPS = 40
NOT_ADVANCING = r"^(?:-|\+\+\+|diff --git)"


def hunk_start(header: Column) -> Column:
    """The new-file line number of an ``@@`` line; 0 if it has none."""
    after_plus = F.get(F.split(header, r"\+", -1), F.lit(1))
    before_at = F.substring_index(after_plus, "@@", 1)
    first = F.trim(F.substring_index(F.trim(before_at), ",", 1))
    number = F.when(first.rlike("^-?[0-9]+$"), first.try_cast("int"))
    return F.coalesce(number, F.lit(0))


def added_lines(diffs: DataFrame, patch: str = "patch", places: bool = False) -> DataFrame:
    """Added lines with their new-file numbers; all other columns are kept.

    ``places`` adds where a line stands in the patch, as ``hunk`` and ``pos``.

    A patch is cut at its ``@@`` lines.  Within a piece every line that does
    not advance the counter is dropped, after which a line's number is the
    start plus its position: no running count and no shuffle.
    """
    keep = [c for c in diffs.columns if c != patch]
    hunks = diffs.select(
        *keep, F.posexplode_outer(F.split(F.col(patch), r"\n(?=@@)", -1)).alias("hunk", "body")
    )
    is_hunk = F.col("body").startswith("@@")
    own = let(
        split_lines(F.col("body")),
        lambda ls: F.when(is_hunk, F.slice(ls, F.lit(2), F.size(ls))).otherwise(ls),
    )
    advancing = F.filter(own, lambda s: ~s.rlike(NOT_ADVANCING))
    start = F.when(is_hunk, hunk_start(F.substring_index(F.col("body"), "\n", 1))).otherwise(0)
    numbered = hunks.select(
        *keep, "hunk", start.alias("start"), F.posexplode_outer(advancing).alias("pos", "text")
    )
    if places:
        keep = [*keep, "hunk", "pos"]
    return numbered.where(F.col("text").startswith("+")).select(
        *keep, (F.col("start") + F.col("pos")).alias("line"), F.expr("substring(text, 2)").alias("content")
    )


def effective_path() -> Column:
    return F.coalesce(F.nullif(F.col("b_path"), F.lit("")), F.col("a_path"))


def live_diffs(diffs: DataFrame) -> DataFrame:
    """Diffs of files that still exist, under their new path."""
    return diffs.where(~F.coalesce(F.col("deleted"), F.lit(False))).select(
        "sha", "diff_ord", effective_path().alias("path"), "patch"
    )


STRIP = rf"^[{SPACE}]+|[{SPACE}]+\z"


def commit_metadata(commits: DataFrame) -> DataFrame:
    """Short id, author, date and first message line."""
    return commits.select(
        "sha",
        F.substring("sha", 1, 8).alias("commit_sha"),
        F.concat("author_name", F.lit(" <"), "author_email", F.lit(">")).alias("commit_author"),
        F.timestamp_seconds("committed_at").alias("commit_date"),
        F.substring_index(F.regexp_replace("message", STRIP, ""), "\n", 1).alias("commit_message"),
    )


def commit_dedup(findings: DataFrame) -> DataFrame:
    """Drop an entropy finding if the commit has an earlier finding with the
    same line number and token, even in another file; rule findings all stay.

    Where there are ``hunk`` and ``pos``, they tell apart lines of equal number in one diff.  One
    aggregation does it.  Each finding competes for (commit, line, token) and
    the first in scan order wins; a rule finding also travels under a key of
    its own place, which no other finding has.  Equal tokens collapse before
    the shuffle, so a token repeated across a whole commit costs one row per
    task.
    """
    places = [c for c in ("hunk", "pos") if c in findings.columns]
    order = F.struct("diff_ord", *places, "kind", "rule_ord", "column")
    is_rule = F.col("kind") == KIND_RULE
    no_key = F.when(F.lit(False), order)
    copies = F.when(is_rule, F.array(order, no_key)).otherwise(F.array(no_key))
    payload = [c for c in findings.columns if c not in ("sha", "line", "token")]
    first = (
        findings.withColumn("own_key", F.explode(copies))
        .groupBy("sha", "line", "token", "own_key")
        .agg(F.min_by(F.struct(*payload), order).alias("f"))
    )
    kept = first.where(F.col("own_key").isNotNull() | (F.col("f.kind") == KIND_ENTROPY))
    return kept.select("sha", "line", "token", "f.*").select(findings.columns)


def scan_diffs(
    diffs: DataFrame, rules: RuleSet | None = None, opts: ScanOptions | None = None
) -> DataFrame:
    """Findings on the added lines of each diff, de-duplicated per commit."""
    found = scan_lines(added_lines(live_diffs(diffs), places=True), "content", rules, opts, dedup=False)
    return commit_dedup(found).drop("hunk", "pos")


def with_commits(findings: DataFrame, commits: DataFrame) -> DataFrame:
    """Attach the metadata after detection, when only findings are left."""
    return findings.join(commit_metadata(commits), "sha")


def newest_commits(commits: DataFrame, depth: int = 100) -> DataFrame:
    return commits.orderBy(F.col("committed_at").desc(), "sha").limit(depth)


def scan_history(
    diffs: DataFrame,
    commits: DataFrame,
    depth: int | None = None,
    branch: str | None = None,
    rules: RuleSet | None = None,
    opts: ScanOptions | None = None,
) -> DataFrame:
    """Scan the newest commits, of all or of those reachable from ``branch``."""
    opts = opts or ScanOptions()
    depth = opts.history_depth if depth is None else depth
    pool = commits
    if branch is not None:
        known_commits(commits, branch)
        pool = commits.join(ancestors(commits, {"tip": branch}).select("sha"), "sha", "left_semi")
    chosen = newest_commits(pool, depth)
    shas = chosen.select("sha")
    picked = (
        diffs.join(F.broadcast(shas), "sha", "left_semi")
        if depth <= BROADCAST_ROWS
        else diffs.join(shas, "sha", "left_semi")
    )
    return with_commits(scan_diffs(picked, rules, opts), chosen)


def ancestors(commits: DataFrame, tips: dict[str, str]) -> DataFrame:
    """``(label, sha)`` of every commit reachable from each labelled tip.

    A history is deep and narrow, so a walk of one parent per round would take
    as many rounds as the history is long.  Instead a table of first-parent
    jumps of 1, 2, 4, ... steps is built, and each round marks whole
    first-parent chains with it.  Only stepping over to the other parents of
    merges needs another round, so the rounds follow the nesting of branches.

    Every join is by shuffle, whatever its size: a broadcast goes through the
    driver, and some dozens of them, each as long as the history, add up.
    """
    spark = commits.sparkSession
    known = commits.select("sha", "parents")
    jump = checkpointed(
        known.select("sha", F.get("parents", F.lit(0)).alias("to")).where(F.col("to").isNotNull())
    )
    jumps = []
    while not jump.isEmpty():
        if len(jumps) > MAX_JUMPS:
            raise ValueError("the parent links form a cycle")
        jumps.append(jump)
        onward = jump.select(F.col("sha").alias("to"), F.col("to").alias("next"))
        jump = checkpointed(jump.join(onward.hint("merge"), "to").select("sha", F.col("next").alias("to")))
    others = known.where(F.size("parents") > 1).select(
        "sha", F.explode(F.expr("filter(parents, (x, i) -> i > 0)")).alias("to")
    )
    others = others.hint("merge")
    fresh = spark.createDataFrame(list(tips.items()), "label string, sha string")
    reached = fresh.limit(0)
    while True:
        for step in reversed(jumps):
            both = F.array_compact(F.array("sha", "to"))
            marked = fresh.join(step.hint("merge"), "sha", "left")
            fresh = marked.select("label", F.explode(both).alias("sha")).distinct()
        fresh = checkpointed(fresh.join(reached.hint("merge"), ["label", "sha"], "left_anti"))
        reached = checkpointed(reached.unionByName(fresh))
        fresh = checkpointed(
            fresh.join(others, "sha")
            .select("label", F.col("to").alias("sha"))
            .distinct()
            .join(reached.hint("merge"), ["label", "sha"], "left_anti")
        )
        if fresh.isEmpty():
            there = commits.select("sha").hint("merge")
            return reached.join(there, "sha", "left_semi").select("label", "sha")


def known_commits(commits: DataFrame, *names: str) -> None:
    """Raise if one of the names is no commit: scanning nothing, or everything, would look like an answer."""
    there = {r.sha for r in commits.where(F.col("sha").isin(list(names))).select("sha").distinct().collect()}
    if unknown := sorted(set(names) - there):
        raise ValueError(f"no such commit: {', '.join(unknown)}")


def commit_range(commits: DataFrame, start: str, end: str) -> DataFrame:
    """Commits reachable from ``end`` and not from ``start``; both must exist."""
    known_commits(commits, start, end)
    reach = ancestors(commits, {"start": start, "end": end})
    before = reach.where(F.col("label") == "start").select("sha")
    return reach.where(F.col("label") == "end").select("sha").join(before.hint("merge"), "sha", "left_anti")


def scan_range(
    diffs: DataFrame,
    commits: DataFrame,
    start: str,
    end: str,
    rules: RuleSet | None = None,
    opts: ScanOptions | None = None,
) -> DataFrame:
    shas = checkpointed(commit_range(commits, start, end))
    picked = semi_join(diffs, shas, "sha")
    return with_commits(scan_diffs(picked, rules, opts), semi_join(commits, shas, "sha"))


def commit_count(commits: DataFrame, branch: str) -> DataFrame:
    """One row: how many commits are reachable from ``branch``."""
    return ancestors(commits, {"tip": branch}).agg(F.count("*").alias("commits"))

