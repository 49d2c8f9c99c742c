"""One query per operator, over the given tables.

Names carry the inventory ids.  Results are flat and free of arrays, so they
can be compared value by value; nothing shows a secret that is not made up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import entropy as E
from ..functions import naming, paths, redact, report as show, text as T
from ..functions.hof import let
from ..operators import delta, detect, history, remediate, report
from ..options import ScanOptions
from ..rules import RuleSet
from ..session import checkpointed, scratch_path, spread
from ..sources import files, store
from ..streaming import incremental
from . import corpus

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r9(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 9)


PLACE = ["path", "line", "column", "rule"]
SHOWN = [*PLACE, "token", "snippet"]


def findings(spark: SparkSession, sf: str) -> DataFrame:
    return detect.scan_files(corpus.files(spark, sf))


def scanned_once(found: DataFrame) -> DataFrame:
    """What a migration plan needs of the findings, written once for all that read it; no token is kept."""
    return checkpointed(report.without_tokens(found).select(*remediate.PLAN_NEEDS))


def shown(found: DataFrame, *extra: str) -> DataFrame:
    return found.select(*SHOWN, *extra, r9("confidence").alias("confidence"))


def file_lines(spark: SparkSession, sf: str) -> DataFrame:
    return T.lines(corpus.files(spark, sf))


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    """All runs of at least the token length, with their place."""
    runs = F.lit(E.run_pattern(20))
    return (
        file_lines(spark, sf)
        .where(E.may_hold_token(F.col("content")))
        .select("path", "line", F.regexp_extract_all("content", runs, F.lit(0)).alias("runs"))
        .select("path", "line", F.posexplode_outer("runs").alias("nth", "token"))
    )


def refs(commits: DataFrame) -> tuple[str, str]:
    """A commit from the middle of the history and the newest one."""
    at = F.col("committed_at")
    ends = commits.agg(F.min(at).alias("first"), F.max(at).alias("last")).first()
    middle = ends["first"] + (ends["last"] - ends["first"]) // 7200 * 3600
    row = (
        commits.where(at.isin(middle, ends["last"]))
        .agg(F.min_by("sha", at).alias("start"), F.max_by("sha", at).alias("end"))
        .first()
    )
    return row["start"], row["end"]


# Sources and sinks


@query
def src1_scan_directory(spark, sf):
    """The files written as a tree and scanned as a directory."""
    root = scratch_path(spark, "tree")
    files.write_tree(corpus.file_contents(spark, sf), root)
    found = files.scan_directory(spark, root)
    return shown(found.withColumn("path", F.substr("path", F.lit(len(root) + 2))))


@query
def src2_scan_files(spark, sf):
    listed = table_paths(spark, sf)
    return shown(detect.scan_listed(corpus.files(spark, sf), listed))


def table_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Paths to scan: those of the labelled documents, and one without a file each."""
    labels = corpus.table(spark, sf, "labels", "doc_id")
    ids = labels.withColumn("tag", F.concat(F.lit("/d"), F.col("doc_id").cast("string"), F.lit("/")))
    own = corpus.files(spark, sf).select(
        "path", F.concat(F.lit("/"), F.split_part("path", F.lit("/"), F.lit(3)), F.lit("/")).alias("tag")
    )
    gone = ids.select(F.concat(F.lit("gone"), "tag").alias("path"))
    return own.join(ids, "tag", "left_semi").select("path").union(gone)


@query
def src3_scan_file(spark, sf):
    return shown(detect.scan_files(corpus.files(spark, sf), walk=False), "kind")


@query
def src4_scan_text(spark, sf):
    found = detect.scan_text(corpus.files(spark, sf), start_line=100)
    return found.select("path", "line", "rule", "token", "start", "end")


@query
def src5_scan_history(spark, sf):
    found = history.scan_history(corpus.diffs(spark, sf), corpus.commits(spark, sf), depth=25)
    return commit_view(found)


def utc_text(c: str) -> Column:
    """A time as UTC text, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd HH:mm:ss")


def commit_view(found: DataFrame) -> DataFrame:
    return found.select(
        "commit_sha",
        "path",
        "line",
        "column",
        "rule",
        "snippet",
        "commit_author",
        utc_text("commit_date").alias("commit_date"),
        "commit_message",
    )


@query
def src6_scan_range(spark, sf):
    commits = corpus.commits(spark, sf)
    start, end = refs(commits)
    return commit_view(history.scan_range(corpus.diffs(spark, sf), commits, start, end))


@query
def src7_commit_count(spark, sf):
    commits = corpus.commits(spark, sf)
    return history.commit_count(commits, refs(commits)[1])


@query
def src8_added_lines(spark, sf):
    return history.added_lines(corpus.diffs(spark, sf).select("sha", "diff_ord", "patch"))


@query
def src9_commit_metadata(spark, sf):
    out = history.commit_metadata(corpus.commits(spark, sf))
    return out.withColumn("commit_date", utc_text("commit_date"))


@query
def src10_load_findings(spark, sf):
    path = scratch_path(spark, "findings")
    empty = store.load_findings(spark, path)
    store.save_findings(report.at_least(findings(spark, sf)), path)
    return store.load_findings(spark, path).union(empty).select(*PLACE, "snippet", r9("confidence").alias("confidence"))


@query
def snk1_save_findings(spark, sf):
    """Two saves: the second replaces the first."""
    path = scratch_path(spark, "findings")
    found = checkpointed(report.stored_form(findings(spark, sf)))
    store.save_findings(found, path, "json")
    store.save_findings(report.at_least(found, 0.9), path, "json")
    return store.load_findings(spark, path, "json").select(*PLACE, "snippet", r9("confidence").alias("confidence"))


@query
def snk2_append_log(spark, sf):
    path = scratch_path(spark, "log")
    rows = overrides(spark, sf)
    store.append_log(rows.where("findings_bypassed < 5"), path, store.OVERRIDE_SCHEMA)
    store.append_log(rows.where("findings_bypassed >= 5"), path, store.OVERRIDE_SCHEMA)
    return store.load_log(spark, path, store.OVERRIDE_SCHEMA).select("reason", "findings_bypassed", "user")


def overrides(spark: SparkSession, sf: str) -> DataFrame:
    """Events in the role of bypass records."""
    return corpus.table(spark, sf, "events", "ts", "event_type", "value", "user_id").selectExpr(
        "cast(ts as timestamp) AS ts",
        "event_type AS reason",
        "cast(floor(value) as int) AS findings_bypassed",
        "cast(user_id as string) AS user",
    )


@query
def snk3_migration_log(spark, sf):
    path = scratch_path(spark, "migrations")
    found = scanned_once(report.at_least(findings(spark, sf), 0.95))
    store.log_migrations(remediate.migration_plan(found), path, "2024-01-02 00:00:00")
    store.log_migrations(remediate.migration_plan(found), path, "2024-03-04 00:00:00")
    out = store.log_stamps(store.migration_log(spark, path))
    for c in ("created_at", "last_updated"):
        out = out.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return out


@query
def snk4_override_log(spark, sf):
    path = scratch_path(spark, "overrides")
    store.log_overrides(overrides(spark, sf), path)
    out = store.overrides_by_user(store.override_log(spark, path))
    return out.select("user", "overrides", "findings_bypassed")


# Filters and projections


@query
def flt1_exclude_paths(spark, sf):
    files = corpus.files(spark, sf).select("path")
    p, globs = F.col("path"), ScanOptions().exclude_patterns
    return files.select(
        "path",
        paths.exclude_exact(p).alias("exact"),
        paths.exclude_walk(p, globs).alias("walk"),
        paths.exclude_exact(p, ["src1", "*.md"]).alias("custom"),
        paths.exclude_exact(p, []).alias("empty_list"),
    )


@query
def flt2_is_binary(spark, sf):
    """Every text as it is, with a NUL, with many control characters, and null."""
    docs = spread(corpus.table(spark, sf, "documents", "doc_id", "text"))
    text = F.col("text")
    noise = F.concat(text, F.repeat(F.lit("\x01"), F.least(F.length(text), F.lit(3000))))
    return docs.select(
        "doc_id",
        T.is_binary_text(text).alias("plain"),
        T.is_binary_text(F.concat(text, F.lit("\x00"))).alias("with_nul"),
        T.is_binary_text(noise).alias("with_noise"),
        T.is_binary_text(F.nullif(text, text)).alias("unreadable"),
    )


@query
def flt3_confidence_filter(spark, sf):
    return shown(report.at_least(findings(spark, sf)))


@query
def flt4_fixable(spark, sf):
    return report.fixable(findings(spark, sf)).select(*PLACE)


@query
def flt5_entropy_length_gate(spark, sf):
    """Token runs of all lengths, with pairs joined so that some are too long."""
    found = tokens(spark, sf)
    long = F.concat("token", F.repeat("token", F.lit(4)))
    return found.select(
        "path",
        "line",
        "nth",
        E.length_ok(F.col("token")).alias("ok"),
        E.length_ok(long).alias("long_ok"),
        E.length_ok(F.col("token"), 30, 44).alias("narrow_ok"),
    )


@query
def flt6_entropy_allowlist(spark, sf):
    token = F.col("token")
    return tokens(spark, sf).select(
        "path",
        "line",
        "nth",
        E.is_allowlisted(token).alias("as_found"),
        E.is_allowlisted(F.concat(token, F.lit("EXAMPLETOKEN123456789"))).alias("marked"),
        E.is_allowlisted(token, ["ab", "blob"]).alias("extended"),
    )


@query
def flt7_secret_exposed(spark, sf):
    out = file_lines(spark, sf)
    return out.where(T.secret_exposed(F.col("content"))).select("path", "line")


@query
def flt8_staged_skip(spark, sf):
    return report.staged(corpus.files(spark, sf)).select("path")


@query
def flt9_deleted_skip(spark, sf):
    return history.live_diffs(corpus.diffs(spark, sf)).select("sha", "diff_ord", "path")


@query
def prj1_to_dict(spark, sf):
    stored = report.stored_form(findings(spark, sf)).drop("found_at")
    return stored.withColumn("confidence", r9("confidence"))


@query
def prj2_confidence_band(spark, sf):
    return findings(spark, sf).select(*PLACE, show.confidence_band(F.col("confidence")).alias("band"))


@query
def prj3_confidence_level(spark, sf):
    c = F.col("confidence")
    return findings(spark, sf).select(
        *PLACE, show.confidence_level(c).alias("level"), show.confidence_text(c).alias("shown")
    )


@query
def prj4_file_warning(spark, sf):
    files = corpus.files(spark, sf).select("path")
    return files.select("path", paths.file_warning(F.col("path")).alias("warning"))


# Detectors


@query
def det1_pattern_scan(spark, sf):
    found = detect.scan_patterns(file_lines(spark, sf))
    return found.select("path", "line", "rule", "token", "start", "end", "confidence")


@query
def det1_natural_text(spark, sf):
    """The rule detector on documents, pages and conversations as they are."""
    docs = spread(corpus.table(spark, sf, "documents", "doc_id", "text"))
    talk = spread(corpus.table(spark, sf, "conversations", "conv_id", "turn", "text"))
    web = spread(corpus.table(spark, sf, "pages", "page_id", "html"))
    all_texts = (
        docs.selectExpr("concat('doc', cast(doc_id as string)) AS path", "text")
        .union(talk.selectExpr("concat('talk', cast(conv_id as string), '.', cast(turn as string))", "text"))
        .union(web.selectExpr("concat('page', cast(page_id as string))", "html"))
    )
    return detect.scan_text(all_texts).select("path", "line", "rule", "token", "start", "end")


@query
def det2_entropy_scan(spark, sf):
    found = detect.scan_entropy(file_lines(spark, sf))
    return found.select(
        "path", "line", "token", "start", "end", r9("entropy").alias("entropy"), r9("confidence").alias("confidence")
    )


@query
def det3_filename_scan(spark, sf):
    files = corpus.files(spark, sf).select("path", paths.filename_finding(F.col("path")).alias("f"))
    return files.where("f IS NOT NULL").select("path", "f.rule", "f.confidence", "f.reason")


@query
def det4_combined_scan(spark, sf):
    return shown(findings(spark, sf), "kind", "end")


USER_RULES = [
    ("FIRST_OF_LINE", r'^K = "([0-9A-Za-z]{20})'),
    ("WHOLE_LINE", r"^blob ([0-9A-Za-z+/=]+) [0-9A-Za-z+/=]{10,}$"),
]


@query
def det4_user_rules(spark, sf):
    """User rules whose expressions look at the ends of a line."""
    rules = RuleSet.default()
    for name, pattern in USER_RULES:
        rules = rules.with_rule(name, pattern, 0.8, "Remove it.")
    found = detect.scan_files(corpus.files(spark, sf), rules)
    return found.where(F.col("rule").isin([n for n, _ in USER_RULES])).select("path", "line", "column", "rule", "token")


@query
def det4_web_pages(spark, sf):
    """The combined scan over raw web pages under their addresses."""
    return shown(detect.scan_files(corpus.pages(spark, sf)))


@query
def det5_commit_scan(spark, sf):
    found = history.scan_diffs(corpus.diffs(spark, sf))
    return found.select("sha", "diff_ord", "path", "line", "column", "rule", "token", "snippet")


@query
def det6_rule_info(spark, sf):
    """The catalogue beside what it found: rules without findings show 0."""
    counted = report.by_rule(detect.scan_patterns(file_lines(spark, sf)))
    rules = RuleSet.default().to_df(spark)
    return (
        rules.join(counted, "rule", "left")
        .select(
            "rule_ord", "rule", "pattern", "group_idx", "confidence", F.coalesce("findings", F.lit(0)).alias("findings")
        )
    )


# Joins


@query
def jon1_rule_enrich(spark, sf):
    """Bare matches get confidence and position from the catalogue by a join."""
    bare = detect.scan_patterns(file_lines(spark, sf)).select("path", "line", "start", "rule")
    rules = RuleSet.default().to_df(spark).select("rule", "rule_ord", "confidence")
    return bare.join(F.broadcast(rules), "rule", "left")


@query
def jon2_entropy_anti_pattern(spark, sf):
    """Entropy matches without a rule match of the same line and token."""
    rows = file_lines(spark, sf)
    found = detect.scan_entropy(rows).select("path", "line", "token", "start")
    rules = detect.scan_patterns(rows).select("path", "line", "token")
    return found.join(rules, ["path", "line", "token"], "left_anti")


def rewritten(spark: SparkSession, sf: str) -> DataFrame:
    return remediate.rewrite_files(corpus.files(spark, sf), plan(spark, sf))


def plan(spark: SparkSession, sf: str) -> DataFrame:
    """A variable for every finding in a text."""
    return remediate.migration_plan(findings(spark, sf))


@query
def jon3_plan_apply(spark, sf):
    out = rewritten(spark, sf)
    return out.select("path", F.size("results").alias("migrations"), F.length("text_before").alias("chars"))


def available(names: DataFrame) -> DataFrame:
    """Which variables are set: a made-up environment for the planned names."""
    h = F.sha2("name", 256)
    first = F.substring(h, 1, 1)
    value = F.when(first.isin("0", "1", "2"), "").when(first.isin("3", "4"), F.substring(h, 1, 6)).otherwise(h)
    return names.where(first != "f").select("name", value.alias("value"))


def required(spark: SparkSession, sf: str) -> DataFrame:
    return plan(spark, sf).select(F.col("env_var_name").alias("name")).distinct()


@query
def jon4_env_check(spark, sf):
    names = required(spark, sf)
    return report.env_check(names, available(names))


@query
def jon5_rescan_delta(spark, sf):
    before = findings(spark, sf)
    after = detect.scan_files(fixed_files(spark, sf))
    return delta.rescan_delta(before, after)


def fixed_files(spark: SparkSession, sf: str) -> DataFrame:
    """The files after someone removed and added secrets by hand."""
    text = F.regexp_replace("text", "AKIA", "none")
    return corpus.files(spark, sf).select("path", F.replace(text, F.lit("blob "), F.lit("blobs ")).alias("text"))


# Aggregations


def flat_map(m: str) -> Column:
    """A map as text, sorted by key."""
    entries = F.array_sort(F.map_entries(m))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")


@query
def agg1_summary(spark, sf):
    return report.summary(findings(spark, sf)).select(
        "total", flat_map("by_rule").alias("by_rule"), "by_confidence.*", "files_affected"
    )


@query
def agg1_summary_empty(spark, sf):
    none = report.at_least(findings(spark, sf), 1.5)
    return report.summary(none).select(
        "total", flat_map("by_rule").alias("by_rule"), "by_confidence.*", "files_affected"
    )


@query
def agg2_by_rule(spark, sf):
    return report.by_rule(findings(spark, sf))


@query
def agg3_stats(spark, sf):
    """Over a store with gaps: some rows have no confidence, some no file."""
    gaps = findings(spark, sf).select(
        F.when(F.col("line") > 5, F.col("path")).alias("path"),
        F.when(F.col("column") < 10, F.col("confidence")).alias("confidence"),
    )
    return report.stats(gaps).select("total", "by_confidence.*", "files_affected")


@query
def agg4_group_by_file(spark, sf):
    return report.by_file(findings(spark, sf)).withColumn("max_confidence", r9("max_confidence"))


@query
def agg4_listed_by_file(spark, sf):
    """The findings of each file in order, in chunks of three."""
    shown = F.transform("entries", lambda e: F.format_string("%d:%d %s %s", e["line"], e["column"], e["rule"], e["snippet"]))
    return report.listed_by_file(findings(spark, sf), 3).select("path", "chunk", F.array_join(shown, "\n").alias("listing"))


@query
def agg5_fix_summary(spark, sf):
    found = scanned_once(findings(spark, sf))
    return report.fix_summary(remediate.migration_plan(found), found.where("confidence < 0.55"))


@query
def agg6_verify_summary(spark, sf):
    names = required(spark, sf)
    return report.verify_summary(report.env_check(names, available(names)))


@query
def agg6_missing_names(spark, sf):
    """The names that are not set, sorted, in chunks of ten."""
    names = required(spark, sf)
    missing = report.missing_names(report.env_check(names, available(names)), 10)
    return missing.select("chunk", F.array_join("names", " ").alias("names"))


@query
def agg7_refactor_summary(spark, sf):
    return report.refactor_summary(remediate.rewrite_results(one_each(spark, sf)))


@query
def agg8_gate(spark, sf):
    return gate_view(incremental.gate_files(changes(spark, sf)))


def changes(spark: SparkSession, sf: str) -> DataFrame:
    """Files with the change they belong to: the first two path parts."""
    return corpus.files(spark, sf).withColumn("change_id", F.substring_index("path", "/", 2))


def gate_view(v: DataFrame) -> DataFrame:
    return v.select("change_id", "findings", r9("max_confidence").alias("max_confidence"), "blocked")


@query
def agg9_exit_status(spark, sf):
    return report.exit_status(report.at_least(findings(spark, sf), 0.97))


@query
def agg10_char_histogram(spark, sf):
    counted = tokens(spark, sf).select("token").distinct()
    return counted.select("token", F.inline(E.char_histogram(F.col("token"))))


# Windows, de-duplication, order


@query
def win1_env_ordinal(spark, sf):
    out = remediate.env_ordinals(report.fixable(findings(spark, sf)).drop("token", "entropy"))
    return out.select(*PLACE, "ordinal")


@query
def win2_diff_line_no(spark, sf):
    """The numbers alone, for every added line of every diff."""
    added = history.added_lines(corpus.diffs(spark, sf).select("sha", "diff_ord", "patch"))
    return added.groupBy("sha", "diff_ord").agg(
        F.count("*").alias("added"), F.min("line").alias("first"), F.max("line").alias("last"), F.sum("line").alias("total")
    )


@query
def ded1_file_dedup(spark, sf):
    found = detect.scan_lines(file_lines(spark, sf))
    return found.select("path", "line", "column", "rule", "token")


@query
def ded2_commit_dedup(spark, sf):
    found = history.scan_diffs(corpus.diffs(spark, sf)).where("kind = 2")
    return found.select("sha", "diff_ord", "line", "column", "token")


@query
def srt1_report_order(spark, sf):
    return report.report_order(findings(spark, sf)).select(*PLACE, "snippet", r9("confidence").alias("confidence"))


@query
def srt2_env_order(spark, sf):
    return required(spark, sf).orderBy("name")


@query
def lim1_newest_commits(spark, sf):
    return history.newest_commits(corpus.commits(spark, sf), 25).select("sha", "committed_at")


@query
def top1_longest_literal(spark, sf):
    """The longest word of each line, the first of equals."""
    words = F.split("content", " ", -1)
    return file_lines(spark, sf).select("path", "line", remediate.longest(words).alias("longest"))


# Set operations


@query
def set1_union_detectors(spark, sf):
    """The three detectors' findings as one table, before any de-duplication."""
    files = corpus.files(spark, sf)
    rows = T.lines(files)
    names = files.select("path", paths.filename_finding(F.col("path")).alias("f")).where("f IS NOT NULL")
    return (
        names.select("path", F.lit(0).alias("line"), F.lit(0).alias("start"), "f.rule")
        .unionByName(detect.scan_patterns(rows).select("path", "line", "start", "rule"))
        .unionByName(detect.scan_entropy(rows).select("path", "line", "start", "rule"))
    )


@query
def set2_env_union(spark, sf):
    high = report.at_least(findings(spark, sf), 0.9)
    log = remediate.migration_plan(high)
    return report.env_union(plan(spark, sf), log)


@query
def set3_commit_range(spark, sf):
    commits = corpus.commits(spark, sf)
    return history.commit_range(commits, *refs(commits))


# Scalar functions


@query
def sca1_shannon_entropy(spark, sf):
    return tokens(spark, sf).select(
        "path", "line", "nth", r9(E.shannon_entropy(F.col("token"))).alias("entropy")
    )


@query
def sca2_is_high_entropy(spark, sf):
    """Every word of every line, most of them too short to be scored."""
    words = file_lines(spark, sf).select("path", "line", F.explode(F.split("content", " ", -1)).alias("word"))
    scored = words.select("path", "line", "word", E.is_high_entropy(F.col("word"), 3.0, 12).alias("s"))
    return scored.groupBy("path").agg(
        F.count("*").alias("words"), F.count_if("s.flag").alias("high"), F.round(F.sum("s.entropy"), 6).alias("total")
    )


@query
def sca3_entropy_confidence(spark, sf):
    h = E.shannon_entropy(F.col("token"))
    return tokens(spark, sf).select(
        "path",
        "line",
        "nth",
        r9(E.entropy_confidence(h)).alias("confidence"),
        r9(E.entropy_confidence(h * 2)).alias("capped"),
    )


@query
def sca4_extract_tokens(spark, sf):
    found = E.extract_tokens(F.col("content"), 3.5, 12, 60)
    return (
        file_lines(spark, sf)
        .where(E.may_hold_token(F.col("content"), 12))
        .select("path", "line", F.inline_outer(let(F.col("content"), lambda c: E.extract_tokens(c, 3.5, 12, 60))))
        .where("token IS NOT NULL")
        .withColumn("entropy", r9("entropy"))
    )


def words(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct words of the corpus: short, long, and not only ASCII."""
    split = F.explode(F.split("content", " ", -1)).alias("word")
    return file_lines(spark, sf).select(split).distinct()


@query
def sca5_redact_secret(spark, sf):
    w = F.col("word")
    return words(spark, sf).select(
        "word", redact.redact_secret(w).alias("masked"), redact.redact_secret(w, 2).alias("masked2")
    )


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """Every line with a span that depends on it, some of them impossible."""
    size = F.length("content")
    start = F.floor(size / 3).cast("int")
    end = F.when(size % 7 == 0, size + 5).when(size % 7 == 1, start).otherwise(start + F.floor(size / 4).cast("int"))
    return file_lines(spark, sf).select("path", "line", "content", start.alias("s"), end.alias("e"))


@query
def sca6_redact_line(spark, sf):
    out = redact.redact_line(F.col("content"), F.col("s"), F.col("e"))
    return spans(spark, sf).select("path", "line", out.alias("redacted"))


@query
def sca7_create_snippet(spark, sf):
    out = redact.create_snippet(F.col("content"), F.col("s"), F.col("e"), 10)
    return spans(spark, sf).select("path", "line", out.alias("snippet"))


@query
def sca8_redact_snippet(spark, sf):
    c, s, e = F.col("content"), F.col("s"), F.col("e")
    return spans(spark, sf).select(
        "path",
        "line",
        redact.redact_snippet(c, s, e).alias("near"),
        redact.redact_snippet(c, s, e, 30, 2).alias("wide"),
    )


@query
def sca9_mask_value(spark, sf):
    w = F.col("word")
    return words(spark, sf).select(
        "word", redact.mask_value(w).alias("masked"), redact.mask_value(w, "#", 0.5).alias("half")
    )


@query
def sca10_env_preview(spark, sf):
    return words(spark, sf).select("word", redact.env_preview(F.col("word")).alias("preview"))


@query
def sca11_env_var_name(spark, sf):
    """For every finding's rule, at ordinals from its line, and for event names."""
    found = findings(spark, sf).select("rule", (F.col("line") % 5).cast("int").alias("n"))
    kinds = corpus.table(spark, sf, "events", "event_type").select(
        F.concat("event_type", F.lit("-url x")).alias("rule"), F.lit(0).alias("n")
    )
    out = naming.env_var_name(F.col("rule"), F.col("n"))
    return found.union(kinds).distinct().select("rule", "n", out.alias("name"))


@query
def sca12_extract_literal(spark, sf):
    out = remediate.extract_literal(F.col("content"))
    return file_lines(spark, sf).select("path", "line", out.alias("literal")).where("literal IS NOT NULL")


@query
def sca13_file_kind(spark, sf):
    files = corpus.files(spark, sf).select("path")
    return files.select("path", paths.file_kind(F.col("path")).alias("kind"))


@query
def sca14_is_placeholder(spark, sf):
    """Words, masked words and the fixed stand-ins."""
    w = words(spark, sf)
    masked = w.select(redact.redact_secret(F.col("word")).alias("word"))
    fixed = w.select(F.when(F.length("word") % 2 == 0, remediate.ASK).otherwise(remediate.MASKED).alias("word"))
    every = w.union(masked).union(fixed).distinct()
    return every.select("word", remediate.is_placeholder(F.col("word")).alias("placeholder"))


@query
def sca15_default_snippet(spark, sf):
    """Each finding's snippet, withheld on even lines."""
    given = F.when(F.col("line") % 2 == 1, F.col("snippet"))
    out = redact.default_snippet(F.col("token"), given)
    return findings(spark, sf).select(*PLACE, out.alias("snippet"))


@query
def sca16_remediation_text(spark, sf):
    return findings(spark, sf).select(*PLACE, "remediation")


# Remediation


@query
def rem1_migration_plan(spark, sf):
    out = plan(spark, sf)
    return out.select("path", "line", "rule", "env_var_name", "value_redacted", "value_full", r9("confidence").alias("confidence"))


@query
def rem2_instructions(spark, sf):
    return remediate.instructions(plan(spark, sf))


def edited_instructions(spark: SparkSession, sf: str) -> DataFrame:
    """The printed plan after someone filled in values, cut places and names, and repeated blocks."""
    line, text = F.col("line"), F.col("instruction")
    valued = F.when(line % 3 == 1, F.concat(text, F.lit("\n   value given: "), line.cast("string"))).otherwise(text)
    unplaced = F.when(line % 11 == 2, F.regexp_replace(valued, r"\n +at [^\n]*", "")).otherwise(valued)
    unnamed = F.when(line % 13 == 4, F.substring_index(unplaced, "\n", -2)).otherwise(unplaced)
    blocks = remediate.instructions(plan(spark, sf)).select(line, unnamed.alias("instruction"))
    return blocks.union(blocks.where("line % 7 = 3"))


@query
def rem3_parse_instructions(spark, sf):
    """The printed plan read back: names, places, values, and what is wrong with a block."""
    return remediate.parsed_instructions(edited_instructions(spark, sf))


def known_secret(spark: SparkSession, sf: str) -> DataFrame:
    """Each file with the value of its ``K = "..."`` line."""
    value = F.regexp_extract("text", 'K = "([0-9A-Za-z]+)"', 1)
    return corpus.files(spark, sf).select("path", "text", value.alias("value"))


@query
def rem4_rewrite_python(spark, sf):
    out = remediate.rewrite_python(F.col("text"), F.col("value"), F.lit("APP_KEY"))
    return known_secret(spark, sf).where(paths.file_kind(F.col("path")) == "python").select("path", out.alias("text"))


@query
def rem5_rewrite_js(spark, sf):
    out = remediate.rewrite_js(F.col("text"), F.col("value"), F.lit("APP_KEY"))
    return known_secret(spark, sf).select("path", out.alias("text"))


@query
def rem6_rewrite_generic(spark, sf):
    out = remediate.rewrite_generic(F.col("text"), F.col("value"), F.lit("APP_KEY"))
    return known_secret(spark, sf).select("path", out.alias("text"))


def one_each(spark: SparkSession, sf: str) -> DataFrame:
    """One migration per file: its value known, masked, asked for, or absent."""
    files = known_secret(spark, sf)
    line = F.size(F.split(F.substring_index("text", 'K = "', 1), "\n", -1))
    size = F.length("text")
    value = (
        F.when(size % 5 == 4, "not in this file")
        .when(size % 3 == 0, remediate.ASK)
        .when(size % 3 == 1, "***")
        .otherwise(F.col("value"))
    )
    todo = files.select(
        "path",
        line.alias("line"),
        F.lit("APP_KEY").alias("env_var_name"),
        value.alias("value_full"),
        *[F.lit(0).alias(c) for c in ("kind", "rule_ord", "column")],
    )
    return remediate.rewrite_files(files, todo)


@query
def rem7_rewrite_file(spark, sf):
    first = F.col("results")[0]
    return one_each(spark, sf).select("path", "text_after", first["success"].alias("success"), first["error"].alias("error"))


def rewritten_many(spark: SparkSession, sf: str) -> DataFrame:
    files, todo = corpus.many(spark, sf)
    return remediate.rewrite_files(files, todo.withColumns({c: F.lit(0) for c in ("kind", "rule_ord", "column")}))


@query
def rem8_rewrite_many(spark, sf):
    """Files of 1 to 2,000 values: the new text, how many were replaced, and what became of each value."""
    told = F.transform("results", lambda r: F.concat(r["env_var_name"], F.lit(": "), F.coalesce(r["error"], F.lit("ok"))))
    replaced = F.size(F.filter("results", lambda r: r["success"])).cast("long")
    return rewritten_many(spark, sf).select("path", "text_after", replaced.alias("replaced"), F.array_join(told, "; ").alias("outcomes"))


@query
def rem9_joined_lines(spark, sf):
    """Lines that differ where values span lines: joined lines have no ``after``."""
    return remediate.changed_lines(rewritten_many(spark, sf))


@query
def rem9_changed_lines(spark, sf):
    files = known_secret(spark, sf)
    todo = files.select(
        "path",
        F.lit(1).alias("line"),
        F.lit("APP_KEY").alias("env_var_name"),
        F.col("value").alias("value_full"),
        *[F.lit(0).alias(c) for c in ("kind", "rule_ord", "column")],
    )
    return remediate.changed_lines(remediate.rewrite_files(files, todo))


# Streaming


@query
def str1_incremental_scan(spark, sf):
    """Scan what changed since the index was taken."""
    seen = delta.file_index(corpus.files(spark, sf))
    return shown(detect.scan_files(delta.changed_files(edited_files(spark, sf), seen)))


def edited_files(spark: SparkSession, sf: str) -> DataFrame:
    """The files after an edit that touches those with a given word."""
    text = F.col("text")
    edited = F.when(text.contains("AKIA"), F.concat(text, F.lit("\n# edited"))).otherwise(text)
    return corpus.files(spark, sf).select("path", edited.alias("text"))


@query
def str2_stream_gate(spark, sf):
    """The gate over a stream of files, a change per source."""
    stream = corpus.documents_stream(spark, sf)
    arriving = spark.sql(corpus.files_sql("{documents}", corpus.SPARK), documents=stream).select(
        F.substring_index("path", "/", 2).alias("change_id"), "path", "text"
    )
    out = scratch_path(spark, "verdicts")
    incremental.write_verdicts(arriving, out, scratch_path(spark, "progress")).awaitTermination()
    return gate_view(incremental.verdicts(spark, out))
