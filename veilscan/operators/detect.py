"""The detectors as row-local plans: files to lines to findings, no shuffle."""

from __future__ import annotations

from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.entropy import (
    entropy_advice,
    entropy_confidence,
    extract_tokens,
    may_hold_token,
)
from ..functions.hof import let, match_spans
from ..functions.paths import exclude_exact, exclude_walk, filename_finding, suspicious_name
from ..functions.redact import hit_snippet, line_chunks, mask_spans, masked_snippet
from ..functions.text import is_binary_text, lines, split_lines
from ..options import ScanOptions
from ..rules import ENTROPY_RULE, LINE_RUN, RuleSet
from .joins import semi_join

CONTEXT = 30
KIND_NAME, KIND_RULE, KIND_ENTROPY = 0, 1, 2


def pattern_hits(line: Column, rules: RuleSet) -> Column:
    """``array<struct<kind, rule_ord, token, start, end, entropy>>`` of all rules.

    Which rules match is tested with literal expressions, compiled once per
    task.  Offsets and groups are worked out only for the rules that matched;
    their expressions are looked up by position and compiled when the rule
    changes from one hit to the next.
    """

    def of_rule(i: Column) -> Column:
        pattern = rules.lookup(i, "java_find")
        found = F.zip_with(
            match_spans(line, pattern),
            F.regexp_extract_all(line, pattern, rules.lookup(i, "group")),
            lambda m, token: F.struct(
                F.lit(KIND_RULE).alias("kind"),
                i.alias("rule_ord"),
                token.alias("token"),
                m["start"].alias("start"),
                m["end"].alias("end"),
                F.lit(None).cast("double").alias("entropy"),
                m["text"].alias("text"),
            ),
        )
        kept = F.filter(found, lambda m: rules.confirmed(i, m["text"]))
        return F.transform(kept, lambda m: m.dropFields("text"))

    return F.flatten(F.transform(rules.matching(line), of_rule))


def entropy_hits(line: Column, opts: ScanOptions, rule_ord: int = 0) -> Column:
    tokens = extract_tokens(
        line, opts.entropy_threshold, opts.min_token_length, harmless=opts.harmless
    )
    return F.transform(
        tokens,
        lambda t: F.struct(
            F.lit(KIND_ENTROPY).alias("kind"),
            F.lit(rule_ord).alias("rule_ord"),
            t["token"].alias("token"),
            t["start"].alias("start"),
            t["end"].alias("end"),
            t["entropy"].alias("entropy"),
        ),
    )


def first_of_token(hits: Column) -> Column:
    """Drop an entropy hit whose token an earlier hit of the line has.

    Sorting by token brings equal tokens together, so one look at the
    neighbour decides; rule hits always stay.
    """
    keyed = F.array_sort(
        F.transform(
            hits,
            lambda h, i: F.struct(h["token"].alias("token"), i.alias("i"), h["kind"].alias("kind")),
        )
    )
    kept = let(
        keyed,
        lambda ks: F.filter(
            ks,
            lambda k, j: (k["kind"] == KIND_RULE)
            | (j == 0)
            | (F.get(ks, j - 1)["token"] != k["token"]),
        ),
    )
    order = F.array_sort(F.transform(kept, lambda k: k["i"]))
    return F.transform(order, lambda i: F.get(hits, i))


def with_snippets(line: Column, hits: Column, opts: ScanOptions) -> Column:
    """Add two snippets to each hit: ``snippet`` masks the hit alone (or every
    span, by option), ``masked_snippet``, the one to be stored, every span."""
    spans = F.array_sort(F.transform(hits, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"))))

    def add(chunks: Column, masked: Column, size: Column) -> Column:
        def fields(h: Column) -> Column:
            place = (size, h["start"], h["end"], CONTEXT)
            return F.struct(
                h["kind"].alias("kind"),
                h["rule_ord"].alias("rule_ord"),
                h["token"].alias("token"),
                h["start"].alias("start"),
                h["end"].alias("end"),
                h["entropy"].alias("entropy"),
                hit_snippet(masked if opts.redact_all_spans else chunks, *place).alias("snippet"),
                masked_snippet(chunks, masked, *place).alias("masked_snippet"),
            )

        return F.transform(hits, fields)

    def with_masked(chunks: Column, size: Column) -> Column:
        return let(line_chunks(mask_spans(chunks, size, spans)), lambda masked: add(chunks, masked, size))

    return let(F.length(line), lambda size: let(line_chunks(line), lambda chunks: with_masked(chunks, size)))


def line_hits(
    column: str, rules: RuleSet, opts: ScanOptions, dedup: bool = True
) -> Column:
    """Rule hits, then entropy hits, of one line, with snippets.

    The expression depends on its arguments alone and has some thousand
    nodes, so it is kept for the next query of the session.
    """
    return _line_hits(SparkContext._active_spark_context, column, rules, opts, dedup)


@lru_cache(maxsize=16)
def _line_hits(
    context: SparkContext, column: str, rules: RuleSet, opts: ScanOptions, dedup: bool
) -> Column:
    n = len(rules.rules)

    def both(text: Column) -> Column:
        def join(found: Column) -> Column:
            kept = first_of_token(found) if dedup else found
            return let(kept, lambda hits: with_snippets(text, hits, opts))

        return let(F.concat(pattern_hits(text, rules), entropy_hits(text, opts, n)), join)

    return let(F.col(column), both)


def gate(line: Column, rules: RuleSet, opts: ScanOptions) -> Column:
    """Lines that can hold a finding at all; a superset by construction."""
    found = rules.may_match(line)
    if rules.tests_words and opts.min_token_length >= LINE_RUN:
        # A word long enough for the entropy detector already passes.
        return found
    return found | may_hold_token(line, opts.min_token_length)


def text_gate(text: Column, rules: RuleSet, opts: ScanOptions) -> Column:
    """Texts that can hold a finding at all.

    A mark of a built-in rule stands in a line wherever it stands in the text.
    The expression of a user rule means something else on a whole text (``^``,
    ``$``, lookarounds), so with one present every text goes to its lines.
    """
    return gate(text, rules, opts) if rules.has_marks_only else F.lit(True)


def describe(hits: DataFrame, rules: RuleSet) -> DataFrame:
    """Add rule, confidence and remediation to exploded hits."""
    is_rule = F.col("kind") == KIND_RULE
    ordinal = F.when(is_rule, F.col("rule_ord"))
    return hits.withColumns(
        {
            "rule": F.when(is_rule, rules.lookup(ordinal, "name")).otherwise(F.lit(ENTROPY_RULE)),
            "confidence": F.when(is_rule, rules.lookup(ordinal, "confidence")).otherwise(
                entropy_confidence(F.col("entropy"))
            ),
            "remediation": F.when(is_rule, rules.lookup(ordinal, "remediation")).otherwise(
                entropy_advice(F.col("entropy"))
            ),
        }
    )


def scan_lines(
    df: DataFrame,
    content: str = "content",
    rules: RuleSet | None = None,
    opts: ScanOptions | None = None,
    dedup: bool = True,
) -> DataFrame:
    """Findings of a table of lines; all other columns are kept.

    ``inline_outer`` keeps the optimizer from testing the size of the hit
    array, which would run every detector twice.
    """
    rules, opts = rules or RuleSet.default(), opts or ScanOptions()
    keep = [c for c in df.columns if c != content]
    hits = (
        df.where(gate(F.col(content), rules, opts))
        .select(*keep, F.inline_outer(line_hits(content, rules, opts, dedup)))
        .where(F.col("kind").isNotNull())
        .withColumnRenamed("start", "column")
    )
    return describe(hits, rules)


def scan_patterns(
    df: DataFrame, content: str = "content", rules: RuleSet | None = None
) -> DataFrame:
    """The rule detector alone: one row per match."""
    rules = rules or RuleSet.default()
    keep = [c for c in df.columns if c != content]
    found = let(F.col(content), lambda text: pattern_hits(text, rules))
    hits = (
        df.where(rules.may_match(F.col(content)))
        .select(*keep, F.inline_outer(found))
        .where(F.col("kind").isNotNull())
    )
    return describe(hits, rules).drop("entropy")


def scan_entropy(
    df: DataFrame, content: str = "content", opts: ScanOptions | None = None
) -> DataFrame:
    """The entropy detector alone: repeated tokens each give a row."""
    opts = opts or ScanOptions()
    keep = [c for c in df.columns if c != content]
    hits = (
        df.where(may_hold_token(F.col(content), opts.min_token_length))
        .select(*keep, F.inline_outer(let(F.col(content), lambda t: entropy_hits(t, opts))))
        .where(F.col("kind").isNotNull())
    )
    return hits.withColumns(
        {
            "rule": F.lit(ENTROPY_RULE),
            "confidence": entropy_confidence(F.col("entropy")),
            "remediation": entropy_advice(F.col("entropy")),
        }
    )


def scan_text(df: DataFrame, text: str = "text", start_line: int = 1, rules: RuleSet | None = None) -> DataFrame:
    """The rule detector over multi-line text, numbered from ``start_line``."""
    return scan_patterns(lines(df, text, start_line), "content", rules)


FINDING_COLUMNS = [
    "path",
    "line",
    "column",
    "end",
    "token",
    "rule",
    "confidence",
    "remediation",
    "snippet",
    "kind",
    "rule_ord",
    "entropy",
    "masked_snippet",
]


def scan_files(
    files: DataFrame,
    rules: RuleSet | None = None,
    opts: ScanOptions | None = None,
    root: str = "",
    walk: bool = True,
    test_binary: bool = True,
) -> DataFrame:
    """All detectors over ``files(path, text)``: the main plan.

    Excluded and binary files are dropped, lines are exploded, and one cheap
    test per line decides which run the detectors.  Line 0 stands for the file
    name, so the file-name detector needs no second pass over the table.
    Nothing is shuffled.  ``walk=False`` tests each path alone, without the
    directories above it.  Columns other than path and text are kept.  Text
    with CR line ends goes through ``universal_newlines`` first.  The binary
    test here sees decoded text; ``test_binary=False`` is for files that were
    tested on their bytes, which is the test that counts.
    """
    rules, opts = rules or RuleSet.default(), opts or ScanOptions()
    path = F.col("path")
    extra = [c for c in files.columns if c not in ("path", "text")]
    excluded = (
        exclude_walk(path, opts.exclude_patterns, root)
        if walk
        else exclude_exact(path, opts.exclude_patterns)
    )
    suspicious = suspicious_name(path)
    # Most texts end here: one pass, left at the first promising place.  The
    # tests sit inside the generator so that they run after any repartitioning.
    worth = suspicious | text_gate(F.col("text"), rules, opts)
    if test_binary:
        worth = worth & ~is_binary_text(F.col("text"))
    numbered = files.where(~excluded).select(
        "path",
        *extra,
        F.when(suspicious, filename_finding(path)).alias("name"),
        F.posexplode_outer(F.when(worth, F.array_prepend(split_lines(F.col("text")), F.lit("")))).alias(
            "line", "content"
        ),
    )
    at_name = F.col("line") == 0
    name = F.col("name")
    from_name = F.array(
        F.struct(
            F.lit(KIND_NAME).alias("kind"),
            F.lit(-1).alias("rule_ord"),
            F.lit("").alias("token"),
            F.lit(0).alias("start"),
            F.lit(0).alias("end"),
            F.lit(None).cast("double").alias("entropy"),
            name["reason"].alias("snippet"),
            name["reason"].alias("masked_snippet"),
        )
    )
    hits = (
        numbered.where((at_name & name.isNotNull()) | (~at_name & gate(F.col("content"), rules, opts)))
        .select(
            "path",
            *extra,
            "line",
            "name",
            F.inline_outer(F.when(at_name, from_name).otherwise(line_hits("content", rules, opts))),
        )
        .where(F.col("kind").isNotNull())
        .withColumnRenamed("start", "column")
    )
    by_name = F.col("kind") == KIND_NAME
    fields = ("rule", "confidence", "remediation")
    found = describe(hits, rules).withColumns(
        {f: F.when(by_name, name[f]).otherwise(F.col(f)) for f in fields}
    )
    return found.select(*FINDING_COLUMNS, *extra)


def scan_listed(
    files: DataFrame, paths: DataFrame, rules: RuleSet | None = None, opts: ScanOptions | None = None
) -> DataFrame:
    """Scan the files named in ``paths(path)``; a path without a file gives nothing."""
    return scan_files(semi_join(files, paths, "path"), rules, opts, walk=False)
