"""Filters, aggregates and orderings over findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import staged_skip
from ..functions.report import HIGH, MEDIUM, confidence_band
from ..options import ScanOptions
from ..session import checkpointed
from .ordinals import chunks

STORED_COLUMNS = ["path", "line", "column", "snippet", "rule", "confidence", "remediation", "found_at"]
COMMIT_COLUMNS = ["commit_sha", "commit_author", "commit_date", "commit_message"]


def at_least(findings: DataFrame, threshold: float | None = None) -> DataFrame:
    t = ScanOptions().confidence_threshold if threshold is None else threshold
    return findings.where(F.col("confidence") >= t)


def fixable(findings: DataFrame) -> DataFrame:
    """Findings in a file's text, as opposed to its name."""
    return findings.where(F.col("line") > 0)


def without_tokens(findings: DataFrame) -> DataFrame:
    """Findings that show no token: snippets mask every span of their line."""
    if "masked_snippet" in findings.columns:
        findings = findings.withColumn("snippet", F.col("masked_snippet"))
    return findings.drop("token", "masked_snippet")


def stored_form(findings: DataFrame) -> DataFrame:
    """What may leave the engine: no token, neither its own nor a neighbour's."""
    findings = without_tokens(findings)
    if "found_at" not in findings.columns:
        findings = findings.withColumn("found_at", F.current_timestamp())
    extra = [c for c in COMMIT_COLUMNS if c in findings.columns]
    return findings.select(*STORED_COLUMNS, *extra)


def band_counts(confidence: Column) -> dict[str, Column]:
    band = confidence_band(confidence)
    return {b: F.count_if(band == b).alias(b) for b in ("high", "medium", "low")}


def by_rule(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule").agg(F.count("*").alias("findings"))


def summary(findings: DataFrame) -> DataFrame:
    """One row: total, counts by rule and band, files affected; zeros if empty.

    Rules and files are counted in one pass over the findings by grouping
    sets, so the scan behind ``findings`` runs once.
    """
    conf = F.col("confidence")
    groups = findings.groupingSets([["rule"], ["path"]], "rule", "path").agg(
        F.grouping("path").alias("is_rule"), F.count("*").alias("n"), *band_counts(conf).values()
    )
    of_rule = F.col("is_rule") == 1

    def total(c: str) -> Column:
        return F.coalesce(F.sum(F.when(of_rule, F.col(c))), F.lit(0))

    # At most one entry per rule is collected.
    entries = F.array_sort(F.collect_list(F.when(of_rule, F.struct("rule", "n"))))
    return groups.agg(
        total("n").alias("total"),
        F.map_from_entries(entries).alias("by_rule"),
        F.struct(*[total(b).alias(b) for b in ("high", "medium", "low")]).alias("by_confidence"),
        F.count_if(~of_rule).alias("files_affected"),
    )


def stats(stored: DataFrame) -> DataFrame:
    """The same bands over a findings store with gaps: no confidence is 0, no file is ''."""
    filled = stored.select(
        F.lit("").alias("rule"),
        F.coalesce("path", F.lit("")).alias("path"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )
    return summary(filled).select("total", "by_confidence", "files_affected")


def report_order(findings: DataFrame) -> DataFrame:
    """By file, then line; column and rule make the order total.

    A range sort on the whole key, so one file with most findings is spread
    over tasks.  The sort samples its input, so the findings, without their
    tokens, are written first and the scan behind them runs once.
    """
    return checkpointed(without_tokens(findings)).orderBy("path", "line", "column", "rule")


def by_file(findings: DataFrame) -> DataFrame:
    """One row per file: how many findings, where they begin and end, the
    strongest one.  ``listed_by_file`` lists the findings themselves."""
    return findings.groupBy("path").agg(
        F.count("*").alias("findings"),
        F.min("line").alias("first_line"),
        F.max("line").alias("last_line"),
        F.max("confidence").alias("max_confidence"),
        F.count_if(F.col("confidence") >= HIGH).alias("high"),
        F.count_if((F.col("confidence") >= MEDIUM) & (F.col("confidence") < HIGH)).alias("medium"),
    )


def listed_by_file(findings: DataFrame, most: int = 1000) -> DataFrame:
    """``path, chunk, entries``: each file's findings by line, column and rule.

    A file with more than ``most`` findings has several chunks, numbered from
    0, so one file with most of all findings is many rows of many tasks.  Tokens
    are left out; the snippet shows what may be printed.
    """
    told = [F.col(c) for c in ("line", "column", "rule", "confidence", "snippet")]
    return chunks(without_tokens(findings), "path", ["line", "column", "rule"], F.struct(*told), most)


def exit_status(findings: DataFrame) -> DataFrame:
    """0 if nothing was reported, else 1."""
    return findings.agg(
        F.count("*").alias("reported"), F.when(F.count("*") > 0, 1).otherwise(0).alias("exit_status")
    )


def gate(findings: DataFrame, threshold: float | None = None, change: str = "change_id") -> DataFrame:
    """Per change: blocked if any finding reaches the threshold."""
    t = ScanOptions().confidence_threshold if threshold is None else threshold
    reaches = F.col("confidence") >= t
    return findings.groupBy(change).agg(
        F.count_if(reaches).alias("findings"),
        F.max("confidence").alias("max_confidence"),
        F.bool_or(reaches).alias("blocked"),
    )


def staged(files: DataFrame) -> DataFrame:
    """Files a change gate looks at."""
    return files.where(~staged_skip(F.col("path")) & (F.col("text") != ""))


def env_check(required: DataFrame, available: DataFrame) -> DataFrame:
    """Each required name, sorted: set or missing, and a masked preview.

    An empty value counts as missing.  ``available(name, value)`` holds one
    row per name.
    """
    from ..functions.redact import env_preview

    names = required.select("name").distinct()
    value = F.nullif(F.col("value"), F.lit(""))
    return (
        names.join(available.select("name", "value"), "name", "left")
        .select(
            "name",
            value.isNotNull().alias("is_set"),
            F.when(value.isNotNull(), env_preview(value)).otherwise("").alias("preview"),
        )
        .orderBy("name")
    )


def env_union(plan: DataFrame, log: DataFrame) -> DataFrame:
    """Names from the plan and from the log, each once."""
    return (
        plan.select(F.col("env_var_name").alias("name"))
        .union(log.select(F.col("env_var_name").alias("name")))
        .distinct()
    )


def verify_summary(checked: DataFrame) -> DataFrame:
    """One row: total, set and missing names.  ``missing_names`` lists the missing ones."""
    return checked.agg(
        F.count("*").alias("total"),
        F.count_if("is_set").alias("set_count"),
        F.count_if(~F.col("is_set")).alias("missing"),
        (F.count_if(~F.col("is_set")) == 0).alias("all_set"),
    )


def missing_names(checked: DataFrame, most: int = 1000) -> DataFrame:
    """``chunk, names``: the names that are not set, sorted, at most ``most`` to a row; no row if all are set."""
    missing = checked.where(~F.col("is_set")).select(F.lit(0).alias("all"), "name")
    return chunks(missing, "all", ["name"], F.col("name"), most).select("chunk", F.col("entries").alias("names"))


def fix_summary(plan: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """One row: migrations, files, variables, skipped findings."""
    rows = plan.select("path", "env_var_name", F.lit(False).alias("skipped"))
    if skipped is not None:
        none = F.lit(None).cast("string")
        rows = rows.union(skipped.select(none, none, F.lit(True)))
    # Files and variables are counted by grouping sets: no distinct set is built.
    groups = rows.groupingSets(
        [["skipped"], ["skipped", "path"], ["skipped", "env_var_name"]], "skipped", "path", "env_var_name"
    ).agg(
        F.grouping("path").alias("no_path"), F.grouping("env_var_name").alias("no_name"), F.count("*").alias("n")
    )
    alone = (F.col("no_path") == 1) & (F.col("no_name") == 1)
    planned = ~F.col("skipped")
    return groups.agg(
        F.coalesce(F.sum(F.when(alone & planned, F.col("n"))), F.lit(0)).alias("migrations"),
        F.count_if(planned & (F.col("no_path") == 0)).alias("files"),
        F.count_if(planned & (F.col("no_name") == 0)).alias("env_vars"),
        F.coalesce(F.sum(F.when(alone & ~planned, F.col("n"))), F.lit(0)).alias("skipped"),
    )


def refactor_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed")
    )
