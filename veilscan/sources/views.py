"""The scan as temporary views, for use from SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.detect import scan_files
from ..operators.report import at_least, by_file, by_rule, stored_form, summary
from ..options import ScanOptions
from ..rules import RuleSet


def register_views(
    files: DataFrame,
    rules: RuleSet | None = None,
    opts: ScanOptions | None = None,
    prefix: str = "",
) -> None:
    """Create ``rules``, ``findings``, ``reported``, ``by_rule``, ``by_file``
    and ``summary`` over ``files(path, text)``.  No view shows a token."""
    rules, opts = rules or RuleSet.default(), opts or ScanOptions()
    found = stored_form(scan_files(files, rules, opts))
    reported = at_least(found, opts.confidence_threshold)
    views = {
        "rules": rules.to_df(files.sparkSession),
        "findings": found,
        "reported": reported,
        "by_rule": by_rule(reported),
        "by_file": by_file(reported),
        "summary": summary(reported),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
