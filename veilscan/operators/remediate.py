"""From findings to a migration plan, and from the plan to rewritten files."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hof import let
from ..functions.naming import env_var_name
from ..functions.paths import file_kind
from ..functions.substitute import IMPORT, JS_STYLES, PYTHON_STYLES, applied, changes, import_edit, substituted
from ..functions.text import split_lines
from .joins import semi_join
from .ordinals import ordinals
from .report import fixable, without_tokens

# Stand-ins for a value that must be read from the file.
ASK, MASKED = "<ask user to provide>", "<masked>"
NOT_EXTRACTED = "no value found on the line"
NOT_FOUND = "value not found in the file"
NO_FILE = "no such file"

ORDER = ["path", "line", "kind", "rule_ord", "column"]
PLAN_NEEDS = ["path", "line", "column", "kind", "rule_ord", "rule", "snippet", "confidence"]


def env_ordinals(findings: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Add ``ordinal``: the 0-based place of a finding among those of its rule."""
    placed = ordinals(without_tokens(findings), "rule", order or ORDER)
    return placed.withColumn("ordinal", F.col("ordinal").cast("int"))


def migration_plan(findings: DataFrame) -> DataFrame:
    """Fixable findings with a variable name each; no secret value is kept."""
    numbered = env_ordinals(without_tokens(fixable(findings)).select(*PLAN_NEEDS))
    return numbered.select(
        "path",
        "line",
        "rule",
        env_var_name(F.col("rule"), F.col("ordinal")).alias("env_var_name"),
        F.col("snippet").alias("value_redacted"),
        F.lit(ASK).alias("value_full"),
        "confidence",
        "column",
        "kind",
        "rule_ord",
    )


def instructions(plan: DataFrame) -> DataFrame:
    """One text block per planned variable, in plan order, ready to print."""
    text = F.format_string(
        "%s\n   at %s:%d\n   found by %s\n   shown as %s",
        "env_var_name",
        "path",
        "line",
        "rule",
        "value_redacted",
    )
    return plan.select("path", "line", "column", "env_var_name", text.alias("instruction")).orderBy(
        "path", "line", "column", "env_var_name"
    )


# What is wrong with a block of a printed plan.
NO_NAME, NO_PLACE, TWICE = "no variable name", "no file and line", "name planned twice"


def parsed_instructions(blocks: DataFrame, text: str = "instruction") -> DataFrame:
    """Printed instructions read back, one row for each block.

    A block is what ``instructions`` prints, perhaps edited by hand: the name
    first, then lines ``at FILE:LINE``, ``found by RULE`` and, where someone
    filled one in, ``value VALUE``.  Returns ``env_var_name, path, line, rule,
    value_full, problem``.  What a block does not tell is null, a missing or
    masked value is ``ASK``, and ``problem`` says why a block cannot be used,
    null if it can.  Null and empty blocks have no name.
    """
    block = F.coalesce(F.col(text), F.lit(""))

    def told(pattern: str, group: int = 1) -> Column:
        return F.nullif(F.regexp_extract(block, r"(?dm)" + pattern, group), F.lit(""))

    place = r"^[ \t]*at (.+):(\d{1,9})[ \t]*$"
    value = told(r"^[ \t]*value (.+)$")
    rows = blocks.select(
        F.nullif(F.regexp_extract(block, r"(?d)^\s*([A-Za-z_][A-Za-z0-9_]*)[ \t]*(?:\n|$)", 1), F.lit("")).alias("env_var_name"),
        told(place).alias("path"),
        told(place, 2).cast("int").alias("line"),
        told(r"^[ \t]*found by (\S+)[ \t]*$").alias("rule"),
        F.when(is_placeholder(value), ASK).otherwise(value).alias("value_full"),
    )
    counted = rows.where("env_var_name IS NOT NULL").groupBy("env_var_name").agg(F.count("*").alias("n"))
    # The list of names planned twice may be as long as the plan; Spark's own limit decides how it is joined.
    twice = counted.where("n > 1").select("env_var_name", F.lit(True).alias("twice"))
    problem = (
        F.when(F.col("env_var_name").isNull(), NO_NAME)
        .when(F.col("path").isNull() | F.col("line").isNull(), NO_PLACE)
        .when(F.col("twice"), TWICE)
    )
    return rows.join(twice, "env_var_name", "left").withColumn("problem", problem).drop("twice")


def is_placeholder(value: Column) -> Column:
    v = F.coalesce(value, F.lit(""))
    return v.isin("", ASK, MASKED) | v.startswith("***")


# String literals by quote style, in the order they are tried,
# and a long bare run.  The loops are possessive, so a long literal with many
# escapes needs no backtracking stack.
LITERALS = [
    r'(?s)"([^"\\]*+(?:\\.[^"\\]*+)*+)"',
    r"(?s)'([^'\\]*+(?:\\.[^'\\]*+)*+)'",
    r'(?s)"""(.*?)"""',
    r"(?s)'''(.*?)'''",
    r"(?s)`([^`]*+)`",
]
BARE_RUN = r"([a-zA-Z0-9_\-+/=]{20,})"


def longest(strings: Column) -> Column:
    """The longest string of an array, the first of equals; null if empty."""
    return F.aggregate(
        strings,
        F.lit(None).cast("string"),
        lambda best, s: F.when(best.isNull() | (F.length(s) > F.length(best)), s).otherwise(best),
    )


def extract_literal(line: Column) -> Column:
    """The likely secret on a line: the longest literal of the first quote
    style that occurs, else the longest bare run, else null."""
    picks = [longest(F.regexp_extract_all(line, F.lit(p), F.lit(1))) for p in [*LITERALS, BARE_RUN]]
    return F.coalesce(*picks)


def import_position(lines: Column) -> Column:
    """Index at which ``import os`` goes: after the module docstring and imports.

    A fold over the lines with a small state: the open docstring quote, an
    open import parenthesis, the index, and whether code was reached.
    """
    state = F.struct(
        F.lit(0).alias("i"),
        F.lit("").alias("quote"),
        F.lit(False).alias("paren"),
        F.lit(0).alias("at"),
        F.lit(False).alias("done"),
    )

    def step(s: Column, line: Column) -> Column:
        text = F.trim(F.translate(line, "\t\r", "  "))
        opener = F.substring(text, 1, 3)
        opens = opener.isin('"""', "'''")
        in_doc, in_paren = s["quote"] != "", s["paren"]
        closes = F.contains(text, s["quote"])
        once = opens & F.contains(F.substr(text, F.lit(4)), opener)
        is_import = text.startswith("import ") | text.startswith("from ")
        passive = (text == "") | text.startswith("#")
        quote = (
            F.when(in_doc, F.when(closes, "").otherwise(s["quote"]))
            .when(~in_paren & opens & ~once, opener)
            .otherwise("")
        )
        paren = F.when(in_doc, False).when(in_paren, ~F.contains(text, F.lit(")"))).otherwise(
            is_import & F.contains(text, F.lit("(")) & ~F.contains(text, F.lit(")"))
        )
        moves = in_doc | in_paren | opens | is_import
        new = F.struct(
            (s["i"] + 1).alias("i"),
            quote.alias("quote"),
            paren.alias("paren"),
            F.when(moves, s["i"] + 1).otherwise(s["at"]).alias("at"),
            (~moves & ~passive).alias("done"),
        )
        return F.when(s["done"], s).otherwise(new)

    return F.aggregate(lines, state, step)["at"]


def needs_import(text: Column) -> Column:
    return ~text.contains("import os") & ~text.contains("from os import")


def insert_line(text: Column, at: Column, new_line: str) -> Column:
    ls = split_lines(text)
    return let(
        ls,
        lambda x: F.array_join(
            F.concat(
                F.slice(x, F.lit(1), at), F.array(F.lit(new_line)), F.slice(x, at + 1, F.size(x))
            ),
            "\n",
        ),
    )


def _swap(text: Column, value: Column, styles: list[tuple[str, str]], name: Column, call: Column) -> Column:
    """Replace the quoted value, or the bare value where it is never quoted.

    Literal replacement passes over the text much faster than a pattern.  Only
    a value equal to its variable's name needs one pass by pattern, since the
    replacement itself holds that name in quotes.
    """
    quoted = [F.concat(F.lit(prefix + quote), value, F.lit(quote)) for prefix, quote in styles]
    one_by_one = reduce(lambda out, form: F.replace(out, form, call), quoted, text)
    literal = F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    pattern = F.concat_ws("|", *[F.concat(F.lit(p + q), literal, F.lit(q)) for p, q in styles])
    at_once = F.regexp_replace(text, pattern, F.replace(call, F.lit("$"), F.lit("\\$")))
    plain = [quote for prefix, quote in styles if not prefix and len(quote) == 1]
    is_quoted = reduce(or_, [F.contains(text, F.concat(F.lit(q), value, F.lit(q))) for q in plain])
    return (
        F.when(~is_quoted, F.replace(text, value, call))
        .when(value == name, at_once)
        .otherwise(one_by_one)
    )


def rewrite_value(text: Column, value: Column, name: Column, kind: Column) -> Column:
    """The text with every occurrence of the value read from the environment;
    null where the value does not occur."""
    getenv = F.concat(F.lit('os.getenv("'), name, F.lit('")'))
    swapped = (
        F.when(kind == "python", _swap(text, value, PYTHON_STYLES, name, getenv))
        .when(kind == "javascript", _swap(text, value, JS_STYLES, name, F.concat(F.lit("process.env."), name)))
        .otherwise(F.replace(text, value, F.concat(F.lit("${"), name, F.lit("}"))))
    )
    return F.when(F.contains(text, value) & (value != ""), swapped)


def rewrite_python(text: Column, value: Column, name: Column) -> Column:
    """``rewrite_value`` for Python, with ``import os`` added where missing."""
    swapped = rewrite_value(text, value, name, F.lit("python"))
    return F.when(
        needs_import(text), insert_line(swapped, import_position(split_lines(text)), "import os")
    ).otherwise(swapped)


def rewrite_js(text: Column, value: Column, name: Column) -> Column:
    return rewrite_value(text, value, name, F.lit("javascript"))


def rewrite_generic(text: Column, value: Column, name: Column) -> Column:
    return rewrite_value(text, value, name, F.lit("other"))


def _migration_list() -> Column:
    """Each migration's value, read from its line where the plan has none."""
    return F.transform(
        F.col("todo"),
        lambda m: F.struct(
            m["ord"].alias("ord"),
            m["line"].alias("line"),
            m["env_var_name"].alias("env_var_name"),
            F.when(
                is_placeholder(m["value_full"]), extract_literal(F.get(F.col("old_lines"), m["line"] - 1))
            )
            .otherwise(m["value_full"])
            .alias("value"),
        ),
    )


RESULT = "struct<ord:int,line:int,env_var_name:string,success:boolean,error:string>"
CHANGE = "struct<line:int,before:string,after:string>"
#: Files handed back together, at most, and about how many characters of text.
ROWS, BATCH_CHARS = 256, 4 << 20


def _rewrite_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``path, text, kind, import_at, todo`` to what ``rewrite_files`` returns."""
    result = pa.struct([("ord", pa.int32()), ("line", pa.int32()), ("env_var_name", pa.string()), ("success", pa.bool_()), ("error", pa.string())])
    change = pa.struct([("line", pa.int32()), ("before", pa.string()), ("after", pa.string())])
    done, size = [], 0

    def made() -> pa.RecordBatch:
        columns = zip(*done, strict=True)
        types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(result), pa.list_(change))
        return pa.record_batch(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
            names=["path", "text_before", "text_after", "import_at", "results", "changes"],
        )

    for batch in batches:
        for row in (r for lo in range(0, batch.num_rows, ROWS) for r in batch.slice(lo, ROWS).to_pylist()):
            text, todo, edits, there = row["text"], row["todo"], [], []
            if text is not None:
                edits, there = substituted(text, row["kind"], [(m["value"], m["env_var_name"]) for m in todo])
            results = []
            for k, m in enumerate(todo):
                error = NO_FILE if text is None else None if there[k] else NOT_FOUND if m["value"] else NOT_EXTRACTED
                results.append((m["ord"], m["line"], m["env_var_name"], error is None, error))
            every, at, changed = edits, None, []
            if text is not None:
                changed = changes(text, edits)
                if row["import_at"] is not None and any(there):
                    inserted = import_edit(text, row["import_at"], edits)
                    at = text.count("\n", 0, inserted.start) + inserted.text.startswith("\n")
                    every = sorted([inserted, *edits])
                    changed.append((at + 1, None, IMPORT))
            done.append((row["path"], text, None if text is None else applied(text, every), at, results, changed))
            size += len(text or "") + sum(len(m["env_var_name"] or "") for m in todo)
            if len(done) >= ROWS or size >= BATCH_CHARS:
                yield made()
                done, size = [], 0
    if done:
        yield made()


def rewrite_files(files: DataFrame, plan: DataFrame) -> DataFrame:
    """Apply each file's migrations in plan order, in one pass over its text.

    Returns ``path, text_before, text_after, import_at, results, changes``: the
    table is new and the source stays as it is.  Values are read by the line
    numbers of the original text and sought in it, never in what another value
    was replaced by; they may span lines.  Of values that hold one another the
    first in the plan is replaced.  A file's plan is held beside its text; the
    plan has rows for strings found in that text, so it does not outgrow it.
    """
    entry = F.struct(
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("line", "kind", "rule_ord", "column")],
        "env_var_name",
        "value_full",
    )
    todo = plan.groupBy("path").agg(F.array_sort(F.collect_list(entry)).alias("todo"))
    numbered = F.transform(
        "todo",
        lambda m, i: F.struct(
            i.alias("ord"),
            m["line"].alias("line"),
            m["env_var_name"].alias("env_var_name"),
            m["value_full"].alias("value_full"),
        ),
    )
    # Only the texts of planned files move, however many files there are.
    wanted = semi_join(files.select("path", "text"), plan, "path")
    joined = todo.withColumn("todo", numbered).join(wanted, "path", "left")
    kind = file_kind(F.col("path"))
    valued = joined.withColumn("old_lines", split_lines(F.col("text"))).withColumn("todo", _migration_list())
    wants = (kind == "python") & needs_import(F.col("text"))
    at = F.when(wants, import_position(F.col("old_lines")))
    schema = f"path string, text_before string, text_after string, import_at int, results array<{RESULT}>, changes array<{CHANGE}>"
    return valued.select("path", "text", kind.alias("kind"), at.alias("import_at"), "todo").mapInArrow(_rewrite_batches, schema)


def rewrite_results(rewritten: DataFrame) -> DataFrame:
    """One row per migration: did it succeed, and if not why."""
    r = F.explode_outer("results").alias("r")
    return rewritten.select("path", r).select(
        "path", "r.ord", "r.line", "r.env_var_name", "r.success", "r.error"
    )


def changed_lines(rewritten: DataFrame) -> DataFrame:
    """Lines that differ: ``path, line, before, after``.

    Old and new lines are aligned by the edits themselves.  A line that was
    joined to the one before has no ``after``; an inserted line has no
    ``before`` and carries its number in the new text, others that in the old.
    """
    return rewritten.select("path", F.inline("changes"))
