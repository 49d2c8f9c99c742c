"""Small helpers for expressions over arrays inside one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.transform(F.array(value), body)[0]


def _fold(numbers: Column) -> Column:
    start = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("before"))
    return F.aggregate(
        numbers,
        start,
        lambda acc, x: F.struct(
            (acc["total"] + x).alias("total"),
            F.concat(acc["before"], F.array(acc["total"])).alias("before"),
        ),
    )


def sums_before(numbers: Column) -> Column:
    """For each number the sum of those before it.

    Appending to an array copies it, so the fold works on blocks: a line with
    very many matches costs n * BLOCK copies and not n * n.
    """
    last_block = F.floor((F.size(numbers) - 1) / BLOCK).cast("int")
    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(last_block, F.lit(0))),
        lambda b: _fold(F.slice(numbers, b * BLOCK + 1, F.lit(BLOCK))),
    )
    return let(
        blocks,
        lambda bs: F.flatten(
            F.zip_with(
                bs,
                _fold(F.transform(bs, lambda b: b["total"]))["before"],
                lambda b, base: F.transform(b["before"], lambda x: x + base),
            )
        ),
    )


def match_spans(line: Column, pattern: Column) -> Column:
    """All matches of ``pattern`` as ``array<struct<text, start, end>>``.

    The text between matches comes from ``split``, so the offsets follow from
    lengths alone; they count code points.
    """
    texts = F.regexp_extract_all(line, pattern, F.lit(0))
    gaps = F.split(line, pattern, -1)
    sized = F.zip_with(
        texts,
        F.slice(gaps, F.lit(1), F.size(gaps) - 1),
        lambda t, g: F.struct(t.alias("text"), F.length(g).alias("gap"), F.length(t).alias("len")),
    )
    return let(
        sized,
        lambda ms: F.zip_with(
            ms,
            sums_before(F.transform(ms, lambda m: m["gap"] + m["len"])),
            lambda m, base: F.struct(
                m["text"].alias("text"),
                (base + m["gap"]).alias("start"),
                (base + m["gap"] + m["len"]).alias("end"),
            ),
        ),
    )
