"""Shannon entropy and the high-entropy token detector, within a row."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..options import HARMLESS, MAX_TOKEN_LENGTH
from .hof import let, match_spans
from .text import has_long_word


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def char_histogram(s: Column) -> Column:
    """``array<struct<ch, n>>`` in order of first appearance."""
    return F.transform(
        F.array_distinct(_chars(s)),
        lambda c: F.struct(
            c.alias("ch"), (F.length(s) - F.length(F.replace(s, c, F.lit("")))).alias("n")
        ),
    )


def shannon_entropy(s: Column) -> Column:
    """Bits per character; 0.0 for the empty string.

    The terms are added in order of first appearance, so a value at a
    threshold does not depend on the plan.
    """
    shares = let(
        F.length(s),
        lambda n: F.transform(
            F.array_distinct(_chars(s)), lambda c: (n - F.length(F.replace(s, c, F.lit("")))) / n
        ),
    )
    return F.aggregate(shares, F.lit(0.0), lambda total, p: total - p * F.log2(p))


def is_high_entropy(s: Column, threshold: float = 4.0, min_length: int = 20) -> Column:
    """``struct<flag, entropy>``; too short a string gives (false, 0.0)."""
    return F.when(
        F.length(s) < min_length, F.struct(F.lit(False).alias("flag"), F.lit(0.0).alias("entropy"))
    ).otherwise(
        let(
            shannon_entropy(s),
            lambda h: F.struct((h >= threshold).alias("flag"), h.alias("entropy")),
        )
    )


def entropy_confidence(entropy: Column) -> Column:
    return F.least(entropy / 8.0, F.lit(0.95))


def is_allowlisted(token: Column, harmless: list[str] | tuple[str, ...] = tuple(HARMLESS)) -> Column:
    lowered = F.lower(token)
    found = F.lit(False)
    for h in harmless:
        found = found | lowered.contains(h.lower())
    return found


def length_ok(token: Column, min_length: int = 20, max_length: int = MAX_TOKEN_LENGTH) -> Column:
    return F.length(token).between(min_length, max_length)


def run_pattern(min_length: int) -> str:
    """Maximal runs of letters, digits and ``_-+=/.`` of a least length."""
    return rf"[\p{{L}}\p{{N}}_\-+=/.]{{{min_length},}}+"


def extract_tokens(
    text: Column,
    threshold: float = 4.0,
    min_length: int = 20,
    max_length: int = MAX_TOKEN_LENGTH,
    harmless: list[str] | tuple[str, ...] = (),
) -> Column:
    """``array<struct<token, entropy, start, end>>`` of the high-entropy runs.

    A run longer than ``max_length`` is dropped whole.  Entropy never exceeds
    log2 of the number of distinct characters, which rules most runs out
    before the sum is taken.
    """
    fewest = math.ceil(2.0**threshold - 1e-6)
    runs = F.lit(run_pattern(min_length))

    def maybe(token: Column) -> Column:
        ok = length_ok(token, min_length, max_length)
        ok = ok & (F.size(F.array_distinct(_chars(token))) >= fewest)
        return ok & ~is_allowlisted(token, harmless) if harmless else ok

    scored = F.transform(
        F.filter(match_spans(text, runs), lambda s: maybe(s["text"])),
        lambda s: F.struct(
            s["text"].alias("token"),
            shannon_entropy(s["text"]).alias("entropy"),
            s["start"].alias("start"),
            s["end"].alias("end"),
        ),
    )
    none = F.array().cast("array<struct<token:string,entropy:double,start:int,end:int>>")
    return F.when(
        has_long_word(text, min_length) & F.exists(F.regexp_extract_all(text, runs, F.lit(0)), maybe),
        F.filter(scored, lambda s: s["entropy"] >= threshold),
    ).otherwise(none)


def may_hold_token(text: Column, min_length: int = 20) -> Column:
    """False only where no run of the least length exists."""
    run = re.sub(r",}\+$", "}", run_pattern(min_length))
    return has_long_word(text, min_length) & text.rlike(run)


def entropy_advice(entropy: Column) -> Column:
    # bround: half-even, as the two-decimal text of an exact tie must be.
    return F.format_string(
        "Random-looking text (%.2f bits per character). If it is a secret, revoke it and read it from the environment.",
        F.bround(entropy, 2),
    )
