"""Masking and snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hof import let

MASK = "***"
CHUNK = 4096


def redact_secret(secret: Column, show_chars: int = 4) -> Column:
    """``***`` and the last characters; nothing of a short secret."""
    if show_chars <= 0:
        return F.lit(MASK)
    return F.when(F.length(secret) <= show_chars, F.lit(MASK)).otherwise(
        F.concat(F.lit(MASK), F.right(secret, F.lit(show_chars)))
    )


def _cut(line: Column, start: Column, stop: Column) -> Column:
    return F.substring(line, start + 1, F.greatest(stop - start, F.lit(0)))


def redact_line(line: Column, start: Column, end: Column, show_chars: int = 4) -> Column:
    """The line with [start, end) masked; an impossible span changes nothing."""
    size = F.length(line)
    masked = F.concat(
        _cut(line, F.lit(0), start), redact_secret(_cut(line, start, end), show_chars), _cut(line, end, size)
    )
    return F.when((start < 0) | (end > size) | (start >= end), line).otherwise(masked)


def _with_dots(body: Column, first: Column, stop: Column, size: Column) -> Column:
    dots, none = F.lit("..."), F.lit("")
    return F.concat(
        F.when(first > 0, dots).otherwise(none), body, F.when(stop < size, dots).otherwise(none)
    )


def create_snippet(line: Column, start: Column, end: Column, context: int = 20) -> Column:
    """The span with some text around it, unmasked."""
    size = F.length(line)
    first, stop = F.greatest(F.lit(0), start - context), F.least(size, end + context)
    return _with_dots(_cut(line, first, stop), first, stop, size)


def redact_snippet(
    line: Column, start: Column, end: Column, context: int = 20, show_chars: int = 4
) -> Column:
    """The span masked, with some text around it."""
    size = F.length(line)
    first, stop = F.greatest(F.lit(0), start - context), F.least(size, end + context)
    valid = (start >= first) & (start < stop) & (end <= stop)
    masked = F.concat(
        _cut(line, first, start), redact_secret(_cut(line, start, end), show_chars), _cut(line, end, stop)
    )
    body = F.when(valid, masked).otherwise(_cut(line, first, stop))
    return _with_dots(body, first, stop, size)


def line_chunks(line: Column) -> Column:
    """The line in pieces of CHUNK characters.

    Reaching an offset in a string walks it from the start; over pieces, many
    findings on one very long line stay cheap.
    """
    return F.when(F.length(line) <= CHUNK, F.array(line)).otherwise(
        F.regexp_extract_all(line, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    )


def _cut_chunks(chunks: Column, start: Column, stop: Column) -> Column:
    first = F.floor(start / CHUNK).cast("int")
    last = F.greatest(first, F.floor((stop - 1) / CHUNK).cast("int"))
    joined = F.array_join(F.slice(chunks, first + 1, last - first + 1), "")
    return F.substring(joined, start - first * CHUNK + 1, F.greatest(stop - start, F.lit(0)))


def hit_snippet(
    chunks: Column, size: Column, start: Column, end: Column, context: int, show_chars: int = 4
) -> Column:
    """``redact_snippet`` for a valid span of a line held as chunks."""
    first, stop = F.greatest(F.lit(0), start - context), F.least(size, end + context)
    tail = F.when(end - start <= show_chars, F.lit("")).otherwise(
        _cut_chunks(chunks, end - show_chars, end)
    )
    body = F.concat(_cut_chunks(chunks, first, start), F.lit(MASK), tail, _cut_chunks(chunks, end, stop))
    return _with_dots(body, first, stop, size)


def _furthest(ends: Column) -> Column:
    """For each place the largest number so far."""
    start = F.struct(F.lit(0).alias("top"), F.array().cast("array<int>").alias("tops"))

    def add(acc: Column, end: Column) -> Column:
        top = F.greatest(acc["top"], end)
        return F.struct(top.alias("top"), F.concat(acc["tops"], F.array(top)).alias("tops"))

    return F.aggregate(ends, start, add, lambda acc: acc["tops"])


def mask_spans(chunks: Column, size: Column, spans: Column) -> Column:
    """The line with every span starred out, put together once.

    ``spans`` are ``(start, end)`` in order of start; they may overlap.
    """

    def join(tops: Column) -> Column:
        def piece(span: Column, i: Column) -> Column:
            free = F.when(i == 0, F.lit(0)).otherwise(F.get(tops, i - 1))
            stars = F.repeat(F.lit("*"), F.greatest(span["end"] - F.greatest(span["start"], free), F.lit(0)))
            return F.concat(_cut_chunks(chunks, free, F.greatest(span["start"], free)), stars)

        last = F.coalesce(F.get(tops, F.size(tops) - 1), F.lit(0))
        return F.concat(F.array_join(F.transform(spans, piece), ""), _cut_chunks(chunks, last, size))

    return let(_furthest(F.transform(spans, lambda s: s["end"])), join)


def masked_snippet(
    chunks: Column, masked: Column, size: Column, start: Column, end: Column, context: int, show_chars: int = 4
) -> Column:
    """``hit_snippet`` with every other span of the line starred out too.

    ``masked`` are the chunks of the line from ``mask_spans``; the span's own
    last characters stay visible.
    """
    first, stop = F.greatest(F.lit(0), start - context), F.least(size, end + context)
    tail = F.when(end - start <= show_chars, F.lit("")).otherwise(_cut_chunks(chunks, end - show_chars, end))
    body = F.concat(_cut_chunks(masked, first, start), F.lit(MASK), tail, _cut_chunks(masked, end, stop))
    return _with_dots(body, first, stop, size)


def default_snippet(token: Column, snippet: Column) -> Column:
    """The given snippet, or the masked token where there is none."""
    bare = let(F.length(token), lambda n: redact_snippet(token, F.lit(0), n))
    return F.coalesce(F.when(snippet != "", snippet), bare)


def mask_value(value: Column, mask_char: str = "*", keep_ratio: float = 0.2) -> Column:
    """Mask all but a share of the characters, at least one, at the end."""
    keep = F.greatest(F.lit(1), F.floor(F.length(value) * F.lit(keep_ratio)).cast("int"))
    hidden = F.greatest(F.length(value) - keep, F.lit(0))
    masked = F.concat(F.repeat(F.lit(mask_char), hidden), F.right(value, keep))
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit(mask_char * 3)).otherwise(masked)


def env_preview(value: Column) -> Column:
    """First and last four characters of a longer value."""
    return F.when(
        F.length(value) > 8,
        F.concat(F.substring(value, 1, 4), F.lit("..."), F.right(value, F.lit(4))),
    ).otherwise(F.lit(MASK))
