"""From bytes or text to numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def universal_newlines(text: Column) -> Column:
    """Fold CRLF and lone CR to LF; text without CR is passed on untouched."""
    return F.when(text.contains("\r"), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def decode_utf8(content: Column) -> Column:
    """Bytes to text, dropping bytes that are not UTF-8."""
    raw = content.cast("string")
    dropped = F.replace(F.make_valid_utf8(raw), F.lit("\ufffd"), F.lit(""))
    return F.when(F.is_valid_utf8(raw), raw).otherwise(dropped)


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def lines(df: DataFrame, text: str = "text", start_line: int = 1) -> DataFrame:
    """One row per line: all other columns, ``line`` and ``content``.

    The outer form of the generator keeps the optimizer from adding a size
    test that would split every text a second time.
    """
    keep = [c for c in df.columns if c != text]
    return df.select(
        *keep, F.posexplode_outer(split_lines(F.col(text))).alias("pos", "content")
    ).select(*keep, (F.col("pos") + start_line).alias("line"), "content")


def has_long_word(text: Column, length: int) -> Column:
    r"""Whether there are that many characters in a row without white space.

    Anchored at the white space before the word, the test looks at most
    characters once; a class of letters and digits of all scripts, tried at
    every position, takes several times as long.
    """
    return text.rlike(rf"\s\S{{{length}}}") | text.rlike(rf"^\S{{{length}}}")


# A key word list for lines that may show a secret (fixed values).
EXPOSURE_WORDS = ["password", "secret", "token", "api_key", "apikey", "private_key", "credentials"]


def secret_exposed(line: Column, words: list[str] | None = None) -> Column:
    """A key word, in any case, and an assignment sign on the same line."""
    lowered = F.lower(line)
    found = F.lit(False)
    for w in EXPOSURE_WORDS if words is None else words:
        found = found | lowered.contains(w)
    return found & (line.contains("=") | line.contains(":"))


CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
SNIFF_BYTES = 8192


def is_binary(content: Column) -> Column:
    """NUL, or over 30 % control bytes, in the first 8 KiB; unreadable counts as binary."""
    head = F.substring(content, 1, SNIFF_BYTES)
    # ISO-8859-1 maps each byte to one character.
    chars = F.decode(head, "ISO-8859-1")
    size = F.length(head)
    controls = size - F.length(F.regexp_replace(chars, CONTROL, ""))
    binary = chars.contains("\x00") | (controls > size * 0.3)
    return F.coalesce(chars.rlike(CONTROL) & binary, F.lit(True))


def is_binary_text(text: Column) -> Column:
    """The same test for a table that already holds text."""
    head = F.substring(text, 1, SNIFF_BYTES)
    # Bytes are counted only where there is a control character at all.
    return F.coalesce(head.rlike(CONTROL) & is_binary(F.encode(head, "UTF-8")), F.lit(True))
