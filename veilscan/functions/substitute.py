"""Many literal values of one text replaced in a single pass.

All values are sought at once by an Aho-Corasick automaton in the text as it
stands, in time linear in the text, the values and their matches.  Matches are
then claimed in the order of the plan: what an earlier value has claimed, with
its quotes, a later one cannot touch, so of values that hold one another the
first in the plan wins.  A value may span lines.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

# Quote styles as prefix and quote, longer forms before the shorter they hold.
PYTHON_STYLES = [("f", '"""'), ("", '"""'), ("f", '"'), ("", '"'), ("f", "'''"), ("", "'''"), ("f", "'"), ("", "'")]
JS_STYLES = [("", '"'), ("", "'"), ("", "`")]
STYLES = {"python": PYTHON_STYLES, "javascript": JS_STYLES}
READS = {"python": 'os.getenv("{}")', "javascript": "process.env.{}"}
ANY_READ = "${{{}}}"
IMPORT = "import os"


class Edit(NamedTuple):
    """Code points ``start`` to ``end`` of the old text become ``text``."""

    start: int
    end: int
    text: str


def occurrences(text: str, values: Iterable[str]) -> dict[str, list[int]]:
    """Where each value begins, in ascending order, overlapping matches included."""
    import ahocorasick

    found: dict[str, list[int]] = {v: [] for v in values}
    automaton = ahocorasick.Automaton()
    for v in found:
        automaton.add_word(v, v)
    if found:
        automaton.make_automaton()
        for last, v in automaton.iter(text):
            found[v].append(last + 1 - len(v))
    return found


class Claims:
    """Which parts of a text have been replaced already."""

    def __init__(self, text: str) -> None:
        self.text, self.taken, self.edits = text, bytearray(len(text)), list[Edit]()

    def free(self, start: int, end: int) -> bool:
        return 0 <= start and end <= len(self.text) and self.taken.find(1, start, end) < 0

    def claim(self, start: int, end: int, new: str) -> None:
        self.taken[start:end] = b"\x01" * (end - start)
        self.edits.append(Edit(start, end, new))

    def quoted(self, start: int, end: int, before: str, after: str) -> bool:
        """Whether these quotes stand around a match and are free."""
        low, high = start - len(before), end + len(after)
        return self.free(low, high) and self.text.startswith(before, low) and self.text.startswith(after, end)

    def replace(self, starts: list[int], size: int, kind: str, new: str) -> bool:
        """Replace the free matches of one value with their quotes, or bare ones if none is quoted."""
        starts = [a for a in starts if self.free(a, a + size)]
        styles = STYLES.get(kind, [])
        plain = [q for prefix, q in styles if not prefix and len(q) == 1]
        if not any(self.quoted(a, a + size, q, q) for a in starts for q in plain):
            styles = [("", "")]
        for prefix, quote in styles:
            for a in starts:
                if self.quoted(a, a + size, prefix + quote, quote):
                    self.claim(a - len(prefix + quote), a + size + len(quote), new)
        return bool(starts)


def substituted(text: str, kind: str, todo: list[tuple[str | None, str]]) -> tuple[list[Edit], list[bool]]:
    """The edits that read each ``(value, name)`` from the environment, in order of place; and which values were there."""
    places, claims = occurrences(text, {v for v, _ in todo if v}), Claims(text)
    read = READS.get(kind, ANY_READ)
    there = [bool(v) and claims.replace(places[v], len(v), kind, read.format(name)) for v, name in todo]
    return sorted(claims.edits), there


def import_edit(text: str, line: int, edits: list[Edit]) -> Edit:
    """An import before line ``line`` (0-based), or before the line of an edit that reaches across."""
    at = 0
    for _ in range(line):
        at = text.find("\n", at) + 1
        if not at:
            return Edit(len(text), len(text), "\n" + IMPORT)
    for edit in reversed(edits):
        if edit.start < at < edit.end:
            at = text.rfind("\n", 0, edit.start) + 1
    return Edit(at, at, IMPORT + "\n")


def applied(text: str, edits: list[Edit]) -> str:
    parts, at = [], 0
    for edit in edits:
        parts += [text[at : edit.start], edit.text]
        at = edit.end
    return "".join([*parts, text[at:]])


def changes(text: str, edits: list[Edit]) -> list[tuple[int, str | None, str | None]]:
    """``(line, before, after)`` of every line that edits touch, lines from 1.

    The edits tell which old lines became which new ones: lines that an edit
    joins are one new line, the first, and the others have no ``after``.
    """
    out, number, at, k = [], 1, 0, 0
    while k < len(edits):
        low = text.rfind("\n", 0, edits[k].start) + 1
        number += text.count("\n", at, low)
        at, group = low, []
        high = low
        while k < len(edits) and (not group or edits[k].start <= high):
            group.append(edits[k])
            end = text.find("\n", edits[k].end)
            high, k = len(text) if end < 0 else end, k + 1
        old = text[low:high].split("\n")
        new = applied(text[low:high], [Edit(e.start - low, e.end - low, e.text) for e in group]).split("\n")
        pairs = list(zip(old, new + [None] * (len(old) - len(new)), strict=False))
        out += [(number + i, a, b) for i, (a, b) in enumerate(pairs) if a != b]
    return out
