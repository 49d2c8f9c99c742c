"""Rewrite a Python regular expression so that Java's engine means the same."""

from __future__ import annotations

import re
from re import _parser as sre

# What Python's \s accepts, as the body of a character class.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = r"\p{L}\p{N}_"
CLASS_BODY = {"s": SPACE, "d": r"\p{Nd}", "w": WORD}
BOUNDARY = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"


def java_pattern(pattern: str, flags: bool = True) -> str:
    """Java form of a Python ``str`` pattern applied to one line.

    Shorthand classes become Unicode classes, ``(?i)`` becomes Unicode case
    folding, and ``.`` excludes only the newline.
    """
    out, i, in_class = [], 0, False
    if pattern.startswith("(?i)"):
        out.append("(?iu)")
        i = 4
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append(_escape(pattern[i + 1], in_class))
            i += 2
            continue
        if in_class:
            if c == "]" and not first:
                in_class = False
            elif c in "[&]":
                c = "\\" + c
            first = False
        elif c == "[":
            in_class, first = True, True
            if pattern[i + 1 : i + 2] == "^":
                c = "[^"
                i += 1
        elif pattern.startswith("(?P<", i):
            c = "(?<"
            i += 3
        elif re.match(r"\(\?[aiLmsux-]+[:)]|\(\?P=|\(\?\(", pattern[i:]):
            raise ValueError("inline flags, named references and conditionals are not supported here")
        out.append(c)
        i += 1
    return ("(?d)" if flags else "") + "".join(out)


def _escape(letter: str, in_class: bool) -> str:
    if letter in "sdw":
        body = CLASS_BODY[letter]
        return body if in_class else f"[{body}]"
    if letter in "SDW":
        if in_class:
            raise ValueError(f"\\{letter} inside a character class is not supported")
        return f"[^{CLASS_BODY[letter.lower()]}]"
    if not in_class and letter in "bB":
        return BOUNDARY if letter == "b" else f"(?!{BOUNDARY})"
    if letter == "A" and not in_class:
        return "^"
    if letter == "Z" and not in_class:
        return r"\z"
    return "\\" + letter


def token_group(pattern: str) -> int:
    """Which group holds the token: the last one, or 0 if there is none.

    A group that may stay unmatched, or that sits inside another, would make
    "last" depend on the match, so such a pattern is refused; so is one that
    can match nothing.
    """
    tree = sre.parse(pattern)
    if tree.getwidth()[0] == 0:
        raise ValueError("a rule must not match the empty string")
    count = tree.state.groups - 1
    if count:
        always = [arg[0] for op, arg in tree if str(op) == "SUBPATTERN" and arg[0] is not None]
        if always != list(range(1, count + 1)):
            raise ValueError("capture groups must be neither optional, alternative nor nested")
    return count
