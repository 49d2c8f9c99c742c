"""The scan as a plain Python loop, written from the stated semantics."""

import math
import re

from veilscan.rules import CATALOGUE

HARMLESS = [
    "ivborw0kggoaaaansuheugaa",
    "data:image/png;base64",
    "0123456789abcdefabcdef",
    "exampletoken123456789",
    "your_api_key_here",
    "replace_with_your_key",
]


def rule_matches(line, catalogue=CATALOGUE):
    out = []
    for name, pattern, *_ in catalogue:
        for m in re.finditer(pattern, line):
            token = m.group(m.lastindex) if m.groups() else m.group(0)
            out.append((name, token, m.start(), m.end()))
    return out


def entropy(s):
    total = 0.0
    for c in dict.fromkeys(s):
        p = s.count(c) / len(s)
        total -= p * math.log2(p)
    return total


def runs(line):
    start = None
    for i, c in enumerate(line + "\n"):
        if c.isalnum() or c in "_-+=/.":
            start = i if start is None else start
        elif start is not None:
            yield line[start:i], start, i
            start = None


def entropy_matches(line, threshold=4.0, least=20):
    out = []
    for token, s, e in runs(line):
        if least <= len(token) <= 200 and entropy(token) >= threshold:
            if not any(h in token.lower() for h in HARMLESS):
                out.append((token, s, e))
    return out


def scan_text(text):
    found, seen = [], set()
    for n, line in enumerate(text.split("\n"), 1):
        for name, token, s, _ in rule_matches(line):
            found.append((n, s, name, token))
            seen.add((n, token))
    for n, line in enumerate(text.split("\n"), 1):
        for token, s, _ in entropy_matches(line):
            if (n, token) not in seen:
                seen.add((n, token))
                found.append((n, s, "HIGH_ENTROPY", token))
    return found
