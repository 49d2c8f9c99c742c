"""Personal data: plain rules, and spans proposed by generators and chosen by boosted trees.

The plain rules find e-mail addresses, IP addresses, card and phone numbers of
the usual form; what they find always stays.  Beside them generators with high
recall propose overlapping spans: addresses spelled out ("a at b dot org"),
dotted quads made harmless ("10[.]0[.]0[.]1"), digits in groups with other
separators, numbers without a country sign.  Boosted trees score a proposal by
its form and its context, and it is kept beyond a threshold calibrated for its
kind.

Nobody labelled the corpus, so the trees learn from the plain rules: positives
are plain spans rewritten into forms that the rules miss (and IPv6 addresses in
place of plain ones), in their own context; negatives are plain spans broken on
purpose (a wrong check digit, an octet of 300, a hardware address, a date, an
order number), and proposals of the corpus that overlap no plain span and fail
the form check of their kind (``likely``).  Proposals that pass it may be what
the plain rules miss: they are neither positives nor negatives.  Beside those of
the corpus, ``INVENTED`` made-up spans of each kind are rewritten and broken in
the same way, so that every kind has examples in any table.  Two thirds of the
made-up spans and of all distinct texts fit the trees; on the rest a threshold
per kind is set where, of the proposals beyond it, ``PRECISION`` are right.
Every example counts: equal ones are a row with their number, and trees and
thresholds need no more than sums over these rows.  Up to ``HELD`` rows the
driver takes the sums itself, beyond that Spark jobs take the same ones.

Every text is searched whole, with expressions that need time in proportion to
its length.

Edge cases: a null text is empty and has no spans; positions are code points,
ends exclusive; equal rows give equal rows; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..session import checkpointed
from .boosting import WIDTH, Held, Model, Tree, binned, boosted, cut_points, first_margin, sigmoid
from .common import whole_text

KINDS = ("email", "ip", "card", "phone")
#: Distinct rows of binned examples up to which the driver takes the sums; beyond, Spark does.
HELD = 60_000
PRECISION = 0.98
#: Steps of the margin in which thresholds are set, to a unit.
STEPS = 256
#: Made-up spans of each kind to learn from, whatever the table.
INVENTED = 500

Span = tuple[int, int, int]  # start, end, kind

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Digits before the start would have been part of an earlier match, or of a failed one that fails here too.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def small(part: str) -> bool:
    """Whether a run of digits is at most 255."""
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def emails(text: str) -> Iterator[Span]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            yield start, free, 0
        at = text.find("@", max(at + 1, free))


def plain_spans(text: str) -> list[Span]:
    """What the plain rules find, by start and kind."""
    found = list(emails(text)) if "@" in text else []
    if DIGIT.search(text):
        found += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(map(small, m[0].split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(digits := NO_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
        found += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 9 <= len(NO_DIGIT.sub("", m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], s[2]))


EDGE, END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
SPELLED = re.compile(
    r"(?<![\w.%+-])[\w.%+-]{1,64}"
    r"(?: ?(?:@|\(at\)|\[at\]|\{at\}) ?[\w-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}| dot ) ?[\w-]{1,63}){1,4}"
    r"| at [\w-]{1,63}(?: dot [\w-]{1,63}){1,4})(?![\w-])",
    re.IGNORECASE,
)
SPELLED_SIGNS = re.compile(r"@|\bdot\b|[(\[{]at[)\]}]", re.IGNORECASE)
QUAD = re.compile(EDGE + r"[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|\[dot\]|[.,_-]) ?[0-9]{1,3}){3}" + END)
SIXES = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
SHORTENED = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])")
GROUPS = re.compile(EDGE + r"[0-9]{3,6}(?:[ ._/-]?[0-9]{2,6}){2,5}" + END)
NUMBER = re.compile(r"(?<![0-9A-Za-z+])(?:00)?\(?[0-9]{2,4}\)?(?:[ ./-]?\(?[0-9]{2,4}\)?){1,6}" + END)


def proposals(text: str) -> list[Span]:
    """Spans that may be personal data; they may overlap."""
    found: set[Span] = set()
    if SPELLED_SIGNS.search(text):
        found |= {(m.start(), m.end(), 0) for m in SPELLED.finditer(text)}
    if DIGIT.search(text):
        found |= {(m.start(), m.end(), 1) for p in (QUAD, SIXES, SHORTENED) for m in p.finditer(text)}
        for pattern, kind, least, most in ((GROUPS, 2, 12, 19), (NUMBER, 3, 7, 15)):
            for m in pattern.finditer(text):
                if least <= len(NO_DIGIT.sub("", m[0])) <= most:
                    found.add((m.start(), m.end(), kind))
    return sorted(found)


#: Words of the context that speak for a kind, in the languages at hand.
WORDS = (
    re.compile(r"mail|contact|write|schreib|correo|courriel", re.IGNORECASE),
    re.compile(r"\bip\b|server|host|addr|login|client", re.IGNORECASE),
    re.compile(r"card|visa|credit|karte|tarjeta|carte|payment", re.IGNORECASE),
    re.compile(r"phone|tel|call|mobil|fax|anruf|llam|appel", re.IGNORECASE),
    re.compile(r"token|key|secret|hash|id\b|version|order|isbn|date|price|no\.", re.IGNORECASE),
)
AT = re.compile(r"@|\bat\b|[(\[{]at[)\]}]", re.IGNORECASE)
DOT = re.compile(r"\bdot\b|\[\.\]|\(\.\)", re.IGNORECASE)
DATE = re.compile(r"^(?:[0-3]?[0-9][./ -][01]?[0-9][./ -](?:19|20)?[0-9]{2}|(?:19|20)[0-9]{2}[./ -][01]?[0-9][./ -][0-3]?[0-9])$")


#: At its start an address with a whole last label; a point with a blank on one side ends a sentence.
ADDRESS = re.compile(
    r"[\w.%+-]*\w[\w.%+-]*(?: ?(?:@|[(\[{]at[)\]}]) ?| at )[\w-]+"
    r"(?:(?:\.| \. | ?[(\[{]dot[)\]}] ?| dot )[\w-]+)*?(?:\.| \. | ?[(\[{]dot[)\]}] ?| dot )[^\W\d_]{2,24}(?![\w-])",
    re.IGNORECASE,
)
#: Four parts between equal marks; a blank on one side of a mark makes a list.
FOUR = re.compile(r"([0-9]+)( ?(?:\[\.\]|\(\.\)|\[dot\]) ?| [._-] |[.,_-])([0-9]+)\2([0-9]+)\2([0-9]+)", re.IGNORECASE)
#: What may be a number beside words of telephony, and what may be one anywhere.
DIALLED = re.compile(r"[0(].*|[0-9]{2,4}(?:[ ./-][0-9]{2,4}){2,}|[0-9]{3}[ .-][0-9]{4}|[0-9]{10,11}")
NATIONAL = re.compile(r"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|00[1-9][0-9]{8,12}|0[1-9][0-9]{1,3}[ /-][0-9]{6,8}")


def well_formed(own: str, kind: int) -> bool:
    """Whether a proposal by itself has the whole form of its kind."""
    if kind == 0:
        return bool(ADDRESS.match(own))
    if kind == 1:
        if "::" in own:
            return 3 <= len([g for g in own.split(":") if g]) <= 7 and bool(DIGIT.search(own))
        if ":" in own:
            return own.count(":") == 7
        parts = FOUR.fullmatch(own)
        return bool(parts) and all(map(small, parts.group(1, 3, 4, 5)))
    if kind == 2:
        return luhn(NO_DIGIT.sub("", own))
    return bool(NATIONAL.fullmatch(own)) and not DATE.match(own)


def likely(text: str, span: Span) -> bool:
    """Whether a proposal may be personal data that the plain rules miss, so that it is no negative."""
    start, end, kind = span
    own = text[start:end]
    if kind < 3:
        return well_formed(own, kind)
    before = text[max(0, start - 40) : start]
    if WORDS[3].search(before):
        return bool(DIALLED.fullmatch(own)) and not DATE.match(own)
    return well_formed(own, kind) and not WORDS[4].search(before)


def form(c: str) -> int:
    """Class of the character beside a span."""
    if not c:
        return 0
    return 1 if c.isspace() else 2 if c.isalnum() else 3 if c in "\"'=<>" else 4


def features(text: str, span: Span) -> list[float]:
    """Numbers that describe a proposal's form and context."""
    start, end, kind = span
    own = text[start:end]
    digits = NO_DIGIT.sub("", own)
    groups = [len(g) for g in re.findall("[0-9]+", own)]
    marks = re.findall(r"[^0-9A-Za-z]+", own)
    before, after = text[max(0, start - 40) : start], text[end : end + 20]
    letters = sum(c.isalpha() for c in own)
    return [
        *(float(kind == k) for k in range(len(KINDS))),
        len(own),
        len(digits),
        letters,
        len(marks),
        len(set(marks)),
        len(groups),
        max(groups, default=0),
        min(groups, default=0),
        float(len(set(groups)) <= 2),
        float("(" in own),
        float(own[:1] == "0"),
        float(own[:2] == "00"),
        float(bool(AT.search(own))),
        len(DOT.findall(own)),
        float(" " in own),
        float(luhn(digits)) if 12 <= len(digits) <= 19 else -1.0,
        float(sum(map(small, re.findall("[0-9]+", own)))),
        float(bool(DATE.match(own))),
        float(well_formed(own, kind)),
        len(own.rsplit(".", 1)[-1].split()[-1]) if own.split() else 0,
        form(before[-1:]),
        form(after[:1]),
        *(float(bool(w.search(before))) for w in WORDS),
        float(bool(DIGIT.search(before[-6:]))),
        float(bool(DIGIT.search(after[:6]))),
    ]


class Taken:
    """Places of a text that are taken, as intervals that do not overlap."""

    def __init__(self, spans: list[Span] = ()) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end, _ in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def free(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end)
        return at == 0 or self.ends[at - 1] <= start

    def take(self, start: int, end: int) -> None:
        """Take a place that is free."""
        at = bisect_left(self.starts, start)
        self.starts.insert(at, start)
        self.ends.insert(at, end)


def rewritten(own: str, kind: int, rng: random.Random) -> str:
    """A plain span in a form that the plain rules miss."""
    if kind == 0:
        local, _, domain = own.partition("@")
        at, dot = rng.choice(((" at ", " dot "), ("(at)", "."), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" @ ", "."), ("{at}", " dot ")))
        return local + at + domain.replace(".", dot)
    digits = NO_DIGIT.sub("", own)
    if kind == 1:
        mark = rng.choice(("[.]", "(.)", "[dot]", " . ", ":"))
        if mark != ":":
            return own.replace(".", mark)
        groups = [f"{rng.randrange(1 << 16):x}" for _ in range(8)]
        first, last = rng.randint(2, 4), rng.randint(1, 3)
        return ":".join(groups) if rng.randrange(2) else f"{':'.join(groups[:first])}::{':'.join(groups[-last:])}"
    if kind == 2:
        mark = rng.choice((".", "/", "_"))
        if len(digits) == 15 and rng.randrange(2):
            return mark.join((digits[:4], digits[4:10], digits[10:]))
        return mark.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    area, middle, last, mark = digits[-10:-7], digits[-7:-4], digits[-4:], rng.choice("-. ")
    return rng.choice(("00" + digits, f"({area}) {middle}-{last}", mark.join((area, middle, last)), f"0{area}{rng.choice(' /-')}{middle}{last}"))


#: What stands before numbers that have the form of a telephone number and are none.
OTHER_NUMBERS = ("order no. ", "version ", "isbn ", "id ", "price ", "token ")


def broken(own: str, kind: int, rng: random.Random) -> tuple[str | None, str]:
    """Something of a similar form that is no personal data, and what to put before it instead of its context."""
    digits = NO_DIGIT.sub("", own) or "0"
    if kind == 0:
        local, _, domain = own.partition("@")
        name, a, b = domain.split(".")[0], rng.randrange(100), rng.randrange(100)
        return None, rng.choice((f"{local} @ {name}. The", f"{local} @ {a}.{b}", f"{local} at {a} dot {b}", f"{local}(at){name}.{a}", f"{a} @ {b}.{a}.{b}"))
    if kind == 1:
        other = rng.randrange(7)
        if other == 6:  # names of a program, parts of a time
            return None, "::".join(rng.choice(("a", "bad", "face", "dec", "add", "12", "30")) for _ in range(2))
        if other == 0:  # a hardware address, a time
            n = rng.randint(4, 6)
            return None, ":".join(f"{rng.randrange(256 if n == 6 else 60):02{'x' if n == 6 else 'd'}}" for _ in range(n))
        if other == 1:  # a list
            return None, ", ".join(str(rng.randrange(256)) for _ in range(4))
        parts = own.split(".")
        parts[rng.randrange(4)] = str(rng.randint(256, 999))
        return None, rng.choice(("[.]", "(.)", "[dot]", " . ", ".", "-")).join(parts)
    if kind == 2:
        if not rng.randrange(3):  # other groups, whatever the check digit
            return None, rng.choice("./_").join(str(rng.randrange(10 ** (n - 1), 10**n)) for n in rng.choice(((3, 5, 2, 6), (3, 2, 4, 2, 5), (6, 2, 6), (5, 3, 5), (3, 3, 3, 3))))
        digits = digits[:-1] + str((int(digits[-1]) + rng.randint(1, 9)) % 10)
        return None, rng.choice((".", "/", "_", " ", "")).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    year, month, day = rng.randint(1950, 2030), rng.randint(1, 12), rng.randint(1, 28)
    if not rng.randrange(3):
        return rng.choice(OTHER_NUMBERS), rewritten(own, kind, rng)
    return None, rng.choice((f"{year}-{month:02}-{day:02}", f"{day:02}.{month:02}.{year}", str(rng.randint(10**6, 10**11)), f"{rng.randint(10, 99)}-{digits[:5]}"))


def examples(text: str) -> list[tuple[list[float], int, int]]:
    """Training rows of a text: features, kind and label."""
    plain, out = plain_spans(text), []
    taken = Taken(plain)
    for span in proposals(text):
        # What has the form of personal data may be what the plain rules miss.
        if taken.free(span[0], span[1]) and not likely(text, span):
            out.append((features(text, span), span[2], 0))
    rng = random.Random(hashlib.md5(text.encode("utf-8", "replace")).digest())
    for start, end, kind in plain:
        for label in (1, 1, 0, 0):
            context, own = (None, rewritten(text[start:end], kind, rng)) if label else broken(text[start:end], kind, rng)
            if context is None:
                context = text[max(0, start - 40) : start]
            made = context + own + text[end : end + 20]
            at = len(context)
            # Only what the generators would propose can be scored later.
            for span in proposals(made):
                if span[2] == kind and span[0] < at + len(own) and at < span[1] and (not label or (span[0] <= at and at + len(own) <= span[1])):
                    out.append((features(made, span), kind, label))
    return out


# What stands before and after made-up spans: words for a kind, then words for none.
CUES = (("please write to ", "mail: "), ("the server at ", "login from ip "), ("paid by card ", "visa "), ("call ", "phone: "))
NEUTRAL = ("", "and then ", "we have ", "it was ", "(", "see ")
AFTER = ("", ".", " and more", ", thanks", ") is here", " now")


def invented(number: int = INVENTED) -> list[str]:
    """Short texts with a made-up plain span each, ``number`` of every kind."""
    rng, out = random.Random(11), []
    for i in range(number):
        word = "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(3, 9)))
        digits = str(rng.randint(2, 6)) + "".join(str(rng.randrange(10)) for _ in range(rng.choice((13, 14, 14))))
        card = next(digits + str(d) for d in range(10) if luhn(digits + str(d)))
        mark = rng.choice(("", " ", "-"))
        own = (
            f"{word}{rng.choice(('', '.x', str(i)))}@{word[::-1]}.{rng.choice(('com', 'org', 'net', 'co.uk', 'de'))}",
            ".".join(str(rng.randrange(256)) for _ in range(4)),
            mark.join(card[k : k + 4] for k in range(0, len(card), 4)),
            f"+{rng.randint(1, 99)}{rng.choice(' -')}{rng.randint(200, 999)}{rng.choice(' -')}{rng.randint(200, 999)}{rng.choice(' -')}{rng.randint(1000, 9999)}",
        )
        out += [rng.choice(CUES[k] if rng.randrange(2) else NEUTRAL) + own[k] + rng.choice(AFTER) for k in range(len(KINDS))]
    return out


@dataclass(frozen=True)
class Chooser:
    """Trees, and for each kind the score from which a proposal is kept."""

    model: Model | None
    limits: tuple[float, ...]

    def keep(self, rows: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.model is None or not len(rows):
            return np.zeros(len(rows), bool), np.zeros(len(rows))
        score = sigmoid(self.model.margin(rows))
        return score >= np.array(self.limits)[kinds], score


def calibrated(score: np.ndarray, right: np.ndarray, number: np.ndarray) -> float:
    """The lowest score from which on ``PRECISION`` of the examples are right; beyond 1 if there is none.

    ``right`` of the ``number`` examples at each score are right; no score comes twice.
    """
    order = np.argsort(-score, kind="stable")
    good = np.flatnonzero(np.cumsum(right[order]) >= PRECISION * np.cumsum(number[order]))
    return max(float(score[order][good[-1]]), 0.5) if len(good) else 2.0


def training_table(docs: DataFrame, sample: int | None = None) -> DataFrame:
    """The examples (``digest, number, x, kind, label, fold``) of all distinct texts of ``docs(text)``, or of about ``sample``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for digest, text in zip(batch["digest"].to_pylist(), batch["text"].to_pylist(), strict=True):
                made = examples(text) if digest not in seen else []
                seen.add(digest)
                if made:
                    fold = hashlib.md5(text.encode("utf-8", "replace")).digest()[0] % 3
                    yield pa.record_batch(
                        {
                            "digest": pa.array([digest] * len(made), pa.int64()),
                            "number": pa.array(range(len(made)), pa.int64()),
                            "x": pa.array([m[0] for m in made], pa.list_(pa.float64())),
                            "kind": pa.array([m[1] for m in made], pa.int64()),
                            "label": pa.array([m[2] for m in made], pa.int64()),
                            "fold": pa.array([fold] * len(made), pa.int64()),
                        }
                    )

    texts = docs.where("text IS NOT NULL").select("text", F.xxhash64("text").alias("digest"))
    if sample is not None:
        n = texts.select("digest").distinct().count()
        draw = F.pmod("digest", F.lit(1 << 30)) / F.lit(float(1 << 30))
        texts = texts.where(draw < sample / max(n, 1))
    made = texts.mapInArrow(run, "digest long, number long, x array<double>, kind long, label long, fold long")
    # Copies of a text in several tasks give equal rows.
    return made.distinct()


def some_rows(made: DataFrame, rows: int) -> DataFrame:
    # The order has nothing to do with what a row says.
    return made.orderBy(F.xxhash64("digest", "number"), "digest", "number").limit(rows)


def training_rows(docs: DataFrame, sample: int, rows: int) -> list[Row]:
    """At most ``rows`` examples of about ``sample`` distinct texts, to look at."""
    return some_rows(training_table(docs, sample), rows).collect()


def invented_rows() -> pa.Table:
    made = [(*e, i // len(KINDS) % 3) for i, text in enumerate(invented()) for e in examples(text)]
    x = pa.array([m[0] for m in made], pa.list_(pa.float64()))
    return pa.table({"x": x} | {c: pa.array([m[k] for m in made], pa.int64()) for k, c in ((1, "kind"), (2, "label"), (3, "fold"))})


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of equal length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def bin_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of bins, a byte each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def spread_sums(rows: DataFrame, start: float):
    """``Sums`` over rows ``bins, label, n`` of any number, by a job each; the driver gets one row per feature, node and bin."""

    def sums(trees: tuple[Tree, ...], tree: Tree, level: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0
            for batch in batches:
                if batch.num_rows:
                    label, n = (batch[c].to_numpy().astype(float) for c in ("label", "n"))
                    total = total + Held(bin_rows(batch["bins"]), label, n, start)(trees, tree, level)
            if np.ndim(total):
                g, h = total.reshape(2, -1)
                some = np.flatnonzero((g != 0) | (h != 0))
                yield pa.record_batch({"place": pa.array(some, pa.int64()), "g": pa.array(g[some]), "h": pa.array(h[some])})

        # Whole numbers below 2**53: their sums are the same in any order.
        made = rows.mapInArrow(run, "place long, g double, h double").groupBy("place").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
        out = np.zeros((2, len(FEATURES) * 2**level * WIDTH))
        out[:, made["place"].to_numpy()] = made["g"].to_numpy(), made["h"].to_numpy()
        return out.reshape(2, len(FEATURES), 2**level, WIDTH)

    return sums


FEATURES = range(len(features("0", (0, 1, 0))))


def fitted(own: DataFrame, held: int) -> Model:
    """Trees for the examples ``x, label, n``."""
    # All features are whole numbers of bounded size, so their values are few.
    values = own.select(F.posexplode("x").alias("f", "v"), "n").groupBy("f", "v").agg(F.sum("n").alias("n")).toArrow()
    f, v, n = (values[c].to_numpy() for c in ("f", "v", "n"))
    cuts = []
    for k in FEATURES:
        order = np.argsort(v[f == k])
        cuts.append(cut_points(v[f == k][order], n[f == k][order]))
    share = own.agg(F.sum(F.col("n") * F.col("label")) / F.sum("n")).first()[0]
    start = first_margin(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bins = pa.array([row.tobytes() for row in binned(matrix(batch["x"]), cuts)], pa.binary())
                yield pa.record_batch({"bins": bins, "label": batch["label"], "n": batch["n"]})

    rows = own.select("x", "label", "n").mapInArrow(run, "bins binary, label long, n long")
    rows = checkpointed(rows.groupBy("bins", "label").agg(F.sum("n").alias("n")))
    if rows.count() > held:
        return boosted(cuts, start, spread_sums(rows, start))
    all_rows = rows.toArrow()
    label, n = (all_rows[c].to_numpy().astype(float) for c in ("label", "n"))
    return boosted(cuts, start, Held(bin_rows(all_rows["bins"]), label, n, start))


def limits_of(model: Model, rest: DataFrame) -> tuple[float, ...]:
    """A threshold for each kind from the examples ``x, kind, label, n``, counted by steps of the margin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                margin = np.clip(model.margin(matrix(batch["x"])), -40, 40)
                step = pa.array(np.floor(margin * STEPS).astype(np.int64))
                yield pa.record_batch({"kind": batch["kind"], "step": step, "label": batch["label"], "n": batch["n"]})

    steps = rest.select("x", "kind", "label", "n").mapInArrow(run, "kind long, step long, label long, n long")
    right = F.sum(F.col("n") * F.col("label")).alias("right")
    told = steps.groupBy("kind", "step").agg(right, F.sum("n").alias("n")).toArrow()
    kind, step, right, n = (told[c].to_numpy() for c in ("kind", "step", "right", "n"))
    score = sigmoid(step / STEPS)
    return tuple(calibrated(score[kind == k], right[kind == k], n[kind == k]) for k in range(len(KINDS)))


def trained(docs: DataFrame, sample: int | None = None, rows: int | None = None, held: int = HELD) -> Chooser:
    """Fit on the examples of all distinct texts of ``docs(text)`` and on made-up spans.

    A caller may ask for about ``sample`` texts or at most ``rows`` examples.
    """
    made = training_table(docs, sample)
    if rows is not None:
        made = some_rows(made, rows)
    made = made.select("x", "kind", "label", "fold").unionByName(docs.sparkSession.createDataFrame(invented_rows()))
    # Equal examples are one row, so only different ones are kept.
    made = checkpointed(made.groupBy("x", "kind", "label", "fold").agg(F.count("*").alias("n")))
    model = fitted(made.where("fold > 0"), held)
    return Chooser(model, limits_of(model, made.where("fold = 0")))


def spans_of(texts: list[str], chooser: Chooser) -> list[tuple[list[Span], list[Span]]]:
    """For each text the plain spans, and all spans."""
    plain, rows, owner, spans = [], [], [], []
    for i, text in enumerate(texts):
        plain.append(plain_spans(text))
        if chooser.model is None:
            continue
        taken = Taken(plain[-1])
        for span in proposals(text):
            if taken.free(span[0], span[1]):
                rows.append(features(text, span))
                owner.append(i)
                spans.append(span)
    kept, score = chooser.keep(np.array(rows), np.array([s[2] for s in spans], np.int64))
    added: list[list[Span]] = [[] for _ in texts]
    places = [Taken() for _ in texts]
    for k in sorted(np.flatnonzero(kept).tolist(), key=lambda k: (-score[k], spans[k])):
        s, e, _ = spans[k]
        if places[owner[k]].free(s, e):
            places[owner[k]].take(s, e)
            added[owner[k]].append(spans[k])
    return [(p, sorted(p + a, key=lambda s: (s[0], s[2]))) for p, a in zip(plain, added, strict=True)]


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def text_batches(batches: Iterator[pa.RecordBatch], chooser: Chooser) -> Iterator[tuple[pa.RecordBatch, list[str], list[tuple[list[Span], list[Span]]]]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            texts = [t or "" for t in part["text"].to_pylist()]
            yield part, texts, spans_of(texts, chooser)


def found(docs: DataFrame, chooser: Chooser | None = None) -> DataFrame:
    """``doc_id``, how many plain spans of each kind, their digest, and all spans of ``docs(doc_id, text)``."""
    docs = docs.select("doc_id", whole_text().alias("text"))
    chooser = chooser or trained(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, spans in text_batches(batches, chooser):
            done = {"doc_id": part["doc_id"].cast(pa.int64())}
            for k, name in enumerate(KINDS):
                done[f"n_{name}"] = pa.array([sum(s[2] == k for s in plain) for plain, _ in spans], pa.int64())
            done["base_sha256"] = pa.array([hashlib.sha256(written(plain).encode()).hexdigest() for plain, _ in spans], pa.string())
            done["spans"] = pa.array([written(every) for _, every in spans], pa.string())
            yield pa.RecordBatch.from_pydict(done)

    counts = ", ".join(f"n_{name} long" for name in KINDS)
    return docs.mapInArrow(run, f"doc_id long, {counts}, base_sha256 string, spans string")


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span (overlapping ones as one) replaced by the name of its kind."""
    out, free = [], 0
    for start, end, kind in spans:
        if start >= free:
            out += [text[free:start], f"[{KINDS[kind].upper()}]"]
        free = max(free, end)
    return "".join([*out, text[free:]])


def redacted(docs: DataFrame, chooser: Chooser | None = None) -> DataFrame:
    """``docs`` with personal data masked in ``text``; a null text stays null."""
    chooser = chooser or trained(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts, spans in text_batches(batches, chooser):
            clean = [masked(t, every) for t, (_, every) in zip(texts, spans, strict=True)]
            column = pa.array([c if v else None for c, v in zip(clean, part["text"].is_valid().to_pylist(), strict=True)], pa.string())
            yield part.set_column(part.schema.get_field_index("text"), "text", column)

    return docs.mapInArrow(run, docs.schema)
