"""Language identification by hyperdimensional profiles.

Every letter has a random vector of ``DIMS`` signs, drawn from its code point.
An n-gram's vector binds its letters: the first one rotated twice, the second
once, and the third multiplied element by element.  A text's vector bundles
(sums) those of its n-grams; a language's prototype bundles the unit vectors of
its training texts.  A text gets the language whose prototype has the largest
cosine with it.

Texts are folded to lower case, and what stands between words counts as one
blank letter.  A batch is counted as a table of texts by n-grams, so its
vectors are one matrix product.

The prototypes are fitted to a bounded sample: of each language about
``SAMPLE`` training rows at most, chosen by a hash of the whole row.  Their sums
are whole numbers, so prototypes do not depend on the order in which tasks end.
The table of prototypes has one row per language, and more than
``MOST_LANGUAGES`` are an error.  Prediction covers every row.

Where texts of no language shall go, ``recognised`` drops those without letters,
by a null and not by a name, and those whose score is below a limit learned from
labelled texts of the predicted language (``score_limits``).

Edge cases: a text that is null or has no letters is ``und`` with score 0;
without any training text everything is ``und``; of equal cosines the first
language in alphabetical order wins; repeated rows give equal rows; rows with
null doc_id are never held out; an empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, stored

DIMS = 1024
GRAM = 3
SCALE = 1 << 20
SAMPLE = 8192
MOST_LANGUAGES = 10_000
UNKNOWN = "und"
TEXT_CHARS = 1 << 19
#: Score limits are for texts of at least so many letters, as a power of 2: shorter ones score no better than noise.
LEAST_SIZE = 6
#: A limit learned from n rows counts for n / (n + this) of what is used: that of all languages against
#: none at all, that of a language against that of all, that of a language and size against the language's.
ROWS_OF_ALL, ROWS_OF_ONE = 50, 1000
#: One labelled text in so many is kept from the prototypes that limits are learned with.
BACK = 4
#: The quantile of their scores that counts, and the part of it that is the limit.
LOWEST, MARGIN = 0.001, 0.8
#: Texts taken from Arrow at a time.
ROWS = 1000
BLOCK_GRAMS = 4096
#: With more letters than this in a block, n-grams are sorted instead of counted in a dense table.
DENSE_LETTERS = 150


class Letters:
    """Which code points are letters, and the sign vectors of those met so far."""

    def __init__(self) -> None:
        self.is_letter = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool)

    @staticmethod
    def signs(codes: np.ndarray, dims: int) -> np.ndarray:
        """A row of -1 and 1 for each code point."""
        grid = codes.astype(np.uint64)[:, None] * np.uint64(1 << 32) + np.arange(dims // 64, dtype=np.uint64)
        bits = np.unpackbits(np.ascontiguousarray(mix(mix(grid))).view(np.uint8), axis=1)
        return bits.astype(np.int8) * 2 - 1

    def grams(self, grams: np.ndarray, dims: int) -> np.ndarray:
        """The bound vector of each n-gram, given as rows of code points."""
        out = np.ones((len(grams), dims), np.int8)
        for k in range(grams.shape[1]):
            codes, at = np.unique(grams[:, k], return_inverse=True)
            turned = np.roll(self.signs(codes, dims), grams.shape[1] - 1 - k, axis=1)
            out *= turned[at]
        return out


LETTERS: list[Letters] = []


def letters() -> Letters:
    if not LETTERS:
        LETTERS.append(Letters())
    return LETTERS[0]


def normal_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts end to end, words apart by one blank (0), and the row of each."""
    known = letters()
    raw = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    codes = np.concatenate(raw) if raw else np.zeros(0, np.uint32)
    row = np.repeat(np.arange(len(texts)), [len(r) for r in raw])
    codes = np.where(known.is_letter[codes], codes, 0)
    blank = codes == 0
    keep = ~blank
    keep[1:] |= blank[1:] & ((~blank[:-1]) | (row[1:] != row[:-1]))
    keep[:1] = True
    return codes[keep], row[keep]


def gram_counts(texts: list[str], gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams (rows of code points), then ``row, gram, count`` triples.

    A text is taken with a blank before and after it; an n-gram of blanks alone
    does not count, so a text without letters has none.
    """
    codes, row = normal_codes([f" {t} " for t in texts])
    if len(codes) < gram:
        return np.zeros((0, gram), np.uint32), *(np.zeros(0, np.int64),) * 3
    alphabet, small = np.unique(codes, return_inverse=True)
    n = len(codes) - gram + 1
    value = np.zeros(n, np.int64)
    for k in range(gram):
        value = value * len(alphabet) + small[k : k + n]
    inside = row[:n] == row[gram - 1 :]
    some = np.zeros(n, bool)
    for k in range(gram):
        some |= codes[k : k + n] != 0
    use = inside & some
    value, at = value[use], row[:n][use]
    if len(alphabet) <= DENSE_LETTERS:
        there = np.bincount(value, minlength=len(alphabet) ** gram) > 0
        distinct = np.flatnonzero(there)
        number = np.cumsum(there) - 1
        which = number[value]
    else:
        which, distinct = pd.factorize(value)
    pair, times = np.unique(at * max(1, len(distinct)) + which, return_counts=True) if len(value) else (value, value)
    grams = np.empty((len(distinct), gram), np.uint32)
    rest = distinct
    for k in range(gram - 1, -1, -1):
        grams[:, k] = alphabet[rest % len(alphabet)]
        rest = rest // len(alphabet)
    return grams, pair // max(1, len(distinct)), pair % max(1, len(distinct)), times


def vectors(texts: list[str], dims: int = DIMS, gram: int = GRAM) -> np.ndarray:
    """The bundled vector of each text; zeros where it has no letters."""
    grams, row, which, times = gram_counts(texts, gram)
    out = np.zeros((len(texts), dims), np.float32)
    order = np.argsort(which, kind="stable")
    row, which, times = row[order], which[order], times[order]
    for lo in range(0, len(grams), BLOCK_GRAMS):
        a, b = np.searchsorted(which, [lo, lo + BLOCK_GRAMS])
        used, local = np.unique(row[a:b], return_inverse=True)
        bound = letters().grams(grams[lo : lo + BLOCK_GRAMS], dims).astype(np.float32)
        for first in range(0, len(used), 512):
            mine = (local >= first) & (local < first + 512)
            counts = np.zeros((min(512, len(used) - first), len(bound)), np.float32)
            counts[local[mine] - first, which[a:b][mine] - lo] = times[a:b][mine]
            out[used[first : first + 512]] += counts @ bound
    return out


def text_blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > TEXT_CHARS:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def held_out(doc_id: Column) -> Column:
    """One document in four is kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled(rows: DataFrame, most: int) -> DataFrame:
    """``text, lang`` of about ``most`` rows of each language, or all where there are fewer."""
    counts = stored(rows.groupBy("lang").count(), "languages")
    if counts.count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    shares = counts.select("lang", (F.lit(float(most)) / F.col("count")).alias("share"))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.join(F.broadcast(shares), "lang").where(draw < F.col("share")).select("text", "lang")


def trained(docs: DataFrame, sample: int = SAMPLE, dims: int = DIMS, gram: int = GRAM) -> dict[str, np.ndarray]:
    """The unit prototype of each language in ``docs(doc_id, text, lang)``, from rows that have text and lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in (b.slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS)):
            texts, names = batch["text"].to_pylist(), np.array(batch["lang"].to_pylist(), object)
            for lo, hi in text_blocks(texts):
                made = vectors(texts[lo:hi], dims, gram).astype(np.float64)
                size = np.linalg.norm(made, axis=1, keepdims=True)
                unit = np.rint(made / np.maximum(size, 1e-9) * SCALE).astype(np.int64)
                for name in set(names[lo:hi]):
                    rows = (names[lo:hi] == name) & (size[:, 0] > 0)
                    if rows.any():
                        sums[name] = sums.get(name, 0) + unit[rows].sum(axis=0)
        if sums:
            yield pa.record_batch({"lang": list(sums), "parts": pa.array([s.tolist() for s in sums.values()], pa.list_(pa.int64()))})

    rows = sampled(docs.select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL"), sample)
    parts = rows.mapInArrow(run, "lang string, parts array<long>").select("lang", F.posexplode("parts").alias("at", "part"))
    found = stored(parts.groupBy("lang", "at").agg(F.sum(F.col("part").cast("decimal(38,0)")).cast("double").alias("part")), "prototypes")
    out: dict[str, np.ndarray] = {}
    for row in found.collect():  # languages times dimensions
        out.setdefault(row.lang, np.zeros(dims))[row.at] = row.part
    return {name: out[name] / np.linalg.norm(out[name]) for name in sorted(out) if np.any(out[name])}


def predicted(docs: DataFrame, prototypes: dict[str, np.ndarray], dims: int = DIMS, gram: int = GRAM, unknown: str | None = UNKNOWN) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` after its columns; columns of these names are replaced.

    Texts without letters are named ``unknown``; with None they differ from every learned label.
    """
    names = np.array([*prototypes, unknown], object)
    table = np.array([*prototypes.values()]).T if prototypes else None
    docs = docs.drop("lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS)):
            texts = pc.fill_null(batch["text"], "").to_pylist()
            best, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
            for lo, hi in text_blocks(texts) if table is not None else ():
                made = vectors(texts[lo:hi], dims, gram).astype(np.float64)
                size = np.linalg.norm(made, axis=1)
                near = made @ table / np.maximum(size, 1e-9)[:, None]
                has = size > 0
                best[lo:hi][has] = near.argmax(axis=1)[has]
                score[lo:hi][has] = np.clip(near.max(axis=1), 0, 1)[has]
            yield pa.record_batch([*batch.columns, pa.array(names[best], pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double")


def size_class(column: str = "text") -> Column:
    """The whole part of the binary logarithm of a text's number of letters; null if there are none."""
    return F.floor(F.log2(F.length(F.regexp_replace(column, r"\P{L}+", "")))).cast("int")


def held_back() -> Column:
    """Texts that limits are learned from; equal texts are on one side."""
    return F.pmod(F.xxhash64("text"), F.lit(BACK)) == 0


def score_limits(docs: DataFrame, sample: int = SAMPLE) -> dict[tuple[str | None, int | None], float]:
    """The score below which a text of at least ``2**LEAST_SIZE`` letters has no language, by language and size.

    Prototypes are learned from part of the labelled rows of ``docs``, and the
    rest tells how well texts score that they were not made from.  Of those told
    rightly the quantile ``LOWEST`` counts, for all rows, by language, and by
    language and size.  Few rows say little of a quantile, so each is drawn
    towards the coarser one by its number of rows, and that of all rows towards
    zero; ``MARGIN`` of the outcome is the limit.  Keys with a None are the
    coarser limits, for what has none of its own.
    """
    labelled = docs.select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    prototypes = trained(labelled.where(~held_back()), sample)
    rows = sampled(labelled.where(held_back()), sample)
    told = predicted(rows, prototypes, unknown=None).where(F.col("lang") == F.col("lang_pred"))
    told = told.select("lang_pred", size_class().alias("size"), "score").where(F.col("size") >= LEAST_SIZE)
    found = told.rollup("lang_pred", "size").agg(
        F.count("*").alias("n"), F.percentile_approx("score", LOWEST, 10_000).alias("low"), F.grouping_id().alias("over")
    )
    # Languages times classes of size; the coarsest first.
    limits: dict[tuple[str | None, int | None], float] = {(None, None): 0.0}
    for row in sorted(found.collect(), key=lambda r: -r.over):
        if row.low is not None:
            coarser = limits[None if row["size"] is None else row.lang_pred, None]
            trust = ROWS_OF_ALL if row.lang_pred is None else ROWS_OF_ONE
            limits[row.lang_pred, row["size"]] = (row.n * row.low + trust * coarser) / (row.n + trust)
    return {key: limit * MARGIN for key, limit in limits.items()}


def recognised(docs: DataFrame, prototypes: dict[str, np.ndarray], limits: dict[tuple[str | None, int | None], float]) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, without texts that have no letters or score below their limit."""
    told = predicted(docs, prototypes, unknown=None).where("lang_pred IS NOT NULL")
    by_language: dict[str, dict[int, float]] = {}
    for (name, size_of), limit in limits.items():
        if name is not None:
            by_language.setdefault(name, {})[-1 if size_of is None else size_of] = limit
    schema = "limit_lang string, limit_of map<int, double>"
    table = F.broadcast(told.sparkSession.createDataFrame([*by_language.items()], schema))
    joined = told.join(table, F.col("lang_pred") == F.col("limit_lang"), "left")
    size = size_class()
    limit = F.coalesce(F.col("limit_of")[size], F.col("limit_of")[F.lit(-1)], F.lit(limits[None, None]))
    return joined.where(~F.coalesce((size >= LEAST_SIZE) & (F.col("score") < limit), F.lit(False))).select(*told.columns)


def identified(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of ``docs(doc_id, text, lang)``, learned from those not held out."""
    marked = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    prototypes = trained(marked.where("NOT held_out"))
    return predicted(marked.select("doc_id", "held_out", "text"), prototypes).drop("text")
