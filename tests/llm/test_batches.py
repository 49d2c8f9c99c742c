"""Known lines, Merkle proofs, periodic runs."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilscan.llm import linedups, manifest, periodic
from veilscan.llm.common import span_hashes

from .conftest import ROWS, SCHEMA


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# Lines


def line_key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip("\t\n\x0b\x0c\r "))


def lines_by_hand(rows):
    """``(doc_id, n_lines, n_dropped, text)`` of rows ``(doc_id, text)``."""
    order, first = lambda d: (d is not None, d or 0), {}
    for d, text in rows:
        for key in map(line_key, (text or "").split("\n")):
            if len(key) >= 10 and (key not in first or order(d) < order(first[key])):
                first[key] = d
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if first.get(line_key(x), d) == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(map(str, out))


def many_lines():
    rnd = random.Random(8)
    pool = [f"{a}{b}{c}" for a in ("", "  ", "\t") for b in ("Common line number 1", "common LINE number 1", "Straße É number 2", "short", "STRASSE é NUMBER 2") for c in ("", "\r", " \x0b")]
    pool += [f"line that is often here {k}" for k in range(30)] + ["", " ", "x" * 9, "x" * 10, "É" * 10, "é" * 10, "\x1cten chars\x1c"]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 12)))) for i in range(200)]
    rows += [(i, "Common line number 1\nown line of document %d" % i) for i in range(200, 320)]  # a third holds one line
    rows += [(7, "own line of document 7 again\nCommon line number 1"), (7, "own line of document 7 again\nCommon line number 1"), (None, "Common line number 1"), (None, None), (9, "")]
    return rows


@pytest.mark.parametrize("batches, fanout", [(1, 2), (4, 2), (9, 2), (7, 3)])
def test_lines_by_hand(spark, batches, fanout):
    rows = many_lines()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.lit("clash")).repartition(5)
    got = linedups.without_known_lines(docs, batches, fanout)
    assert sorted(str(tuple(r)) for r in got.collect()) == lines_by_hand(rows)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_runs_are_compacted(spark):
    runs = linedups.LineRuns(spark, fanout=2)
    for k in range(8):
        hashes = [(bytes([k % 5, x]), k) for x in range(20)]
        runs.add(spark.createDataFrame(hashes, "hash binary, doc long"))
    assert [len(names) for names in runs.levels] == [2, 1, 1]
    owned = {bytes(r.hash): r.doc for r in runs.owned().collect()}
    assert owned == {bytes([k, x]): k for k in range(5) for x in range(20)}
    held = [spark.table(n).count() for names in runs.levels for n in names]
    assert sum(held) == len(owned)
    runs.close()


def test_lines_of_odd_documents(spark, docs, no_docs):
    rows = [(r[0], r[1]) for r in ROWS]
    got = linedups.without_known_lines(docs)
    assert sorted(str(tuple(r)) for r in got.collect()) == lines_by_hand(rows)
    digests = {(r.doc_id, r.kept_sha256) for r in linedups.line_digests(docs).collect()}
    assert digests == {(r.doc_id, sha(r.kept_text)) for r in got.collect()}
    assert linedups.line_digests(no_docs).count() == 0


def test_lines_of_a_long_text(spark):
    rows = [(1, "\n".join(f"a line of a long text {k % 60000}" for k in range(90000))), (2, "a line of a long text 59999\nx\n" + " " * 500_000 + "y")]
    got = {r.doc_id: r for r in linedups.without_known_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_dropped == 0 and got[1].kept_text == rows[0][1]
    assert (got[2].n_lines, got[2].n_dropped, got[2].kept_text) == (3, 1, "x\n" + " " * 500_000 + "y")


# Merkle


def merkle_by_hand(rows):
    """One row per document: the columns of ``manifest.verified``."""

    def leaf(doc_id, text, lang, source, n_chars):
        parts = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
        return sha("".join("-" if p is None else f"{len(p.encode())}:{p}" for p in parts))

    def levels(hashes):
        out = [hashes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
        return out

    def climb(built, at, folded, proof):
        for level in built[:-1]:
            sibling = level[at ^ 1] if at ^ 1 < len(level) else ""
            folded, proof = sha(sibling + folded if at % 2 else folded + sibling), proof + sibling
            at //= 2
        return folded, proof

    langs = defaultdict(list)
    for r in rows:
        changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
        langs[r[2]].append((r[0], leaf(*r), leaf(*r[:4], r[4] + 1) if changed else leaf(*r)))
    for x in langs.values():
        x.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    order = sorted(langs, key=lambda k: (k is not None, (k or "").encode()))
    built = {k: levels([r[1] for r in langs[k]]) for k in order}
    high, out = levels([built[k][-1][0] for k in order]), []
    root = high[-1][0] if order else None
    for place, k in enumerate(order):
        for at, (doc_id, own, tampered) in enumerate(langs[k]):
            folded, proof = climb(high, place, *climb(built[k], at, tampered, ""))
            out.append((doc_id, own, built[k][-1][0], root, folded, sha(proof), folded == root))
    return sorted(map(str, out))


def shown(df):
    return sorted(str(tuple(r)) for r in df.select("doc_id", "leaf", "subroot", "root", "folded_root", "proof_sha256", "verified").collect())


@pytest.mark.parametrize("height", [1, 2, 10])
def test_proofs_by_hand(spark, monkeypatch, height):
    monkeypatch.setattr(manifest, "HEIGHT", height)
    sizes = {None: 1, "": 2, "de": 5, "en": 33, "é": 8}
    if height == 1:
        sizes = {None: 1, "de": 3, "en": 5}
    rows = [(k * 1000 + i, f"text {i}", lang, None if i % 5 == 0 else "s", None if i % 4 == 0 else i) for k, (lang, n) in enumerate(sizes.items()) for i in range(n)]
    docs = spark.createDataFrame(rows, SCHEMA + ", n_chars long").repartition(5)
    got = shown(manifest.verified(docs))
    assert got == merkle_by_hand(rows)
    assert any(x.endswith("False)") for x in got)


def test_proofs_of_odd_documents(spark, docs, no_docs):
    rows = [(*r, None if r[1] is None else len(r[1])) for r in ROWS]
    assert shown(manifest.verified(docs)) == merkle_by_hand(rows)
    assert manifest.verified(no_docs).count() == 0
    one = spark.createDataFrame([(0, "x" * 3_000_000, None, "s", 2**63 - 1)], SCHEMA + ", n_chars long")
    assert shown(manifest.verified(one)) == merkle_by_hand([(0, "x" * 3_000_000, None, "s", 2**63 - 1)])


def test_row_limit_of_recursion_is_put_back(spark, docs):
    before = spark.conf.get(manifest.ROW_LIMIT)
    manifest.verified(docs)
    assert spark.conf.get(manifest.ROW_LIMIT) == before


# Periodic runs


def runs_by_hand(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(6, 4 * q):
                found.setdefault((start, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed_by_hand(words):
    gone = {i for s, length, q in runs_by_hand(words) for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repetitive(n_texts=400):
    rnd, out = random.Random(5), []
    for _ in range(n_texts):
        letters = rnd.choice(["a", "ab", "abc", "abcdefgh"])
        n = rnd.randint(0, rnd.choice([10, 60, 300]))
        words = [rnd.choice(letters) for _ in range(n)]
        if n and rnd.random() < 0.6:
            p = rnd.randint(1, max(1, n // 4))
            words = [words[i % p] for i in range(n)]
            for _ in range(rnd.randint(0, 3)):
                words[rnd.randrange(n)] = rnd.choice(letters)
        out.append(words)
    return out


def test_transforms_count_mismatches():
    rng = np.random.default_rng(2)
    for size in (1, 2, 8, 64):
        block, window = rng.integers(0, 9, (5, size)), rng.integers(0, 9, (5, 2 * size))
        got = periodic.mismatches(block.astype(np.uint64), window.astype(np.uint64))
        want = [[((b - w[d : d + size]) ** 2).sum() for d in range(size)] for b, w in zip(block, window, strict=True)]
        assert got.tolist() == want
        assert periodic.restored(periodic.transformed(window.astype(np.uint64))).tolist() == window.tolist()


@pytest.mark.parametrize("cells", [4, 1 << 19])
def test_runs_by_hand(monkeypatch, cells):
    monkeypatch.setattr(periodic, "CELLS", cells)
    texts = repetitive()
    found = list(periodic.found_in(pa.array([" ".join(w) for w in texts]), lambda row, n: None))
    assert [own.tolist() for _, own, _ in found] == [list(map(list, runs_by_hand(w))) for w in texts]
    assert sum(len(own) for _, own, _ in found) > 200


def test_run_digests_by_hand(spark, docs, no_docs):
    rows = [(r[0], r[1]) for r in ROWS] + [(100 + i, "\n".join(w)) for i, w in enumerate(repetitive())]
    more = spark.createDataFrame(rows[len(ROWS) :], "doc_id long, text string").repartition(4)
    got = periodic.run_digests(docs.select("doc_id", "text").union(more)).collect()
    want = []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        words = [w.decode() for w in words]
        n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = runs_by_hand(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        milli = 1000 * best[1] // best[2] if runs else None
        listed = "".join("%d,%d,%d\n" % r for r in runs)
        want.append((doc_id, len(runs), *best, milli, sha(listed), sha(collapsed_by_hand(words))))
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want))
    assert periodic.run_digests(no_docs).count() == 0 == periodic.collapsed(no_docs).count()


def test_collapsed_texts(spark):
    rows = [(1, "x a b a b a b a b y"), (2, None), (3, " go  go go go\ngo go stop ")]
    got = {r.doc_id: r for r in periodic.collapsed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == "x a b y" and [tuple(r) for r in got[1].runs] == [(1, 8, 2)]
    assert got[2].text == "" and not got[2].runs and got[3].text == "go stop"


def test_long_texts_take_time_in_proportion(spark):
    n = 200_000
    rnd = random.Random(1)
    texts = ["a " * n, ("a " * (n // 9) + "b ") * 9, " ".join(rnd.choice("ab") for _ in range(n)), " ".join(str(i % (n // 5)) for i in range(n))]
    found = [own for _, own, _ in periodic.found_in(pa.array(texts), lambda row, n: None)]
    assert found[0].tolist() == [[0, n, 1]] and len(found[1]) == 10 and found[3].tolist() == [[0, n, n // 5]]


# The hash of words


@pytest.mark.parametrize("bits", [10, 11, 12, 13])
def test_thue_morse_words_differ(bits):
    word = np.array([97 + bin(i).count("1") % 2 for i in range(1 << bits)], np.uint8)
    both = np.concatenate([word, 195 - word])
    n = len(word)
    a, b = span_hashes(both, np.array([0, n]), np.array([n, 2 * n]))
    assert a != b
