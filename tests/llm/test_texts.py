"""Fingerprints, near-duplicates, repeats."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from veilscan.llm import fingerprints, linking, probminhash, repeats, suffixes
from veilscan.llm.common import mix
from veilscan.llm.shingles import shingle_hashes

from .conftest import ROWS, SCHEMA, prose


def grams(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def likeness(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x or y else 1.0


def test_shingles_are_word_runs():
    texts = ["", "a", "a b c d e", " a\tb c\nd e ", "a b c d e f"]
    raw = [t.encode() for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    found, rows = shingle_hashes(np.frombuffer(b"".join(raw), np.uint8), starts)
    assert np.diff(rows).tolist() == [0, 1, 1, 1, 2]
    assert found[rows[2]] == found[rows[3]] == found[rows[4]]


def test_fingerprints(docs, no_docs):
    got = fingerprints.fingerprinted(docs).collect()
    assert len(got) == len(ROWS)
    by_text = {}
    known = [r for r in ROWS if [x[0] for x in ROWS].count(r[0]) == 1 and r[0] is not None]
    for r in known:
        g = next(x for x in got if x.doc_id == r[0])
        assert g.n_chars == len(r[1] or "")
        assert by_text.setdefault(r[1] or "", g.fingerprint) == g.fingerprint
    one, two = (next(x for x in got if x.doc_id == k) for k in (1, 0))
    assert one.near_next == 1.0
    text, after = ROWS[1][1], ROWS[0][1]
    edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
    assert one.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert abs(one.near_edited - likeness(text, edited)) < 0.2
    assert two.fingerprint == one.fingerprint
    assert fingerprints.fingerprinted(no_docs).count() == 0


def test_the_last_row_is_followed_by_the_first(spark):
    rows = [(i, prose(i, 30 + i)) for i in range(40)]
    got = {r.doc_id: r for r in fingerprints.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    for i, text in rows:
        after = rows[(i - 1) % 40][1]
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(got[i].near_next - likeness(text, after)) < 0.2
    alone = fingerprints.fingerprinted(spark.createDataFrame(rows[:1], "doc_id long, text string")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def exact(a, b):
    (one, n), (two, m) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    x, y = dict(zip(one.tolist(), n.tolist(), strict=True)), dict(zip(two.tolist(), m.tolist(), strict=True))
    every = set(x) | set(y)
    return sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in every) for d in set(x) & set(y))


def test_sketches_estimate_probability_jaccard():
    rng, errors = np.random.default_rng(0), []
    for _ in range(40):
        a = mix(rng.integers(0, 40, int(rng.integers(1, 60))).astype(np.uint64))
        b = np.concatenate([a[: len(a) * 3 // 4 + 1], mix(rng.integers(0, 60, int(rng.integers(0, 20))).astype(np.uint64))])
        want = exact(a, b)
        assert probminhash.probability_jaccard(a, b) == pytest.approx(want)
        got = probminhash.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        errors.append((got[0] == got[1]).mean() - want)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def classes(rows, linked):
    """Smallest index of the texts each text is linked with."""
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if linked(rows[i][1] or "", rows[j][1] or ""):
                x, y = sorted((find(i), find(j)))
                label[y] = x
    return [find(i) for i in range(len(rows))]


def chained(n):
    """Texts each alike to its neighbours only, copies, and texts that share half."""
    rnd = random.Random(1)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
    rows = [" ".join(base[4 * i : 4 * i + 160]) for i in range(n)]
    rows += [rows[0]] * 5 + [" ".join(base[:80] + [f"z{i}{k}" for k in range(80)]) for i in range(6)]
    rnd.shuffle(rows)
    return list(enumerate(rows))


def weighted_likeness(a, b):
    def row(t):
        raw = np.frombuffer(t.encode(), np.uint8)
        return shingle_hashes(raw, np.array([0, len(raw)]))[0]

    return probminhash.probability_jaccard(row(a), row(b))


def noisy(n):
    """Copies of three texts, each with its own share of words replaced."""
    rnd = random.Random(3)
    base = [[f"w{rnd.randrange(10**6)}" for _ in range(90)] for _ in range(3)]
    rows = []
    for _ in range(n):
        share = rnd.random() * 0.12
        rows.append(" ".join(f"n{rnd.randrange(10**6)}" if rnd.random() < share else w for w in rnd.choice(base)))
    return list(enumerate(rows))


@pytest.mark.parametrize("rows", [chained(30), noisy(160)])
@pytest.mark.parametrize("module, like", [(probminhash, weighted_likeness), (fingerprints, likeness)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, module, like, rows):
    monkeypatch.setattr(linking, "BLOCK", 50)
    want = classes(rows, lambda a, b: a == b or (bool(a.split()) and like(a, b) >= 0.8))
    got = dict(tuple(r) for r in module.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [got[i] for i, _ in rows] == want


def test_near_duplicates_of_odd_rows(docs, no_docs):
    got = probminhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    found = {r.doc_id: r.class_id for r in got if r.doc_id is not None}
    assert found[0] == found[1] == found[2] == 0
    assert found[3] == found[4] == 3 and found[5] == 5 and found[6] == 6
    assert probminhash.near_duplicates(no_docs).count() == 0
    kept = probminhash.without_duplicates(docs)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    assert texts.count(ROWS[0][1]) == 1 and texts.count(ROWS[10][1]) == 1
    assert ROWS[2][1] not in texts and ROWS[13][1] in texts and ROWS[14][1] in texts


def cut(rows):
    """What stays of each text, by looking every string up among all earlier ones."""
    seen, out = set(), []
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(raw[i : i + 100])
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((doc_id, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def passages(n):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcde fghijé") for _ in range(400)) for _ in range(6)]

    def noise(most):
        return "".join(rnd.choice("abcd ") for _ in range(rnd.randint(0, most)))

    makers = [
        lambda x: x,
        lambda x: noise(150) + x[rnd.randint(0, 200) :][: rnd.randint(60, 200)] + noise(150),
        lambda x: "ab" * rnd.randint(0, 300),
        lambda x: "x" * rnd.randint(0, 400) + x[: rnd.randint(0, 200)],
        lambda x: None,
        lambda x: x[:130] * rnd.randint(1, 4),
    ]
    return [(i, rnd.choice(makers)(rnd.choice(base))) for i in range(n)]


@pytest.mark.parametrize("common", [{}, {"COMMON": 3, "SHARE": 4}])
def test_repeats_equal_brute_force(spark, monkeypatch, common):
    for name, value in common.items():
        monkeypatch.setattr(repeats, name, value)
    rows = passages(120)
    got = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(cut(rows))


def test_long_rows_are_taken_in_steps(monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 1000)
    raw = prose(8, 900).encode()
    row, first, n, place, found = repeats.anchors(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert n.sum() == len(raw) - 99 and np.array_equal(np.append(first, len(raw) - 99)[1:], first + n)
    whole = repeats.gram_hashes(np.frombuffer(raw, np.uint8))
    assert np.array_equal(whole[first + place], found)


def test_repeats_in_odd_rows(spark, docs, no_docs):
    got = repeats.without_repeats(docs).collect()
    order = sorted(range(len(ROWS)), key=lambda i: (ROWS[i][0] is not None, ROWS[i][0] or 0, hashlib.md5((ROWS[i][1] or "").encode()).digest()))
    want = cut([ROWS[i][:2] for i in order])
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert repeats.without_repeats(no_docs).count() == 0
    short = repeats.shortened(docs).collect()
    assert len(short) == len(ROWS)
    assert sum(len(r.text or "") for r in short) <= sum(w[1] - w[2] for w in want) + 10
    assert repeats.shortened(spark.createDataFrame([], SCHEMA + ", n_chars long")).count() == 0


def test_suffix_buckets_put_equal_strings_together():
    assert {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.PERIOD))
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("ab") for _ in range(130)) for _ in range(4)]
    texts = [texts[rnd.randrange(4)] for _ in range(12)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    block = suffixes.Block(data, np.full(12, 130), np.zeros(12, np.int64))
    seen = 0
    for text, start, run in block.buckets(np.zeros(12, np.int64), np.full(12, 31), 100):
        strings = [texts[t][s : s + 100] for t, s in zip(text.tolist(), start.tolist(), strict=True)]
        seen += len(strings)
        assert len(set(strings)) == run[-1] + 1
        assert all((a == b) == (strings[i] == strings[j]) for i, a in enumerate(run) for j, b in enumerate(run))
        assert strings == sorted(strings)
    assert seen == 12 * 31


def test_equal_surroundings_are_not_sorted_again():
    context = pa.array([b"aa", b"aa", b"bb", b"aa", b"cc", b"cc", b"dd", b"aa", b"aa"])
    group = np.array([0, 0, 0, 1, 2, 2, 3, 4, 4])
    place = np.array([0, 0, 0, 0, 0, 0, 0, 0, 1])
    age = np.array([5, 3, 9, 0, 1, 2, 4, 6, 7])
    copy, rest = repeats.copies(context, group, place, age, group == 3)
    # 0 is a later copy of 1, and 5 of 4; 3 and 4 are left alone; 6 is alone here, but other tasks have its anchor.
    assert np.flatnonzero(copy).tolist() == [0, 5] and rest.tolist() == [1, 2, 6, 7, 8]


def test_near_copies_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(9)
    base = "".join(rnd.choice("abcdef ") for _ in range(900))
    rows = []
    for i in range(60):
        a = rnd.randint(0, 899)
        rows.append((None if i == 40 else i, base[:a] + rnd.choice(["", "x", "éé"]) + base[a:]))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for share in (repeats.SHARE, 3):
        monkeypatch.setattr(repeats, "SHARE", share)
        monkeypatch.setattr(repeats, "COMMON", 2)
        got = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, cut(order)))
