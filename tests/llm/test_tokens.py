"""Id files, encoding and packing."""

import bisect
import functools
import hashlib
import io
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veilscan.llm import idplanes, packing, pieces, shingles, speculate
from veilscan.llm.common import text_bytes

from .conftest import ROWS

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = "ab É é ' \n\t,.!0 　́×ß日<|>Σσ'sreS\x1c\x85"


def texts(n=1500):
    rnd = random.Random(3)
    odd = ["", None, " ", "<|endoftext|>a<|ENDOFTEXT|> <|startoftext|>", "don't 'S x'!'s", "日本語 ½ x²", "a" * 3000]
    return odd + ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


@functools.cache
def loaded(path):
    return Tokenizer.from_file(path)


def library(path, text):
    return loaded(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("make, path", [(pieces.word_encoder, WORD), (pieces.byte_encoder, BYTE), (speculate.speculative_encoder, WORD)])
def test_encoders_equal_the_library(make, path, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK", 257)  # cuts inside long rows
    all_texts, tokenizer = texts(), Tokenizer.from_file(path)
    ids, counts = make(path).encode(*text_bytes(pa.array(all_texts)))
    ends = np.cumsum(counts)
    for text, end, n in zip(all_texts, ends, counts, strict=True):
        assert ids[end - n : end].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text


def test_piece_memory_can_overflow():
    encoder = pieces.library_encoder(WORD, lower=True, drop_space=True, limit=50)
    for _ in range(2):
        some = texts(200)
        ids, counts = encoder.encode(*text_bytes(pa.array(some)))
        assert counts.tolist() == [len(library(WORD, t)) for t in some]


def test_pair_test_equals_merging():
    merges = speculate.Merges(WORD)
    rnd = random.Random(4)
    words = ["".join(rnd.choice("aaabtheinsr") for _ in range(rnd.randint(1, 14))) for _ in range(3000)]
    flat, length, repaired = merges.encode(words)
    ends = np.cumsum(length)
    assert 0 < repaired < len(words)
    for w, end, n in zip(words, ends, length, strict=True):
        assert flat[end - n : end].tolist() == merges.merged(w)


def morse(power, letters):
    """The Thue-Morse word of 2**power letters."""
    word = letters[0]
    other = letters[1]
    for _ in range(power):
        word, other = word + other, other + word
    return word


@pytest.mark.parametrize("make, path", [(pieces.word_encoder, WORD), (pieces.byte_encoder, BYTE), (speculate.speculative_encoder, WORD)])
def test_words_that_collide_for_odd_bases(make, path):
    words = [morse(k, letters) for k in (10, 11, 13) for letters in ("ab", "ba")]
    encoder = make(path)
    for batches in ([words], [[w] for w in words]):  # in one batch and across batches
        for batch in batches:
            ids, counts = encoder.encode(*text_bytes(pa.array(batch)))
            ends = np.cumsum(counts)
            for word, end, n in zip(batch, ends, counts, strict=True):
                assert ids[end - n : end].tolist() == library(path, word)


def test_such_words_are_not_alike():
    data, starts = text_bytes(pa.array([morse(12, "ab"), morse(12, "ba")]))
    one, two = shingles.shingle_hashes(data, starts)[0]
    assert one != two


def test_a_word_of_a_megabyte():
    rnd = random.Random(5)
    word = "".join(rnd.choice("etaoinshrdlu") for _ in range(1 << 20))
    ids, _ = speculate.speculative_encoder(WORD).encode(*text_bytes(pa.array([word])))
    assert ids.tolist() == library(WORD, word)


def test_digests(docs, no_docs):
    got = sorted(tuple(r) for r in speculate.digests(docs, WORD).collect() if r.doc_id is not None)
    tokenizer, wanted = Tokenizer.from_file(WORD), []
    for doc_id, text, *_ in ROWS:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        both = (" ".join(map(str, ids)), tokenizer.decode(ids, skip_special_tokens=False))
        wanted.append((doc_id, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in both)))
    assert got == sorted(w for w in wanted if w[0] is not None)
    assert speculate.digests(docs, WORD).count() == len(ROWS)
    assert speculate.digests(no_docs, WORD).count() == 0


def test_decoding_equals_the_library(spark, docs):
    got = speculate.encoded(docs, WORD).collect()
    tokenizer = Tokenizer.from_file(WORD)
    assert len(got) == len(ROWS)
    for row in got:
        assert row.decoded == tokenizer.decode(row.ids, skip_special_tokens=False)


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    ids = np.random.default_rng(0).integers(0, 1 << 32, 10_007, dtype=np.uint32)
    sink = io.BytesIO()
    writer = idplanes.PlaneWriter(sink, kind, block=1000)
    cuts = [0, 0, 3, 2500, 2500, 10_007]
    for a, b in zip(cuts, cuts[1:], strict=False):
        writer.add(pa.array([a], pa.int64()), np.array([b - a]), ids[a:b])
    writer.close()
    reader = idplanes.PlaneReader(io.BytesIO(sink.getvalue()))
    assert np.array_equal(np.concatenate([reader.block(k) for k in range(len(reader.head["blocks"]))]), ids)
    assert [d[2] for d in reader.documents()] == [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]
    with pytest.raises(ValueError):
        idplanes.PlaneReader(io.BytesIO(sink.getvalue()[:-1]))


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_token_files(docs, no_docs, planes):
    got = sorted(tuple(r) for r in idplanes.token_files(docs, WORD, planes=planes).collect() if r.doc_id is not None)
    rows = sorted((r for r in ROWS if r[0] is not None), key=lambda r: r[0])
    missing = sum(len(library(WORD, r[1])) + 1 for r in ROWS if r[0] is None)  # nulls come first
    assert [g[0] for g in got] == [r[0] for r in rows]
    start = missing
    by_id = defaultdict(list)
    for r in rows:
        by_id[r[0]].append(np.array([*library(WORD, r[1]), 1], "<u4"))
    for key in sorted(by_id):
        mine = sorted(g for g in got if g[0] == key)
        assert sorted(g[2] for g in mine) == sorted(len(x) for x in by_id[key])
        assert sorted(g[3] for g in mine) == sorted(zlib.crc32(x.tobytes()) for x in by_id[key])
        for g in mine:
            assert g[1] == start
            start += g[2]
    assert idplanes.token_files(no_docs, WORD).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_gapless_and_short(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 80)) if seed < 3 else 3000
    lengths = rng.integers(1, 65, n) if seed % 2 else np.clip(rng.lognormal(2.5, 1, n).astype(int), 1, 64)
    count = np.bincount(lengths, minlength=65)
    rows, sequences = packing.plan(count, 64)
    rows.sort()
    fill, placed = np.zeros(sequences, int), []
    for i, (length, number, sequence, offset) in enumerate(rows):
        until = rows[i + 1][1] if i + 1 < len(rows) and rows[i + 1][0] == length else count[length]
        placed += [(sequence + k, offset, length) for k in range(until - number)]
    for sequence, offset, length in sorted(placed):
        assert fill[sequence] == offset
        fill[sequence] += length
    assert fill.max() <= 64 and fill.sum() == lengths.sum()
    assert sequences <= best_fit_decreasing(lengths.tolist(), 64)


def best_fit_decreasing(lengths, capacity):
    """How many sequences plain best fit by falling length needs."""
    gaps, n = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, length)
        n += at == len(gaps)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        bisect.insort(gaps, gap - length)
    return n


@given(st.lists(st.integers(1, 20), max_size=60))
@settings(max_examples=200, deadline=None)
def test_no_plan_is_longer_than_best_fit(lengths):
    count = np.bincount(np.array(lengths, int), minlength=21)
    wanted = best_fit_decreasing(lengths, 20)
    assert packing.combined(count, 20, 0)[1] == wanted
    assert packing.plan(count, 20)[1] <= wanted


def test_packing(docs, no_docs):
    got = packing.packed(docs, BYTE, capacity=64).collect()
    want = defaultdict(list)
    for r in ROWS:
        want[r[0]].append(np.array([*library(BYTE, r[1]), 2], "<u4"))
    for key, all_ids in want.items():
        mine = [g for g in got if g.doc_id == key]
        pieces_ = []
        for ids in all_ids:
            first = len(ids) % 64 or 64
            edges = [0, *range(first, len(ids) + 1, 64)]
            pieces_ += [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
        assert sorted((g.piece, g.start, g.length, g.ids_crc32) for g in mine) == sorted(pieces_)
    fill = defaultdict(int)
    for g in sorted(got, key=lambda g: (g.sequence_id, g.offset)):
        assert fill[g.sequence_id] == g.offset
        fill[g.sequence_id] += g.length
    assert max(fill.values()) <= 64
    assert packing.packed(no_docs, BYTE).count() == 0
