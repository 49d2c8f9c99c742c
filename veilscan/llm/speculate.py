"""Byte-pair encoding by speculation, verification and repair; and decoding.

*Speculate*: a word is cut greedily into the longest tokens of the vocabulary.
*Verify*: a cut is what byte-pair merging gives exactly if every adjacent pair
of tokens is, so all adjacent pairs of a batch are tested at once with arrays.
*Repair*: only words with a failing pair are merged step by step.

The pair test walks both tokens back in time.  Where tokens ``a`` and ``b``
meet, the parts that touch change only when one of them is swallowed by a merge
inside its own token.  The pair is wrong if some touching parts have a merge
that comes before either part is swallowed.

Words come from the tokenizer's own normaliser and splitter, only distinct ones
are encoded, and everything is counted on whole texts.

Edge cases: a null text is empty and has no ids; the strings of special tokens
in a text are their ids, as in the library; repeated rows give equal rows; an
empty table gives no rows; null doc_ids are kept; other columns are ignored; a
word of n characters takes about n log n steps, so megabytes without a break are
encoded in seconds.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks, text_bytes, whole_text
from .pieces import ENCODERS, PieceEncoder, in_order

NEVER = np.int64(1 << 40)
TEXT_BYTES = 4 << 20


class Merges:
    """The merge table of a vocabulary file with word ends, as arrays."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        model = content["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.ending: str = model["end_of_word_suffix"]
        special = {x["content"]: x["id"] for x in content["added_tokens"]}
        self.special = special
        self.size = max([*self.vocab.values(), *special.values()]) + 1
        self.token = [""] * self.size
        for t, i in (self.vocab | special).items():
            self.token[i] = t
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in pairs])
        right = np.array([self.vocab[b] for _, b in pairs])
        made = np.array([self.vocab[a + b] for a, b in pairs])
        # When a token comes to be (its merge's rank; -1 for a single byte) and of which parts.
        self.born = np.full(self.size, -1, np.int64)
        self.left, self.right = np.full(self.size, -1), np.full(self.size, -1)
        self.born[made], self.left[made], self.right[made] = np.arange(len(made)), left, right
        key = left * self.size + right
        order = np.argsort(key)
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.rank_of = {p: k for k, p in enumerate(zip(left.tolist(), right.tolist(), strict=True))}
        self.made_by: list[int] = made.tolist()
        self.inner = {t: i for t, i in self.vocab.items() if not t.endswith(self.ending)}
        self.final = {t.removesuffix(self.ending): i for t, i in self.vocab.items() if t.endswith(self.ending)}
        self.longest = max(map(len, [*self.inner, *self.final]))

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of merging each pair, or NEVER."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of ``a`` and ``b`` together gives just these two tokens."""
        good = np.ones(len(a), bool)
        row = np.arange(len(a))
        until_a, until_b = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(row):
            rank = self.rank(a, b)
            # Of equal ranks the left one is merged first.
            wrong = (rank < until_a) & (rank <= until_b) & (rank < NEVER)
            good[row[wrong]] = False
            born_a, born_b = self.born[a], self.born[b]
            go = ~wrong & (np.maximum(born_a, born_b) >= 0)
            row, a, b, until_a, until_b, born_a, born_b = (x[go] for x in (row, a, b, until_a, until_b, born_a, born_b))
            back = born_a > born_b  # undo the later of the two
            a, until_a = np.where(back, self.right[a], a), np.where(back, born_a, until_a)
            b, until_b = np.where(back, b, self.left[b]), np.where(back, until_b, born_b)
        return good

    def greedy(self, word: str) -> list[int]:
        """The longest tokens from the left; the last one carries the word's end."""
        out, at, n = [], 0, len(word)
        inner, final = self.inner, self.final
        while True:
            if n - at <= self.longest and (found := final.get(word[at:])) is not None:
                out.append(found)
                return out
            size = min(n - at - 1, self.longest)
            while (found := inner.get(word[at : at + size])) is None:
                size -= 1
            out.append(found)
            at += size

    def merged(self, word: str) -> list[int]:
        """Exact merging: lowest rank first, leftmost of equals.

        A heap of pairs over a linked list, so a word of n characters takes
        n log n steps; pairs that are no more are passed over when they come up.
        """
        ids = [self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + self.ending]]
        n, rank_of, made_by = len(ids), self.rank_of, self.made_by
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, at) for at, p in enumerate(zip(ids, ids[1:], strict=False)) if (rank := rank_of.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, at = heapq.heappop(heap)
            right = after[at]
            if ids[at] < 0 or right == n or rank_of.get((ids[at], ids[right])) != rank:
                continue
            ids[at], ids[right] = made_by[rank], -1
            after[at] = right = after[right]
            if right < n:
                before[right] = at
                if (rank := rank_of.get((ids[at], ids[right]))) is not None:
                    heapq.heappush(heap, (rank, at))
            if (left := before[at]) >= 0 and (rank := rank_of.get((ids[left], ids[at]))) is not None:
                heapq.heappush(heap, (rank, left))
        return [i for i in ids if i >= 0]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids of the words end to end, how many each has, and how many words were repaired."""
        proposed = [self.greedy(w) for w in words]
        length = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((i for ids in proposed for i in ids), np.int64, int(length.sum()))
        word = np.repeat(np.arange(len(words)), length)
        inside = np.flatnonzero(word[1:] == word[:-1])
        code, pairs = pd.factorize(flat[inside] * self.size + flat[inside + 1])
        good = self.compatible(pairs // self.size, pairs % self.size)[code]
        wrong = np.unique(word[inside[~good]])
        for i in wrong.tolist():
            proposed[i] = self.merged(words[i])
            length[i] = len(proposed[i])
        flat = np.fromiter((i for ids in proposed for i in ids), np.uint32, int(length.sum()))
        return flat, length, len(wrong)


def speculative_encoder(path: str) -> PieceEncoder:
    """Encoder of whole texts; one per worker and vocabulary."""
    key = ("speculative", path)
    if key in ENCODERS:
        return ENCODERS[key]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    parts, merges = Tokenizer.from_file(path), Merges(path)
    # Bytes as the splitter writes them: one visible character each.
    as_char = {c: parts.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xC0, 0x100)) if c.isalpha()}
    lead, tail = as_char["é"][0], {c.encode()[1]: x[1] for c, x in as_char.items()}
    plain_chars = bytes(range(97, 123)).decode()
    to_char = str.maketrans({chr(b): x for b, x in tail.items()} | {chr(0xC3): lead} | {c: c for c in plain_chars})

    def words_of(piece: bytes) -> list[str]:
        if piece.decode("utf-8", "replace") in merges.special:
            return [piece.decode()]
        normal = parts.normalizer.normalize_str(piece.decode("utf-8", "replace"))
        return [w for w, _ in parts.pre_tokenizer.pre_tokenize_str(normal)]

    def encode_new(pieces: list[bytes], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        direct, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        words = [pieces[i].decode("latin-1").translate(to_char) for i in direct.tolist()]
        owner = [direct]
        specials: dict[int, int] = {}
        split = [words_of(pieces[i]) for i in rest.tolist()]
        for i, got in zip(rest.tolist(), split, strict=True):
            if len(got) == 1 and got[0] in merges.special:
                specials[i] = merges.special[got[0]]
                got.clear()
            words += got
        owner.append(np.repeat(rest, [len(x) for x in split]))
        flat, length, _ = merges.encode(words)
        extra = np.fromiter(specials, np.int64, len(specials))
        flat = np.concatenate([flat, np.fromiter(specials.values(), np.uint32, len(specials))])
        owner = np.concatenate([*owner, extra])
        length = np.concatenate([length, np.ones(len(extra), np.int64)])
        # Words of a piece stay in order; a piece may have none.
        per_piece = np.bincount(owner, weights=length, minlength=len(pieces)).astype(np.int64)
        order = np.argsort(owner, kind="stable")
        place = np.empty(len(owner), np.int64)
        place[order] = np.arange(len(owner))
        return in_order(place, flat, length)[0], per_piece

    special = tuple(t.encode() for t in merges.special)
    ENCODERS[key] = PieceEncoder(encode_new, lower=True, drop_space=True, special=special)
    ENCODERS[key].merges = merges
    return ENCODERS[key]


def decode(ids: list[int], token: list[str]) -> str:
    """What the library's ``decode(ids, skip_special_tokens=False)`` gives for a file without decoder."""
    return " ".join([token[i] for i in ids])


def encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, ids, decoded`` of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, ids, starts, token in encode_batches(batches, vocabulary):
            rows = [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)]
            done = {"doc_id": doc_id, "ids": pa.array(rows, pa.list_(pa.int32())), "decoded": [decode(r, token) for r in rows]}
            yield pa.record_batch(done)

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_batches(batches: Iterator[pa.RecordBatch], vocabulary: str):
    """Of rows ``doc_id, text``: the doc_ids, all ids, where each row's begin, and the token strings."""
    encoder = speculative_encoder(vocabulary)
    for batch in batches:
        data, starts = text_bytes(batch["text"])
        for lo, hi in blocks(starts, TEXT_BYTES):
            ids, counts = encoder.encode(data, starts[lo : hi + 1])
            yield batch["doc_id"][lo:hi].cast(pa.int64()), ids, np.concatenate([[0], np.cumsum(counts)]), encoder.merges.token


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``, without moving ids between processes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: list[str] = []
        for doc_id, ids, starts, token in encode_batches(batches, vocabulary):
            number = number or [str(i) for i in range(len(token))]
            shas: tuple[list[str], list[str]] = ([], [])
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                row = ids[a:b].tolist()
                for out, names in zip(shas, (number, token), strict=True):
                    out.append(hashlib.sha256(decode(row, names).encode()).hexdigest())
            done = {"doc_id": doc_id, "n_tokens": pa.array(np.diff(starts), pa.int64()), "ids_sha256": shas[0], "decoded_sha256": shas[1]}
            yield pa.record_batch(done)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, schema)
