"""Alignment of the tokens of two tokenizers, by divide and conquer at shared cuts.

Both tokenizers spell the same bytes.  An interval of tokens is split at a common end near its
middle: ends of the first tokenizer are tried from the middle outwards, each looked up among the ends
of the second by bisection, and both halves go on in the same way.  An interval without a common
end inside is a leaf, one group.  All intervals of one depth, of many documents, are split at once.

Tokens whose bytes overlap are linked.  How many documents hold a link between two ids is counted
over the corpus: documents travel in chunks of bounded size, a chunk asks once for each id pair it
holds, whatever its documents repeat, and gets the corpus-wide counts back.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from struct import pack
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, id_and_bytes

BITS = 20  # of a token id inside a pair of ids
PART = 1_000_000  # bytes of text whose tokens are held at once
SUMMARY = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


class ByteLevel:
    """A byte-level BPE tokenizer file (JSON); special tokens inside a text are plain text.

    Texts go through a faster encoder with the same ranks, those with a very long run of white
    space, which it cannot take, through the file's own.  Both spell every byte of a text.
    """

    # Fixed value: how byte-level BPE of this kind cuts a text before merging.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    LONG_RUN = re.compile(r"\s{1000}")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        special = {t["id"] for t in whole["added_tokens"]}
        # visible bytes stand for themselves, the others for code points from 256 on, in their order
        hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
        as_byte = {chr(b): b for b in range(256) if b not in hidden} | {chr(256 + n): b for n, b in enumerate(hidden)}
        vocabulary = whole["model"]["vocab"]
        ranks = {bytes(as_byte[c] for c in t): i for t, i in vocabulary.items() if i not in special}
        self.spelled = [b""] * (max(vocabulary.values()) + 1)
        for token, i in ranks.items():
            self.spelled[i] = token
        self.lengths = np.array([len(t) for t in self.spelled], np.int64)
        self.fast = tiktoken.Encoding("ranks", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text with a space before it."""
        texts = [" " + t for t in texts]
        slow = self.LONG_RUN.search
        return [self.own.encode(t, add_special_tokens=False).ids if slow(t) else self.fast.encode_ordinary(t) for t in texts]


class Pieces:
    """A SentencePiece model with byte fallback that puts a space before a text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        one_byte = re.compile("<0x([0-9A-F]{2})>")
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        byte = [one_byte.fullmatch(p) for p in pieces]
        self.spelled = [bytes([int(b[1], 16)]) if b else p.replace("▁", " ").encode() for p, b in zip(pieces, byte, strict=True)]
        self.lengths = np.array([len(t) for t in self.spelled], np.int64)
        self.by_word = all("▁" not in p.lstrip("▁") for p in pieces)

    def ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; the model itself puts a space before it."""
        return self.model.encode(texts, num_threads=1) if texts else []


@dataclass(frozen=True)
class Coders:
    """The tokenizer files; ``a`` is byte-level BPE, ``b`` a SentencePiece model."""

    a: str
    b: str

    def load(self) -> "Words":
        return _loaded(self)


@lru_cache(maxsize=1)
def _loaded(coders: Coders) -> "Words":
    return Words(ByteLevel(coders.a), Pieces(coders.b))


class Words:
    """Ids of whole texts from those of their words, which are remembered from task to task.

    A text may be cut before a space that follows anything but white space: the byte-level pattern
    never reaches over that place, and the model does not if none of its pieces has a space after
    another character (else texts stay whole).  ``most`` bounds the memory; long words are not kept.
    """

    CUT = re.compile(r"(?<=\S) (?!\Z)")

    def __init__(self, a: ByteLevel, b: Pieces, most: int = 400_000, longest: int = 100):
        self.a, self.b, self.most, self.longest = a, b, most, longest
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.odd: set[str] = set()

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both tokenizers; None where one of them does not spell the bytes of the text."""
        words = self.CUT.split(text) if self.b.by_word else [text]
        long = [w for w in set(words) if len(w) > self.longest]
        if len(self.known[0]) > self.most:
            self._forget()
        if new := [w for w in dict.fromkeys(words) if w not in self.known[0]]:
            self._learn(new)
        ok = self.odd.isdisjoint(words)
        found = tuple(np.frombuffer(b"".join(map(k.__getitem__, words)), "<i4") for k in self.known) if ok else None
        for w in long:
            self.odd.discard(w)
            for k in self.known:
                del k[w]
        return found

    def _learn(self, words: list[str]) -> None:
        """New words are encoded as one text, and cut where they end; each by itself where that text
        is not spelled byte by byte, or a word ends in white space."""
        plain = [w for w in words if w and not w[-1].isspace()]
        ends = np.cumsum([len(w.encode()) + 1 for w in plain])
        if plain and self.b.by_word:
            text = " ".join(plain)
            found = [c.ids([text])[0] for c in (self.a, self.b)]
            if b"".join([self.b.spelled[i] for i in found[1]]) == b" " + text.encode():
                for k, c, ids in zip(self.known, (self.a, self.b), found, strict=True):
                    ids = np.array(ids, "<i4")
                    stop = (np.searchsorted(np.cumsum(c.lengths[ids]), ends) + 1) * 4
                    raw = ids.tobytes()
                    k.update(zip(plain, map(raw.__getitem__, map(slice, [0, *stop[:-1].tolist()], stop.tolist())), strict=True))
        words = [w for w in words if w not in self.known[0]]
        for word, x, y in zip(words, self.a.ids(words), self.b.ids(words), strict=True):
            if b"".join([self.b.spelled[i] for i in y]) != b" " + word.encode():
                self.odd.add(word)
            for k, ids in zip(self.known, (x, y), strict=True):
                k[word] = pack(f"<{len(ids)}i", *ids)

    def _forget(self) -> None:
        self.odd.clear()
        for k in self.known:
            k.clear()


class Tokens(NamedTuple):
    """Tokens of several documents in a row; document ``n`` has those from ``first[n]`` to ``first[n + 1]``."""

    ids: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def _tokens(found: list[np.ndarray], lengths: np.ndarray) -> Tokens:
    first = np.cumsum([0, *map(len, found)])
    ids = np.concatenate([np.zeros(0, np.int64), *found])
    return Tokens(ids, np.cumsum(lengths[ids]), first)


def encoded(texts: list[bytes | None], coders: Coders) -> tuple[Tokens, Tokens]:
    """Tokens of each text with a space before it; none where one tokenizer does not spell its bytes."""
    words, none = coders.load(), (np.zeros(0, np.int64),) * 2
    found = []
    for text in texts:
        try:
            found.append(words.ids(text.decode()) or none if text else none)
        except UnicodeDecodeError:
            found.append(none)
    return _tokens([x for x, _ in found], words.a.lengths), _tokens([y for _, y in found], words.b.lengths)


def leaves(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` where a group begins, in order: what is left once every interval
    is split at a common end near its middle for as long as it has one."""
    lo, hi, lo_b, hi_b = a.first[:-1], a.first[1:], b.first[:-1], b.first[1:]
    some = hi > lo
    lo, hi, lo_b, hi_b = lo[some], hi[some], lo_b[some], hi_b[some]
    starts_a, starts_b = [], []
    while len(lo):
        cut, cut_b = np.full(len(lo), -1), np.full(len(lo), -1)
        middle, last = (lo + hi - 1) // 2, hi - 1  # a cut is the place of the token that ends there, and never the last
        open_, away = np.flatnonzero((hi - lo > 1) & (hi_b - lo_b > 1)), 0
        while len(open_):  # twice as far each time; the nearest common end wins
            steps = np.arange(away, max(1, 2 * away))
            steps = np.stack([-steps, steps], axis=1).ravel()
            tried = middle[open_, None] + steps
            inside = (tried >= lo[open_, None]) & (tried < last[open_, None])
            ends = a.ends[tried[inside]]
            at = np.searchsorted(b.ends, ends)
            hit, place = np.zeros(tried.shape, bool), np.zeros(tried.shape, np.int64)
            hit[inside], place[inside] = b.ends[at] == ends, at
            best = hit.argmax(axis=1)
            row = np.arange(len(open_))
            ok = hit[row, best]
            cut[open_[ok]], cut_b[open_[ok]] = tried[row, best][ok], place[row, best][ok]
            away = max(1, 2 * away)
            left = open_[~ok]
            open_ = left[(middle[left] - away >= lo[left]) | (middle[left] + away < last[left])]
        leaf = cut < 0
        starts_a.append(lo[leaf])
        starts_b.append(lo_b[leaf])
        split = ~leaf
        halves = lambda left, right: np.stack([left[split], right[split]], axis=1).ravel()
        lo, hi, lo_b, hi_b = halves(lo, cut + 1), halves(cut + 1, hi), halves(lo_b, cut_b + 1), halves(cut_b + 1, hi_b)
    none = np.zeros(0, np.int64)
    return np.sort(np.concatenate([none, *starts_a])), np.sort(np.concatenate([none, *starts_b]))


def _links(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens of each linked pair: one for each stretch of bytes between two ends of any kind."""
    ends = np.sort(np.concatenate([a.ends, b.ends]), kind="stable")
    ends = ends[np.r_[True, ends[1:] != ends[:-1]]] if len(ends) else ends
    return np.searchsorted(a.ends, ends), np.searchsorted(b.ends, ends)


@lru_cache(maxsize=4)
def _digits(n: int) -> np.ndarray:
    """The decimal digits of all numbers below ``n``, a row each, zeros behind them."""
    texts = np.array([str(i).encode() for i in range(n)])
    return texts.view(np.uint8).reshape(n, -1)


def _written(a: Tokens, b: Tokens, group_a: np.ndarray, group_b: np.ndarray) -> list[bytes]:
    """The groups of each document as text: ``a1,a2|b1;a3|b2,b3``."""
    n_a, n_b = len(a.ids), len(b.ids)
    per_a, per_b = np.diff(np.r_[group_a, n_a]), np.diff(np.r_[group_b, n_b])
    # the tokens of a group in a, then those in b
    place_a = np.arange(n_a) + np.repeat(group_b, per_a)
    place_b = np.arange(n_b) + np.repeat(group_a + per_a, per_b)
    digits = _digits(1 << int(max(a.ids.max(initial=0), b.ids.max(initial=0))).bit_length())
    rows = np.zeros((n_a + n_b, 1 + digits.shape[1]), np.uint8)
    rows[place_a, 0] = rows[place_b, 0] = ord(",")
    rows[place_a[group_a], 0], rows[place_b[group_b], 0] = ord(";"), ord("|")
    rows[place_a, 1:], rows[place_b, 1:] = digits[a.ids], digits[b.ids]
    used = rows != 0
    at = np.r_[0, np.cumsum(used.sum(axis=1))][a.first + b.first]
    flat = rows[used].tobytes()
    return [flat[s + 1 : e] for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _parts(batches: Iterator[pa.RecordBatch], most: int = PART) -> Iterator[tuple[list, list, int]]:
    """Ids and texts in parts of about ``most`` bytes, at least one text each."""
    ids, texts, size = [], [], 0
    for b in batches:
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            ids.append(doc_id)
            texts.append(text)
            size += len(text or b"")
            if size >= most or len(ids) >= 20_000:
                yield ids, texts, size
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts, size


def groups(docs: DataFrame, coders: Coders) -> DataFrame:
    """One row per group: ``doc_id, group`` (from 0), ``start, end`` (bytes of the text with a space
    before it), and the ids ``a`` and ``b`` as arrays.  Documents without tokens have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts, _ in _parts(batches):
            a, b = encoded(texts, coders)
            group_a, group_b = leaves(a, b)
            doc = np.searchsorted(a.first, group_a, side="right") - 1
            ends = a.ends[np.r_[group_a[1:], len(a.ids)] - 1] if len(group_a) else np.zeros(0, np.int64)
            before = np.r_[0, a.ends][a.first[doc]]
            columns = [
                pa.array([doc_ids[d] for d in doc.tolist()], pa.int64()),
                pa.array(np.arange(len(doc)) - np.searchsorted(group_a, a.first[doc])),
                pa.array(np.r_[0, a.ends][group_a] - before),
                pa.array(ends - before),
                pa.ListArray.from_arrays(pa.array(np.r_[group_a, len(a.ids)], pa.int32()), pa.array(a.ids, pa.int32())),
                pa.ListArray.from_arrays(pa.array(np.r_[group_b, len(b.ids)], pa.int32()), pa.array(b.ids, pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "group", "start", "end", "a", "b"])

    schema = "doc_id long, `group` long, start long, end long, a array<int>, b array<int>"
    return id_and_bytes(docs).mapInArrow(run, schema)


class _Chunk:
    """Documents whose id pairs are asked for together."""

    def __init__(self):
        self.rows, self.pairs, self.times, self.sizes, self.bytes = [], [], [], [], 0

    def add(self, doc_ids: list, texts: list, size: int, coders: Coders) -> None:
        a, b = encoded(texts, coders)
        group_a, group_b = leaves(a, b)
        first, n = np.searchsorted(group_a, a.first), len(doc_ids)
        at_a, at_b = _links(a, b)
        doc = np.searchsorted(a.first, at_a, side="right") - 1
        # one sort finds the pairs of each document and how often it has them
        order = doc << 2 * BITS | a.ids[at_a] << BITS | b.ids[at_b]
        order, times = np.unique(order, return_counts=True)
        links = np.bincount(doc, minlength=n)
        for k, text in enumerate(_written(a, b, group_a, group_b)):
            digest = hashlib.sha256(text).hexdigest() if text else ""
            counts = (a.first[k + 1] - a.first[k], b.first[k + 1] - b.first[k], first[k + 1] - first[k], links[k])
            self.rows.append((doc_ids[k], *map(int, counts), digest))
        self.pairs.append(order & (1 << 2 * BITS) - 1)
        self.times.append(times)
        self.sizes.append(np.bincount(order >> 2 * BITS, minlength=n))
        self.bytes += size

    def batch(self, chunk: int) -> pa.RecordBatch:
        pairs, times, sizes = (np.concatenate(x) for x in (self.pairs, self.times, self.sizes))
        known, where, held = np.unique(pairs, return_inverse=True, return_counts=True)
        held_rows = pa.StructArray.from_arrays(
            [pa.array(c, pa.int64()) for c in list(zip(*self.rows, strict=True))[:-1]] + [pa.array([r[-1] for r in self.rows])],
            ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"],
        )
        packed = [zlib.compress(x.tobytes(), 1) for x in (where.astype("<u4"), times.astype("<u4"), sizes.astype("<u4"))]
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        columns = [pa.array([chunk]), one(held_rows), one(pa.array(known)), one(pa.array(held)), *(pa.array([p]) for p in packed)]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "docs", "pairs", "held", "at", "times", "sizes"])


CHUNKS = (
    "chunk long, docs array<struct<doc_id:long,n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string>>, "
    "pairs array<long>, held array<long>, at binary, times binary, sizes binary"
)


def _chunks(docs: DataFrame, coders: Coders, chunk_bytes: int) -> DataFrame:
    """Rows of ``CHUNKS``: documents of about ``chunk_bytes`` of text, their distinct id pairs, how many
    of them hold each, and (packed) where and how often each document has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, chunk = TaskContext.get().partitionId() << 32, _Chunk()
        for doc_ids, texts, size in _parts(batches, min(PART, chunk_bytes)):
            chunk.add(doc_ids, texts, size, coders)
            if chunk.bytes >= chunk_bytes:
                yield chunk.batch(number)
                number, chunk = number + 1, _Chunk()
        if chunk.rows:
            yield chunk.batch(number)

    return id_and_bytes(docs).mapInArrow(run, CHUNKS)


def _summed(chunk: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of a chunk with sums over the counts of their links."""
    rows = pa.table({f.name: c for f, c in zip(chunk["docs"].type.value_type, chunk["docs"].combine_chunks().flatten().flatten(), strict=True)})
    pair, n, best = (answers[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("pair", "n", "best"))
    order = np.argsort(pair)  # as the chunk lists them
    at, times, sizes = (
        np.frombuffer(zlib.decompress(chunk[c][0].as_py()), "<u4").astype(np.int64) for c in ("at", "times", "sizes")
    )
    doc = np.repeat(np.arange(len(sizes)), sizes)
    n_best, count_sum = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    np.add.at(n_best, doc, times * best[order][at])
    np.add.at(count_sum, doc, times * n[order][at])
    return rows.append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(count_sum))


def aligned(docs: DataFrame, coders: Coders, chunk_bytes: int = 8_000_000) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum``.

    A pair of ids counts the documents (rows) that link it anywhere.  ``n_best`` counts links whose
    pair has the highest count of all pairs of its first id, ties included; ``count_sum`` adds the
    counts of all links.  Null and empty texts, and those that a tokenizer does not spell byte by
    byte, have no tokens: zeros and an empty digest.  Repeated rows count each.  Ids may be null.
    Other columns are ignored.  No rows: no rows.  ``chunk_bytes`` bounds what a task holds, beyond
    one whole text.
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    chunks = scratch.put(_chunks(docs, coders, chunk_bytes), "chunks")
    pairs = chunks.select("chunk", F.explode(F.arrays_zip("pairs", "held")).alias("p"))
    asked = pairs.select("chunk", F.col("p.pairs").alias("pair"), F.col("p.held").alias("held"))
    counts = scratch.put(asked.groupBy("pair").agg(F.sum("held").alias("n")), "counts")
    first = F.shiftrightunsigned("pair", BITS)
    best = counts.groupBy(first.alias("a")).agg(F.max("n").alias("most"))
    counts = counts.withColumn("a", first).join(best, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    answers = asked.select(F.col("chunk").alias("to"), "pair").join(counts, "pair")
    both = chunks.drop("pairs", "held").groupBy("chunk").cogroup(answers.groupBy("to"))
    return both.applyInArrow(_summed, SUMMARY + ", n_best long, count_sum long")
