"""Stupid-backoff scores of documents by the counts of the rest of the corpus.

Texts are gathered in chunks.  Every chunk sends its distinct n-grams with their counts to count
tables partitioned by the top bits of a 64-bit hash; a partition adds up what it gets and answers
every chunk with the totals, which the chunk joins back to its exploded n-grams.  So an n-gram
crosses the network once per chunk and order, and a word that everyone uses is no hot key.  A
document is scored by the totals less its own counts, and its scores are summed.

For a word w after the ``order - 1`` words v (fewer where the text begins), with counts c of the
other documents and N their words, the score is

    c(v w) / c(v)                 where v w occurs elsewhere
    backoff * score after v without its first word    else

and, after no word, c(w) / N where w occurs elsewhere and backoff / N else.  Above order 2 the totals
of one order are written before the next order is sent.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, id_and_bytes, mixed, n_words

MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def packed(values: np.ndarray) -> bytes:
    """Unsigned numbers by byte planes, as many as the largest needs; high planes compress to little."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + planes.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, : data[0]] = planes.T
    return wide.reshape(-1).view("<u8")


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the number of words of every text."""
    split = [t.split() for t in texts]
    count = np.array([len(w) for w in split], np.int64)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for words in split for w in words), np.uint64, count.sum()), count


def _grams(words: np.ndarray, count: np.ndarray, order: int = 2) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every length up to ``order``: keys of the n-grams, and the places of their last words."""
    within = np.arange(len(words)) - np.repeat(np.cumsum(count) - count, count)
    key, at = mixed(words), np.arange(len(words))
    out = [(mixed(words + np.uint64(1)), at)]
    for n in range(2, order + 1):
        long = within[at] >= n - 1
        key, at = key[long], at[long]
        key = mixed(words[at - n + 1] * MULTIPLY + key + np.uint64(n))
        out.append((key, at))
    return out


def _chunks(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """``chunk, ids, texts``: rows gathered until their texts have ``chunk_bytes``."""
    names = ["chunk", "ids", "texts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def chunk() -> pa.RecordBatch:
            lengths = np.array([len(t) for t in texts], "<i8").tobytes()
            body = packer.compress(len(texts).to_bytes(8, "little") + lengths + b"".join(texts))
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([body], pa.binary())], names
            )

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(text or b"")
                size += len(texts[-1])
                if size >= chunk_bytes:
                    yield chunk()
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield chunk()

    return id_and_bytes(docs).mapInArrow(run, "chunk long, ids array<long>, texts binary")


def _texts(body: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    n = int.from_bytes(raw[:8], "little")
    ends = 8 + 8 * n + np.cumsum(np.frombuffer(raw, "<i8", n, 8))
    return [raw[s:e] for s, e in zip([8 + 8 * n, *ends[:-1].tolist()], ends.tolist(), strict=False)]


def _sent(chunks: DataFrame, bits: int, orders: tuple[int, ...]) -> DataFrame:
    """``bucket, chunk, n, keys, counts``: the distinct n-grams of ``orders`` for every bucket."""
    names = ["bucket", "chunk", "n", "keys", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, body in zip(b.column("chunk").to_pylist(), b.column("texts").to_pylist(), strict=True):
                grams = _grams(*_words(_texts(body)), max(orders))
                for n in orders:
                    keys, counts = np.unique(grams[n - 1][0], return_counts=True)
                    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
                    cut = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(keys)] if len(keys) else [0]
                    rows = [
                        (int(bucket[s]), number, n, packed(np.diff(keys[s:e], prepend=np.uint64(0))), packed(counts[s:e]))
                        for s, e in zip(cut[:-1], cut[1:], strict=True)
                    ]
                    if rows:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])

    return chunks.select("chunk", "texts").mapInArrow(run, "bucket long, chunk long, n long, keys binary, counts binary")


def _answered(sent: DataFrame) -> DataFrame:
    """``chunk, n, bucket, totals``: for every message the totals of its keys, in their order."""
    names = ["chunk", "n", "bucket", "totals"]

    def answer(bucket: int, n: int, group: list) -> pa.RecordBatch:
        keys = [np.cumsum(unpacked(k)) for _, k, _ in group]
        counts = np.concatenate([unpacked(c) for _, _, c in group])
        _, where = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(where, weights=counts)[where]
        cut = np.cumsum([len(k) for k in keys])[:-1]
        answers = [packed(t) for t in np.split(totals, cut)]
        m = len(group)
        columns = [pa.array([c for c, _, _ in group]), pa.array([n] * m), pa.array([bucket] * m), pa.array(answers, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, []
        for b in batches:
            for bucket, n, *row in zip(*(b.column(c).to_pylist() for c in ("bucket", "n", "chunk", "keys", "counts")), strict=True):
                if (bucket, n) != at:
                    if group:
                        yield answer(*at, group)
                    at, group = (bucket, n), []
                group.append(row)
        if group:
            yield answer(*at, group)

    return (
        sent.repartition("bucket").sortWithinPartitions("bucket", "n").mapInArrow(run, "chunk long, n long, bucket long, totals binary")
    )


def score_chunk(words: np.ndarray, count: np.ndarray, totals: list[np.ndarray], all_words: int, backoff: float):
    """Per document: n-grams and words that occur nowhere else, and the sum of log scores; an order per total."""
    doc = np.repeat(np.arange(len(count)), count)
    others, places = [], []
    for (keys, at), total in zip(_grams(words, count, len(totals)), totals, strict=True):
        known, which = np.unique(keys, return_inverse=True)
        _, inside, times = np.unique(doc[at] * max(1, len(known)) + which, return_inverse=True, return_counts=True)
        others.append(np.zeros(len(words), np.int64))
        others[-1][at] = total[which] - times[inside]
        places.append(at)
    rest = np.maximum(all_words - count, 1)[doc].astype(float)
    seen = others[0] > 0
    score = np.where(seen, np.log(np.maximum(others[0], 1) / rest), np.log(backoff / rest))
    backed = np.zeros(len(words), bool)
    for shorter, longer, at in zip(others, others[1:], places[1:], strict=False):
        hit = longer[at] > 0
        score[at] = np.where(
            hit, np.log(np.maximum(longer[at], 1) / np.maximum(shorter[at - 1], 1)), np.log(backoff) + score[at]
        )
        backed[at] = ~hit  # the longest n-gram of a place has the last word
    n = len(count)
    return (
        np.bincount(doc, backed, n).astype(np.int64),
        np.bincount(doc, ~seen, n).astype(np.int64),
        np.bincount(doc, score, n).astype(float),
    )


def scored(
    docs: DataFrame, backoff: float = 0.4, chunk_bytes: int = 8 << 20, keys_per_bucket: int = 1_000_000, order: int = 2
) -> DataFrame:
    """``doc_id, n_words, n_backed_off, n_unseen, log_score, mean_log_score`` of every row.

    ``n_backed_off`` counts the places, but a text's first, whose n-gram of ``order`` words (of all words
    up to there, where those are fewer) no other row has, and ``n_unseen`` words that no other row has.  Null, empty and
    blank texts have no words, a log score of 0 and a null mean.  Rows that repeat an id or a text
    are documents of their own, so a copy knows all of its text.  N is 1 where there are no other
    words.  No rows: no rows.  Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "backoff")
    all_words = docs.agg(F.sum(n_words(F.col("text")))).first()[0] or 0
    bits = max(4, (2 * all_words // keys_per_bucket).bit_length())
    chunks = scratch.put(_chunks(docs, chunk_bytes), "chunks")
    if order <= 2:
        answers = _answered(_sent(chunks, bits, tuple(range(1, order + 1))))
    else:
        parts = [scratch.put(_answered(_sent(chunks, bits, (n,))), f"totals-{n}") for n in range(1, order + 1)]
        answers = reduce(DataFrame.union, parts)
    by_chunk = answers.groupBy("chunk").agg(F.collect_list(F.struct("n", "bucket", "totals")).alias("answers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                got = sorted(b.column("answers")[i].as_py() or [], key=lambda r: (r["n"], r["bucket"]))
                totals = []
                for n in range(1, order + 1):
                    parts = [unpacked(r["totals"]).astype(np.int64) for r in got if r["n"] == n]
                    totals.append(np.concatenate([np.zeros(0, np.int64), *parts]))
                del got
                words, count = _words(_texts(b.column("texts")[i].as_py()))
                backed, unseen, score = score_chunk(words, count, totals, all_words, backoff)
                mean = [s / c if c else None for s, c in zip(score.tolist(), count.tolist(), strict=True)]
                columns = [b.column("ids")[i].values, count, backed, unseen, score, pa.array(mean, pa.float64())]
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c) for c in columns],
                    ["doc_id", "n_words", "n_backed_off", "n_unseen", "log_score", "mean_log_score"],
                )

    return chunks.join(by_chunk, "chunk", "left").mapInArrow(
        run, "doc_id long, n_words long, n_backed_off long, n_unseen long, log_score double, mean_log_score double"
    )
