"""Packing documents into sequences, shortest pack first over the histogram of lengths.

A document of n tokens is cut into whole sequences and a rest, so the cut needs nothing but the
document.  The pieces are packed by their histogram (at most ``size`` counts, whatever the
corpus): lengths are placed longest first, each into the packing pattern with the fewest tokens if
it fits, else into a new one; a pattern and its count stand for all sequences packed alike.  Pieces
find their place by their rank within their length.  Ranks come from counts per length and bucket
of ids, so a length that a third of all documents share is ranked in many tasks.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, word_encoder

END = 2
PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


def patterns(histogram: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """``(count, [(length, first rank, offset), ...])`` of every packing pattern.

    Ranks of a length go to patterns in ranges: the pattern takes ``count`` ranks from the first on.
    """
    heap: list[tuple[int, int]] = []  # tokens of a pattern, its number
    made: list[tuple[int, list[tuple[int, int, int]]]] = []

    def put(tokens: int, count: int, parts: list[tuple[int, int, int]]) -> None:
        heapq.heappush(heap, (tokens, len(made)))
        made.append((count, parts))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            if not heap or heap[0][0] + length > size:
                _open(put, length, left, rank, size)
                break
            tokens, number = heapq.heappop(heap)
            count, parts = made[number]
            taken = min(count, left)
            if taken < count:  # the others of the pattern stay as they were, with the ranks that follow
                made[number] = (count - taken, [(n, first + taken, at) for n, first, at in parts])
                heapq.heappush(heap, (tokens, number))
                put(tokens + length, taken, [*parts, (length, rank, tokens)])
            else:
                made[number] = (count, [*parts, (length, rank, tokens)])
                heapq.heappush(heap, (tokens + length, number))
            rank, left = rank + taken, left - taken
    return made


def _open(put, length: int, count: int, rank: int, size: int) -> None:
    """New packs for ``count`` equal lengths: as few as hold them, filled evenly."""
    each = size // length
    packs = -(-count // each)
    fewer, more = divmod(count, packs)
    for packs_here, n in ((more, fewer + 1), (packs - more, fewer)):
        if packs_here:
            put(n * length, packs_here, [(length, rank + i * packs_here, i * length) for i in range(n)])
            rank += n * packs_here


def places(histogram: dict[int, int], size: int) -> np.ndarray:
    """Columns ``length << 40 | first rank, first rank, sequence, offset``, sorted."""
    rows, sequence = [], 0
    for count, parts in patterns(histogram, size):
        rows += [((length << 40) + rank, rank, sequence, offset) for length, rank, offset in parts]
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 4).T


def pieces(docs: DataFrame, tokenizer: str, size: int = 4096) -> DataFrame:
    """Every document cut into pieces: ``doc_id, start, length, ids_crc32, doc_tokens``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer)
        end = END.to_bytes(4, "little")
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = encode(text or "") + end
                n = len(ids) // 4
                rows += [
                    (doc_id, s, min(size, n - s), zlib.crc32(ids[4 * s : 4 * (s + size)]), n)
                    for s in range(0, n, size)
                ]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], PIECE)

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{n} long" for n in PIECE))


def ranked(rows: DataFrame, counts: dict[int, int], rows_per_task: int = 200_000) -> DataFrame:
    """``rows`` with their rank from 0 within their length.

    Buckets of ids split every length; there are as many as keep the largest one small.
    """
    buckets = 64
    while max(counts.values(), default=0) > buckets * rows_per_task:
        buckets *= 2
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    sizes = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = W.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    return (
        rows.withColumn("rank", F.row_number().over(within) - 1)
        .join(before, ["length", "bucket"])
        .withColumn("rank", F.col("rank") + F.col("before"))
        .drop("bucket", "before")
    )


def packed(docs: DataFrame, tokenizer: str, size: int = 4096) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every piece.

    Null and empty texts have the end token alone.  Documents of any length are cut, none is left
    out; repeated rows and equal lengths are packed each for itself.  A row without id is packed
    like the others.  No rows: no rows.  Other columns are ignored.
    """
    cut = Scratch(docs.sparkSession, "packing").put(pieces(docs, tokenizer, size), "pieces")
    histogram = cut.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``size`` rows
    counts = {r.length: r.n for r in histogram}
    starts, first, sequence, offset = places(counts, size)  # bounded by the patterns of one histogram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(starts, (length << 40) + rank, side="right") - 1
            placed = [pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in PIECE), *placed], [*PIECE, "sequence_id", "offset"]
            )

    schema = ", ".join(f"{c} long" for c in [*PIECE, "sequence_id", "offset"])
    return ranked(cut, counts).mapInArrow(run, schema)
