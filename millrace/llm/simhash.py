"""SimHash near duplicates with bit-sliced comparison.

Fingerprints that link at ``radius`` or fewer differing bits agree on at least two of four 16-bit
pieces (radius 2), so candidates meet in six tables keyed by two pieces.  A bucket above ``refine``
is keyed again by two of the four remaining bytes; as fingerprints are distinct by then, such a
bucket holds at most 65,536 of them whatever the data.  Inside a bucket, 64 fingerprints form a
block stored as 64 vertical bit planes; one pass over the planes updates 64 distances at once in
carry-save counters, and a block is abandoned once all its lanes exceed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, id_and_bytes
from millrace.llm.components import components

PAIRS = list(combinations(range(4), 2))
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """The fingerprint as an unsigned number; 0 where there is no word (null, empty, blank)."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    size = min(size, len(words))
    starts = [0, *(ends[: len(words) - size] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    n, ones = len(starts), np.zeros(64, np.int64)
    hashes = np.fromiter(
        (digest(joined[s:e], 42) for s, e in zip(starts, ends[size - 1 :].tolist(), strict=True)), ">u8", n
    )
    for at in range(0, n, 65_536):
        part = hashes[at : at + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t, size) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return id_and_bytes(docs).mapInArrow(run, "doc_id long, fp long")


def close_pairs(fps: np.ndarray, groups: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``i < j`` of the same group whose fingerprints differ in ``radius`` bits or fewer.

    ``groups`` is sorted.  Groups are cut into blocks of 64 lanes; each member asks its own and
    every later block of its group.
    """
    n = len(fps)
    first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    length = np.diff(np.r_[first, n])
    blocks = -(-length // 64)
    base = np.r_[0, np.cumsum(blocks)]
    group = np.repeat(np.arange(len(first)), length)
    within = np.arange(n) - first[group]
    block = base[group] + within // 64
    lanes = np.zeros((base[-1], 64), ">u8")
    lanes[block, within % 64] = fps
    valid = np.zeros(base[-1], np.uint64)
    np.bitwise_or.at(valid, block, np.uint64(1) << (within % 64).astype(np.uint64))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    asks = base[group + 1] - block
    upto = np.cumsum(asks)
    at = 0
    while at < n:  # a bounded number of (member, block) pairs at a time
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 200_000, side="right")))
        member = np.repeat(np.arange(at, to), asks[at:to])
        begin = np.cumsum(asks[at:to]) - asks[at:to]
        target = block[member] + np.arange(len(member)) - np.repeat(begin, asks[at:to])
        for i, j in _sliced(fps, lanes, valid, member, target, radius):
            lane_block, lane = j // 64, j % 64
            other = first[np.searchsorted(base, lane_block, side="right") - 1]
            other = other + (lane_block - base[np.searchsorted(base, lane_block, side="right") - 1]) * 64 + lane
            keep = other > i
            left.append(i[keep])
            right.append(other[keep])
        at = to
    return np.concatenate(left), np.concatenate(right)


def _sliced(fps, lanes, valid, member, target, radius):
    used, where = np.unique(target, return_inverse=True)
    for at in range(0, len(used), 4096):  # planes of 4096 blocks at a time
        mine = np.flatnonzero((where >= at) & (where < at + 4096))
        part = lanes[used[at : at + 4096]]
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), 64, 8), axis=2, bitorder="big")
        planes = np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little"))
        planes = planes.view("<u8")[:, :, 0]
        q, own, t = fps[member[mine]], where[mine] - at, mine
        over = ~valid[used[at:][own]] if len(own) else np.zeros(0, np.uint64)
        width = (radius + 1).bit_length()
        count = [np.zeros(len(q), np.uint64) for _ in range(width)]
        for bit in range(64):
            asked = np.uint64(0) - ((q >> np.uint64(63 - bit)) & np.uint64(1))
            carry = planes[bit][own] ^ asked
            for k in range(width):
                count[k], carry = count[k] ^ carry, count[k] & carry
            reached = FULL
            for k in range(width):
                reached = reached & (count[k] if (radius + 1) >> k & 1 else ~count[k])
            over = over | reached
            if bit % 8 == 7:
                live = np.flatnonzero(over != FULL)
                if len(live) < len(q):
                    q, own, t, over = q[live], own[live], t[live], over[live]
                    count = [c[live] for c in count]
                if not len(q):
                    break
        if len(q):
            hit = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, lane = np.nonzero(hit)
            yield member[t[row]], target[t[row]] * 64 + lane


def _keys(df: DataFrame, radius: int) -> DataFrame:
    if radius > 2:
        raise ValueError("the tables hold for a radius of 2 at most")
    piece = [F.shiftrightunsigned("fp", 48 - 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    keys = [
        F.lit(n * 2**32) + F.shiftleft(piece[i], 16) + piece[j] for n, (i, j) in enumerate(PAIRS)
    ]
    return df.withColumn("key", F.explode(F.array(*keys)))


def _refined(df: DataFrame) -> DataFrame:
    """Keys of two of the four bytes that the first key leaves open, behind that key."""
    table = F.shiftrightunsigned("key", 32)
    piece = [F.shiftrightunsigned("fp", 48 - 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    rest = None
    for n, pair in enumerate(PAIRS):
        a, b = (piece[x] for x in range(4) if x not in pair)
        value = F.shiftleft(a, 16) + b
        rest = F.when(table == n, value) if rest is None else rest.when(table == n, value)
    df = df.withColumn("rest", rest)
    byte = [F.shiftrightunsigned("rest", 24 - 8 * i).bitwiseAND(F.lit(0xFF)) for i in range(4)]
    keys = [
        F.shiftleft("key", 19) + F.lit(n * 2**16) + F.shiftleft(byte[i], 8) + byte[j]
        for n, (i, j) in enumerate(PAIRS)
    ]
    # a first key has 35 bits, so refined keys are told from it by the sign
    return df.withColumn("key", F.explode(F.array(*[-k - 1 for k in keys]))).drop("rest")


def links(distinct: DataFrame, scratch: Scratch, radius: int = 2, refine: int = 4096) -> DataFrame:
    """Pairs ``(a, b)`` of the ``rep`` of distinct fingerprints ``(fp, rep)`` within ``radius`` bits.

    At most 2,080 fingerprints lie within 2 bits of one, so the pairs are linear in the rows.
    """
    keyed = _keys(distinct, radius)
    sized = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    met = scratch.put(keyed.join(sized, "key"), "met")
    small = met.where(F.col("members") <= refine).drop("members")
    large = _refined(met.where(F.col("members") > refine).drop("members"))
    rows = small.unionByName(large)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(key, fp, rep):
            i, j = close_pairs(fp.view(np.uint64), key, radius)
            pairs = np.unique(np.stack([np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])], axis=1), axis=0)
            for at in range(0, len(pairs), 100_000):
                part = np.ascontiguousarray(pairs[at : at + 100_000].T)
                yield pa.RecordBatch.from_arrays([pa.array(part[0]), pa.array(part[1])], ["a", "b"])

        held = None
        for b in batches:  # sorted by key: the last key of a batch may go on in the next
            now = [b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "rep")]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            if len(held[0]) < 50_000:
                continue
            cut = int(np.searchsorted(held[0], held[0][-1]))
            if cut:
                yield from found(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield from found(*held)

    return (
        rows.select("key", "fp", "rep")
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(run, "a long, b long")
    )


def _classes(prints: DataFrame, scratch: Scratch, radius: int) -> DataFrame:
    """``fp, root`` of every fingerprint of ``prints`` (``doc_id, fp``): equal roots are one class.

    Fingerprints are the nodes, so rows without id link like any other; rows that repeat an id
    link their fingerprints.
    """
    distinct = scratch.put(prints.select("fp", F.col("fp").alias("rep")).distinct(), "distinct")
    by_id = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z"))
    several = by_id.where("a <> z").select("doc_id", "a")
    same = prints.join(several, "doc_id").where("a <> fp").select("a", F.col("fp").alias("b"))
    found = components(links(distinct, scratch, radius).union(same), scratch)
    joined = distinct.join(found, distinct["rep"] == found["node"], "left")
    return joined.select("fp", F.coalesce("root", "rep").alias("root"))


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """Near-duplicate classes: ``doc_id, fingerprint, component_id`` of every row.

    Nulls, empty and blank texts have fingerprint zero and link like any other.  Rows that repeat
    an id or a text share its class.  A row without id links like any other but gives no name to
    its class, whose ``component_id`` is null where no member has an id.  No rows: no rows.
    Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.put(fingerprints(docs, size), "prints")
    roots = scratch.put(_classes(prints, scratch, radius), "roots")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp")
    named = roots.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").drop("root")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """One row of ``docs`` for each class of near duplicates, all columns kept as they are.

    The row kept is that of the smallest id, rows without id last, then of the smallest hash of all
    columns; a class whose rows have no id keeps one of them.  Whole rows that are repeated are one.
    Columns of any other name are carried along.
    """
    scratch = Scratch(docs.sparkSession, "simhash-kept")
    # a row travels as one struct, so that no column of it can clash with those used here
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    rows = whole.select("row", F.xxhash64("row").alias("h"), F.xxhash64(F.lit(1), "row").alias("g"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t, size) for t in b.column("text").to_pylist()], np.uint64)
            columns = [b.column("doc_id"), b.column("h"), b.column("g"), pa.array(found.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "g", "fp"])

    read = rows.select("row.doc_id", F.col("row.text").cast("binary").alias("text"), "h", "g")
    prints = scratch.put(read.mapInArrow(run, "doc_id long, h long, g long, fp long"), "prints")
    roots = _classes(prints, scratch, radius)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "h", "g").alias("best")
    best = prints.groupBy("fp").agg(F.min(order).alias("best")).join(roots, "fp").groupBy("root").agg(F.min("best").alias("best"))
    kept = rows.join(best.select("best.h", "best.g"), ["h", "g"], "left_semi").dropDuplicates(["h", "g"])
    return kept.select("row.*")
