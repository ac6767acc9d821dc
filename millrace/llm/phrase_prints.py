"""Document fingerprints by locally consistent parsing.

A text is parsed in rounds.  Runs of one symbol become one symbol; deterministic coin tossing turns
each symbol and its left neighbour into a small label (twice the lowest bit in which they differ,
plus that bit), three times over, until labels are below 8 and neighbours still differ; a phrase
begins at every local minimum.  A phrase's name is a hash of its symbols, and the names are the
symbols of the next round.  Labels see a few neighbours only, so equal substrings get equal names
inside, whatever their offset.  The fingerprint is the ``size`` smallest distinct names from round
``first`` on, and two fingerprints give an estimate of the share of phrases in common.

Documents meet their successors in ranges of about equal size, cut from the sorted ids and sizes:
every range also gets a copy of the first row of the next one, and is read in order by one task
that holds a few texts at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Spans, mixed

ONE = np.uint64(1)
SIZE, FIRST, BITS = 64, 2, 40
ROW = 2048  # bytes that a row counts for beside its text


def _lowest(x: np.ndarray) -> np.ndarray:
    """Index of the lowest set bit, from the exponent of that bit as a float; 64 for zero."""
    bit = x & (np.uint64(0) - x)
    at = (bit.astype(np.float64).view(np.int64) >> 52) - 1023
    return np.where(x == 0, 64, at)


def _toss_table(n: int) -> np.ndarray:
    """Labels of all pairs (left, right) below ``n`` at ``left * n + right``."""
    left, right = np.divmod(np.arange(n * n, dtype=np.uint64), np.uint64(n))
    at = np.where(left == right, 0, _lowest(left ^ right))
    return (2 * at + ((right >> at.astype(np.uint64)) & ONE).astype(np.int64)).astype(np.uint8)


SECOND, THIRD = _toss_table(256), _toss_table(16)


def _again(label: np.ndarray, table: np.ndarray, n: int, new: np.ndarray) -> np.ndarray:
    left = np.empty_like(label)
    left[1:] = label[:-1]
    left[new] = label[new] ^ 1  # the first symbol of a text has no neighbour to differ from
    return table[left.astype(np.int32) * n + label]


def parse(symbols: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One round over texts laid end to end, ``new`` being where each begins: names, and where the
    texts begin in them.  A text of one symbol keeps it."""
    n = len(symbols)
    starts = np.zeros(n, bool)
    starts[1:] = symbols[1:] != symbols[:-1]
    starts[new] = True
    run = np.flatnonzero(starts)
    a = symbols[run]
    length = np.diff(np.r_[run, n])
    long = np.flatnonzero(length > 1)
    a[long] = mixed(a[long] * np.uint64(2) + ONE + length[long].astype(np.uint64) * np.uint64(Spans.BASE))
    new = np.searchsorted(run, new)
    m = len(a)

    differ = np.empty_like(a)
    differ[1:] = a[1:] ^ a[:-1]
    differ[new] = ONE
    at = _lowest(differ)
    label = (2 * at + ((a >> np.minimum(at, 63).astype(np.uint64)) & ONE).astype(np.int64)).astype(np.uint8)
    label = _again(_again(label, SECOND, 256, new), THIRD, 16, new)

    cut = np.zeros(m, bool)
    cut[1:-1] = (label[:-2] > label[1:-1]) & (label[1:-1] < label[2:])
    cut[new[1:] - 1] = False  # the last symbol of a text begins no phrase
    cut[new] = True
    begin = np.flatnonzero(cut)
    end = np.r_[begin[1:], m]
    names = Spans(a).of(begin, end) if m else a
    alone = end - begin == 1
    names[alone] = mixed(a[begin[alone]] + ONE)
    return names, np.searchsorted(begin, new)


def prints(texts: list[str], size: int = SIZE, first: int = FIRST) -> list[np.ndarray]:
    """Sorted distinct names (40 bits) of every text, at most ``size``; none for an empty text."""
    whole = [i for i, t in enumerate(texts) if t]
    out = [np.zeros(0, np.int64)] * len(texts)
    if not whole:
        return out
    joined = "".join(texts[i] for i in whole).encode("utf-32-le", "surrogatepass")
    symbols = np.frombuffer(joined, "<u4").astype(np.uint64)
    new = np.cumsum([0] + [len(texts[i]) for i in whole[:-1]])
    owner = np.arange(len(whole))
    found: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    level = 0
    while len(owner):
        symbols, new = parse(symbols, new)
        level += 1
        count = np.diff(np.r_[new, len(symbols)])
        done = count == 1
        of = np.repeat(owner, count)
        # the top name stands for the whole text, and is there however short the text is
        take = np.repeat(done, count) if level < first else slice(None)
        found.append((mixed(symbols[take] ^ np.uint64(level)) >> np.uint64(64 - BITS)).astype(np.int64))
        owners.append(of[take])
        stay = np.repeat(~done, count)
        symbols, owner, count = symbols[stay], owner[~done], count[~done]
        new = np.cumsum(count) - count
    key = np.unique((np.concatenate(owners) << BITS) | np.concatenate(found))
    of, name = key >> BITS, key & ((1 << BITS) - 1)
    edge = np.searchsorted(of, np.arange(len(whole) + 1))
    for k, i in enumerate(whole):
        out[i] = name[edge[k] : min(edge[k + 1], edge[k] + size)]
    return out


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated share of a text's names that the other text has too (Dice: twice the common names
    over the names of both); 1 for two empty texts."""
    both = np.union1d(a, b)[:size]
    if not len(both):
        return 1.0
    jaccard = float((np.isin(both, a, assume_unique=True) & np.isin(both, b, assume_unique=True)).mean())
    return 2 * jaccard / (1 + jaccard)


def edited(text: str, following: str) -> str:
    """The last quarter of the text replaced by as much of the beginning of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _as_text(names: np.ndarray) -> str:
    return "".join(f"{x:010x}" for x in names.tolist())


def _rows(pairs: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    """Result rows of consecutive documents, each with the text that follows."""
    texts = [p[1] for p in pairs]
    changed = [edited(a, b) for _, a, b in pairs]
    found = prints([*texts, pairs[-1][2], *changed])
    own, new = found[: len(pairs) + 1], found[len(pairs) + 1 :]
    columns = [
        pa.array([p[0] for p in pairs], pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
        pa.array([_as_text(x) for x in own[:-1]]),
        pa.array([_as_text(x) for x in new]),
        pa.array([likeness(a, b) for a, b in zip(own, new, strict=False)], pa.float64()),
        pa.array([likeness(a, b) for a, b in zip(own[:-1], own[1:], strict=True)], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA])


SCHEMA = [
    "doc_id long", "n_chars long", "edited_sha256 string", "fingerprint string", "edited_fingerprint string",
    "near_edited double", "near_next double",
]


class Cuts:
    """First keys (id, hash of the text) of consecutive ranges, null ids first, and the ranges of rows."""

    def __init__(self, keys: list[tuple[int | None, int]]):
        keys = sorted(set(keys), key=lambda k: (k[0] is not None, k[0] or 0, k[1]))
        self.n = len(keys)
        self.nulls = sum(i is None for i, _ in keys)
        self.ids = np.array([i for i, _ in keys[self.nulls :]], np.int64)
        self.ties = np.array([t for _, t in keys], np.int64)

    def of(self, ids: pa.Array, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of each row, and whether the row is equal to the first one of it."""
        null = ids.is_null().to_numpy(zero_copy_only=False)
        known = ids.fill_null(0).to_numpy(zero_copy_only=False)
        at, high = (np.searchsorted(self.ids, known, side) + self.nulls for side in ("left", "right"))
        equal = ~null & (high > at)  # ids that ranges begin with, some of them in several ranges
        for k in np.flatnonzero(equal):
            at[k] += np.searchsorted(self.ties[at[k] : high[k]], ties[k], "right")
        at = np.where(null, np.searchsorted(self.ties[: self.nulls], ties, "right"), at) - 1
        same = np.zeros(len(at), bool)
        of_known = np.flatnonzero(equal & (at >= self.nulls))
        same[of_known] = self.ids[at[of_known] - self.nulls] == known[of_known]
        same |= null
        return at, same & (self.ties[at] == ties)


def _cuts(keys: DataFrame, range_bytes: int) -> Cuts:
    """Ranges of about ``range_bytes`` from ``doc_id, tie, size``, one key of 16 bytes each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, filled = None, 0
        for b in batches:
            first = []
            columns = (b.column(c).to_pylist() for c in ("doc_id", "tie", "size"))
            for i, (doc_id, tie, size) in enumerate(zip(*columns, strict=True)):
                if last is None or (filled >= range_bytes and last != (doc_id, tie)):
                    first.append(i)
                    filled = 0
                last = (doc_id, tie)
                filled += size
            yield b.select(["doc_id", "tie"]).take(pa.array(first, pa.int64()))

    order = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc()]
    found = keys.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, "doc_id long, tie long")
    return Cuts([(r.doc_id, r.tie) for r in found.collect()])


def _ranged(docs: DataFrame, range_bytes: int) -> DataFrame | None:
    """``range, carried, doc_id, tie, text``: rows in ranges of their order, and the copies of first rows."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("tie"), text.alias("text"))
    keys = rows.select("doc_id", "tie", (F.octet_length("text") + ROW).alias("size"))
    size = keys.agg(F.sum("size")).first()[0]
    if size is None:
        return None
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = _cuts(keys, min(range_bytes, size // tasks))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["range", "carried", "doc_id", "tie", "text"]
        for b in batches:
            own = [b.column(c) for c in names[2:]]
            at, first = cuts.of(own[0], own[1].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.zeros(len(at), np.int32)), *own], names)
            if first.any():
                before = (at[first] - 1) % cuts.n  # before the first range, the last
                copies = [c.take(pa.array(np.flatnonzero(first))) for c in own]
                yield pa.RecordBatch.from_arrays([pa.array(before, pa.int32()), pa.array(np.ones(len(before), np.int32)), *copies], names)

    return rows.mapInArrow(deal, "range int, carried int, doc_id long, tie long, text string")


def fingerprinted(docs: DataFrame, range_bytes: int = 64 << 20) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    A null text is an empty one, whose fingerprint is empty: its likeness is 1 to an empty text and
    0 to others.  Rows go in ascending order of id, null first; rows of one id in the order of a
    hash of their text, so equal rows follow each other and are compared.  A single row follows
    itself.  No rows: no rows.  Other columns are ignored.

    Ranges end within an id where it repeats (also null), so none exceeds ``range_bytes`` by more
    than a text, but for rows equal in id and text; small tables have a range for each shuffle
    partition.  The driver holds one key per range: 25 MB for 100 TB.
    """
    ranged = _ranged(docs, range_bytes)
    if ranged is None:
        return docs.sparkSession.createDataFrame([], ", ".join(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: tuple[int | None, str] | None = None
        pairs: list[tuple[int | None, str, str]] = []
        size = 0
        for b in batches:
            columns = (b.column(c).to_pylist() for c in ("carried", "doc_id", "text"))
            for carried, doc_id, text in zip(*columns, strict=True):
                if pending is not None:
                    pairs.append((*pending, text))
                    size += len(pending[1])
                pending = None if carried else (doc_id, text)
                if pairs and (size > 300_000 or carried):  # pairs of one range follow each other
                    yield _rows(pairs)
                    pairs, size = [], 0

    return (
        ranged.repartition("range")
        .sortWithinPartitions("range", "carried", F.col("doc_id").asc_nulls_first(), "tie")
        .mapInArrow(run, ", ".join(SCHEMA))
    )
