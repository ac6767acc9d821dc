"""Removal of passages that repeat across documents, by a compacted de Bruijn graph of word windows.

Every window of ``window`` words is an edge of the graph.  The smallest hash among the k-mers inside
a window (its minimiser) names the bucket of the edge, so equal windows meet wherever they stand.
Consecutive windows of a document with the same minimiser are a path without a branch; it is
compacted to one row that holds the minimiser, the hash of all its words and its source
coordinates.  Spark joins then compare paths instead of windows:

* paths whose minimiser occurs in one document only are dropped;
* equal paths fall together in one row with the smallest document, their first source;
* only where different paths share a minimiser, which is at the ends of a repeated passage or
  around an edit, the first source of each path is read again at its coordinates and verified
  window by window.

Words are compared through two independent 64-bit hashes (minimiser and path, minimiser and window).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, Spans, id_and_bytes, mixed

MARKS = "_removed_windows"


def _symbols(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def paths(symbols: np.ndarray, window: int) -> tuple | None:
    """Compacted paths of one document: minimiser, hash of the words, first window, windows, and as
    bytes the other places where the same path begins (a line said again and again is one path)."""
    n = len(symbols) - window + 1
    if n < 1:
        return None
    k = (2 * window) // 5  # 20 words of 50: long enough to be rare, short enough to be sparse
    spans = Spans(symbols)
    at = np.arange(len(symbols) - k + 1)
    kmers = spans.of(at, at + k)
    view = np.lib.stride_tricks.sliding_window_view(kmers, window - k + 1)
    least = np.empty(n, np.int64)
    for s in range(0, n, 65_536):
        least[s : s + 65_536] = view[s : s + 65_536].argmin(axis=1)
    least += np.arange(n)
    start = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    end = np.r_[start[1:], n]
    core, whole, n = kmers[least[start]], spans.of(start, end - 1 + window), end - start
    order = np.argsort(whole, kind="stable")
    first = np.flatnonzero(np.r_[True, whole[order[1:]] != whole[order[:-1]]])
    more = [None] * len(first)
    size = np.diff(np.r_[first, len(order)])
    for i in np.flatnonzero(size > 1).tolist():
        more[i] = start[order[first[i] + 1 : first[i] + size[i]]].astype("<i8").tobytes()
    one = order[first]
    return core[one], whole[one], start[one], n[one], more


def places(s: np.ndarray, n: np.ndarray, more: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """First windows and numbers of windows of runs, with the other places of each run."""
    others = [(np.frombuffer(m, "<i8"), k) for m, k in zip(more, n.tolist(), strict=True) if m]
    if not others:
        return s, n
    return np.concatenate([s, *(o for o, _ in others)]), np.concatenate([n, *(np.full(len(o), k) for o, k in others)])


def _batch(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def _all_paths(docs: DataFrame, window: int) -> DataFrame:
    names = ["core", "whole", "doc_id", "s", "n", "more"]

    def joined(parts: list[tuple]) -> pa.RecordBatch:
        *columns, more = zip(*parts, strict=True)
        return _batch(names, [*map(np.concatenate, columns), pa.array([m for part in more for m in part], pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, size = [], 0
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if text and doc_id is not None and (found := paths(_symbols(text.split()), window)):
                    core, whole, s, n, more = found
                    parts.append((core.view(np.int64), whole.view(np.int64), np.full(len(s), doc_id), s, n, more))
                    size += len(s)
                if size > 100_000:
                    yield joined(parts)
                    parts, size = [], 0
            if parts:
                yield joined(parts)

    return id_and_bytes(docs).mapInArrow(run, "core long, whole long, doc_id long, s long, n long, more binary")


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """The windows of the paths in ``todo`` (structs of core, s, n, more), read again at their place."""
    names = ["core", "word_hash", "doc_id", "s", "more"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            todo = b.column("todo")
            for i, (doc_id, text) in enumerate(
                zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)
            ):
                spans = Spans(_symbols((text or b"").split()))
                values = todo[i].values
                core, s, n = (values.field(f).to_numpy(zero_copy_only=False) for f in ("core", "s", "n"))
                more = [m and np.frombuffer(m, "<i8") for m in values.field("more").to_pylist()]
                path = np.repeat(np.arange(len(s)), n)
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = s[path] + step
                fits = at + window < len(spans.sums)
                path, step, at = path[fits], step[fits], at[fits]
                hashes = mixed(spans.of(at, at + window) + np.uint64(1)).view(np.int64)
                for cut in range(0, len(at), 100_000):
                    part = slice(cut, cut + 100_000)
                    others = [
                        None if more[p] is None else (more[p] + k).tobytes()
                        for p, k in zip(path[part].tolist(), step[part].tolist(), strict=True)
                    ]
                    here = [core[path[part]], hashes[part], np.full(len(at[part]), doc_id), at[part]]
                    yield _batch(names, [*here, pa.array(others, pa.binary())])

    return rows.mapInArrow(run, "core long, word_hash long, doc_id long, s long, more binary")


def repeats(docs: DataFrame, scratch: Scratch, window: int = 50) -> DataFrame:
    """``doc_id, s, n, more``: runs of n windows from s on, and from the places in ``more`` on, that
    also start in a document of a smaller id."""
    found = _all_paths(docs, window)
    shared = (
        found.groupBy("core")
        .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("whole").alias("x"), F.max("whole").alias("y"))
        .where("lo < hi")
        .select("core", "lo", (F.col("x") < F.col("y")).alias("branches"))
    )
    # written, so that the join reads two plain exchanges and Spark can split a hot minimiser
    shared = scratch.put(shared, "shared")
    met = scratch.put(found.join(shared, "core").where("branches or doc_id > lo"), "met")
    plain = met.where("not branches").select("doc_id", "s", "n", "more")
    forked = met.where("branches")
    first = forked.groupBy("core", "whole").agg(F.min("doc_id").alias("source"))
    first = scratch.put(first, "first")
    forked = scratch.put(forked.join(first, ["core", "whole"]), "forked")
    copied = forked.where("doc_id > source").select("doc_id", "s", "n", "more")
    todo = (
        forked.where("doc_id = source")
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("core", "s", "n", "more")).alias("todo"))  # as many as the document has paths
    )
    windows = scratch.put(_windows(id_and_bytes(docs).join(todo, "doc_id"), window), "windows")
    again = (
        windows.groupBy("core", "word_hash")
        .agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"))
        .where("source < last")
    )
    again = scratch.put(again, "again")
    verified = (
        windows.join(again, ["core", "word_hash"])
        .where("doc_id > source")
        .select("doc_id", "s", F.lit(1).cast("long").alias("n"), "more")
    )
    return plain.union(copied).union(verified)


def covered(n_words: int, s: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Which of ``n_words`` words lie in a removed window."""
    step = np.zeros(n_words + 1, np.int64)
    s, e = np.minimum(s, n_words), np.minimum(s + n - 1 + window, n_words)
    np.add.at(step, s, 1)
    np.add.at(step, e, -1)
    return np.cumsum(step[:-1]) > 0


def _with_marks(docs: DataFrame, scratch: Scratch, window: int) -> DataFrame:
    marks = repeats(docs, scratch, window).groupBy("doc_id").agg(F.collect_list(F.struct("s", "n", "more")).alias(MARKS))
    return docs.join(marks, "doc_id", "left")


def _kept(text: bytes | None, marks, window: int) -> tuple[int, int, bytes]:
    words = (text or b"").split()
    if marks is None or not len(marks):
        return len(words), 0, b" ".join(words)
    s, n = (marks.field(f).to_numpy(zero_copy_only=False) for f in ("s", "n"))
    s, n = places(s, n, marks.field("more").to_pylist())
    gone = covered(len(words), s, n, window)
    return len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)


def without_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row.

    A null text has no words.  Texts of fewer than ``window`` words lose nothing and take nothing
    from others.  Repeats inside one document stay.  ``doc_id`` names one text: rows that repeat an
    id with the same text get the same result; the windows of different texts under one id are
    taken to be one document's.  A row without id loses nothing and is no source.  No rows: no
    rows.  Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "substrings")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = b.column(MARKS)
            rows = [
                _kept(t, marks[i].values, window) for i, t in enumerate(b.column("text").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return _with_marks(id_and_bytes(docs), scratch, window).mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept_sha256 string"
    )


def cut_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """``docs`` with the kept words as text (joined by one space) where a document lost words, and
    ``n_chars`` to match; all other rows and columns as they were, none dropped."""
    scratch = Scratch(docs.sparkSession, "substrings")

    @F.pandas_udf("string")
    def keep(texts, marks):
        import pandas as pd

        out = [None] * len(texts)
        for i, (t, m) in enumerate(zip(texts, marks, strict=True)):
            if t is not None and m is not None:
                words = t.split()
                s, n = (np.array([r[f] for r in m], np.int64) for f in ("s", "n"))
                s, n = places(s, n, [r["more"] for r in m])
                gone = covered(len(words), s, n, window)
                out[i] = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode()
        return pd.Series(out, dtype=object)

    marked = F.col(MARKS).isNotNull() & F.col("text").isNotNull()
    text = F.when(marked, keep(F.when(marked, F.col("text").cast("binary")), MARKS)).otherwise(F.col("text"))
    cut = _with_marks(docs, scratch, window).withColumn("text", text)
    if "n_chars" in docs.columns:
        length = F.when(marked, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        cut = cut.withColumn("n_chars", length)
    return cut.select(docs.columns)
