"""Near duplicates of vectors by spherical-cap filters from random product codes.

A filter is a direction; a vector belongs to all filters whose inner product with it exceeds a
threshold, so vectors at a small angle share caps.  Directions are product codes: the coordinates
are cut into ``parts``, each with its own random codebook, and every combination of one codeword per
part is a filter.  A vector's filters are decoded from the sorted products of each part, without
looking at the others.  Codebooks grow with the number of vectors, which keeps the vectors of a
filter constant.  Products of unit vectors spread less than normal ones, so the threshold is a
quantile of the projected sphere, and a vector that exceeds it in fewer than ``fewest`` filters takes
its best ones instead; ``fewest`` is ``caps`` up to a million vectors and grows slowly from there,
which holds the recall at a cosine of 0.9.

Vectors join on filters.  Inside a filter all pairs are compared in double precision; filters with
many vectors are cut into tiles, and pairs of tiles go to different tasks.  A pair counts only in
the first filter that both are in, so links are counted without a table of links; for components,
a filter gives a spanning forest of what it has linked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch
from millrace.llm.components import components


class ProductCode:
    """Codebooks for ``dims`` coordinates and about four filters for each of ``n`` vectors.

    Vectors are turned at random first, into 32 coordinates at least, so that every part has its
    share of them, also of short or sparse ones.
    """

    def __init__(self, dims: int, n: int, caps: float, seed: int = 7):
        self.parts = 2 if n <= 400_000_000 else 3 if n <= 4_000_000_000 else 4
        self.words = max(32, math.ceil((4 * n) ** (1 / self.parts)))
        rng = np.random.default_rng([seed, dims])
        self.turn = np.linalg.qr(rng.normal(size=(max(dims, 32), dims)))[0].T
        dims = max(dims, 32)
        self.cuts = np.linspace(0, dims, self.parts + 1).astype(int)
        self.books = []
        for a, b in zip(self.cuts, self.cuts[1:], strict=False):
            book = rng.normal(size=(self.words, b - a))
            book *= math.sqrt((b - a) / dims) / np.linalg.norm(book, axis=1, keepdims=True)
            self.books.append(book)
        tail = min(0.4, caps / self.words**self.parts)
        # a product of two random unit vectors has the density (1 - x^2)^((dims - 3) / 2); summed from 1 downwards
        x = np.linspace(1, 0, 200_001)
        above = np.cumsum((1 - x * x) ** ((dims - 3) / 2))
        self.threshold = float(np.interp(tail, above / (2 * above[-1]), x))
        self.fewest = math.ceil(caps * max(1.0, n / 1_000_000) ** 0.125)

    def filters(self, unit: np.ndarray) -> np.ndarray:
        """Sorted numbers of all filters that the vector exceeds."""
        unit = unit @ self.turn
        products = [book @ unit[a:b] for book, a, b in zip(self.books, self.cuts, self.cuts[1:], strict=False)]
        best = np.array([p.max() for p in products])
        codes, sums = np.zeros(1, np.int64), np.zeros(1)
        for i, p in enumerate(products):  # prefixes that the best of the later parts can still lift
            order = np.argsort(-p)
            need = self.threshold - best[i + 1 :].sum() - sums
            many = np.searchsorted(-p[order], -need, side="right")
            row = np.repeat(np.arange(len(codes)), many)
            at = order[np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)]
            codes, sums = codes[row] * self.words + at, sums[row] + p[at]
        return np.sort(codes)

    def best(self, unit: np.ndarray) -> np.ndarray:
        """Sorted numbers of the ``fewest`` filters with the largest products."""
        unit = unit @ self.turn
        codes, sums = np.zeros(1, np.int64), np.zeros(1)
        for book, a, b in zip(self.books, self.cuts, self.cuts[1:], strict=False):
            p = book @ unit[a:b]
            order = np.argsort(-p)[: self.fewest]
            # sums and products fall, so place (i, j) has (i + 1)(j + 1) - 1 places before it
            many = np.minimum(self.fewest // np.arange(1, len(codes) + 1), len(order))
            row = np.repeat(np.arange(len(codes)), many)
            at = order[np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)]
            codes, sums = codes[row] * self.words + at, sums[row] + p[at]
            top = np.argsort(-sums)[: self.fewest]
            codes, sums = codes[top], sums[top]
        return np.sort(codes)

    def chosen(self, unit: np.ndarray) -> np.ndarray:
        """The filters that the vector exceeds, or its best ones where those are fewer than ``fewest``."""
        found = self.filters(unit)
        return found if len(found) >= self.fewest else self.best(unit)


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v``: rows with an id whose vector has finite components, no nulls, and is not zero."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0.0)
    return vectors.select("vec_id", v.alias("v")).where("vec_id is not null").where(F.coalesce(finite & some, F.lit(False)))


def _spanning(left: np.ndarray, right: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a forest over the ids of rows and columns that ``linked`` joins."""
    edges: list[tuple[int, int]] = []
    ids, where = np.unique(np.r_[left, right], return_inverse=True)
    i, j = np.nonzero(linked)
    i, j = where[: len(left)][i], where[len(left) :][j]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(ids)))
    edges += zip(ids[moved].tolist(), ids[label[moved]].tolist(), strict=True)
    return edges


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; the largest component is taken out first, so that no square leaves the range."""
    unit = v / np.linalg.norm(v / np.abs(v).max(axis=1, keepdims=True), axis=1, keepdims=True)
    return unit / np.abs(v).max(axis=1, keepdims=True)


def _compare(f: int, left: dict, right: dict | None, least: float):
    """Counts of links (rows and columns) that belong to this filter, and edges of all links."""
    other = left if right is None else right
    linked = left["unit"] @ other["unit"].T >= least
    if right is None:
        np.fill_diagonal(linked, False)
    if not linked.any():
        return None
    rows, columns = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    sub = linked[np.ix_(rows, columns)]
    earlier = [[x[x < f] for x in (side["caps"][k] for k in at)] for side, at in ((left, rows), (other, columns))]
    known = np.unique(np.concatenate([*earlier[0], *earlier[1], np.zeros(0, np.int64)]))
    if len(known):
        shared = np.zeros(sub.shape, np.float32)
        for at in range(0, len(known), 4096):  # a bounded part of the earlier filters at a time
            part = known[at : at + 4096]
            inside = [np.zeros((len(side), len(part)), np.float32) for side in earlier]
            for m, side in zip(inside, earlier, strict=True):
                for k, x in enumerate(side):
                    x = x[(x >= part[0]) & (x <= part[-1])]
                    m[k, np.searchsorted(part, x)] = 1
            shared += inside[0] @ inside[1].T
        own = sub & (shared == 0)
    else:
        own = sub
    counts = [(left["rep"][rows], own @ other["copies"][columns])]
    if right is not None:
        counts.append((other["rep"][columns], own.T @ left["copies"][rows]))
    return counts, _spanning(left["rep"][rows], other["rep"][columns], sub)


def _linked(classes: DataFrame, scratch: Scratch, dims: int, n: int, least: float, caps: float, tile: int) -> DataFrame:
    """``rep, n, root``: partial counts of links (root null), and edges between classes (n null)."""
    code = ProductCode(dims, n, caps)  # a few thousand codewords, from a seed
    kind = np.dtype("<i4" if code.words**code.parts < 2**31 else "<i8")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                found = [code.chosen(x) for x in _unit(v)]
                with np.errstate(over="ignore"):
                    short = v.astype("<f4")  # half as long, where that loses nothing
                sent = [(a if (a == b).all() else b).tobytes() for a, b in zip(short, v, strict=True)]
                earlier = [x.astype(kind)[:k].tobytes() for x in found for k in range(len(x))]
                many = [len(x) for x in found]
                row = np.repeat(np.arange(part.num_rows), many)
                columns = [
                    pa.array(np.concatenate([*found, np.zeros(0, np.int64)])),
                    part.column("rep").take(pa.array(row)),
                    part.column("copies").take(pa.array(row)),
                    pa.array(sent, pa.binary()).take(pa.array(row)),
                    pa.array(earlier, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["f", "rep", "copies", "v", "caps"])

    caught = classes.mapInArrow(decode, "f long, rep long, copies long, v binary, caps binary")
    caught = scratch.put(caught, f"caught-{dims}")
    sizes = caught.groupBy("f").agg(F.count("*").alias("members")).where("members > 1")
    tiles = scratch.put(sizes.select("f", F.ceil(F.col("members") / tile).alias("tiles")), f"tiles-{dims}")
    own = F.pmod(F.xxhash64("rep"), F.col("tiles"))
    rows = caught.join(tiles, "f").withColumn("tile", own)
    # a row meets every tile of its filter once: as (low, high) pair of tiles
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    rows = rows.withColumns({"low": F.least("tile", "with"), "high": F.greatest("tile", "with")})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def side(rows: list) -> dict:
            return {
                "rep": np.array([r[0] for r in rows], np.int64),
                "copies": np.array([r[1] for r in rows], np.int64),
                "unit": _unit(np.array([np.frombuffer(r[2], "<f4" if len(r[2]) == 4 * dims else "<f8") for r in rows], float)),
                "caps": [np.frombuffer(r[3], kind) for r in rows],
            }

        def finish(key: tuple, group: list):
            f, low, high = key
            if low == high:
                return _compare(f, side([r[1:] for r in group]), None, least) if len(group) > 1 else None
            parts = [[r[1:] for r in group if r[0] == t] for t in (low, high)]
            return _compare(f, side(parts[0]), side(parts[1]), least) if all(parts) else None

        def out(found) -> Iterator[pa.RecordBatch]:
            reps = [x for counts, _ in found for x, _ in counts] + [np.array([a for _, e in found for a, _ in e], np.int64)]
            n = [x for counts, _ in found for _, x in counts]
            roots = [b for _, e in found for _, b in e]
            filled = sum(map(len, n))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(reps)),
                    pa.array([*np.concatenate([*n, np.zeros(0, np.int64)]).tolist(), *[None] * len(roots)], pa.int64()),
                    pa.array([None] * filled + roots, pa.int64()),
                ],
                ["rep", "n", "root"],
            )

        key, group, found = None, [], []
        names = ("f", "low", "high", "tile", "rep", "copies", "v", "caps")
        for b in batches:
            for f, low, high, *row in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                if (f, low, high) != key:
                    if key is not None and (got := finish(key, group)):
                        found.append(got)
                    if len(found) >= 500:
                        yield from out(found)
                        found = []
                    key, group = (f, low, high), []
                group.append(row)
        if key is not None and (got := finish(key, group)):
            found.append(got)
        if found:
            yield from out(found)

    keys = ["f", "low", "high"]
    return (
        rows.select(*keys, "tile", "rep", "copies", "v", "caps")
        .repartition(*keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(compare, "rep long, n long, root long")
    )


def near_duplicates(vectors: DataFrame, least: float = 0.9, caps: float = 56.0, tile: int = 1024) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors`` (``vec_id, embedding``).

    Vectors link at a cosine of ``least`` or more; every link found is verified, and those missed
    are few (tests measure the recall against all pairs).  Equal vectors are one class, whose copies
    link with each other.  A vector that is null, zero, empty, or has a null or non-finite component
    links with nothing and is kept; so does a row without id, whose component is null and which is
    not kept.  Vectors of different lengths do not link.  ``vec_id`` names one vector.  No rows: no
    rows.  Other columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession, "caps")
    good = usable(vectors)
    classes = good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = scratch.put(classes.withColumn("dims", F.size("v")), "classes")
    found = None
    kinds = classes.groupBy("dims").agg(F.count("*").alias("n")).orderBy("dims").collect()  # one row per vector length
    for dims, n in kinds:
        some = _linked(classes.where(F.col("dims") == dims), scratch, dims, n, least, caps, tile)
        found = some if found is None else found.union(some)
    rows = vectors.select("vec_id")
    if found is None:
        return rows.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept")
        )
    found = scratch.put(found, "found")
    counts = found.where("n is not null").groupBy("rep").agg(F.sum("n").alias("n"))
    roots = components(found.where("root is not null").select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch)
    by_class = (
        classes.join(counts, "rep", "left")
        .join(roots, classes["rep"] == roots["node"], "left")
        .select("v", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("root", "rep").alias("c"))
    )
    linked = good.join(by_class, "v").select("vec_id", F.col("n").alias("n_links"), F.col("c").alias("component_id"))
    bad = usable_not(vectors).select("vec_id", F.lit(0).cast("long"), "vec_id")
    return linked.union(bad).withColumn("kept", F.coalesce(F.expr("vec_id = component_id"), F.lit(False)))


def usable_not(vectors: DataFrame) -> DataFrame:
    """The rows that ``usable`` leaves out."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0.0)
    return vectors.where(F.col("vec_id").isNull() | ~F.coalesce(finite & some, F.lit(False))).select("vec_id")
