"""Clustering against plain distances, and the progressive search against all distances."""

import hashlib
import math

import numpy as np
import pytest

from millrace.llm import centroids as cw
from millrace.sources.tables import table

SCHEMA = "vec_id long, embedding array<double>, v string, cluster string, n int"


def brute(rows, dims, scale, k, rounds, seed="2:"):
    """The contract in plain whole numbers; ``rows`` are (id, vector)."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [int(x) * scale if abs(x) > 1e300 else math.floor(x * scale) for x in v]) for i, v in kept]
    named = sorted((hashlib.sha256(f"{seed}{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in named[:k]]
    if not centres:
        return []

    def assign():
        out = []
        for i, v in kept:
            d, c = min((sum((x - y) ** 2 for x, y in zip(v, centre, strict=True)), c) for c, centre in enumerate(centres))
            out.append((i, v, c, d))
        return out

    for _ in range(rounds):
        members = {}
        for _, v, c, _ in assign():
            members.setdefault(c, []).append(v)
        for c, vs in members.items():
            centres[c] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    last, fits = assign(), lambda x: x if x is not None and x < 2**63 else None
    sums = {c: sum(d for *_, x, d in last if x == c) for c in {c for *_, c, _ in last}}
    known = {c: all(d < 2**63 for *_, x, d in last if x == c) for c in sums}
    whole = sum(sums.values()) if all(known.values()) else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, c, fits(d), fits(sums[c]) if known[c] else None, fits(whole), digest[c]) for i, _, c, d in last]


def got(df):
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in df.select(columns).collect()), key=str)


def test_transform_keeps_distances_and_orders_sign_changes():
    rng = np.random.default_rng(1)
    for size in (1, 2, 8, 64):
        basis = cw.walsh(np.eye(size, dtype=np.int64))
        changes = [(np.diff(np.sign(c)) != 0).sum() for c in basis.T]
        assert changes == list(range(size))
        x, y = rng.integers(-500, 500, (2, 20, size))
        assert (((cw.walsh(x) - cw.walsh(y)) ** 2).sum(axis=1) == size * ((x - y) ** 2).sum(axis=1)).all()


@pytest.mark.parametrize("size", [1, 4, 64, 128])
def test_search_equals_all_distances(size):
    rng = np.random.default_rng(size)
    for spread in (1, 3, 300):
        rows, centres = rng.integers(-spread, spread + 1, (700, size)), rng.integers(-spread, spread + 1, (40, size))
        rows[:100] = centres[rng.integers(0, 40, 100)] + rng.integers(0, 2, (100, size))
        centres[7] = centres[3]  # a tie for every vector
        whole = ((rows[:, None] - centres[None]) ** 2).sum(axis=2)
        number, distance = cw.nearest(cw.walsh(rows), cw.walsh(centres))
        assert (number == whole.argmin(axis=1)).all() and (distance == size * whole.min(axis=1)).all()
        big = cw.nearest(cw.walsh(rows.astype(object)), cw.walsh(centres.astype(object)))
        assert (big[0] == number).all() and (big[1] == distance).all()


def test_few_centroids_leave_the_search_late():
    rng = np.random.default_rng(3)
    smooth = np.repeat(rng.integers(-9, 9, (40, 4)), 16, axis=1)  # the coarse coefficients tell these apart
    rows = cw.walsh(smooth[rng.integers(0, 40, 500)] + rng.integers(-1, 2, (500, 64)))
    part = ((rows[:, None, :8] - cw.walsh(smooth)[None, :, :8]) ** 2).sum(axis=2)
    _, distance = cw.nearest(rows, cw.walsh(smooth))
    assert (part <= distance[:, None]).sum() < 2 * len(rows)


def test_whole_table_equals_brute_force(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    assert got(cw.clustered(vectors)) == sorted(brute(rows, 64, 256, 40, 5), key=str)


def odd_rows():
    return [
        (1, [0.5, -0.25, 1.0]), (2, [0.5, -0.25, 1.0]), (2, [3.0, 3.0, 3.0]), (3, None), (4, []), (5, [1.0, 2.0]), (6, [1.0, None, 2.0]),
        (7, [1.0, math.nan, 2.0]), (8, [math.inf, 0.0, 0.0]), (None, [9.0, 9.0, 9.0]), (None, [0.5, -0.25, 1.0]), (9, [0.0, 0.0, 0.0]),
        (10, [-0.001, -1e-300, 0.0]), (11, [1.0, 2.0, 3.0, 4.0]),
    ]


@pytest.mark.parametrize("extra", [[], [(20, [1e30, 0.0, -5.0]), (21, [1.7e308, 1.0, 1.0]), (22, [3e9, 1.0, 1.0]), (23, [2.9e9, 1.0, 1.0])]])
def test_odd_vectors_repeats_and_clashing_columns(spark, extra):
    rows = odd_rows() + extra
    vectors = spark.createDataFrame([(i, v, "x", "y", 1) for i, v in rows], SCHEMA)
    for k, rounds in ((3, 4), (40, 2), (1, 0)):
        found = got(cw.clustered(vectors, dims=3, k=k, rounds=rounds))
        assert found == sorted(brute(rows, 3, 256, k, rounds), key=str)


def test_no_vectors(spark):
    none = spark.createDataFrame([(1, None, "", "", 1), (None, [1.0] * 64, "", "", 1)], SCHEMA)
    assert cw.clustered(none).count() == 0 and cw.clustered(none.limit(0)).count() == 0
