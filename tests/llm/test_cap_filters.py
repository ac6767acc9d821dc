"""Cap filters: recall against all pairs, classes, tiles and odd vectors."""

import numpy as np
import pytest

from millrace.llm import cap_filters as cf

SCHEMA = "vec_id long, embedding array<float>, label int, v string, rep int, f string"


def brute(rows, least=0.9):
    ids = [r[0] for r in rows]
    v = np.array([r[1] for r in rows], np.float32).astype(float)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = unit @ unit.T >= least
    np.fill_diagonal(near, False)
    label = np.array(ids)
    for _ in ids:
        label = np.minimum(label, np.where(near, label[None, :], 2**62).min(axis=1))
    return {i: (int(n), int(c)) for i, n, c in zip(ids, near.sum(axis=1), label, strict=True)}


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "v", 2, "f") for r in rows], SCHEMA)


@pytest.mark.parametrize("tile", [1024, 16])
def test_clusters_copies_and_single_vectors(spark, tile):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(12):
        centre = rng.normal(size=32)
        for _ in range(5 * (c + 1)):
            x = centre + rng.normal(size=32) * 0.25 * rng.random()
            rows.append((len(rows) * 7, (x * rng.choice([0.01, 1, 50])).astype(np.float32).tolist()))
    rows += [(len(rows) * 7 + k, rows[3][1]) for k in range(1, 4)]
    rows += [(10_000 + k, rng.normal(size=32).astype(np.float32).tolist()) for k in range(300)]
    got = {r.vec_id: r for r in cf.near_duplicates(table(spark, rows), tile=tile).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    found, true = sum(r.n_links for r in got.values()), sum(n for n, _ in want.values())
    assert all(got[i].n_links <= n for i, (n, _) in want.items())
    assert found >= 0.99 * true
    assert np.mean([got[i].component_id == c for i, (_, c) in want.items()]) > 0.99
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0])]
    rows += [(9, [1.0, 0.0]), (8, [1.0, 0.0]), (None, [1.0, 0.0]), (7, [2.0, 0.01]), (10, [1.0, 0.0, 0.0]), (11, [5.0]), (12, [1e-30]), (13, [-1.0])]
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in cf.near_duplicates(table(spark, rows)).collect()}
    alone = {(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 10, 13)}
    assert got == alone | {(9, 2, 7, False), (8, 2, 7, False), (7, 2, 7, True), (None, 0, None, False), (11, 1, 11, True), (12, 1, 11, False)}


def test_empty_table(spark):
    assert cf.near_duplicates(table(spark, []).limit(0)).count() == 0
    assert cf.near_duplicates(table(spark, [(1, None)])).count() == 1


def test_decoding_finds_exactly_the_filters_above_the_threshold():
    rng = np.random.default_rng(6)
    code = cf.ProductCode(24, 900, 10.0)
    for _ in range(20):
        x = rng.normal(size=24)
        x /= np.linalg.norm(x)
        a, b = (book @ (x @ code.turn)[s:e] for book, s, e in zip(code.books, code.cuts, code.cuts[1:], strict=False))
        i, j = np.nonzero(a[:, None] + b[None, :] >= code.threshold)
        assert code.filters(x).tolist() == sorted((i * code.words + j).tolist())


@pytest.mark.parametrize("n", [1_000_000, 5_000_000, 100_000_000])
def test_partners_at_the_least_cosine_share_a_filter_in_large_tables(n):
    rng = np.random.default_rng(7)
    code, hits, many = cf.ProductCode(64, n, 56.0), 0, []
    for _ in range(200):
        x, y = rng.normal(size=(2, 64))
        x /= np.linalg.norm(x)
        y -= (y @ x) * x
        y = 0.9 * x + np.sqrt(1 - 0.81) * y / np.linalg.norm(y)
        a, b = code.chosen(x), code.chosen(y)
        many += [len(a), len(b)]
        hits += len(np.intersect1d(a, b)) > 0
    assert min(many) >= 56
    assert hits >= 190


def test_best_filters_are_those_of_the_largest_products():
    rng = np.random.default_rng(8)
    code = cf.ProductCode(24, 900, 10.0)
    for _ in range(20):
        x = rng.normal(size=24)
        x /= np.linalg.norm(x)
        a, b = (book @ (x @ code.turn)[s:e] for book, s, e in zip(code.books, code.cuts, code.cuts[1:], strict=False))
        assert code.best(x).tolist() == sorted(np.argsort(-(a[:, None] + b[None, :]).ravel())[: code.fewest].tolist())
