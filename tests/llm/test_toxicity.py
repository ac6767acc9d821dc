"""Toxic passages: segments against brute force, the fold rule, planted passages, odd rows."""

import random
import zlib

import numpy as np
import pytest

from millrace.llm import queries as _registered  # noqa: F401
from millrace.llm import toxicity
from millrace.llm.common import documents
from millrace.llm.registry import QUERIES
from millrace.sources.tables import table

SCHEMA = "doc_id long, text string, kind string, score string, n long"
BAD = [f"bad{n}" for n in range(12)]


def brute_segments(scores):
    """All maximal segments by definition: the best one, then those left and right of it."""
    best = None
    for s in range(len(scores)):
        for e in range(s + 1, len(scores) + 1):
            total = sum(scores[s:e])
            # of equal ones the shorter, then the first
            if total > 0 and (best is None or (total, s - e, -s) > (best[2], best[0] - best[1], -best[0])):
                best = (s, e, total)
    if best is None:
        return []
    s, e, _ = best
    left = brute_segments(scores[:s])
    right = [(a + e, b + e, t) for a, b, t in brute_segments(scores[e:])]
    return [*left, best, *right]


def test_segments_equal_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        scores = [rng.choice([-3, -2, -1, 1, 2, 5]) + rng.random() / 64 for _ in range(rng.randrange(25))]
        got = toxicity.segments(np.array(scores, float))
        want = brute_segments(scores)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want])
    assert toxicity.segments(np.zeros(0)) == []


def test_segments_are_linear():
    scores = np.tile([3.0, -2.0, 1.0, -4.0], 50_000)
    assert len(toxicity.segments(scores)) == 100_000
    assert len(toxicity.segments(np.tile([3.0, -2.0], 100_000))) == 1


def planted(n=600, seed=1):
    """Texts of random words; every fifth holds a passage of bad words, whose places are returned."""
    rng, texts, places = random.Random(seed), [], {}
    plain = [f"w{n}" for n in range(500)]
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(30, 200))]
        if i % 5 == 0:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(BAD).upper() + rng.choice(["", ",", "!"]) for _ in range(6)]
            places[i] = at
        texts.append(" ".join(words))
    return texts, places


@pytest.fixture(scope="module")
def trained(spark):
    texts, places = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in places)) for i in range(len(texts))], "doc_id long, toxic int")
    return docs, labels, places


def test_planted_passages_are_found(spark, trained):
    docs, labels, places = trained
    got = toxicity.scored(docs, labels).toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.doc_id.isin(list(places))).all() and held.predicted.sum() > 10
    model = toxicity.train(docs, labels)
    rows = toxicity.passages(docs, model).collect()
    assert {r.doc_id for r in rows} == set(places)
    exact = [r for r in rows if r.first_word == places[r.doc_id] and r.n_words == 6]
    assert len(exact) > 0.9 * len(places) and all(r.expected < model.level for r in rows)
    assert all(w.strip(",!") in BAD for r in exact for w in r.text.split())


def test_expectations_hold_in_clean_text(spark, trained):
    docs, labels, _ = trained
    model = toxicity.train(docs, labels)
    scorer = toxicity.Scorer({"w1": 1.0, "w2": 0.5}, frozenset(), 0.5)
    rng = np.random.default_rng(2)
    rate = toxicity.rate_of(np.array([1.0, 0.5, -0.5]), np.array([1.0, 1.0, 8.0]))
    assert abs(np.exp(rate * np.array([1.0, 0.5, -0.5])) @ [0.1, 0.1, 0.8] - 1) < 1e-6
    best = []
    for _ in range(2000):
        words = [f"w{n}" for n in rng.integers(1, 11, 200)]
        best.append(max([s for *_, s in toxicity.segments(scorer.text(words))], default=0.0))
    best = np.array(best)
    density = len(best) / (200 * np.exp(-rate * best)).sum()
    fitted = toxicity.Model(model.lexicon, rate, density, (0, 0), 0.01)
    for share in (0.2, 0.05):  # as many clean texts as expected have a segment that is expected so rarely
        seen = (fitted.expected(200, best) < -np.log1p(-share)).mean()
        assert share / 2.5 < seen < share * 2.5


def test_query_fold_and_labels(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    got = QUERIES["op13_toxicity"](spark, sf_dir).toPandas()
    assert len(got) == documents(spark, sf_dir).count() and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.5)).all()
    held = toxicity.held_out(labels["doc_id"]).cast("int")
    flipped = labels.withColumn("toxic", (1 - labels["toxic"]) * held + labels["toxic"] * (1 - held))
    again = toxicity.scored(documents(spark, sf_dir), flipped).toPandas()
    assert sorted(zip(got.doc_id, got.score, strict=True)) == sorted(zip(again.doc_id, again.score, strict=True))


def test_held_out_documents_of_a_larger_table(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    got = toxicity.scored(docs, labels).toPandas()
    known = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert (known.predicted[known.toxic == 0] == 0).mean() > 0.97
    assert known.predicted[known.toxic == 1].mean() > 0.6


def test_odd_rows_and_empty_tables(spark, trained):
    docs, labels, _ = trained
    rows = [(1, None), (2, ""), (3, " \n"), (4, "wort " * 200_000), (5, "bad1 bad2 bad3 " * 3), (5, "bad1 bad2 bad3 " * 3), (None, "bad1 bad2 bad3 " * 3)]
    odd = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA)
    whole = docs.selectExpr("doc_id + 100 as doc_id", "text", "'x' as kind", "'y' as score", "1L as n").union(odd)
    shifted = labels.selectExpr("doc_id + 100 as doc_id", "toxic").union(spark.createDataFrame([(None, 1), (7, None), (1, 1)], labels.schema))
    got = toxicity.scored(whole, shifted).toPandas()
    got = got[~(got.doc_id >= 100)]
    assert len(got) == 7
    blank = got[got.doc_id.isin([1, 2, 3])].score
    assert blank.nunique() == 1 and blank.iloc[0] < 0.5
    assert got[(got.doc_id == 5) | got.doc_id.isna()].score.nunique() == 1
    assert not got[got.doc_id.isna()].held_out.any()
    assert set(toxicity.scored(odd, labels.limit(0)).toPandas().score) == {0.0}
    assert set(toxicity.scored(odd, labels.where("toxic = 0")).toPandas().score) == {0.0}
    assert toxicity.scored(odd.limit(0), labels).count() == 0
