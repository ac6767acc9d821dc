"""The quality classifier: held-out accuracy, the fold rule, odd rows."""

import math
import zlib

import numpy as np
import pytest

from millrace.llm import quality
from millrace.llm.common import documents
from millrace.sources.tables import table

SCHEMA = "doc_id long, text string, score string, quality int, held_out int"


def test_held_out_rows_are_told_apart(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    got = quality.scored(documents(spark, sf_dir), labels).toPandas()
    assert len(got) == documents(spark, sf_dir).count()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    known = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    good, bad = (known.score[known.quality == q].to_numpy() for q in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert (known.predicted == known.quality).mean() > 0.95


def slow_features(text):
    """The features of a text, counted byte by byte and word by word."""
    text = text or b""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [1.0] + [0.0] * (quality.N_FEATURES - 1)
    classes = [sum(c in v for c in text) for v in quality.CLASSES.values()] + [sum(c > 127 for c in text)]
    kinds, lines = sorted(set(words)), text.split(b"\n")
    shares = [text.count(bytes([c])) / size for c in set(text)]
    return [
        0.0,
        *(c / size for c in classes),
        *(min(c / n, 4.0) for c in classes),
        *(math.sqrt(c / size) for c in classes),
        len(kinds) / n,
        math.log(len(kinds)) / math.log(n + 1),
        len(kinds) / math.sqrt(n),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        max(words.count(w) for w in kinds) / n,
        len(set(lines)) / len(lines),
        math.log(1 + n),
        math.log(1 + size),
        (size - n) / n,
        math.log(1 + n / len(lines)),
        -sum(x * math.log2(x) for x in shares),
        sum(w.isupper() for w in kinds) / len(kinds),
        sum(w.isalpha() for w in kinds) / len(kinds),
        sum(len(w) > 20 for w in kinds) / len(kinds),
    ]


def test_every_score_of_the_table_by_hand(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels)
    want = {}
    for r in docs.collect():
        x = [(f - c) / s for f, c, s in zip(slow_features(r.text and r.text.encode()), model.centre, model.scale, strict=True)]
        z = sum(min(max(v, -8.0), 8.0) * w for v, w in zip(x, model.weights[:-1], strict=True)) + model.weights[-1]
        want[r.doc_id] = 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))
    got = {r.doc_id: r.score for r in quality.scored(docs, labels).collect()}
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)


@pytest.mark.parametrize("prior", (0.2, 0.6))
def test_fit_reaches_the_lowest_risk(prior):
    """Classes that overlap: the risk stays above its bound, and no step from the result lowers it."""
    rng = np.random.default_rng(7)
    positive = rng.normal(0.6, 1, (4000, 2))
    n = int(prior * 4000)
    unlabelled = np.concatenate([rng.normal(0.6, 1, (n, 2)), rng.normal(-0.6, 1, (4000 - n, 2))])
    model = quality.fit(positive, unlabelled, prior, decay=0.0)

    def risk(w):
        zp, zu = (np.clip((x - model.centre) / model.scale, -8, 8) @ w[:-1] + w[-1] for x in (positive, unlabelled))
        loss = lambda z: np.log1p(np.exp(-z)).mean()
        negative = loss(-zu) - prior * loss(-zp)
        assert negative > 0
        return prior * loss(zp) + max(0.0, negative)

    lowest = risk(model.weights)
    for _ in range(60):
        assert risk(model.weights + rng.normal(0, rng.choice([0.02, 0.2]), 3)) > lowest - 1e-6


def test_held_out_labels_change_nothing(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    held = quality.held_out(labels["doc_id"])
    flipped = labels.withColumn("quality", (1 - labels["quality"]) * held.cast("int") + labels["quality"] * (~held).cast("int"))
    a, b = (quality.train(docs, x, most=50) for x in (labels, flipped))
    assert np.array_equal(a.weights, b.weights) and a.prior == b.prior


def test_risk_is_not_driven_below_zero():
    rng = np.random.default_rng(3)
    positive = rng.normal(1, 1, (3000, 4))
    unlabelled = np.concatenate([rng.normal(1, 1, (2100, 4)), rng.normal(-1.5, 1, (900, 4))])
    model = quality.fit(positive, unlabelled, 0.7)
    assert (model.scores(rng.normal(1, 1, (500, 4))) >= 0.3).mean() > 0.9
    assert (model.scores(rng.normal(-1.5, 1, (500, 4))) < 0.3).mean() > 0.9


def test_odd_rows_and_empty_tables(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    rows = [(1, None, "x", 1, 1), (2, "", None, 1, 1), (3, " \n", None, None, None), (4, "wort " * 200_000, "", 0, 0)]
    rows += [(5, "the same", "", 1, 1), (5, "the same", "", 1, 1), (None, "no id", "", 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = quality.scored(docs, labels).toPandas()
    assert len(got) == 7 and got.score.between(0, 1).all()
    blank = got[got.doc_id.isin([1, 2, 3])].score
    assert blank.nunique() == 1
    assert got[got.doc_id == 5].score.nunique() == 1
    assert not got[got.doc_id.isna()].held_out.any()
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert set(quality.scored(docs, none).toPandas().score) == {0.5}
    assert quality.scored(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, none).count() == 7
    assert quality.keep_good(docs, labels).columns == docs.columns
