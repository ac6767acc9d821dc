"""Quality classifier learned from trusted positives and unlabelled text.

A logistic model over surface features minimises the non-negative unbiased risk

    prior * R+(positives)  +  max(0, R-(unlabelled) - prior * R-(positives))

whose second part is climbed instead of descended while it is negative.  The texts labelled 0 are
never training examples; they only help to estimate the class prior of the unlabelled rows.  The
model is fitted on bounded samples (``most``, a parameter) of rows picked by a hash of their id,
and scores every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import id_and_bytes

# Classes of ASCII bytes that features count.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "end": b".!?",
    "pause": b",;:",
    "bang": b"!",
    "bar": b"|",
    "mark": b"#$%&*@^~=+<>_\\",
    "bracket": b"()[]{}",
    "quote": b"\"'`",
    "line": b"\n",
    "blank": b" \t",
    "slash": b"/",
}
HIGH = np.arange(256) >= 128
SELECT = np.array([[c in v for c in range(256)] for v in CLASSES.values()] + [HIGH], np.float64).T


def features(text: bytes | None) -> np.ndarray:
    """Surface features of a whole text; for null, empty and blank texts all but the flag are 0."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return np.r_[1.0, np.zeros(N_FEATURES - 1)]
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    by_class = counts @ SELECT
    kinds: dict[bytes, int] = {}
    same = 0
    before = None
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
        same += w == before
        before = w
    lines = text.split(b"\n")
    share = counts[counts > 0] / len(text)
    distinct = len(kinds)
    return np.r_[
        0.0,
        by_class / len(text),
        np.minimum(by_class / n, 4.0),
        np.sqrt(by_class / len(text)),
        distinct / n,
        np.log(distinct) / np.log(n + 1.0),
        distinct / np.sqrt(n),
        same / n,
        max(kinds.values()) / n,
        len(set(lines)) / len(lines),
        np.log1p(n),
        np.log1p(len(text)),
        (len(text) - n) / n,
        np.log1p(n / len(lines)),
        -(share * np.log2(share)).sum(),
        sum(w.isupper() for w in kinds) / distinct,
        sum(w.isalpha() for w in kinds) / distinct,
        sum(len(w) > 20 for w in kinds) / distinct,
    ]


N_FEATURES = 1 + 3 * (len(CLASSES) + 1) + 14


@dataclass(frozen=True)
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        x = np.clip((rows - self.centre) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, decay: float = 1e-4) -> Model:
    """Minimise the non-negative risk with the logistic loss by full-batch Adam from zero."""
    both = np.concatenate([positive, unlabelled])
    centre, scale = both.mean(axis=0), both.std(axis=0) + 1e-6
    p, u = (np.c_[np.clip((x - centre) / scale, -8, 8), np.ones(len(x))] for x in (positive, unlabelled))
    w = np.zeros(p.shape[1])
    first, second = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        rise_p = prior * (p.T @ (sigmoid(zp) - 1)) / len(p)
        rise_n = u.T @ sigmoid(zu) / len(u) - prior * (p.T @ sigmoid(zp)) / len(p)
        risk_n = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        grad = rise_p + rise_n if risk_n >= 0 else -rise_n
        grad[:-1] += decay * w[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        rate = 0.05 * (1 - (t - 1) / steps) + 1e-3
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return Model(centre, scale, w, prior)


def held_out(doc_id: Column) -> Column:
    """Whether the id belongs to the fold that nothing is learned from (false for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _table(docs: DataFrame, schema: str, make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            rows = np.array([features(t) for t in texts]) if texts else np.zeros((0, N_FEATURES))
            yield make(b, rows)

    return docs.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, most: int = 8000) -> Model | None:
    """Fit on at most about ``most`` positives and as many unlabelled rows outside the held-out fold.

    ``labels`` has ``doc_id, quality``.  None if there is nothing to learn from: no positive label
    or no document.  The prior is the share of positives among the labelled rows of the fold,
    smoothed by one row of each kind.
    """
    known = labels.select("doc_id", "quality").where(~held_out(F.col("doc_id")) & F.col("quality").isNotNull())
    some = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    n_known, n_positive = known.agg(F.count("*"), F.coalesce(F.sum(F.expr("int(quality = 1)")), F.lit(0))).first()
    n_some = some.count()
    if not n_positive or not n_some:
        return None
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("sample")), 11) / float(2**53)
    chosen = known.where((F.col("quality") == 1) & (draw < most / n_positive)).select("doc_id", F.lit(1).alias("kind"))
    chosen = chosen.union(some.where(draw >= 1 - most / n_some).select("doc_id", F.lit(0).alias("kind")))
    # at most about 2 * most ids by construction, whatever the size of the corpus
    rows = id_and_bytes(docs).join(F.broadcast(chosen.distinct()), "doc_id")

    def make(b, x):
        values = pa.array([r.tobytes() for r in x.astype("<f4")], pa.binary())
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("kind"), values], ["doc_id", "kind", "x"])

    got = sorted((r.doc_id, r.kind, bytes(r.x)) for r in _table(rows, "doc_id long, kind int, x binary", make).collect())
    parts = [np.array([np.frombuffer(x, "<f4") for _, k, x in got if k == kind], np.float64) for kind in (1, 0)]
    if not len(parts[0]) or not len(parts[1]):
        return None
    return fit(parts[0], parts[1], (n_positive + 1) / (n_known + 2))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = 8000) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Null, empty and blank texts get the score of a text without words.  Repeated rows get equal
    scores.  Without a model (no positive label, no documents) every score is 0.5.  Labels of ids
    that have no document are ignored, as are other columns.
    """
    model = train(docs, labels, most)

    def make(b, x):
        score = model.scores(x) if model is not None else np.full(len(x), 0.5)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    rows = _table(id_and_bytes(docs), "doc_id long, score double", make)
    return rows.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = 8000) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, all columns as they were."""
    model = train(docs, labels, most)

    @F.pandas_udf("double")
    def score(texts):
        if model is None:
            return texts.map(lambda _: 0.5).astype(float)
        import pandas as pd

        return pd.Series(model.scores(np.array([features(t) for t in texts]).reshape(-1, N_FEATURES)))

    return docs.where(score(F.col("text").cast("binary")) >= threshold)
