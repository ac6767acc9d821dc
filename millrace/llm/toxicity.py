"""Toxicity as maximum-scoring segments of token log-odds.

A unit is a word, or the beginning of a longer word (``PREFIXES`` letters).  Its log-odds between
toxic and clean training documents have a Dirichlet prior in proportion to the unit's share in both,
and a word scores the lower confidence bound of its longest known unit, less a cost per word.  One
scan of a text, linear in its words, finds all maximal segments (no extension and no part of one
scores more).  A segment of score S among n words is expected K n exp(-lambda S) times in clean
text; lambda is the positive root of the mean of exp(lambda s) = 1 over clean words, K is fitted to
the best segments of clean training documents, each scored as if it had not been learned from.
Segments expected less than ``level`` times are significant; the sum of their negative log
expectations is a document's evidence, which a logistic curve turns into its score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import id_and_bytes
from millrace.llm.quality import held_out

PREFIXES = (6, 5, 4)
EDGES = "".join(chr(c) for c in range(128) if not chr(c).isalnum()) + "«»“”„‘’‚¡¿…–—"


def units(word: str) -> list[str]:
    """The word and its beginnings, longest first; beginnings end in ``*``."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def plain(word: str) -> str:
    return word.strip(EDGES)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)``, in order, in time linear in the scores.

    Left to right over the positive scores; a segment is joined with the nearest one before it
    that begins on lower ground, if that one's top lies lower as well.  ``back`` leads from a
    segment to the nearest one before it that begins on lower ground, so none is passed twice.
    """
    ground = np.r_[0.0, np.cumsum(scores)]
    kept: list[tuple[int, int, float, float]] = []  # start, end, ground before, ground after
    back: list[int] = []
    for at in np.flatnonzero(scores > 0).tolist():
        start, end, low, high = at, at + 1, float(ground[at]), float(ground[at + 1])
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= low:
                j = back[j]
            if j < 0 or kept[j][3] >= high:
                break
            start, low = kept[j][0], kept[j][2]
            del kept[j:]
            nearest = back[j]
            del back[j:]
            j = nearest
        kept.append((start, end, low, high))
        back.append(j)
    return [(s, e, high - low) for s, e, low, high in kept]


@dataclass
class Lexicon:
    """Document counts of the units that may speak for toxicity, and of units that speak against a
    beginning of theirs; ``totals`` are all units of clean and of toxic documents."""

    counts: dict[str, tuple[int, int]]  # unit: clean, toxic
    against: frozenset[str]
    totals: tuple[int, int]
    share: float = 0.02
    sure: float = 2.0
    cost: float = 0.5

    def bound(self, clean, toxic):
        """Lower confidence bound of the log-odds, less the cost of a word (arrays or numbers)."""
        n_clean, n_toxic = self.totals
        prior = self.share * (n_clean + n_toxic)
        own = prior * (clean + toxic) / (n_clean + n_toxic)
        odds = np.log((toxic + own) / (n_toxic + prior - toxic - own)) - np.log((clean + own) / (n_clean + prior - clean - own))
        return odds - self.sure * np.sqrt(1 / (toxic + own) + 1 / (clean + own)) - self.cost

    def scorer(self, kind: int | None = None) -> "Scorer":
        """Scores of words; for a training document of ``kind`` (0 clean, 1 toxic) those of a
        lexicon without it."""
        found = {}
        for unit, (clean, toxic) in self.counts.items():
            clean, toxic = clean - (kind == 0), toxic - (kind == 1)
            value = float(self.bound(clean, toxic)) if clean >= 0 and toxic > 0 else -self.cost
            found[unit] = max(value, -self.cost)
        return Scorer(found, self.against, self.cost)


@dataclass
class Scorer:
    found: dict[str, float]
    against: frozenset[str]
    cost: float
    known: dict[str, float] = field(default_factory=dict)

    def word(self, raw: str) -> float:
        for unit in units(plain(raw)):
            if unit in self.found:
                return self.found[unit]
            if unit in self.against:
                break
        return -self.cost

    def text(self, words: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.array([known[w] for w in words])
        except KeyError:
            if len(known) > 500_000:
                known.clear()
            for w in set(words):
                if w not in known:
                    known[w] = self.word(w)
            return np.array([known[w] for w in words])


@dataclass(frozen=True)
class Model:
    """``rate`` is lambda, ``density`` is K; ``curve`` the logistic's offset and slope over log(1 + evidence)."""

    lexicon: Lexicon
    rate: float
    density: float
    curve: tuple[float, float]
    level: float

    def expected(self, n_words: int, scores: np.ndarray) -> np.ndarray:
        """How often clean text of ``n_words`` holds a segment of at least each score."""
        return self.density * n_words * np.exp(-self.rate * scores)

    def evidence(self, n_words: int, scores: np.ndarray) -> float:
        expected = self.expected(n_words, scores)
        return float(-np.log(np.maximum(expected[expected < self.level], 1e-300)).sum())

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-(self.curve[0] + self.curve[1] * math.log1p(evidence))))


def words_of(text: bytes | None) -> list[str]:
    return (text or b"").decode("utf-8", "replace").lower().split()


def _counted(rows: DataFrame) -> DataFrame:
    """``unit, clean, toxic``: documents of each kind with the unit, of ``rows`` (``text, kind``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: dict[str, list[int]] = {}
            for text, kind in zip(b.column("text").to_pylist(), b.column("kind").to_pylist(), strict=True):
                for unit in {u for w in {plain(w) for w in words_of(text)} if w for u in units(w)}:
                    held.setdefault(unit, [0, 0])[kind] += 1
            clean, toxic = (pa.array([v[k] for v in held.values()], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string()), clean, toxic], ["unit", "clean", "toxic"])

    counted = rows.mapInArrow(run, "unit string, clean long, toxic long")
    return counted.groupBy("unit").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _lexicon(rows: DataFrame) -> Lexicon:
    """Only units that would score if one clean document fewer had them, and longer units that
    clean documents hold three times or more, come to the driver: part of a bounded sample's words."""
    counted = _counted(rows).persist()
    try:
        n_clean, n_toxic = counted.agg(F.coalesce(F.sum("clean"), F.lit(0)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        shape = Lexicon({}, frozenset(), (max(n_clean, 1), max(n_toxic, 1)))

        @F.pandas_udf("boolean")
        def speaks(clean, toxic):
            return shape.bound((clean - 1).clip(lower=0), toxic) > -shape.cost

        some = {r.unit: (r.clean, r.toxic) for r in counted.where("toxic > 1").where(speaks("clean", "toxic")).toLocalIterator()}
        shorter = sorted(u for u in some if u.endswith("*"))
        if not shorter:
            return Lexicon(some, frozenset(), shape.totals)
        # their number is bounded by the sample, as the lexicon is
        begun = F.broadcast(rows.sparkSession.createDataFrame([(u,) for u in shorter], "begun string"))
        words = counted.where("clean >= 3").withColumn("bare", F.rtrim(F.lit("*"), "unit"))
        starts = F.explode(F.array(*[F.concat(F.substring("bare", 1, n), F.lit("*")) for n in PREFIXES]))
        longer = words.select("unit", starts.alias("begun")).where("length(begun) < length(unit) + int(unit not like '%*')")
        against = {r.unit for r in longer.join(begun, "begun").select("unit").distinct().toLocalIterator()}
        return Lexicon(some, frozenset(against - some.keys()), shape.totals)
    finally:
        counted.unpersist()


def rate_of(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum(weights * exp(rate * values)) = sum(weights); the mean is negative."""
    mean = lambda rate: float((weights * np.expm1(rate * values)).sum())
    low, high = 0.0, 1.0
    while mean(high) < 0 and high < 64:
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if mean(middle) < 0 else (low, middle)
    return high


def curve_of(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Offset and slope (0 or more) of a weighted logistic regression, by damped Newton steps."""
    rows, w = np.c_[np.ones(len(x)), x], np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        slope = rows.T @ (weight * (y - p)) - ridge * w
        curvature = (rows * (weight * p * (1 - p))[:, None]).T @ rows + ridge * np.eye(2)
        step = np.linalg.solve(curvature, slope)
        w = w + step / max(1.0, np.abs(step).max())
    return float(w[0]), float(max(w[1], 0.0))


def train(docs: DataFrame, labels: DataFrame, most: int = 8000, level: float = 0.01) -> Model | None:
    """Learn from at most about ``most`` documents of each kind outside the held-out fold.

    ``labels`` has ``doc_id, toxic``; rows without id or label teach nothing.  None where there is
    no toxic or no clean document to learn from.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("kind")).where(
        ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)
    )
    n = dict(known.groupBy("kind").count().collect())
    if not n.get(0) or not n.get(1):
        return None
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("toxic")), 11) / float(2**53)
    chosen = known.where(draw < F.when(F.col("kind") == 1, most / n[1]).otherwise(most / n[0])).distinct()
    # at most about 2 * most ids by construction, whatever the size of the corpus
    rows = id_and_bytes(docs).join(F.broadcast(chosen), "doc_id").select("text", "kind")
    lexicon = _lexicon(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [lexicon.scorer(kind) for kind in (0, 1)]
        for b in batches:
            out = []
            for text, kind in zip(b.column("text").to_pylist(), b.column("kind").to_pylist(), strict=True):
                scores = scorers[kind].text(words_of(text))
                best = np.array([s for *_, s in segments(scores)], "<f4")
                out.append((kind, len(scores), scores[scores > 0].astype("<f4").tobytes(), best.tobytes()))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            types = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["kind", "n", "words", "best"])

    found = rows.mapInArrow(run, "kind int, n long, words binary, best binary").collect()
    found.sort(key=lambda r: (r.kind, r.n, bytes(r.best)))
    scored = [(r.kind, r.n, np.frombuffer(r.words, "<f4").astype(float), np.frombuffer(r.best, "<f4").astype(float)) for r in found]
    clean = [r for r in scored if r[0] == 0 and r[1]]
    if not clean or not any(r[0] == 1 for r in scored):
        return None
    # one word with the lexicon's highest score is added, so that the root exists
    top = max(lexicon.scorer().found.values(), default=1.0)
    values = np.concatenate([*(r[2] for r in clean), [max(top, 1.0)]])
    below = max(sum(r[1] for r in clean) - len(values) + 1, 1)
    rate = rate_of(np.r_[values, -lexicon.cost], np.r_[np.ones(len(values)), below])
    density = len(clean) / sum(r[1] * math.exp(-rate * r[3].max(initial=0.0)) for r in clean)
    model = Model(lexicon, rate, density, (0.0, 0.0), level)
    x = np.array([math.log1p(model.evidence(r[1], r[3])) for r in scored])
    y = np.array([r[0] for r in scored])
    weight = np.array([n[k] / max(1, (y == k).sum()) for k in (0, 1)])[y]
    return Model(lexicon, rate, density, curve_of(x, y, weight / weight.sum() * len(y)), level)


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """The significant passages: ``doc_id, passage`` (from 0), ``first_word, n_words, score, expected, text``.

    Words are counted from 0; ``text`` is the passage in lower case, its words joined by a space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.lexicon.scorer()
        for b in batches:
            out = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = words_of(text)
                found = segments(scorer.text(words))
                expected = model.expected(len(words), np.array([s for *_, s in found]))
                kept = [(*f, e) for f, e in zip(found, expected.tolist(), strict=True) if e < model.level]
                out += [(doc_id, k, s, e - s, v, x, " ".join(words[s:e])) for k, (s, e, v, x) in enumerate(kept)]
            columns = list(zip(*out, strict=True)) or [[]] * 7
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string())
            names = ["doc_id", "passage", "first_word", "n_words", "score", "expected", "text"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    schema = "doc_id long, passage long, first_word long, n_words long, score double, expected double, text string"
    return id_and_bytes(docs).mapInArrow(run, schema)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most: int = 8000) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_passages, n_toxic_words`` of every row.

    ``n_passages`` are significant passages, ``n_toxic_words`` the words in them.  Null, empty and
    blank texts get the score of a text without evidence.  Repeated rows get equal scores.  Without
    a model (no toxic or no clean document with a label) every score is 0.  Labels of ids that have
    no document are ignored, as are other columns.
    """
    model = train(docs, labels, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.lexicon.scorer() if model else None
        for b in batches:
            out = []
            for text in b.column("text").to_pylist() if model else [None] * b.num_rows:
                words = words_of(text)
                found = segments(scorer.text(words)) if words else []
                values = np.array([s for *_, s in found])
                expected = model.expected(len(words), values) if model else values
                wide = [e - s for (s, e, _), x in zip(found, expected.tolist(), strict=True) if x < model.level]
                out.append((model.score(model.evidence(len(words), values)) if model else 0.0, len(wide), sum(wide)))
            columns = list(zip(*out, strict=True)) or [[]] * 3
            types = (pa.float64(), pa.int64(), pa.int64())
            arrays = [b.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "score", "n_passages", "n_toxic_words"])

    rows = id_and_bytes(docs).mapInArrow(run, "doc_id long, score double, n_passages long, n_toxic_words long")
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted, "n_passages", "n_toxic_words")
