"""Substring removal against a brute-force version."""

import hashlib
import random

import pytest

from millrace.llm import substrings
from millrace.llm.common import documents

SCHEMA = "doc_id long, text string, marks string, core int, n_chars long"


def brute(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in sorted((x for x in words if x[0] is not None), key=lambda x: x[0]):
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), i)
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - window + 1):
            if i is not None and first[tuple(w[s : s + window])] < i:
                gone.update(range(s, s + window))
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df, window):
    got = substrings.without_repeats(df, window).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str)


def test_whole_table(spark, sf_dir):
    docs = documents(spark, sf_dir)
    assert result(docs, 50) == brute([(r.doc_id, r.text) for r in docs.collect()], 50)


@pytest.mark.parametrize("seed", range(3))
def test_shared_passages_edits_and_few_different_words(spark, seed):
    rng = random.Random(seed)
    words = ["a", "b", "c"] if seed == 0 else [f"w{n}" for n in range(400)]
    passages = [[rng.choice(words) for _ in range(rng.randrange(5, 60))] for _ in range(12)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randrange(1, 6)):
            p = list(rng.choice(passages))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = rng.choice(words)
            text += p + [rng.choice(words) for _ in range(rng.randrange(4))]
        rows.append((rng.randrange(10**6) * 100 + i, " ".join(text), None, None, None))
    assert result(spark.createDataFrame(rows, SCHEMA), 10) == brute([r[:2] for r in rows], 10)


def test_odd_rows(spark):
    long_text = " ".join(f"x{n % 977}y{n}" for n in range(60_000))
    rows = [(1, None), (2, ""), (3, "\x0b\x0c \r\n"), (4, "few words"), (5, "same " * 300), (6, "same " * 300)]
    rows += [(7, long_text), (8, "other " + long_text), (8, "other " + long_text), (None, long_text)]
    rows += [(9, "café au lait " * 60), (10, "café au lait\t" * 60)]
    df = spark.createDataFrame([(*r, "m", 1, len(r[1] or "")) for r in rows], SCHEMA)
    assert result(df, 50) == brute(rows, 50)
    cut = substrings.cut_repeats(df)
    assert cut.columns == df.columns and cut.count() == len(rows)
    texts = {r.doc_id: (r.text, r.n_chars) for r in cut.collect()}
    assert texts[8] == ("other", 5) and texts[6] == ("", 0) and texts[1][0] is None and texts[5][0] == "same " * 300


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert result(df, 50) == [] and substrings.cut_repeats(df).count() == 0
