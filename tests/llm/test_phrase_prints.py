"""Phrase fingerprints: plain-Python parsing, successors, locality and odd rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import phrase_prints as pp
from millrace.llm.common import Spans, documents

SCHEMA = "doc_id long, text string, tie string, range int, carried int"
MASK = 2**64 - 1


def mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def toss(left, right):
    at = ((left ^ right) & -(left ^ right)).bit_length() - 1
    return 2 * at + (right >> at & 1)


def slow_names(text):
    """The names of one text, symbol by symbol."""
    symbols, level, names = [ord(c) for c in text], 0, set()
    while True:
        runs = []
        for s in symbols:
            if runs and runs[-1][0] == s:
                runs[-1][1] += 1
            else:
                runs.append([s, 1])
        a = [s if n == 1 else mixed((s * 2 + 1 + n * Spans.BASE) & MASK) for s, n in runs]
        label = [toss(a[i - 1] if i else a[0] ^ 1, a[i]) for i in range(len(a))]
        for _ in range(2):
            label = [toss(label[i - 1] if i else label[0] ^ 1, label[i]) for i in range(len(label))]
        cuts = [0] + [i for i in range(1, len(a) - 1) if label[i - 1] > label[i] < label[i + 1]]
        symbols = []
        for s, e in zip(cuts, [*cuts[1:], len(a)], strict=True):
            if e - s == 1:
                symbols.append(mixed((a[s] + 1) & MASK))
            else:
                symbols.append(mixed(sum(x * pow(Spans.BASE, i, 1 << 64) for i, x in enumerate(a[s:e])) & MASK))
        level += 1
        if level >= pp.FIRST or len(symbols) == 1:
            names |= {mixed(s ^ level) >> (64 - pp.BITS) for s in symbols}
        if len(symbols) == 1:
            return sorted(names)[: pp.SIZE]


def test_batches_equal_parsing_one_by_one(spark, sf_dir):
    texts = [r.text for r in documents(spark, sf_dir).limit(40).collect()]
    texts = [t[:4000] for t in texts] + ["", "a", "aa", "ab", "aab", "é" * 50, "😀😁" * 30, "abababababab", "\x00\x00\x01"]
    for text, names in zip(texts, pp.prints(texts), strict=True):
        assert names.tolist() == (slow_names(text) if text else [])


@pytest.mark.parametrize("seed", range(3))
def test_equal_substrings_share_their_inner_names(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij ") for _ in range(rng.randrange(200, 400)))
    inside = "".join(word() for _ in range(10))
    a, b = (pp.prints([word()[:150] + inside + word()[:150]], size=10**6)[0] for _ in range(2))
    assert len(np.intersect1d(a, b)) > 0.8 * len(pp.prints([inside], size=10**6)[0])


def test_whole_table(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    for range_bytes in (1 << 24, 20_000):
        got = {r.doc_id: r for r in pp.fingerprinted(docs, range_bytes).collect()}
        assert len(got) == len(rows)
        names = dict(zip([r[0] for r in rows], pp.prints([r[1] for r in rows]), strict=True))
        for i, (doc_id, text) in enumerate(rows):
            after_id, after = rows[(i + 1) % len(rows)]
            n = len(text) // 4
            changed = text[: len(text) - n] + after[:n]
            r = got[doc_id]
            assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
            assert r.fingerprint == "".join(f"{x:010x}" for x in names[doc_id].tolist())
            assert r.near_next == pp.likeness(names[doc_id], names[after_id])
            assert r.near_edited == pp.likeness(names[doc_id], pp.prints([changed])[0])
    assert np.mean([r.near_edited for r in got.values()]) > 0.6
    assert np.mean([r.near_next for r in got.values()]) < 0.1


def test_odd_rows(spark):
    rows = [(4, None), (3, ""), (7, "abc"), (9, "long text ü " * 30_000), (9, "long text ü " * 30_000), (None, "no id"), (12, "\x00")]
    df = spark.createDataFrame([(*r, "t", 1, 1) for r in rows], SCHEMA)
    got = pp.fingerprinted(df).collect()
    assert sorted((r.doc_id or -1, r.n_chars) for r in got) == sorted((r[0] or -1, len(r[1] or "")) for r in rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[3].near_next == 1.0 and by_id[4].near_next == 0.0 and by_id[3].fingerprint == ""
    assert sorted(r.near_next for r in got if r.doc_id == 9)[-1] == 1.0
    one = pp.fingerprinted(df.where("doc_id = 7")).first()
    assert one.near_next == 1.0 and one.n_chars == 3


def test_rows_of_one_id_lie_in_many_ranges(spark):
    rng = random.Random(5)
    text = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(300, 900)))
    rows = [(i, text()) for i in range(200)] + [(77, text()) for _ in range(150)] + [(None, text()) for _ in range(150)]
    rows += [(77, "equal " * 50)] * 40 + [(None, None)] * 40
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    ranged = pp._ranged(df, 20_000)
    sizes = {r["range"]: r["count"] for r in ranged.where("carried = 0").groupBy("range").count().collect()}
    assert sum(sizes.values()) == len(rows) and len(sizes) > 25 and max(sizes.values()) < 60
    assert ranged.where("carried = 0").groupBy("doc_id").agg(F.countDistinct("range").alias("n")).where("n > 4").count() == 2

    texts = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = texts.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).collect()
    want = []
    for i, (doc_id, own) in enumerate(order):
        changed = pp.edited(own, order[(i + 1) % len(order)].text)
        want.append((doc_id, len(own), hashlib.sha256(changed.encode()).hexdigest()))
    got = [(r.doc_id, r.n_chars, r.edited_sha256) for r in pp.fingerprinted(df, 20_000).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_table(spark):
    got = pp.fingerprinted(spark.createDataFrame([], SCHEMA))
    assert got.count() == 0 and got.columns == [c.split()[0] for c in pp.SCHEMA]
