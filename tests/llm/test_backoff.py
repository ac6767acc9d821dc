"""Stupid backoff against its SQL and a brute-force version."""

import math
from collections import Counter

import duckdb
import pytest

from millrace.llm import backoff, queries, registry

SCHEMA = "doc_id long, text string, chunk string, n int, totals int"


def brute(texts):
    docs = [(t or "").encode().split() for t in texts]
    ones, twos, total = Counter(w for d in docs for w in d), Counter(p for d in docs for p in zip(d, d[1:])), sum(map(len, docs))
    out = []
    for d in docs:
        own, own_two = Counter(d), Counter(zip(d, d[1:]))
        rest, score, backed, unseen = max(1, total - len(d)), 0.0, 0, 0
        for i, w in enumerate(d):
            c = ones[w] - own[w]
            unseen += c == 0
            lower = math.log(c / rest) if c else math.log(0.4 / rest)
            pair = (d[i - 1], w)
            if i and (n := twos[pair] - own_two[pair]):
                score += math.log(n / (ones[d[i - 1]] - own[d[i - 1]]))
            else:
                score += lower + (math.log(0.4) if i else 0)
                backed += bool(i)
        out.append((len(d), backed, unseen, score))
    return out


def test_whole_table_equals_its_sql(spark, sf_dir):
    got = queries.op5_backoff(spark, sf_dir).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(registry.CHECKS["op5_backoff"]).df().sort_values("doc_id").reset_index(drop=True)[list(got.columns)]
    for c in ("doc_id", "n_words", "n_backed_off", "n_unseen"):
        assert (got[c] == want[c]).all(), c
    assert ((got.log_score - want.log_score).abs() < 2e-3).all()


@pytest.mark.parametrize("chunk_bytes", [1, 60, 1 << 20])
def test_odd_rows_and_any_chunks(spark, chunk_bytes):
    texts = ["a b a b c", "a b", None, "", " \n", "b a b", "a b", "long words " * 20_000, "alone", "naïve naïve b"]
    rows = [(i if i != 8 else None, t, "c", 1, 1) for i, t in enumerate(texts)]
    got = backoff.scored(spark.createDataFrame(rows, SCHEMA), chunk_bytes=chunk_bytes, keys_per_bucket=2).collect()
    assert len(got) == len(rows)
    by_id = {8 if r.doc_id is None else r.doc_id: r for r in got}
    for i, (n, backed, unseen, score) in enumerate(brute(texts)):
        r = by_id[i]
        assert (r.n_words, r.n_backed_off, r.n_unseen) == (n, backed, unseen)
        assert math.isclose(r.log_score, score, rel_tol=1e-9, abs_tol=1e-9)
        assert (r.mean_log_score is None) == (n == 0)


def test_empty_and_single(spark):
    assert backoff.scored(spark.createDataFrame([], SCHEMA)).count() == 0
    one = backoff.scored(spark.createDataFrame([(1, "x y", "", 1, 1)], SCHEMA)).first()
    assert (one.n_unseen, one.n_backed_off) == (2, 1) and math.isclose(one.log_score, 3 * math.log(0.4))


@pytest.mark.parametrize("order", [1, 3, 4])
@pytest.mark.parametrize("chunk_bytes", [60, 1 << 20])
def test_other_orders(spark, order, chunk_bytes):
    texts = ["a b c a b c d", "x a b c", "b c d e", "a b", None, "", "c d e a b c d e f", "alone", "a b c a b c d"]
    docs = [(t or "").split() for t in texts]
    got = backoff.scored(spark.createDataFrame([(i, t, "c", 1, 1) for i, t in enumerate(texts)], SCHEMA), order=order, chunk_bytes=chunk_bytes)
    for r in got.collect():
        rest = Counter()
        for i, d in enumerate(docs):
            if i != r.doc_id:
                rest.update(tuple(d[s : s + n]) for n in range(1, order + 1) for s in range(len(d) - n + 1))
        total = max(1, sum(len(d) for i, d in enumerate(docs) if i != r.doc_id))

        def value(gram):
            if len(gram) == 1:
                return (rest[gram] or 0.4) / total
            return rest[gram] / rest[gram[:-1]] if rest[gram] else 0.4 * value(gram[1:])

        d = docs[r.doc_id]
        grams = [tuple(d[max(0, i - order + 1) : i + 1]) for i in range(len(d))]
        assert math.isclose(r.log_score, sum(math.log(value(g)) for g in grams), rel_tol=1e-9, abs_tol=1e-9)
        assert r.n_backed_off == sum(not rest[g] for g in grams if len(g) > 1)
