"""Mixing: targets by water filling, words taken near them, order and odd rows."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing, registry, queries  # noqa: F401
from millrace.llm.common import documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, target int, tie int"


def filled(sizes, share=1.5, most=2.0):
    """Brute force: raise the level until the targets sum up."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    low, high, total = 0.0, 4.0 * sum(sizes.values()) + 1, share * sum(sizes.values())
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(most * sizes[s], level * weight[s]) for s in sizes) < total:
            low = level
        else:
            high = level
    return {s: min(most * sizes[s], high * weight[s]) for s in sizes}


def test_whole_table_equals_its_sql(spark, sf_dir):
    got = queries.op3_mixing(spark, sf_dir).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(registry.CHECKS["op3_mixing"]).df()
    merged = got.merge(want, on="doc_id", suffixes=("", "_want"))
    assert len(got) == len(want) == len(merged)
    assert (merged.taken == merged.taken_want).all()
    assert ((merged.target - merged.target_want).abs() < 1e-6).all()
    assert (got.taken <= 2 * got["size"]).all()
    again = queries.op3_mixing(spark, sf_dir).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))


@pytest.mark.parametrize("hot", [1, 40])
def test_taken_comes_near_the_filled_targets(spark, hot):
    rows = []
    for i in range(600):
        source = ["b", "a", None, "é", "Z"][min(i % (4 + hot), 4)]
        rows.append((i, "word " * (i * 37 % 400), "", source, 0, "x", 1, 1))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mixed(docs).toPandas()
    source = {r[0]: r[3] for r in rows}
    sizes, taken, target = {}, {}, {}
    for r in got.itertuples():
        s = source[r.doc_id]
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
        assert r.taken == sum(p.words for p in r.passes) and all(p.words <= r.size for p in r.passes)
    want = filled(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - want[s]) <= 0.01 * want[s] + 3


def test_odd_rows_and_the_mixed_table(spark):
    rows = [(1, None, "", "a"), (2, "", "", "a"), (3, " \n\x0b", "", "b"), (4, "one two  three", "", None), (4, "one two  three", "", None)]
    rows += [(None, "no id here", "", "a"), (5, "many words " * 50_000, "", "c"), (6, "x", "", "z")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "s", 3, 9) for r in rows], SCHEMA)
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r.size for r in got)
    assert {r.doc_id for r in got if r.size == 0} == {1, 2, 3}
    assert all(r.target == 0 for r in got if r.doc_id == 3)
    mix = mixing.mixed_documents(docs)
    assert mix.columns == docs.columns
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in mix.collect())
    assert words == sum(r.taken for r in got)


def small_corpus(spark):
    """300 documents of three sources in the ratio 4 : 1 : 1, every word its own."""
    rows = []
    for i in range(300):
        source = "abcaaa"[i % 6]
        rows.append((i, " ".join(f"w{i}_{j}" for j in range(i * 29 % 90)), "", source, 0, "x", 1, 1))
    return spark.createDataFrame(rows, SCHEMA)


SMALL = mixing.Mix(slots=500, blocks=16)


def test_slots_follow_the_golden_ratio(spark):
    docs = small_corpus(spark)
    spans = mixing.spans(docs, SMALL).toPandas()
    owner = spans.groupby("slot").source.agg(["min", "max"])
    assert (owner["min"] == owner["max"]).all()
    by_source = mixing.sizes(docs).groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = mixing.goals(by_source, SMALL).toPandas().set_index("source")
    quota = (goals.target / goals.block + 0.5).astype(int)
    assert owner["min"].value_counts().to_dict() == quota.to_dict()
    edges, low, total = {}, 0, quota.sum()
    for s in sorted(quota.index):
        edges[s] = (low * 2**32 // total, (low + quota[s]) * 2**32 // total)
        low += quota[s]
    golden = (5**0.5 - 1) / 2
    for slot, s in owner["min"].items():
        assert edges[s][0] / 2**32 - 1e-6 <= (slot + 1) * golden % 1 <= edges[s][1] / 2**32 + 1e-6
    # at any time every source is near its share, which no order by source or by chance keeps
    seen = dict.fromkeys(quota.index, 0)
    for n, s in enumerate(owner["min"].iloc[: int(0.9 * total)], 1):
        seen[s] += 1
        assert all(abs(seen[q] - n * quota[q] / total) <= 3 for q in seen)


def test_slots_of_a_source_run_through_its_words(spark):
    docs = small_corpus(spark)
    spans = mixing.spans(docs, SMALL).toPandas()
    for _, of_source in spans.groupby("source"):
        slots = of_source.drop_duplicates("slot").sort_values("slot")
        blocks = of_source.block.max() + 1
        want = [(r % blocks, r // blocks) for r in range(len(slots))]
        assert list(zip(slots.block, slots["pass"])) == want
        for _, run in of_source.sort_values(["slot", "first"]).groupby("pass"):
            at = (run["first"] + run.start).tolist()  # words of the source without gap
            assert at == [0, *(run.words.cumsum().tolist()[:-1])]
    taken = {r.doc_id: r.taken for r in mixing.mixed(docs, SMALL).collect() if r.taken}
    assert spans.groupby("doc_id").words.sum().to_dict() == taken


def test_the_mixed_table_is_in_the_order_of_the_slots(spark):
    docs = small_corpus(spark)
    spans = mixing.spans(docs, SMALL).toPandas().sort_values(["slot", "first"])
    want = spans.drop_duplicates(["pass", "doc_id"]).doc_id.tolist()
    got = mixing.mixed_documents(docs, SMALL).collect()
    assert [r.doc_id for r in got] == want
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(text[r.doc_id].startswith(r.text) for r in got)


def test_names_that_clash(spark):
    names = ["slot", "pass", "words", "row", "run", "nth", "first", "_size", "_id", "_tie", "id", "block", "number"]
    docs = small_corpus(spark)
    for n in names:
        docs = docs.selectExpr("*", f"doc_id + 7 AS {n}")
    got = mixing.mixed_documents(docs, SMALL)
    assert got.columns == docs.columns
    rows = got.collect()
    assert rows and all(r[n] == r.doc_id + 7 for r in rows for n in names)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixing.mixed(docs).count() == 0 and mixing.mixed_documents(docs).count() == 0
    assert mixing.spans(docs).count() == 0


def test_no_python_in_the_plan(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for df in (mixing.mixed(docs), mixing.mixed_documents(docs), mixing.spans(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
