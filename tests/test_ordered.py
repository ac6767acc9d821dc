"""Running columns: the blocked path for heavy keys must equal the plain windows."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import ordered as o


def _rows(seed=5, n=60):
    rnd = random.Random(seed)
    # key None and key 'hot' are heavy, the others have one or two rows
    keys = [None] * 15 + ["hot"] * 30 + [f"k{i}" for i in range(n - 45)]
    rnd.shuffle(keys)
    return [
        (k, rnd.randrange(20), i, rnd.choice([None, rnd.randrange(-9, 9)]))
        for i, k in enumerate(keys)
    ]


def _specs():
    return dict(
        idx=o.index(),
        total=o.running_sum("v"),
        top=o.running_max("v"),
        low=o.running_min("v"),
        known=o.last_known("v"),
        head=o.first_value("v"),
        prev=o.lag("v"),
        nxt=o.lead("v"),
    )


def _result(df, by):
    seq = o.ordered(df, by=by, order_by=["t", "id"]).add(**_specs())
    again = seq.add(runs=o.running_sum(F.when(~F.col("prev").eqNullSafe(F.col("v")), 1).otherwise(0)))
    return seq.blocked, sorted(again.df.collect(), key=lambda r: r["id"])


@pytest.mark.parametrize("kind", ["value blocks", "range blocks", "ties"])
def test_blocked_equals_plain(spark, kind):
    df = spark.createDataFrame(_rows(), "k string, t int, id int, v int")
    if kind == "range blocks":  # a text has no place in numbers
        df = df.withColumn("t", F.lpad(F.col("t").cast("string"), 3, "0"))
    if kind == "ties":  # one place holds too much
        df = df.withColumn("t", F.lit(1))
    for by in (["k"], []):
        plain_blocked, plain = _result(df, by)
        assert not plain_blocked
        spark.conf.set("spark.millrace.smallBytes", "0")
        spark.conf.set("spark.millrace.rowsPerTask", "3")
        try:
            blocked, rows = _result(df, by)
        finally:
            spark.conf.unset("spark.millrace.smallBytes")
            spark.conf.unset("spark.millrace.rowsPerTask")
        assert blocked
        assert rows == plain


def test_heavy_key_is_cut_into_blocks(spark, heavy):
    df = spark.createDataFrame(_rows(), "k string, t int, id int, v int")
    seq = o.ordered(df, by="k", order_by=["t", "id"])
    sizes = {
        (r["k"], r[o.BLOCK]): r["count"]
        for r in seq.rows.groupBy("k", o.BLOCK).count().collect()
    }
    assert len([1 for (k, b) in sizes if k == "hot"]) > 3
    assert all(b == o.LIGHT for (k, b) in sizes if k and k != "hot")


def test_plain_plan_has_one_exchange_and_one_sort(spark, sf_dir):
    from millrace.sources.tables import table

    seq = o.ordered(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"])
    df = seq.add(prev=o.lag("ts")).add(n=o.running_sum(F.when(F.col("prev").isNull(), 1))).df
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert plan.count("Sort [") == 1


def test_value_blocks_add_no_shuffle_of_the_rows(spark, heavy):
    rows = [("hot", t, t) for t in range(40)] + [("cold", 1, 1), (None, 2, 2)]
    df = spark.createDataFrame(rows, "k string, t int, id int")
    seq = o.ordered(df, by="k", order_by=["t", "id"])
    plan = seq.rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "rangepartitioning" not in plan
    sizes = [r["count"] for r in seq.rows.where("_block >= 0").groupBy("_block").count().collect()]
    assert sum(sizes) == 40 and max(sizes) <= 6


def test_rows_without_a_place_come_first(spark, heavy):
    rows = [("k", None if i % 4 == 0 else i, i) for i in range(24)]
    df = spark.createDataFrame(rows, "k string, t int, id int")
    seq = o.ordered(df, by="k", order_by=["t", "id"]).add(i=o.index())
    assert seq.blocked
    order = [r["id"] for r in seq.df.orderBy("i").collect()]
    assert order == [i for i in range(24) if i % 4 == 0] + [i for i in range(24) if i % 4]


@pytest.mark.parametrize("text", [False, True])
def test_blocks_do_not_grow_with_the_table(spark, heavy, monkeypatch, text):
    df = spark.createDataFrame(_rows(n=90), "k string, t int, id int, v int")
    if text:
        df = df.withColumn("t", F.lpad(F.col("t").cast("string"), 3, "0"))
    for by in (["k"], []):
        spark.conf.set("spark.millrace.smallBytes", "1000000000")
        spark.conf.set("spark.millrace.rowsPerTask", "1000000")
        _, plain = _result(df, by)
        spark.conf.set("spark.millrace.smallBytes", "0")
        spark.conf.set("spark.millrace.rowsPerTask", "5")
        monkeypatch.setattr(o, "MOST_BLOCKS", 8)
        seq = o.ordered(df, by=by, order_by=["t", "id"])
        assert seq.blocked and seq.wide
        sizes = seq.rows.where(f"{o.BLOCK} >= 0").groupBy(*by, o.BLOCK).count().collect()
        assert len(sizes) > 8 and max(r["count"] for r in sizes) <= 5
        blocked, rows = _result(df, by)
        assert blocked and rows == plain
        plan = seq.add(**_specs()).df._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=broadcast" not in plan
        monkeypatch.undo()


def test_rows_below_a_generator_are_counted(spark):
    # 200 rows of a few bytes by the estimate, 200,000 in fact
    df = spark.range(200).select(F.explode(F.sequence(F.lit(1), F.lit(1000))).alias("n"), "id")
    spark.conf.set("spark.millrace.rowsPerTask", "50000")
    try:
        seq = o.ordered(df, (), ["id", "n"])
        assert seq.blocked
        sizes = [r["count"] for r in seq.rows.groupBy(o.BLOCK).count().collect()]
        assert sum(sizes) == 200_000 and max(sizes) <= 50_000
    finally:
        spark.conf.unset("spark.millrace.rowsPerTask")
