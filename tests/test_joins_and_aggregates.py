import itertools
import math
import statistics


import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from millrace.functions import arrays, numbers, text
from millrace.operators import aggregates as ag
from millrace.operators import joins, latest, routing, user
from millrace.operators import ordered as o
from millrace.operators import sequence as sq


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def versions(spark, side):
    data = [(i, int(v[1:])) for i, v in enumerate("A1 B2 B4 A3 B6 A5".split()) if v[0] == side]
    return spark.createDataFrame(data, "i int, version int")


def test_combine_latest(spark):
    larger = lambda a, b: {"a": a["version"], "b": b["version"],
                           "best": F.greatest(a["version"], b["version"])}
    found = joins.combine_latest(versions(spark, "A"), versions(spark, "B"), (), "i", larger)
    assert rows(found.select("i", "a", "b", "best"), "i") == [
        (1, 1, 2, 2), (2, 1, 4, 4), (3, 3, 4, 4), (4, 3, 6, 6), (5, 5, 6, 6),
    ]


def test_asof_uses_the_newest_parameter(spark, heavy):
    elements = spark.createDataFrame([(t, 10.0) for t in range(9)], "t int, v double")
    params = spark.createDataFrame([(3, 1.0), (6, 1.5)], "t int, p double")
    use = lambda row, p: {"scaled": row["v"] * F.coalesce(p["p"], F.lit(0.5))}
    found = joins.asof(elements, params, (), "t", use)
    assert [r["scaled"] for r in found.orderBy("t").collect()] == [5.0] * 3 + [10.0] * 3 + [15.0] * 3


@pytest.mark.parametrize("low_limits", [False, True])
def test_exclusion_lists_replace_each_other(spark, low_limits):
    if low_limits:
        spark.conf.set("spark.millrace.smallBytes", "0")
        spark.conf.set("spark.millrace.rowsPerTask", "2")
    try:
        elements = spark.createDataFrame(
            [(t, w) for t in range(10) for w in ("yes", "maybe")], "t int, word string"
        )
        # nothing at first; {yes} from 2; {yes, maybe} from 4; {no} from 6; empty from 8
        listing = spark.createDataFrame(
            [(2, "yes", 1), (4, "yes", 2), (4, "maybe", 2), (6, "no", 3), (8, None, 4)],
            "t int, word string, version int",
        )
        kept = joins.versioned_exclusion(elements, listing, "word", "t")
        passed = {(r["t"], r["word"]) for r in kept.collect()}
    finally:
        spark.conf.unset("spark.millrace.smallBytes")
        spark.conf.unset("spark.millrace.rowsPerTask")
    assert {t for t, w in passed if w == "yes"} == {0, 1, 6, 7, 8, 9}
    assert {t for t, w in passed if w == "maybe"} == {0, 1, 2, 3, 6, 7, 8, 9}


def test_zip_ends_with_the_shorter_side(spark):
    a = spark.createDataFrame([(i, f"a{i}") for i in range(4)], "i int, a string")
    b = spark.createDataFrame([(i * 10, f"b{i}") for i in range(2)], "j int, b string")
    zipped = joins.zip_positional(a, b, (), "i", "j")
    assert rows(zipped.select("idx", "a", "b"), "idx") == [(0, "a0", "b0"), (1, "a1", "b1")]


def test_surplus_lines_take_the_last_original(spark):
    originals = spark.createDataFrame(
        [("g", 0, 2, "o0"), ("g", 1, 2, "o1")], "k string, place int, n int, original string"
    )
    derived = spark.createDataFrame([("g", i, f"d{i}") for i in range(4)], "k string, place int, d string")
    found = joins.realign(derived, originals, "k", "place", "n")
    assert rows(found.select("d", "original"), "d") == [
        ("d0", "o0"), ("d1", "o1"), ("d2", "o1"), ("d3", "o1"),
    ]


def test_fan_out_pending_and_replies(spark):
    sent = spark.createDataFrame([(i,) for i in range(4)], "id int")
    acked = spark.createDataFrame([(1,), (3,)], "ack int")
    assert rows(joins.pending(sent, acked, [("id", "ack")]), "id") == [(0,), (2,)]
    matched = joins.match_replies(sent, acked, [("id", "ack")])
    assert [r["answered"] for r in matched.orderBy("id").collect()] == [False, True, False, True]
    assert joins.fan_out(sent, 4).count() == 16


def test_min_mean_max_and_zero_seed(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 5.0), ("b", -4.0), ("b", -2.0)], "k string, v double")
    true = ag.min_mean_max(df, "k", "v").select("k", "lowest", "highest", "mean")
    assert [tuple(r) for r in true.collect()] == [("a", 3.0, 5.0, 4.0), ("b", -4.0, -2.0, -3.0)]
    seeded = ag.min_mean_max(df, "k", "v", seed_zero=True).select("k", "lowest", "highest")
    assert [tuple(r) for r in seeded.collect()] == [("a", 0.0, 5.0), ("b", -4.0, 0.0)]


def test_means_are_not_rounded(spark):
    df = spark.createDataFrame([("a", 0.00001), ("a", 0.00002)], "k string, v double")
    assert ag.min_mean_max(df, "k", "v").first()["mean"] == pytest.approx(0.000015, rel=1e-12)
    timed = df.withColumn("ts", F.timestamp_seconds(F.lit(5)))
    assert ag.downsample(timed, "k", "ts", "1 minute", "v").first()["mean"] == pytest.approx(0.000015, rel=1e-12)


def test_a_listing_is_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def seen(v):
        made.add(1)
        return v

    listing = spark.range(4).select(F.lit(0).alias("version"), seen("id").alias("v"), F.lit(1).alias("t"))
    rows_ = spark.range(8).select(F.col("id").cast("int").alias("v"), F.lit(5).alias("t"))
    left = joins.versioned_exclusion(rows_, listing, "v", "t")
    assert sorted(r["v"] for r in left.collect()) == [4, 5, 6, 7] and made.value == 4


def test_stored_partials_merge_to_the_same_answer(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), (F.col("id") / 100).alias("v"))
    halves = [df.where(f"v {op} 5") for op in ("<", ">=")]
    merged = ag.merge_partials(
        ag.partials(halves[0], "k", "v").unionByName(ag.partials(halves[1], "k", "v")), "k"
    )
    assert rows(merged, "k") == rows(ag.partials(df, "k", "v"), "k")


def test_sums_keep_small_values_and_values_that_are_no_numbers(spark):
    df = spark.createDataFrame([(1, 0.004), (1, 0.004), (2, 1.0), (2, float("nan"))], "k int, v double")
    got = {r["k"]: r for r in ag.partials(df, "k", "v").collect()}
    assert got[1]["total"] == 0.008 and got[1]["n"] == 2
    assert math.isnan(got[2]["total"]) and got[2]["lowest"] == 1.0
    slots = df.withColumn("ts", F.timestamp_seconds(F.lit(5)))
    means = {r["k"]: r["mean"] for r in ag.downsample(slots, "k", "ts", "1 minute", "v").collect()}
    assert means[1] == 0.004 and math.isnan(means[2])


def test_rows_without_a_time_stay(spark):
    df = spark.createDataFrame([(1, 5, 1.0), (1, None, 2.0), (1, None, 4.0)], "k int, s int, v double")
    for kind in ("timestamp", "timestamp_ntz"):
        timed = df.withColumn("ts", F.timestamp_seconds("s").cast(kind))
        slots = {r["slot"]: (r["n"], r["mean"]) for r in ag.downsample(timed, "k", "ts", "1 minute", "v").collect()}
        assert len(slots) == 2 and slots[None] == (2, 3.0)
        assert sum(r["n"] for r in ag.throughput(timed, "ts", "1 minute").collect()) == 3
        assert sorted(r["v"] for r in latest.conflate(timed, "k", "ts", "1 minute", "v").collect()) == [1.0, 4.0]
        cut = sq.timed_chunks(timed, "k", ["ts", "v"], "ts", 1, "1 minute")
        assert sorted((r["v"], r["chunk_no"]) for r in cut.collect()) == [(1.0, 0), (2.0, 0), (4.0, 1)]


def test_large_ranks_are_positions_in_the_order(spark):
    df = spark.range(6000).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    df = df.unionByName(spark.range(3).select(F.lit(None).cast("bigint").alias("k"), F.col("id").alias("v")))
    kept = latest.keep_newest(df, "k", "v", 1500)
    found = kept.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("low")).collect()
    assert {r["k"]: (r["n"], r["low"]) for r in found} == {0: (1500, 3000), 1: (1500, 3001), None: (3, 0)}
    named = df.where("k IS NOT NULL").withColumn("s", F.col("k").cast("string"))
    few = latest.merge_by_priority(named, "s", ["v"], {"0": 2, "1": 1}, 900).select("s", "v", "position")
    many = latest.merge_by_priority(named, "s", ["v"], {"0": 2, "1": 1}, 1500).select("s", "v", "position")
    assert many.limit(900).collect() == few.collect()
    assert many.count() == 1500


def test_words_and_keyword_messages(spark):
    df = spark.createDataFrame([("Truth fakeNews, fakeNews!",), ("fakenews only",)], "t string")
    words = df.select(F.explode(text.words("t")).alias("w"))
    assert rows(ag.count_words(words, "w", ignore=["truth"]), "w") == [("fakenews", 3), ("only", 1)]
    assert df.where(F.contains("t", F.lit("fakeNews"))).count() == 1


def test_empty_input_folds_to_zero(spark):
    even = lambda *v: spark.createDataFrame([(x,) for x in v], "v int").where("v % 2 = 0")
    assert ag.empty_safe_sum(even(1, 3, 5), "v").first()["total"] == 0
    assert ag.empty_safe_sum(even(1, 2, 3, 5), "v").first()["total"] == 2


def lower(values):
    return sorted(values)[(len(values) - 1) // 2]


def by_hand(values):
    level = [lower(values[i:i + 5]) for i in range(0, len(values), 5)]
    while len(level) > 5:
        level = [lower(level[i:i + 5]) for i in range(0, len(level), 5)]
    return lower(level)


@pytest.mark.parametrize("size, expected", [(100, 38), (7, 3), (1, 1), (26, None), (53, None)])
def test_median_of_medians(spark, size, expected):
    data = list(range(1, size + 1))
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(data)], "k string, i int, v int")
    found = ag.median_of_medians(df, "k", "i", "v").first()["median"]
    assert found == by_hand(data)
    assert expected is None or found == expected


def test_lower_median_of_all_small_orders(spark):
    data = [(list(p),) for n in range(1, 5) for p in itertools.permutations(range(n))]
    df = spark.createDataFrame(data, "v array<int>").select("v", arrays.lower_median("v").alias("m"))
    assert all(r["m"] == statistics.median_low(r["v"]) for r in df.collect())


def test_kth_smallest_small_and_large_k(spark):
    df = spark.range(50).select((F.col("id") % 2).alias("k"), (100 - F.col("id")).alias("v"), "id")
    near = latest.kth_smallest(df, "k", "v", 3, "id")
    far = latest.kth_smallest(df, "k", "v", 3, "id", small_k=1)
    assert rows(near.select("k", "v"), "k") == rows(far.select("k", "v"), "k") == [(0, 56), (1, 55)]


def test_mean_is_cut_and_attributed_to_the_first_id(spark):
    df = spark.createDataFrame([("t", 0, 1.239, "x"), ("t", 1, 2.0, "y")], "k string, s int, v double, id string")
    df = df.withColumn("ts", F.timestamp_seconds("s"))
    found = ag.batch_means(df, "k", ["ts"], "ts", "v", "id", 100, "10 seconds").first()
    assert (found["first_id"], found["n"], found["measured"], found["mean"]) == ("x", 2, 2, 1.61)
    assert spark.range(1).select(numbers.floor_2(F.lit(1.6195)).alias("m")).first()["m"] == 1.61


def test_running_maps_of_few_and_many_keys(spark):
    data = [("u", i, f"k{(i * 7) % 5}", i) for i in range(12)] + [("w", 0, "k9", None)]
    data += [("u", 12, None, 99), ("x", 0, None, 1), (None, 0, "k1", 7), (None, 1, "k2", 8)]
    df = spark.createDataFrame(data, "u string, i int, key string, v int")
    few = ag.running_maps(df, "u", "i", "key", "v")
    many = ag.running_maps(df, "u", "i", "key", "v", most_columns=2)
    as_dicts = lambda d: {(r["u"], r["i"]): r["so_far"] for r in d.collect()}
    got = as_dicts(few)
    assert got == as_dicts(many)
    assert got[("u", 6)] == {"k0": 5, "k2": 6, "k4": 2, "k1": 3, "k3": 4}
    assert got[("u", 12)] == got[("u", 11)] and got[("x", 0)] == {}
    assert got[(None, 1)] == {"k1": 7, "k2": 8}
    # every sequence starts with the empty map
    assert all(got[(u, None)] == {} for u in ("u", "w", "x", None))
    assert few.count() == many.count() == len(data) + 4
    nothing = ag.running_maps(df.where("key IS NULL"), "u", "i", "key", "v")
    assert {r["so_far"].__len__() for r in nothing.collect()} == {0}


def test_throughput_rate_rule(spark):
    rate = lambda n, ms: spark.range(1).select(
        ag.overall_rate(F.lit(n), F.lit(ms)).alias("r")
    ).first()["r"]
    assert rate(100, 4999) == 0
    assert rate(100, 7999) == 14


def test_series_and_coverage(spark):
    points = spark.createDataFrame([("a", 1), ("a", 2), ("b", 9)], "s string, t int")
    assert ag.series_count(points, "s", "t", F.lit(0), F.lit(5)).first()[0] == 1
    assert ag.series_count(points, "s", "t", F.lit(50), F.lit(60)).first()[0] == 0
    seen = spark.createDataFrame([(1, 0, "x"), (2, 1, "x"), (3, 1, "y"), (4, 0, "y"), (5, 2, "x")],
                                 "t int, k int, b string")
    assert rows(ag.coverage(seen, "k", "b", "t", 2), "k") == [
        (0, 2, True, 4), (1, 2, True, 3), (2, 1, False, None),
    ]


def test_points_merge_per_field(spark):
    data = [("m", 1, 10, None), ("m", 2, None, 7), ("m", 3, 12, None)]
    df = spark.createDataFrame(data, "id string, seq int, a int, b int")
    assert rows(ag.merge_points(df, "id", ["a", "b"], "seq"), "id") == [("m", 12, 7)]


def test_divert_and_functions(spark):
    df = spark.range(1, 11).select(F.col("id").alias("n"))
    routed = routing.with_error(
        df, [(F.col("n") % 2 == 1, "odd"), (F.col("n") <= 5, "5 or less")]
    )
    valid, invalid = routing.divert(routed)
    assert rows(valid, "n") == [(6,), (8,), (10,)]
    assert rows(invalid, "n") == [
        (1, "odd"), (2, "5 or less"), (3, "odd"), (4, "5 or less"),
        (5, "odd"), (7, "odd"), (9, "odd"),
    ]
    both = routing.through_all(spark.range(1, 101), "id", [lambda v: v * 2, lambda v: v * 3])
    assert both.count() == 200
    assert both.agg(F.sum("result")).first()[0] == 25250
    with pytest.raises(ValueError):
        routing.through_all(df, "n", [])


def test_twin_primes(spark):
    n = F.col("id")
    twins = spark.range(100).where(numbers.is_prime(n) & numbers.is_prime(n + 2)).select((n * 2).alias("d"))
    assert [r["d"] for r in twins.orderBy("d").collect()] == [6, 10, 22, 34, 58, 82, 118, 142]


@pytest.mark.parametrize("low_limits", [False, True])
def test_round_robins(spark, low_limits):
    if low_limits:
        spark.conf.set("spark.millrace.smallBytes", "0")
        spark.conf.set("spark.millrace.rowsPerTask", "2")
    try:
        seven = spark.range(7)
        weighted = routing.weighted_round_robin(seven, "id", {"1": 1, "2": 2, "3": 3})
        assert "".join(r["target"] for r in weighted.orderBy("id").collect()) == "2233312"
        plain = routing.round_robin(seven, "id", 3)
        assert [r["target"] for r in plain.orderBy("id").collect()] == [0, 1, 2, 0, 1, 2, 0]
    finally:
        spark.conf.unset("spark.millrace.smallBytes")
        spark.conf.unset("spark.millrace.rowsPerTask")


def test_least_loaded_takes_the_lowest_id_of_a_tie(spark):
    loads = spark.createDataFrame([(3, 5), (2, 5), (1, 9)], "target int, load int")
    assert tuple(routing.least_loaded(loads, "target", "load").first()) == (2, 5)


def test_tap_observes_without_change(spark):
    from pyspark.sql import Observation

    seen = Observation("seen")
    df = spark.range(10).observe(seen, F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    assert df.count() == 10
    assert seen.get == {"n": 10, "top": 9}
    assert routing.tap(spark.range(3), "named", F.count(F.lit(1)).alias("n")).count() == 3


def test_dead_letters_keep_the_payload(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "bad")], "trace int, payload string")
    failed = routing.dead_letters(
        df, F.col("payload") == "bad", "trace", F.lit("BadPayload"), F.concat(F.lit("was "), "payload")
    )
    assert rows(failed, "trace") == [(2, "bad", "2", "BadPayload", "was bad")]


def test_priority_merge_and_retained(spark):
    data = [(s, i) for s in ("low", "high") for i in range(30)]
    df = spark.createDataFrame(data, "source string, i int")
    merged = latest.merge_by_priority(df, "source", "i", {"low": 1, "high": 10}, 11)
    counts = {r["source"]: r["count"] for r in merged.groupBy("source").count().collect()}
    assert counts == {"high": 10, "low": 1}
    topics = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("a", 5)], "topic string, t int")
    got = latest.retained(topics, "topic", "t", "t", F.lit(3))
    assert rows(got, "topic", "t") == [("a", 2, True), ("a", 5, False), ("b", 1, True)]


def test_newest_oldest_and_keep_newest(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", 1, None)],
                               "k string, t int, v string")
    assert rows(latest.newest_per(df, "k", "t"), "k") == [("a", 3, "y"), ("b", 1, None)]
    assert rows(latest.oldest_per(df, "k", "t"), "k") == [("a", 1, "x"), ("b", 1, None)]
    assert rows(latest.keep_newest(df, "k", "t", 2), "k", "t") == [
        ("a", 2, "z"), ("a", 3, "y"), ("b", 1, None),
    ]


def test_group_limit_runs_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = latest.keep_newest(df, "k", "id", 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit")
    assert "Partial" in plan[plan.index("Exchange"):]


def test_user_fold_merges_states_of_a_heavy_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 5 == 0, "few").otherwise("many").alias("k"), "id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        found = user.fold_per_key(
            df, "k", ["id"], "n BIGINT, top BIGINT",
            lambda rows: {"n": len(rows), "top": int(rows["id"].max())},
            lambda states: {"n": int(states["n"].sum()), "top": int(states["top"].max())},
            fan_in=4,
        )
        assert rows(found, "k") == [("few", 1000, 4995), ("many", 4000, 4999)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_equal_states_of_a_key_take_different_lanes(spark):
    df = spark.range(0, 5000, 1, 1).select(F.lit("k").alias("k"), F.lit(1).alias("v"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        found = user.fold_per_key(
            df, "k", ["v"], "n BIGINT, met BIGINT",
            lambda rows: {"n": len(rows), "met": 1},
            lambda states: {"n": int(states["n"].sum()), "met": max(int(states["met"].max()), len(states))},
            fan_in=10,
        ).first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # 50 states: 5 to a lane, and then those of 10 lanes
    assert (found["n"], found["met"]) == (5000, 10)


def test_rows_that_fail_are_skipped(spark):
    def strict(batch):
        if (batch["v"] % 7 == 3).any():
            raise ValueError
        return batch

    df = spark.range(0, 100, 1, 3).select(F.col("id").alias("v"))
    kept = user.map_batches(df, strict, "v BIGINT", skip_failing=True)
    assert sorted(r["v"] for r in kept.collect()) == [v for v in range(100) if v % 7 != 3]
    with pytest.raises(PythonException):
        user.map_batches(df, strict, "v BIGINT").collect()


def test_rows_that_fail_cost_no_further_calls(spark):
    calls = spark.sparkContext.accumulator(0)

    def strict(row):
        calls.add(1)
        if row.v % 7 == 3:
            raise ValueError
        return row.v, row.v * 2

    df = spark.range(0, 700, 1, 3).select(F.col("id").alias("v"))
    each = user.each_row(strict, ["v", "doubled"])
    kept = user.map_batches(df, each, "v BIGINT, doubled BIGINT", skip_failing=True)
    assert sorted(map(tuple, kept.collect())) == [(v, 2 * v) for v in range(700) if v % 7 != 3]
    assert calls.value == 700
    with pytest.raises(PythonException, match="ValueError"):
        user.map_batches(df, each, "v BIGINT, doubled BIGINT").collect()
    none = user.map_batches(df.where("v % 7 = 3"), each, "v BIGINT, doubled BIGINT", skip_failing=True)
    assert none.count() == 0


def test_rows_left_of_a_batch_go_on_as_one(spark):
    def strict(batch):
        if (batch["v"] % 7 == 3).any():
            raise ValueError
        return batch

    df = spark.range(0, 700, 1, 1).select(F.col("id").alias("v"))
    kept = user.map_batches(df, strict, "v BIGINT", skip_failing=True)
    sizes = kept.mapInPandas(lambda batches: (b.iloc[:0].assign(n=[]) if b.empty else b.iloc[:1].assign(n=len(b)) for b in batches), "v BIGINT, n BIGINT")
    assert [r.n for r in sizes.collect()] == [600]


def test_concat_keeps_the_order_of_the_inputs(spark):
    a, b = spark.createDataFrame([(5,)], "v int"), spark.createDataFrame([(1,)], "v int")
    seq = o.ordered(routing.concat(a, b), (), ["part", "v"]).add(i=o.index())
    assert [r["v"] for r in seq.df.orderBy("i").collect()] == [5, 1]


def test_means_keep_small_and_odd_values(spark):
    from millrace.operators import aggregates

    rows = [("a", 0.004), ("a", 0.004), ("b", float("nan")), ("b", 1.0), ("c", 1e18), ("c", 3e18)]
    got = {r.k: r for r in aggregates.min_mean_max(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    assert got["a"]["mean"] == 0.004 and got["b"]["mean"] != got["b"]["mean"] and got["c"]["mean"] == 2e18
