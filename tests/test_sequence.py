"""Sequence operators: known cases, on the plain path and on the heavy-key path."""

import random
import time

import pytest
from pyspark.sql import functions as F

from millrace.operators import ordered as o
from millrace.operators import sequence as sq


@pytest.fixture(params=["plain", "heavy"])
def path(request, spark):
    if request.param == "heavy":
        spark.conf.set("spark.millrace.smallBytes", "0")
        spark.conf.set("spark.millrace.rowsPerTask", "3")
    yield request.param
    spark.conf.unset("spark.millrace.smallBytes")
    spark.conf.unset("spark.millrace.rowsPerTask")


def seq_of(spark, values, kind="int"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return o.ordered(df, (), "i")


def groups(df, number, value):
    """Values per group number, in row order."""
    found = {}
    for r in sorted(df.collect(), key=lambda r: r["i"]):
        found.setdefault(r[number], []).append(r[value])
    assert list(found) == list(range(len(found)))
    return list(found.values())


def values(df, column="v"):
    return [r[column] for r in sorted(df.collect(), key=lambda r: r["i"])]


def test_drop_consecutive_duplicates(spark, path):
    seq = seq_of(spark, [7, 7, 30, 7, 30, 30, 30, 0, 0, 7])
    assert values(sq.drop_consecutive_duplicates(seq, "v")) == [7, 30, 7, 30, 0, 7]
    nulls = seq_of(spark, [None, None, 1, None])
    assert values(sq.drop_consecutive_duplicates(nulls, "v")) == [None, 1, None]


def test_runs_open_a_new_group_for_a_returning_key(spark, path):
    kinds = "red red blue red blue blue green".split()
    df = spark.createDataFrame([(i, k, 10 * i) for i, k in enumerate(kinds)], "i int, k string, v int")
    assert groups(sq.runs(o.ordered(df, (), "i"), "k").df, "run_no", "v") == [
        [0, 10], [20], [30], [40, 50], [60],
    ]
    assert groups(sq.runs(seq_of(spark, [8, None, None, 8]), "v").df, "run_no", "v") == [[8], [None, None], [8]]


# Gaps of exactly 5 between q and r and between v and w.
SESSION_EVENTS = [
    (3, "p"), (4, "q"), (9, "r"), (12, "s"), (12, "t"), (16, "u"), (30, "v"), (35, "w"), (36, "x"),
]


def test_sessions_split_at_exactly_the_gap(spark, path):
    rows = [(i, t, d) for i, (t, d) in enumerate(SESSION_EVENTS)]
    df = spark.createDataFrame(rows, "i int, t bigint, v string")
    expected = ["pq", "rstu", "v", "wx"]
    numbered = sq.number_sessions(o.ordered(df, (), ["t", "i"]), "t", 5).df
    assert ["".join(g) for g in groups(numbered, "session_no", "v")] == expected
    timed = df.withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz"))
    numbered = sq.sessions(o.ordered(timed, (), ["ts", "i"]), "ts", 5).df
    assert ["".join(g) for g in groups(numbered, "session_no", "v")] == expected


def test_scenes_use_the_end_of_the_row_before(spark, path):
    # the long first block covers the second one; its end does not count for the third
    rows = [(0, 0, 100), (1, 10, 20), (2, 25, 30), (3, 29, 31), (4, 41, 50)]
    df = spark.createDataFrame(rows, "i int, s int, e int")
    grouped = sq.scenes(o.ordered(df, (), ["s", "i"]), "s", "e", 10).df
    assert groups(grouped, "scene_no", "i") == [[0, 1, 2, 3], [4]]


def test_chunks_and_sliding(spark, path):
    seq = seq_of(spark, list(range(1, 8)))
    assert groups(sq.chunks(seq, 3).df, "chunk_no", "v") == [[1, 2, 3], [4, 5, 6], [7]]
    windows = sorted(r["win"] for r in sq.sliding(seq, "v", 3).collect())
    assert windows == [[1, 2, 3], [2, 3, 4], [3, 4, 5], [4, 5, 6], [5, 6, 7]]
    short = sq.sliding(seq_of(spark, [1, 2]), "v", 3).collect()
    assert [r["win"] for r in short] == [[1, 2]]


def test_chunk_by_marker_and_fold(spark, path):
    words = "A say a word STOP B be ready STOP".split()
    chunked = sq.marker_chunks(seq_of(spark, words, "string"), F.col("v") == "STOP").df
    assert groups(chunked, "chunk_no", "v") == [
        ["A", "say", "a", "word", "STOP"], ["B", "be", "ready", "STOP"],
    ]
    placed = o.ordered(chunked, "chunk_no", "i").add(pos=o.index()).df
    rest = sq.fold_text(placed.where("pos > 0"), "chunk_no", "pos", "v", leading=True)
    folded = {r["chunk_no"]: r["folded"] for r in rest.collect()}
    assert folded[0].upper() == " SAY A WORD STOP"
    assert folded[1].lower() == " be ready stop"


def test_fold_text_goes_on_in_parts(spark, path):
    rows = [("g", i, f"w{i}") for i in range(20)] + [("h", 0, "x")]
    df = spark.createDataFrame(rows, "k string, i int, v string")
    parts = sq.fold_text(df, "k", "i", "v", part_bytes=12).orderBy("k", "part").collect()
    whole = "".join(r["folded"] for r in parts if r["k"] == "g")
    assert whole == " ".join(f"w{i}" for i in range(20))
    assert len(parts) > 4
    assert all(len(r["folded"]) <= 12 + 5 for r in parts)


def test_long_windows_reach_over_blocks_in_one_pass(spark, path):
    rows = [("a", i, None if i % 9 == 4 else i) for i in range(57)] + [("b", i, -i) for i in range(3)]
    seq = o.ordered(spark.createDataFrame(rows, "k string, i int, v int"), "k", "i")
    for size in (1, 2, 20, 57, 60):
        got = sorted((r["k"], r["i"], r["win"]) for r in sq.sliding(seq, "v", size).collect())
        expected = []
        for k in "ab":
            values = [v for key, _, v in rows if key == k]
            for i in range(max(len(values) - size + 1, 1)):
                expected.append((k, i, values[i : i + size]))
        assert got == expected


def test_plans_of_long_windows_stay_small(spark, tmp_path):
    before = {n: spark.conf.get(n, None) for n in ("spark.millrace.smallBytes", "spark.millrace.rowsPerTask")}
    spark.conf.set("spark.millrace.smallBytes", "0")
    spark.conf.set("spark.millrace.rowsPerTask", "100")
    try:
        source = str(tmp_path / "rows")
        spark.range(1000).select("id", (F.col("id") * 3).alias("v")).write.parquet(source)
        seq = o.ordered(spark.read.parquet(source), (), "id")
        start = time.monotonic()
        plan = sq.sliding(seq, "v", 20)._jdf.queryExecution().executedPlan().toString()
        assert time.monotonic() - start < 2
        assert plan.count("Scan parquet") <= 4
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_head_and_tail_are_written_once(spark, path):
    df = spark.createDataFrame([("g", i, f"w{i}") for i in range(20)] + [("h", 0, "x")], "k string, i int, v string")
    for most in (12, 1 << 20):
        parts = sq.fold_text(df, "k", "i", "v", separator="; ", part_bytes=most, head="[", tail="]")
        whole = {"g": "", "h": ""}
        for r in parts.orderBy("k", "part").collect():
            whole[r["k"]] += r["folded"]
        assert whole == {"g": "[" + "; ".join(f"w{i}" for i in range(20)) + "]", "h": "[x]"}


def test_first_element_is_special(spark, path):
    seq = seq_of(spark, [1, 2, 3, 4, 5])
    said = lambda t: F.concat(F.lit(t), F.col("v").cast("string"))
    treated = sq.special_first(seq, said("head="), said("tail="))
    assert values(treated, "treated") == ["head=1"] + [
        f"tail={i}" for i in range(2, 6)
    ]
    assert [(r["head"], r["v"]) for r in sq.head_with_rest(seq, "v").orderBy("i").collect()] == [
        (1, 2), (1, 3), (1, 4), (1, 5),
    ]


def test_take_and_drop_while(spark, path):
    seq = seq_of(spark, [1, 2, 9, 1, 2])
    assert values(sq.take_while(seq, F.col("v") < 5)) == [1, 2]
    assert values(sq.drop_while(seq, F.col("v") < 5)) == [9, 1, 2]


def test_running_fold_starts_with_its_zero(spark, path):
    folded = sq.running_fold(seq_of(spark, list(range(1, 11))), "v", kind="product")
    found = [r["folded"] for r in folded.orderBy("step").collect()]
    assert found == [1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880, 3628800]
    sums = sq.running_fold(seq_of(spark, [5, 6]), "v").orderBy("step").collect()
    assert [r["folded"] for r in sums] == [0, 5, 11]


def test_per_second_groups(spark, path):
    stamps = [0.1, 0.9, 1.0, 1.5, 3.2]
    df = spark.createDataFrame(list(enumerate(stamps)), "i int, s double").withColumn(
        "ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("bigint"))
    )
    seq = o.ordered(df, (), ["ts", "i"])
    count = lambda d: [
        r["count"] for r in d.groupBy("group_no").count().orderBy("group_no").collect()
    ]
    assert count(sq.changed_seconds(seq, "ts")) == [2, 2, 1]
    assert sum(count(sq.changed_seconds(seq, "ts", drop_last=True))) == len(stamps) - 1


def test_flush_batches(spark, path):
    events = [(0, 0.0, "42"), (1, 0.1, "abc"), (2, 2.1, "43"), (3, 2.2, "44"), (4, 2.3, "Flush"),
              (5, 2.4, "45"), (6, 2.5, "Flush"), (7, 2.6, "Flush")]
    df = spark.createDataFrame(events, "i int, s double, v string").withColumn(
        "ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("bigint"))
    )
    batched = sq.flush_batches(o.ordered(df, (), ["ts", "i"]), "ts", F.col("v") == "Flush", 1)
    assert groups(batched, "batch_no", "v") == [["42", "abc"], ["43", "44"], ["45"]]


def test_replace_or_append(spark, path):
    steps = [("get", 0), ("add", 1), ("add", 1), ("replace", 3), ("add", 1), ("get", 0)]
    df = spark.createDataFrame([(i, k, n) for i, (k, n) in enumerate(steps)], "i int, k string, n int")
    sized = sq.replace_or_append(o.ordered(df, (), "i"), F.col("k") == "replace", F.col("n"))
    assert values(sized, "size") == [None, 1, 2, 3, 4, 4]


def test_dedupe_with_reset(spark, path):
    df = spark.createDataFrame(list(enumerate([7, 7, 7, 7, 9])), "i int, v int")
    kept = sq.dedupe_with_reset(df, "v", "i", 2).orderBy("i").collect()
    assert [(r["i"], r["v"]) for r in kept] == [(0, 7), (2, 7), (4, 9)]
    once = sq.dedupe_with_reset(df, "v", "i").orderBy("i").collect()
    assert [(r["i"], r["v"]) for r in once] == [(0, 7), (4, 9)]


def test_cache_reads_renew_the_idle_time(spark, path):
    minutes = [0, 4, 8, 13.5]
    df = spark.createDataFrame([(i, 1, m * 60.0) for i, m in enumerate(minutes)], "i int, k int, s double")
    df = df.withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("bigint")))
    judged = sq.cache_outcome(df, "k", ["ts", "i"], "ts", 300)
    assert values(judged, "outcome") == ["miss", "hit", "hit", "miss"]
    updated = sq.cache_outcome(
        df, "k", ["ts", "i"], "ts", 300, update=F.col("i") == 2, update_idle_seconds=600
    )
    assert values(updated, "outcome") == ["miss", "hit", "update", "hit"]


def test_late_rows_move_the_mark_with_every_row(spark, path):
    seq = seq_of(spark, [2, 9, 1, 30, 27, 31, 26]).with_columns(ts=F.timestamp_seconds("v"))
    late = sq.late_rows(seq, "ts", 4)
    assert [r["v"] for r in late.where("late").orderBy("i").collect()] == [1, 26]


def test_heartbeats_fill_idle_stretches(spark, path):
    seq = seq_of(spark, [0, 5, 30, 60]).with_columns(ts=F.timestamp_seconds("v").cast("timestamp_ntz"))
    beats = sq.heartbeats(seq, "ts", 10).select(F.unix_seconds(F.col("beat").cast("timestamp")).alias("b"))
    assert sorted(r["b"] for r in beats.collect()) == [15, 25, 40, 50]


def test_timed_chunks_stay_in_their_bucket(spark, path):
    df = spark.createDataFrame([(i, "k", t) for i, t in enumerate([0, 1, 2, 61, 62])], "i int, k string, t int")
    df = df.withColumn("ts", F.timestamp_seconds("t"))
    cut = sq.timed_chunks(df, "k", ["ts", "i"], "ts", 2, "1 minute")
    sizes = cut.groupBy("bucket", "chunk_no").count().orderBy("bucket", "chunk_no").collect()
    assert [r["count"] for r in sizes] == [2, 1, 2]


def test_sessions_partition_the_input(spark, path):
    rnd = random.Random(3)
    rows = [(i, rnd.choice("ab"), rnd.randrange(200)) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, k string, t int")
    found = sq.number_sessions(o.ordered(df, "k", ["t", "i"]), "t", 7).df.collect()
    assert sorted(r["i"] for r in found) == list(range(60))
    for k in "ab":
        mine = sorted((r["session_no"], r["t"]) for r in found if r["k"] == k)
        for (n1, t1), (n2, t2) in zip(mine, mine[1:]):
            assert (t2 - t1 < 7) == (n1 == n2)


def test_times_without_zone_ignore_clock_changes(spark, path):
    # the clocks of this zone skip from 2 to 3 o'clock on that day
    stamps = ["2024-03-10 01:50:00", "2024-03-10 02:30:00", "2024-03-10 03:10:00", "2024-03-10 04:20:00"]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame(list(enumerate(stamps)), "i int, s string").select(
            "i", F.col("s").cast("timestamp_ntz").alias("ts")
        )
        numbered = sq.sessions(o.ordered(df, (), ["ts", "i"]), "ts", 3600).df
        assert groups(numbered, "session_no", "i") == [[0, 1, 2], [3]]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_arguments_are_checked(spark):
    df = spark.range(3)
    with pytest.raises(ValueError):
        o.ordered(df, (), ())
    with pytest.raises(ValueError):
        sq.chunks(o.ordered(df, (), "id"), 0)
    with pytest.raises(ValueError):
        sq.sliding(o.ordered(df, (), "id"), "id", 0)
