"""Streams against their batch form, late rows, restarts, repeated batches."""

import datetime as dt
import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from millrace.operators import latest
from millrace.sources.index import DocumentIndex
from millrace.streaming import runs, sinks, stateful, windows

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def land(spark, folder, rows, schema, name="in"):
    path = folder.landing(name)
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def seconds(value):
    return int((value.replace(tzinfo=dt.timezone.utc) - T0).total_seconds())


def test_windows_per_event(spark):
    df = spark.createDataFrame([("k", at(25))], "k string, ts timestamp")
    spans = lambda step: [
        (seconds(r["start"]), seconds(r["end"]))
        for r in windows.event_windows(df, "k", "ts", 10, step).orderBy("start").collect()
    ]
    assert spans(None) == [(20, 30)]
    assert spans(5) == [(20, 30), (25, 35)]
    with pytest.raises(ValueError):
        windows.event_windows(df, "k", "ts", 10, 4)


def test_window_size_counts_distinct_times(spark):
    df = spark.createDataFrame([("k", at(1), 1), ("k", at(1), 2)], "k string, ts timestamp, id int")
    row = windows.event_windows(df, "k", "ts", 10).first()
    assert (row["n"], row["n_times"]) == (2, 1)


def test_window_stream_equals_batch_and_emits_on_close(spark):
    folder, schema = runs.Folder.new(spark, "t-windows"), "k string, ts timestamp"
    rows = [("a", at(s)) for s in (1, 2, 2, 11, 25)] + [("b", at(3))]
    stream = windows.event_windows(
        runs.with_event_time(land(spark, folder, rows, schema), "ts", "4 seconds"), "k", "ts", 10
    )
    runs.drain(folder.append_to(stream))
    out = folder.read(stream)
    # the mark is 21: [20, 30) is still open
    assert sorted((r["k"], seconds(r["start"]), r["n"], r["n_times"]) for r in out.collect()) == [
        ("a", 0, 3, 2), ("a", 10, 1, 1), ("b", 0, 1, 1),
    ]
    # a closed window never opens again
    land(spark, folder, [("a", at(5)), ("a", at(40))], schema)
    runs.drain(folder.append_to(stream))
    assert sorted((r["k"], seconds(r["start"]), r["n"]) for r in folder.read(stream).collect()) == [
        ("a", 0, 3), ("a", 10, 1), ("a", 20, 1), ("b", 0, 1),
    ]


def test_session_stream_splits_at_the_gap_and_flushes_at_the_end(spark):
    folder, schema = runs.Folder.new(spark, "t-sessions"), "k string, ts timestamp"
    times = (1, 7, 8, 15, 16, 18, 25, 26, 26, 28, 32, 42, 43, 48)
    whole = land(spark, folder, [("u", at(s)) for s in times], schema).unionByName(
        runs.end_marks(spark, folder, schema)
    )
    stream = windows.sessions(runs.with_event_time(whole, "ts", "1 second"), "k", "ts", 5)
    runs.drain(folder.append_to(stream))
    runs.mark_end(spark, folder, schema, "ts")
    runs.drain(folder.append_to(stream))
    got = folder.read(stream).where("k IS NOT NULL").orderBy("start_ts").collect()
    assert [r["n"] for r in got] == [1, 2, 3, 5, 2, 1]


def test_late_filter_goes_on_over_batches(spark):
    folder, schema = runs.Folder.new(spark, "t-late"), "n int, ts timestamp"
    rule = stateful.late_filter(folder, [], ["n"], "ts", 4)
    arrivals = [2, 9, 1, 30, 27, 31, 26]
    for piece in (range(0, 2), range(2, 5), range(5, 7)):
        stream = land(spark, folder, [(i, at(arrivals[i])) for i in piece], schema)
        runs.drain(rule.writer(stream))
    kept = runs.read_batches(folder, schema).orderBy("n").collect()
    assert [seconds(r["ts"]) for r in kept] == [2, 9, 30, 27, 31]


def test_late_filter_per_key(spark, heavy):
    folder, schema = runs.Folder.new(spark, "t-late"), "k string, n int, ts timestamp"
    rule = stateful.late_filter(folder, ["k"], ["n"], "ts", 4)
    for piece in ([("a", 0, at(50)), ("b", 1, at(9))], [("a", 2, at(45)), ("b", 3, at(6))], [("a", 4, at(46))]):
        runs.drain(rule.writer(land(spark, folder, piece, schema)))
    assert sorted(r["n"] for r in runs.read_batches(folder, schema).collect()) == [0, 1, 3, 4]


def test_cache_outcomes_go_on_over_batches(spark):
    folder, schema = runs.Folder.new(spark, "t-cache"), "k int, n int, ts timestamp, kind string"
    rule = stateful.cache_outcomes(
        folder, "k", ["ts", "n"], "ts", lambda: F.col("kind") == "update", 300, 600
    )
    for i, (minute, kind) in enumerate([(0, "get"), (4, "get"), (8, "update"), (17, "get"), (23, "get")]):
        runs.drain(rule.writer(land(spark, folder, [(1, i, at(minute * 60), kind)], schema)))
    out = runs.read_batches(folder, "n int, outcome string").orderBy("n").collect()
    assert [r["outcome"] for r in out] == ["miss", "hit", "update", "hit", "miss"]
    # what is carried is bounded by the idle time: the last access only
    carried = spark.read.parquet(f"{folder.path}/carried/batch_id=4")
    assert [r["n"] for r in carried.collect()] == [4]


def test_running_counts_are_a_log_of_changes(spark):
    folder = runs.Folder.new(spark, "t-counts")
    counts = stateful.RunningCounts(folder, "w")
    for words in (["a", "b", "a"], ["a"]):
        runs.drain(counts.writer(land(spark, folder, [(w,) for w in words], "w string")))
    assert sorted((r["w"], r["n"]) for r in counts.current().collect()) == [("a", 3), ("b", 1)]
    assert sorted((r["w"], r["n"]) for r in counts.changes().collect()) == [("a", 2), ("a", 3), ("b", 1)]


def test_repeated_batches_change_nothing(spark):
    folder = runs.Folder.new(spark, "t-repeat")
    index = DocumentIndex(spark, folder.output, ["id"], ["n"])
    stream = land(spark, folder, [("x", 1), ("x", 2), ("y", 1)], "id string, n int")
    runs.drain(sinks.to_index(stream, folder, index))
    # a lost commit makes Spark run the batch again
    local = folder.checkpoint.replace("file:", "")
    os.remove(os.path.join(local, "commits", "0"))
    crc = os.path.join(local, "commits", ".0.crc")
    if os.path.exists(crc):
        os.remove(crc)
    runs.drain(sinks.to_index(stream, folder, index))
    assert sorted((r["id"], r["n"]) for r in index.read().collect()) == [("x", 2), ("y", 1)]
    assert spark.read.parquet(folder.output).count() == 2


def test_all_consumers_get_every_row(spark):
    folder = runs.Folder.new(spark, "t-multi")
    stream = land(spark, folder, [(i,) for i in range(10)], "n int")
    runs.drain(sinks.to_all(stream, folder, {"backup": lambda b: b, "even": lambda b: b.where("n % 2 = 0")}))
    count = lambda name: spark.read.parquet(f"{folder.output}/{name}").count()
    assert (count("backup"), count("even")) == (10, 5)


def test_exclusion_list_is_read_for_each_batch(spark):
    folder = runs.Folder.new(spark, "t-list")
    listed = {"now": ["yes"]}
    read = lambda s: s.createDataFrame([(w,) for w in listed["now"]] or [], "word string")
    for words, banned in ((["yes", "no"], ["yes"]), (["yes", "no"], ["no"]), (["yes"], [])):
        listed["now"] = banned
        stream = land(spark, folder, [(w,) for w in words], "word string")
        runs.drain(sinks.without_listed(stream, folder, read, "word"))
    assert sorted(r["word"] for r in spark.read.parquet(folder.output).collect()) == ["no", "yes", "yes"]


def test_each_batch_applies_a_batch_operator(spark):
    folder = runs.Folder.new(spark, "t-each")
    newest = lambda b: latest.newest_per(b, "k", "n")
    for rows in ([("a", 1), ("a", 5)], [("a", 2), ("b", 1)]):
        runs.drain(runs.each_batch(land(spark, folder, rows, "k string, n int"), folder, newest))
    got = runs.read_batches(folder, "k string, n int").collect()
    assert sorted((r["batch_id"], r["k"], r["n"]) for r in got) == [(0, "a", 5), (1, "a", 2), (1, "b", 1)]


def test_duplicates_within_the_watermark(spark):
    folder, schema = runs.Folder.new(spark, "t-dedupe"), "id int, ts timestamp"
    for rows in ([(1, at(0)), (1, at(1)), (2, at(2))], [(2, at(3)), (3, at(4))]):
        stream = land(spark, folder, rows, schema)
        once = windows.dedupe_within(runs.with_event_time(stream, "ts", "1 minute"), "id")
        runs.drain(folder.append_to(once))
    assert sorted(r["id"] for r in folder.read(once).collect()) == [1, 2, 3]


def test_directory_ingest_takes_each_file_once(spark, tmp_path):
    folder, upload = runs.Folder.new(spark, "t-ingest"), tmp_path / "upload"

    def put(name):
        path = upload / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"content of {name}")

    def processed():
        stream = sinks.read_directory(spark, str(upload), archive=str(tmp_path / "done"))
        runs.drain(folder.append_to(stream))
        return folder.read(stream).count()

    put("one.txt")
    put("sub/two.txt")
    assert processed() == 2
    put("three.txt")
    assert processed() == 3
    put("sub/four.txt")
    put("new/nested/five.txt")
    assert processed() == 5
    assert processed() == 5


def test_intake_is_limited_per_batch(spark, tmp_path):
    folder, upload = runs.Folder.new(spark, "t-limit"), tmp_path / "upload"
    upload.mkdir()
    for i in range(5):
        (upload / f"{i}.txt").write_text(str(i))
    stream = sinks.read_directory(spark, str(upload), max_files=2)
    query = runs.drain(folder.append_to(stream))
    sizes = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert max(sizes) <= 2 and sum(sizes) == 5


def test_restart_goes_on_from_the_checkpoint(spark):
    folder, tries, waits = runs.Folder.new(spark, "t-restart"), [], []
    stream = land(spark, folder, [(1,), (2,)], "n int")

    def write(batch, batch_id):
        tries.append(batch_id)
        if len(tries) < 3:
            raise RuntimeError("store is away")
        batch.write.mode("overwrite").parquet(f"{folder.output}/batch_id={batch_id}")

    def start():
        writer = stream.writeStream.option("checkpointLocation", folder.checkpoint)
        return writer.foreachBatch(write).trigger(availableNow=True).start()

    runs.run_restarting(start, least_wait=1, most_wait=10, sleep=waits.append)
    assert (tries, waits) == ([0, 0, 0], [1, 2])
    assert runs.read_batches(folder, "n int").count() == 2


def test_restarts_are_limited(spark):
    folder = runs.Folder.new(spark, "t-limit")
    stream = land(spark, folder, [(1,)], "n int")

    def fail(batch, batch_id):
        raise RuntimeError("always")

    def start():
        writer = stream.writeStream.option("checkpointLocation", folder.checkpoint)
        return writer.foreachBatch(fail).trigger(availableNow=True).start()

    waits = []
    with pytest.raises(StreamingQueryException):
        runs.run_restarting(start, most_restarts=2, sleep=waits.append)
    assert waits == [1.0, 2.0]


def test_a_running_query_can_be_stopped(spark):
    folder = runs.Folder.new(spark, "t-stop")
    query = folder.append_to(sinks.ticks(spark, 5)).start()
    query.processAllAvailable()
    query.stop()
    assert not query.isActive and query.exception() is None


def test_fold_until_idle_gives_partial_folds(spark):
    folder, schema = runs.Folder.new(spark, "t-fold"), "k string, n bigint, ts timestamp"
    rows = [("a", i, at(i)) for i in range(50)] + [("b", 1, at(1))]
    whole = land(spark, folder, rows, schema).unionByName(runs.end_marks(spark, folder, schema))

    def step(state, batch):
        return (state[0] + len(batch), state[1] + int(batch["n"].fillna(0).sum()))

    stream = stateful.fold_until_idle(
        runs.with_event_time(whole, "ts", "1 second"), "k", "ts", "n", (0, 0), "rows BIGINT, total BIGINT",
        step, idle_ms=1000, spread=3,
    )
    runs.drain(folder.append_to(stream))
    runs.mark_end(spark, folder, schema, "ts")
    runs.drain(folder.append_to(stream))
    got = folder.read(stream).where("k IS NOT NULL").groupBy("k").agg(F.sum("rows"), F.sum("total"))
    assert sorted(map(tuple, got.collect())) == [("a", 50, 1225), ("b", 1, 1)]


def test_idle_time_is_counted_from_the_keys_own_newest_event(spark):
    folder, schema = runs.Folder.new(spark, "t-idle"), "k string, n bigint, ts timestamp"
    marks = runs.end_marks(spark, folder, schema)
    add = lambda state, batch: (state[0] + len(batch),)

    def drained(rows):
        whole = land(spark, folder, rows, schema).unionByName(marks)
        stream = stateful.fold_until_idle(
            runs.with_event_time(whole, "ts", "1 second"), "k", "ts", "n", (0,), "rows BIGINT",
            add, idle_ms=60_000, spread=1,
        )
        runs.drain(folder.append_to(stream))
        return sorted((r["k"], r["rows"]) for r in folder.read(stream).where("k IS NOT NULL").collect())

    assert drained([("a", 1, at(1000)), ("b", 1, at(1000))]) == []
    assert drained([("a", 2, at(1040))]) == []  # b has been idle for 39 s only
    # a went on, b did not: b comes out, a counts from its own newest event
    assert drained([("c", 1, at(1070))]) == [("b", 1)]
    assert drained([("a", 3, at(1075))]) == [("b", 1)]
    assert drained([("c", 2, at(1200))]) == [("a", 3), ("b", 1)]
    runs.mark_end(spark, folder, schema, "ts")
    assert drained([]) == [("a", 3), ("b", 1), ("c", 2)]


def test_folds_of_many_keys_share_states(spark):
    folder, schema = runs.Folder.new(spark, "t-shared"), "k string, n bigint, ts timestamp"
    marks = runs.end_marks(spark, folder, schema)
    add = lambda state, batch: (state[0] + len(batch),)

    def drained(rows):
        whole = land(spark, folder, rows, schema).unionByName(marks)
        stream = stateful.fold_until_idle(
            runs.with_event_time(whole, "ts", "1 second"), "k", "ts", "n", (0,), "rows BIGINT",
            add, idle_ms=60_000, spread=2, buckets=3,
        )
        run = runs.drain(folder.append_to(stream))
        found = folder.read(stream).where("k IS NOT NULL").groupBy("k").agg(F.sum("rows").alias("n"))
        return sorted(map(tuple, found.collect())), run.lastProgress["stateOperators"][0]["numRowsTotal"]

    out, kept = drained([(f"key {k}", n, at(k)) for k in range(100) for n in range(4)])
    assert kept <= 6
    # keys come out by their own idle time, in a bucket where others go on
    assert {k for k, _ in out} == {f"key {k}" for k in range(38)}
    out, _ = drained([(f"key {k}", n, at(k + 60)) for k in range(50, 100) for n in range(4)])
    runs.mark_end(spark, folder, schema, "ts")
    out, _ = drained([])
    assert out == sorted((f"key {k}", 4 if k < 50 else 8) for k in range(100))


def test_checkpoints_live_below_the_shared_folder(spark):
    folder = runs.Folder.new(spark, "t-place")
    assert folder.checkpoint.startswith(spark.conf.get("spark.checkpoint.dir"))
