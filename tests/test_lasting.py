"""Streams that give up state while they run, redelivery, batches seen whole or not at all."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from millrace.operators import joins
from millrace.plans import lasting
from millrace.runtime import get_file, names_in, put_file, work_dir
from millrace.streaming import runs, stateful, timed
from millrace.streaming.published import Published, batch_key
from millrace.streaming.redelivery import Redelivery

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def seconds(value):
    return int((value.replace(tzinfo=dt.timezone.utc) - T0).total_seconds())


def land(spark, folder, rows, schema):
    path = folder.landing("in")
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


@pytest.mark.parametrize("found", [lasting.timed_sessions, lasting.delivered_twice])
def test_state_is_given_up_and_rows_come_out_before_the_end(spark, sf_dir, found):
    log = []
    total = found(spark, sf_dir, log=log).count()
    assert len(log) == lasting.SLICES >= 5
    out = [s.rows_out for s in log]
    assert out == sorted(out) and 0 < out[1] < out[3] <= out[4] <= total
    # what is kept belongs to the last hours, not to all that has passed
    assert max(s.state_rows for s in log) < total / 2
    assert log[-1].state_rows < 2 * max(log[0].state_rows, 20)


def test_windows_come_out_while_the_stream_goes_on(spark, sf_dir):
    log = []
    total = lasting.closed_windows(spark, sf_dir, None, log).count()
    assert [s.rows_out for s in log] == sorted(s.rows_out for s in log) and log[2].rows_out > total / 4


def test_sessions_close_by_timer_while_other_keys_go_on(spark):
    folder, schema = runs.Folder.new(spark, "t-timer"), "k string, ts timestamp"

    def drained(rows):
        stream = runs.with_event_time(land(spark, folder, rows, schema), "ts", "5 seconds")
        done = timed.sessions(stream, "k", "ts", 10)
        with timed.stores(spark):
            run = runs.drain(folder.append_to(done))
        rows = [(r.k, r.n, seconds(r.start_ts), seconds(r.end_ts)) for r in folder.read(done).collect()]
        return sorted(rows), run.lastProgress["stateOperators"][0]["numRowsTotal"]

    out, kept = drained([("a", at(3)), ("b", at(4)), ("a", at(8)), (None, at(1)), ("c", None)])
    assert out == [] and kept > 0
    # out of order inside the delay: a row that joins two open sessions of a, and one on its own
    out, _ = drained([("a", at(17)), ("a", at(13)), ("b", at(14))])
    assert out == []
    out, before = drained([("b", at(23)), ("c", at(31)), ("c", at(41))])
    # the mark is 36: a ended at 17 and is over, b goes on until 23 + 10
    assert out == [("a", 4, 3, 17), ("b", 1, 4, 4), ("b", 2, 14, 23)]
    out, after = drained([("c", at(50)), ("c", at(500))])
    assert out[3:] == [("c", 1, 31, 31), ("c", 2, 41, 50)] and after <= before


def test_keys_share_the_state_rows_of_their_bucket(spark):
    folder, schema = runs.Folder.new(spark, "t-buckets"), "k string, ts timestamp"

    def drained(rows):
        stream = runs.with_event_time(land(spark, folder, rows, schema), "ts", "5 seconds")
        done = timed.sessions(stream, "k", "ts", 10, buckets=3)
        with timed.stores(spark):
            run = runs.drain(folder.append_to(done))
        return folder.read(done), run.lastProgress["stateOperators"][0]["numRowsTotal"]

    rows = [(f"key {k}", at(20 * n + k % 7)) for k in range(200) for n in range(3)]
    out, kept = drained(rows)
    assert kept <= 3 * 4  # spans, time of the timer, the timer by key and by time
    out, kept = drained([("end", at(1000))])
    found = sorted((r.k, r.n, seconds(r.start_ts), seconds(r.end_ts)) for r in out.collect())
    assert found == sorted((f"key {k}", 1, 20 * n + k % 7, 20 * n + k % 7) for k in range(200) for n in range(3))


def test_spans_nearer_than_the_gap_become_one():
    rng = random.Random(5)
    for _ in range(50):
        spans = [(rng.choice("abc"), t, t + rng.randrange(9), 1) for t in (rng.randrange(100) for _ in range(rng.randrange(1, 30)))]
        want = []
        for k, first, last, n in sorted(spans):
            if want and want[-1][0] == k and first - want[-1][2] < 4:
                want[-1] = (k, want[-1][1], max(want[-1][2], last), want[-1][3] + n)
            else:
                want.append((k, first, last, n))
        got = timed.spans_of(pd.DataFrame(spans, columns=["k", "first", "last", "n"]), "k", 4)
        assert sorted(got.itertuples(index=False, name=None)) == want


def order_rows():
    """Rows (channel, second, id, is it a reply) with early, late, missing and surplus replies."""
    rng, rows = random.Random(3), []
    for channel in ("x", "y", "z"):
        ids = iter(range(1, 400))
        for _ in range(40):
            rows.append((channel, rng.randrange(600), next(ids), rng.random() < 0.5))
    return rows + [("only asked", 5, 1, False), ("only told", 6, 1, True)]


def brute_in_order(rows, timeout):
    out = []
    for channel in {r[0] for r in rows}:
        sides = [sorted((s, i) for c, s, i, told in rows if c == channel and told == kind) for kind in (False, True)]
        for n, (s, i) in enumerate(sides[0]):
            reply = sides[1][n] if n < len(sides[1]) else None
            ok = reply is not None and 0 <= reply[0] - s <= timeout
            out.append((channel, n, i, reply[1] if ok else None, "answered" if ok else "timeout"))
    return sorted(out)


def test_replies_by_order(spark, heavy):
    rows = order_rows()
    side = lambda kind, names: spark.createDataFrame([(c, at(s), i) for c, s, i, told in rows if told == kind], names)
    got = joins.match_in_order(
        side(False, "channel string, q_ts timestamp, q_id long"), side(True, "channel string, r_ts timestamp, r_id long"),
        "channel", ["q_ts", "q_id"], ["r_ts", "r_id"], 60,
    )
    found = sorted((r.channel, r.n, r.q_id, r.r_id, r.outcome) for r in got.collect())
    assert found == brute_in_order(rows, 60)
    assert {"answered", "timeout"} == {r[-1] for r in found}
    assert got.where("outcome = 'timeout' and r_ts is not null").count() == 0


def test_replies_by_order_on_a_stream(spark):
    rows = order_rows()
    folder, schema = runs.Folder.new(spark, "t-order"), "channel string, ts timestamp, id long, told boolean"
    rng, sizes = random.Random(4), []
    arriving = sorted(rows, key=lambda r: r[1] + rng.randrange(100))
    pieces = [arriving[n : n + 31] for n in range(0, len(arriving), 31)] + [[("end", 10_000, 1, True)]]
    for piece in pieces:
        stream = runs.with_event_time(land(spark, folder, [(c, at(s), i, t) for c, s, i, t in piece], schema), "ts", "100 seconds")
        done = timed.match_in_order(stream, "channel", "ts", "id", "told", 60)
        with timed.stores(spark):
            runs.drain(folder.append_to(done))
        sizes.append(folder.read(done).count())
    found = sorted((r.channel, r.n, r.request_id, r.reply_id, r.outcome) for r in folder.read(done).collect())
    assert found == brute_in_order(rows, 60)
    assert 0 < sizes[-3] < sizes[-1]


def test_channels_share_the_state_rows_of_their_bucket(spark):
    folder, schema = runs.Folder.new(spark, "t-channels"), "channel string, ts timestamp, id long, told boolean"
    rows = [(f"c{n % 50}", at(n), n, n >= 50) for n in range(100)]
    stream = runs.with_event_time(land(spark, folder, rows, schema), "ts", "200 seconds")
    with timed.stores(spark):
        run = runs.drain(folder.append_to(timed.match_in_order(stream, "channel", "ts", "id", "told", 60, buckets=2)))
    assert 0 < run.lastProgress["stateOperators"][0]["numRowsTotal"] < 50


def test_a_reader_sees_a_batch_whole_or_not_at_all(spark):
    store = Published(spark, work_dir(spark, "t-published"))
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id int")
    seen = lambda: sorted(r.id for r in store.read("rows", "id int").collect())
    assert seen() == []
    folder = store.stage({"rows": rows(1, 2)}, batch_key(0))
    early = store.read("rows", "id int")  # started between writing and publishing
    assert seen() == []
    assert store.publish(batch_key(0), folder)
    assert early.count() == 0 and seen() == [1, 2]
    store.add({"rows": rows(1, 2)}, batch_key(0))  # the batch once more
    assert not store.publish(batch_key(0), store.stage({"rows": rows(7)}, batch_key(0)))
    store.add({"rows": rows(3)}, batch_key(1))
    assert seen() == [1, 2, 3] and store.keys() == [batch_key(0), batch_key(1)]


def test_small_files_are_put_once(spark):
    path = work_dir(spark, "t-files")
    assert names_in(spark, path) == []
    assert put_file(spark, f"{path}/a", "one\ntwo") and not put_file(spark, f"{path}/a", "three")
    assert get_file(spark, f"{path}/a") == "one\ntwo" and names_in(spark, path) == ["a"]


def test_nacked_messages_come_back_and_die_in_the_end(spark):
    folder, schema = runs.Folder.new(spark, "t-nack"), "id int"
    rule = "CASE WHEN id = 3 THEN false WHEN id = 4 THEN CAST(null AS BOOLEAN) WHEN id % 2 = 0 THEN attempt > 1 ELSE true END"
    seen = []

    def accept(messages):
        seen.append(sorted((r.id, r.attempt) for r in messages.collect()))
        return messages.withColumn("ok", F.expr(rule))

    stream = land(spark, folder, [(i,) for i in range(1, 5)], schema)
    queue = Redelivery(folder, spark.createDataFrame([], schema).schema, accept, most=3)
    runs.drain(queue.writer(stream))
    runs.drain(queue.writer(land(spark, folder, [(i,) for i in (11, 12)], schema)))
    assert seen == [[(1, 1), (2, 1), (3, 1), (4, 1)], [(2, 2), (3, 2), (4, 2), (11, 1), (12, 1)]]
    assert queue.settle() == 1 and seen[2] == [(3, 3), (4, 3), (12, 2)]
    assert queue.settle() == 0
    # what settled between two batches is not delivered again by the next one
    runs.drain(queue.writer(land(spark, folder, [(21,)], schema)))
    assert seen[3:] == [[(21, 1)]]
    assert sorted((r.id, r.attempt) for r in queue.acked().collect()) == [(1, 1), (2, 2), (11, 1), (12, 2), (21, 1)]
    assert sorted((r.id, r.attempt) for r in queue.dead().collect()) == [(3, 3), (4, 3)]
    assert queue.deliveries().count() == 4 + 5 + 3 + 1


def test_an_answer_that_changes_is_asked_for_once(spark):
    folder, schema = runs.Folder.new(spark, "t-random"), "id int"
    queue = Redelivery(folder, spark.createDataFrame([], schema).schema, lambda m: m.withColumn("ok", F.rand() < 0.5), most=50)
    runs.drain(queue.writer(land(spark, folder, [(i,) for i in range(100)], schema)))
    assert queue.settle() > 1
    rows = queue.deliveries().groupBy("id").agg(
        F.max("attempt").alias("last"), F.count("*").alias("n"), F.sum(F.expr("int(state = 'acked')")).alias("acked")
    ).collect()
    assert len(rows) == 100 and all(r.n == r.last and r.acked == 1 for r in rows)


def test_a_failed_batch_is_not_delivered_twice(spark):
    folder, schema, failed = runs.Folder.new(spark, "t-fails"), "id int", []
    queue = Redelivery(folder, spark.createDataFrame([], schema).schema, lambda m: m.withColumn("ok", F.col("id") > 1), most=2)

    stream = land(spark, folder, [(1,), (2,)], schema)
    deliver = queue.step

    def step(batch, batch_id):
        deliver(batch, batch_id)
        if not failed:
            failed.append(batch_id)
            raise RuntimeError("after publishing")

    writer = stream.writeStream.option("checkpointLocation", folder.checkpoint).foreachBatch(step)
    with pytest.raises(StreamingQueryException):
        runs.drain(writer)
    runs.drain(writer)
    assert sorted((r.id, r.attempt, r.state) for r in queue.deliveries().collect()) == [(1, 1, "nacked"), (2, 1, "acked")]


def test_live_counts_are_read_from_the_state(spark):
    folder = runs.Folder.new(spark, "t-live")
    counts = stateful.LiveCounts(folder, "w")
    for words, want in ((["a", "b", "a"], {"a": 2, "b": 1}), (["a", None], {"a": 3, "b": 1, None: 1})):
        runs.drain(counts.writer(land(spark, folder, [(w,) for w in words], "w string")))
        assert {r.w: r.n for r in counts.current().collect()} == want
    assert names_in(spark, folder.output) == []
