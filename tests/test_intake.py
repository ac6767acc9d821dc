"""Marks of keys in buckets, files that are claimed and moved, logs in shards."""

import datetime as dt
import random

import pytest
from pyspark.errors import StreamingQueryException

from millrace.runtime import files_below, work_dir
from millrace.sources.intake import Intake
from millrace.sources.shards import append_to_shards, read_shards
from millrace.streaming import runs
from millrace.streaming.marks import KeyMarks

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
MARKED = "k string, n int, ts timestamp"


def at(seconds):
    return None if seconds is None else T0 + dt.timedelta(seconds=seconds)


def land(spark, folder, rows):
    path = folder.landing("in")
    rows = [(k, n, at(t)) for k, n, t in rows]
    spark.createDataFrame(rows, MARKED).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(MARKED).parquet(path)


def late(folder):
    return {r.n: r.late for r in runs.read_batches(folder, "n int, late boolean").collect()}


def brute(rows, delay):
    tops, found = {}, {}
    for k, n, t in rows:
        top = max([v for v in (tops.get(k), t) if v is not None], default=None)
        found[n], tops[k] = t is not None and t < top - delay, top
    return found


@pytest.mark.parametrize("path", ["plain", "heavy"])
def test_marks_go_on_over_batches(spark, request, path):
    if path == "heavy":
        request.getfixturevalue("heavy")
    chance = random.Random(5)
    rows = [
        (chance.choice(["a", "b", "c", None, "hot", "hot", "hot"]), n, chance.choice([None, *[n * 3 - chance.randrange(90) for _ in range(9)]]))
        for n in range(120)
    ]
    folder = runs.Folder.new(spark, "t-marks")
    rule = KeyMarks(folder, ["k"], ["n"], "ts", 20, 1000, buckets=3)
    for first in range(0, 120, 30):
        runs.drain(rule.writer(land(spark, folder, rows[first : first + 30])))
    want = brute(rows, 20)
    assert late(folder) == want and 10 < sum(want.values()) < 110


def test_untouched_buckets_keep_their_files(spark):
    folder = runs.Folder.new(spark, "t-buckets")
    rule = KeyMarks(folder, ["k"], ["n"], "ts", 5, 1000, buckets=16)
    keys = [f"k{i}" for i in range(12)]
    runs.drain(rule.writer(land(spark, folder, [(k, i, 100) for i, k in enumerate(keys)])))
    first = dict(rule.last().buckets)
    assert len(first) > 4
    for i in range(1, 5):
        runs.drain(rule.writer(land(spark, folder, [("k0", 100 + i, 100 + i)])))
        now = dict(rule.last().buckets)
        changed = {b for b in first if now[b] != first[b]}
        assert len(changed) == 1 and set(now) == set(first)
    # folders that no later version names are gone: one bucket was written five times
    files = [f for f in files_below(spark, f"{folder.path}/marks") if f.endswith(".parquet")]
    assert len({f.rsplit("/", 1)[0] for f in files}) == len(first) - 1 + 2
    assert len(files_below(spark, f"{folder.path}/versions")) <= 6  # two versions, with their checksums


def test_marks_are_given_up(spark):
    folder = runs.Folder.new(spark, "t-forget")
    rule = KeyMarks(folder, ["k"], ["n"], "ts", 5, 50, buckets=8)
    kept = []
    for i in range(6):
        stream = land(spark, folder, [(f"k{i}_{j}", i * 10 + j, i * 40 + j) for j in range(4)])
        runs.drain(rule.writer(stream))
        kept.append(rule.marks(stream.select("k", "ts"), rule.last()).count())
    # of 24 keys seen: those of the last two batches, and of the one before where their bucket holds
    # one of these and was not touched since
    assert max(kept) <= 12 and kept[-1] <= 12
    # the mark of k0_0 is gone; older than any mark kept by more than the delay is late all the same
    runs.drain(rule.writer(land(spark, folder, [("k0_0", 90, 0), ("new", 91, 1), ("new", 92, 200), ("k5_3", 93, 190)])))
    found = late(folder)
    assert [found[n] for n in (90, 91, 92, 93)] == [True, True, False, True]


def test_a_repeated_batch_starts_from_the_same_marks(spark):
    folder, failing = runs.Folder.new(spark, "t-repeat"), [True]
    rule = KeyMarks(folder, ["k"], ["n"], "ts", 5, 1000, buckets=2)
    runs.drain(rule.writer(land(spark, folder, [("a", 0, 100), ("b", 1, 10)])))

    class Breaks(KeyMarks):
        def _forget(self, batch_id, before):
            if failing.pop() if failing else False:
                raise ValueError("after the version was put in place")

    broken = Breaks(folder, ["k"], ["n"], "ts", 5, 1000, buckets=2)
    stream = land(spark, folder, [("a", 2, 98), ("a", 3, 200), ("a", 4, 99), ("b", 5, 9)])
    with pytest.raises(StreamingQueryException):
        runs.drain(broken.writer(stream))
    runs.drain(rule.writer(stream))
    assert late(folder) == {0: False, 1: False, 2: False, 3: False, 4: True, 5: False}


def test_a_file_delivered_twice_is_read_twice_and_kept_once(spark, tmp_path):
    folder, upload = runs.Folder.new(spark, "t-intake"), tmp_path / "upload"
    intake = Intake(spark, str(upload), str(tmp_path / "done"), "*.txt")

    def put(name, content):
        path = upload / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)

    def run():
        n = intake.run(folder.append_to)
        return n, sorted((r.file, r.line) for r in folder.read(intake.lines()).collect())

    assert intake.run(folder.append_to) == 0  # no folder yet
    put("a b+%.txt", "old\nlines\n")
    put("sub/c.txt", "one")
    put("sub/c.log", "not asked for")
    put("empty.txt", "")
    first = [("a b+%.txt", "lines"), ("a b+%.txt", "old"), ("sub/c.txt", "one")]
    assert run() == (3, first)
    assert run() == (0, first)
    put("a b+%.txt", "new")
    assert run() == (1, sorted([*first, ("a b+%.txt", "new")]))
    done = {str(p.relative_to(tmp_path / "done")): p.read_text() for p in (tmp_path / "done").rglob("*.txt")}
    assert done == {"a b+%.txt": "new", "sub/c.txt": "one", "empty.txt": ""}
    assert [p.name for p in upload.rglob("*") if p.is_file() and not p.name.endswith(".crc")] == ["c.log"]


def test_claimed_files_survive_a_failure(spark, tmp_path):
    folder, upload, failing = runs.Folder.new(spark, "t-claims"), tmp_path / "up", [True]
    intake = Intake(spark, str(upload), str(tmp_path / "done"), flat=True)
    upload.mkdir()
    (upload / "x").write_text("first")

    def writer(lines):
        def write(batch, batch_id):
            if failing.pop() if failing else False:
                raise ValueError("once")
            batch.write.mode("overwrite").parquet(f"{folder.output}/batch_id={batch_id}")

        return lines.writeStream.option("checkpointLocation", folder.checkpoint).foreachBatch(write)

    with pytest.raises(StreamingQueryException):
        intake.run(writer)
    assert not (tmp_path / "done").exists()
    (upload / "deep").mkdir()
    (upload / "deep" / "x").write_text("second")
    assert intake.run(writer) == 1
    got = spark.read.parquet(folder.output).collect()
    assert sorted((r.file, r.line) for r in got) == [("deep/x", "second"), ("x", "first")]
    assert (tmp_path / "done" / "x").read_text() == "second"  # flat: the later claim replaced it


def test_shards_have_offsets_of_their_own(spark):
    log, folder = work_dir(spark, "t-shards"), runs.Folder.new(spark, "t-shards")
    rows = spark.range(1000).selectExpr("id", "CASE WHEN id % 10 < 7 THEN 0 ELSE id % 3 END AS shard")
    append_to_shards(rows.where("id < 800"), log, "shard", "id", 100)
    stream, stop_at = read_shards(spark, log, "id bigint", [0, 1, 2]), [2]

    def write(batch, batch_id):
        if stop_at and batch_id == stop_at[0]:
            stop_at.pop()
            raise ValueError("stopped")
        batch.write.mode("overwrite").parquet(f"{folder.output}/batch_id={batch_id}")

    def drained():
        query = stream.writeStream.option("checkpointLocation", folder.checkpoint).foreachBatch(write)
        return [p for p in runs.drain(query).recentProgress if p["numInputRows"]]

    with pytest.raises(StreamingQueryException):
        drained()
    before = spark.read.parquet(folder.output).count()
    assert 0 < before <= 600
    steps = drained()
    for p in steps:
        assert len(p["sources"]) == 3 and all(s["numInputRows"] <= 100 for s in p["sources"])
    assert len(steps) >= 4 and before + sum(p["numInputRows"] for p in steps) == 800
    append_to_shards(rows.where("id >= 800"), log, "shard", "id", 100)
    assert sum(p["numInputRows"] for p in drained()) == 200
    got = spark.read.parquet(folder.output)
    assert got.count() == got.select("id").distinct().count() == 1000
    want = {r.shard: r["count"] for r in rows.groupBy("shard").count().collect()}
    assert {r.shard: r["count"] for r in got.groupBy("shard").count().collect()} == want
