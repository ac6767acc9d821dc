"""Registered queries: streams that forget what they no longer need.

Events land in slices of their arrival, which is up to ``DISORDER`` hours after their time; that is
the delay of the watermark, known beforehand.  Windows, sessions and ids are given up while the
stream goes on; the mark of the end brings out only what the last hours have left open.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import joins
from millrace.plans.common import events
from millrace.plans.registry import query
from millrace.plans.streams import KEYED, SLIDING, TUMBLING, TYPED
from millrace.sources.intake import Intake
from millrace.sources.shards import append_to_shards, read_shards
from millrace.sources.tables import table, table_stream
from millrace.streaming import runs, stateful, timed, windows
from millrace.streaming.marks import KeyMarks
from millrace.streaming.published import Published, batch_key
from millrace.streaming.redelivery import Redelivery

DISORDER = 12
SLICES = 5


@dataclass(frozen=True)
class Seen:
    """After a landing was drained: rows that had come out, and rows of state kept."""

    rows_out: int
    state_rows: int


def _hours(name: str, most: int):
    """A delay of its own for every event, up to ``most`` hours, in seconds."""
    return F.pmod(F.xxhash64("event_id", F.lit(name)), F.lit(most * 3600))


def arrivals(rows: DataFrame, late: str = "once", most: int = DISORDER) -> DataFrame:
    return rows.withColumn("arrival", F.unix_seconds(F.col("ts").cast("timestamp")) + _hours(late, most))


def in_slices(rows: DataFrame, folder: runs.Folder, drained: Callable[[DataFrame], object], slices: int = SLICES) -> DataFrame:
    """Land ``rows`` in slices of equal length by ``arrival``, drain each, and give back the stream."""
    spark, landing = rows.sparkSession, folder.landing("slices")
    first, last = rows.agg(F.min("arrival"), F.max("arrival")).first()
    first, length = first or 0, ((last or 0) - (first or 0)) // slices + 1
    for n in range(slices):
        piece = rows.where(F.floor((F.col("arrival") - first) / length) == n)
        piece.drop("arrival").write.mode("append").parquet(landing)
        stream = spark.readStream.schema(piece.drop("arrival").schema).parquet(landing)
        drained(stream)
    return stream


def until_the_end(rows: DataFrame, folder: runs.Folder, schema: str, build, log: list[Seen] | None = None, seen=None) -> DataFrame:
    """Drain slice by slice, then mark the end; ``log`` gets what was to see after every slice."""
    spark = rows.sparkSession
    marks = runs.end_marks(spark, folder, schema)
    columns = [c.split(" ")[0] for c in schema.split(", ")]

    def result(stream):
        return build(stream.withColumn("ts", F.col("ts").cast("timestamp")).select(*columns).unionByName(marks))

    def drained(stream):
        done = result(stream)
        run = runs.drain(folder.append_to(done))
        if log is not None:
            state = run.lastProgress["stateOperators"]
            log.append(Seen(folder.read(done).count(), sum(s["numRowsTotal"] for s in state)))

    stream = in_slices(rows, folder, drained)
    runs.mark_end(spark, folder, schema, "ts")
    done = result(stream)
    runs.drain(folder.append_to(done))
    return folder.read(done)


def delayed(rows: DataFrame, hours: int = DISORDER) -> DataFrame:
    return runs.with_event_time(rows, "ts", f"{hours} hours")


def _ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def closed_windows(spark, sf_dir, step, log=None):
    counts = lambda rows: windows.event_windows(delayed(rows), "event_type", "ts", 3600, step)
    done = until_the_end(arrivals(events(spark, sf_dir)), runs.Folder.new(spark, "closed"), TYPED, counts, log)
    return _ntz(done.where(F.col("event_type").isNotNull()), "start", "end")


@query("tumbling_closed_stream", TUMBLING)
def tumbling_closed_stream(spark, sf_dir):
    return closed_windows(spark, sf_dir, None)


@query("sliding_closed_stream", SLIDING)
def sliding_closed_stream(spark, sf_dir):
    return closed_windows(spark, sf_dir, 900)


SESSIONS = """
    SELECT user_id, count(*) AS n, min(ts) AS start_ts, max(ts) AS end_ts FROM (
      SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)
                            >= INTERVAL {gap} THEN 1 ELSE 0 END AS cut FROM events))
    GROUP BY user_id, s
"""


def closed_sessions(spark, sf_dir, find, log=None):
    rows = arrivals(events(spark, sf_dir))
    done = until_the_end(rows, runs.Folder.new(spark, "closed"), KEYED, lambda r: find(delayed(r)), log)
    return _ntz(done.where(F.col("user_id").isNotNull()), "start_ts", "end_ts")


@query("sessions_closed_stream", SESSIONS.format(gap="30 MINUTE"))
def sessions_closed_stream(spark, sf_dir):
    return closed_sessions(spark, sf_dir, lambda rows: windows.sessions(rows, "user_id", "ts", 1800))


def timed_sessions(spark, sf_dir, log=None):
    with timed.stores(spark):
        return closed_sessions(spark, sf_dir, lambda rows: timed.sessions(rows, "user_id", "ts", 6 * 3600), log)


@query("sessions_by_timer_stream", SESSIONS.format(gap="6 HOUR"))
def sessions_by_timer_stream(spark, sf_dir):
    return timed_sessions(spark, sf_dir)


def delivered_twice(spark, sf_dir, log=None):
    # the copy of an event comes up to six hours after it, or before it
    rows = events(spark, sf_dir).select("event_id", "user_id", "event_type", "ts")
    both = arrivals(rows).unionByName(arrivals(rows, "again", DISORDER + 6))
    folder = runs.Folder.new(spark, "twice")

    def once(stream):
        return windows.dedupe_within(delayed(stream, DISORDER + 6), "event_id").drop("ts")

    def drained(stream):
        run = runs.drain(folder.append_to(once(stream.withColumn("ts", F.col("ts").cast("timestamp")))))
        if log is not None:
            state = run.lastProgress["stateOperators"]
            log.append(Seen(folder.read(once(stream)).count(), sum(s["numRowsTotal"] for s in state)))

    return folder.read(once(in_slices(both, folder, drained)))


@query("dedupe_closed_stream", "SELECT event_id, user_id, event_type FROM events")
def dedupe_closed_stream(spark, sf_dir):
    return delivered_twice(spark, sf_dir)


@query(
    "redelivered_stream",
    """
    SELECT event_id, event_type,
           CASE WHEN event_id % 35 = 0 THEN 4 WHEN event_id % 7 = 0 THEN 2 ELSE 1 END AS attempts,
           CASE WHEN event_id % 35 = 0 THEN 'dead' ELSE 'acked' END AS state
    FROM events
    """,
)
def redelivered_stream(spark, sf_dir):
    # every seventh event is refused once, every thirty-fifth always
    ledger = refused(spark, sf_dir)
    ends = ledger.deliveries().where("state <> 'nacked'")
    return ends.select("event_id", "event_type", F.col("attempt").alias("attempts"), "state")


@query(
    "delivery_attempts_stream",
    """
    SELECT event_id, CAST(attempt AS INTEGER) AS attempt,
           CASE WHEN attempt < CASE WHEN event_id % 35 = 0 THEN 4 ELSE 2 END THEN 'nacked'
                WHEN event_id % 35 = 0 THEN 'dead' ELSE 'acked' END AS state
    FROM events, (SELECT unnest(range(1, 5)) AS attempt)
    WHERE event_id % 7 = 0 AND attempt <= CASE WHEN event_id % 35 = 0 THEN 4 ELSE 2 END
    """,
)
def delivery_attempts_stream(spark, sf_dir):
    ledger = refused(spark, sf_dir)
    return ledger.deliveries().where("event_id % 7 = 0").select("event_id", "attempt", "state")


def refused(spark, sf_dir) -> Redelivery:
    rows = events(spark, sf_dir).select("event_id", "event_type", "ts")
    accept = lambda m: m.withColumn("ok", F.expr("event_id % 7 <> 0 OR (event_id % 35 <> 0 AND attempt > 1)"))
    folder = runs.Folder.new(spark, "redelivered")
    ledger = Redelivery(folder, rows.schema, accept, most=4)
    in_slices(arrivals(rows), folder, lambda stream: runs.drain(ledger.writer(stream)))
    ledger.settle()
    return ledger


@query(
    "committed_copy",
    "SELECT event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY event_type",
)
def committed_copy(spark, sf_dir):
    # beside the published batches lies one that was written and never published
    folder = runs.Folder.new(spark, "copy")
    rows = events(spark, sf_dir).select("event_id", "event_type", "ts")
    copy = Published(spark, folder.output)
    in_slices(arrivals(rows), folder, lambda stream: runs.drain(copy.writer(stream.drop("ts"), folder.checkpoint)), 3)
    copy.stage({"rows": rows.drop("ts").withColumn("event_id", F.col("event_id") + 10**9)}, batch_key(999))
    read = copy.read("rows", "event_id BIGINT, event_type STRING")
    return read.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")
    )


_WORDS = r"""
    SELECT word, count(*) AS n
    FROM (SELECT unnest(regexp_split_to_array(lower(text), '\W+')) AS word FROM documents)
    WHERE word <> '' GROUP BY word
"""


@query("live_word_count_stream", _WORDS)
def live_word_count_stream(spark, sf_dir):
    # the totals are read from the state of the stream; it writes nothing else
    docs = table_stream(spark, sf_dir, "documents")
    words = docs.select(F.explode(text.words("text")).alias("word"))
    counts = stateful.LiveCounts(runs.Folder.new(spark, "live"), "word")
    runs.drain(counts.writer(words))
    return counts.current()


# odd events answer the even ones of their user, in order
_IN_ORDER = """
    WITH q AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n
               FROM events WHERE event_id % 2 = 0),
         r AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n
               FROM events WHERE event_id % 2 = 1)
    SELECT user_id, n, q.event_id AS request_id,
           CASE WHEN r.ts BETWEEN q.ts AND q.ts + INTERVAL 2 DAY THEN r.event_id END AS reply_id,
           CASE WHEN r.ts BETWEEN q.ts AND q.ts + INTERVAL 2 DAY THEN 'answered' ELSE 'timeout' END AS outcome
    FROM q LEFT JOIN r USING (user_id, n)
"""


@query("replies_in_order", _IN_ORDER)
def replies_in_order(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_id", "ts")
    asked = rows.where("event_id % 2 = 0").toDF("user_id", "request_id", "request_ts")
    told = rows.where("event_id % 2 = 1").toDF("user_id", "reply_id", "reply_ts")
    matched = joins.match_in_order(
        asked, told, "user_id", ["request_ts", "request_id"], ["reply_ts", "reply_id"], 2 * 86_400
    )
    return matched.select("user_id", "n", "request_id", "reply_id", "outcome")


def ordered_replies(spark, sf_dir, log=None):
    rows = arrivals(events(spark, sf_dir))
    folder, schema = runs.Folder.new(spark, "in-order"), "user_id BIGINT, event_id BIGINT, ts TIMESTAMP"
    found = lambda r: timed.match_in_order(
        delayed(r).withColumn("told", F.col("event_id") % 2 == 1), "user_id", "ts", "event_id", "told", 2 * 86_400
    )
    with timed.stores(spark):
        return until_the_end(rows, folder, schema, found, log).where(F.col("request_id").isNotNull())


@query("replies_in_order_stream", _IN_ORDER)
def replies_in_order_stream(spark, sf_dir):
    return ordered_replies(spark, sf_dir).where(F.col("user_id").isNotNull())


@query(
    "late_by_user_stream",
    """
    SELECT event_id, user_id, coalesce(ts < top - INTERVAL 2 HOUR, FALSE) AS late FROM (
      SELECT *, max(ts) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT
             + ('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT % 43200, event_id) AS top FROM events)
    """,
)
def late_by_user_stream(spark, sf_dir):
    # no event comes more than 12 hours after a newer one, so marks older than that are given up
    wait = F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 8), 16, 10).cast("bigint")
    came = F.unix_seconds(F.col("ts").cast("timestamp")) + wait % (DISORDER * 3600)
    rows = events(spark, sf_dir).select("event_id", "user_id", "ts", came.alias("arrival"), came.alias("came"))
    folder = runs.Folder.new(spark, "marks")
    rule = KeyMarks(folder, ["user_id"], ["came", "event_id"], "ts", 2 * 3600, DISORDER * 3600, buckets=8)
    in_slices(rows, folder, lambda stream: runs.drain(rule.writer(stream)))
    return runs.read_batches(folder, "event_id BIGINT, user_id BIGINT, late BOOLEAN").drop("batch_id")


@query(
    "shard_log_stream",
    """
    SELECT user_id % 4 AS shard, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id
    FROM events WHERE user_id IS NOT NULL GROUP BY ALL
    """,
)
def shard_log_stream(spark, sf_dir):
    # odd events first; the even ones are appended to the same shards and read on from there
    folder = runs.Folder.new(spark, "shard-log")
    rows = events(spark, sf_dir).select("event_id", "ts", (F.col("user_id") % 4).alias("of"))
    for delivered in (1, 0):
        log = folder.landing("log")
        append_to_shards(rows.where(F.col("event_id") % 2 == delivered), log, "of", "event_id", 5_000)
        stream = read_shards(spark, log, "event_id BIGINT, ts TIMESTAMP_NTZ", [0, 1, 2, 3], files=2)
        runs.drain(folder.append_to(stream))
    return folder.read(stream).groupBy(F.col("shard").cast("bigint").alias("shard")).agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")
    )


@query(
    "intake_moved",
    "SELECT lang, source, count(*) AS n_read, count(*) AS n_moved FROM documents GROUP BY lang, source",
)
def intake_moved(spark, sf_dir):
    # two deliveries; rows are counted as they were read and in the folder of processed files
    folder = runs.Folder.new(spark, "intake")
    line = F.concat_ws(",", F.col("doc_id").cast("string"), "lang", "source").alias("line")
    docs = table(spark, sf_dir, "documents").select("lang", "source", line)
    intake = Intake(spark, folder.landing("upload"), f"{folder.path}/processed", "*.txt")
    for part in (0, 1):
        half = docs.where(F.pmod(F.xxhash64("line"), F.lit(2)) == part)
        half.write.mode("append").partitionBy("lang", "source").text(intake.upload)
        intake.run(folder.append_to)
    moved = spark.read.option("recursiveFileLookup", True).text(intake.processed).toDF("line")
    rows = folder.read(intake.lines()).select("line", F.lit(1).alias("read")).unionByName(moved.withColumn("read", F.lit(0)))
    fields = F.split("line", ",")
    return rows.groupBy(fields[1].alias("lang"), fields[2].alias("source")).agg(
        F.sum("read").alias("n_read"), F.sum(1 - F.col("read")).alias("n_moved")
    )
