"""Registered queries: streaming forms, run to the end of their input.

Each reads the given tables as a stream (or lands them in pieces), and gives the rows of
its batch form.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import latest
from millrace.plans.common import events
from millrace.plans.registry import query
from millrace.sources import connectors
from millrace.sources.index import BucketedIndex
from millrace.sources.tables import SCHEMAS, table, table_stream
from millrace.streaming import runs, sinks, stateful, windows

KEYED = "user_id BIGINT, ts TIMESTAMP"
TYPED = "event_type STRING, ts TIMESTAMP"


def counted():
    return F.count(F.lit(1)).alias("n")


def _ntz(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def _land_by_arrival(spark, sf_dir, folder, writer_of):
    """Events in three landings by arrival order, each drained before the next one lands.

    Arrival has nothing to do with event time.  Gives back the stream of all landings.
    """
    rows = events(spark, sf_dir).withColumn("arrival", F.md5(F.col("event_id").cast("string")))
    landing = folder.landing("arrivals")
    for first, last in (("0", "5"), ("5", "b"), ("b", "g")):
        piece = rows.where((F.col("arrival") >= first) & (F.col("arrival") < last))
        piece.write.mode("append").parquet(landing)
        stream = spark.readStream.schema(rows.schema).parquet(landing)
        runs.drain(writer_of(stream))
    return stream


def _disorder(spark, sf_dir):
    """A delay that no row exceeds, in whatever order the rows come."""
    first, last = events(spark, sf_dir).agg(
        F.unix_seconds(F.min("ts").cast("timestamp")), F.unix_seconds(F.max("ts").cast("timestamp"))
    ).first()
    return f"{(last or 0) - (first or 0) + 2} seconds"


def _to_the_end(spark, sf_dir, folder, schema, build):
    """Drain the landings one by one, mark the end, and drain what was still open."""
    marks = runs.end_marks(spark, folder, schema)
    columns = [c.split(" ")[0] for c in schema.split(", ")]

    def result(rows):
        kept = rows.withColumn("ts", F.col("ts").cast("timestamp")).select(*columns)
        return build(kept.unionByName(marks))

    stream = _land_by_arrival(spark, sf_dir, folder, lambda rows: folder.append_to(result(rows)))
    runs.mark_end(spark, folder, schema, "ts")
    done = result(stream)
    runs.drain(folder.append_to(done))
    return folder.read(done)


@query(
    "word_count_stream",
    r"""
    SELECT word, count(*) AS n
    FROM (SELECT unnest(regexp_split_to_array(lower(text), '\W+')) AS word FROM documents)
    WHERE word <> '' GROUP BY word
    """,
)
def word_count_stream(spark, sf_dir):
    docs = table_stream(spark, sf_dir, "documents")
    words = docs.select(F.explode(text.words("text")).alias("word"))
    counts = stateful.RunningCounts(runs.Folder.new(spark, "word-count"), "word")
    runs.drain(counts.writer(words))
    return counts.current()


_WINDOWS = """
    SELECT event_type, start, start + INTERVAL {length} MINUTE AS "end", count(*) AS n,
           count(DISTINCT ts) AS n_times
    FROM (SELECT event_type, ts, unnest(generate_series(
            time_bucket(INTERVAL {step} MINUTE, ts, TIMESTAMP '1970-01-01') - INTERVAL {back} MINUTE,
            time_bucket(INTERVAL {step} MINUTE, ts, TIMESTAMP '1970-01-01'),
            INTERVAL {step} MINUTE)) AS start FROM events)
    GROUP BY event_type, start
"""
TUMBLING = _WINDOWS.format(length=60, step=60, back=0)
SLIDING = _WINDOWS.format(length=60, step=15, back=45)


@query("tumbling", TUMBLING)
def tumbling(spark, sf_dir):
    return windows.event_windows(events(spark, sf_dir), "event_type", "ts", 3600)


@query("sliding", SLIDING)
def sliding(spark, sf_dir):
    return windows.event_windows(events(spark, sf_dir), "event_type", "ts", 3600, 900)


def _window_stream(spark, sf_dir, step):
    folder = runs.Folder.new(spark, "windows")
    delay = _disorder(spark, sf_dir)

    def counts(rows):
        return windows.event_windows(runs.with_event_time(rows, "ts", delay), "event_type", "ts", 3600, step)

    done = _to_the_end(spark, sf_dir, folder, TYPED, counts)
    return _ntz(done.where(F.col("event_type").isNotNull()), "start", "end")


@query("tumbling_stream", TUMBLING)
def tumbling_stream(spark, sf_dir):
    return _window_stream(spark, sf_dir, None)


@query("sliding_stream", SLIDING)
def sliding_stream(spark, sf_dir):
    return _window_stream(spark, sf_dir, 900)


@query(
    "sessions_30m_stream",
    """
    SELECT user_id, count(*) AS n, min(ts) AS start_ts, max(ts) AS end_ts FROM (
      SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)
                            >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS cut FROM events))
    GROUP BY user_id, s
    """,
)
def sessions_30m_stream(spark, sf_dir):
    folder = runs.Folder.new(spark, "sessions")
    delay = _disorder(spark, sf_dir)

    def found(rows):
        return windows.sessions(runs.with_event_time(rows, "ts", delay), "user_id", "ts", 1800)

    # a heavy user's rows are merged into sessions before the shuffle
    with runs.setting(spark, "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true"):
        done = _to_the_end(spark, sf_dir, folder, KEYED, found)
    return _ntz(done.where(F.col("user_id").isNotNull()), "start_ts", "end_ts")


_ON_TIME = """
    SELECT event_id, event_type, ts FROM (
      SELECT *, max(ts) OVER (ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) AS top FROM events)
    WHERE ts >= top - INTERVAL 10 DAY
"""


@query("late_filter_stream", _ON_TIME)
def late_filter_stream(spark, sf_dir):
    folder = runs.Folder.new(spark, "late")
    rule = stateful.late_filter(folder, [], ["arrival", "event_id"], "ts", 10 * 86_400)
    _land_by_arrival(spark, sf_dir, folder, rule.writer)
    kept = runs.read_batches(folder, SCHEMAS["events"])
    return kept.select("event_id", "event_type", "ts")


@query(
    "late_and_closed_stream",
    f"""
    SELECT event_type, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start,
           time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') + INTERVAL 1 DAY AS "end",
           count(*) AS n, count(DISTINCT ts) AS n_times
    FROM ({_ON_TIME})
    WHERE time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') + INTERVAL 1 DAY
          <= (SELECT max(ts) FROM events) - INTERVAL 10 DAY
    GROUP BY ALL
    """,
)
def late_and_closed_stream(spark, sf_dir):
    # only windows that the final mark has closed come out
    late = runs.Folder.new(spark, "late")
    rule = stateful.late_filter(late, [], ["arrival", "event_id"], "ts", 10 * 86_400)
    _land_by_arrival(spark, sf_dir, late, rule.writer)

    folder = runs.Folder.new(spark, "closed")
    on_time = (
        spark.readStream.schema(SCHEMAS["events"])
        .option("recursiveFileLookup", True)
        .parquet(late.output)
        .select("event_type", "ts")
    )
    timed = runs.with_event_time(on_time, "ts", "10 days")
    stream = windows.event_windows(timed, "event_type", "ts", 86_400)
    runs.drain(folder.append_to(stream))
    return _ntz(folder.read(stream), "start", "end")


@query(
    "union_streams",
    """
    SELECT event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id
    FROM events GROUP BY event_type
    """,
)
def union_streams(spark, sf_dir):
    folder = runs.Folder.new(spark, "union")
    rows = events(spark, sf_dir).select("event_id", "event_type")
    producers = []
    for i in range(3):
        landing = folder.landing(f"producer{i}")
        rows.where(F.col("event_id") % 3 == i).write.parquet(landing)
        producers.append(spark.readStream.schema(rows.schema).parquet(landing))
    merged = producers[0].unionByName(producers[1]).unionByName(producers[2])
    runs.drain(folder.append_to(merged))
    return folder.read(merged).groupBy("event_type").agg(
        counted(), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")
    )


@query("dedupe_stream", "SELECT event_id, user_id, event_type FROM events")
def dedupe_stream(spark, sf_dir):
    # everything is delivered in three batches, and then once more in a fourth
    folder = runs.Folder.new(spark, "dedupe")
    delay = _disorder(spark, sf_dir)

    def once(rows):
        timed = runs.with_event_time(rows.select("event_id", "user_id", "event_type", "ts"), "ts", delay)
        return windows.dedupe_within(timed, "event_id").drop("ts")

    stream = _land_by_arrival(spark, sf_dir, folder, lambda rows: folder.append_to(once(rows)))
    again = events(spark, sf_dir).withColumn("arrival", F.lit("again"))
    again.write.mode("append").parquet(folder.landing("arrivals"))
    runs.drain(folder.append_to(once(stream)))
    return folder.read(once(stream))


@query(
    "limited_intake_stream",
    "SELECT event_type, count(*) AS n, CAST(1 AS BIGINT) AS most_files FROM events GROUP BY event_type",
)
def limited_intake_stream(spark, sf_dir):
    # four files and more are waiting; each micro-batch takes one of them
    folder = runs.Folder.new(spark, "intake")
    rows = events(spark, sf_dir).select("event_id", "event_type")
    landing = folder.landing("files")
    for i in range(4):
        rows.where(F.col("event_id") % 4 == i).write.mode("append").parquet(landing)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    named = stream.select("event_type", F.col("_metadata.file_path").alias("file"))
    sizes = lambda b: b.groupBy("event_type").agg(
        counted(), F.count_distinct("file").alias("n_files")
    )
    runs.drain(runs.each_batch(named, folder, sizes))
    return runs.read_batches(folder, "event_type STRING, n BIGINT, n_files BIGINT").groupBy("event_type").agg(
        F.sum("n").alias("n"), F.max("n_files").alias("most_files")
    )


PER_TYPE = """
    SELECT event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id
    FROM events GROUP BY event_type
"""


def _per_type(kept):
    return kept.groupBy("event_type").agg(
        counted(), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")
    )


@query("restarted_stream", PER_TYPE)
def restarted_stream(spark, sf_dir):
    # every landing fails once after its rows were written; nothing is lost and nothing counts twice
    folder, failed = runs.Folder.new(spark, "restarted"), set()

    def starting(stream):
        def write(batch, batch_id):
            batch.write.mode("overwrite").parquet(f"{folder.output}/{runs.BATCH}={batch_id}")
            if batch_id not in failed:
                failed.add(batch_id)
                raise RuntimeError("lost after writing")

        writer = stream.select("event_id", "event_type").writeStream
        writer = writer.option("checkpointLocation", folder.checkpoint).foreachBatch(write)
        return lambda: writer.trigger(availableNow=True).start()

    rows = events(spark, sf_dir)
    landing = folder.landing("files")
    for i in range(2):
        rows.where(F.col("event_id") % 2 == i).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(rows.schema).parquet(landing)
        runs.run_restarting(starting(stream), least_wait=0.1, most_wait=0.2)
    return _per_type(runs.read_batches(folder, "event_id BIGINT, event_type STRING"))


@query("stopped_stream", PER_TYPE)
def stopped_stream(spark, sf_dir):
    # stopped after the first landing, started again from the checkpoint for the second
    folder = runs.Folder.new(spark, "stopped")
    rows = events(spark, sf_dir).select("event_id", "event_type")
    landing = folder.landing("files")
    rows.where("event_id % 3 = 0").write.parquet(landing)
    stream = spark.readStream.schema(rows.schema).parquet(landing)
    query = folder.append_to(stream).start()
    query.processAllAvailable()
    query.stop()
    rows.where("event_id % 3 <> 0").write.mode("append").parquet(landing)
    runs.drain(folder.append_to(stream))
    return _per_type(folder.read(stream))


@query(
    "multi_sink",
    """
    SELECT 'backup' AS sink, event_type, count(*) AS n FROM events GROUP BY event_type
    UNION ALL SELECT 'errors', event_type, count(*) FROM events WHERE event_type = 'error' GROUP BY event_type
    UNION ALL SELECT 'totals', event_type, count(*) FROM events GROUP BY event_type
    """,
)
def multi_sink(spark, sf_dir):
    folder = runs.Folder.new(spark, "multi")
    rows = table_stream(spark, sf_dir, "events").select("event_id", "event_type")
    consumers = {
        "backup": lambda b: b,
        "errors": lambda b: b.where("event_type = 'error'"),
        "totals": lambda b: b.groupBy("event_type").agg(counted()),
    }
    runs.drain(sinks.to_all(rows, folder, consumers))
    schema = "event_id BIGINT, event_type STRING"
    read = lambda name, s: spark.read.schema(s).parquet(f"{folder.output}/{name}")
    per_type = lambda df: df.groupBy("event_type").agg(counted())
    totals = read("totals", "event_type STRING, n BIGINT").groupBy("event_type").agg(
        F.sum("n").alias("n")
    )
    parts = {
        "backup": per_type(read("backup", schema)),
        "errors": per_type(read("errors", schema)),
        "totals": totals,
    }
    tagged = [df.withColumn("sink", F.lit(name)) for name, df in parts.items()]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


@query(
    "upsert_stream",
    """
    SELECT strftime(ts, '%Y-%m-%dT%H') AS doc_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts
    FROM events GROUP BY 1
    """,
)
def upsert_stream(spark, sf_dir):
    folder = runs.Folder.new(spark, "upsert")
    index = BucketedIndex(spark, folder.output, ["doc_id"], ["ts", "event_id"], buckets=8)
    shape = lambda df: df.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH").alias("doc_id"), "event_id", "ts"
    )
    _land_by_arrival(
        spark, sf_dir, folder, lambda stream: sinks.to_index(shape(stream), folder, index)
    )
    return index.read()


@query(
    "cache_hit_miss_stream",
    """
    SELECT user_id, event_id, CASE WHEN event_type = 'signup' THEN 'update'
      WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w)
           < CASE WHEN lag(event_type) OVER w = 'signup' THEN 3600000000 ELSE 1800000000 END
      THEN 'hit' ELSE 'miss' END AS outcome
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    """,
)
def cache_hit_miss_stream(spark, sf_dir):
    folder = runs.Folder.new(spark, "cache")
    rows = events(spark, sf_dir).select("user_id", "event_id", "event_type", "ts")
    landing = folder.landing("days")
    outcomes = stateful.cache_outcomes(
        folder, "user_id", ["ts", "event_id"], "ts",
        lambda: F.col("event_type") == "signup", 1800, 3600,
    )
    # the month arrives in three pieces; the last accesses go from one to the next
    for first, last in ((1, 10), (11, 20), (21, 31)):
        day = F.dayofmonth("ts")
        rows.where((day >= first) & (day <= last)).write.mode("append").parquet(landing)
        runs.drain(outcomes.writer(spark.readStream.schema(rows.schema).parquet(landing)))
    return runs.read_batches(
        folder, "user_id BIGINT, event_id BIGINT, outcome STRING"
    ).drop("batch_id")


@query(
    "keyed_fold_stream",
    """
    SELECT user_id, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id
    FROM events GROUP BY user_id
    """,
)
def keyed_fold_stream(spark, sf_dir):
    # a user fold with state: what a key has gathered comes out at the end of the input
    folder = runs.Folder.new(spark, "fold")
    schema = "user_id BIGINT, event_id BIGINT, ts TIMESTAMP"
    delay = _disorder(spark, sf_dir)

    def step(state, batch):
        n, first, last = state
        ids = batch["event_id"].array  # a key has few rows in a batch, so no frame is made of them
        ids = ids[~ids.isna()].to_numpy()
        if not len(ids):
            return state
        return n + len(ids), min(first, int(ids.min())), max(last, int(ids.max()))

    def folded(rows):
        return stateful.fold_until_idle(
            runs.with_event_time(rows, "ts", delay), "user_id", "ts", "event_id", (0, 2**62, -1),
            "n BIGINT, first_id BIGINT, last_id BIGINT", step, idle_ms=365 * 86_400_000,
        )

    partial = _to_the_end(spark, sf_dir, folder, schema, folded).where(F.col("user_id").isNotNull())
    return partial.groupBy("user_id").agg(
        F.sum("n").alias("n"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id")
    )


@query(
    "reply_match_stream",
    """
    SELECT q.event_id AS request_id, r.event_id AS reply_id FROM (
      SELECT * FROM events WHERE event_id % 2 = 0) q
    LEFT JOIN (SELECT * FROM events WHERE event_id % 2 = 1) r
    ON q.event_id // 2 = r.event_id // 2 AND r.ts >= q.ts AND r.ts <= q.ts + INTERVAL 5 MINUTE
    """,
)
def reply_match_stream(spark, sf_dir):
    # even events are requests, the odd one after each is its reply, if it came in time
    folder = runs.Folder.new(spark, "replies")
    schema = "event_id BIGINT, ts TIMESTAMP"
    delay = _disorder(spark, sf_dir)
    is_end = F.col("event_id").isNull()

    def side(rows, name, rest):
        picked = rows.where(is_end | (F.col("event_id") % 2 == rest))
        timed = runs.with_event_time(picked, "ts", delay)
        # the end marks get keys of their own: the join filters null keys before the watermark
        pair = F.coalesce(F.floor(F.col("event_id") / 2), F.lit(-1 - rest))
        return timed.select(
            pair.alias(f"{name}_pair"),
            F.col("event_id").alias(f"{name}_id"),
            F.col("ts").alias(f"{name}_ts"),
        )

    def matched(rows):
        return windows.match_replies(
            side(rows, "request", 0), side(rows, "reply", 1), "request_pair", "reply_pair",
            "request_ts", "reply_ts", "5 MINUTES",
        ).select("request_id", "reply_id")

    done = _to_the_end(spark, sf_dir, folder, schema, matched)
    return done.where(F.col("request_id").isNotNull())


@query(
    "topic_copy",
    """
    SELECT CAST(user_id AS VARCHAR) AS key, upper(event_type) AS value, event_id AS source_offset FROM events
    """,
)
def topic_copy(spark, sf_dir):
    # file tables in the topic schema stand in for the topics
    folder = runs.Folder.new(spark, "topic")
    rows = connectors.as_topic_rows(
        events(spark, sf_dir), "events", F.col("user_id"), F.col("event_type"), 4,
        F.col("event_id"), F.col("ts"),
    )
    landing = folder.landing("topic")
    for part in (0, 1):
        rows.where(F.col("offset") % 2 == part).write.mode("append").parquet(landing)
        stream = connectors.read_topic_files(spark, landing)
        upper = stream.select(
            F.col("key").cast("string").alias("key"),
            F.upper(F.col("value").cast("string")).alias("value"),
            F.col("offset").alias("source_offset"),
        )
        runs.drain(runs.each_batch(upper, folder, lambda b: b))
    return runs.read_batches(folder, "key STRING, value STRING, source_offset BIGINT").drop("batch_id")


@query(
    "shard_replay",
    """
    SELECT user_id % 4 AS shard, min(event_id) AS first_id, count(*) AS n FROM events GROUP BY ALL
    """,
)
def shard_replay(spark, sf_dir):
    # shards deliver odd events, then even ones, then some of both again; kept once each
    folder = runs.Folder.new(spark, "shards")
    rows = events(spark, sf_dir).select("event_id", (F.col("user_id") % 4).alias("shard"), "ts")
    landing = folder.landing("shards")
    delay = _disorder(spark, sf_dir)
    for delivered in ("event_id % 2 = 1", "event_id % 2 = 0", "event_id % 5 = 0"):
        rows.where(delivered).write.mode("append").partitionBy("shard").parquet(landing)
        stream = spark.readStream.schema("event_id BIGINT, ts TIMESTAMP_NTZ, shard BIGINT").parquet(landing)
        timed = runs.with_event_time(stream, "ts", delay)
        once = windows.dedupe_within(timed, ["shard", "event_id"]).drop("ts")
        runs.drain(folder.append_to(once))
    return folder.read(once).groupBy("shard").agg(F.min("event_id").alias("first_id"), counted())


@query(
    "conflate_stream",
    """
    SELECT event_type, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts
    FROM events GROUP BY event_type
    """,
)
def conflate_stream(spark, sf_dir):
    # the newest row per type of each micro-batch, then of all of them
    folder = runs.Folder.new(spark, "conflate")
    rows = table_stream(spark, sf_dir, "events").select("event_type", "event_id", "ts")
    newest = lambda df: latest.newest_per(df, "event_type", ["ts", "event_id"])
    runs.drain(runs.each_batch(rows, folder, newest))
    kept = runs.read_batches(folder, "event_type STRING, event_id BIGINT, ts TIMESTAMP_NTZ")
    return newest(kept.drop("batch_id"))


@query(
    "dir_ingest",
    "SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source",
)
def dir_ingest(spark, sf_dir):
    # nested folders by language and source; the second half lands after the first run
    folder = runs.Folder.new(spark, "ingest")
    landing = folder.landing("upload")
    docs = table(spark, sf_dir, "documents").select(
        "lang", "source", F.concat_ws(",", F.col("doc_id").cast("string"), "lang", "source").alias("value")
    )
    for part in (0, 1):
        docs.where(F.pmod(F.xxhash64("value"), F.lit(2)) == part).write.mode("append").partitionBy(
            "lang", "source"
        ).text(landing)
        lines = sinks.read_directory(spark, landing, "*.txt").where("line <> ''")
        fields = F.split("line", ",")
        parsed = lines.select(fields[0].alias("id"), fields[1].alias("lang"), fields[2].alias("source"))
        runs.drain(folder.append_to(parsed))
    return folder.read(parsed).groupBy("lang", "source").agg(counted())
