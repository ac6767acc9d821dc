"""Registered queries: sequences in event order."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text
from millrace.functions.time import micros_of
from millrace.operators import latest
from millrace.operators import ordered as o
from millrace.operators import sequence as sq
from millrace.plans.common import events, user_events
from millrace.plans.registry import query
from millrace.runtime import spread
from millrace.sources.tables import table

PER_USER = "PARTITION BY user_id ORDER BY ts, event_id"


def counted():
    return F.count(F.lit(1)).alias("n")


def _sql(body: str) -> str:
    return body.replace("{w}", PER_USER)


@query(
    "row_index",
    _sql("SELECT event_id, user_id, row_number() OVER ({w}) - 1 AS idx FROM events"),
)
def row_index(spark, sf_dir):
    return sq.row_index(user_events(spark, sf_dir)).df.drop("ts")


@query(
    "global_index",
    """
    SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS idx FROM orders
    """,
)
def global_index(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return sq.row_index(o.ordered(orders, (), ["o_orderdate", "o_orderkey"])).df.drop("o_orderdate")


@query(
    "sliding_pairs",
    _sql(
        """
        SELECT user_id, event_id, event_type || '>' || nxt AS step FROM (
          SELECT user_id, event_id, event_type, lead(event_type) OVER ({w}) AS nxt FROM events)
        WHERE nxt IS NOT NULL
        """
    ),
)
def sliding_pairs(spark, sf_dir):
    # users with a single event give a short window, which is no pair
    windows = sq.sliding(user_events(spark, sf_dir, "event_type"), "event_type", 2)
    return windows.where(F.size("win") == 2).select(
        "user_id", "event_id", F.array_join("win", ">").alias("step")
    )


@query(
    "sliding_mean",
    _sql(
        """
        SELECT user_id, event_id, round((a + b + c + d) / 4, 4) AS mean FROM (
          SELECT user_id, event_id, value AS a, lead(value) OVER ({w}) AS b,
                 lead(value, 2) OVER ({w}) AS c, lead(value, 3) OVER ({w}) AS d FROM events)
        WHERE d IS NOT NULL
        """
    ),
)
def sliding_mean(spark, sf_dir):
    windows = sq.sliding(user_events(spark, sf_dir, "value"), "value", 4)
    total = F.aggregate("win", F.lit(0.0), lambda a, x: a + x)
    return windows.where(F.size("win") == 4).select(
        "user_id", "event_id", F.round(total / 4, 4).alias("mean")
    )


@query(
    "dedupe_consecutive",
    _sql(
        """
        SELECT user_id, event_id, event_type FROM (
          SELECT *, lag(event_type) OVER ({w}) AS p FROM events)
        WHERE p IS NULL OR p <> event_type
        """
    ),
)
def dedupe_consecutive(spark, sf_dir):
    seq = user_events(spark, sf_dir, "event_type")
    return sq.drop_consecutive_duplicates(seq, "event_type").drop("ts")


@query(
    "run_groups",
    _sql(
        """
        SELECT user_id, run_no, any_value(event_type) AS event_type, count(*) AS n,
               min(ts) AS start_ts, max(ts) AS end_ts FROM (
          SELECT *, CAST(sum(change) OVER ({w}) AS BIGINT) AS run_no FROM (
            SELECT *, CASE WHEN lag(event_type) OVER ({w}) <> event_type THEN 1 ELSE 0 END AS change
            FROM events))
        GROUP BY user_id, run_no
        """
    ),
)
def run_groups(spark, sf_dir):
    grouped = sq.runs(user_events(spark, sf_dir, "event_type"), "event_type").df
    return sq.summarise(
        grouped, "user_id", "run_no",
        F.first("event_type").alias("event_type"), counted(),
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"),
    )


@query(
    "sessions_30m",
    _sql(
        """
        SELECT user_id, session_no, count(*) AS n, min(ts) AS start_ts, max(ts) AS end_ts,
               round(sum(value), 4) AS total FROM (
          SELECT *, CAST(sum(cut) OVER ({w}) AS BIGINT) AS session_no FROM (
            SELECT *, CASE WHEN ts - lag(ts) OVER ({w}) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS cut
            FROM events))
        GROUP BY user_id, session_no
        """
    ),
)
def sessions_30m(spark, sf_dir):
    grouped = sq.sessions(user_events(spark, sf_dir, "value"), "ts", 30 * 60).df
    return sq.summarise(
        grouped, "user_id", "session_no", counted(),
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"),
        F.round(F.sum("value"), 4).alias("total"),
    )


@query(
    "global_sessions",
    """
    SELECT session_no, count(*) AS n, min(event_id) AS first_id FROM (
      SELECT *, CAST(sum(cut) OVER (ORDER BY ts, event_id) AS BIGINT) AS session_no FROM (
        SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY ts, event_id) >= INTERVAL 10 MINUTE
                       THEN 1 ELSE 0 END AS cut FROM events))
    GROUP BY session_no
    """,
)
def global_sessions(spark, sf_dir):
    rows = events(spark, sf_dir).select("ts", "event_id")
    grouped = sq.sessions(o.ordered(rows, (), ["ts", "event_id"]), "ts", 10 * 60).df
    return grouped.groupBy("session_no").agg(counted(), F.min("event_id").alias("first_id"))


@query(
    "scenes",
    _sql(
        """
        WITH blocks AS (SELECT user_id, event_id, ts, epoch_us(ts) AS s,
                               epoch_us(ts) + CAST(round(value * 1000) AS BIGINT) * 1000 * 60 AS e FROM events)
        SELECT user_id, scene_no, count(*) AS n, min(s) AS start_us, max(e) AS end_us FROM (
          SELECT *, CAST(sum(cut) OVER ({w}) AS BIGINT) AS scene_no FROM (
            SELECT *, CASE WHEN s - lag(e) OVER ({w}) >= 3600000000 THEN 1 ELSE 0 END AS cut FROM blocks))
        GROUP BY user_id, scene_no
        """
    ),
)
def scenes(spark, sf_dir):
    # a block lasts as many minutes as its value; scenes end at a pause of an hour
    seq = user_events(spark, sf_dir, "value")
    start = micros_of(seq.rows, "ts")("ts")
    length = F.rint(F.col("value") * 1000).cast("bigint") * 1000 * 60
    seq = seq.with_columns(s=start, e=start + length)
    grouped = sq.scenes(seq, "s", "e", 3_600_000_000).df
    return sq.summarise(
        grouped, "user_id", "scene_no", counted(), F.min("s").alias("start_us"), F.max("e").alias("end_us")
    )


@query(
    "timed_chunks",
    """
    SELECT user_id, bucket, chunk_no, count(*) AS n, min(event_id) AS first_id FROM (
      SELECT user_id, event_id, date_trunc('day', ts) AS bucket,
             (row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) - 1) // 2
               AS chunk_no FROM events)
    GROUP BY ALL
    """,
)
def timed_chunks(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "ts", "event_id")
    cut = sq.timed_chunks(rows, "user_id", ["ts", "event_id"], "ts", 2, "1 day")
    return cut.groupBy("user_id", "bucket", "chunk_no").agg(counted(), F.min("event_id").alias("first_id"))


@query(
    "chunk_by_marker",
    _sql(
        """
        WITH marked AS (
          SELECT *, CAST(coalesce(sum((event_type = 'purchase')::INT) OVER (
                   {w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chunk_no
          FROM events),
        placed AS (
          SELECT *, row_number() OVER (PARTITION BY user_id, chunk_no ORDER BY ts, event_id) - 1 AS pos
          FROM marked)
        SELECT user_id, chunk_no, count(*) AS n, arg_min(event_type, pos) AS head,
          0 AS part, CASE arg_min(event_type, pos)
            WHEN 'click' THEN upper(' ' || string_agg(event_type, ' ' ORDER BY pos) FILTER (WHERE pos > 0))
            WHEN 'view' THEN lower(' ' || string_agg(event_type, ' ' ORDER BY pos) FILTER (WHERE pos > 0))
            ELSE 'error' END AS treated
        FROM placed GROUP BY user_id, chunk_no
        """
    ),
)
def chunk_by_marker(spark, sf_dir):
    seq = user_events(spark, sf_dir, "event_type")
    chunked = sq.marker_chunks(seq, F.col("event_type") == "purchase").df
    placed = o.ordered(chunked, ["user_id", "chunk_no"], ["ts", "event_id"]).add(pos=o.index()).df
    keys = ["user_id", "chunk_no"]
    heads = placed.groupBy(*keys).agg(F.min_by("event_type", "pos").alias("head"), counted())
    rest = sq.fold_text(placed.where("pos > 0"), keys, "pos", "event_type", leading=True)
    treated = (
        F.when(F.col("head") == "click", F.upper("folded"))
        .when(F.col("head") == "view", F.lower("folded"))
        .otherwise("error")
    )
    whole = heads.join(rest, keys, "left").withColumn("part", F.coalesce("part", F.lit(0)))
    return whole.withColumn("treated", treated).drop("folded")


@query(
    "first_special",
    _sql(
        """
        SELECT user_id, event_id, CASE WHEN row_number() OVER ({w}) = 1 THEN 'Processed first: '
               ELSE 'Processed rest: ' END || event_type AS treated FROM events
        """
    ),
)
def first_special(spark, sf_dir):
    seq = user_events(spark, sf_dir, "event_type")
    said = lambda label: F.concat(F.lit(f"Processed {label}: "), "event_type")
    return sq.special_first(seq, said("first"), said("rest")).drop("ts", "event_type")


@query(
    "head_with_rest",
    _sql(
        """
        SELECT user_id, event_id, head FROM (
          SELECT user_id, event_id, first_value(event_type) OVER ({w}) AS head,
                 row_number() OVER ({w}) AS rn FROM events) WHERE rn > 1
        """
    ),
)
def head_with_rest(spark, sf_dir):
    seq = user_events(spark, sf_dir, "event_type")
    return sq.head_with_rest(seq, "event_type").drop("ts", "event_type")


@query(
    "take_drop_while",
    _sql(
        """
        SELECT user_id, event_id, CASE WHEN failed = 0 THEN 'taken' ELSE 'dropped_to_here' END AS side FROM (
          SELECT user_id, event_id, max((event_type = 'error')::INT) OVER ({w}) AS failed FROM events)
        """
    ),
)
def take_drop_while(spark, sf_dir):
    fine = F.col("event_type") != "error"
    seq = user_events(spark, sf_dir, "event_type")
    taken = sq.take_while(seq, fine).withColumn("side", F.lit("taken"))
    rest = sq.drop_while(seq, fine).withColumn("side", F.lit("dropped_to_here"))
    return taken.unionByName(rest).select("user_id", "event_id", "side")


def _unit_groups(drop_last: str) -> str:
    return _sql(
        f"""
        SELECT user_id, group_no, count(*) AS n FROM (
          SELECT *, CAST(sum(cut) OVER ({{w}}) AS BIGINT) AS group_no FROM (
            SELECT *, lead(ts) OVER ({{w}}) AS nxt,
                   CASE WHEN date_trunc('minute', lag(ts) OVER ({{w}})) <> date_trunc('minute', ts)
                        THEN 1 ELSE 0 END AS cut FROM events))
        {drop_last} GROUP BY user_id, group_no
        """
    )


@query("second_buckets", _unit_groups(""))
def second_buckets(spark, sf_dir):
    grouped = sq.changed_seconds(user_events(spark, sf_dir), "ts", "minute")
    return sq.summarise(grouped, "user_id", "group_no", counted())


@query("second_buckets_drop_last", _unit_groups("WHERE nxt IS NOT NULL"))
def second_buckets_drop_last(spark, sf_dir):
    grouped = sq.changed_seconds(user_events(spark, sf_dir), "ts", "minute", drop_last=True)
    return sq.summarise(grouped, "user_id", "group_no", counted())


def _slot_pick(pick: str) -> str:
    return f"""
    SELECT event_type, date_trunc('hour', ts) AS slot, {pick}(ts, (ts, event_id)) AS ts,
           {pick}(event_id, (ts, event_id)) AS event_id, {pick}(value, (ts, event_id)) AS value
    FROM events GROUP BY event_type, date_trunc('hour', ts)
    """


@query("latest_per_slot", _slot_pick("arg_max"))
def latest_per_slot(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_type", "ts", "event_id", "value")
    return latest.conflate(rows, "event_type", "ts", "1 hour", ["ts", "event_id"])


@query("sample_per_slot", _slot_pick("arg_min"))
def sample_per_slot(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_type", "ts", "event_id", "value")
    return latest.sample_first(rows, "event_type", "ts", "1 hour", ["ts", "event_id"])


@query(
    "keep_newest_n",
    """
    SELECT event_type, date_trunc('day', ts) AS slot, event_id FROM events
    QUALIFY row_number() OVER (PARTITION BY event_type, date_trunc('day', ts)
                               ORDER BY ts DESC, event_id DESC) <= 3
    """,
)
def keep_newest_n(spark, sf_dir):
    rows = latest.with_slot(events(spark, sf_dir).select("event_type", "ts", "event_id"), "ts", "1 day")
    return latest.keep_newest(rows, ["event_type", "slot"], ["ts", "event_id"], 3).drop("ts")


@query(
    "heartbeat_fill",
    _sql(
        """
        SELECT user_id, event_id, unnest(generate_series(ts + INTERVAL 1 DAY,
               nxt - INTERVAL 1 MICROSECOND, INTERVAL 1 DAY)) AS beat
        FROM (SELECT user_id, event_id, ts, lead(ts) OVER ({w}) AS nxt FROM events)
        WHERE ts + INTERVAL 1 DAY < nxt
        """
    ),
)
def heartbeat_fill(spark, sf_dir):
    return sq.heartbeats(user_events(spark, sf_dir), "ts", 86_400).drop("ts")


@query(
    "retained_value",
    """
    SELECT event_type, event_id, false AS retained FROM events WHERE ts > TIMESTAMP '2024-01-15'
    UNION ALL
    SELECT event_type, arg_max(event_id, (ts, event_id)), true FROM events
    WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY event_type
    """,
)
def retained_value(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_type", "ts", "event_id")
    since = F.lit("2024-01-15").cast("timestamp_ntz")
    return latest.retained(rows, "event_type", "ts", ["ts", "event_id"], since).drop("ts")


@query(
    "flush_batches",
    _sql(
        """
        WITH marked AS (
          SELECT *, CASE WHEN ts - lag(ts) OVER ({w}) >= INTERVAL 2 HOUR
                           OR lag(event_type) OVER ({w}) = 'purchase' THEN 1 ELSE 0 END AS cut
          FROM events),
        raw AS (SELECT *, sum(cut) OVER ({w}) AS r FROM marked)
        SELECT user_id, dense_rank() OVER (PARTITION BY user_id ORDER BY r) - 1 AS batch_no, n, first_id
        FROM (SELECT user_id, r, count(*) AS n, min(event_id) AS first_id FROM raw
              WHERE event_type <> 'purchase' GROUP BY user_id, r)
        """
    ),
)
def flush_batches(spark, sf_dir):
    seq = user_events(spark, sf_dir, "event_type")
    batched = sq.flush_batches(seq, "ts", F.col("event_type") == "purchase", 2 * 3600)
    return sq.summarise(batched, "user_id", "batch_no", counted(), F.min("event_id").alias("first_id"))


@query(
    "replace_append",
    _sql(
        """
        WITH sized AS (
          SELECT *, CASE event_type WHEN 'view' THEN 0 WHEN 'signup' THEN 3 ELSE 1 END AS z FROM events),
        epochs AS (
          SELECT *, sum((event_type = 'signup')::INT) OVER ({w}) AS epoch,
                 max((event_type <> 'view')::INT) OVER ({w}) AS touched FROM sized)
        SELECT user_id, event_id, CASE WHEN touched = 1 THEN
          CAST(sum(z) OVER (PARTITION BY user_id, epoch ORDER BY ts, event_id) AS BIGINT) END AS size
        FROM epochs
        """
    ),
)
def replace_append(spark, sf_dir):
    # signup replaces the list by three entries, view only reads, the others add one
    kind = F.col("event_type")
    size = F.when(kind == "view", 0).when(kind == "signup", 3).otherwise(1)
    seq = user_events(spark, sf_dir, "event_type")
    return sq.replace_or_append(seq, kind == "signup", size).drop("ts", "event_type")


@query(
    "dedupe_reset",
    _sql(
        """
        SELECT user_id, event_id FROM events
        QUALIFY (row_number() OVER ({w}) - 1) % 2 = 0
        """
    ),
)
def dedupe_reset(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "ts", "event_id")
    return sq.dedupe_with_reset(rows, "user_id", ["ts", "event_id"], 2).drop("ts")


@query(
    "dedupe_first",
    "SELECT event_type, user_id, min(event_id) AS event_id FROM events GROUP BY event_type, user_id",
)
def dedupe_first(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_type", "event_id")
    return latest.oldest_per(rows, ["event_type", "user_id"], ["event_id"])


@query(
    "cache_hit_miss",
    _sql(
        """
        SELECT user_id, event_id, CASE WHEN event_type = 'signup' THEN 'update'
          WHEN epoch_us(ts) - epoch_us(lag(ts) OVER ({w}))
               < CASE WHEN lag(event_type) OVER ({w}) = 'signup' THEN 3600000000 ELSE 1800000000 END
          THEN 'hit' ELSE 'miss' END AS outcome
        FROM events
        """
    ),
)
def cache_hit_miss(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type")
    judged = sq.cache_outcome(
        rows, "user_id", ["ts", "event_id"], "ts", 1800,
        update=F.col("event_type") == "signup", update_idle_seconds=3600,
    )
    return judged.select("user_id", "event_id", "outcome")


@query(
    "late_filter",
    """
    SELECT event_id, user_id FROM (
      SELECT event_id, user_id, ts, max(ts) OVER (ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) AS top
      FROM events) WHERE ts >= top - INTERVAL 6 HOUR
    """,
)
def late_filter(spark, sf_dir):
    rows = events(spark, sf_dir).select(
        "event_id", "user_id", "ts", F.md5(F.col("event_id").cast("string")).alias("arrival")
    )
    marked = sq.late_rows(o.ordered(rows, (), ["arrival", "event_id"]), "ts", 6 * 3600)
    return marked.where(~F.col("late")).select("event_id", "user_id")


@query(
    "late_filter_by_user",
    """
    SELECT event_id, user_id, ts < top - INTERVAL 2 DAY AS late FROM (
      SELECT event_id, user_id, ts, max(ts) OVER (PARTITION BY user_id
             ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) AS top FROM events)
    """,
)
def late_filter_by_user(spark, sf_dir):
    rows = events(spark, sf_dir).select(
        "event_id", "user_id", "ts", F.md5(F.col("event_id").cast("string")).alias("arrival")
    )
    marked = sq.late_rows(o.ordered(rows, "user_id", ["arrival", "event_id"]), "ts", 2 * 86_400)
    return marked.select("event_id", "user_id", "late")


@query(
    "chat_echo",
    """
    SELECT conv_id, chunk_no, count(*) AS n, 0 AS part,
           'Hello ' || string_agg(replace(upper(text), 'ẞ', 'SS'), '; ' ORDER BY turn) || '!' AS reply
    FROM (SELECT conv_id, turn, text,
                 (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 10 AS chunk_no
          FROM conversations)
    GROUP BY conv_id, chunk_no
    """,
)
def chat_echo(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    chunked = sq.chunks(o.ordered(turns, "conv_id", "turn"), 10).df
    keys = ["conv_id", "chunk_no"]
    folded = sq.fold_text(
        chunked, keys, "turn", F.upper("text"), separator="; ", name="reply", head="Hello ", tail="!"
    )
    sizes = chunked.groupBy(*keys).agg(counted())
    return folded.join(sizes, keys)


@query(
    "tokens",
    r"""
    SELECT doc_id, replace(upper(t), 'ẞ', 'SS') AS token, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \t\n\r\f\v]+')) AS t FROM documents)
    WHERE t <> '' GROUP BY ALL
    """,
)
def tokens(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = docs.select("doc_id", F.explode(text.tokens(F.upper("text"))).alias("token"))
    return listed.groupBy("doc_id", "token").agg(counted())
