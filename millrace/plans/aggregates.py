"""Registered queries: aggregates, sorts and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import arrays, numbers, text
from millrace.functions.time import micros_of, slot_start
from millrace.operators import aggregates as ag
from millrace.operators import latest
from millrace.operators import ordered as o
from millrace.operators import sequence as sq
from millrace.operators import user
from millrace.plans.common import events
from millrace.plans.registry import query
from millrace.runtime import spread
from millrace.sources.tables import table


def _mean_to(places, df):
    return df.withColumn("mean", F.round("mean", places))


@query(
    "station_stats",
    """
    SELECT event_type, count(value) AS n, min(value) AS lowest, max(value) AS highest,
           round(avg(value), 4) AS mean
    FROM events GROUP BY event_type ORDER BY event_type
    """,
)
def station_stats(spark, sf_dir):
    return _mean_to(4, ag.min_mean_max(events(spark, sf_dir), "event_type", "value"))


@query(
    "station_stats_seed_zero",
    """
    SELECT s_nationkey, count(*) AS n, least(min(s_acctbal), 0.0) AS lowest,
           greatest(max(s_acctbal), 0.0) AS highest,
           round(avg(s_acctbal), 4) AS mean
    FROM supplier GROUP BY s_nationkey ORDER BY s_nationkey
    """,
)
def station_stats_seed_zero(spark, sf_dir):
    return _mean_to(4, ag.min_mean_max(
        table(spark, sf_dir, "supplier"), "s_nationkey", "s_acctbal", seed_zero=True
    ))


@query(
    "measure_with_small_means",
    """
    SELECT event_type, count(value) AS n, min(value / 1e8) AS lowest, max(value / 1e8) AS highest,
           round(avg(value / 1e8), 15) AS mean
    FROM events GROUP BY event_type ORDER BY event_type
    """,
)
def measure_with_small_means(spark, sf_dir):
    # means below 0.0001 stay what they are
    rows = events(spark, sf_dir).withColumn("v", F.col("value") / F.lit(1e8))
    return _mean_to(15, ag.min_mean_max(rows, "event_type", "v"))


@query(
    "delay_by_supplier",
    """
    SELECT l_suppkey, count(*) AS n, CAST(sum(delay) AS BIGINT) AS total,
           CAST(sum(delay) // count(*) AS BIGINT) AS average
    FROM (SELECT l_suppkey, CAST(l_quantity AS INT) - 25 AS delay FROM lineitem)
    WHERE delay > 0 GROUP BY l_suppkey
    """,
)
def delay_by_supplier(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", (F.col("l_quantity").cast("int") - 25).alias("delay")
    )
    return ag.delay_average(items, "l_suppkey", "delay")


@query(
    "safe_cast_delay",
    """
    SELECT l_returnflag, count(*) AS n, CAST(sum(delay) AS BIGINT) AS total,
           CAST(sum(delay) // count(*) AS BIGINT) AS average
    FROM (SELECT l_returnflag,
                 coalesce(TRY_CAST(CASE WHEN l_linestatus = 'O' THEN 'NA'
                          ELSE CAST(CAST(l_quantity AS INT) - 25 AS VARCHAR) END AS INT), -1) AS delay
          FROM lineitem)
    WHERE delay > 0 GROUP BY l_returnflag
    """,
)
def safe_cast_delay(spark, sf_dir):
    raw = F.when(F.col("l_linestatus") == "O", "NA").otherwise(
        (F.col("l_quantity").cast("int") - 25).cast("string")
    )
    items = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", numbers.whole_or(raw, -1).alias("delay")
    )
    return ag.delay_average(items, "l_returnflag", "delay")


@query(
    "partial_rollup",
    """
    SELECT event_type, count(value) AS n, min(value) AS lowest, max(value) AS highest,
           round(sum(value), 4) AS total
    FROM events GROUP BY event_type
    """,
)
def partial_rollup(spark, sf_dir):
    daily = events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    stored = ag.partials(daily, ["event_type", "day"], "value")
    return ag.merge_partials(stored, "event_type").withColumn(
        "total", F.round("total", 4)
    )


_MEASURED = """
    SELECT l_returnflag, count(v) AS n, round(min(v), 4) AS lowest, NOT isfinite(max(v)) AS no_highest,
           round(sum(CASE WHEN isfinite(v) THEN v ELSE 0 END), 4) AS total,
           CASE WHEN isfinite(max(v)) THEN round(avg(v), 4) END AS mean
    FROM (SELECT l_returnflag, {value} AS v FROM lineitem) GROUP BY l_returnflag
"""


def _measured(spark, sf_dir, value):
    items = table(spark, sf_dir, "lineitem").select("l_returnflag", value.alias("v"))
    states = ag.merge_partials(ag.partials(items, "l_returnflag", "v"), "l_returnflag")
    means = _mean_to(4, ag.min_mean_max(items, "l_returnflag", "v")).select("l_returnflag", "mean")
    finite = items.withColumn("v", F.when(~F.isnan("v"), F.col("v")).otherwise(0.0))
    totals = ag.partials(finite, "l_returnflag", "v").select("l_returnflag", "total")
    return states.drop("total").join(means, "l_returnflag").join(totals, "l_returnflag").select(
        "l_returnflag", "n", F.round("lowest", 4).alias("lowest"),
        F.isnan("highest").alias("no_highest"), F.round("total", 4).alias("total"),
        F.when(~F.isnan("mean"), F.col("mean")).alias("mean"),
    )


@query("measure_of_six_places", _MEASURED.format(value="l_extendedprice * l_discount * l_tax"))
def measure_of_six_places(spark, sf_dir):
    # more decimals than a price has: nothing may be rounded before it is summed
    return _measured(spark, sf_dir, F.col("l_extendedprice") * F.col("l_discount") * F.col("l_tax"))


@query(
    "measure_with_nan",
    _MEASURED.format(
        value="CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN CAST('nan' AS DOUBLE) "
        "ELSE l_extendedprice * l_discount END"
    ),
)
def measure_with_nan(spark, sf_dir):
    # one flag has values that are no numbers: its highest and mean are none, the others stand
    odd = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7)
    measure = F.col("l_extendedprice") * F.col("l_discount")
    return _measured(spark, sf_dir, F.when(odd, F.lit(float("nan"))).otherwise(measure))


@query(
    "word_count",
    r"""
    SELECT word, count(*) AS n
    FROM (SELECT unnest(regexp_split_to_array(lower(text), '\W+')) AS word FROM documents)
    WHERE word <> '' AND word <> 'the' GROUP BY word
    """,
)
def word_count(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("text"))
    listed = docs.select(F.explode(text.words("text")).alias("word"))
    return ag.count_words(listed, "word", ignore=["the"])


@query(
    "keyword_messages",
    """
    SELECT source, count(*) AS n FROM documents WHERE contains(text, 'The') GROUP BY source
    """,
)
def keyword_messages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    hit = docs.where(F.contains("text", F.lit("The")))
    return hit.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(
    "keyword_delta",
    """
    WITH daily AS (SELECT event_type, date_trunc('day', ts)::DATE AS day, count(*) AS n
                   FROM events GROUP BY ALL),
         totals AS (SELECT event_type, day,
                           CAST(sum(n) OVER (PARTITION BY event_type ORDER BY day) AS BIGINT) AS total
                    FROM daily)
    SELECT event_type, day, total,
           total - lag(total, 1, 0) OVER (PARTITION BY event_type ORDER BY day) AS delta,
           CAST(sum(total) OVER (PARTITION BY event_type ORDER BY day) AS BIGINT) AS accumulated
    FROM totals
    """,
)
def keyword_delta(spark, sf_dir):
    daily = (
        events(spark, sf_dir)
        .groupBy("event_type", F.to_date("ts").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = o.ordered(daily, "event_type", "day").add(total=o.running_sum("n")).df.drop("n")
    changed = ag.deltas(totals, "event_type", "day", "total")
    return o.ordered(changed, "event_type", "day").add(accumulated=o.running_sum("total")).df


@query(
    "newest_total",
    """
    SELECT event_type, arg_max(total, day) AS total, max(day) AS day FROM (
      SELECT event_type, day, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY day) AS BIGINT) AS total
      FROM (SELECT event_type, date_trunc('day', ts)::DATE AS day, count(*) AS n FROM events GROUP BY ALL))
    GROUP BY event_type
    """,
)
def newest_total(spark, sf_dir):
    daily = (
        events(spark, sf_dir)
        .groupBy("event_type", F.to_date("ts").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = o.ordered(daily, "event_type", "day").add(total=o.running_sum("n")).df
    return latest.newest_per(totals.select("event_type", "day", "total"), "event_type", "day")


@query("empty_fold", "SELECT CAST(coalesce(sum(event_id), 0) AS BIGINT) AS total FROM events WHERE user_id < 0")
def empty_fold(spark, sf_dir):
    none = events(spark, sf_dir).where(F.col("user_id") < 0)
    return ag.empty_safe_sum(none, "event_id")


@query(
    "empty_fold_by_user",
    """
    SELECT user_id, event_type, CAST(coalesce(sum(event_id) FILTER (WHERE value > 300), 0) AS BIGINT) AS total
    FROM events GROUP BY user_id, event_type
    """,
)
def empty_fold_by_user(spark, sf_dir):
    # some users have no dear event of a type: their fold is over nothing
    return ag.empty_safe_sum(
        events(spark, sf_dir), "event_id", by=["user_id", "event_type"], where=F.col("value") > 300
    )


@query(
    "text_fold",
    """
    SELECT conv_id, 0 AS part, ' ' || string_agg(role, ' ' ORDER BY turn) AS folded, count(*) AS n
    FROM conversations GROUP BY conv_id
    """,
)
def text_fold(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    folded = sq.fold_text(
        turns.select("conv_id", "turn", "role"), "conv_id", "turn", "role", leading=True
    )
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return folded.join(sizes, "conv_id")


@query(
    "chunk_sums",
    """
    SELECT chunk_no, CAST(sum(o_orderkey) AS BIGINT) AS key_sum, count(*) AS n,
           round(sum(o_totalprice), 4) AS price_sum
    FROM (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS chunk_no,
                 o_orderkey, o_totalprice FROM orders)
    GROUP BY chunk_no
    """,
)
def chunk_sums(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    paged = sq.chunks(o.ordered(orders, (), "o_orderkey"), 1000).df
    return paged.groupBy("chunk_no").agg(
        F.sum("o_orderkey").alias("key_sum"),
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("o_totalprice"), 4).alias("price_sum"),
    )


_MEDIAN_LEVEL = """
      SELECT event_type, batch_no, (pos // 5) AS pos, list_sort(list(v))[(count(*) + 1) // 2] AS v
      FROM {source} GROUP BY event_type, batch_no, pos // 5
"""


@query(
    "median_of_medians",
    """
    WITH numbered AS (
      SELECT event_type, value AS v,
             row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i FROM events),
    batches AS (SELECT event_type, i // 100 AS batch_no, i % 100 AS pos, v FROM numbered),
    level1 AS (""" + _MEDIAN_LEVEL.format(source="batches") + """),
    level2 AS (""" + _MEDIAN_LEVEL.format(source="level1") + """),
    sizes AS (SELECT event_type, batch_no, count(*) AS medians FROM level1 GROUP BY ALL),
    remaining AS (
      SELECT l.event_type, l.batch_no, l.v FROM level1 l JOIN sizes USING (event_type, batch_no)
      WHERE medians <= 5
      UNION ALL
      SELECT l.event_type, l.batch_no, l.v FROM level2 l JOIN sizes USING (event_type, batch_no)
      WHERE medians > 5)
    SELECT event_type, batch_no, b.n, r.median
    FROM (SELECT event_type, batch_no, list_sort(list(v))[(count(*) + 1) // 2] AS median
          FROM remaining GROUP BY ALL) r
    JOIN (SELECT event_type, batch_no, count(*) AS n FROM batches GROUP BY ALL) b
    USING (event_type, batch_no)
    """,
)
def median_of_medians(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_type", "event_id", "value")
    return ag.median_of_medians(rows, "event_type", "event_id", "value")


@query(
    "kth_smallest",
    """
    SELECT l_returnflag, l_extendedprice FROM (
      SELECT l_returnflag, l_extendedprice,
             row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS rn
      FROM lineitem) WHERE rn = 10
    """,
)
def kth_smallest(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    return latest.kth_smallest(items, "l_returnflag", "l_extendedprice", 10)


@query(
    "kth_smallest_large_k",
    """
    SELECT l_returnflag, l_extendedprice FROM (
      SELECT l_returnflag, l_extendedprice,
             row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS rn
      FROM lineitem) WHERE rn = 1400
    """,
)
def kth_smallest_large_k(spark, sf_dir):
    # beyond the ranks that Spark limits before the shuffle
    items = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    return latest.kth_smallest(items, "l_returnflag", "l_extendedprice", 1400)


@query(
    "downsample_without_times",
    """
    SELECT event_type, date_trunc('hour', CASE WHEN event_id % 7 <> 0 THEN ts END) AS slot, count(*) AS n,
           round(avg(value), 4) AS mean
    FROM events GROUP BY ALL
    """,
)
def downsample_without_times(spark, sf_dir):
    # every seventh event has lost its time and is counted in the null slot
    rows = events(spark, sf_dir).withColumn("ts", F.when(F.col("event_id") % 7 != 0, F.col("ts")))
    slots = _mean_to(4, ag.downsample(rows, "event_type", "ts", "1 hour", "value"))
    return slots.select("event_type", "slot", "n", "mean")


@query(
    "series_recent",
    """
    SELECT count(DISTINCT (user_id, event_type)) AS n_series FROM events
    WHERE ts >= (SELECT max(ts) - INTERVAL 1 DAY FROM events)
    """,
)
def series_recent(spark, sf_dir):
    points = events(spark, sf_dir).select("user_id", "event_type", "ts")
    newest = points.agg(F.max("ts").alias("newest"))
    recent = points.join(F.broadcast(newest))  # one row: the reference time of the range
    return ag.series_count(
        recent,
        ["user_id", "event_type"],
        "ts",
        F.col("newest") - F.expr("INTERVAL 1 DAY"),
        F.col("newest"),
    )


@query(
    "point_merge",
    """
    SELECT user_id, date_trunc('hour', ts) AS hour,
           arg_max(value, (ts, event_id)) FILTER (WHERE event_type <> 'view') AS value,
           arg_max(props, (ts, event_id)) FILTER (WHERE event_type <> 'click') AS props
    FROM events GROUP BY ALL
    """,
)
def point_merge(spark, sf_dir):
    points = events(spark, sf_dir).select(
        "user_id",
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"),
        "ts",
        "event_id",
        F.when(F.col("event_type") != "view", F.col("value")).alias("value"),
        F.when(F.col("event_type") != "click", F.col("props")).alias("props"),
    )
    return ag.merge_points(points, ["user_id", "hour"], ["value", "props"], ["ts", "event_id"])


@query(
    "downsample",
    """
    SELECT event_type, date_trunc('hour', ts) AS slot, count(*) AS n, min(value) AS lowest,
           max(value) AS highest, min(ts) AS first_ts, max(ts) AS last_ts,
           round(avg(value), 4) AS mean
    FROM events GROUP BY ALL
    """,
)
def downsample(spark, sf_dir):
    return _mean_to(4, ag.downsample(events(spark, sf_dir), "event_type", "ts", "1 hour", "value"))


@query(
    "throughput",
    """
    WITH slots AS (SELECT date_trunc('day', ts) AS slot, count(*) AS n, min(ts) AS a, max(ts) AS b
                   FROM events GROUP BY ALL)
    SELECT slot, n, CASE WHEN (epoch_us(b) - epoch_us(a)) // 1000 // 1000 < 5 THEN 0
                    ELSE n // ((epoch_us(b) - epoch_us(a)) // 1000 // 1000) END AS rate
    FROM slots
    """,
)
def throughput(spark, sf_dir):
    rows = events(spark, sf_dir)
    slots = rows.groupBy(slot_start("ts", "1 day").alias("slot")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b")
    )
    micros = micros_of(rows, "ts")
    elapsed = F.floor((micros("b") - micros("a")) / 1000)
    return slots.select("slot", "n", ag.overall_rate(F.col("n"), elapsed).alias("rate"))


@query(
    "batch_mean_total",
    """
    WITH numbered AS (
      SELECT *, date_trunc('hour', ts) AS bucket,
             (row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) - 1) // 100 AS chunk_no
      FROM events),
    batches AS (
      SELECT user_id, bucket, chunk_no, arg_min(event_id, (ts, event_id)) AS first_id, count(*) AS n,
             floor(round(avg(value), 9) * 100) / 100.0 AS mean
      FROM numbered GROUP BY user_id, bucket, chunk_no)
    SELECT *, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY bucket, chunk_no) AS BIGINT) AS measured
    FROM batches
    """,
)
def batch_mean_total(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "ts", "event_id", "value")
    return ag.batch_means(
        rows, "user_id", ["ts", "event_id"], "ts", "value", "event_id", 100, "1 hour"
    )


@query(
    "running_map",
    """
    WITH known AS (
      SELECT event_id, user_id, ts,
        last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER w AS c,
        last_value(CASE WHEN event_type = 'error' THEN value END IGNORE NULLS) OVER w AS e,
        last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w AS p,
        last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER w AS s,
        last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w AS v
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT event_id, user_id,
           CAST((c IS NOT NULL)::INT + (e IS NOT NULL)::INT + (p IS NOT NULL)::INT
                + (s IS NOT NULL)::INT + (v IS NOT NULL)::INT AS INT) AS n_keys,
           concat_ws(',', CASE WHEN c IS NOT NULL THEN 'click' END, CASE WHEN e IS NOT NULL THEN 'error' END,
                     CASE WHEN p IS NOT NULL THEN 'purchase' END, CASE WHEN s IS NOT NULL THEN 'signup' END,
                     CASE WHEN v IS NOT NULL THEN 'view' END) AS keys,
           c AS click_value
    FROM known
    UNION ALL SELECT DISTINCT NULL, user_id, 0, '', CAST(NULL AS DOUBLE) FROM events
    """,
)
def running_map(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type", "value")
    mapped = ag.running_maps(rows, "user_id", ["ts", "event_id"], "event_type", "value")
    return mapped.select(
        "event_id",
        "user_id",
        F.size("so_far").alias("n_keys"),
        F.array_join(F.array_sort(F.map_keys("so_far")), ",").alias("keys"),
        F.try_element_at("so_far", F.lit("click")).alias("click_value"),
    )


@query(
    "running_map_many_keys",
    """
    WITH firsts AS (SELECT user_id, event_type, min((ts, event_id)) AS f FROM events GROUP BY ALL),
    entries AS (
      SELECT e.user_id, e.event_id, f.event_type AS k,
             (SELECT arg_max(x.value, (x.ts, x.event_id)) FROM events x WHERE x.user_id = e.user_id
              AND x.event_type = f.event_type AND (x.ts, x.event_id) <= (e.ts, e.event_id)) AS v
      FROM events e JOIN firsts f ON f.user_id = e.user_id AND f.f <= (e.ts, e.event_id))
    SELECT user_id, event_id, string_agg(k || '=' || printf('%.4f', v), ',' ORDER BY k) AS so_far
    FROM entries GROUP BY user_id, event_id
    UNION ALL SELECT DISTINCT user_id, NULL, '' FROM events
    """,
)
def running_map_many_keys(spark, sf_dir):
    # the form for key sets of any size
    rows = events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type", "value")
    mapped = ag.running_maps(
        rows, "user_id", ["ts", "event_id"], "event_type", "value", most_columns=2
    )
    entry = F.transform(
        F.array_sort(F.map_entries("so_far")),
        lambda e: F.concat_ws("=", e["key"], F.format_string("%.4f", e["value"])),
    )
    return mapped.select("user_id", "event_id", F.array_join(entry, ",").alias("so_far"))


@query(
    "user_fold",
    """
    SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total,
           CAST(max(l_linenumber) AS BIGINT) AS top FROM lineitem GROUP BY l_returnflag
    """,
)
def user_fold(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")

    def fold(rows):
        return {
            "n": len(rows),
            "total": int(rows["l_quantity"].sum()),
            "top": int(rows["l_linenumber"].max()),
        }

    def merge(states):
        return {
            "n": int(states["n"].sum()),
            "total": int(states["total"].sum()),
            "top": int(states["top"].max()),
        }

    return user.fold_per_key(
        items, "l_returnflag", ["l_quantity", "l_linenumber"], "n BIGINT, total BIGINT, top BIGINT",
        fold, merge, fan_in=16,
    )


@query(
    "running_fold",
    """
    SELECT user_id, row_number() OVER w AS step,
           round(sum(value) OVER w, 4) AS folded
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    UNION ALL SELECT DISTINCT user_id, 0, 0.0 FROM events
    """,
)
def running_fold(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "ts", "event_id", "value")
    folded = sq.running_fold(o.ordered(rows, "user_id", ["ts", "event_id"]), "value")
    return folded.withColumn("folded", F.round("folded", 4))


@query(
    "running_product",
    """
    SELECT l_orderkey, row_number() OVER w AS step,
           CAST(product(l_linenumber) OVER w AS DOUBLE) AS folded
    FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    UNION ALL SELECT DISTINCT l_orderkey, 0, 1.0 FROM lineitem
    """,
)
def running_product(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"
    )
    seq = o.ordered(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"])
    return sq.running_fold(seq, "l_linenumber", kind="product")


@query(
    "branch_coverage",
    """
    WITH firsts AS (SELECT user_id, event_type, min((ts, event_id)) AS f FROM events GROUP BY ALL)
    SELECT user_id, count(*) AS seen, count(*) = 5 AS complete,
           CASE WHEN count(*) = 5 THEN max(f)[1] END AS complete_at
    FROM firsts GROUP BY user_id
    """,
)
def branch_coverage(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_type", "ts", "event_id")
    branches = rows.select("event_type").distinct().count()
    return ag.coverage(rows, "user_id", "event_type", ["ts", "event_id"], branches)


@query(
    "top_n",
    """
    SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
    ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10
    """,
)
def top_n(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice"
    )
    return latest.top_n(
        items, 10, F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")
    )


@query(
    "priority_merge",
    """
    SELECT event_type, event_id, position, weight, position / weight AS turn FROM (
      SELECT event_type, event_id,
             CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS INT) AS position,
             CASE event_type WHEN 'error' THEN 100 WHEN 'purchase' THEN 10 ELSE 1 END AS weight
      FROM events WHERE event_type IN ('view', 'purchase', 'error'))
    ORDER BY turn, weight DESC, event_type LIMIT 20
    """,
)
def priority_merge(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_type", "event_id", "ts")
    weights = {"view": 1, "purchase": 10, "error": 100}
    merged = latest.merge_by_priority(rows, "event_type", ["ts", "event_id"], weights, 20)
    return merged.drop("ts")


@query(
    "window_times",
    """
    SELECT event_type, slot, ts, row_number() OVER (PARTITION BY event_type, slot ORDER BY ts) - 1 AS place
    FROM (SELECT DISTINCT event_type, date_trunc('day', ts) AS slot, ts FROM events)
    """,
)
def window_times(spark, sf_dir):
    # the set of event times of each window, in order: one row per time, no array
    rows = latest.with_slot(events(spark, sf_dir).select("event_type", "ts"), "ts", "1 day").distinct()
    return o.ordered(rows, ["event_type", "slot"], "ts").add(place=o.index()).df


@query(
    "sorted_set",
    """
    SELECT user_id, len(list(DISTINCT date_trunc('day', ts))) AS n_days,
           strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day
    FROM events GROUP BY user_id
    """,
)
def sorted_set(spark, sf_dir):
    # days of a month: the set is bounded by the calendar, not by the rows
    days = F.array_sort(F.collect_set(F.date_format("ts", "yyyy-MM-dd")))
    return (
        events(spark, sf_dir)
        .groupBy("user_id")
        .agg(days.alias("days"))
        .select(
            "user_id",
            F.size("days").cast("bigint").alias("n_days"),
            arrays.head("days").alias("first_day"),
            arrays.last("days").alias("last_day"),
        )
    )
