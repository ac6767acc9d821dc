"""Registered queries: joins by position, by time and by reference."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import joins
from millrace.operators import ordered as o
from millrace.operators import sequence as sq
from millrace.plans.common import events
from millrace.plans.registry import query
from millrace.sources.tables import table


@query(
    "zip_positional",
    """
    WITH c AS (SELECT user_id, event_id AS click_id, row_number() OVER w - 1 AS idx FROM events
               WHERE event_type = 'click' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
         v AS (SELECT user_id, event_id AS view_id, row_number() OVER w - 1 AS idx FROM events
               WHERE event_type = 'view' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, idx, click_id, view_id FROM c JOIN v USING (user_id, idx)
    """,
)
def zip_positional(spark, sf_dir):
    rows = events(spark, sf_dir)

    def side(kind):
        return rows.where(F.col("event_type") == kind).select(
            "user_id", F.col("ts").alias(f"{kind}_ts"), F.col("event_id").alias(f"{kind}_id")
        )

    zipped = joins.zip_positional(
        side("click"), side("view"), "user_id", ["click_ts", "click_id"], ["view_ts", "view_id"]
    )
    return zipped.drop("click_ts", "view_ts")


@query(
    "combine_latest",
    """
    WITH sides AS (
      SELECT user_id, ts, event_id, CASE WHEN event_type = 'click' THEN value END AS a,
             CASE WHEN event_type = 'view' THEN value END AS b
      FROM events WHERE event_type IN ('click', 'view')),
    known AS (
      SELECT user_id, event_id, last_value(a IGNORE NULLS) OVER w AS a, last_value(b IGNORE NULLS) OVER w AS b
      FROM sides WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT user_id, event_id, CASE WHEN a > b THEN 'click' ELSE 'view' END AS winner,
           greatest(a, b) AS value FROM known WHERE a IS NOT NULL AND b IS NOT NULL
    """,
)
def combine_latest(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type", "value")

    def larger(a, b):
        return {
            "winner": F.when(a["value"] > b["value"], "click").otherwise("view"),
            "value": F.greatest(a["value"], b["value"]),
        }

    return joins.combine_latest(
        rows.where("event_type = 'click'"),
        rows.where("event_type = 'view'"),
        "user_id",
        ["ts", "event_id"],
        larger,
    ).drop("ts")


@query(
    "asof_param",
    """
    SELECT event_id, user_id, round(value * coalesce(last_value(p IGNORE NULLS) OVER w, 0.5), 4) AS scaled
    FROM (SELECT event_id, user_id, ts, value, event_type,
                 CASE WHEN event_type = 'signup' THEN round(value / 100, 2) END AS p FROM events)
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    QUALIFY event_type <> 'signup'
    """,
)
def asof_param(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type", "value")
    params = rows.where("event_type = 'signup'").select(
        "user_id", "ts", "event_id", F.round(F.col("value") / 100, 2).alias("p")
    )
    elements = rows.where("event_type <> 'signup'")

    def scale(row, param):
        return {"scaled": F.round(row["value"] * F.coalesce(param["p"], F.lit(0.5)), 4)}

    return joins.asof(elements, params, "user_id", ["ts", "event_id"], scale).select(
        "event_id", "user_id", "scaled"
    )


@query(
    "versioned_exclusion",
    """
    WITH versions AS (SELECT DISTINCT date_trunc('day', ts) + INTERVAL 1 DAY AS valid_from,
                             user_id FROM events WHERE event_type = 'error'),
    starts AS (SELECT DISTINCT valid_from FROM versions),
    judged AS (SELECT e.event_id, e.user_id,
                      (SELECT max(valid_from) FROM starts s WHERE s.valid_from <= e.ts) AS v FROM events e)
    SELECT event_id, user_id FROM judged j
    WHERE NOT EXISTS (SELECT 1 FROM versions x WHERE x.valid_from = j.v AND x.user_id = j.user_id)
    """,
)
def versioned_exclusion(spark, sf_dir):
    # users with an error are excluded on the next day; each day replaces the list
    rows = events(spark, sf_dir)
    day = F.date_trunc("day", F.col("ts")).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
    listing = (
        rows.where("event_type = 'error'")
        .select("user_id", day.alias("ts"))
        .distinct()
        .select("user_id", "ts", F.col("ts").alias("version"))
    )
    elements = rows.select("event_id", "user_id", "ts")
    return joins.versioned_exclusion(elements, listing, "user_id", "ts").drop("ts")


@query(
    "lookup_enrich",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, p_name, p_brand FROM lineitem
    JOIN part ON l_partkey = p_partkey AND p_size > 10
    """,
)
def lookup_enrich(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parts = table(spark, sf_dir, "part").where("p_size > 10").select(
        F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand"
    )
    return joins.enrich(items, parts, "l_partkey")


@query(
    "reply_match",
    """
    SELECT q.conv_id, q.turn, length(r.text) AS reply_chars, r.turn IS NOT NULL AS answered
    FROM (SELECT * FROM conversations WHERE role = 'user') q
    LEFT JOIN (SELECT * FROM conversations WHERE role = 'assistant') r
    ON r.conv_id = q.conv_id AND r.turn = q.turn + 1
    """,
)
def reply_match(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    requests = turns.where("role = 'user'").select(
        "conv_id", "turn", (F.col("turn") + 1).alias("expected")
    )
    replies = turns.where("role = 'assistant'").select(
        F.col("conv_id").alias("r_conv"),
        F.col("turn").alias("r_turn"),
        F.length("text").cast("bigint").alias("reply_chars"),
    )
    matched = joins.match_replies(
        requests, replies, [("expected", "r_turn"), ("conv_id", "r_conv")]
    )
    return matched.select("conv_id", "turn", "reply_chars", "answered")


@query(
    "pending",
    """
    SELECT o_orderkey, o_orderstatus FROM orders
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
    """,
)
def pending(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return joins.pending(orders, table(spark, sf_dir, "lineitem"), [("o_orderkey", "l_orderkey")])


@query(
    "fan_out",
    "SELECT o_orderkey, branch FROM orders, (SELECT unnest([0, 1, 2, 3])::INT AS branch)",
)
def fan_out(spark, sf_dir):
    return joins.fan_out(table(spark, sf_dir, "orders").select("o_orderkey"), 4)


_LINES = """
    lines AS (
      SELECT conv_id, turn, role, x.line AS line, x.place AS place FROM (
        SELECT conv_id, turn, role, unnest(list_transform(
          list_filter(string_split(text, chr(10)), lambda l: l <> ''),
          lambda l, i: {'line': l, 'place': i - 1})) AS x FROM conversations))
"""


@query(
    "realign_lines",
    f"""
    WITH {_LINES},
    originals AS (SELECT conv_id, turn AS at_turn, place, line AS original,
                         count(*) OVER (PARTITION BY conv_id, turn) AS n FROM lines WHERE role = 'user'),
    derived AS (SELECT conv_id, turn - 1 AS at_turn, place, line AS derived FROM lines WHERE role = 'assistant')
    SELECT d.conv_id, d.at_turn, CAST(d.place AS INT) AS place, d.derived, o.original
    FROM derived d JOIN originals o ON o.conv_id = d.conv_id AND o.at_turn = d.at_turn
     AND o.place = least(d.place, o.n - 1)
    """,
)
def realign_lines(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    originals = turns.where("role = 'user'").select(
        "conv_id",
        F.col("turn").alias("at_turn"),
        F.size(lines).alias("n"),
        F.posexplode(lines).alias("place", "original"),
    )
    derived = turns.where("role = 'assistant'").select(
        "conv_id",
        (F.col("turn") - 1).alias("at_turn"),
        F.posexplode(lines).alias("place", "derived"),
    )
    return joins.realign(derived, originals, ["conv_id", "at_turn"], "place", "n")


@query(
    "plausible_answers",
    """
    SELECT a.conv_id, a.turn,
           len(list_filter(string_split(a.text, chr(10)), lambda x: x <> ''))
             = len(list_filter(string_split(u.text, chr(10)), lambda x: x <> '')) AS plausible,
           CASE WHEN len(list_filter(string_split(a.text, chr(10)), lambda x: x <> ''))
             = len(list_filter(string_split(u.text, chr(10)), lambda x: x <> '')) THEN a.text ELSE u.text END AS chosen
    FROM conversations a JOIN conversations u
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' AND u.role = 'user'
    """,
)
def plausible_answers(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("fallback")
    )
    answers = turns.where("role = 'assistant'").join(asked, ["conv_id", "turn"])
    expected = F.size(F.filter(F.split("fallback", "\n"), lambda x: x != ""))
    return answers.withColumn("plausible", text.plausible_lines("text", expected)).select(
        "conv_id",
        "turn",
        "plausible",
        F.when(F.col("plausible"), F.col("text")).otherwise(F.col("fallback")).alias("chosen"),
    )


@query(
    "filled_templates",
    """
    SELECT conv_id, 0 AS part, 'What was said:' || chr(10) || string_agg(text || chr(10) || chr(10), '' ORDER BY turn)
           || 'That was all.' AS prompt
    FROM conversations GROUP BY conv_id
    """,
)
def filled_templates(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    placed = o.ordered(turns, "conv_id", "turn").add(pos=o.index()).df
    block = F.concat("text", F.lit("\n\n"))
    return sq.fold_text(
        placed, "conv_id", "pos", block, separator="", name="prompt", head="What was said:\n", tail="That was all."
    )
