"""Registered queries: projections, routing, text, time and number columns."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from millrace.functions import arrays, numbers, protect, text
from millrace.functions import time as clock
from millrace.operators import names, routing, user
from millrace.operators import ordered as o
from millrace.plans.common import events
from millrace.plans.registry import query
from millrace.runtime import pin, spread
from millrace.sources import records
from millrace.sources.tables import table


def counted():
    return F.count(F.lit(1)).alias("n")


@query(
    "row_filters",
    """
    SELECT o_orderkey, o_totalprice * 2 AS doubled FROM orders
    WHERE o_orderstatus = 'F' AND NOT o_totalprice < 1000
    """,
)
def row_filters(spark, sf_dir):
    return routing.collect_where(
        table(spark, sf_dir, "orders"),
        (F.col("o_orderstatus") == "F") & ~(F.col("o_totalprice") < 1000),
        "o_orderkey",
        (F.col("o_totalprice") * 2).alias("doubled"),
    )


@query(
    "with_original",
    "SELECT event_id, value, round(value * 1.5 + 1, 4) AS scaled FROM events",
)
def with_original(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "value")
    return routing.beside(rows, "scaled", lambda v: F.round(v * 1.5 + 1, 4), "value")


@query(
    "user_batches",
    """
    SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, p_size * 2 AS doubled FROM part
    """,
)
def user_batches(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")

    def split(batch):
        batch = batch.assign(word=batch["p_name"].str.split(" "), doubled=batch["p_size"] * 2)
        return batch.explode("word")[["p_partkey", "word", "doubled"]]

    return user.map_batches(parts, split, "p_partkey BIGINT, word STRING, doubled INT")


@query(
    "fan_functions",
    """
    SELECT p_partkey, b AS branch, p_partkey * (b + 2) AS result
    FROM part, (SELECT unnest([0, 1])::INT AS b)
    """,
)
def fan_functions(spark, sf_dir):
    keys = table(spark, sf_dir, "part").select("p_partkey")
    return routing.through_all(keys, "p_partkey", [lambda v: v * 2, lambda v: v * 3])


_DIVERT = """
    SELECT o_orderkey, CASE WHEN o_orderkey % 2 <> 0 THEN 'odd key'
                            WHEN o_orderkey <= 5 THEN 'key of 5 or less' END AS error FROM orders
"""


@query(
    "divert",
    f"""
    SELECT o_orderkey, 'valid' AS side, CAST(NULL AS VARCHAR) AS error FROM ({_DIVERT}) WHERE error IS NULL
    UNION ALL SELECT o_orderkey, 'invalid', error FROM ({_DIVERT}) WHERE error IS NOT NULL
    """,
)
def divert(spark, sf_dir):
    key = F.col("o_orderkey")
    routed = routing.with_error(
        table(spark, sf_dir, "orders").select("o_orderkey"),
        [(key % 2 != 0, "odd key"), (key <= 5, "key of 5 or less")],
    )
    valid, invalid = routing.divert(routed)
    return valid.select(
        "o_orderkey", F.lit("valid").alias("side"), F.lit(None).cast("string").alias("error")
    ).unionByName(invalid.withColumn("side", F.lit("invalid")))


@query(
    "reject_reason",
    """
    SELECT event_id, CAST(event_id AS VARCHAR) AS correlation_id, 'LimitExceeded' AS error_type,
           'k is ' || json_extract_string(props, '$.k') AS error_message
    FROM events WHERE coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT), -1) >= 50
    """,
)
def reject_reason(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    rows = events(spark, sf_dir).select("event_id", k.alias("k"))
    failed = routing.dead_letters(
        rows,
        numbers.whole_or("k", -1) >= 50,
        "event_id",
        F.lit("LimitExceeded"),
        F.concat(F.lit("k is "), "k"),
    )
    return failed.drop("k")


@query(
    "twin_primes",
    """
    WITH primes AS (SELECT p_partkey AS p FROM part WHERE p_partkey > 1 AND NOT EXISTS (
      SELECT 1 FROM generate_series(2, CAST(floor(sqrt(p_partkey)) AS BIGINT)) d(d)
      WHERE d.d < part.p_partkey AND part.p_partkey % d.d = 0))
    SELECT p * 2 AS doubled FROM primes WHERE p + 2 IN (
      SELECT q FROM (SELECT p_partkey + 2 AS q FROM part) WHERE q > 1 AND NOT EXISTS (
        SELECT 1 FROM generate_series(2, CAST(floor(sqrt(q)) AS BIGINT)) d(d)
        WHERE d.d < q AND q % d.d = 0))
    """,
)
def twin_primes(spark, sf_dir):
    key = F.col("p_partkey")
    return routing.collect_where(
        table(spark, sf_dir, "part"),
        numbers.is_prime(key) & numbers.is_prime(key + 2),
        (key * 2).alias("doubled"),
    )


@query(
    "tapped_rows",
    """
    SELECT event_type, count(*) AS n, (SELECT count(*) FROM events) AS n_seen,
           (SELECT max(event_id) FROM events) AS newest_seen FROM events GROUP BY event_type
    """,
)
def tapped_rows(spark, sf_dir):
    # what the tap saw stands beside the rows, which passed unchanged
    seen = Observation("tapped_rows")
    rows = events(spark, sf_dir).select("event_id", "event_type")
    passed = pin(routing.tap(rows, seen, counted(), F.max("event_id").alias("newest")), "tapped")
    metrics = seen.get
    return passed.groupBy("event_type").agg(counted()).select(
        "*",
        F.lit(metrics["n"]).cast("bigint").alias("n_seen"),
        F.lit(metrics["newest"]).cast("bigint").alias("newest_seen"),
    )


@query(
    "skip_failing_rows",
    "SELECT event_id, CAST(event_id * 2 AS BIGINT) AS doubled FROM events WHERE event_type <> 'error'",
)
def skip_failing_rows(spark, sf_dir):
    # a user function that raises for some rows: those are left out, the rest goes on
    def doubled(row):
        if row.event_type == "error":
            raise ValueError("not to be doubled")
        return row.event_id, row.event_id * 2

    rows = spread(events(spark, sf_dir).select("event_id", "event_type"))
    each = user.each_row(doubled, ["event_id", "doubled"])
    return user.map_batches(rows, each, "event_id BIGINT, doubled BIGINT", skip_failing=True)


@query(
    "hash_buckets",
    """
    SELECT o_orderkey, CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8)) AS BIGINT) % 3 AS bucket,
           row_number() OVER (PARTITION BY CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8)) AS BIGINT) % 3
                              ORDER BY o_orderkey) - 1 AS place
    FROM orders
    """,
)
def hash_buckets(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    bucketed = orders.withColumn("bucket", numbers.hash_bucket("o_orderkey", 3))
    return o.ordered(bucketed, "bucket", "o_orderkey").add(place=o.index()).df


@query(
    "round_robin",
    """
    SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) % 3 AS target FROM orders
    """,
)
def round_robin(spark, sf_dir):
    return routing.round_robin(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 3)


@query(
    "weighted_targets",
    """
    SELECT o_orderkey, (['a', 'b', 'b', 'c', 'c', 'c'])[row_number() OVER (ORDER BY o_orderkey) % 6 + 1] AS target
    FROM orders
    """,
)
def weighted_targets(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return routing.weighted_round_robin(orders, "o_orderkey", {"a": 1, "b": 2, "c": 3})


@query(
    "least_loaded",
    """
    WITH loads AS (SELECT s_nationkey, CAST(round(sum(s_acctbal) / 10000) AS BIGINT) AS load
                   FROM supplier GROUP BY s_nationkey)
    SELECT s_nationkey, load FROM loads ORDER BY load, s_nationkey LIMIT 1
    """,
)
def least_loaded(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier")
    loads = suppliers.groupBy("s_nationkey").agg(
        F.round(F.sum("s_acctbal") / 10000).cast("bigint").alias("load")
    )
    return routing.least_loaded(loads, "s_nationkey", "load")


@query(
    "hashtags",
    """
    SELECT doc_id, len(tags) AS n_tags, list_contains(tags, 'the') AS tagged
    FROM (SELECT doc_id, list_distinct(list_filter(string_split(text, ' '), lambda x: starts_with(x, 'th'))) AS tags
          FROM documents)
    WHERE len(tags) > 0
    """,
)
def hashtags(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return (
        docs.withColumn("tags", text.hashtags("text", mark="th"))
        .where(F.size("tags") > 0)
        .select(
            "doc_id",
            F.size("tags").cast("bigint").alias("n_tags"),
            F.array_contains("tags", "the").alias("tagged"),
        )
    )


@query(
    "change_events",
    """
    WITH raw AS (
      SELECT event_id, event_type, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k, user_id FROM events)
    SELECT event_id, event_type AS cmd_type, CAST(0 AS BIGINT) AS timestamp, '' AS title,
           user_id % 2 = 0 AS is_bot, user_id % 2 = 0 AND user_id % 3 = 0 AS is_named_bot,
           CASE WHEN event_type IN ('new', 'edit') THEN k ELSE 0 END AS length_new,
           CASE WHEN event_type IN ('new', 'edit') THEN k - 5 ELSE 0 END AS length_old,
           CASE WHEN event_type IN ('new', 'edit') THEN 5 ELSE 0 END AS delta
    FROM (SELECT * REPLACE (CASE event_type WHEN 'view' THEN 'new' WHEN 'click' THEN 'edit' ELSE event_type END
                            AS event_type) FROM raw)
    """,
)
def change_events(spark, sf_dir):
    rows = events(spark, sf_dir)
    kind = (
        F.when(F.col("event_type") == "view", "new")
        .when(F.col("event_type") == "click", "edit")
        .otherwise(F.col("event_type"))
    )
    k = F.get_json_object("props", "$.k").try_cast("int")
    user = F.when(F.col("user_id") % 3 == 0, "A Bot").otherwise("A person")
    payload = F.to_json(
        F.struct(
            kind.alias("type"),
            user.alias("user"),
            (F.col("user_id") % 2 == 0).alias("bot"),
            F.struct(k.alias("new"), (k - 5).alias("old")).alias("length"),
        )
    )
    texts = rows.select("event_id", payload.alias("json"))
    changes = records.change_events(texts, "json")
    return changes.select("event_id", "change.*").drop("server_name", "user")


@query(
    "entities",
    """
    SELECT doc_id, len(names) AS n_names, names[1] AS first_name FROM (
      SELECT doc_id, list_distinct(found) AS d, found AS names0,
             list_filter(found, lambda x, i: list_position(found, x) = i) AS names
      FROM (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]+ [A-Z][a-z]+') AS found FROM documents))
    WHERE len(names) > 0
    """,
)
def entities(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return (
        spread(docs)
        .select("doc_id", text.names("text").alias("names"))
        .where(F.size("names") > 0)
        .select(
            "doc_id",
            F.size("names").cast("bigint").alias("n_names"),
            arrays.head("names").alias("first_name"),
        )
    )


_NAMES = r"""
    WITH begun AS (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
    names AS (SELECT DISTINCT array_to_string(w[1:n], ' ') AS name, n FROM begun, (VALUES (3), (5)) v(n) WHERE len(w) >= n),
    places AS (SELECT doc_id, unnest(w) AS a, unnest(range(len(w))) AS p
               FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents)),
    ahead AS (SELECT doc_id, p, a || ' ' || lead(a, 1) OVER o || ' ' || lead(a, 2) OVER o AS three,
                     ' ' || lead(a, 3) OVER o || ' ' || lead(a, 4) OVER o AS more
              FROM places WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
    found AS (SELECT doc_id, p, n, name FROM ahead JOIN names ON n = 3 AND name = three
              UNION ALL SELECT doc_id, p, n, name FROM ahead JOIN names ON n = 5 AND name = three || more)
    SELECT doc_id, CAST(p AS INTEGER) AS "at", CAST(n AS INTEGER) AS n_words, name FROM found
    QUALIFY row_number() OVER (PARTITION BY doc_id, p ORDER BY n DESC) = 1
"""


@query("names_by_dictionary", _NAMES)
def names_by_dictionary(spark, sf_dir):
    # the dictionary: how the benchmark's passages begin, with three words and with five
    begun = table(spark, sf_dir, "benchmark").select(names.words("text").alias("w"))
    sizes = begun.withColumn("n", F.explode(F.array(F.lit(3), F.lit(5)))).where(F.size("w") >= F.col("n"))
    dictionary = sizes.select(F.array_join(F.slice("w", 1, F.col("n")), " ").alias("name"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return names.find_names(spread(docs), dictionary, "text", "name")


@query(
    "name_pairs",
    """
    WITH flags AS (SELECT DISTINCT l_orderkey, l_returnflag AS f FROM lineitem)
    SELECT x.f AS a, y.f AS b, count(*) AS n FROM flags x JOIN flags y
    ON x.l_orderkey = y.l_orderkey AND x.f < y.f GROUP BY ALL
    """,
)
def name_pairs(spark, sf_dir):
    # the list per order is a set of flags: three at most
    flags = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.array_sort(F.collect_set("l_returnflag")).alias("flags"))
    )
    paired = flags.select(F.explode(arrays.pairs("flags")).alias("p"))
    return paired.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(counted())


@query(
    "text_cleanup",
    r"""
    WITH clean AS (
      SELECT conv_id, turn, regexp_replace(text, '[\x00-\x1F]', '', 'g') AS t FROM conversations),
    unquoted AS (
      SELECT conv_id, turn, CASE WHEN starts_with(t, '"') THEN substr(t, 2, greatest(length(t) - 2, 0)) ELSE t END AS t
      FROM clean),
    parts AS (SELECT *, instr(t, ',') - 1 AS c, string_split(t, ' ') AS w FROM unquoted)
    SELECT conv_id, turn,
      CASE WHEN starts_with(t, '-') THEN
             array_to_string(list_transform(list_filter(string_split(t, '-')[2:], lambda x: x <> ''), lambda x: '-' || x), '/')
           WHEN length(t) <= 40 THEN t
           WHEN c > 15 AND c < length(t) - 15 THEN substr(t, 1, c + 1) || '/' || substr(t, c + 2)
           ELSE array_to_string(w[1:len(w) // 2], ' ') || '/' || array_to_string(w[len(w) // 2 + 1:], ' ')
      END AS lines
    FROM parts
    """,
)
def text_cleanup(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        "conv_id", "turn", F.array_join(text.display_lines("text"), "/").alias("lines")
    )


@query(
    "text_parts",
    r"""
    SELECT o_orderkey, ltrim(CAST(o_orderkey AS VARCHAR), '12') AS stripped,
           lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS padded,
           upper(o_orderpriority) AS loud, trim('  ' || o_orderpriority || ' ') AS trimmed,
           contains(o_orderpriority, 'URGENT') AS urgent, starts_with(o_orderpriority, '1') AS first,
           lower(o_orderpriority) = lower('1-urgent') AS same, left(o_orderpriority, 3) AS start,
           replace(o_orderpriority, '-', ' ') AS spaced, 'key-' || CAST(o_orderkey AS VARCHAR) AS labelled
    FROM orders
    """,
)
def text_parts(spark, sf_dir):
    key, kind = F.col("o_orderkey").cast("string"), F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        text.strip_leading(key, "12").alias("stripped"),
        text.pad_number("o_orderkey", 12).alias("padded"),
        F.upper(kind).alias("loud"),
        F.trim(F.concat(F.lit("  "), kind, F.lit(" "))).alias("trimmed"),
        F.contains(kind, F.lit("URGENT")).alias("urgent"),
        F.startswith(kind, F.lit("1")).alias("first"),
        text.equals_ignore_case(kind, F.lit("1-urgent")).alias("same"),
        F.left(kind, F.lit(3)).alias("start"),
        F.replace(kind, F.lit("-"), F.lit(" ")).alias("spaced"),
        F.concat(F.lit("key-"), key).alias("labelled"),
    )


@query(
    "path_parts",
    """
    SELECT page_id, string_split(url, '/')[-1] AS last, string_split(split_part(url, '?', 1), '/')[-1] AS leaf,
           split_part(url, ':', 1) AS scheme,
           regexp_replace(regexp_replace(split_part(url, '?', 1), '^.*/', ''), '\\.[^.]*$', '') AS base
    FROM pages
    """,
)
def path_parts(spark, sf_dir):
    path = F.substring_index("url", "?", 1)
    return table(spark, sf_dir, "pages").select(
        "page_id",
        text.last_part("url").alias("last"),
        text.last_part(path).alias("leaf"),
        F.substring_index("url", ":", 1).alias("scheme"),
        text.base_name(path).alias("base"),
    )


@query("url_roundtrip", "SELECT page_id, url FROM pages")
def url_roundtrip(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.url_encode("url").alias("coded"))
    return pages.select("page_id", F.url_decode("coded").alias("url"))


@query(
    "bytes_roundtrip",
    "SELECT doc_id, text, octet_length(encode(text)) AS n_bytes FROM documents",
)
def bytes_roundtrip(spark, sf_dir):
    coded = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b"))
    return coded.select(
        "doc_id", F.decode("b", "UTF-8").alias("text"), F.octet_length("b").cast("bigint").alias("n_bytes")
    )


@query(
    "time_parts",
    """
    SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(ts, '%H:%M:%S') AS clock,
           epoch_us(ts) // 1000 % 86400000 AS ms_day,
           strftime(ts, '%H:%M:%S,') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') AS clock_ms,
           date_trunc('second', ts) AS second,
           epoch_us(ts) // 1000000 - (epoch_us(ts) // 1000000) % 90 AS floored,
           strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S') AS zurich
    FROM events
    """,
)
def time_parts(spark, sf_dir):
    # January: the local zone is one hour ahead of UTC
    rows = events(spark, sf_dir)
    seconds = F.floor(clock.micros_of(rows, "ts")("ts") / 1_000_000).cast("bigint")
    return rows.select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
        F.date_format("ts", "HH:mm:ss").alias("clock"),
        clock.ms_of_day("ts").alias("ms_day"),
        clock.clock_text(clock.ms_of_day("ts")).alias("clock_ms"),
        F.date_trunc("second", F.col("ts")).cast("timestamp_ntz").alias("second"),
        clock.floor_to(seconds, 90).alias("floored"),
        clock.local_seconds(seconds, "Europe/Zurich").alias("zurich"),
    )


@query(
    "clock_roundtrip",
    "SELECT event_id, epoch_us(ts) // 1000 % 86400000 AS ms FROM events",
)
def clock_roundtrip(spark, sf_dir):
    shown = events(spark, sf_dir).select(
        "event_id", clock.clock_text(clock.ms_of_day("ts")).alias("shown")
    )
    return shown.select("event_id", clock.clock_ms("shown").alias("ms"))


@query(
    "safe_math",
    """
    SELECT o_orderkey, abs(o_orderkey - 500) AS distance, (o_orderkey + 1) % 7 AS rest,
           least(o_orderkey, 100) AS low, greatest(o_orderkey, 100) AS high,
           floor(o_totalprice / 3 * 100) / 100.0 AS cut,
           CASE WHEN o_custkey % 5 = 0 THEN 0 ELSE o_orderkey // (o_custkey % 5) END AS average
    FROM orders
    """,
)
def safe_math(spark, sf_dir):
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.abs(key - 500).alias("distance"),
        F.pmod(key + 1, F.lit(7)).alias("rest"),
        F.least(key, F.lit(100)).alias("low"),
        F.greatest(key, F.lit(100)).alias("high"),
        numbers.floor_2(F.col("o_totalprice") / 3).alias("cut"),
        numbers.integer_average(key, F.col("o_custkey") % 5).alias("average"),
    )


@query(
    "array_parts",
    """
    SELECT vec_id, embedding[1] AS head, embedding[-1] AS last, len(embedding) AS n,
           len(embedding[2:]) AS n_rest, list_reverse(embedding)[2] AS before_last,
           len(list_filter(embedding, lambda x: x > 0)) AS n_positive,
           list_position(embedding, list_max(embedding)) AS top_at,
           round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total
    FROM embeddings
    """,
)
def array_parts(spark, sf_dir):
    v = F.col("embedding")
    long = lambda c: c.cast("bigint")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        arrays.head(v).alias("head"),
        arrays.last(v).alias("last"),
        long(F.size(v)).alias("n"),
        long(F.size(arrays.without_head(v))).alias("n_rest"),
        F.try_element_at(F.reverse(v), F.lit(2)).alias("before_last"),
        long(F.size(F.filter(v, lambda x: x > 0))).alias("n_positive"),
        F.array_position(v, F.array_max(v)).cast("int").alias("top_at"),
        F.round(arrays.fold_sum(v), 4).alias("total"),
    )


@query("protect_roundtrip", "SELECT c_custkey, c_name, 12 + length(c_name) + 16 AS gcm_bytes FROM customer")
def protect_roundtrip(spark, sf_dir):
    # a key per table, derived here for the example; real keys come from the caller
    key = F.unhex(F.sha2(F.lit("customer table key"), 256))
    coded = table(spark, sf_dir, "customer").select(
        "c_custkey",
        protect.encrypt("c_name", key).alias("gcm"),
    )
    return coded.select(
        "c_custkey",
        protect.decrypt("gcm", key).cast("string").alias("c_name"),
        F.octet_length("gcm").cast("bigint").alias("gcm_bytes"),
    )


@query("protect_roundtrip_cbc", "SELECT c_custkey, c_name FROM customer")
def protect_roundtrip_cbc(spark, sf_dir):
    key = F.unhex(F.sha2(F.lit("customer table key"), 256))
    coded = table(spark, sf_dir, "customer").select(
        "c_custkey", protect.encrypt("c_name", key, "CBC").alias("cbc")
    )
    return coded.select("c_custkey", protect.decrypt("cbc", key, "CBC").cast("string").alias("c_name"))


@query(
    "base64_roundtrip",
    "SELECT doc_id, text, text AS text_url, text AS text_mime, base64(encode(text)) AS coded FROM documents",
)
def base64_roundtrip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    coded = docs.select(
        "doc_id",
        protect.to_base64("text").alias("coded"),
        protect.to_base64("text", "url").alias("url"),
        protect.to_base64("text", "mime").alias("mime"),
    )
    return coded.select(
        "doc_id",
        "coded",
        protect.from_base64("coded").cast("string").alias("text"),
        protect.from_base64("url", "url").cast("string").alias("text_url"),
        protect.from_base64("mime", "mime").cast("string").alias("text_mime"),
    )


@query(
    "merged_sources",
    """
    SELECT s_name AS name, 'supplier' AS kind FROM supplier
    UNION ALL SELECT c_name, 'customer' FROM customer
    """,
)
def merged_sources(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"), F.lit("supplier").alias("kind")
    )
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), F.lit("customer").alias("kind")
    )
    return suppliers.unionByName(customers)


@query(
    "concat_sources",
    """
    SELECT name, row_number() OVER (ORDER BY part, name) - 1 AS place FROM (
      SELECT s_name AS name, 0 AS part FROM supplier UNION ALL SELECT c_name, 1 FROM customer)
    """,
)
def concat_sources(spark, sf_dir):
    first = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))
    second = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"))
    both = routing.concat(first, second)
    return o.ordered(both, (), ["part", "name"]).add(place=o.index()).df.drop("part")


@query("distinct_values", "SELECT DISTINCT o_custkey, o_orderpriority FROM orders")
def distinct_values(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority").distinct()


@query(
    "generated_range",
    """
    SELECT p_partkey, unnest(generate_series(1, p_size)) AS n, 'tick' AS kind FROM part
    """,
)
def generated_range(spark, sf_dir):
    parts = table(spark, sf_dir, "part").where("p_size >= 1")
    size = F.col("p_size").cast("bigint")
    return parts.select(
        "p_partkey",
        F.explode(F.sequence(F.lit(1).cast("bigint"), size)).alias("n"),
        F.lit("tick").alias("kind"),
    )
