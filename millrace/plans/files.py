"""Registered queries: formats.  Each writes the given tables in a format and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import messages, protect
from millrace.functions import time as clock
from millrace.operators import aggregates as ag
from millrace.operators import ordered as o
from millrace.operators import sequence as sq
from millrace.plans.common import events
from millrace.plans.registry import query
from millrace.runtime import spread, work_dir
from millrace.sources import files, lines, records
from millrace.sources.index import BucketedIndex
from millrace.sources.tables import table


def counted():
    return F.count(F.lit(1)).alias("n")


@query(
    "measurement_lines",
    """
    SELECT event_type AS location, count(*) AS n, min(CAST(value AS DOUBLE)) AS lowest,
           max(value) AS highest,
           round(avg(value), 4) AS mean
    FROM events GROUP BY event_type
    """,
)
def measurement_lines(spark, sf_dir):
    path = work_dir(spark, "measurements")
    events(spark, sf_dir).select(
        F.concat_ws(" ; ", "event_type", F.col("value").cast("string"))
    ).write.text(path)
    parsed = lines.parse_fields(
        lines.read_lines(spark, path), "location STRING, temperature DOUBLE", ";"
    )
    clean = parsed.where(F.col("error").isNull())
    stats = ag.min_mean_max(clean, "location", "temperature")
    return stats.withColumn("mean", F.round("mean", 4))


@query(
    "delimited_rejects",
    """
    SELECT coalesce(error, 'clean') AS outcome, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM (
      SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'total has another type'
                  WHEN o_orderkey % 11 = 0 THEN 'fields are missing' END AS error,
             o_orderkey AS k FROM orders)
    GROUP BY ALL
    """,
)
def delimited_rejects(spark, sf_dir):
    key, path = F.col("o_orderkey"), work_dir(spark, "delimited")
    broken = F.when(key % 7 == 0, F.lit("NA")).otherwise(F.col("o_totalprice").cast("string"))
    full = F.concat_ws(",", key.cast("string"), F.concat(F.lit(" "), broken, F.lit(" ")), "o_orderstatus")
    cut = F.concat_ws(",", key.cast("string"), broken)
    table(spark, sf_dir, "orders").select(
        F.when((key % 11 == 0) & (key % 7 != 0), cut).otherwise(full)
    ).write.text(path)
    parsed = lines.parse_fields(
        lines.read_lines(spark, path), "id BIGINT, total DOUBLE, status STRING"
    )
    outcome = F.coalesce("error", F.lit("clean")).alias("outcome")
    return parsed.groupBy(outcome).agg(counted(), F.sum("id").alias("total"))


@query("gzip_roundtrip", "SELECT doc_id, lang, n_chars FROM documents")
def gzip_roundtrip(spark, sf_dir):
    path = work_dir(spark, "gzip")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    docs.write.option("compression", "gzip").csv(path)
    return lines.read_delimited(spark, path, "doc_id BIGINT, lang STRING, n_chars BIGINT")


@query(
    "json_rows",
    """
    SELECT CASE WHEN s_acctbal < 0 THEN NULL ELSE CAST(s_acctbal AS FLOAT) END AS myfloat_nullable,
           s_name AS mystr, CAST(s_suppkey AS INT) AS myint_id FROM supplier ORDER BY myint_id
    """,
)
def json_rows(spark, sf_dir):
    path = work_dir(spark, "json")
    balance = F.col("s_acctbal").cast("float")
    rows = table(spark, sf_dir, "supplier").select(
        F.when(F.col("s_acctbal") >= 0, balance).alias("myfloat_nullable"),
        F.col("s_name").alias("mystr"),
        F.col("s_suppkey").cast("int").alias("myint_id"),
    )
    files.write_json_rows(rows, path)
    schema = "myfloat_nullable FLOAT, mystr STRING, myint_id INT"
    return files.read_json_rows(spark, path, schema, "myint_id")


@query(
    "subtitles",
    """
    SELECT idx, epoch_us(ts) // 1000 % 86400000 AS start,
           epoch_us(ts) // 1000 % 86400000 + CAST(round(value * 10) AS BIGINT) AS "end",
           event_type || '/' || 'value ' || user_id AS lines
    FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS idx FROM events)
    """,
)
def subtitles(spark, sf_dir):
    path = work_dir(spark, "subtitles")
    start = clock.ms_of_day("ts")
    blocks = events(spark, sf_dir).select(
        "ts",
        "event_id",
        start.alias("start"),
        (start + F.floor(F.col("value") * 10 + 0.5)).alias("end"),
        F.array(F.col("event_type"), F.format_string("value %d", "user_id")).alias("lines"),
    )
    records.write_subtitles(blocks, path, ["ts", "event_id"])
    # the number in the file is the position, which the reader leaves out
    numbered = spark.read.option("lineSep", records.BLOCK_END).text(path)
    numbered = numbered.withColumn("idx", F.substring_index(F.ltrim("value"), "\n", 1).try_cast("bigint") - 1)
    back = records.subtitle_blocks(numbered.where("value <> ''"))
    return back.select("idx", "start", "end", F.array_join("lines", "/").alias("lines"))


@query(
    "line_protocol",
    """
    SELECT 'load_' || event_type AS measurement, CAST(user_id AS VARCHAR) AS sensor,
           CAST(event_id AS VARCHAR) AS hr, CAST(value AS DOUBLE) AS level, epoch_us(ts) // 1000 AS at
    FROM events
    """,
)
def line_protocol(spark, sf_dir):
    path = work_dir(spark, "points")
    rows = events(spark, sf_dir)
    line = records.point_line(
        F.concat(F.lit("load_"), "event_type"),
        {"sensor": F.col("user_id")},
        {"hr": records.integer_field(F.col("event_id")), "level": F.col("value")},
        F.floor(clock.micros_of(rows, "ts")("ts") / 1000),
    )
    rows.select(line).write.text(path)
    back = records.points(lines.read_lines(spark, path))
    return back.select(
        "measurement",
        F.col("tags")["sensor"].alias("sensor"),
        F.col("fields")["hr"].alias("hr"),
        F.col("fields")["level"].cast("double").alias("level"),
        "at",
    )


@query(
    "line_protocol_texts",
    r"""
    SELECT doc_id, 'notes, all = \ ' || lang AS measurement, source || ' =,"\' AS origin,
           md5(coalesce(text, '')) AS text_md5, length(text) AS at
    FROM documents
    """,
)
def line_protocol_texts(spark, sf_dir):
    # whole texts with quotes, blanks, commas and line ends as a field; separators in every name
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    line = records.point_line(
        F.concat(F.lit("notes, all = \\ "), "lang"),
        {"the origin": F.concat("source", F.lit(' =,"\\'))},
        {"text, whole": records.text_field(F.coalesce("text", F.lit("")))},
        F.length("text"),
    )
    back = records.points(docs.select("doc_id", line.alias("line")))
    return back.select(
        "doc_id",
        "measurement",
        F.col("tags")["the origin"].alias("origin"),
        F.md5(F.col("fields")["text, whole"]).alias("text_md5"),
        "at",
    )


@query(
    "line_protocol_endings",
    """
    SELECT event_type AS measurement, CAST(event_id AS VARCHAR) AS number, props AS kind,
           CASE WHEN event_id % 2 = 0 THEN user_id END AS at
    FROM (SELECT event_id, user_id, event_type, 'k' || user_id AS props FROM events)
    """,
)
def line_protocol_endings(spark, sf_dir):
    # line ends of two kinds, behind the time or, where there is none, behind the last value
    rows = events(spark, sf_dir).select("event_id", "user_id", "event_type")
    time = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" "), "user_id")).otherwise("")
    end = F.when(F.col("event_id") % 3 == 0, "\r\n").when(F.col("event_id") % 3 == 1, "\n").otherwise("")
    line = F.concat("event_type", F.lit(" kind=k"), "user_id", F.lit(",number="), "event_id", time, end)
    found = records.points(rows.select(line.alias("line")))
    fields = F.col("fields")
    return found.select("measurement", fields["number"].alias("number"), fields["kind"].alias("kind"), "at")


def _messages(spark, sf_dir):
    """One message per order: header, person, and one to four OBX segments."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    key = F.col("o_orderkey")
    version = F.when(key % 10 == 3, F.lit("")).otherwise(F.lit("2.5"))
    head = F.format_string(
        "MSH|^~\\&|SHOP|HQ|LAB|HQ|20240101||ADT^A01|c%d|P|%s|", key, version
    )
    person = F.format_string("PID|1||%d^^^ID||||", "o_custkey")
    observed = F.transform(
        F.sequence(F.lit(1).cast("bigint"), key % 4 + 1),
        lambda n: F.concat(
            F.lit("OBX|"), n.cast("string"), F.lit("|NM|"), (key + n).cast("string"),
            F.lit("^part~"), (key % 13).cast("string"), F.lit("^supplier||"),
            (n * 7).cast("string"), F.lit("|||"),
        ),
    )
    body = F.array_join(F.concat(F.array(head, person), observed), messages.SEGMENT_END)
    framed = messages.frame(F.concat(body, F.lit(messages.SEGMENT_END)))
    return spread(orders).select("o_orderkey", framed.alias("message"))


@query(
    "hl7_segments",
    """
    SELECT o_orderkey, 'MSH' AS name, 1 AS occurrence, 'c' || o_orderkey AS value, 0 AS place FROM orders
    UNION ALL SELECT o_orderkey, 'PID', 1, o_custkey || '^^^ID', 1 FROM orders
    UNION ALL SELECT o_orderkey, 'OBX', CAST(n AS INT), (o_orderkey + n) || '^part~' || (o_orderkey % 13) || '^supplier',
                     CAST(n + 1 AS INT)
    FROM (SELECT o_orderkey, unnest(generate_series(1, o_orderkey % 4 + 1)) AS n FROM orders)
    """,
)
def hl7_segments(spark, sf_dir):
    segments = records.hl7_segments(_messages(spark, sf_dir), "o_orderkey", "message")
    value = F.when(F.col("name") == "MSH", messages.field("segment", 10)).otherwise(
        messages.field("segment", 3)
    )
    return segments.select("o_orderkey", "name", "occurrence", value.alias("value"), "place")


@query(
    "hl7_components",
    """
    SELECT o_orderkey, CAST(n AS VARCHAR) AS line, CAST(o_orderkey + n AS VARCHAR) AS part,
           CAST(o_orderkey % 13 AS VARCHAR) AS supplier, CAST(n * 7 AS VARCHAR) AS quantity
    FROM (SELECT o_orderkey, unnest(generate_series(1, o_orderkey % 4 + 1)) AS n FROM orders)
    """,
)
def hl7_components(spark, sf_dir):
    segments = records.hl7_segments(_messages(spark, sf_dir), "o_orderkey", "message")
    observed = segments.where("name = 'OBX'")
    repeated = F.split(messages.field("segment", 3), messages.REPETITION_SEPARATOR)
    first = lambda i: F.substring_index(
        F.get(repeated, F.lit(i)), messages.COMPONENT_SEPARATOR, 1
    )
    return observed.select(
        "o_orderkey",
        messages.field("segment", 1).alias("line"),
        first(0).alias("part"),
        first(1).alias("supplier"),
        messages.field("segment", 5).alias("quantity"),
    )


@query(
    "hl7_replies",
    """
    SELECT o_orderkey, 'c' || o_orderkey AS control_id, CASE WHEN o_orderkey % 10 = 3 THEN 'AE' ELSE 'AA' END AS code,
           CASE WHEN o_orderkey % 10 = 3 THEN 'version is missing' END AS error,
           o_orderkey % 10 = 3 AS refused
    FROM orders
    """,
)
def hl7_replies(spark, sf_dir):
    replies = records.hl7_acknowledge(_messages(spark, sf_dir), "o_orderkey", "message")
    return replies.select(
        "o_orderkey", "control_id", "code", "error", messages.refused("reply").alias("refused")
    )


@query(
    "hl7_stripped",
    """
    SELECT o_orderkey, 'PID|1||' || o_custkey || '^^^ID' AS person FROM orders
    """,
)
def hl7_stripped(spark, sf_dir):
    whole = messages.stripped("message")
    person = F.regexp_extract(whole, r"(PID\|1\|\|\d+\^\^\^ID)", 1)
    return _messages(spark, sf_dir).select("o_orderkey", person.alias("person"))


@query(
    "xml_docs",
    """
    SELECT doc_id, 1 AS number, 'text/' || lang AS media_type, lang AS ending, text AS body FROM documents
    UNION ALL SELECT doc_id, 2, 'note/' || source, source, lang || '-' || source FROM documents
    """,
)
def xml_docs(spark, sf_dir):
    element = lambda kind, name, body: F.format_string(
        '<embeddedDoc id="%d" mediaType="%s/%s">%s</embeddedDoc>',
        F.col("doc_id"), F.lit(kind), F.col(name), protect.to_base64(body, "mime"),
    )
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    xml = F.concat(
        F.lit("<documents>"),
        element("text", "lang", "text"),
        element("note", "source", F.concat_ws("-", "lang", "source")),
        F.lit("</documents>"),
    )
    found = records.embedded_documents(docs.select("doc_id", xml.alias("xml")), "doc_id", "xml")
    return found.select(
        "doc_id", "number", "media_type", "ending", F.col("content").cast("string").alias("body")
    )


@query(
    "archive_entries",
    """
    SELECT source AS archive, 'doc-' || doc_id || '.txt' AS name, md5(text) AS digest,
           octet_length(encode(text)) AS n_bytes FROM documents
    """,
)
def archive_entries(spark, sf_dir):
    path = work_dir(spark, "archives")
    docs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("archive"),
        F.format_string("doc-%d.txt", "doc_id").alias("name"),
        F.encode("text", "UTF-8").alias("content"),
    )
    files.pack_archives(docs, 256 * 1024).write.parquet(path)
    packed = spark.read.schema("archive STRING, part INT, content BINARY").parquet(path)
    entries = files.expand_archives(packed, "archive")
    return entries.select(
        "archive", "name", F.md5("content").alias("digest"),
        F.octet_length("content").cast("bigint").alias("n_bytes"),
    )


@query(
    "split_by_key_counted",
    "SELECT event_type, count(*) AS n_rows, count(*) AS n FROM events GROUP BY event_type",
)
def split_by_key_counted(spark, sf_dir):
    path = work_dir(spark, "split")
    files.split_with_counts(events(spark, sf_dir).drop("props"), path, "event_type")
    back = spark.read.schema("event_id BIGINT, event_type STRING, n_rows BIGINT").parquet(path)
    return back.groupBy("event_type", "n_rows").agg(counted())


@query(
    "file_per_value",
    "SELECT o_orderstatus, o_orderkey FROM orders",
)
def file_per_value(spark, sf_dir):
    path = work_dir(spark, "values")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    files.write_per_value(orders, path, "o_orderstatus")
    return spark.read.schema("o_orderkey BIGINT, o_orderstatus STRING").parquet(path)


@query(
    "file_inventory",
    "SELECT event_type, true AS listed FROM events GROUP BY event_type",
)
def file_inventory(spark, sf_dir):
    # a folder per type and a listing of its files, oldest first, contents unread
    path = work_dir(spark, "inventory")
    files.write_per_value(events(spark, sf_dir).select("event_id", "event_type"), path, "event_type")
    found = files.inventory(spark, path, "*.parquet", depth=2)
    folder = F.regexp_extract("path", r"event_type=([^/]+)/", 1).alias("event_type")
    dated = F.col("modificationTime").isNotNull() & (F.col("length") > 0)
    return found.groupBy(folder).agg(F.bool_and(dated).alias("listed"))


@query(
    "object_roundtrip",
    "SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name AS content, (SELECT count(*) FROM supplier) AS n_objects FROM supplier",
)
def object_roundtrip(spark, sf_dir):
    # one object up per supplier, the objects counted, and down again
    store = work_dir(spark, "objects")
    names = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    files.put_text_objects(names, store, "s_suppkey", "s_name")
    objects = files.read_objects(spark, store, "*.txt")
    number = F.regexp_extract("path", "s_suppkey=([0-9]+)/", 1).cast("bigint")
    return objects.select(
        number.alias("s_suppkey"), F.regexp_replace(F.col("content").cast("string"), "\n$", "").alias("content"),
        F.lit(objects.count()).cast("bigint").alias("n_objects"),
    )


@query(
    "upsert_latest",
    """
    SELECT strftime(ts, '%Y-%m-%dT%H:%M') AS doc_id, arg_max(event_id, (ts, event_id)) AS event_id,
           arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts
    FROM events GROUP BY 1
    """,
)
def upsert_latest(spark, sf_dir):
    index = BucketedIndex(spark, work_dir(spark, "index"), ["doc_id"], ["ts", "event_id"], buckets=8)
    rows = events(spark, sf_dir).select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("doc_id"), "event_id", "event_type", "ts"
    )
    # two batches, the second one delivered twice
    odd = F.col("event_id") % 2 == 1
    index.upsert(rows.where(odd), 0)
    index.upsert(rows.where(~odd), 1)
    index.upsert(rows.where(~odd), 1)
    return index.read()


@query(
    "upsert_twenty_batches",
    """
    SELECT strftime(ts, '%Y-%m-%dT%H') AS doc_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts
    FROM events GROUP BY 1
    """,
)
def upsert_twenty_batches(spark, sf_dir):
    # buckets are merged whenever they hold more than three runs; half-way old runs are deleted
    index = BucketedIndex(spark, work_dir(spark, "index"), ["doc_id"], ["ts", "event_id"], buckets=8, most_runs=3)
    rows = events(spark, sf_dir).select(
        F.date_format("ts", "yyyy-MM-dd'T'HH").alias("doc_id"), "event_id", "ts"
    )
    for n in range(20):
        index.upsert(rows.where(F.col("event_id") % 20 == n), n)
        if n == 10:
            index.vacuum()
    return index.read()


@query(
    "log_after_marker",
    """
    WITH numbered AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS rn FROM documents),
    log AS (SELECT rn, doc_id || ' ' || CASE doc_id % 4 WHEN 0 THEN 'ERROR ' ELSE 'INFO ' END
                   || lang AS line FROM numbered JOIN documents USING (doc_id)),
    start AS (SELECT min(rn) AS rn FROM log WHERE contains(line, 'ERROR de'))
    SELECT line FROM log, start WHERE log.rn >= start.rn AND contains(line, 'ERROR')
    """,
)
def log_after_marker(spark, sf_dir):
    path = work_dir(spark, "log")
    level = F.when(F.col("doc_id") % 4 == 0, "ERROR").otherwise("INFO")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat_ws(" ", F.col("doc_id").cast("string"), level, "lang").alias("line")
    )
    lines.write_ordered_lines(docs, path, "line", ["doc_id"])
    log = lines.read_ordered_lines(spark, path)
    return lines.after_marker(log, "ERROR de", "ERROR").select("line")


@query(
    "marked_scenes",
    """
    SELECT scene_no, count(*) AS n FROM (
      SELECT *, CAST(sum(cut) OVER (ORDER BY ts, event_id) AS BIGINT) AS scene_no FROM (
        SELECT ts, event_id, CASE WHEN epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000
                 + CAST(round(value * 1000) AS BIGINT)) OVER (ORDER BY ts, event_id) >= 60000
               THEN 1 ELSE 0 END AS cut FROM events))
    GROUP BY scene_no
    """,
)
def marked_scenes(spark, sf_dir):
    # intervals over the whole table: one sequence without a key
    rows = events(spark, sf_dir)
    start = F.floor(clock.micros_of(rows, "ts")("ts") / 1000)
    blocks = rows.select(
        "ts", "event_id", start.alias("s"),
        (start + F.rint(F.col("value") * 1000).cast("bigint")).alias("e"),
    )
    grouped = sq.scenes(o.ordered(blocks, (), ["ts", "event_id"]), "s", "e", 60_000).df
    return grouped.groupBy("scene_no").agg(counted())
