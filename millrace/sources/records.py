"""Text record formats: subtitles, line protocol points, HL7 segments, embedded documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import messages
from millrace.functions.text import file_ending
from millrace.functions.time import clock_ms, clock_text
from millrace.operators import ordered as o
from millrace.sources.lines import write_ordered_lines

# Fixed values of the subtitle format.
RANGE_MARK = " --> "
BLOCK_END = "\n\n"

# Fixed values of the point line: names end at a comma, equals sign or blank unless a backslash
# stands before it; text fields stand in quotes, with quotes and backslashes escaped.
NAME = r"[^\\,= ]*+(?:\\.[^\\,= ]*+)*+"
SERIES = r"(?=[^, ])[^\\, ]*+(?:\\.[^\\, ]*+)*+"
TEXT_FIELD = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
TAG = f",{NAME}={NAME}"
BARE = r"[^\\,= \r\n]*+(?:\\.[^\\,= \r\n]*+)*+"  # a line end ends the line
FIELD = f"{NAME}=(?:{TEXT_FIELD}|{BARE})"
POINT = rf"(?s)^({SERIES})((?:{TAG})*+) ({FIELD}(?:,{FIELD})*+)(?: (-?\d+))?\s*$"


def subtitle_blocks(raw: DataFrame, block: str = "value") -> DataFrame:
    """Block texts to ``start`` and ``end`` (ms of the day) and ``lines``.

    The number in a block's head is not used; texts that are no block are dropped.
    """
    others = [c for c in raw.columns if c != block]
    split = F.filter(F.split(F.regexp_replace(block, "\r", ""), "\n"), lambda t: t != "")
    rows, times = F.col("_rows"), F.col("_times")
    return (
        raw.select(*others, split.alias("_rows"))
        .withColumn("_times", F.split(F.get(rows, F.lit(1)), RANGE_MARK))
        .select(
            *others,
            clock_ms(F.get(times, F.lit(0))).alias("start"),
            clock_ms(F.get(times, F.lit(1))).alias("end"),
            F.when(F.size(rows) > 2, F.slice(rows, F.lit(3), F.size(rows)))
            .otherwise(F.array().cast("array<string>"))
            .alias("lines"),
        )
        .where(F.col("start").isNotNull() & F.col("end").isNotNull())
    )


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """Blocks are separated by a blank line; big files are split between tasks."""
    return subtitle_blocks(spark.read.option("lineSep", BLOCK_END).text(path))


def subtitle_text(number: Column, start: Column, end: Column, lines: Column) -> Column:
    times = F.concat(clock_text(start), F.lit(RANGE_MARK), clock_text(end))
    return F.concat_ws("\n", number.cast("string"), times, F.array_join(lines, "\n"), F.lit(""))


def write_subtitles(df: DataFrame, path: str, order_by: list[str]) -> None:
    """Numbered blocks from 1, in order over the part files."""
    numbered = o.ordered(df, (), order_by).add(_no=o.index()).df
    block = subtitle_text(F.col("_no") + 1, F.col("start"), F.col("end"), F.col("lines"))
    write_ordered_lines(numbered.withColumn("_block", block), path, "_block", ["_no"])


def points(lines: DataFrame, line: str = "line") -> DataFrame:
    """Point lines to ``measurement``, ``tags`` and ``fields`` (maps of text) and ``at``.

    Escapes are undone, the quotes of a text field and the ``i`` of an integer are removed.
    Of a repeated tag or field the last one counts.
    Lines that are no point keep a null measurement.
    """
    part = lambda i: F.regexp_extract(line, POINT, i)
    others = [c for c in lines.columns if c != line]
    split = lambda text, item: F.regexp_extract_all(text, F.lit(f"(?s){item}"), F.lit(0))
    rows = lines.select(
        *others,
        F.nullif(part(1), F.lit("")).alias("_series"),
        _entries(split(part(2), TAG), _plain_name).alias("_tags"),
        _entries(split(F.concat(F.lit(","), part(3)), f",{FIELD}"), _field_value).alias("_fields"),
        F.nullif(part(4), F.lit("")).try_cast("bigint").alias("at"),
    )
    is_point = F.col("_series").isNotNull()
    return rows.select(
        *others,
        _plain_name(F.col("_series")).alias("measurement"),
        F.when(is_point, _last_entries("_tags")).alias("tags"),
        F.when(is_point, _last_entries("_fields")).alias("fields"),
        "at",
    )


def _plain_name(name: Column) -> Column:
    return F.regexp_replace(name, r"\\([,= \\])", "$1")


def _field_value(value: Column) -> Column:
    text = F.regexp_replace(F.substring(value, F.lit(2), F.length(value) - 2), r'\\(["\\])', "$1")
    whole = F.rlike(value, F.lit(r"^-?\d+i$"))
    return (
        F.when(F.startswith(value, F.lit('"')), text)
        .when(whole, F.regexp_replace(value, "i$", ""))
        .otherwise(_plain_name(value))
    )


def _entries(items: Column, value_of: Callable[[Column], Column]) -> Column:
    """Items ``,name=value`` as structs of key and value."""

    def entry(item: Column) -> Column:
        name = F.regexp_extract(item, f"(?s)^,({NAME})=", 1)
        value = F.substring(item, F.length(name) + 3, F.length(item))
        return F.struct(_plain_name(name).alias("key"), value_of(value).alias("value"))

    return F.transform(items, entry)


def _last_entries(entries: str) -> Column:
    keys, n = F.col(entries)["key"], F.size(entries)
    is_last = lambda e, i: F.array_position(F.slice(keys, i + 2, n), e["key"]) == 0
    return F.map_from_entries(F.filter(entries, is_last))


def point_line(
    measurement: Column, tags: dict[str, Column], fields: dict[str, Column], at: Column | None = None
) -> Column:
    """A point as a line; separators in names and tags are escaped, null tags left out.

    Integer columns must be given with their ``i`` by ``integer_field``, texts in their quotes
    by ``text_field``.  A backslash is escaped as well, so that ``points`` gives back the same.
    """
    escaped = lambda c: F.regexp_replace(c.cast("string"), r"[,= \\]", r"\\$0")
    name = lambda k: F.concat(escaped(F.lit(k)), F.lit("="))
    listed = [F.concat(name(k), escaped(v)) for k, v in tags.items()]
    head = F.concat_ws(",", escaped(measurement), *listed)
    values = F.concat_ws(",", *[F.concat(name(k), v.cast("string")) for k, v in fields.items()])
    return F.concat_ws(" ", head, values, *([at.cast("string")] if at is not None else []))


def text_field(value: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(value, r'["\\]', r"\\$0"), F.lit('"'))


def integer_field(value: Column) -> Column:
    return F.concat(value.cast("bigint").cast("string"), F.lit("i"))


def change_events(table: DataFrame, json: str, name: str = "change") -> DataFrame:
    """The JSON column replaced by the change event in it; parsed once per row."""
    raw = table.withColumn("_raw", messages.raw_change(json)).drop(json)
    return raw.withColumn(name, messages.change_event(F.col("_raw"))).drop("_raw")


def hl7_segments(table: DataFrame, key: str, message: str) -> DataFrame:
    """A message table to a segment table.

    ``place`` is the 0-based place in the message, ``occurrence`` counts the segments of
    one name from 1, so that the second OBX is (OBX, 2).  The segments of a message are sorted
    by name and place in its own array, where a name starts at one place: no shuffle, and each
    segment row carries one entry per name of its message.
    """
    # one projection per step: inside a lambda an expression would be made per element
    cut = table.select(key, messages.segments(message).alias("_all"))
    entry = lambda s, i: F.struct(F.substring(s, 1, 3).alias("name"), i.alias("place"), s.alias("segment"))
    cut = cut.select(key, F.array_sort(F.transform("_all", entry)).alias("_sorted"))
    cut = cut.withColumn("_names", F.col("_sorted")["name"])
    starts = F.transform(
        F.array_distinct("_names"), lambda n: F.struct(n, F.array_position(F.col("_names"), n).cast("int"))
    )
    cut = cut.select(key, "_sorted", F.map_from_entries(starts).alias("_starts"))
    rows = cut.select(key, "_starts", F.posexplode("_sorted").alias("_at", "_s"))
    return rows.select(
        key,
        F.col("_s")["place"].alias("place"),
        F.col("_s")["name"].alias("name"),
        (F.col("_at") + 2 - F.element_at("_starts", F.col("_s")["name"])).alias("occurrence"),
        F.col("_s")["segment"].alias("segment"),
    )


def hl7_acknowledge(table: DataFrame, key: str, message: str) -> DataFrame:
    """One reply row per message: AA for a readable one, AE with the reason otherwise."""
    table = table.withColumn("_header", F.get(messages.segments(message), F.lit(0)))
    header = F.col("_header")
    control = F.nullif(messages.field(header, 10), F.lit(""))
    version = F.nullif(messages.field(header, 12), F.lit(""))
    error = (
        F.when(header.isNull(), "message is empty")
        .when(~F.startswith(header, F.lit("MSH")), "message does not start with MSH")
        .when(control.isNull(), "control id is missing")
        .when(version.isNull(), "version is missing")
    )
    code = F.when(error.isNull(), "AA").otherwise("AE")
    return table.select(
        key,
        control.alias("control_id"),
        version.alias("version"),
        code.alias("code"),
        error.alias("error"),
        F.concat_ws("|", F.lit("MSA"), code, F.coalesce(control, F.lit(""))).alias("reply"),
    )


EMBEDDED = "_id STRING, _mediaType STRING, _VALUE STRING"


def _decoded(rows: DataFrame, keys: list[str], doc: str) -> DataFrame:
    d = lambda f: F.col(f"{doc}.{f}" if doc else f)
    return rows.select(
        *keys,
        d("_id").alias("id"),
        d("_mediaType").alias("media_type"),
        file_ending(d("_mediaType")).alias("ending"),
        F.unbase64(F.regexp_replace(d("_VALUE"), r"\s", "")).alias("content"),
    )


def read_embedded_documents(spark: SparkSession, path: str, row_tag: str = "embeddedDoc") -> DataFrame:
    """Base64 documents in XML files: ``media_type``, file ``ending`` and binary ``content``."""
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(EMBEDDED).load(path)
    return _decoded(rows, [], "")


def embedded_documents(messages_table: DataFrame, key: str, xml: str, row_tag: str = "embeddedDoc") -> DataFrame:
    """The same for a table of XML messages; ``number`` counts the documents of a message from 1."""
    parsed = F.from_xml(F.col(xml), f"{row_tag} ARRAY<STRUCT<{_fields(EMBEDDED)}>>")
    exploded = messages_table.select(key, F.posexplode(parsed[row_tag]).alias("_n", "_d"))
    numbered = exploded.withColumn("number", F.col("_n") + 1)
    return _decoded(numbered, [key, "number"], "_d")


def _fields(ddl: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (f.split(" ") for f in ddl.split(", ")))
