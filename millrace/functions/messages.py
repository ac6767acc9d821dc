"""Change events in JSON and HL7 v2 message texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.numbers import number_in

# Fixed values of the message formats.
START_OF_BLOCK = "\x0b"
END_OF_BLOCK = "\x1c"
SEGMENT_END = "\r"
FIELD_SEPARATOR = "|"
REPETITION_SEPARATOR = "~"
COMPONENT_SEPARATOR = "^"
REFUSAL_CODES = "AE|AR|CE|CR"
SIZED_CHANGES = ("new", "edit")

CHANGE_SCHEMA = (
    "timestamp STRING, title STRING, server_name STRING, user STRING, type STRING, "
    "bot STRING, length STRUCT<new: STRING, old: STRING>"
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def raw_change(json: Column | str) -> Column:
    """The JSON of a change event with every field as text.

    Fields are cast one by one afterwards, so a wrong type in one does not null the others.
    """
    return F.from_json(_col(json), CHANGE_SCHEMA)


def change_event(raw: Column) -> Column:
    """A change event from its raw fields; absent or mistyped ones get their default.

    ``raw`` should be a column of its own (as ``records.change_events`` makes it): given
    the parsing expression itself, Spark may parse once per field.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    bot = F.coalesce(raw["bot"].try_cast("boolean"), F.lit(False))
    sized = text(raw["type"]).isin(*SIZED_CHANGES)
    size = lambda c: F.when(
        sized, F.coalesce(number_in(c, "int"), F.lit(0))
    ).otherwise(0)
    new, old = size(raw["length"]["new"]), size(raw["length"]["old"])
    return F.struct(
        F.coalesce(number_in(raw["timestamp"], "bigint"), F.lit(0)).alias("timestamp"),
        text(raw["title"]).alias("title"),
        text(raw["server_name"]).alias("server_name"),
        text(raw["user"]).alias("user"),
        text(raw["type"]).alias("cmd_type"),
        bot.alias("is_bot"),
        (bot & F.contains(F.lower(text(raw["user"])), F.lit("bot"))).alias("is_named_bot"),
        new.alias("length_new"),
        old.alias("length_old"),
        (new - old).alias("delta"),
    )


def unframe(message: Column | str) -> Column:
    """Strip the block characters of the transport frame."""
    body = F.ltrim(_col(message), F.lit(START_OF_BLOCK))
    return F.regexp_replace(body, "\\x1c\\r?$", "")


def frame(message: Column | str) -> Column:
    return F.concat(F.lit(START_OF_BLOCK), _col(message), F.lit(END_OF_BLOCK + "\r"))


def segments(message: Column | str) -> Column:
    """Array of the segment texts; line feeds count as segment ends too."""
    return F.filter(F.split(unframe(message), r"[\r\n]+"), lambda s: s != "")


def fields(segment: Column | str) -> Column:
    return F.split(_col(segment), r"\|")


def field(segment: Column | str, n: int) -> Column:
    """Field ``n`` as the standard counts: in the header the separator itself is field 1."""
    s = _col(segment)
    shift = F.when(F.startswith(s, F.lit("MSH")), F.lit(n)).otherwise(F.lit(n + 1))
    return F.try_element_at(fields(s), shift)


def refused(reply: Column | str) -> Column:
    """A reply counts as refused when a refusal code appears anywhere in it."""
    return F.rlike(_col(reply), F.lit(REFUSAL_CODES))


def stripped(message: Column | str) -> Column:
    """Segments without their trailing separators, put together without a separator."""
    bare = F.transform(segments(message), lambda s: F.regexp_replace(s, r"\|+$", ""))
    return F.array_join(bare, "")
