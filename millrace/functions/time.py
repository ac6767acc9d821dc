"""Time columns: epoch conversions, time of day in milliseconds, flooring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

MS_PER_HOUR = 3_600_000
MS_PER_MINUTE = 60_000
MS_PER_SECOND = 1_000
MICROS_PER_DAY = 86_400_000_000
MICROS_PER_MINUTE = 60_000_000
UTC_NAMES = ("UTC", "Etc/UTC", "GMT", "Etc/GMT", "Z", "+00:00")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clock_ms(text: Column | str) -> Column:
    """``HH:mm:ss,SSS`` to milliseconds of the day; null if it is not such a time."""
    part = lambda i: F.nullif(
        F.regexp_extract(_col(text), r"^\s*(\d{2}):(\d{2}):(\d{2}),(\d{3})\s*$", i), F.lit("")
    ).cast("bigint")
    return (
        part(1) * MS_PER_HOUR + part(2) * MS_PER_MINUTE + part(3) * MS_PER_SECOND + part(4)
    )


def clock_text(ms: Column | str) -> Column:
    """Milliseconds of the day to ``HH:mm:ss,SSS``."""
    m = _col(ms)
    two = lambda c: F.lpad(c.cast("bigint").cast("string"), 2, "0")
    return F.concat(
        two(F.floor(m / MS_PER_HOUR)),
        F.lit(":"),
        two(F.floor(m / MS_PER_MINUTE) % 60),
        F.lit(":"),
        two(F.floor(m / MS_PER_SECOND) % 60),
        F.lit(","),
        F.lpad((m % MS_PER_SECOND).cast("string"), 3, "0"),
    )


def ms_of_day(ts: Column | str) -> Column:
    t = _col(ts)
    whole = (F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)).cast("bigint") * MS_PER_SECOND
    return whole + F.date_format(t, "SSS").cast("bigint")


def floor_to(value: Column | str, step: int) -> Column:
    """Largest multiple of ``step`` not above the value (also below zero)."""
    v = _col(value)
    return v - F.pmod(v, F.lit(step))


def epoch_micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a TIMESTAMP; a TIMESTAMP_NTZ is read in the session zone."""
    return F.unix_micros(_col(ts).cast("timestamp"))


def wall_micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ as if its clock ran in UTC, in any session zone."""
    t = _col(ts)
    days = F.unix_date(t.cast("date")).cast("bigint")
    minutes = F.hour(t) * 60 + F.minute(t)
    micros = (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("bigint")
    return days * MICROS_PER_DAY + minutes.cast("bigint") * MICROS_PER_MINUTE + micros


def micros_of(df: DataFrame, column: str) -> Callable[[Column | str], Column]:
    """How to turn values of a time column into microseconds, in time order.

    Times without a zone must not pass through a zone with clock changes; where the
    session zone is UTC the plain cast is the same and much cheaper.
    """
    if not isinstance(df.schema[column].dataType, TimestampNTZType):
        return epoch_micros
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    return epoch_micros if zone in UTC_NAMES else wall_micros


def slot_start(ts: str, width: str) -> Column:
    """Start of the time slot of a time column; rows without a time get a null slot and stay."""
    # F.window drops rows whose time is null, so it is given another time for them
    some_time = F.coalesce(F.col(ts), F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"))
    return F.when(F.col(ts).isNotNull(), F.window(some_time, width)["start"])


def local_seconds(epoch_seconds: Column | str, zone: str = "UTC") -> Column:
    """Epoch seconds to the local date-time text ``yyyy-MM-ddTHH:mm:ss`` of a zone."""
    utc = F.timestamp_seconds(_col(epoch_seconds))
    return F.date_format(F.from_utc_timestamp(utc, zone), "yyyy-MM-dd'T'HH:mm:ss")
