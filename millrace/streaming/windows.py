"""Event-time windows and sessions on streams (and, for the same functions, on tables)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Names = Sequence[str] | str


def _list(names: Names) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def _seconds(length: int, step: int) -> tuple[str, str]:
    # Another step would give Spark's windows, which are not those of floor(ts / step).
    if step <= 0 or length % step:
        raise ValueError("the step must divide the window length")
    return f"{length} seconds", f"{step} seconds"


def event_windows(df: DataFrame, by: Names, ts: str, length: int, step: int | None = None) -> DataFrame:
    """Per key and window: ``n`` rows and ``n_times`` distinct event times.

    Rows are counted per event time first.  The windows then see each time once, so they
    need no set of times, sliding windows multiply the times and not the rows, and the
    second aggregation combines on the map side.  On a stream the first step also drops
    rows behind the watermark whose window is still open.
    Lengths in seconds; without a step the windows tumble.
    """
    window = F.window(ts, *_seconds(length, step or length))
    times = df.groupBy(*_list(by), ts).agg(F.count(F.lit(1)).alias("_n"))
    return (
        times.groupBy(*_list(by), window.alias("w"))
        .agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("n_times"))
        .select(*_list(by), F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "n_times")
    )


def sessions(df: DataFrame, by: Names, ts: str, gap_seconds: int) -> DataFrame:
    """Sessions per key: a gap equal to the limit starts a new one.

    Spark would merge at exactly the gap, hence one microsecond less.
    """
    gap = f"{gap_seconds - 1} seconds 999 milliseconds 999 microseconds"
    return (
        df.groupBy(*_list(by), F.session_window(ts, gap).alias("s"))
        .agg(
            F.count(F.lit(1)).alias("n"), F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts")
        )
        .select(*_list(by), "n", "start_ts", "end_ts")
    )


def dedupe_within(df: DataFrame, keys: Names) -> DataFrame:
    """First row per key within the watermark; the state is given up with it."""
    return df.dropDuplicatesWithinWatermark(_list(keys))


def match_replies(
    requests: DataFrame,
    replies: DataFrame,
    request_key: str,
    reply_key: str,
    request_ts: str,
    reply_ts: str,
    timeout: str,
) -> DataFrame:
    """Requests with the reply that came within the timeout; without one after it.

    Both sides carry a watermark, so the join forgets a request once its time is over.
    """
    in_time = (F.col(reply_ts) >= F.col(request_ts)) & (
        F.col(reply_ts) <= F.col(request_ts) + F.expr(f"INTERVAL {timeout}")
    )
    return requests.join(
        replies, (F.col(request_key) == F.col(reply_key)) & in_time, "left_outer"
    )
