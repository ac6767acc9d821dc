"""State with timers: sessions closed by a timer, replies matched by order.

Both need event time with a watermark, and state stores that can hold several kinds of state
(``stores``).  Keys share buckets: a bucket has one timer and its state as packed tables, which are
worked on for all its keys at once, so the calls to the state store go by the buckets and not by
keys or rows.  A bucket's state lives in one task; what is kept of a session does not grow with it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import AbstractContextManager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.streaming.runs import setting

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 64


def stores(spark: SparkSession) -> AbstractContextManager[None]:
    """The session setting that queries of this module must be started under."""
    return setting(spark, PROVIDER, ROCKS)


def pack(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


def joined(parts: Sequence[pd.DataFrame]) -> pd.DataFrame:
    """The parts that have rows as one table; the first part if none has."""
    full = [p for p in parts if len(p)]
    return pd.concat(full, ignore_index=True) if full else parts[0]


def codes_of(key: pd.Series) -> np.ndarray:
    return pd.factorize(key, use_na_sentinel=False)[0]


def _ms(micros):
    """The first millisecond that is not before ``micros``."""
    return -(-micros // 1000)


def _stamp(micros: np.ndarray) -> pd.Series:
    return pd.to_datetime(pd.Series(micros, dtype="int64"), unit="us")


def _keyed(stream: DataFrame, key: str, ts: str, buckets: int) -> DataFrame:
    """Rows with a key and a time, and their bucket.  One condition over both, since a condition on the
    key alone would be moved before the watermark, which then would not see rows without a key."""
    kept = stream.where(F.when(F.col(ts).isNotNull(), F.col(key).isNotNull()))
    return kept.withColumns({"bucket": F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"), "micros": F.unix_micros(ts)})


class _Timer:
    """The one timer of a bucket, at the earliest of what is due in it; 0 is none."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.handle, self.at = handle, handle.getValueState("timer", "at BIGINT")

    def get(self) -> int:
        return self.at.get()[0] if self.at.exists() else 0

    def set(self, before: int, timer: int) -> None:
        """In place of ``before``, which is 0 if it has gone off."""
        if before != timer:
            if before:
                self.handle.deleteTimer(before)
            if timer:
                self.handle.registerTimer(timer)
        if timer:
            self.at.update((timer,))
        else:
            self.at.clear()


def spans_of(spans: pd.DataFrame, key: str, gap: int) -> pd.DataFrame:
    """Spans (key, first, last, n) of which those of a key that are nearer than the gap became one."""
    spans = spans.iloc[np.lexsort((spans["first"], codes_of(spans[key])))].reset_index(drop=True)
    codes = codes_of(spans[key])  # now in ascending order
    first, last = spans["first"].to_numpy(), spans["last"].to_numpy()
    # times by their rank, so that the running maximum can start anew with every key
    times, rank = np.unique(last, return_inverse=True)
    reach = times[np.maximum.accumulate(codes * len(times) + rank) - codes * len(times)]
    start = np.ones(len(spans), bool)
    start[1:] = (codes[1:] != codes[:-1]) | (first[1:] - reach[:-1] >= gap)
    at = np.flatnonzero(start)
    return pd.DataFrame({
        key: spans[key].to_numpy()[at], "first": first[at], "last": np.maximum.reduceat(last, at),
        "n": np.add.reduceat(spans["n"].to_numpy(), at),
    })


class _Sessions(StatefulProcessor):
    """Open sessions of a bucket: key, first time, last time and rows of each."""

    def __init__(self, key: str, gap: int):
        self.key, self.gap = key, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "spans BINARY")
        self.timer = _Timer(handle)

    def _keep(self, spans: pd.DataFrame, before: int) -> None:
        if len(spans):
            self.open.update((pack(spans),))
        else:
            self.open.clear()
        self.timer.set(before, _ms(int(spans["last"].min()) + self.gap) if len(spans) else 0)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        spans = [unpack(self.open.get()[0])] if self.open.exists() else []
        for part in rows:  # rows of a part become spans before they meet the open sessions
            if len(part):
                micros = part["micros"].astype("int64")
                single = pd.DataFrame({self.key: part[self.key], "first": micros, "last": micros, "n": 1})
                spans.append(spans_of(single, self.key, self.gap))
        if spans:
            self._keep(spans_of(joined(spans), self.key, self.gap), self.timer.get())
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        spans = unpack(self.open.get()[0])
        over = _ms(spans["last"] + self.gap) <= timerValues.getCurrentWatermarkInMs()
        self._keep(spans[~over], 0)
        done = spans[over].reset_index(drop=True)
        if len(done):
            yield pd.DataFrame({
                self.key: done[self.key], "n": done["n"], "start_ts": _stamp(done["first"].to_numpy()),
                "end_ts": _stamp(done["last"].to_numpy()),
            })

    def close(self) -> None:
        pass


def sessions(stream: DataFrame, key: str, ts: str, gap_seconds: int, buckets: int = BUCKETS) -> DataFrame:
    """``key, n, start_ts, end_ts`` of each session, when the watermark has passed its last time by
    the gap; a gap equal to the limit starts a new session.  Rows without a time or key are
    left out.

    Rows may come in any order inside the watermark's delay, so a key can have several open
    sessions, which a late row may join.  The state has a row for each open session.
    """
    kind = stream.schema[key].dataType.simpleString()
    rows = _keyed(stream, key, ts, buckets).select("bucket", key, ts, "micros")
    return rows.groupBy("bucket").transformWithStateInPandas(
        _Sessions(key, gap_seconds * 1_000_000),
        f"`{key}` {kind}, n BIGINT, start_ts TIMESTAMP, end_ts TIMESTAMP", "append", "eventTime",
    )


class _InOrder(StatefulProcessor):
    """Rows of a bucket's channels wait until the watermark has passed them, then are taken in their order.

    ``waiting`` has parts of rows that are not in order yet, ``asked`` the open requests and ``told``
    the replies whose request has not come, both by number; ``counts`` numbers the rows of each channel.
    """

    def __init__(self, channel: str, timeout: int):
        self.channel, self.timeout = channel, timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "rows BINARY")
        self.open = handle.getValueState("open", "asked BINARY, told BINARY, counts BINARY")
        self.timer = _Timer(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before, earliest = self.timer.get(), []
        for part in rows:
            if len(part):
                self.waiting.appendValue((pack(part[[self.channel, "micros", "reply", "row_id"]]),))
                # a row is in order once nothing of its time can come: the watermark is past it
                earliest.append(_ms(int(part["micros"].min()) + 1))
        if earliest:
            self.timer.set(before, min([before or earliest[0], *earliest]))
        yield from ()

    def _numbered(self, rows: pd.DataFrame, counts: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        """The rows in order with their number ``n`` on their side, going on from the counts, and the new counts."""
        rows = rows.drop_duplicates().sort_values(["micros", "reply", "row_id"])
        rows = rows.merge(counts, on=self.channel, how="left").fillna({"requests": 0, "replies": 0})
        base = np.where(rows["reply"], rows["replies"], rows["requests"]).astype("int64")
        rows["n"] = base + rows.groupby([self.channel, "reply"], sort=False, dropna=False).cumcount().to_numpy()
        new = rows.groupby(self.channel, sort=False, dropna=False)["reply"].agg(["size", "sum"]).reset_index()
        new = pd.DataFrame({self.channel: new[self.channel], "requests": new["size"] - new["sum"], "replies": new["sum"]})
        total = joined([counts, new]).groupby(self.channel, sort=False, dropna=False).sum().astype("int64").reset_index()
        return rows[[self.channel, "n", "row_id", "micros", "reply"]], total

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, side = timerValues.getCurrentWatermarkInMs(), [self.channel, "n", "row_id", "micros"]
        parts = [unpack(data) for (data,) in self.waiting.get()] if self.waiting.exists() else []
        waiting = joined(parts) if parts else None
        asked, told, counts = (unpack(data) for data in self.open.get()) if self.open.exists() else (None, None, None)
        if waiting is not None:
            ready = _ms(waiting["micros"] + 1) <= now
            rows, waiting = waiting[ready], waiting[~ready]
            if counts is None:
                counts = rows[[self.channel]].iloc[:0].assign(requests=np.int64(0), replies=np.int64(0))
                asked = told = rows.iloc[:0].assign(n=np.int64(0))[side]
            if len(rows):
                rows, counts = self._numbered(rows, counts)
                asked = joined([asked, rows.loc[~rows["reply"], side]])
                told = joined([told, rows.loc[rows["reply"], side]])
                self.waiting.clear()
                if len(waiting):
                    self.waiting.put([(pack(waiting),)])
        replies = told.rename(columns={"row_id": "reply_id", "micros": "reply_micros"})
        replies["reply_id"] = replies["reply_id"].astype("Int64")
        replies["reply_micros"] = replies["reply_micros"].astype("Int64")
        pairs = asked.merge(replies, on=[self.channel, "n"], how="left")
        come = pairs["reply_id"].notna().to_numpy()
        # a request whose time is over has its failure row now; its reply, if one comes, finds none
        over = (_ms(pairs["micros"] + self.timeout + 1) <= now).to_numpy()
        wait = (pairs["reply_micros"] - pairs["micros"]).where(come)
        ok = ((wait >= 0) & (wait <= self.timeout)).fillna(False).to_numpy(dtype=bool)
        left = pairs.loc[~come & ~over, side]
        # replies are kept for requests that have not come
        told = told.merge(counts, on=self.channel, how="left")
        told = told.loc[told["n"] >= told["requests"], side]
        self.open.update((pack(left), pack(told), pack(counts)))
        due = [_ms(int(left["micros"].min()) + self.timeout + 1)] if len(left) else []
        if waiting is not None and len(waiting):
            due.append(_ms(int(waiting["micros"].min()) + 1))
        self.timer.set(0, min(due, default=0))
        out = come | over
        if out.any():
            done = pairs[out]
            yield pd.DataFrame({
                self.channel: done[self.channel], "n": done["n"], "request_id": done["row_id"],
                "reply_id": done["reply_id"].where(ok[out]), "outcome": np.where(ok[out], "answered", "timeout"),
            })

    def close(self) -> None:
        pass


def match_in_order(
    stream: DataFrame, channel: str, ts: str, row_id: str, is_reply: str, timeout_seconds: int, buckets: int = BUCKETS
) -> DataFrame:
    """``channel, n, request_id, reply_id, outcome`` of each request, as ``joins.match_in_order``
    finds them in the order of time, requests before replies, and id.

    Requests and replies are rows of one stream, told apart by the flag.  A row waits until the
    watermark has passed it, so rows may come in any order inside the delay.  A request without a
    reply in time comes out by a timer.  Rows without a time or channel are left out.
    """
    kind = stream.schema[channel].dataType.simpleString()
    rows = _keyed(stream, channel, ts, buckets).select(
        "bucket", channel, ts, "micros", F.col(row_id).cast("bigint").alias("row_id"),
        F.coalesce(F.col(is_reply), F.lit(False)).alias("reply"),
    )
    return rows.groupBy("bucket").transformWithStateInPandas(
        _InOrder(channel, timeout_seconds * 1_000_000),
        f"`{channel}` {kind}, n BIGINT, request_id BIGINT, reply_id BIGINT, outcome STRING", "append", "eventTime",
    )
