"""Operators that carry values from one micro-batch to the next."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.functions.time import micros_of
from millrace.operators import latest
from millrace.operators import ordered as o
from millrace.operators.ordered import Ordered
from millrace.streaming.runs import BATCH, Folder
from millrace.streaming.timed import pack, unpack

MICROS = 1_000_000
FRESH = "_fresh"


@dataclass(frozen=True)
class CarriedScan:
    """An ordered scan that goes on from one micro-batch to the next.

    A batch is scanned together with the rows carried from the batch before, which come
    first in the order; ``scan`` adds its columns, ``carry`` picks the rows (one per key,
    say) that the next batch needs.  Inside a batch heavy keys are cut into blocks as in
    any ordered scan.  Carried rows are stored under the number of their batch, so a
    repeated batch starts from the same ones and writes the same result.
    """

    folder: Folder
    by: Sequence[str]
    order_by: Sequence[str]
    scan: Callable[[Ordered], Ordered]
    carry: Callable[[DataFrame], DataFrame]

    def _carried_path(self, batch_id: int) -> str:
        return f"{self.folder.path}/carried/{BATCH}={batch_id}"

    def writer(self, stream: DataFrame) -> DataStreamWriter:
        def process(batch: DataFrame, batch_id: int) -> None:
            spark, columns = batch.sparkSession, batch.columns
            kept = batch.persist()  # read by the scan's passes and by the carry
            try:
                rows = kept.withColumn(FRESH, F.lit(1))
                if batch_id > 0:
                    past = spark.read.schema(batch.schema).parquet(self._carried_path(batch_id - 1))
                    rows = rows.unionByName(past.withColumn(FRESH, F.lit(0)))
                seq = self.scan(o.ordered(rows, self.by, [FRESH, *self.order_by]))
                seq.where(F.col(FRESH) == 1).df.drop(FRESH).write.mode("overwrite").parquet(
                    f"{self.folder.output}/{BATCH}={batch_id}"
                )
                self.carry(rows).select(*columns).write.mode("overwrite").parquet(
                    self._carried_path(batch_id)
                )
            finally:
                kept.unpersist()

        return stream.writeStream.option(
            "checkpointLocation", self.folder.checkpoint
        ).foreachBatch(process)


def late_filter(
    folder: Folder, by: Sequence[str], arrival: Sequence[str], ts: str, delay_seconds: int
) -> CarriedScan:
    """Drop rows older than the newest time so far, in arrival order, minus a delay.

    The mark moves with every row, not once per micro-batch as a watermark does.  The row
    with the newest time of each key (of all, without keys) is carried.
    """

    def on_time(seq: Ordered) -> Ordered:
        micros = micros_of(seq.rows, ts)
        mark = micros("_top") - delay_seconds * MICROS
        return seq.add(_top=o.running_max(ts)).where(micros(ts) >= mark).drop("_top")

    def newest(rows: DataFrame) -> DataFrame:
        if by:
            return latest.newest_per(rows, list(by), [ts, *arrival])
        row = F.max_by(F.struct(*rows.columns), F.struct(ts, *arrival)).alias("r")
        return rows.agg(row).where("r IS NOT NULL").select("r.*")

    return CarriedScan(folder, by, arrival, on_time, newest)


def cache_outcomes(
    folder: Folder,
    key: str,
    order_by: Sequence[str],
    ts: str,
    is_update: Callable[[], Column],
    idle_seconds: int,
    update_idle_seconds: int,
    name: str = "outcome",
) -> CarriedScan:
    """``hit``, ``miss`` or ``update`` per row, by the access of the key before it.

    Reading renews the idle time; an update keeps the entry for its own idle time.  The
    last access per key is carried, as long as it is recent enough to still matter.
    """
    keep = max(idle_seconds, update_idle_seconds) * MICROS

    def judge(seq: Ordered) -> Ordered:
        seq = seq.with_columns(_u=is_update()).add(_pt=o.lag(ts), _pu=o.lag("_u"))
        allowed = F.when(F.col("_pu"), F.lit(update_idle_seconds)).otherwise(F.lit(idle_seconds))
        micros = micros_of(seq.rows, ts)
        idle = micros(ts) - micros("_pt")
        hit = F.coalesce(idle < allowed.cast("bigint") * MICROS, F.lit(False))
        outcome = F.when(F.col("_u"), "update").when(hit, "hit").otherwise("miss")
        return seq.with_columns(**{name: outcome}).drop("_u", "_pt", "_pu")

    def last_access(rows: DataFrame) -> DataFrame:
        # older than the idle time before the newest of all: a miss in any case,
        # because rows arrive in time order
        newest = rows.agg(F.max(ts).alias("_now"))
        last = latest.newest_per(rows, key, list(order_by)).join(F.broadcast(newest))
        micros = micros_of(rows, ts)
        return last.where(micros("_now") - micros(ts) <= keep).drop("_now")

    return CarriedScan(folder, [key], order_by, judge, last_access)


@dataclass(frozen=True)
class RunningCounts:
    """Counts per key that can be read at any time, as a log of their changes.

    Each batch adds the new totals of the keys it touched; the newest total of a key is
    its current value.
    """

    folder: Folder
    key: str

    def writer(self, stream: DataFrame) -> DataStreamWriter:
        counts = stream.groupBy(self.key).agg(F.count(F.lit(1)).alias("n"))

        def append(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.folder.output}/{BATCH}={batch_id}")

        return (
            counts.writeStream.outputMode("update")
            .option("checkpointLocation", self.folder.checkpoint)
            .foreachBatch(append)
        )

    def changes(self) -> DataFrame:
        return self.folder.spark.read.parquet(self.folder.output)

    def current(self) -> DataFrame:
        return latest.newest_per(self.changes(), self.key, BATCH).drop(BATCH)


@dataclass(frozen=True)
class LiveCounts:
    """Counts per key that can be read at any time from the state of the stream itself.

    Nothing is written besides the checkpoint; reading takes the last batch that was committed, one
    row per key, while the stream runs or after it has stopped.
    """

    folder: Folder
    key: str

    def writer(self, stream: DataFrame) -> DataStreamWriter:
        counts = stream.groupBy(self.key).agg(F.count(F.lit(1)).alias("n"))
        return (
            counts.writeStream.outputMode("update")
            .option("checkpointLocation", self.folder.checkpoint)
            .format("noop")
        )

    def current(self) -> DataFrame:
        state = self.folder.spark.read.format("statestore").load(self.folder.checkpoint)
        return state.select(f"key.`{self.key}`", F.col("value.count").alias("n"))


def fold_until_idle(
    stream: DataFrame,
    key: str,
    ts: str,
    spread_by: str,
    zero: tuple,
    state_schema: str,
    step: Callable[[tuple, pd.DataFrame], tuple],
    idle_ms: int,
    spread: int = 8,
    buckets: int = 32,
) -> DataFrame:
    """A user fold per key; its result comes out when the key has been idle, and at the end.

    A key is idle when the watermark is ``idle_ms`` past its own newest event time.  That time
    is part of the state, so a key that goes on in a later batch starts its idle time anew.

    ``step`` folds the rows that a key has in one Arrow batch into its state, so a key's rows are
    never held together.  Each key is spread over several states by a hash of ``spread_by``, so one
    heavy key does not wait for one task: the results are partial folds per (key, spread),
    to be merged by a plain aggregate.  ``step`` must not depend on the order of rows.
    The stream needs a watermark.

    Keys share ``buckets``; the state of a bucket is one packed table, so that what a batch costs
    besides the steps does not go by the keys.
    """
    key_type = stream.select(key).schema[0].dataType.simpleString()
    names = [f.split(" ")[0] for f in state_schema.split(", ")]
    helpers = ["_bucket", "_spread", "_ms"]

    def fold(
        group: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        held = unpack(state.get[0]) if state.exists else None
        now, met = {}, []
        if held is not None:
            now = {k: tuple(v) for k, *v in zip(*(held[c].tolist() for c in [key, *names, "_newest"]), strict=True)}
        for rows in () if state.hasTimedOut else batches:
            codes, keys = pd.factorize(rows[key], use_na_sentinel=False)
            order = codes.argsort(kind="stable")
            newest = rows["_ms"].fillna(0).astype("int64").to_numpy()[order]
            rows = rows.drop(columns=helpers).iloc[order]
            ends = np.cumsum(np.bincount(codes, minlength=len(keys))).tolist()
            keys = [None if pd.isna(k) else k for k in keys.tolist()]
            for k, first, last in zip(keys, [0, *ends], ends, strict=False):
                *value, latest_ms = now.get(k, (*zero, 0))
                now[k] = (*step(tuple(value), rows.iloc[first:last]), max(latest_ms, int(newest[first:last].max())))
            met += keys
        met = set(met)
        done = [k for k, v in now.items() if v[-1] + idle_ms < mark and k not in met]
        if done:
            columns = zip(*(now[k][:-1] for k in done), strict=True)
            yield pd.DataFrame({key: done, **dict(zip(names, columns, strict=True))})
        for k in done:
            del now[k]
        if now:
            columns = zip(*now.values(), strict=True)
            state.update((pack(pd.DataFrame({key: list(now), **dict(zip([*names, "_newest"], columns, strict=True))})),))
            # a timeout must lie past the watermark
            state.setTimeoutTimestamp(max(min(v[-1] for v in now.values()) + idle_ms, mark + 1))
        elif state.exists:
            state.remove()

    # rows without a key are apart, so that the keys of a bucket keep their type
    bucket = F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    salted = stream.withColumns({
        "_bucket": bucket, "_spread": F.pmod(F.xxhash64(spread_by), F.lit(spread)).cast("int"), "_ms": F.unix_millis(ts),
    })
    return salted.groupBy("_bucket", "_spread").applyInPandasWithState(
        fold, f"{key} {key_type}, {state_schema}", "states BINARY", "append",
        GroupStateTimeout.EventTimeTimeout,
    )
