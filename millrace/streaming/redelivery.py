"""Messages that are delivered again until they are acknowledged."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from millrace.streaming.published import Published, batch_key
from millrace.streaming.runs import Folder

ATTEMPT, STATE = "attempt", "state"
ACKED, NACKED, DEAD = "acked", "nacked", "dead"


@dataclass(frozen=True)
class Redelivery:
    """A ledger of deliveries: the columns of a message, its ``attempt`` (from 1) and ``state``.

    A batch delivers its new messages together with those that the batch before it left nacked,
    one attempt further.  ``accept`` sees the messages with their attempt and says per row whether
    it is acknowledged (null: it is not).  A message that fails ``most`` attempts is ``dead``, and
    stays in the ledger for whoever looks after it.  ``accept`` is evaluated once per delivery,
    also if it is not repeatable: the ledger is written, published whole, and only then read.  A
    repeated batch finds itself published and changes nothing.  A batch costs what it delivers.
    """

    folder: Folder
    schema: StructType
    accept: Callable[[DataFrame], DataFrame]
    most: int = 5

    @property
    def _ledger(self) -> Published:
        return Published(self.folder.spark, self.folder.output)

    @property
    def _entries(self) -> str:
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields]
        return ", ".join([*fields, f"{ATTEMPT} INT", f"{STATE} STRING"])

    def _waiting(self, before: list[str]) -> DataFrame | None:
        """What the last batch left nacked, one attempt further."""
        if not before:
            return None
        last = self._ledger.read("deliveries", self._entries, before[-1:])
        return last.where(F.col(STATE) == NACKED).withColumn(ATTEMPT, F.col(ATTEMPT) + 1).drop(STATE)

    def _deliver(self, messages: DataFrame, key: str) -> None:
        judged = self.accept(messages).withColumn(
            STATE,
            F.when(F.col("ok"), ACKED).when(F.col(ATTEMPT) >= self.most, DEAD).otherwise(NACKED),
        )
        rows = judged.select(*[f"`{f.name}`" for f in self.schema.fields], ATTEMPT, STATE)
        self._ledger.add({"deliveries": rows}, key)

    def step(self, batch: DataFrame, batch_id: int) -> None:
        """Deliver the messages of one micro-batch and what waits from the one before."""
        key, keys = batch_key(batch_id), self._ledger.keys()
        if key in keys:
            return
        fresh = batch.withColumn(ATTEMPT, F.lit(1))
        waiting = self._waiting([k for k in keys if k < key])
        self._deliver(fresh if waiting is None else fresh.unionByName(waiting), key)

    def writer(self, stream: DataFrame) -> DataStreamWriter:
        return stream.writeStream.option("checkpointLocation", self.folder.checkpoint).foreachBatch(self.step)

    def settle(self) -> int:
        """With the stream stopped, deliver what still waits until nothing does; the rounds it took."""
        rounds = 0
        while True:
            keys = self._ledger.keys()
            waiting = self._waiting(keys)
            if waiting is None or waiting.isEmpty():
                return rounds
            batch, step = map(int, keys[-1].split("-"))
            self._deliver(waiting, batch_key(batch, step + 1))
            rounds += 1

    def deliveries(self) -> DataFrame:
        """Every attempt of every message."""
        return self._ledger.read("deliveries", self._entries)

    def acked(self) -> DataFrame:
        return self.deliveries().where(F.col(STATE) == ACKED)

    def dead(self) -> DataFrame:
        return self.deliveries().where(F.col(STATE) == DEAD)
