"""Attempts at items as a stream: what is done, what failed for good, and what is due again.

An item is pending until an attempt begins (in_progress) and ends: completed, or failed. Some failures are transient, by marks in their
messages: such an item is due again after a wait that doubles with each attempt, up to `most` attempts; other failures are final.
A timer makes it pending when that time has passed, by the watermark. Rows of one item are taken in the order of their time, and a due
time that lies before the next row comes first, so the outcome does not depend on how rows fall into batches. What comes after an item
is settled is ignored. Every transition is a row of an append-only sink; with its checkpoint a stopped stream goes on where it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Marks of a transient failure in an error's message, beside any HTTP status from 500 to 599 (fixed values).
TRANSIENT = ("econnreset", "econnrefused", "etimedout", "timeout", "interrupted", "aborted")
MOST_ATTEMPTS, WAIT_SECONDS = 3, 60
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "attempts long, status string, due long, steps long"
ROWS = "item long, step long, at timestamp, attempts long, status string, transient boolean, retryable boolean, due timestamp"
#: Outcomes by their place in a code.
OUTCOMES = ("completed", "failed", "started")
#: The same as ROWS with times in milliseconds, as the processor gives them.
_MOVES = "item long, step long, at_ms long, attempts long, status string, transient boolean, retryable boolean, due_ms long"
_MOVE = Row(*[c.split()[0] for c in _MOVES.split(", ")])


def is_transient(message: Column) -> Column:
    return F.lower(F.coalesce(message, F.lit(""))).rlike("|".join(TRANSIENT) + "|http 5[0-9]{2}")


class Attempts(StatefulProcessor):
    """Input rows: code, the time in milliseconds, the outcome's place (completed, failed, started) and whether it was transient in one number.

    There are few rows of an item and many items, so rows are taken as they are, in few columns: a frame for each item costs more than its work.
    """

    def __init__(self, most: int, wait_seconds: int):
        self.most, self.wait = most, wait_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("attempt", STATE)

    def _row(self, item, at: int, attempts: int, status: str, transient, due, steps: int) -> Row:
        open_ = status in ("pending", "in_progress") or (status == "failed" and bool(transient) and attempts < self.most)
        return _MOVE(item, steps, at, attempts, status, transient, open_, due)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        item = key[0]
        held = self.state.get()
        attempts, status, due, steps = held or (0, "pending", None, 0)
        if status in ("completed", "lost"):
            return
        was = due
        for code in sorted(r.code for r in rows):
            ms, outcome, transient = code >> 3, OUTCOMES[code >> 1 & 3], bool(code & 1)
            if status in ("completed", "lost"):
                break
            if due is not None and due <= ms:
                status, steps = "pending", steps + 1
                yield self._row(item, due, attempts, status, None, None, steps)
            due, steps = None, steps + 1
            if outcome == "started":
                status = "in_progress"
            else:
                attempts += 1
                status = outcome
                if status == "failed" and transient and attempts < self.most:
                    due = ms + self.wait * 2 ** (attempts - 1)
            yield self._row(item, ms, attempts, status, transient if status == "failed" else None, due, steps)
            if status == "failed" and due is None:
                status = "lost"
        if was != due:
            if was is not None:
                self.handle.deleteTimer(was)
            if due is not None:
                self.handle.registerTimer(due)
        self.state.update((attempts, status, due, steps))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        attempts, status, due, steps = self.state.get()
        if due is not None and due <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.update((attempts, "pending", None, steps + 1))
            yield self._row(key[0], due, attempts, "pending", None, None, steps + 1)

    def close(self) -> None:
        pass


def transitions(results: DataFrame, item: str, at: str, outcome: Column, message: Column, late: str = "10 minutes", most: int = MOST_ATTEMPTS, wait_seconds: int = WAIT_SECONDS) -> DataFrame:
    """A stream of results -> a stream of (item, step, at, attempts, status, transient, retryable, due)."""
    when = F.col(at).cast("timestamp")
    place = F.when(outcome == "completed", 0).when(outcome == "started", 2).when(outcome.isNotNull(), 1)
    code = F.unix_millis(when) * 8 + place * 2 + is_transient(message).cast("int")
    rows = results.select(F.col(item).cast("long").alias("item"), when.alias("at"), code.alias("code"))
    rows = rows.where("item is not null and at is not null and code is not null").withWatermark("at", late)
    moves = rows.groupBy("item").transformWithState(Attempts(most, wait_seconds), _MOVES, "Append", "EventTime")
    time = lambda c: F.timestamp_millis(c).alias(c.removesuffix("_ms"))
    return moves.select("item", "step", time("at_ms"), "attempts", "status", "transient", "retryable", time("due_ms"))


def run_into(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs over what is there now into Parquet at path, and reads all that stands there; called again, it goes on from the checkpoint."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        query = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).queryName(f"attempts-{uuid.uuid4().hex[:8]}").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
    return spark.read.schema(ROWS).parquet(path)


def latest(rows: DataFrame) -> DataFrame:
    """The last transition of each item."""
    rest = [c for c in rows.columns if c != "item"]
    return rows.groupBy("item").agg(F.max_by(F.struct(*rest), "step").alias("x")).select("item", "x.*")
