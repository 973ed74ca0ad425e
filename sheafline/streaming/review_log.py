"""The review log as a stream: the state of every item, kept up to date as its events arrive.

Writers only append events, each in files of its own, so any number may write at once and may write an event again. One
stream reads the log and holds for each bundle its first opening and its last closing. Both are extremes, so neither the
order of events nor their repetition changes the outcome: it is that of `review.state` over the same events. Of openings at
the same time the first by route and reasons counts, of closings the last by their data. Events without a time or kind do
nothing; a closing whose opening has not come is held until it does.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

OPENING = "at double, route string, reasons array<string>"
CLOSING = "at double, reviewer string, conclusion string, edits string, note string"
ITEM = "route string, reasons array<string>, opened_at double, closed_at double, reviewer string, conclusion string, edits string, note string, status string, overdue boolean, version long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _rank(event: tuple) -> tuple:
    return event[0], json.dumps(event[1:])


class ReviewItem(StatefulProcessor):
    """One item. What changes it gives a row with the next version; a timer tells that it is still open after a while."""

    def __init__(self, overdue_ms: int | None):
        self.overdue_ms = overdue_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.opening = handle.getValueState("opening", OPENING)
        self.closing = handle.getValueState("closing", CLOSING)
        self.told = handle.getValueState("told", "version long")

    def held(self) -> tuple[tuple | None, tuple | None]:
        return tuple(tuple(s.get()) if s.exists() else None for s in (self.opening, self.closing))

    def row(self, key: tuple, first: tuple, last: tuple | None, overdue: bool) -> Row:
        version = (self.told.get()[0] if self.told.exists() else 0) + 1
        self.told.update((version,))
        _, route, reasons = first
        closed_at, reviewer, conclusion, edits, note = last or (None,) * 5
        return Row(
            bundle_id=key[0], route=route, reasons=reasons, opened_at=first[0], closed_at=closed_at, reviewer=reviewer, conclusion=conclusion, edits=edits, note=note,
            status="closed" if last else "open", overdue=overdue, version=version,
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        first, last = before = self.held()
        for r in rows:
            if r["at"] is None or r["kind"] is None:
                continue
            if r["kind"] == "open":
                new = (r["at"], r["route"], None if r["reasons"] is None else list(r["reasons"]))
                first = new if first is None else min(first, new, key=_rank)
            else:
                new = (r["at"], r["reviewer"], r["conclusion"], r["edits"], r["note"])
                last = new if last is None else max(last, new, key=_rank)
        if first != before[0]:
            self.opening.update(first)
        if last != before[1]:
            self.closing.update(last)
        if first is None or (first, last) == before:
            return
        if before[0] is None and last is None and self.overdue_ms is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.overdue_ms)
        yield self.row(key, first, last, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        first, last = self.held()
        if first is not None and last is None:
            yield self.row(key, first, last, True)

    def close(self) -> None:
        pass


def states(events: DataFrame, overdue_ms: int | None = None) -> DataFrame:
    """A row for each change of an item, from a stream of events (see review.EVENTS). The session must keep state in
    RocksDB, as `keep` has it."""
    key = events.schema["bundle_id"].dataType.simpleString()
    return events.groupBy("bundle_id").transformWithState(ReviewItem(overdue_ms), f"bundle_id {key}, {ITEM}", "Update", "None" if overdue_ms is None else "ProcessingTime")


def keep(events: DataFrame, path: str, checkpoint: str, overdue_ms: int | None = None, **trigger) -> StreamingQuery:
    """Starts the stream that writes every change below path. A batch that is tried again overwrites what it wrote."""
    spark = events.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)  # a query takes the session's settings as it starts
    try:
        out = states(events, overdue_ms).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
        return (out.trigger(**trigger) if trigger else out).start()
    finally:
        spark.conf.set(PROVIDER, before)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The latest state of every item that was opened."""
    changes = spark.read.parquet(path).drop("batch")
    return changes.groupBy("bundle_id").agg(F.max_by(F.struct(*(c for c in changes.columns if c != "bundle_id")), "version").alias("s")).select("bundle_id", "s.*").drop("version")
