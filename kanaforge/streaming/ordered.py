"""Keyed folds in order of event time: a buffer in state that the watermark releases.

Rows of a key wait in a map state, each under itself, until the watermark has passed their time; then they are taken in order, so the
result does not depend on how a stream is cut into micro-batches, nor on the order of arrival within the watermark's delay. Rows that
come later than that are dropped by Spark. Of what is released, only the keys of the buffer are in memory at once.
Needs the RocksDB state store (`use_rocksdb`)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Folds keep maps and timers in state, which only this store of Spark's has."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def in_order(row: tuple) -> tuple:
    """A sort key of rows that may hold nulls: nulls first, as Spark sorts."""
    return tuple((x is not None, x) for x in row)


class OrderedFold(StatefulProcessor):
    """Calls take(key, row) on a key's rows in order. The first column of a row, `at`, is its time in microseconds.

    forget_ms: a key that nothing comes for in so long loses its state; wipe() clears what a subclass keeps."""

    def __init__(self, key: list[str], row: T.StructType, forget_ms: int):
        self.row, self.forget_ms = row, forget_ms
        self.names = [f.name for f in row]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getMapState("buffer", self.row, "times int")
        self.timer = handle.getValueState("timer", "at long")
        self.last = handle.getValueState("last", "at long")

    def _wake(self, at: int | None) -> None:
        """One timer a key, at the first waiting row or, where none waits, at the end of its memory."""
        if at is None:
            at = (self.last.get()[0] if self.last.exists() else 0) // 1000 + self.forget_ms
        now = self.timer.get()[0] if self.timer.exists() else None
        if now != at:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = None
        for row in rows:
            kept = tuple(row[n] for n in self.names)
            before = self.buffer.getValue(kept)[0] if self.buffer.containsKey(kept) else 0
            self.buffer.updateValue(kept, (before + 1,))
            first = kept[0] if first is None else min(first, kept[0])
        if first is not None:
            waits = self.timer.get()[0] if self.timer.exists() else None
            due = -(-first // 1000)
            if waits is None or due < waits:
                self._wake(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        waiting = list(self.buffer.keys())
        ready = sorted((tuple(w) for w in waiting if w[0] <= now), key=in_order)
        out = []
        for row in ready:
            for _ in range(self.buffer.getValue(row)[0]):
                out += self.take(key, row)
            self.buffer.removeKey(row)
            self.last.update((row[0],))
        rest = min((w[0] for w in waiting if w[0] > now), default=None)
        if ready or rest is not None:
            self._wake(None if rest is None else -(-rest // 1000))
        elif self.last.exists() and self.last.get()[0] // 1000 + self.forget_ms <= now // 1000:
            self.last.clear()
            self.wipe()
        else:
            self._wake(None)
        return iter(out)

    def take(self, key: tuple, row: tuple) -> list[Row]:
        raise NotImplementedError

    def wipe(self) -> None:
        """Clear what take() keeps."""

    def close(self) -> None:
        pass


def folded(rows: DataFrame, by: list[str], fold: OrderedFold, output: str) -> DataFrame:
    """The fold over a stream whose watermark stands on one of its columns."""
    use_rocksdb(rows.sparkSession)
    return rows.groupBy(*by).transformWithState(statefulProcessor=fold, outputStructType=output, outputMode="Append", timeMode="EventTime")
