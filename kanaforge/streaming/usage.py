"""Usage over event time; each transformation serves a batch and a stream.

A late event counts for its own day until the watermark passes it; running totals take it whenever it comes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kanaforge.operators.spans import running_count
from kanaforge.streaming.ordered import OrderedFold, folded

LATE = "1 day"
#: A century: totals are not forgotten.
FOREVER_MS = 36_525 * 86_400_000


def _marked(events: DataFrame) -> DataFrame:
    return events.withWatermark("ts", LATE) if events.isStreaming else events


def daily(events: DataFrame) -> DataFrame:
    """(kind, day, requests) of (ts, kind): tumbling days."""
    return _marked(events).groupBy("kind", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("requests")).select("kind", F.col("w.start").alias("day"), "requests")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(kind, session_id, start, end, requests): a session ends after a gap, and the next one starts from nothing."""
    return _marked(events).groupBy("kind", "session_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("requests")).select("kind", "session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "requests")


def totals(events: DataFrame, *by: str) -> DataFrame:
    """(kind, by..., requests, words): running totals, in all or for each session or day. A stream updates them in place
    (output mode update or complete): its state is a row for each group and never a row of an event."""
    return events.groupBy("kind", *by).agg(F.count("*").alias("requests"), F.sum("words").alias("words"))


class Totals(OrderedFold):
    """The totals of a kind in state."""

    def init(self, handle) -> None:
        super().init(handle)
        self.totals = handle.getValueState("totals", "total long, day string, today long")

    def take(self, key: tuple, row: tuple) -> list[Row]:
        _, event_id, day = row
        total, last, today = self.totals.get() if self.totals.exists() else (0, None, 0)
        now = (total + 1, day, today + 1 if day == last else 1)
        self.totals.update(now)
        return [Row(event_id=event_id, kind=key[0], day=day, total=now[0], today=now[2])]


def running(events: DataFrame) -> DataFrame:
    """(event_id, kind, day, total, today): the totals as they stood after each event, in order of time: `today` starts anew
    with each day. Over a table, counts of hours are added up first, so that no task holds all events of a kind; a stream folds the events
    of a kind in order once its watermark has passed them, and keeps totals for good."""
    if events.isStreaming:
        rows = events.withWatermark("ts", LATE).select("kind", "ts", F.unix_micros("ts").alias("at"), "event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
        row = T.StructType([T.StructField(c, rows.schema[c].dataType) for c in ("at", "event_id", "day")])
        kinds = {c: rows.schema[c].dataType.simpleString() for c in ("event_id", "kind")}
        return folded(rows, ["kind"], Totals(["kind"], row, FOREVER_MS), f"event_id {kinds['event_id']}, kind {kinds['kind']}, day string, total long, today long")
    rows = events.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    today = running_count(rows, ["kind", "day"], "ts", ["event_id"], "today")
    return running_count(today, ["kind"], "ts", ["event_id"], "total").select("event_id", "kind", "day", "total", "today")
