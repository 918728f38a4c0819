"""Learning words from answers: one small state for each word, in a stream and over a table.

What an answer does depends on the word's phase:

    answer                              nothing known     pending kana, line      learned kana
    no kana, or too long                -                 -                       -
    as the word reads anyway            -                 forgotten               -
    the kana at hand, on another line   pending           learned                 kept
    the kana at hand, on the same line  pending           pending                 kept
    another kana                        pending           pending, the new one    dropped, nothing known
    a tombstone                         forgotten         forgotten               forgotten

A line without text never teaches. Answers of a word are taken in order of (ts, n, kana, line, local, forget), in a stream as over a
table: a stream keeps them until its watermark, LATE behind the latest, has passed them. A word that no answer comes for in KEPT_DAYS of
event time is forgotten without a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kanaforge.streaming.ordered import OrderedFold, folded

KEPT_DAYS = 180
LATE = "1 day"
STATE = "kana string, line string, learned boolean, at long"
_KEPT = KEPT_DAYS * 86_400_000_000
OUTPUT = "n bigint, status string, kana string"
_KANA = re.compile("[ァ-ヶーヿ]{1,14}").fullmatch


@dataclass
class Word:
    """What is known of a word: nothing (no kana), a kana that one line gave, or a learned kana."""

    kana: str = ""
    line: str = ""
    learned: bool = False
    at: int | None = None  # of its last answer, in microseconds

    def after(self, at: int) -> "Word":
        """The word when its next answer comes: nothing is known of it after KEPT_DAYS."""
        if self.at is not None and at - self.at > _KEPT:
            self.__init__()
        self.at = at
        return self

    def take(self, kana: str | None, line: str | None, local: str | None, forget: bool = False) -> tuple[str, str | None] | None:
        """The status and kana that an answer brings about, or None where it changes nothing."""
        line = " ".join((line or "").split())
        if forget:
            self.__init__(at=self.at)
            return "forgotten", None
        if not kana or not _KANA(kana) or self.learned and kana == self.kana:
            return None
        if kana == local:
            if not self.learned:
                self.__init__(at=self.at)
            return None
        if self.learned:
            dropped = self.kana
            self.__init__(at=self.at)
            return "dropped", dropped
        if kana == self.kana and self.line and line and line != self.line:
            self.learned, self.line = True, ""
            return "learned", kana
        if kana == self.kana and self.line:
            return None
        self.kana, self.line = kana, line
        return "pending", kana


def answers_of(rows: DataFrame, word: str = "word", normalise=None) -> DataFrame:
    """(word, ts, n, kana, line, local, forget) of answers, with the caller's own form of the word (normalise: a
    function of columns). Single letters and empty words never enter."""
    key = normalise(F.col(word)) if normalise else F.lower(F.trim(F.col(word)))
    forget = F.coalesce("forget", F.lit(False)) if "forget" in rows.columns else F.lit(False)
    return rows.select(key.alias("word"), "ts", F.col("n").cast("long").alias("n"), "kana", "line", "local", forget.alias("forget")).where("length(word) > 1")


def batch(answers: DataFrame) -> DataFrame:
    """(word, n, status, kana) of all answers (answers_of()).

    Spark sorts, and spills, each partition by word and order; a task goes through it once with the one word at hand
    in memory, so a word with very many answers needs no more than any other."""

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, word = Word(), None
        for part in parts:
            words, ns, statuses, kanas = [], [], [], []
            for key, at, n, kana, line, local, forget in zip(*(part.column(i).to_pylist() for i in range(7)), strict=True):
                if key != word:
                    now, word = Word(), key
                if said := now.after(at).take(kana, line, local, forget):
                    words.append(key)
                    ns.append(n)
                    statuses.append(said[0])
                    kanas.append(said[1])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(ns, pa.int64()), pa.array(statuses, pa.string()), pa.array(kanas, pa.string())], ["word", "n", "status", "kana"])

    laid = timed(answers).repartition("word").sortWithinPartitions("word", "at", *FIELDS)
    return laid.select("word", "at", *FIELDS).mapInArrow(fold, f"word string, {OUTPUT}")


FIELDS = ("n", "kana", "line", "local", "forget")


def timed(answers: DataFrame) -> DataFrame:
    return answers.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))


class Learning(OrderedFold):
    """One Word in state."""

    def init(self, handle) -> None:
        super().init(handle)
        self.word = handle.getValueState("word", STATE)

    def take(self, key: tuple, row: tuple) -> list[Row]:
        at, n, kana, line, local, forget = row
        now = (Word(*self.word.get()) if self.word.exists() else Word()).after(at)
        said = now.take(kana, line, local, forget)
        self.word.update((now.kana, now.line, now.learned, now.at))
        return [Row(word=key[0], n=n, status=said[0], kana=said[1])] if said else []

    def wipe(self) -> None:
        self.word.clear()


def stream(answers: DataFrame) -> DataFrame:
    """The same over a stream of answers."""
    rows = timed(answers.withWatermark("ts", LATE)).select("word", "ts", "at", *FIELDS)
    row = T.StructType([T.StructField("at", T.LongType())] + [T.StructField(f.name, f.dataType) for f in rows.schema if f.name in FIELDS])
    return folded(rows, ["word"], Learning(["word"], row, KEPT_DAYS * 86_400_000), f"word string, {OUTPUT}")


def learned(changes: DataFrame) -> DataFrame:
    """(word, kana): the words whose last change taught them."""
    last = changes.where("status <> 'pending'").groupBy("word").agg(F.max_by(F.struct("status", "kana"), "n").alias("x"))
    return last.where("x.status = 'learned'").select("word", "x.kana")


def two_way_out(answers: DataFrame, two_way) -> DataFrame:
    """Answers without the words that no answer may settle; two_way(word, local): a column."""
    return answers.where(~F.coalesce(two_way(F.col("word"), F.col("local")), F.lit(False)))


__all__ = ["Column", "Word", "answers_of", "batch", "learned", "stream", "two_way_out"]
