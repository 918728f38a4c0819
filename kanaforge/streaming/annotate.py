"""Streams of lines: tokens with readings as they arrive, questions asked once, answers joined when they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kanaforge.functions.text import context_key, word_key
from kanaforge.functions.tokens import spread_tokens, tokens_column
from kanaforge.operators import cascade as R
from kanaforge.streaming.ordered import OrderedFold, folded

#: How long an answer may take, and how long a question is remembered.
PATIENCE, REMEMBERED = "10 minutes", "1 day"


def annotated(lines: DataFrame, readings: DataFrame) -> DataFrame:
    """(doc_id, line_no, ts, ctx, tok_no, text, start, end, key, kana, source) of a stream of (doc_id, line_no, line, ts).

    readings: a static table (word, kana, source) of distinct words; words that it lacks have no kana yet."""
    tokens = lines.select("doc_id", "line_no", "ts", context_key("line").alias("ctx"), tokens_column("line").alias("_tokens"))
    tokens = spread_tokens(tokens, "_tokens")
    flat = tokens.select("doc_id", "line_no", "ts", "ctx", "tok_no", "t.text", "t.start", (F.col("t.start") + F.length("t.text")).alias("end"), word_key("t.text").alias("key"))
    return flat.join(readings.select(F.col("word").alias("text"), "kana", "source"), "text", "left")


def read_batches(lexicon: DataFrame, write, **tables: DataFrame):
    """What foreachBatch calls: the line-aware cascade (in_lines, kinds_of, read_tokens) over each micro-batch's lines,
    handed to write(readings, batch number). A batch's own documents vote on its languages. tables: as kinds_of() takes."""

    def each(lines: DataFrame, number: int) -> None:
        told = R.line_tokens(R.in_lines(lines.select("doc_id", "line_no", "line"), lexicon))
        write(R.read_tokens(told, R.kinds_of(told, lexicon, **tables)), number)

    return each


def questions(tokens: DataFrame) -> DataFrame:
    """(key, ctx, ts): words without a reading, each asked once for its sentence while it is remembered."""
    asked = tokens.where("kana IS NULL AND key IS NOT NULL").select("key", "ctx", "ts")
    return asked.withWatermark("ts", REMEMBERED).dropDuplicatesWithinWatermark(["key", "ctx"]) if tokens.isStreaming else asked.dropDuplicates(["key", "ctx"])


#: How long a token waits for an answer, and an answer serves tokens that come after it.
WAIT = "7 days"
_WAIT = 7 * 86_400_000_000
_TOKEN = ("doc_id", "line_no", "tok_no", "text", "start", "end")


class Waiting(OrderedFold):
    """The last answer of a question, and the tokens that wait for its next one, in state."""

    def init(self, handle) -> None:
        super().init(handle)
        self.answer = handle.getValueState("answer", "at long, kana string")
        self.tokens = handle.getMapState("tokens", self.row, "times int")

    def _row(self, key: tuple, token: tuple, at: int, kana: str) -> Row:
        return Row(key=key[0], ctx=key[1], **dict(zip(_TOKEN, token[2:8], strict=True)), kana=kana, asked=token[0], answered=at)

    def take(self, key: tuple, row: tuple) -> list[Row]:
        at, is_token, kana = row[0], row[1], row[-1]
        if is_token:
            known = self.answer.get() if self.answer.exists() else None
            if known and at - known[0] <= _WAIT:
                return [self._row(key, row, *known)]
            before = self.tokens.getValue(row)[0] if self.tokens.containsKey(row) else 0
            self.tokens.updateValue(row, (before + 1,))
            return []
        out = []
        for token, (times,) in list(self.tokens.iterator()):
            token = tuple(token)
            if at - token[0] <= _WAIT:
                out += [self._row(key, token, at, kana)] * times
            self.tokens.removeKey(token)
        self.answer.update((at, kana))
        return out

    def wipe(self) -> None:
        self.answer.clear()
        self.tokens.clear()


def _events(tokens: DataFrame, answers: DataFrame) -> DataFrame:
    """(key, ctx, ts, at, is_token, a token's columns, kana) of tokens without a reading and of answers with one."""
    micros = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    waiting = tokens.where("kana IS NULL AND key IS NOT NULL").select("key", "ctx", "ts", micros, F.lit(True).alias("is_token"), *_TOKEN, F.lit(None).cast("string").alias("kana"))
    kinds = {f.name: f.dataType for f in waiting.schema}
    said = answers.where("kana IS NOT NULL").select("key", "ctx", F.col("at").alias("ts"), "kana")
    return waiting.unionByName(said.select("key", "ctx", "ts", micros, F.lit(False).alias("is_token"), *[F.lit(None).cast(kinds[c]).alias(c) for c in _TOKEN], "kana"))


def answered(tokens: DataFrame, answers: DataFrame) -> DataFrame:
    """(key, ctx, a token's columns, kana, asked, answered) of tokens without a reading (annotated()) and answers (key, ctx, kana, at).

    A token takes the last answer that came before it, or with it, in WAIT; else it waits, and comes out again when the first
    answer after it comes in WAIT. Times are those of the events, so a table gives the same rows as a stream of them in any order
    within PATIENCE. asked, answered: microseconds."""
    if tokens.isStreaming:  # a watermark of each: the slower stream's counts
        rows = events = _events(tokens.withWatermark("ts", PATIENCE), answers.withWatermark("at", PATIENCE))
        row = T.StructType([T.StructField(f.name, f.dataType) for f in events.schema if f.name not in ("key", "ctx", "ts")])
        kinds = {f.name: f.dataType.simpleString() for f in events.schema}
        output = "key string, ctx string, " + ", ".join(f"`{c}` {kinds[c]}" for c in _TOKEN) + ", kana string, asked long, answered long"
        return folded(rows, ["key", "ctx"], Waiting(["key", "ctx"], row, _WAIT // 1000), output)
    events = _events(tokens, answers)
    order = ["at", "is_token", *_TOKEN, "kana"]
    answer = F.when(~F.col("is_token"), F.struct("at", "kana"))
    until = Window.partitionBy("key", "ctx").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("key", "ctx").orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    both = events.select("*", F.last(answer, True).over(until).alias("_before"), F.first(answer, True).over(later).alias("_after")).where("is_token")
    took = F.when(F.col("at") - F.col("_before.at") <= _WAIT, F.col("_before")).when(F.col("_after.at") - F.col("at") <= _WAIT, F.col("_after"))
    return both.withColumn("_took", took).where("_took IS NOT NULL").select("key", "ctx", *_TOKEN, F.col("_took.kana").alias("kana"), F.col("at").alias("asked"), F.col("_took.at").alias("answered"))


def relabelled(tokens: DataFrame, answers: DataFrame) -> DataFrame:
    """Tokens without a reading with the answer (key, ctx, kana, at) that came for them in time."""
    waiting = tokens.where("kana IS NULL").drop("kana", "source")
    said = answers.select(F.col("key").alias("_key"), F.col("ctx").alias("_ctx"), "kana", "at")
    if tokens.isStreaming:
        waiting, said = waiting.withWatermark("ts", PATIENCE), said.withWatermark("at", PATIENCE)
    return waiting.join(said, F.expr(f"key = _key AND ctx = _ctx AND at >= ts AND at <= ts + INTERVAL {PATIENCE}")).drop("_key", "_ctx")


#: Days that an answer is kept, by where it came from.
KEEP = {"model": 180, "free": 30}


def cached(answers: DataFrame, keep: dict[str, int] = KEEP) -> DataFrame:
    """The cache of a stream of answers (kind, word, ctx, kana, is_miss, at): the first answer of each question from each
    source, once, while that source's answers are kept; a miss is an answer like any other, until it is retried (see
    operators.answers.retried). Over a table: the first answers that are still fresh at the table's last moment."""
    if answers.isStreaming:
        parts = [answers.where(F.col("kind") == k).withWatermark("at", f"{days} days").dropDuplicatesWithinWatermark(["word", "ctx"]) for k, days in keep.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
    days = F.create_map(*[F.lit(x) for pair in keep.items() for x in pair])[F.col("kind")]
    newest = answers.agg(F.max("at").alias("_now"))
    kept = answers.join(F.broadcast(newest), F.col("at") > F.col("_now") - F.make_dt_interval(days)).drop("_now")  # one row
    fields = [c for c in answers.columns if c not in ("kind", "word", "ctx")]
    return kept.groupBy("kind", "word", "ctx").agg(F.min(F.struct("at", *[c for c in fields if c != "at"])).alias("_x")).select("kind", "word", "ctx", *[F.col(f"_x.{c}").alias(c) for c in fields])
