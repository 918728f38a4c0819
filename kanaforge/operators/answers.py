"""Answers of outside sources: consolidation, evidence, promotion, limits, batches, health.

Answer rows: (word, ctx, kana, is_miss, why, at)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kanaforge.functions.kana import romaji_column
from kanaforge.functions.sounds import ROWS
from kanaforge.functions.text import KANA, MAX_KANA, is_kana
from kanaforge.operators.spans import as_of, previous, ranked, trailing

#: Rows of kana that a first letter may start with: its usual sounds, and those of the groups that it opens (ps, kn, gn,
#: ng, mn ...). Letters that are not listed never reject a reading.
FIRST_ROWS = {
    "b": "b v", "c": "k s ch sh", "d": "d j", "f": "f h", "g": "g j n", "j": "j y h", "k": "k n", "l": "r", "m": "m n", "n": "n g", "p": "p f h s n", "q": "k ch", "r": "r", "s": "s sh z ch", "t": "t ch ts s sh z", "v": "b v f", "x": "z j s k", "z": "z j ts",
}
FIRST_SOUNDS = {letter: "".join(dict.fromkeys(mora[0] for row in rows.split() for mora in ROWS[row])) + ("ン" if letter in "mn" else "") for letter, rows in FIRST_ROWS.items()}
VOICED_TH = "".join(mora[0] for mora in (*ROWS["z"], *ROWS["d"]))


def first_sound_ok(word: Column, kana: Column, lang: Column | None = None) -> Column:
    """Whether a reading may start a word: by its first letter, `th` with voiced sounds too; any on a foreign line."""
    rows = F.create_map(*[F.lit(x) for pair in FIRST_SOUNDS.items() for x in pair])[F.lower(F.substring(word, 1, 1))]
    rows = F.when(F.lower(word).startswith("th"), F.concat(rows, F.lit(VOICED_TH))).otherwise(rows)
    ok = rows.isNull() | (F.length(kana) == 0) | F.contains(rows, F.substring(kana, 1, 1))
    return ok if lang is None else ok | lang.isNotNull()


Validator = Callable[[Column, Column, Column], Column]


def answer_reason(word: Column, kana: Column, lang: Column | None = None, validate: Validator = first_sound_ok) -> Column:
    """Why an answer is refused; null where it is taken. validate(word, kana, lang): the caller's own last check."""
    lang = F.lit(None).cast("string") if lang is None else lang
    return F.when(kana.isNull() | (kana == ""), "not given").when(~is_kana(kana, "answer"), "not kana").when(F.length(kana) > MAX_KANA, "too long").when(~validate(word, kana, lang), "first sound")


def lookup(tokens: DataFrame, answers: DataFrame) -> DataFrame:
    """tokens (word, ctx) with kana, asked: the answer for the sentence, else the word's latest on any line.

    A miss for the sentence means that it was asked, and that nothing else is used."""
    own = answers.groupBy("word", "ctx").agg(F.max_by("kana", "stamp").alias("_own"), F.max_by("is_miss", "stamp").alias("_miss"))
    latest = latest_readings(answers).select("word", F.col("kana").alias("_any"))
    joined = tokens.join(own, ["word", "ctx"], "left").join(latest, "word", "left")
    return joined.select(*tokens.columns, F.when(F.col("_miss"), None).otherwise(F.coalesce("_own", "_any")).alias("kana"), F.col("_miss").isNotNull().alias("asked"))


def lookup_as_of(tokens: DataFrame, answers: DataFrame) -> DataFrame:
    """tokens (word, ctx, stamp) with kana, asked: as lookup(), but of the answers that were there at the token's time.

    The answer for the sentence, else the word's latest on any line before the token; a miss for the sentence that is its last
    answer before the token means that nothing else is used."""
    own = as_of(tokens, answers.select("word", "ctx", "stamp", "kana", "is_miss"), ["word", "ctx"], "stamp", ["is_miss", "kana"], "_own")
    both = as_of(own, answers.where("NOT is_miss").select("word", "stamp", "kana"), ["word"], "stamp", ["kana"], "_any")
    return both.select(*tokens.columns, F.when(F.col("_own.is_miss"), None).otherwise(F.coalesce("_own.kana", "_any.kana")).alias("kana"), F.col("_own").isNotNull().alias("asked"))


def latest_readings(answers: DataFrame) -> DataFrame:
    """(word, kana, at): the last reading of each word."""
    return answers.where("NOT is_miss").groupBy("word").agg(F.max_by("kana", F.struct("stamp", "kana")).alias("kana"), F.max("stamp").alias("stamp"))


def consolidate(answers: DataFrame) -> DataFrame:
    """(word, kana, lines, consistent): first reading, distinct sentences, and whether all readings agree."""
    return answers.where("NOT is_miss").groupBy("word").agg(F.min_by("kana", F.struct("stamp", "kana")).alias("kana"), F.countDistinct("ctx").alias("lines"), (F.countDistinct("kana") == 1).alias("consistent"))


def evidence(learned: DataFrame, model: DataFrame, free: DataFrame) -> DataFrame:
    """(word, kana, lines, consistent) over sources: learned and free rows count two lines, model rows their own."""
    two = learned.select(F.lower("word").alias("word"), "kana", F.lit(2).cast("long").alias("lines"), F.lit(True).alias("consistent"))
    more = free.select(F.lower("word").alias("word"), "kana", F.lit(2).cast("long").alias("lines"), F.lit(True).alias("consistent"))
    own = model.select(F.lower("word").alias("word"), "kana", F.col("lines").cast("long"), "consistent")
    rows = two.unionByName(own).unionByName(more)
    return rows.groupBy("word").agg(F.min("kana").alias("kana"), F.sum("lines").alias("lines"), (F.bool_and("consistent") & (F.countDistinct("kana") == 1)).alias("consistent"))


def two_way(word: Column, kana: Column) -> Column:
    """Short syllables whose romanised reading is another: what they mean depends on the sentence."""
    romaji = romaji_column(word)
    return (F.length(word) <= 3) & romaji.isNotNull() & (romaji != kana)


def promote(found: DataFrame, hand: DataFrame, model: DataFrame, blocked: DataFrame, foreign: DataFrame, ambiguous: Callable[[Column, Column], Column] = two_way) -> DataFrame:
    """found with reason (null: accepted) and old_kana of the model lexicon, by an ordered list of reasons.

    ambiguous(word, kana): words that no list may settle."""
    def flag(df: DataFrame, name: str) -> DataFrame:
        return df.select("word").distinct().withColumn(name, F.lit(True))

    joined = found.join(flag(hand, "_hand"), "word", "left").join(flag(blocked, "_blocked"), "word", "left").join(flag(foreign, "_foreign"), "word", "left").join(model.select("word", F.col("kana").alias("old_kana")), "word", "left")
    joined = joined.withColumn("_two_way", ambiguous(F.col("word"), F.col("kana")))
    reason = (
        F.when(~F.col("word").rlike("^[a-z]+$"), "key")
        .when(~F.col("kana").rlike(f"^{KANA['learned']}$"), "kana")
        .when(F.length("kana") > MAX_KANA, "length")
        .when(~F.col("consistent"), "inconsistent")
        .when(F.col("lines") < 2, "few lines")
        .when(F.col("_blocked"), "blocked")
        .when(F.coalesce("_two_way", F.lit(False)), "ambiguous")
        .when(F.col("_hand"), "in hand lexicon")
        .when(F.col("_foreign"), "foreign")
        .when(F.col("old_kana") == F.col("kana"), "same")
    )
    return joined.select("word", "kana", "lines", "consistent", "old_kana", reason.alias("reason"))


def reject_report(answers: DataFrame) -> DataFrame:
    """(why, rows): refused answers by reason."""
    return answers.where("why IS NOT NULL").groupBy("why").agg(F.count("*").alias("rows"))


def latest_rejects(answers: DataFrame, k: int = 30) -> DataFrame:
    return answers.where("why IS NOT NULL").orderBy(F.desc("stamp"), "word", "ctx").limit(k)


def evict_oldest(rows: DataFrame, most: int, at: str, tie: str) -> DataFrame:
    """The newest rows of a store: a top-k, never a sort in one task."""
    return rows.orderBy(F.desc(at), tie).limit(most)


def plan_batches(pending: DataFrame, size: int, shard: Column | None = None) -> DataFrame:
    """(word, ctx, stamp, shard, batch, item): distinct questions in order of arrival, in batches of a size.

    By default one order over all questions, ranked by ranges, and shard 0; with shard, a column, each shard has batches of its own."""
    asked = pending.groupBy("word", "ctx").agg(F.min("stamp").alias("stamp"))
    if shard is None:
        numbered = ranked(asked.withColumn("shard", F.lit(0)), ["stamp", "word", "ctx"], "_n").withColumn("_n", F.col("_n") - 1)
    else:
        numbered = asked.withColumn("shard", shard).withColumn("_n", F.row_number().over(Window.partitionBy("shard").orderBy("stamp", "word", "ctx")) - 1)
    return numbered.select("word", "ctx", "stamp", "shard", F.expr(f"cast(_n div {size} AS {'bigint' if shard is None else 'int'})").alias("batch"), F.expr(f"cast(_n % {size} + 1 AS int)").alias("item"))


def rate_limit(requests: DataFrame, most: int, seconds: int, key: str = "endpoint") -> DataFrame:
    """requests with recent and over: how many came in the trailing window, and whether that is beyond the quota."""
    counted = trailing(requests, key, "ts", seconds * 1_000_000, F.lit(1), "recent", open_start=True)
    return counted.withColumn("over", F.col("recent") > most)


def change_runs(events: DataFrame, seconds: int = 3, most: int = 3) -> DataFrame:
    """events (key, ts, value, n) with changes in the trailing window and suppressed; the first sight is no change."""
    seen = previous(events, "key", ["ts", "n"], "value", "_last")
    changed = seen.withColumn("_c", F.coalesce((F.col("value") != F.col("_last.value")).cast("int"), F.lit(0)))
    return trailing(changed, "key", "ts", seconds * 1_000_000, F.col("_c"), "changes").withColumn("suppressed", F.col("changes") >= most).drop("_c", "_last")


OUTCOMES = ("hit", "cached", "miss", "rejected")


def health(log: DataFrame) -> DataFrame:
    """One row for each endpoint: requests, failures, failures since the last success, stalled, and outcomes by kind.

    log: (endpoint, ts, n, ok), with outcome (one of OUTCOMES, or null) and pending (words that wait) where they are
    known; an endpoint is stalled after two failures in a row while anything waits."""
    good = log.where("ok").groupBy("endpoint").agg(F.max(F.struct("ts", "n")).alias("_last"))
    tail = log.join(good, "endpoint", "left").withColumn("_tail", F.col("_last").isNull() | (F.struct("ts", "n") > F.col("_last")))
    counts = [F.count_if(F.col("outcome") == x).alias({"hit": "hits", "cached": "cache_hits", "miss": "misses", "rejected": "rejected"}[x]) for x in OUTCOMES] if "outcome" in log.columns else []
    waits = F.max_by("pending", F.struct("ts", "n")) > 0 if "pending" in log.columns else F.lit(True)
    out = tail.groupBy("endpoint").agg(F.count("*").alias("requests"), F.count_if(~F.col("ok")).alias("failures"), F.count_if(F.col("_tail")).alias("tail_failures"), *counts, waits.alias("_waits"))
    return out.withColumn("stalled", (F.col("tail_failures") >= 2) & F.coalesce("_waits", F.lit(False))).drop("_waits")


def align_by_index(asked: DataFrame, said: DataFrame, validate: Validator = first_sound_ok) -> DataFrame:
    """asked (batch, item, word) with kana and why from said (batch, key, value): by item number, else by the word.

    Where said has a column partial, an item that a broken answer lacks is to be asked again: why is `requeue`."""
    by_item = said.select("batch", F.expr("try_cast(key AS int)").alias("item"), F.regexp_replace("value", r"\s", "").alias("_a")).where("item IS NOT NULL")
    by_word = said.select("batch", F.col("key").alias("word"), F.regexp_replace("value", r"\s", "").alias("_b"))
    joined = asked.join(by_item, ["batch", "item"], "left").join(by_word, ["batch", "word"], "left").withColumn("_k", F.coalesce("_a", "_b"))
    lang = F.col("lang") if "lang" in asked.columns else None
    why = answer_reason(F.col("word"), F.col("_k"), lang, validate)
    if "partial" in said.columns:
        joined = joined.join(said.groupBy("batch").agg(F.bool_or("partial").alias("_partial")), "batch", "left")
        why = F.when(F.col("_k").isNull() & F.coalesce("_partial", F.lit(False)), "requeue").otherwise(why)
    return joined.select("batch", "item", "word", F.when(why.isNull(), F.col("_k")).alias("kana"), why.alias("why"))


def align_by_line(asked: DataFrame, bodies: DataFrame) -> DataFrame:
    """asked (batch, item, word) with kana and why from bodies (batch, body), a line for each item: a body with another
    number of lines is refused as a whole; an answer that holds no kana is a miss."""
    lines = F.split(F.regexp_replace("body", r"\s+$", ""), r"\r?\n")
    sizes = asked.groupBy("batch").agg(F.count("*").alias("_asked"))
    said = bodies.select("batch", lines.alias("_lines")).join(sizes, "batch")
    each = said.select("batch", (F.size("_lines") == F.col("_asked")).alias("_whole"), F.posexplode("_lines").alias("_at", "_line")).select("batch", "_whole", (F.col("_at") + 1).alias("item"), F.regexp_replace("_line", r"\s", "").alias("_k"))
    joined = asked.join(each, ["batch", "item"], "left")
    whole = F.max(F.col("_whole")).over(Window.partitionBy("batch"))
    why = F.when(~F.coalesce(whole, F.lit(False)), "line count").otherwise(answer_reason(F.col("word"), F.col("_k")))
    return joined.withColumn("_why", why).select("batch", "item", "word", F.when(F.col("_why").isNull(), F.col("_k")).alias("kana"), F.col("_why").alias("why"))


def fresh(answers: DataFrame, now: Column, keep: dict[str, int], kind: str = "kind", at: str = "at") -> DataFrame:
    """Answers that are not out of date: each kind is kept for its number of days; unknown kinds are dropped."""
    days = F.create_map(*[F.lit(x) for pair in keep.items() for x in pair])[F.col(kind)]
    return answers.where(F.col(at) > now - F.make_dt_interval(days))


def retried(answers: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers, wanted) once misses are to be asked again: misses go, and their questions have no tries behind them."""
    misses = answers.where("is_miss").select("word", "ctx").distinct().withColumn("_miss", F.lit(True))
    reset = wanted.join(misses, ["word", "ctx"], "left").withColumn("tries", F.when(F.col("_miss"), 0).otherwise(F.col("tries"))).drop("_miss")
    return answers.where("NOT is_miss"), reset


def parse_answers(raw: DataFrame) -> DataFrame:
    """(batch, key, value, partial) of raw (batch, content): the outermost object, else what pairs can be saved."""
    whole = F.from_json(F.regexp_extract("content", r"(?s)(\{.*\})", 1), "map<string,string>")
    keys = F.expr(r"""regexp_extract_all(content, '"([^"\\\\]+)"\\s*:\\s*"([^"\\\\]{0,24})"', 1)""")
    values = F.expr(r"""regexp_extract_all(content, '"([^"\\\\]+)"\\s*:\\s*"([^"\\\\]{0,24})"', 2)""")
    parsed = raw.select("batch", whole.alias("w"), F.arrays_zip(keys.alias("key"), values.alias("value")).alias("p"))
    good = parsed.where(F.col("w").isNotNull() & (F.size("w") > 0))
    full = good.select("batch", F.explode("w").alias("key", "value"), F.lit(False).alias("partial"))
    saved = parsed.where(F.col("w").isNull() | (F.size("w") <= 0)).select("batch", F.posexplode("p").alias("_n", "p")).select("batch", "_n", "p.key", "p.value")
    first = saved.groupBy("batch", "key").agg(F.min_by("value", "_n").alias("value"), F.lit(True).alias("partial"))
    return full.unionByName(first)
