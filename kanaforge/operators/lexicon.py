"""Lexicons: look-ups, priority builds, drift, quality, candidates. Lexicon rows: (word, kana, source, priority)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kanaforge.functions.text import KANA, MAX_KANA
from kanaforge.sources.scratch import written

KEY = "^[a-z]+$"
MASKS = "○●◯〇*"


def pick_by_priority(rows: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def lookup(words: DataFrame, lexicon: DataFrame, raw: str = "word") -> DataFrame:
    """words with kana and step: the key as written, in lower case, then letters only; the first hit wins.

    Distinct words are looked up, and joined back."""
    keys = F.array(F.col(raw), F.lower(F.trim(F.col(raw))), F.regexp_replace(F.lower(F.col(raw)), "[^a-z]", ""))
    asked = words.select(raw).distinct().select(raw, F.posexplode(keys).alias("step", "_key"))
    hits = asked.join(lexicon.select(F.col("word").alias("_key"), "kana"), "_key")
    best = hits.groupBy(raw).agg(F.min_by("kana", "step").alias("kana"), F.min("step").alias("step"))
    return words.join(best, raw, "left")


def add_online(lexicon: DataFrame, additions: DataFrame, source: str = "online", priority: int = 9) -> DataFrame:
    """The lexicon with readings that were found later (word, kana): only pure kana is taken, under every key that a
    look-up tries, and never in place of what is there."""
    good = additions.where(F.col("kana").rlike(f"^{KANA['lexicon']}$"))
    keys = F.array_distinct(F.array(F.col("word"), F.lower(F.trim("word")), F.regexp_replace(F.lower("word"), "[^a-z]", "")))
    rows = good.select(F.explode(keys).alias("word"), "kana").where("word <> ''").groupBy("word").agg(F.min("kana").alias("kana")).join(lexicon.select("word"), "word", "left_anti")
    return lexicon.unionByName(rows.select("word", "kana", F.lit(source).alias("source"), F.lit(priority).alias("priority")), allowMissingColumns=True)


def masked_lookup(words: DataFrame, lexicon: DataFrame, curated: DataFrame | None = None) -> DataFrame:
    """(word, kana): words with masked letters that are listed (curated: word, kana), or whose lexicon matches all
    agree on one reading.

    Lexicon words are filed under their length and every letter, and every two letters, with their places, as far as a mask asks for
    that file. A mask with one or two visible letters is answered by its file's first and last reading, however many words it
    holds; one with more meets the words of its rarest two letters, and the rest is a pattern check."""
    low = F.lower(F.col("word"))
    masked = words.select("word").distinct().where(F.col("word").rlike(f"[{MASKS}]") & F.col("word").rlike("[A-Za-z]")).withColumn("like", F.translate(low, MASKS, "_" * len(MASKS)))
    masked = written(masked)  # asked for several times
    letter = lambda at: F.substring("like", at, 1)
    shown = F.filter(F.sequence(F.lit(1), F.length("like")), lambda at: letter(at) != "_")
    masks = masked.select("like").distinct().withColumn("n", F.length("like")).withColumn("shown", shown).withColumn("visible", F.size("shown"))
    entries = lexicon.select("kana", F.col("word").alias("entry"), F.length("word").alias("n")).where("kana IS NOT NULL")
    places = entries.select("n", "entry", "kana", F.posexplode(F.split("entry", "")).alias("_p", "letter")).select("n", "entry", "kana", (F.col("_p") + 1).alias("at"), "letter")
    sizes = places.groupBy("n", "at", "letter").agg(F.count("*").alias("size"), F.min("kana").alias("first"), F.max("kana").alias("last"))
    asked = masks.select("like", "n", "visible", F.explode("shown").alias("at")).withColumn("letter", letter(F.col("at")))
    known = asked.join(sizes, ["n", "at", "letter"])  # a visible letter that no word has there leaves the mask without an answer
    two = known.groupBy("like", "n", "visible").agg(F.count("*").alias("met"), F.slice(F.array_sort(F.collect_list(F.struct("size", "at", "letter", "first", "last"))), 1, 2).alias("rare")).where("met = visible")
    two = written(two)
    single = two.where("visible = 1 AND rare[0].first = rare[0].last").select("like", F.col("rare")[0]["first"].alias("kana"))
    a, b = F.least(F.col("rare")[0]["at"], F.col("rare")[1]["at"]), F.greatest(F.col("rare")[0]["at"], F.col("rare")[1]["at"])
    pairs = two.where("visible > 1").select("like", "n", "visible", a.alias("a"), b.alias("b")).withColumn("x", letter(F.col("a"))).withColumn("y", letter(F.col("b")))
    file = ["n", "a", "x", "b", "y"]
    wanted = pairs.select("n", "a", "b").distinct()  # places only: few, whatever the masks
    filed = entries.join(wanted, "n").withColumn("x", F.expr("substring(entry, a, 1)")).withColumn("y", F.expr("substring(entry, b, 1)"))
    filed = filed.join(pairs.select(*file).distinct(), file, "left_semi")
    readings = filed.groupBy(*file).agg(F.min("kana").alias("first"), F.max("kana").alias("last"))
    double = pairs.where("visible = 2").join(readings, file).where("first = last").select("like", F.col("first").alias("kana"))
    met = pairs.where("visible > 2").join(filed.select(*file, "entry", "kana"), file).where(F.expr("entry LIKE like"))
    more = met.groupBy("like").agg(F.min("kana").alias("kana"), F.max("kana").alias("_k")).where("kana = _k").drop("_k")
    found = masked.join(single.unionByName(double).unionByName(more), "like").select("word", "kana")
    if curated is None:
        return found
    listed = words.select("word").distinct().join(curated.select(F.lower("word").alias("_key"), "kana"), F.lower("word") == F.col("_key")).select("word", "kana")
    return listed.unionByName(found.join(listed, "word", "left_anti"))


def unknown_words(words: DataFrame, *known: DataFrame) -> DataFrame:
    """words whose norm no known table (word) has."""
    for k in known:
        words = words.join(k.select(F.col("word").alias("norm")), "norm", "left_anti")
    return words


def top_unknown(words: DataFrame, lexicon: DataFrame, k: int) -> DataFrame:
    """(norm, times): the most frequent unread words, the next candidates to ask for."""
    return unknown_words(words.groupBy("norm").agg(F.count("*").alias("times")), lexicon).orderBy(F.desc("times"), "norm").limit(k)


def status(rows: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """rows with status: bad_key, bad_kana, blocked, or ok."""
    marked = rows if blocked is None else rows.join(blocked.select("word", F.lit(True).alias("_blocked")), "word", "left")
    refused = F.lit(False) if blocked is None else F.coalesce(F.col("_blocked") & (F.col("source") == "model"), F.lit(False))
    state = F.when(~F.coalesce(F.col("word").rlike(KEY), F.lit(False)), "bad_key").when(~F.coalesce(F.col("kana").rlike(f"^{KANA['lexicon']}$"), F.lit(False)), "bad_kana").when(refused, "blocked").otherwise("ok")
    return marked.withColumn("status", state).drop("_blocked")


def build(rows: DataFrame, blocked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(lexicon, counters): one reading for each word by priority, and rows added and refused by source."""
    stated = status(rows, blocked)
    ranked = stated.withColumn("_n", F.when(F.col("status") == "ok", F.row_number().over(Window.partitionBy("word", "status").orderBy("priority", "source", "kana"))))
    told = ranked.withColumn("status", F.when(F.col("_n") == 1, "added").when(F.col("_n") > 1, "skipped").otherwise(F.col("status")))
    return told.where("status = 'added'").select("word", "kana", "source", "priority"), told.groupBy("source", "status").agg(F.count("*").alias("rows"))


def conflicts(rows: DataFrame) -> DataFrame:
    """(word, readings): words to which one source gives several readings."""
    return rows.groupBy("word").agg(F.array_sort(F.collect_set("kana")).alias("readings")).where(F.size("readings") > 1)


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """(word, change): missing, extra and changed readings between two lexicons."""
    a, b = old.select("word", F.col("kana").alias("a")), new.select("word", F.col("kana").alias("b"))
    change = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "word", "full_outer").select("word", change.alias("change")).where("change IS NOT NULL")


def quality(lexicon: DataFrame, declared: int | None = None, floor: int = 4000) -> DataFrame:
    """One row: size, bad keys, bad kana, duplicates, and whether the lexicon passes."""
    r = lexicon.agg(
        F.count("*").alias("size"),
        F.count_if(~F.col("word").rlike(KEY)).alias("bad_keys"),
        F.count_if(~F.col("kana").rlike(f"^{KANA['lexicon']}$")).alias("bad_kana"),
        (F.count("*") - F.countDistinct("word")).alias("duplicates"),
    )
    right = (F.col("size") >= floor) & (F.col("bad_keys") == 0) & (F.col("bad_kana") == 0) & (F.col("duplicates") == 0)
    return r.withColumn("passes", right & (F.lit(declared is None) | (F.col("size") == F.lit(declared))))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Words that both have."""
    return a.select("word").intersect(b.select("word"))


def difference(a: DataFrame, b: DataFrame, blocked: DataFrame) -> DataFrame:
    """Words of a that b lacks, without the blocked ones."""
    return a.select("word").join(blocked.select("word"), "word", "left_anti").join(b.select("word"), "word", "left_anti")


def homographs(words: DataFrame, table: DataFrame) -> DataFrame:
    """Words (lang, norm) that a language's homograph table claims from the lexicon."""
    return words.join(table.select("lang", F.col("word").alias("norm")), ["lang", "norm"], "left_semi")


def loan_lookup(words: DataFrame, loans: DataFrame) -> DataFrame:
    """words (lang, norm, folded) with loan_kana: by the bare form, then by the folded one."""
    by_norm = loans.select("lang", F.col("key").alias("norm"), F.col("kana").alias("_k1"))
    by_fold = loans.select("lang", F.col("key").alias("folded"), F.col("kana").alias("_k2"))
    return words.join(by_norm, ["lang", "norm"], "left").join(by_fold, ["lang", "folded"], "left").withColumn("loan_kana", F.coalesce("_k1", "_k2")).drop("_k1", "_k2")


def learned_lookup(words: DataFrame, learned: DataFrame) -> DataFrame:
    """words (norm, kana) with learned readings where the lexicon had none."""
    extra = learned.where(F.length("kana") <= MAX_KANA).select(F.col("word").alias("norm"), F.col("kana").alias("_l"))
    return words.join(extra, "norm", "left").withColumn("kana", F.coalesce("kana", "_l")).drop("_l")
