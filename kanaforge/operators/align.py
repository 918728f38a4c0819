"""Official readings of whole titles, aligned to their words; evaluation against gold readings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A title's segments: western words, kana, `&`, and digits (with an ordinal's tail) or Han, which may read as anything.
SEGMENT = "([0-9]+(?:st|nd|rd|th)?|[A-Za-z']+|[ァ-ヶーぁ-ゖ]+|&|[一-鿿]+)"


def segments(title: Column) -> Column:
    kind = lambda s: F.when(s.rlike("^[A-Za-z']"), "word").when(s == "&", "and").when(s.rlike("^[0-9一-鿿]"), "wild").otherwise("kana")
    return F.transform(F.regexp_extract_all(title, F.lit(SEGMENT), F.lit(1)), lambda s: F.struct(s.alias("text"), kind(s).alias("kind")))


def distances(expected: str, reading: str, start: int) -> list[int]:
    """Edit distances of expected to reading[start:start], reading[start:start + 1], ..., in one pass."""
    column = list(range(len(expected) + 1))
    out = [column[-1]]
    for y in reading[start:]:
        corner, column[0] = column[0], column[0] + 1
        for i, x in enumerate(expected, 1):
            corner, column[i] = column[i], min(column[i] + 1, column[i - 1] + 1, corner + (x != y))
        out.append(column[-1])
    return out


def align(parts: list[tuple[str, bool]], reading: str) -> list[str] | None:
    """The cut of a reading into one piece for each part, at the least total edit distance.

    parts: (expected kana, wild); a wild part costs nothing, others take one character at least; ties go to the
    cut that ends its first pieces earliest. Polynomial in the lengths: no title is too long."""
    total, best = len(reading), [{0: (0, 0)}]  # for each part: end -> (cost, start)
    for expected, wild in parts:
        here: dict[int, tuple[int, int]] = {}
        for start, (cost, _) in best[-1].items():
            costs = [0] * (total - start + 1) if wild else distances(expected, reading, start)
            for size in range(0 if wild else 1, len(costs)):
                new = cost + costs[size], start
                if start + size not in here or new[0] < here[start + size][0]:
                    here[start + size] = new
        best.append(here)
    if total not in best[-1]:
        return None
    out, end = [], total
    for ends in reversed(best[1:]):
        start = ends[end][1]
        out.append(reading[start:end])
        end = start
    return out[::-1]


def _pieces(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for parts, readings in batches:
        rows = zip(parts.to_pylist(), readings.to_pylist(), strict=True)
        yield pa.array([align([(x["expected"] or "", x["wild"]) for x in p], r) if p and r is not None else None for p, r in rows], pa.list_(pa.string()))


def pieces_column(parts: Column, reading: Column) -> Column:
    """parts: array of struct(expected, wild); one piece of the reading for each, or null."""
    return F.arrow_udf(_pieces, "array<string>")(parts, reading)


def accept(word: Column, expected: Column, piece: Column) -> Column:
    """Why an aligned piece is refused; null where it becomes a reading of its word."""
    d = F.levenshtein(expected, piece)
    return (
        F.when(F.length(word) < 2, "single letter")
        .when(expected.isNull() | (expected == ""), "unreadable")
        .when(piece.isNull() | F.trim(piece).isin("", "ー"), "empty")
        .when(expected == piece, "equal")
        .when(F.substring(expected, 1, 1) != F.substring(piece, 1, 1), "first sound")
        .when(F.abs(F.length(expected) - F.length(piece)) > 2, "length")
        .when(d > F.length(expected) / 2 + 1, "distance")
    )


def align_titles(titles: DataFrame, readings: DataFrame) -> DataFrame:
    """(title, ord, word, piece, expected, reason) for the words of titles (title, pronunciation); readings: (word, kana)."""
    parts = titles.select("title", "pronunciation", F.posexplode(segments(F.col("title"))).alias("ord", "s"))
    known = readings.select(F.col("word").alias("_w"), F.col("kana").alias("_k"))
    expected = F.when(F.col("s.kind") == "word", F.col("_k")).when(F.col("s.kind") == "and", "アンド").when(F.col("s.kind") == "kana", F.col("s.text"))
    joined = parts.join(known, F.lower("s.text") == F.col("_w"), "left").select("title", "pronunciation", "ord", F.col("s.text").alias("text"), F.col("s.kind").alias("kind"), expected.alias("expected"))
    row = F.array_sort(F.collect_list(F.struct("ord", "text", "kind", "expected", (F.col("kind") == "wild").alias("wild"))))
    whole = joined.groupBy("title", "pronunciation").agg(row.alias("parts"))
    cut = whole.withColumn("pieces", pieces_column(F.transform("parts", lambda p: F.struct(p["expected"].alias("expected"), p["wild"].alias("wild"))), F.col("pronunciation")))
    flat = cut.select("title", F.posexplode(F.arrays_zip("parts", "pieces")).alias("ord", "x")).where("x.parts.kind = 'word'")
    return flat.select("title", "ord", F.col("x.parts.text").alias("word"), F.col("x.pieces").alias("piece"), F.col("x.parts.expected").alias("expected"), accept(F.col("x.parts.text"), F.col("x.parts.expected"), F.col("x.pieces")).alias("reason"))


def merge_overrides(hand: DataFrame, made: DataFrame) -> DataFrame:
    """Hand-made overrides, and generated ones of other titles. Rows: (title, word, kana)."""
    return hand.unionByName(made.join(hand.select("title").distinct(), "title", "left_anti"))


def single_word_titles(titles: DataFrame, known: DataFrame, hand: DataFrame | None = None) -> DataFrame:
    """(title, word, reason): titles of one western word are candidates (reason null) for the lexicon.

    hand, known (word): words that the hand-made lexicon, or any other, has already."""
    words, first = F.regexp_extract_all("title", F.lit("[A-Za-z]+"), F.lit(0)), F.get("_w", F.lit(0))
    one = titles.withColumn("_w", words).withColumn("word", F.lower(first))
    one = one.join(known.select("word").distinct().withColumn("_known", F.lit(True)), "word", "left")
    one = one.join((known.limit(0) if hand is None else hand).select("word").distinct().withColumn("_hand", F.lit(True)), "word", "left")
    bad = F.col("title").isNull() | (F.trim("title") == "")
    reason = (
        F.when(bad, "bad")
        .when(F.size("_w") == 0, "no word")
        .when(F.size("_w") > 1, "several words")
        .when(F.col("title").rlike("[0-9]"), "digits")
        .when(F.col("title").rlike("[ぁ-ゖァ-ヺ一-鿿]"), "mixed")
        .when(F.col("title").rlike("[^A-Za-z ]"), "punctuation")
        .when(F.length(first) == 1, "single letter")
        .when(F.col("_hand"), "hand")
        .when(F.col("_known"), "known")
    )
    return one.select("title", "word", reason.alias("reason"))


def evaluate(gold: DataFrame, actual: DataFrame) -> DataFrame:
    """One row: words, exact matches, gaps known beforehand, unexplained misses, mean distance. gold: (word, kana, known_gap)."""
    j = gold.join(actual.select("word", F.col("kana").alias("got")), "word", "left")
    hit = F.coalesce(F.col("kana") == F.col("got"), F.lit(False))
    return j.agg(F.count("*").alias("words"), F.count_if(hit).alias("exact"), F.count_if(~hit & F.col("known_gap")).alias("known_gaps"), F.count_if(~hit & ~F.col("known_gap")).alias("unexplained"), F.avg(F.levenshtein("kana", F.coalesce("got", F.lit("")))).alias("mean_distance"))
