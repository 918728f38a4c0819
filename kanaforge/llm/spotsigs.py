"""SpotSigs fingerprints. DataFrame and SQL functions only.

A spot signature is a common-word anchor (or a run of anchors) with the two content words that follow it; a
fingerprint is the set of a text's signatures, hashed to 32 bits and sorted. A text with fewer than ENOUGH of them also
gets chains of neighbouring words, of single characters in scripts without spaces: the share of its chains that
it lacks signatures, picked by their hashes, so that texts with about as many signatures pick the same ones and a
text that gains or loses an anchor hardly changes. Likeness is the Jaccard similarity of two sets. near_pairs joins
whole tables: classes of equal sets, partitioned by set length so that only neighbouring partitions can reach
the threshold, candidates by their rarest signatures, and an exact Jaccard check.

Defined cases: null texts are empty; two empty fingerprints have likeness 1; whole texts are read; equal texts
have equal fingerprints; a single document is its own next one; repeated ids follow each other in the order of a hash of their
texts; null ids come last; an empty table gives an empty one.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Anchors, the commonest function words of the languages at hand.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au ce de des du elle en est et il la le les par pas pour que qui sur un une "
    "das dem den der die ein eine er es ist mit nicht sich und von zu "
    "al como con del el las los no para por se su una y"
).split()
#: Signatures from which on a text needs no chains of other words.
ENOUGH = 48
#: Characters of scripts without spaces.
UNSPACED = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}])"
#: Sizes that signatures are counted in: a fixed number at any size of the corpus.
COUNTED = 1 << 16
#: Documents of one id range, about, and ranges at most (bounds what is broadcast).
RANGE_ROWS, MAX_RANGES = 2_000, 65_536


def spots(text: Column) -> Column:
    """A text's spot signatures: sorted array of distinct hashes."""
    words = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")
    hung = F.regexp_replace(F.trim(words), rf"(?<![^ ])({'|'.join(ANCHORS)}) ", "$1~")  # "~" cannot occur in a word
    return bound(F.split(hung, " "), lambda parts: F.array_sort(F.array_distinct(F.array_compact(F.zip_with(parts, F.slice(parts, 2, F.size(parts)), _spot)))))


def _spot(x: Column, y: Column) -> Column:
    return F.when(F.contains(x, F.lit("~")) & y.isNotNull(), F.hash(x, F.substring_index(y, "~", -1)))


def bound(value: Column, use) -> Column:
    """use(value), with value computed once: outside of generated code Spark would repeat it at each use."""
    return F.transform(F.array(value), use)[0]


def chains(text: Column) -> Column:
    """Hashes of all pairs of neighbouring words, or of characters in scripts without spaces; of the word where there
    is one only. Texts without letters and digits are split at white space."""
    words = F.regexp_replace(F.regexp_replace(F.lower(text), UNSPACED, " $1 "), r"[^\p{L}\p{N}]+", " ")
    units = lambda t, mark: F.filter(F.split(t, mark), lambda w: w != "")
    both = bound(units(words, " "), lambda u: F.when(F.size(u) > 0, u).otherwise(units(F.lower(text), r"\s+")))
    pairs = lambda u: F.when(F.size(u) == 1, F.transform(u, lambda w: F.hash(w))).otherwise(F.zip_with(F.slice(u, 1, F.greatest(F.size(u) - 1, F.lit(0))), F.slice(u, 2, F.size(u)), lambda x, y: F.hash(x, F.lit(0), y)))
    return bound(both, pairs)


def signatures(text: Column) -> Column:
    """Spot signatures, with chains where there are few of them."""
    lowest = lambda s: F.lit(-(1 << 31)) + F.lit(1 << 32) * (ENOUGH - F.size(s)) / ENOUGH
    more = lambda s: F.array_sort(F.array_distinct(F.concat(s, F.filter(chains(text), lambda h: h < lowest(s)))))
    return bound(spots(text), lambda s: F.when(F.size(s) >= ENOUGH, s).otherwise(more(s)))


def likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, 1.0).otherwise(both / either)


def as_text(sigs: Column) -> Column:
    return F.array_join(sigs.cast("array<string>"), ",")


def id_ranges(docs: DataFrame) -> Column:
    """Number of the id range of a document, from quantiles of the ids: two lookups in short arrays."""
    spark = docs.sparkSession
    rows = docs.count()
    n = min(MAX_RANGES, max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), rows // RANGE_ROWS))
    cuts = docs.agg(F.percentile_approx("_id", [i / n for i in range(1, n)], max(10_000, 4 * n))).first()[0] if n > 1 else []
    cuts = sorted(set(cuts or []))
    if not cuts:
        return F.lit(0)
    width = math.isqrt(len(cuts)) + 1
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    text = lambda xs: "array(" + ", ".join(f"{x}L" if x > -(1 << 63) else "(-9223372036854775807L - 1L)" for x in xs) + ")"
    group = f"size(filter({text([g[0] for g in groups])}, x -> x <= _id))"
    inner = "array(array(cast(NULL AS bigint)), " + ", ".join(text(g) for g in groups) + ")"
    return F.expr(f"{group} * {width} + size(filter({inner}[{group}], x -> x <= _id))")


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, sigs, next): each document with the struct (text, sigs) of the next one, descending doc_id.

    One exchange: rows meet by id range, and each range also gets the first row of the following one."""
    base = docs.select("doc_id", F.coalesce("doc_id", F.expr("-9223372036854775807L - 1L")).cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranged = base.withColumn("_range", id_ranges(base.select("_id")))
    firsts = ranged.groupBy("_range").agg(F.max("_id").alias("_first"))
    down = Window.orderBy(F.desc("_first"))  # a row for each range
    after = firsts.select(F.col("_range").alias("_to"), F.coalesce(F.lead("_first").over(down), F.max("_first").over(Window.partitionBy(F.lit(0)))).alias("_id"))
    guests = base.join(F.broadcast(after), "_id").select("doc_id", "_id", "text", F.col("_to").alias("_range"), F.lit(1).alias("_guest"))
    rows = ranged.select("doc_id", "_id", "text", "_range", F.lit(0).alias("_guest")).unionByName(guests)
    rows = rows.select("doc_id", "_id", "_range", "_guest", F.struct("text", signatures(F.col("text")).alias("sigs")).alias("own"))
    order = Window.partitionBy("_range").orderBy("_guest", F.desc("_id"), F.xxhash64("own.text"))
    return rows.withColumn("next", F.lead("own").over(order)).where("_guest = 0").select("doc_id", "own.text", "own.sigs", "next")


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next.text"), F.lit(1), third))
    rows = with_next(docs).select("doc_id", n.cast("long").alias("n_chars"), "sigs", F.col("next.sigs").alias("next_sigs"), edited.alias("edited"))
    rows = rows.select("*", signatures(F.col("edited")).alias("edited_sigs"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text(F.col("sigs")).alias("fingerprint"),
        as_text(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b, similarity) between class representatives at the threshold or above, and
    (doc_id, rep) of every document. A class is one set of signatures; its representative the smallest doc_id."""
    rows = docs.select("doc_id", signatures(F.coalesce("text", F.lit(""))).alias("sigs"))
    classes = rows.groupBy("sigs").agg(F.min("doc_id").alias("rep"))
    members = rows.join(classes, "sigs").select("doc_id", "rep")
    sized = classes.withColumn("n", F.size("sigs")).where("n > 0").withColumn("part", F.floor(F.log("n") / math.log(1 / threshold)).cast("int"))
    # how common signatures are only orders them, so counts of their hashes' low bits do
    often = {r["at"]: r["n"] for r in classes.select(F.explode("sigs").alias("sig")).groupBy(F.expr(f"sig & {COUNTED - 1}").alias("at")).agg(F.count("*").alias("n")).collect()}
    counts = F.from_json(F.lit(json.dumps([often.get(i, 0) for i in range(COUNTED)])), "array<bigint>")
    ordered = F.array_sort(F.transform("sigs", lambda x: F.struct(F.get(counts, x.bitwiseAND(COUNTED - 1)).alias("count"), x.alias("sig"))))
    first = F.slice(ordered, 1, (F.col("n") - F.ceil(F.col("n") * threshold) + 1).cast("int"))
    rare = sized.select("rep", "n", "part", F.explode(F.transform(first, lambda x: x["sig"])).alias("sig"))
    left = rare.select(F.col("rep").alias("a"), F.col("n").alias("an"), "sig", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    right = rare.select(F.col("rep").alias("b"), F.col("n").alias("bn"), "sig", "part")
    # sizes are compared as (n, id), so each pair is met from its smaller side; the length bound prunes the rest
    met = left.join(right, ["sig", "part"]).where("(an < bn OR an = bn AND a < b) AND an >= bn * " + repr(threshold)).select("a", "b").distinct()
    sets = classes.select("rep", "sigs")
    full = met.join(sets.select(F.col("rep").alias("a"), F.col("sigs").alias("sa")), "a").join(sets.select(F.col("rep").alias("b"), F.col("sigs").alias("sb")), "b")
    pairs = full.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), likeness(F.col("sa"), F.col("sb")).alias("similarity")).where(F.col("similarity") >= threshold)
    return pairs, members
