"""Batch twins of the streams, over the conversation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kanaforge.jobs.inputs import ANS, answers
from kanaforge.jobs.registry import query
from kanaforge.streaming import annotate as W
from kanaforge.streaming import learn as S


def _rows(spark, sf):
    a = answers(spark, sf)
    return S.answers_of(a.select("word", F.timestamp_seconds("stamp").alias("ts"), F.col("stamp").alias("n"), "kana", F.col("ctx").alias("line"), F.lit("").alias("local")))


@query("t1_learn")
def t1(spark, sf):
    """Every change of what is known of a word, over all answers."""
    return S.batch(_rows(spark, sf))


@query("t1_learned_first", rf"""WITH {ANS}, q AS (SELECT *, sum((stamp - before > {S.KEPT_DAYS * 86400})::INT) OVER (PARTITION BY word ORDER BY stamp) AS life FROM (SELECT *, lag(stamp, 1, stamp) OVER (PARTITION BY word ORDER BY stamp) AS before FROM an WHERE length(word) > 1)),
  v AS (SELECT * FROM q WHERE kana IS NOT NULL AND length(kana) <= 14), r AS (SELECT word, life, ctx, kana, stamp, lag(kana) OVER w AS k FROM v WINDOW w AS (PARTITION BY word, life ORDER BY stamp)),
  s AS (SELECT *, sum((k IS DISTINCT FROM kana)::INT) OVER (PARTITION BY word, life ORDER BY stamp) AS run FROM r), f AS (SELECT *, first_value(ctx) OVER (PARTITION BY word, life, run ORDER BY stamp) AS first_line FROM s)
  SELECT word, arg_min(kana, stamp) AS kana, min(stamp) AS n FROM f WHERE ctx <> first_line GROUP BY word""")
def t1f(spark, sf):
    """When each word was first learned: two lines in a run of equal answers, before the word was forgotten."""
    return S.batch(_rows(spark, sf)).where("status = 'learned'").groupBy("word").agg(F.min_by("kana", "n").alias("kana"), F.min("n").alias("n"))


@query("t7_answered_tokens", f"""WITH {ANS}, t AS (SELECT word, ctx, stamp, stamp - 5000 AS ts FROM an), b AS (SELECT word, ctx, stamp, max(kana) AS kana FROM an WHERE kana IS NOT NULL GROUP BY ALL), f AS (SELECT word, ctx, stamp, min(kana) AS kana FROM an WHERE kana IS NOT NULL GROUP BY ALL),
  j AS (SELECT t.*, b.kana AS bk, b.stamp AS bs FROM t ASOF LEFT JOIN b ON t.word = b.word AND t.ctx = b.ctx AND t.ts >= b.stamp), k AS (SELECT j.*, f.kana AS fk, f.stamp AS fs FROM j ASOF LEFT JOIN f ON j.word = f.word AND j.ctx = f.ctx AND j.ts < f.stamp)
  SELECT word AS key, ctx, stamp AS doc_id, CASE WHEN ts - bs <= 604800 THEN bk ELSE fk END AS kana, ts * 1000000 AS asked, (CASE WHEN ts - bs <= 604800 THEN bs ELSE fs END) * 1000000 AS answered FROM k WHERE ts - bs <= 604800 OR fs - ts <= 604800""")
def t7(spark, sf):
    """The batch twin of the stream of waiting tokens: every question half a turn before its answer."""
    a = answers(spark, sf)
    ts = F.timestamp_seconds(F.col("stamp") - 5000)
    none = F.lit(None).cast("string")
    tokens = a.select(F.col("stamp").alias("doc_id"), F.lit(0).alias("line_no"), ts.alias("ts"), "ctx", F.lit(0).alias("tok_no"), F.col("word").alias("text"), F.lit(0).alias("start"), F.length("word").alias("end"), F.col("word").alias("key"), none.alias("kana"))
    said = a.select(F.col("word").alias("key"), "ctx", "kana", F.timestamp_seconds("stamp").alias("at"))
    return W.answered(tokens, said).select("key", "ctx", "doc_id", "kana", "asked", "answered")
