"""Queries over the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kanaforge.jobs.inputs import LEX, SPELLED, hand, lexicon, spelled
from kanaforge.jobs.registry import query
from kanaforge.operators.spans import ranked
from kanaforge.sources import files as S
from kanaforge.sources import versions as V
from kanaforge.sources.scratch import shared_folder


@query("s1_loan_errors", f"WITH {LEX}, l AS (SELECT CASE WHEN length(word) % 7 = 0 THEN word || kana WHEN length(word) % 5 = 0 THEN ':' || kana WHEN length(word) % 3 = 0 THEN word || ':' || word ELSE word || ':' || kana END AS line, word, source FROM lx), m AS (SELECT *, CASE WHEN length(word) % 7 = 0 THEN 'no colon' WHEN length(word) % 5 = 0 THEN 'empty word' WHEN length(word) % 3 = 0 THEN 'not kana' END AS why FROM l), d AS (SELECT word FROM m WHERE why IS NULL GROUP BY word HAVING count(*) > 1) SELECT line, coalesce(why, 'duplicate') AS why FROM m WHERE why IS NOT NULL OR word IN (SELECT word FROM d)")
def s1(spark, sf):
    n = F.length("word")
    line = F.when(n % 7 == 0, F.concat("word", "kana")).when(n % 5 == 0, F.concat(F.lit(":"), "kana")).when(n % 3 == 0, F.concat("word", F.lit(":"), "word")).otherwise(F.concat("word", F.lit(":"), "kana"))
    return S.parse_loans(lexicon(spark, sf).select(F.lit("xx").alias("lang"), line.alias("line")))[1].select("line", "why")


@query("s3_frequency_words", f"WITH {LEX}, r AS (SELECT word, length(word)::BIGINT * 1000000 + row_number() OVER (ORDER BY word) AS rank FROM (SELECT DISTINCT word FROM lx)) SELECT rank, word FROM r WHERE regexp_matches(word, '^[a-z]{{2,14}}$') AND NOT regexp_matches(word, 'aaa|bbb|ccc|ddd|eee|fff|ggg|hhh|iii|jjj|kkk|lll|mmm|nnn|ooo|ppp|qqq|rrr|sss|ttt|uuu|vvv|www|xxx|yyy|zzz') ORDER BY rank, word LIMIT 500")
def s3(spark, sf):
    words = ranked(lexicon(spark, sf).select("word").distinct(), ["word"])
    return S.frequency_words(words.withColumn("rank", F.length("word").cast("long") * 1_000_000 + F.col("rank")), 500)


@query("s4_bundle_round_trip", f"WITH {LEX}, m AS (SELECT word, min(kana) AS kana, count(*) AS lines FROM lx WHERE source = 'model' GROUP BY word) SELECT 'learned' AS part, word, kana, NULL::BIGINT AS lines FROM lx WHERE source = 'hand' UNION ALL SELECT 'llm', * FROM m UNION ALL SELECT 'free', word, kana, NULL FROM lx WHERE source = 'model' AND length(word) > 6")
def s4(spark, sf):
    own, model = hand(spark, sf), lexicon(spark, sf).where("source = 'model'")
    asked = model.groupBy("word").agg(F.min("kana").alias("kana"), F.count("*").alias("lines"), F.lit(True).alias("consistent"))
    learned, llm, free = S.read_bundle(S.write_bundle(own, asked, model.where("length(word) > 6")))
    none = F.lit(None).cast("long").alias("lines")
    return learned.select(F.lit("learned").alias("part"), "word", "kana", none).unionByName(llm.select(F.lit("llm").alias("part"), "word", "kana", "lines")).unionByName(free.select(F.lit("free").alias("part"), "word", "kana", none))


_BUNDLES = """bu AS (SELECT word, source, CASE WHEN length(word) % 7 = 0 THEN '{"version":1,"learned":[]}' WHEN length(word) % 5 = 0 THEN '{"version":2,"learned":[{"word":"' || word || '","kana":"' || kana || '"}]}' WHEN length(word) % 3 = 0 THEN '{"version":1,"learned":[{"word":"' || word || '","ka' ELSE '{"version":1,"learned":[{"word":"' || word || '","kana":"' || kana || '"}]}' END AS bundle FROM lx)"""


@query("s4_bundle_errors", f"WITH {LEX}, {_BUNDLES} SELECT word, source, CASE WHEN length(word) % 7 = 0 THEN 'empty' WHEN length(word) % 5 = 0 THEN 'version' ELSE 'broken' END AS why FROM bu WHERE length(word) % 7 = 0 OR length(word) % 5 = 0 OR length(word) % 3 = 0")
def s4_errors(spark, sf):
    """Every word as a bundle of its own; some are cut off, some of a version to come, some hold nothing."""
    n, rest = F.length("word"), F.concat(F.lit('[{"word":"'), F.col("word"), F.lit('","kana":"'), F.col("kana"), F.lit('"}]}'))
    text = F.when(n % 7 == 0, '{"version":1,"learned":[]}').when(n % 5 == 0, F.concat(F.lit('{"version":2,"learned":'), rest)).when(n % 3 == 0, F.concat(F.lit('{"version":1,"learned":[{"word":"'), F.col("word"), F.lit('","ka'))).otherwise(F.concat(F.lit('{"version":1,"learned":'), rest))
    return S.bundle_errors(lexicon(spark, sf).select("word", "source", text.alias("bundle"))).select("word", "source", "why")


_KINDS = "word string, kana string"


@query("s5_version_load", f"WITH {LEX} SELECT word, kana FROM lx WHERE source = 'model'")
def s5_versions(spark, sf):
    """The newest of two versions, saved and loaded with all its checks."""
    folder = f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}"
    for rows in (hand(spark, sf), lexicon(spark, sf).where("source = 'model'")):
        V.save(rows.select("word", "kana"), folder)
    return V.load(spark, folder, _KINDS)


@query("j10_version_drift", f"WITH {LEX}, n AS (SELECT word, CASE WHEN word[1] = 'a' AND length(word) % 2 = 0 THEN kana || 'ー' ELSE kana END AS kana FROM lx WHERE source = 'hand' AND NOT (word[1] = 'b' AND length(word) = 4)) SELECT coalesce(a.word, n.word) AS word, CASE WHEN n.word IS NULL THEN 'missing' ELSE 'changed' END AS change FROM (SELECT * FROM lx WHERE source = 'hand') a LEFT JOIN n USING (word) WHERE n.word IS NULL OR n.kana <> a.kana")
def j10_versions(spark, sf):
    """What changed between two versions of which few buckets differ."""
    folder = f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}"
    first = hand(spark, sf).select("word", "kana")
    drawn = F.col("word").startswith("a") & (F.length("word") % 2 == 0)
    second = first.where(~(F.col("word").startswith("b") & (F.length("word") == 4))).withColumn("kana", F.when(drawn, F.concat("kana", F.lit("ー"))).otherwise(F.col("kana")))
    old, new = V.save(first, folder), V.save(second, folder)
    return V.drift(spark, folder, old, new, _KINDS)


@query("s5_valid_snapshot", f"WITH {LEX} SELECT word, kana FROM lx WHERE regexp_matches(word, '^[a-z]+$') AND regexp_matches(kana, '^[ァ-ヶーヿ]+$')")
def s5(spark, sf):
    return S.valid_snapshot(lexicon(spark, sf).select("word", "kana"))


@query("s6_page_blocks")
def s6(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return pages.select("page_id", F.posexplode(S.page_blocks(F.col("html"))).alias("ord", "line"))


@query("s6_page_text", r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def s6t(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", S.page_text(F.col("html")).alias("text"))


@query("s2_titles", r"SELECT DISTINCT p_name AS title, regexp_replace(translate(lower(regexp_replace(p_name, '[^A-Za-z ]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz ', '%s'), '[^ァ-ヺー]', '', 'g') AS pronunciation FROM part" % SPELLED)
def s2(spark, sf):
    """Titles with readings in mixed kana, with spaces and marks, as the reader cleans them."""
    name = F.lower(F.regexp_replace("p_name", "[^A-Za-z ]", ""))
    raw = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_name").alias("title"), F.concat(F.translate(spelled(name), "アイウエオ", "あいうえお"), F.lit("・ !")).alias("pronunciation")).distinct()
    return S.clean_titles(raw)
