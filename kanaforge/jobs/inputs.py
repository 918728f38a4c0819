"""Inputs of the registered queries, all derived from the given tables, and the same as SQL.

The tables hold no kana, so readings are spelled letter by letter through a fixed alphabet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kanaforge.functions import tokens as T
from kanaforge.functions.text import CYRILLIC, FOLDED_MARKS, GREEK, LATIN, WESTERN
from kanaforge.operators.lines import split_lines

LETTERS = "abcdefghijklmnopqrstuvwxyz"
SPELLED = "アベセデエフゲハイジカルムノオペクラサタウヴワザヤゼ"


def spread(df: DataFrame) -> DataFrame:
    """A table that is read in fewer parts than there are cores, such as one small file, dealt out to all of them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_lines(docs(spark, sf_dir))


def spelled(column):
    return F.translate(column, LETTERS, SPELLED)


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, kana, source, priority): the words of the conversations; a speaker is a source."""
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    words = talk.select("role", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).select("role", F.lower("w").alias("word")).distinct().where("length(word) >= 2")
    kana = F.when(F.col("role") == "user", spelled(F.col("word"))).otherwise(F.concat(spelled(F.col("word")), F.lit("ー")))
    source = F.when(F.col("role") == "user", "hand").otherwise("model")
    return words.select("word", kana.alias("kana"), source.alias("source"), F.when(F.col("role") == "user", 1).otherwise(3).alias("priority"))


def hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon(spark, sf_dir).where("source = 'hand'")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, ctx, kind, kana, is_miss, why, stamp): every word of every turn, asked in its conversation."""
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    asked = talk.select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("at", "w")).withColumn("word", F.lower("w"))
    miss = F.length("word") % 5 == 0
    kana = F.when(F.col("turn") % 4 == 3, F.concat(spelled(F.col("word")), F.lit("ン"))).otherwise(spelled(F.col("word")))
    stamp = F.col("conv_id").cast("long") * 1_000_000 + F.col("turn") * 10_000 + F.col("at")
    why = F.when(miss, F.when(F.length("word") > 5, "too long").otherwise("not kana"))
    return asked.select("word", F.col("conv_id").cast("string").alias("ctx"), F.when(F.col("turn") % 2 == 0, "model").otherwise("free").alias("kind"), F.when(~miss, kana).alias("kana"), miss.alias("is_miss"), why.alias("why"), stamp.alias("stamp"))


#: The same as SQL: WITH clauses to put before a query.
_WORD = rf"[{WESTERN}]+(?:[''’][{WESTERN}]+)*"
_MARKS = FOLDED_MARKS.replace("'", "''")
DL = "dl AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::INT AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)"
DW = f"dw AS (SELECT *, translate(lower(word), '{_MARKS}', '') AS norm FROM (SELECT doc_id, line_no, unnest(range(len(w)))::INT AS word_no, unnest(w) AS word FROM (SELECT doc_id, line_no, regexp_extract_all(line, '{_WORD}') AS w FROM dl)))"
LEX = f"""lx AS (SELECT word, CASE role WHEN 'user' THEN k ELSE k || 'ー' END AS kana, CASE role WHEN 'user' THEN 'hand' ELSE 'model' END AS source, CASE role WHEN 'user' THEN 1 ELSE 3 END AS priority
  FROM (SELECT DISTINCT role, lower(w) AS word, translate(lower(w), '{LETTERS}', '{SPELLED}') AS k FROM (SELECT role, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM conversations) WHERE length(w) >= 2))"""
ANS = f"""an AS (SELECT word, ctx, CASE WHEN turn % 2 = 0 THEN 'model' ELSE 'free' END AS kind, CASE WHEN length(word) % 5 = 0 THEN NULL WHEN turn % 4 = 3 THEN translate(word, '{LETTERS}', '{SPELLED}') || 'ン' ELSE translate(word, '{LETTERS}', '{SPELLED}') END AS kana,
    length(word) % 5 = 0 AS is_miss, CASE WHEN length(word) % 5 = 0 THEN CASE WHEN length(word) > 5 THEN 'too long' ELSE 'not kana' END END AS why, stamp
  FROM (SELECT lower(w) AS word, conv_id::VARCHAR AS ctx, turn, conv_id::BIGINT * 1000000 + turn * 10000 + pos AS stamp
    FROM (SELECT conv_id, turn, unnest(range(len(w))) AS pos, unnest(w) AS w FROM (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z]+') AS w FROM conversations))))"""


def _sql(chars: str) -> str:
    return chars.replace("'", "''")


#: The scanner in SQL, another way: every run of letters gets a mark at its end, so that letters strung by marks are told
#: from words without looking ahead; places are running sums.
_END = "⟂"
_STRUNG = f"[{LATIN}]{_END}(?:[{_sql(T.STRINGS)}][{LATIN}]{_END})+"
_PIECE = f"(?:[*＊]{{2,}})?[{WESTERN}]+{_END}(?:[{T.CIRCLES}]+(?:[{WESTERN}]+{_END})?|(?:[{_sql(T.JOINS)}]|[*＊]+)[{WESTERN}]+{_END})*"
_LIST = f"""CASE WHEN regexp_full_match(raw, '{_STRUNG}') THEN list_transform(list_filter(range(1, length(r) + 1), lambda k: regexp_matches(r[k], '[{WESTERN}&]')), lambda k: {{'off': k - 1, 'text': r[k], 'kind': CASE WHEN r[k] = '&' THEN 4 ELSE 3 END}})
      WHEN NOT starts_with(r, '*') AND len(parts) > 1 AND list_min(list_transform(parts, lambda x: length(x))) >= 2 THEN list_transform(range(1, len(parts) + 1), lambda k: {{'off': coalesce(list_sum(list_transform(parts[:k - 1], lambda x: length(x) + 1)), 0)::BIGINT, 'text': parts[k], 'kind': 2}})
      ELSE [{{'off': 0::BIGINT, 'text': r, 'kind': CASE WHEN starts_with(r, '*') THEN 1 ELSE 0 END}}] END"""
TK = f"""tk1 AS (SELECT doc_id, line_no, unnest(range(len(r)))::INT AS i, unnest(r) AS raw, unnest(g[:len(r)]) AS g FROM (SELECT doc_id, line_no, regexp_extract_all(s, '{_STRUNG}|{_PIECE}') AS r, regexp_split_to_array(s, '{_STRUNG}|{_PIECE}') AS g
    FROM (SELECT doc_id, line_no, regexp_replace(line, '([{WESTERN}]+)', '\\1{_END}', 'g') AS s FROM dl))),
tk2 AS (SELECT doc_id, line_no, raw, r, regexp_split_to_array(r, '[{T.DASHES}]') AS parts, sum(length(g) + length(r)) OVER (PARTITION BY doc_id, line_no ORDER BY i) - length(r) AS pos FROM (SELECT doc_id, line_no, i, raw, replace(raw, '{_END}', '') AS r, g FROM tk1)),
tk3 AS (SELECT doc_id, line_no, pos, unnest({_LIST}) AS x FROM tk2),
tk4 AS (SELECT doc_id, line_no, x.text AS text, (pos + x.off)::INT AS start, (pos + x.off + length(x.text))::INT AS "end", x.kind AS kind FROM tk3),
tk AS (SELECT tk4.*, line, (row_number() OVER w - 1)::INT AS tok_no, line[coalesce(lag("end") OVER w, 0) + 1:start] AS gap, line["end" + 1:coalesce(lead(start) OVER w, length(line))] AS gap_after, coalesce(lag(text) OVER w, '') AS tb, coalesce(lead(text) OVER w, '') AS ta,
    translate(lower(text), '{_MARKS}', '') AS norm, length(text) = 1 AS one, kind IN (3, 4) AS notation, count(*) FILTER (length(text) >= 2) OVER (PARTITION BY tk4.doc_id, tk4.line_no) AS long_words
  FROM tk4 JOIN dl USING (doc_id, line_no) WINDOW w AS (PARTITION BY tk4.doc_id, tk4.line_no ORDER BY start))"""
_TOUCH = _sql(T._TOUCH)
#: Flags of a token of tk.
FLAGS = {
    "script": f"CASE WHEN regexp_matches(text, '[{CYRILLIC}]') THEN 'cyrillic' WHEN regexp_matches(text, '[{GREEK}]') THEN 'greek' ELSE 'latin' END",
    "glued": f"(notation OR kind = 0 AND one AND (regexp_matches(gap, '[{_TOUCH}]$') OR regexp_matches(gap_after, '^[{_TOUCH}]')))",
    "emoticon": "(kind = 0 AND one AND (regexp_matches(gap, '[:：;；].?$') OR regexp_matches(gap_after, '^.?[:：;；]')))",
    "after_digit": "regexp_matches(gap, '[0-9０-９]$')",
    "label": "(kind = 0 AND regexp_matches(text, '^[A-Z]$') AND regexp_matches(gap_after, '^\\s*[:：]'))",
    "diacritic": "(kind = 0 AND regexp_matches(text, '[^\\x00-\\x7F]'))",
    "before": "CASE WHEN NOT regexp_matches(gap, '\\S') THEN right(tb, 1) ELSE regexp_extract(gap, '(\\S)\\s*$', 1) END",
    "before_spaced": "(regexp_matches(gap, '\\s$') AND (tb <> '' OR regexp_matches(gap, '\\S')))",
    "after": "CASE WHEN NOT regexp_matches(gap_after, '\\S') THEN left(ta, 1) ELSE regexp_extract(gap_after, '^\\s*(\\S)', 1) END",
    "after_spaced": "(regexp_matches(gap_after, '^\\s') AND (ta <> '' OR regexp_matches(gap_after, '\\S')))",
    "japanese": f"(regexp_matches(gap, '[{T.JAPANESE}]$') OR regexp_matches(gap_after, '^[{T.JAPANESE}]'))",
    "before_digit": "regexp_matches(gap_after, '^[0-9０-９]')",
    "after_mask": "regexp_matches(gap, '[*＊]{2}$')",
    "censored": "(regexp_matches(lower(text), '^(?:bbb?|ccc?|ddd?|fff?|ggg?|hhh?|jjj?|kkk?|lll?|mmm?|nnn?|ppp?|qqq?|rrr?|sss?|ttt?|vvv?|www?|xxx?|yyy?|zzz?)$') AND (regexp_matches(gap_after, '^[”’\"'')）」』\\]]?[ぁ-ゖ]') OR regexp_matches(gap, '\\*\\*$') OR regexp_matches(gap_after, '^\\*\\*')))",
    "other_word": "(long_words - (length(text) >= 2)::INT > 0)",
    "readable": r"""CASE WHEN norm = '' THEN false WHEN kind IN (3, 4) THEN true
      WHEN len(norm) > 1 AND regexp_matches(norm, '^[bcdfghjklmnpqrstvwxyz]+$') AND replace(norm, norm[1], '') = '' THEN CASE WHEN regexp_matches(gap, '[0-9０-９]$') THEN length(norm) <= 3 ELSE regexp_matches(text, '^[BCDFGHJKLMNPQRSTVWXYZ]{2,3}$') END
      WHEN length(norm) = 1 THEN CASE WHEN GLUED AND NOT EMOTICON THEN false WHEN EMOTICON OR regexp_matches(text, '^[A-Z]$') THEN true ELSE (kind = 0 AND regexp_matches(text, '[^\x00-\x7F]')) OR norm IN ('a', 'i', 'o') END ELSE true END""",
}
FLAGS["readable"] = FLAGS["readable"].replace("GLUED", FLAGS["glued"]).replace("EMOTICON", FLAGS["emoticon"])


def flag_columns(*names: str) -> str:
    return ", ".join(f"{FLAGS[n]} AS {n}" for n in names)
