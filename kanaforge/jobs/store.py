"""Queries over lexicons, answers, usage and event logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from kanaforge.functions import kana as K
from kanaforge.jobs.inputs import ANS, LEX, LETTERS, SPELLED, answers, hand, lexicon, spelled
from kanaforge.jobs.registry import query
from kanaforge.operators import answers as A
from kanaforge.operators import lexicon as X
from kanaforge.operators import usage as U
from kanaforge.operators.spans import ranked
from kanaforge.streaming.annotate import cached

_K = "^[゠-ヿー]+$"


def _events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet")


def _model(spark, sf):
    return lexicon(spark, sf).where("source = 'model'")


def _blocked(spark, sf):
    return lexicon(spark, sf).where("length(word) = 4").select("word").distinct()


@query("a11_build_lexicon", f"WITH {LEX} SELECT word, kana, source, priority FROM lx WHERE NOT (source = 'model' AND length(word) = 4) QUALIFY row_number() OVER (PARTITION BY word ORDER BY priority, source, kana) = 1")
def a11(spark, sf):
    return X.build(lexicon(spark, sf), _blocked(spark, sf))[0]


@query("a11_build_counters", f"""WITH {LEX}, s AS (SELECT *, CASE WHEN source = 'model' AND length(word) = 4 THEN 'blocked' ELSE 'ok' END AS st FROM lx), r AS (SELECT *, row_number() OVER (PARTITION BY word, st ORDER BY priority, source, kana) AS n FROM s)
  SELECT source, CASE WHEN st = 'blocked' THEN 'blocked' WHEN n = 1 THEN 'added' ELSE 'skipped' END AS status, count(*) AS rows FROM r GROUP BY ALL""")
def a11c(spark, sf):
    return X.build(lexicon(spark, sf), _blocked(spark, sf))[1]


@query("w2_pick_by_priority", f"WITH {LEX} SELECT word, kana FROM lx QUALIFY row_number() OVER (PARTITION BY word ORDER BY priority DESC, kana) = 1")
def w2(spark, sf):
    return X.pick_by_priority(lexicon(spark, sf), "word", F.desc("priority"), "kana").select("word", "kana")


@query("j10_lexicon_drift", f"WITH {LEX} SELECT coalesce(a.word, b.word) AS word, CASE WHEN b.word IS NULL THEN 'missing' WHEN a.word IS NULL THEN 'extra' ELSE 'changed' END AS change FROM (SELECT * FROM lx WHERE source = 'hand') a FULL JOIN (SELECT * FROM lx WHERE source = 'model') b ON a.word = b.word WHERE a.word IS NULL OR b.word IS NULL OR a.kana <> b.kana")
def j10(spark, sf):
    return X.drift(hand(spark, sf), _model(spark, sf))


@query("j9_learned_lookup", f"WITH {LEX}, h AS (SELECT * FROM lx WHERE source = 'hand' AND length(word) % 2 = 0), m AS (SELECT * FROM lx WHERE source = 'model' AND length(kana) <= 14) SELECT w.word AS norm, coalesce(h.kana, m.kana) AS kana FROM (SELECT DISTINCT word FROM lx) w LEFT JOIN h USING (word) LEFT JOIN m USING (word)")
def j9(spark, sf):
    words = lexicon(spark, sf).select("word").distinct().join(hand(spark, sf).where("length(word) % 2 = 0").select("word", "kana"), "word", "left")
    return X.learned_lookup(words.withColumnRenamed("word", "norm"), _model(spark, sf))


@query("j4_loan_lookup", f"WITH {LEX}, l AS (SELECT word AS key, kana FROM lx WHERE source = 'hand'), w AS (SELECT DISTINCT word AS norm, CASE WHEN length(word) > 6 THEN word[:6] ELSE word END AS folded FROM lx WHERE source = 'model') SELECT norm, coalesce(a.kana, b.kana) AS loan_kana FROM w LEFT JOIN l a ON a.key = norm LEFT JOIN l b ON b.key = folded")
def j4(spark, sf):
    loans = hand(spark, sf).select(F.lit("de").alias("lang"), F.col("word").alias("key"), "kana")
    words = _model(spark, sf).select(F.lit("de").alias("lang"), F.col("word").alias("norm"), F.substring("word", 1, 6).alias("folded")).distinct()
    return X.loan_lookup(words, loans).select("norm", "loan_kana")


@query("q1_lexicon_quality", f"WITH {LEX} SELECT count(*) AS size, count(*) FILTER (NOT regexp_matches(word, '^[a-z]+$')) AS bad_keys, count(*) FILTER (NOT regexp_matches(kana, '{_K}')) AS bad_kana, count(*) - count(DISTINCT word) AS duplicates, count(*) >= 4000 AND count(*) = count(DISTINCT word) AND count(*) FILTER (NOT regexp_matches(word, '^[a-z]+$') OR NOT regexp_matches(kana, '{_K}')) = 0 AS passes FROM lx")
def q1(spark, sf):
    return X.quality(lexicon(spark, sf))


@query("u1_union_sources", f"WITH {LEX} SELECT source, count(*) AS words, min(length(kana)) AS shortest, max(length(kana)) AS longest FROM lx GROUP BY source")
def u1(spark, sf):
    both = hand(spark, sf).unionByName(_model(spark, sf), allowMissingColumns=True)
    return both.groupBy("source").agg(F.count("*").alias("words"), F.min(F.length("kana")).alias("shortest"), F.max(F.length("kana")).alias("longest"))


@query("u2_overlap", f"WITH {LEX} SELECT word FROM lx WHERE source = 'hand' INTERSECT SELECT word FROM lx WHERE source = 'model'")
def u2(spark, sf):
    return X.overlap(hand(spark, sf), _model(spark, sf))


@query("u3_difference", f"WITH {LEX} SELECT word FROM lx WHERE source = 'model' AND length(word) <> 4 AND word NOT IN (SELECT word FROM lx WHERE source = 'hand')")
def u3(spark, sf):
    return X.difference(_model(spark, sf), hand(spark, sf), _blocked(spark, sf))


@query("k3_sorted_lexicon", f"WITH {LEX} SELECT word, min(kana) AS kana, row_number() OVER (ORDER BY word) AS place FROM lx WHERE source = 'hand' GROUP BY word")
def k3(spark, sf):
    return ranked(hand(spark, sf).select("word", "kana"), ["word"], "place").select("word", "kana", "place")


# -- answers -----------------------------------------------------------------------------------------------


@query("a8_consolidate", f"WITH {ANS} SELECT word, arg_min(kana, (stamp, kana)) AS kana, count(DISTINCT ctx) AS lines, count(DISTINCT kana) = 1 AS consistent FROM an WHERE NOT is_miss GROUP BY word")
def a8(spark, sf):
    return A.consolidate(answers(spark, sf))


@query("w6_latest_reading", f'''WITH {ANS} SELECT word, arg_max(kana, (stamp, kana)) AS kana, max(stamp) AS stamp FROM an WHERE NOT is_miss GROUP BY word''')
def w6(spark, sf):
    return A.latest_readings(answers(spark, sf))


@query("j7_answer_lookup", f"WITH {ANS}, t AS (SELECT DISTINCT word, ctx FROM an UNION SELECT DISTINCT word, 'elsewhere' FROM an), o AS (SELECT word, ctx, arg_max(kana, stamp) FILTER (stamp = m) AS kana, bool_or(is_miss) FILTER (stamp = m) AS miss FROM (SELECT *, max(stamp) OVER (PARTITION BY word, ctx) AS m FROM an) GROUP BY ALL), l AS (SELECT word, arg_max(kana, (stamp, kana)) AS kana FROM an WHERE NOT is_miss GROUP BY word) SELECT t.word, t.ctx, CASE WHEN o.miss THEN NULL ELSE coalesce(o.kana, l.kana) END AS kana, o.miss IS NOT NULL AS asked FROM t LEFT JOIN o USING (word, ctx) LEFT JOIN l ON l.word = t.word")
def j7(spark, sf):
    a = answers(spark, sf)
    return A.lookup(a.select("word", "ctx").union(a.select("word", F.lit("elsewhere"))).distinct(), a)


_EVIDENCE = f"""{ANS}, {LEX}, co AS (SELECT word, arg_min(kana, (stamp, kana)) AS kana, count(DISTINCT ctx) AS lines, count(DISTINCT kana) = 1 AS consistent FROM an WHERE NOT is_miss GROUP BY word),
ev AS (SELECT word, min(kana) AS kana, sum(lines)::BIGINT AS lines, bool_and(consistent) AND count(DISTINCT kana) = 1 AS consistent FROM (SELECT word, kana, 2 AS lines, true AS consistent FROM lx WHERE source = 'hand' UNION ALL SELECT * FROM co UNION ALL SELECT word, kana, 2, true FROM lx WHERE source = 'model') GROUP BY word)"""


def _evidence(spark, sf):
    return A.evidence(hand(spark, sf), A.consolidate(answers(spark, sf)), _model(spark, sf))


@query("a9_collect_evidence", f"WITH {_EVIDENCE} SELECT * FROM ev")
def a9(spark, sf):
    return _evidence(spark, sf)


#: Words of three letters and less that are romanised Japanese, and how; few readings of the tables, spelled out, are the same.
_SHORT = {a + b for a in K.SYLLABLES for b in ("", "n", *[x for x in K.SYLLABLES if len(x) < 3]) if len(a + b) <= 3} | {"n" + x for x in K.SYLLABLES if len(x) < 3} | {x * 3 for x in "aiueo"}
_TWO_WAY = ", ".join(f"('{w}', '{K.romaji_to_kana(w)}')" for w in sorted(w for w in _SHORT if K.romaji_to_kana(w)))


@query("a10_promote", f"""WITH {_EVIDENCE}, h AS (SELECT word FROM lx WHERE source = 'hand' AND length(word) % 3 = 0), m AS (SELECT word, kana AS old_kana FROM lx WHERE source = 'model'), b AS (SELECT DISTINCT word FROM lx WHERE length(word) = 4), tw(word, romaji) AS (VALUES {_TWO_WAY})
  SELECT ev.word, kana, lines, consistent, old_kana, CASE WHEN NOT regexp_matches(ev.word, '^[a-z]+$') THEN 'key' WHEN NOT regexp_matches(kana, '^[ァ-ヶーヿ]+$') THEN 'kana' WHEN length(kana) > 14 THEN 'length' WHEN NOT consistent THEN 'inconsistent' WHEN lines < 2 THEN 'few lines'
    WHEN b.word IS NOT NULL THEN 'blocked' WHEN tw.word IS NOT NULL THEN 'ambiguous' WHEN h.word IS NOT NULL THEN 'in hand lexicon' WHEN ev.word IN ('und', 'les', 'que') THEN 'foreign' WHEN old_kana = kana THEN 'same' END AS reason
  FROM ev LEFT JOIN h ON h.word = ev.word LEFT JOIN m ON m.word = ev.word LEFT JOIN b ON b.word = ev.word LEFT JOIN tw ON tw.word = ev.word AND tw.romaji <> ev.kana""")
def a10(spark, sf):
    foreign = spark.sql("SELECT * FROM VALUES ('und'), ('les'), ('que') AS t(word)")
    return A.promote(_evidence(spark, sf), hand(spark, sf).where("length(word) % 3 = 0"), _model(spark, sf), _blocked(spark, sf), foreign)


@query("a13_reject_report", f"WITH {ANS} SELECT why, count(*) AS rows FROM an WHERE why IS NOT NULL GROUP BY why")
def a13(spark, sf):
    return A.reject_report(answers(spark, sf))


@query("a13_latest_rejects", f"WITH {ANS} SELECT word, ctx, why, stamp FROM an WHERE why IS NOT NULL ORDER BY stamp DESC, word, ctx LIMIT 30")
def a13l(spark, sf):
    return A.latest_rejects(answers(spark, sf)).select("word", "ctx", "why", "stamp")


@query("w3_evict_oldest", f'''WITH {ANS} SELECT word, max(stamp) AS stamp FROM an GROUP BY word ORDER BY stamp DESC, word LIMIT 800''')
def w3(spark, sf):
    return A.evict_oldest(answers(spark, sf).groupBy("word").agg(F.max("stamp").alias("stamp")), 800, "stamp", "word")


@query("k1_list_learned", f'''WITH {ANS} SELECT word, arg_max(kana, (stamp, kana)) AS kana, max(stamp) AS stamp FROM an WHERE NOT is_miss GROUP BY word ORDER BY stamp DESC, word LIMIT 50''')
def k1(spark, sf):
    return A.latest_readings(answers(spark, sf)).orderBy(F.desc("stamp"), "word").limit(50)


@query("f9_first_sound", f"""WITH {LEX}, s(l, rows) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in A.FIRST_SOUNDS.items())}) SELECT word, kana, s.rows IS NULL OR contains(CASE WHEN word LIKE 'th%' THEN s.rows || '{A.VOICED_TH}' ELSE s.rows END, kana[1]) AS ok FROM lx LEFT JOIN s ON s.l = word[1]""")
def f9(spark, sf):
    return lexicon(spark, sf).select("word", "kana", A.first_sound_ok(F.col("word"), F.col("kana")).alias("ok"))


@query("t3_answer_cache", f"""WITH {ANS}, c AS (SELECT *, make_timestamp(stamp * 1000000) AS told FROM an), k AS (SELECT * FROM c WHERE told > (SELECT max(told) FROM c) - CASE kind WHEN 'model' THEN INTERVAL 180 DAY ELSE INTERVAL 30 DAY END)
  SELECT kind, word, ctx, arg_min(kana, stamp) FILTER (stamp = m) AS kana, bool_or(is_miss) FILTER (stamp = m) AS is_miss, min(stamp) AS stamp FROM (SELECT *, min(stamp) OVER (PARTITION BY kind, word, ctx) AS m FROM k) GROUP BY kind, word, ctx""")
def t3(spark, sf):
    """The batch twin of the answer cache: first fresh answer of each question from each source."""
    rows = answers(spark, sf).select("kind", "word", "ctx", "kana", "is_miss", "stamp", F.timestamp_seconds("stamp").alias("at"))
    return cached(rows).select("kind", "word", "ctx", "kana", "is_miss", "stamp")


@query("t3_retried_misses", f"WITH {ANS}, w AS (SELECT word, ctx, count(*) AS tries FROM an GROUP BY word, ctx) SELECT w.word, w.ctx, CASE WHEN m.word IS NULL THEN tries ELSE 0 END AS tries FROM w LEFT JOIN (SELECT DISTINCT word, ctx FROM an WHERE is_miss) m USING (word, ctx)")
def t3r(spark, sf):
    """Questions after their misses were opened again."""
    a = answers(spark, sf)
    return A.retried(a, a.groupBy("word", "ctx").agg(F.count("*").alias("tries")))[1].select("word", "ctx", F.col("tries").cast("long").alias("tries"))


@query("w4_plan_batches", f"""WITH {ANS}, q AS (SELECT word, ctx, min(stamp) AS stamp FROM an GROUP BY word, ctx), p AS (SELECT *, cast(floor(stamp / 1e6 / 64) AS BIGINT) AS shard FROM q), n AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY stamp, word, ctx) - 1 AS n FROM p)
  SELECT word, ctx, stamp, shard, (n // 30)::INT AS batch, (n % 30 + 1)::INT AS item FROM n""")
def w4(spark, sf):
    """Batches of 30 questions, by stretches of 64 conversations."""
    return A.plan_batches(answers(spark, sf), 30, shard=F.floor(F.col("stamp") / 1e6 / 64).cast("long"))


@query("w4_plan_batches_all", f"""WITH {ANS}, q AS (SELECT word, ctx, min(stamp) AS stamp FROM an GROUP BY word, ctx), n AS (SELECT *, row_number() OVER (ORDER BY stamp, word, ctx) - 1 AS n FROM q)
  SELECT word, ctx, stamp, n // 30 AS batch, (n % 30 + 1)::INT AS item FROM n""")
def w4_all(spark, sf):
    """Batches of 30 questions in one order over all."""
    return A.plan_batches(answers(spark, sf), 30).drop("shard")


@query("j7_answer_as_of", f"""WITH {ANS}, t AS (SELECT DISTINCT word, ctx, stamp - 5000 AS stamp FROM an UNION SELECT DISTINCT word, 'elsewhere', stamp FROM an),
  o AS (SELECT word, ctx, stamp, max({{'m': is_miss, 'k': kana}}) AS s FROM an GROUP BY word, ctx, stamp), l AS (SELECT word, stamp, max(kana) AS kana FROM an WHERE NOT is_miss GROUP BY word, stamp),
  a AS (SELECT t.*, o.s FROM t ASOF LEFT JOIN o ON t.word = o.word AND t.ctx = o.ctx AND t.stamp >= o.stamp)
  SELECT a.word, a.ctx, a.stamp, CASE WHEN a.s.m THEN NULL ELSE coalesce(a.s.k, l.kana) END AS kana, a.s IS NOT NULL AS asked FROM a ASOF LEFT JOIN l ON a.word = l.word AND a.stamp >= l.stamp""")
def j7_as_of(spark, sf):
    """Every question half a turn before it was answered, and every word at its times on another line."""
    a = answers(spark, sf)
    tokens = a.select("word", "ctx", F.col("stamp") - 5000).union(a.select("word", F.lit("elsewhere"), "stamp")).toDF("word", "ctx", "stamp").distinct()
    return A.lookup_as_of(tokens, a)


@query("w5_rate_limit", "SELECT event_id, count(*) OVER w AS recent, count(*) OVER w > 20 AS over FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '3599.999999 seconds' PRECEDING AND CURRENT ROW)")
def w5(spark, sf):
    return A.rate_limit(_events(spark, sf), 20, 3600, "user_id").select("event_id", "recent", "over")


@query("w7_change_runs", "WITH c AS (SELECT event_id, user_id, ts, coalesce((event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT, 0) AS c FROM events) SELECT event_id, (sum(c) OVER w)::BIGINT AS changes, sum(c) OVER w >= 3 AS suppressed FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '7200 seconds' PRECEDING AND CURRENT ROW)")
def w7(spark, sf):
    e = _events(spark, sf).select("event_id", F.col("user_id").alias("key"), "ts", F.col("event_type").alias("value"), F.col("event_id").alias("n"))
    return A.change_runs(e, 7200, 3).select("event_id", "changes", "suppressed")


@query("a16_answer_health", """WITH l AS (SELECT *, user_id AS endpoint, value >= 40 AS ok, sum((value >= 40)::INT) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS good, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS late FROM events)
  SELECT endpoint, count(*) AS requests, count(*) FILTER (NOT ok) AS failures, count(*) FILTER (good = 0) AS tail_failures, count(*) FILTER (event_type = 'click') AS hits, count(*) FILTER (event_type = 'view') AS cache_hits, count(*) FILTER (event_type = 'purchase') AS misses, count(*) FILTER (event_type = 'error') AS rejected,
    count(*) FILTER (good = 0) >= 2 AND max(event_id % 2) FILTER (late = 1) > 0 AS stalled FROM l GROUP BY endpoint""")
def a16(spark, sf):
    outcome = F.create_map(*[F.lit(x) for pair in {"click": "hit", "view": "cached", "purchase": "miss", "error": "rejected"}.items() for x in pair])[F.col("event_type")]
    log = _events(spark, sf).select(F.col("user_id").alias("endpoint"), "ts", F.col("event_id").alias("n"), (F.col("value") >= 40).alias("ok"), outcome.alias("outcome"), (F.col("event_id") % 2).alias("pending"))
    return A.health(log).select("endpoint", "requests", "failures", "tail_failures", "hits", "cache_hits", "misses", "rejected", "stalled")


@query("a14_usage_report", """WITH e AS (SELECT CASE event_type WHEN 'click' THEN 'model' WHEN 'view' THEN 'free' ELSE event_type END AS kind, 's' || (user_id % 7) AS session_id, strftime(ts, '%Y-%m-%d') AS day, floor(greatest(value, 0)) AS v FROM events),
  g AS (SELECT CASE WHEN grouping(session_id) = 0 THEN 'session' WHEN grouping(day) = 0 THEN 'day' ELSE 'total' END AS scope, CASE WHEN grouping(session_id) = 0 THEN session_id WHEN grouping(day) = 0 THEN day ELSE 'all' END AS bucket, kind, sum(v) AS words, count(*)::DOUBLE AS requests FROM e WHERE kind IN ('model', 'free') GROUP BY GROUPING SETS ((kind, session_id), (kind, day), (kind)))
  SELECT scope, bucket, kind, words, requests, CASE WHEN kind = 'model' THEN (words * 2 * 3.0 + words * 15.0) / 1e6 ELSE 0.0 END AS cost FROM g""")
def a14(spark, sf):
    kind = F.when(F.col("event_type") == "click", "model").when(F.col("event_type") == "view", "free").otherwise(F.col("event_type"))
    v = F.floor(F.greatest(F.col("value"), F.lit(0.0))).cast("double")
    e = _events(spark, sf).select("ts", F.concat(F.lit("s"), F.col("user_id") % 7).alias("session_id"), kind.alias("kind"), F.lit(1.0).alias("requests"), F.lit(1.0).alias("ok"), F.lit(0.0).alias("failures"), v.alias("words"), F.lit(0.0).alias("chars"), (v * 2).alias("prompt_tokens"), v.alias("completion_tokens"))
    return U.report(e, 3.0, 15.0).select("scope", "bucket", "kind", "words", "requests", "cost")


@query("t2_usage_windows", "SELECT event_type AS kind, time_bucket(INTERVAL '1 day', ts) AS day, count(*) AS requests FROM events GROUP BY ALL")
def t2(spark, sf):
    """The batch twin of the usage stream: tumbling days."""
    from kanaforge.streaming.usage import daily

    return daily(_events(spark, sf).select("ts", F.col("event_type").alias("kind")))


@query("t2_running_totals", "SELECT event_id, event_type AS kind, strftime(ts, '%Y-%m-%d') AS day, count(*) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total, count(*) OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS today FROM events")
def t2r(spark, sf):
    from kanaforge.streaming.usage import running

    return running(_events(spark, sf).select("event_id", "ts", F.col("event_type").alias("kind")))


@query("t2_sessions", """WITH e AS (SELECT event_type AS kind, user_id AS session_id, ts, coalesce((ts - lag(ts) OVER w >= INTERVAL 30 MINUTE)::INT, 1) AS new FROM events WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts)), n AS (SELECT *, sum(new) OVER (PARTITION BY kind, session_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM e)
  SELECT kind, session_id, min(ts) AS start, count(*) AS requests FROM n GROUP BY kind, session_id, s""")
def t2s(spark, sf):
    from kanaforge.streaming.usage import sessions

    return sessions(_events(spark, sf).select("ts", F.col("event_type").alias("kind"), F.col("user_id").alias("session_id"))).select("kind", "session_id", "start", "requests")


_TALK = "tw AS (SELECT conv_id AS batch, (turn * 10000 + pos + 1)::INT AS item, lower(w) AS word FROM (SELECT conv_id, turn, unnest(range(len(w))) AS pos, unnest(w) AS w FROM (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z]+') AS w FROM conversations)))"


def _talk(spark, sf):
    """(batch, item, word): every word of every turn."""
    talk = spark.read.parquet(f"{sf}/conversations.parquet")
    words = talk.select(F.col("conv_id").alias("batch"), "turn", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("at", "w"))
    return words.select("batch", (F.col("turn") * 10000 + F.col("at") + 1).cast("int").alias("item"), F.lower("w").alias("word"))


@query("f19_align_answers", f"WITH {_TALK}, a AS (SELECT *, CASE WHEN length(word) % 4 = 0 THEN NULL ELSE translate(word, '{LETTERS}', '{SPELLED}') END AS k FROM tw), s(l, rows) AS (VALUES {', '.join(f"""('{a}', '{b}')""" for a, b in A.FIRST_SOUNDS.items())}), y AS (SELECT batch, item, word, k, CASE WHEN k IS NULL OR k = '' THEN 'not given' WHEN NOT regexp_matches(k, '^[ァ-ヶー]+$') THEN 'not kana' WHEN length(k) > 14 THEN 'too long' WHEN NOT (s.rows IS NULL OR contains(CASE WHEN word LIKE 'th%' THEN s.rows || '{A.VOICED_TH}' ELSE s.rows END, k[1])) THEN 'first sound' END AS why FROM a LEFT JOIN s ON s.l = word[1]) SELECT batch, item, word, CASE WHEN why IS NULL THEN k END AS kana, why FROM y")
def f19(spark, sf):
    asked = _talk(spark, sf)
    said = asked.where("length(word) % 4 <> 0").select("batch", F.col("item").cast("string").alias("key"), F.concat(F.lit(" "), spelled(F.col("word"))).alias("value"))
    return A.align_by_index(asked, said)


@query("f18_parse_answers", f"WITH {_TALK} SELECT DISTINCT batch, word AS key, word AS value, batch % 3 = 0 AS partial FROM tw WHERE batch % 3 <> 0 OR length(word) <= 24")
def f18(spark, sf):
    """Answers as JSON text, all words of a conversation, every third text cut off before its end: what is saved of those are whole pairs
    with answers of 24 characters at most."""
    bodies = _talk(spark, sf).groupBy("batch").agg(F.to_json(F.map_from_entries(F.transform(F.array_sort(F.collect_set("word")), lambda w: F.struct(w, w)))).alias("j"))
    return A.parse_answers(bodies.select("batch", F.when(F.col("batch") % 3 == 0, F.expr("substring(j, 1, length(j) - 1)")).otherwise(F.col("j")).alias("content")))
