"""One thin query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kanaforge.llm import bpe, collocations, htmltext, langid, media, mixing, negatives, quality, sharding, simhash, spotsigs, toxicity, urls
from kanaforge.llm.common import documents, labels

BPE_RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprint(documents(spark, sf_dir))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", media.digest_column("text").alias("d")).select("doc_id", "d.*")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return toxicity.classify(docs, labels(spark, sf_dir)).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.positions(documents(spark, sf_dir).select("doc_id", "source"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: labels.quality of the page's number; 0 is bad."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    outcomes = labels(spark, sf_dir).where(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return urls.judge(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return quality.classify(docs, labels(spark, sf_dir)).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.learn_and_identify(documents(spark, sf_dir).select("doc_id", "text", "lang"))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "accepted")


def op11_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir).select("text", "lang"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where vec_id is divisible by 7, the label is one off; anchors are the ids divisible by 100."""
    rows = negatives.quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


QUERIES = {
    "op3_spotsigs": op3_spotsigs,
    "op4_media": op4_media,
    "op5_toxicity": op5_toxicity,
    "op6_sharding": op6_sharding,
    "op7_mixing": op7_mixing,
    "op8_quality": op8_quality,
    "op9_langid": op9_langid,
    "op10_urls": op10_urls,
    "op1_simhash": op1_simhash,
    "op2_bpe": op2_bpe,
    "op11_htmltext": op11_htmltext,
    "op12_collocations": op12_collocations,
    "op13_negatives": op13_negatives,
}

#: op10: the rules, and the posterior bound of each host, from first principles.
OP10_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), o AS (
  SELECT p.page_id, p.host, l.bad FROM p
  LEFT JOIN (SELECT doc_id, max(1 - quality) AS bad FROM labels WHERE quality IN (0, 1) GROUP BY doc_id) l ON l.doc_id = p.page_id
), h0 AS (
  SELECT *, CASE WHEN regexp_matches(b, '^[0-9]{1,3}(\\.[0-9]{1,3}){3}$') OR starts_with(b, '[') THEN [b] ELSE string_split(b, '.') END AS s
  FROM (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\\.$', '') AS b FROM o GROUP BY host)
), h1 AS (
  SELECT *, CASE WHEN len(s) > 2 AND length(s[len(s)]) = 2 AND s[len(s) - 1] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') THEN 2 ELSE 1 END AS k FROM h0
), h AS (
  SELECT host, n, bad,
    array_to_string(list_slice(s, greatest(len(s) - k + 1, 1), len(s)), '.') AS suffix,
    array_to_string(list_slice(s, greatest(len(s) - k, 1), len(s)), '.') AS domain
  FROM h1
), d AS (
  SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain, suffix
), x AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY suffix
), levels AS (
  SELECT 'h' AS lv, n, bad FROM h WHERE n > 0 UNION ALL SELECT 'd', n, bad FROM d WHERE n > 0 UNION ALL SELECT 'x', n, bad FROM x WHERE n > 0
), sums AS (
  SELECT lv, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, count(*) AS m, sum(n * n)::DOUBLE AS nn, sum(bad * bad / n::DOUBLE) AS w FROM levels GROUP BY lv
), parts AS (
  SELECT lv, n, m, (bad - w) / nullif(n - m, 0) AS within, greatest(0, w - bad * bad / n) / nullif(m - 1, 0) AS between_, (n - nn / n) / nullif(m - 1, 0) AS size FROM sums
), rhos AS (
  SELECT lv, n, m, CASE WHEN between_ + (size - 1) * within > 0 THEN (between_ - within) / (between_ + (size - 1) * within) ELSE 0 END AS rho FROM parts
), st AS (
  SELECT lv, CASE WHEN m < 2 OR n <= m OR NOT rho > 0 THEN 1000.0 ELSE least(greatest(1 / rho - 1, 2.0), 1000.0) END AS s FROM rhos
), m AS (
  SELECT coalesce(max(s) FILTER (lv = 'h'), 1000.0) AS mh, coalesce(max(s) FILTER (lv = 'd'), 1000.0) AS md, coalesce(max(s) FILTER (lv = 'x'), 1000.0) AS mx FROM st
), g AS (
  SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1) AS rate FROM x
), px AS (
  SELECT suffix, (bad + mx * rate) / (n + mx) AS up FROM x, m, g
), pd AS (
  SELECT domain, (d.bad + md * up) / (d.n + md) AS prior FROM d JOIN px USING (suffix), m
), ab AS (
  SELECT host, prior * mh + bad AS a, (1 - prior) * mh + n - bad AS b FROM h JOIN pd USING (domain), m
), v AS (
  SELECT host, CASE WHEN a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5 THEN 'block' ELSE 'allow' END AS method FROM ab
), r AS (
  SELECT p.*, method, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p JOIN v USING (host)
)
SELECT page_id, host, path, rule, CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'net/' THEN 'block' ELSE method END AS verdict
FROM r
"""

#: op11: the text of the article element. It scores nothing, so it holds for pages whose article is marked as in these tables.
OP11_SQL = r"""
WITH a AS (
  SELECT page_id, url, string_split_regex(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>') AS parts FROM pages
), b AS (
  SELECT page_id, url, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM a
), t AS (
  SELECT page_id, url, i, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(replace(part, '<br>', ' '), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')) AS part FROM b
)
SELECT page_id, url, coalesce(string_agg(part, chr(10) ORDER BY i) FILTER (part <> ''), '') AS text, coalesce(length(string_agg(part, chr(10) ORDER BY i) FILTER (part <> '')), 0)::BIGINT AS n_chars
FROM t GROUP BY page_id, url
"""

#: op12: every phrase of one to four words, counted by itself.
OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(list_transform(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]'), lambda x: regexp_extract_all(x, '[^\x20\x09]+'))) AS w
  FROM documents
), g AS (
  SELECT lang, m, w[i:i + m - 1] AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p), (VALUES (1), (2), (3), (4)) AS s(m) WHERE i + m - 1 <= len(w)
), f AS (
  SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang
), c AS (
  SELECT * FROM f WHERE m > 1 AND f >= 30
), cuts AS (
  SELECT lang, m, phrase, f AS a, unnest(range(1, m)) AS k FROM c
), s AS (
  SELECT x.lang, x.phrase, x.m, x.a, x.k, l.f AS l, r.f AS r, (2000000::HUGEINT * x.a // (l.f::HUGEINT + r.f))::BIGINT AS score
  FROM cuts x JOIN f l ON l.lang = x.lang AND l.phrase = x.phrase[1:x.k] JOIN f r ON r.lang = x.lang AND r.phrase = x.phrase[x.k + 1:x.m]
), worst AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, phrase[i:i + z - 1] AS phrase, max(f) AS longer
  FROM (SELECT lang, m, phrase, f, z, unnest(range(1, m - z + 2)) AS i FROM c, (VALUES (2), (3)) AS t(z) WHERE z < m) GROUP BY ALL
), kept AS (
  SELECT w.lang, array_to_string(w.phrase, ' ') AS phrase, w.a, w.l, w.r, w.score FROM worst w LEFT JOIN inside i ON i.lang = w.lang AND i.phrase = w.phrase
  WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * w.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""

#: op13: every pair of an anchor and a row, ordered.
OP13_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.uid AS anchor, a.vec_id AS anchor_id, b.uid, b.vec_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM e a JOIN e b ON a.uid <> b.uid AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, uid) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.uid ORDER BY s.score DESC, s.vec_id, s.uid)::INTEGER AS rank,
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10
"""

ORACLES: dict[str, str] = {"op10_urls": OP10_SQL, "op11_htmltext": OP11_SQL, "op12_collocations": OP12_SQL, "op13_negatives": OP13_SQL}
