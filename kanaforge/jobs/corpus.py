"""Queries over the corpus: lines, words, gates, languages, coverage."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from kanaforge.functions import kana as K
from kanaforge.functions import text as T
from kanaforge.functions.tokens import tokenize
from kanaforge.jobs.inputs import DL, DW, LETTERS, LEX, SPELLED, TK, docs, flag_columns, hand, lexicon, lines
from kanaforge.jobs.registry import query
from kanaforge.operators import language as L
from kanaforge.operators import lexicon as X
from kanaforge.operators import lines as P

_CREDIT = "(" + " OR ".join("regexp_matches(line, '{}')".format(p.replace("'", "''")) for p in P.CREDITS.patterns()) + ")"


@query("p1_split_lines", f"WITH {DL} SELECT doc_id, line_no, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS ctx FROM dl")
def p1(spark, sf):
    return lines(spark, sf).select("doc_id", "line_no", T.context_key("line", None).alias("ctx"))


@query("p3_normalize_word", f"WITH {DL}, {DW} SELECT norm, count(*) AS times, count(DISTINCT word) AS forms FROM dw GROUP BY norm")
def p3(spark, sf):
    return P.plain_words(lines(spark, sf)).groupBy("norm").agg(F.count("*").alias("times"), F.countDistinct("word").alias("forms"))


@query("p4_script_of", f"WITH {DL} SELECT doc_id, line_no, CASE WHEN regexp_matches(line, '[{T.CYRILLIC}]') THEN 'cyrillic' WHEN regexp_matches(line, '[{T.GREEK}]') THEN 'greek' ELSE 'latin' END AS script, regexp_matches(line, '[{T.LATIN}]') AS latin, regexp_matches(line, '[{T.WESTERN}]') AS western FROM dl")
def p4(spark, sf):
    return lines(spark, sf).select("doc_id", "line_no", T.script_of("line").alias("script"), T.has_latin("line").alias("latin"), T.has_western("line").alias("western"))


@query("p5_is_readable", f"WITH {DL}, {TK} SELECT doc_id, line_no, tok_no, text, {flag_columns('readable')} FROM tk")
def p5(spark, sf):
    c = F.col
    readable = T.is_readable(c("text"), c("norm"), c("script"), c("glued") & ~c("notation"), c("emoticon"), c("notation"), c("after_digit"), c("diacritic"))
    return tokenize(lines(spark, sf)).select("doc_id", "line_no", "tok_no", "text", readable.alias("readable"))


@query("p6_credit_lines", f"WITH {DL} SELECT doc_id, line_no, {_CREDIT} AS credit FROM dl")
def p6(spark, sf):
    return lines(spark, sf).select("doc_id", "line_no", P.is_credit_line(F.col("line")).alias("credit"))


@query("w1_credit_block", f"WITH {DL}, c AS (SELECT doc_id, line_no, {_CREDIT} AS credit FROM dl) SELECT doc_id, line_no, credit OR (coalesce(lag(credit) OVER w, false) AND coalesce(lead(credit) OVER w, false)) AS skipped FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)")
def w1(spark, sf):
    return P.credit_blocks(lines(spark, sf)).select("doc_id", "line_no", "skipped")


_FEATURES = rf"""fe AS (SELECT dl.doc_id, dl.line_no, dl.line, coalesce(words, 0) AS words, coalesce(singles, 0) AS singles, coalesce(strung, 0) AS strung, coalesce(capitals, 0) AS capitals, coalesce(short_words, 0) AS short_words, coalesce(short_kinds, 0) AS short_kinds, coalesce(english_pairs, 0) AS english_pairs, kinds
  FROM dl LEFT JOIN (SELECT doc_id, line_no, count(*) AS words, count(*) FILTER (one) AS singles, count(*) FILTER (notation) AS strung, count(*) FILTER (regexp_matches(text, '^[A-Z]$')) AS capitals, count(*) FILTER (length(norm) <= 3) AS short_words,
    count(DISTINCT norm) FILTER (length(norm) <= 3) AS short_kinds, count(*) FILTER (regexp_matches(norm, '{P.NOT_ROMAJI}')) AS english_pairs, list(DISTINCT text) FILTER (regexp_matches(text, '^[A-Z]$')) AS kinds FROM tk GROUP BY ALL) c USING (doc_id, line_no))"""
_ART = rf"(words > 0 AND singles = words AND strung = 0 AND length(regexp_replace(line, '[{T.WESTERN}0-9０-９\s぀-ヿ一-鿿　-〿！-／]', '', 'g')) >= {P.ART_MARKS})"
_UNITS = ", ".join(f"'{u}'" for u in K.UNIT_SYMBOLS)


def _features(spark, sf):
    return P.line_features(P.with_tokens(lines(spark, sf)))


@query("p7_ascii_art", f"WITH {DL}, {TK}, {_FEATURES} SELECT doc_id, line_no, {_ART} AS is_art FROM fe")
def p7(spark, sf):
    return _features(spark, sf).select("doc_id", "line_no", "is_art")


@query("p8_censor_marks", f"WITH {DL}, {TK} SELECT doc_id, line_no, tok_no, {flag_columns('after_mask', 'censored')} FROM tk")
def p8(spark, sf):
    return tokenize(lines(spark, sf)).select("doc_id", "line_no", "tok_no", "after_mask", "censored")


@query("p10_neighbours", f"WITH {DL}, {TK} SELECT doc_id, line_no, tok_no, text, start, {flag_columns('before', 'before_spaced', 'after', 'after_spaced', 'after_digit', 'before_digit', 'label', 'glued', 'emoticon', 'japanese', 'other_word')} FROM tk")
def p10(spark, sf):
    rows = tokenize(lines(spark, sf), with_line=True)
    return rows.select("doc_id", "line_no", "tok_no", "text", "start", "before", "before_spaced", "after", "after_spaced", "after_digit", "before_digit", "label", "glued", "emoticon", (F.col("japanese_left") | F.col("japanese_right")).alias("japanese"), "other_word")


#: Section labels: every document's language in a capital before a colon, at the beginning of each line.
_LABELLED = "dl AS (SELECT doc_id, line_no, mark || ': ' || line AS line FROM (SELECT doc_id, upper(coalesce(lang, 'x')[1]) AS mark, unnest(range(len(string_split(text, chr(10)))))::INT AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents))"


@query("p9_label_letters", f"WITH {_LABELLED}, {TK} SELECT doc_id, line_no, tok_no, text FROM tk WHERE {flag_columns('label').removesuffix(' AS label')}")
def p9(spark, sf):
    marked = docs(spark, sf).withColumn("mark", F.upper(F.left(F.coalesce("lang", F.lit("x")), F.lit(1))))
    labelled = P.split_lines(marked, keep=("mark",)).select("doc_id", "line_no", F.concat("mark", F.lit(": "), "line").alias("line"))
    return tokenize(labelled).where("label").select("doc_id", "line_no", "tok_no", "text")


@query("p11_letter_runs", rf"WITH {DL}, {TK}, {_FEATURES} SELECT doc_id, line_no, regexp_matches(line, '(?:^|[^A-Za-z])[A-Z]\s?[,，、/・&]\s?[A-Z](?:[^A-Za-z]|$)') OR strung >= 2 OR capitals >= 3 AS letter_run, coalesce(len(kinds) >= 2 AND capitals = singles AND len(list_filter(kinds, lambda k: k NOT IN ({_UNITS}))) = 0, false) AS all_units FROM fe")
def p11(spark, sf):
    return _features(spark, sf).select("doc_id", "line_no", "letter_run", "all_units")


@query("a5_romaji_shape", f"WITH {DL}, {TK}, {_FEATURES} SELECT doc_id, line_no, short_kinds >= {P.ROMAJI_KINDS} AND short_words >= {P.ROMAJI_SHARE} * words AND english_pairs = 0 AS romaji_shape FROM fe")
def a5(spark, sf):
    shape = (F.size("short_kinds") >= P.ROMAJI_KINDS) & (F.col("short_words") >= P.ROMAJI_SHARE * F.col("words")) & (F.col("english_pairs") == 0)
    return _features(spark, sf).select("doc_id", "line_no", shape.alias("romaji_shape"))


#: Words of two and three letters that are romanised Japanese and spelled out otherwise.
_SHORT = ("".join(x) for n in (2, 3) for x in product(LETTERS, repeat=n))
_TWO_WAY = ", ".join(f"'{w}'" for w in _SHORT if (K.romaji_to_kana(w) or "") not in ("", w.translate(str.maketrans(LETTERS, SPELLED))))


@query("a5_romaji_lines", f"""WITH {DL}, {LEX}, w AS (SELECT doc_id, line_no, list_filter(regexp_extract_all(lower(line), '[a-z]+'), lambda x: length(x) <= 3 AND NOT regexp_matches(x, '{P.NOT_ROMAJI}')) AS w FROM dl)
  SELECT doc_id, line_no FROM (SELECT DISTINCT doc_id, line_no, unnest(w) AS word FROM w) JOIN (SELECT DISTINCT word FROM lx WHERE source = 'hand') USING (word) WHERE word IN ({_TWO_WAY}) GROUP BY ALL HAVING count(*) >= {P.ROMAJI_KINDS}""")
def a5r(spark, sf):
    """Lines, of which the short words are left, whose readings in the lexicon, spelled out here, are not the romanised ones."""
    short = F.filter(F.regexp_extract_all(F.lower("line"), F.lit("[a-z]+"), F.lit(0)), lambda w: (F.length(w) <= 3) & ~w.rlike(P.NOT_ROMAJI))
    sung = lines(spark, sf).select("doc_id", "line_no", F.array_join(short, " ").alias("line"))
    return P.romaji_lines(P.line_features(P.with_tokens(sung)), hand(spark, sf)).select("doc_id", "line_no")


@query("a15_skip_report", f"WITH {DL}, {TK}, {_FEATURES} SELECT CASE WHEN {_CREDIT} THEN 'credit' WHEN {_ART} THEN 'art' WHEN words = 0 THEN 'no_words' ELSE 'annotated' END AS reason, count(*) AS lines FROM fe GROUP BY 1")
def a15(spark, sf):
    return P.skip_report(_features(spark, sf))


@query("p12_primary_layer", "SELECT page_id AS item, line, ord FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY regexp_matches(line, '[ぁ-ゖァ-ヺ]') DESC, ord) AS n FROM (SELECT page_id, unnest(range(len(b)))::INT AS ord, unnest(b) AS line FROM (SELECT page_id, regexp_extract_all(html, '>([^<>]*[^<>\\s][^<>]*)<', 1) AS b FROM pages))) WHERE n = 1")
def p12(spark, sf):
    blocks = F.regexp_extract_all("html", F.lit(r"(?s)>([^<>]*[^<>\s][^<>]*)<"), F.lit(1))
    pages = spark.read.parquet(f"{sf}/pages.parquet").select(F.col("page_id").alias("item"), F.posexplode(blocks).alias("ord", "line"))
    return P.primary_layer(pages).select("item", "line", "ord")


@query("p13_japanese_documents", rf"WITH {DL} SELECT doc_id, max(regexp_matches(line, '[ぁ-ゖァ-ヺ]')::INT) = 1 OR max(regexp_matches(line, '\S')::INT) = 0 AS japanese FROM dl GROUP BY doc_id")
def p13(spark, sf):
    return P.japanese_documents(lines(spark, sf))


@query("p14_scope_filter", "SELECT conv_id, turn, role AS kind FROM conversations WHERE role IN ('user')")
def p14(spark, sf):
    return P.scope_filter(spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", F.col("role").alias("kind")), ["user"])


#: The tables hold no chained capitals, so the documents' own syllables are written so first: words of a consonant and a
#: vowel in capitals, the spaces between them as hyphens.
_SUNG = "regexp_replace(upper(regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g')), '([B-DF-HJ-NP-TV-Z][AEIOU]) ', '\\1-', 'g')"


@query("a6_long_vowels", rf"SELECT DISTINCT doc_id, unnest(regexp_split_to_array(chain, '-\n?')) AS word FROM (SELECT doc_id, unnest(regexp_extract_all({_SUNG}, '\b[B-DF-HJ-NP-TV-Z]{{1,2}}[AEIOU](?:-\n?[B-DF-HJ-NP-TV-Z]{{1,2}}[AEIOU])+\b')) AS chain FROM documents)")
def a6(spark, sf):
    sung = docs(spark, sf).select("doc_id", F.regexp_replace(F.upper(F.regexp_replace("text", r"[^\x00-\x7F]", " ")), "([B-DF-HJ-NP-TV-Z][AEIOU]) ", "$1-").alias("text"))
    return P.long_vowel_words(sung)


@query("a7_echo_fragments", f"WITH {DL}, {DW}, c AS (SELECT doc_id, line_no, norm, count(*) AS times FROM dw GROUP BY ALL) SELECT doc_id, line_no, norm FROM c WHERE length(norm) BETWEEN 2 AND 3 AND times >= 2 AND EXISTS (SELECT 1 FROM c l WHERE l.doc_id = c.doc_id AND l.line_no = c.line_no AND length(l.norm) > length(c.norm) AND right(l.norm, length(c.norm)) = c.norm)")
def a7(spark, sf):
    return P.echo_fragments(lines(spark, sf))


@query("a12_layer_hit_report", f"WITH {DL}, {DW}, {LEX} SELECT d.lang, CASE WHEN h.word IS NULL THEN 'missed' ELSE 'dict' END AS layer, count(*) AS tokens, count(DISTINCT norm) AS kinds FROM dw JOIN documents d USING (doc_id) LEFT JOIN (SELECT word FROM lx WHERE source = 'hand') h ON h.word = norm GROUP BY ALL")
def a12(spark, sf):
    """Reading coverage by language: documents -> lines -> words -> normal form -> lexicon."""
    words = P.plain_words(lines(spark, sf)).groupBy("doc_id", "norm").agg(F.count("*").alias("n"))
    by_lang = words.join(docs(spark, sf).select("doc_id", "lang"), "doc_id").groupBy("lang", "norm").agg(F.sum("n").alias("n"))
    known = by_lang.join(hand(spark, sf).select(F.col("word").alias("norm"), F.lit("dict").alias("layer")), "norm", "left")
    return known.groupBy("lang", F.coalesce("layer", F.lit("missed")).alias("layer")).agg(F.sum("n").alias("tokens"), F.count("*").alias("kinds"))


# -- languages ---------------------------------------------------------------------------------------------

_LOWER = f"regexp_extract_all(regexp_replace(lower(line), '[''’]', '', 'g'), '{L.WORD}')"


def _q(text: str) -> str:
    return text.replace("'", "''")


def _quoted(words) -> str:
    return ", ".join(f"'{_q(w)}'" for w in words)


def _own(lang: str) -> str:
    by: dict[int, list[str]] = {}
    for w, n in L.SIGNALS[lang].words.items():
        by.setdefault(n, []).append(w)
    return "CASE " + " ".join(f"WHEN word IN ({_quoted(ws)}) THEN {n}" for n, ws in by.items()) + " ELSE 0 END"


def _shape(lang: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(word, '{p}') THEN {n}" for p, n in L.SIGNALS[lang].shapes) + " ELSE 0 END"


def _hard(lang: str) -> str:
    return " + ".join([f"(CASE WHEN regexp_matches(lower(line), '{_q(p)}') THEN {n} ELSE 0 END)" for p, n in L.SIGNALS[lang].hard] or ["0"])


def _part(lang: str) -> str:
    return f"regexp_matches(word, '{L.SIGNALS[lang].parts}')" if L.SIGNALS[lang].parts else "false"


def _gate(lang: str) -> str:
    g, parts = L.SIGNALS[lang], []
    if g.own_words:
        owned = f"{lang}_own >= {g.own_words}" + (" AND NOT regexp_matches(line, '[A-Z]{2}')" if g.plain else "")
        marked = " OR ".join(f"regexp_matches(lower(line), '{_q(p)}')" for p, _ in g.hard)
        parts.append(f"({owned} OR ({marked}) AND {lang}_own >= 1)" if g.marked else f"({owned})")
    if g.strong:
        parts.append(f"{lang}_strong >= {g.strong}")
    if g.parts:
        parts.append(f"n > 0 AND 2 * {lang}_parts >= n")
    return " AND ".join(parts) or "true"


_SCORED = f"""lw AS (SELECT doc_id, line_no, unnest({_LOWER}) AS word FROM dl), kinds AS (SELECT DISTINCT word FROM lw),
own AS (SELECT word, length(word) > 1 AND word IN ({_quoted(L.ENGLISH)}) AS common, {', '.join(f'{_own(x)} AS {x}_own, {_shape(x)} AS {x}_shape, {_part(x)} AS {x}_part' for x in L.LANGS)} FROM kinds),
ws AS (SELECT word, common, {', '.join(f'{x}_own, {x}_part, CASE WHEN common THEN CASE WHEN {x}_own > 0 THEN {x}_own ELSE -2 END ELSE {x}_own + {x}_shape END AS {x}' for x in L.LANGS)} FROM own),
ls AS (SELECT doc_id, line_no, count(*) AS n, count(*) FILTER (common) AS english, count(*) FILTER (length(word) > 1) AS longer, max(length(word)) AS longest,
  {', '.join(f'sum({x}) AS {x}_sum, sum({x}_own) AS {x}_points, count(*) FILTER ({x}_own >= 2) AS {x}_own, count(*) FILTER ({x}_part) AS {x}_parts, count(*) FILTER (length(word) > 1 AND {x} <> 0) AS {x}_hits' for x in L.LANGS)} FROM lw JOIN ws USING (word) GROUP BY ALL),
sc AS (SELECT dl.doc_id, dl.line_no, line, coalesce(n, 0) AS n, coalesce(english, 0)::INT AS english, coalesce(longer, 0) AS longer, coalesce(longest, 0) AS longest,
  {', '.join(f'(coalesce({x}_sum, 0) + {_hard(x)})::BIGINT AS {x}, coalesce({x}_own, 0) AS {x}_own, coalesce({x}_points, 0) + {_hard(x)} AS {x}_strong, coalesce({x}_parts, 0) AS {x}_parts, coalesce({x}_hits, 0) AS {x}_hits' for x in L.LANGS)} FROM dl LEFT JOIN ls USING (doc_id, line_no))"""
_DETECTED = f"""de AS (SELECT sc.*, CASE WHEN regexp_matches(line, '[ぁ-ゖァ-ヺ]') THEN NULL WHEN regexp_matches(line, '[Ѐ-ӿ]') THEN 'ru' WHEN regexp_matches(line, '[Ͱ-Ͽἀ-῿]') THEN 'el' ELSE c.lang END AS lang FROM sc LEFT JOIN (
  SELECT doc_id, line_no, lang FROM ({' UNION ALL '.join(f"SELECT doc_id, line_no, '{x}' AS lang, {x} AS score, {i} AS ord FROM sc WHERE {x} >= {s.least} AND {_gate(x)}" for i, (x, s) in enumerate(L.SIGNALS.items()))})
  QUALIFY row_number() OVER (PARTITION BY doc_id, line_no ORDER BY score DESC, ord) = 1) c USING (doc_id, line_no))"""
_DOCLANG = "dg AS (SELECT doc_id, lang AS doc_lang FROM (SELECT doc_id, lang, count(*) AS votes, max(line_no) AS last FROM de WHERE lang IS NOT NULL GROUP BY ALL) WHERE votes >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, last, lang) = 1)"


@query("a1_language_scores", f"WITH {DL}, {_SCORED} SELECT doc_id, line_no, {', '.join(L.LANGS)}, english FROM sc")
def a1(spark, sf):
    return L.line_scores(lines(spark, sf)).select("doc_id", "line_no", *L.LANGS, "english")


@query("a2_detect_language", f"WITH {DL}, {_SCORED}, {_DETECTED} SELECT doc_id, line_no, lang FROM de")
def a2(spark, sf):
    return L.detect(L.line_scores(lines(spark, sf))).select("doc_id", "line_no", "lang")


@query("a3_document_language", f"WITH {DL}, {_SCORED}, {_DETECTED}, {_DOCLANG} SELECT * FROM dg")
def a3(spark, sf):
    return L.document_language(L.detect(L.line_scores(lines(spark, sf))))


@query("a4_line_language", f"""WITH {DL}, {_SCORED}, {_DETECTED}, {_DOCLANG} SELECT doc_id, line_no, doc_lang, coalesce(lang, CASE WHEN regexp_matches(line, '[ぁ-ゖァ-ヺ]') THEN NULL
  {' '.join(f"WHEN doc_lang = '{x}' AND english = 0 AND longer > 0 AND CASE WHEN longer = 1 THEN {x}_hits = 1 AND longest >= 5 ELSE {x}_hits >= 0.6 * longer END THEN '{x}'" for x in L.LANGS)} END) AS line_lang FROM de LEFT JOIN dg USING (doc_id)""")
def a4(spark, sf):
    return L.line_language(L.detect(L.line_scores(lines(spark, sf)))).select("doc_id", "line_no", "doc_lang", "line_lang")


@query("g7_language_confusion", f"WITH {DL}, {_SCORED}, {_DETECTED}, {_DOCLANG} SELECT d.lang, coalesce(doc_lang, 'none') AS doc_lang, count(*) AS documents FROM documents d LEFT JOIN dg USING (doc_id) GROUP BY ALL")
def g7(spark, sf):
    return L.confusion(docs(spark, sf), L.document_language(L.detect(L.line_scores(lines(spark, sf)))))


# -- words against lexicons --------------------------------------------------------------------------------


@query("j1_lexicon_lookup", f"WITH {DL}, {DW}, {LEX}, h AS (SELECT word AS k, kana FROM lx WHERE source = 'hand'), w AS (SELECT DISTINCT word FROM dw) SELECT w.word, coalesce(a.kana, b.kana, c.kana) AS kana, CASE WHEN a.k IS NOT NULL THEN 0 WHEN b.k IS NOT NULL THEN 1 WHEN c.k IS NOT NULL THEN 2 END AS step FROM w LEFT JOIN h a ON a.k = w.word LEFT JOIN h b ON b.k = lower(trim(w.word)) LEFT JOIN h c ON c.k = regexp_replace(lower(w.word), '[^a-z]', '', 'g')")
def j1(spark, sf):
    return X.lookup(P.plain_words(lines(spark, sf)).select("word").distinct(), hand(spark, sf))


@query("j5_masked_lookup", f"WITH {DL}, {DW}, {LEX}, h AS (SELECT word AS e, kana FROM lx WHERE source = 'hand'), m AS (SELECT DISTINCT word[:1] || '○' || word[3:] AS word FROM dw WHERE regexp_matches(word, '^[A-Za-z]{{2,}}$')) SELECT word, min(kana) AS kana FROM m JOIN h ON length(e) = length(word) AND e LIKE replace(lower(word), '○', '_') GROUP BY word HAVING count(DISTINCT kana) = 1")
def j5(spark, sf):
    words = P.plain_words(lines(spark, sf)).where(F.col("word").rlike("^[A-Za-z]{2,}$")).select(F.concat(F.substring("word", 1, 1), F.lit("○"), F.expr("substring(word, 3)")).alias("word"))
    return X.masked_lookup(words, hand(spark, sf))


@query("j6_homographs", f"WITH {DL}, {DW} SELECT DISTINCT d.lang, norm FROM dw JOIN documents d USING (doc_id) WHERE (d.lang, norm) IN (('de', 'die'), ('de', 'in'), ('fr', 'pour'), ('fr', 'le'), ('es', 'no'))")
def j6(spark, sf):
    table = spark.sql("SELECT * FROM VALUES ('de', 'die'), ('de', 'in'), ('fr', 'pour'), ('fr', 'le'), ('es', 'no') AS t(lang, word)")
    words = P.plain_words(lines(spark, sf)).join(docs(spark, sf).select("doc_id", "lang"), "doc_id").select("lang", "norm").distinct()
    return X.homographs(words, table)


@query("j8_unknown_words", f"WITH {DL}, {DW}, {LEX} SELECT norm, count(*) AS times FROM dw WHERE norm NOT IN (SELECT word FROM lx) GROUP BY norm")
def j8(spark, sf):
    return X.unknown_words(P.plain_words(lines(spark, sf)).groupBy("norm").agg(F.count("*").alias("times")), lexicon(spark, sf))


@query("k2_top_unknown", f"WITH {DL}, {DW}, {LEX} SELECT norm, count(*) AS times FROM dw WHERE norm NOT IN (SELECT word FROM lx WHERE source = 'hand') GROUP BY norm ORDER BY times DESC, norm LIMIT 100")
def k2(spark, sf):
    return X.top_unknown(P.plain_words(lines(spark, sf)), hand(spark, sf), 100)


@query("f7_fold_diacritics", f"WITH {DL}, {DW} SELECT DISTINCT word, translate(replace(replace(replace(replace(lower(word), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'þ', 'th'), '{T.MARKED}', '{T.BASE}') AS folded FROM dw")
def f7(spark, sf):
    return P.plain_words(lines(spark, sf)).select("word").distinct().select("word", T.fold_diacritics("word").alias("folded"))


@query("f16_word_key", f"WITH {DL}, {DW}, k AS (SELECT DISTINCT word, regexp_replace(translate(replace(replace(replace(replace(lower(word), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'þ', 'th'), '{T.MARKED}', '{T.BASE}'), '[^a-z{T.CYRILLIC}{T.GREEK}]', '', 'g') AS k FROM dw) SELECT word, CASE WHEN length(k) BETWEEN 1 AND 24 THEN k END AS key FROM k")
def f16(spark, sf):
    return P.plain_words(lines(spark, sf)).select("word").distinct().select("word", T.word_key("word").alias("key"))


@query("f17_same_sentences", rf"WITH {DL} SELECT trim(regexp_replace(line, '\s+', ' ', 'g')) AS sentence, count(*) AS times FROM dl WHERE trim(regexp_replace(line, '\s+', ' ', 'g')) <> '' GROUP BY 1 HAVING count(*) > 1")
def f17(spark, sf):
    rows = lines(spark, sf).select(T.context_hash("line").alias("h"), F.trim(F.regexp_replace("line", r"\s+", " ")).alias("sentence")).where("h IS NOT NULL")
    return rows.groupBy("h", "sentence").agg(F.count("*").alias("times")).where("times > 1").drop("h")


#: Shapes of secrets by kind.
SECRETS = {"token": '(?i)token\\s*=\\s*"[0-9a-f]{40}"', "aws": "AKIA[0-9A-Z]{16}", "pem": "-----BEGIN [A-Z ]*PRIVATE KEY-----", "bearer": "(?i)bearer\\s+[a-z0-9._-]{20,}", "sk": "\\bsk-[A-Za-z0-9]{20,}", "github": "\\bgh[oprsu]_[A-Za-z0-9]{36}", "github_fine": "\\bgithub_pat_[A-Za-z0-9_]{22,}"}


@query("q3_secret_scan", " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind FROM documents WHERE regexp_matches(text, '{p}')" for k, p in SECRETS.items()))
def q3(spark, sf):
    kinds = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(k)) for k, p in SECRETS.items()]))
    return docs(spark, sf).select("doc_id", F.explode(kinds).alias("kind"))
