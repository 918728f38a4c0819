"""Queries over tokens, engines, readings and titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from kanaforge.functions import kana as K
from kanaforge.functions.tokens import tokenize
from kanaforge.jobs.inputs import DL, DW, LETTERS, LEX, SPELLED, TK, docs, flag_columns, hand, lexicon, lines, spelled
from kanaforge.jobs.registry import query
from kanaforge.operators import align as G
from kanaforge.operators import cascade as R
from kanaforge.operators import language as L
from kanaforge.operators import lines as P


def _lev(a: str, b: str) -> str:
    """Edit distance in SQL: DuckDB counts bytes, so the kana of the derived lexicon go back to letters first."""
    return "levenshtein({}, {})".format(*(f"translate({x}, '{SPELLED}ー', '{LETTERS}-')" for x in (a, b)))


def _kinds(spark, sf):
    return P.plain_words(lines(spark, sf)).select("word").distinct()


@query("p2_tokenize", f"""WITH {DL}, {TK} SELECT doc_id, line_no, tok_no, text, start, "end", kind, norm, {flag_columns('script', 'glued', 'emoticon', 'after_digit', 'label', 'diacritic')} FROM tk""")
def p2(spark, sf):
    return tokenize(lines(spark, sf)).select("doc_id", "line_no", "tok_no", "text", "start", "end", "kind", "norm", "script", "glued", "emoticon", "after_digit", "label", "diacritic")


@query("f1_romaji")
def f1(spark, sf):
    return _kinds(spark, sf).select("word", K.romaji_column(F.lower("word")).alias("kana"))


@query("f2_english")
def f2(spark, sf):
    return _kinds(spark, sf).select("word", K.english_column("word").alias("r")).select("word", "r.*")


@query("q2_rule_output", f"WITH {LEX} SELECT word FROM lx GROUP BY word")
def q2(spark, sf):
    """The lexicon words that the spelling rules read as kana, which must be all of them."""
    kinds = lexicon(spark, sf).select("word").distinct().select("word", K.english_column("word").alias("r"))
    return kinds.where(F.col("r.kana").rlike("^[ァ-ヶー]+$")).select("word")


@query("f3_uncertain_spelling", f"WITH {LEX} SELECT DISTINCT word, regexp_matches(word, '{K._UNCERTAIN.pattern}') AS uncertain FROM lx")
def f3(spark, sf):
    return lexicon(spark, sf).select("word").distinct().select("word", K.uncertain_spelling(F.col("word")).alias("uncertain"))


_NAMES = "map {" + ", ".join(f"'{a}': '{b}'" for a, b in K.LETTER_NAMES.items()) + "}"


@query("f4_letters", f"WITH {LEX} SELECT DISTINCT word, array_to_string(list_transform(string_split(word, ''), lambda c: {_NAMES}[c]), '') AS kana FROM lx")
def f4(spark, sf):
    return lexicon(spark, sf).select("word").distinct().select("word", K.letters_to_kana(F.col("word")).alias("kana"))


@query("f5_acronyms", f"WITH {DL}, {DW}, k AS (SELECT DISTINCT word, norm FROM dw WHERE regexp_matches(word, '^[A-Z]{{2,6}}$')) SELECT word, CASE WHEN NOT regexp_matches(word, '[AEIOUY]') OR length(word) <= 3 AND norm NOT IN (SELECT word FROM ({LEX[len('lx AS (') : -1]}) l WHERE source = 'hand') THEN array_to_string(list_transform(string_split(lower(word), ''), lambda c: {_NAMES}[c]), '') END AS kana FROM k")
def f5(spark, sf):
    words = P.plain_words(lines(spark, sf)).where(F.col("word").rlike("^[A-Z]{2,6}$")).select("word", "norm").distinct()
    known = hand(spark, sf).select(F.col("word").alias("norm"), F.lit(True).alias("k"))
    return words.join(known, "norm", "left").select("word", K.acronym_kana(F.col("word"), F.coalesce("k", F.lit(False))).alias("kana"))


_SUFFIXES = ("'s", "'re", "'ll", "'d", "'ve", "'m", "n't")
_WHOLE = ", ".join("('{}', '{}')".format(a.replace("'", "''"), b) for a, b in K.WHOLE_CONTRACTIONS.items())


@query("f6_contractions", f"""WITH {LEX}, w AS (SELECT DISTINCT word || s AS raw, CASE WHEN s = 'n''t' THEN 'nt' ELSE s[2:] END AS suffix, CASE WHEN s <> 'n''t' AND word || s LIKE '%n''t' THEN NULL ELSE word END AS base, kana FROM lx, (VALUES {', '.join("('" + x.replace("'", "''") + "')" for x in _SUFFIXES)}) v(s) WHERE source = 'hand'), f(k, fixed) AS (VALUES {_WHOLE})
  SELECT raw, base, suffix, fixed, CASE suffix WHEN 's' THEN CASE right(kana, 1) WHEN 'ト' THEN left(kana, -1) || 'ツ' WHEN 'ド' THEN left(kana, -1) || 'ズ' WHEN 'ッ' THEN kana || 'ツ' ELSE kana || 'ズ' END WHEN 're' THEN CASE right(kana, 1) WHEN 'ー' THEN left(kana, -1) ELSE kana END || 'ア'
    WHEN 'll' THEN kana || 'ル' WHEN 'd' THEN kana || 'ド' WHEN 've' THEN kana || 'ブ' WHEN 'm' THEN kana || 'ム' ELSE kana || 'ント' END AS kana FROM w LEFT JOIN f ON k = raw""")
def f6(spark, sf):
    """Every lexicon word with every suffix: its parts, its settled sound, and its reading with the suffix's."""
    raw = hand(spark, sf).select("word", "kana", F.explode(F.array(*map(F.lit, _SUFFIXES))).alias("s")).select(F.concat("word", "s").alias("raw"), "kana")
    split = raw.select("raw", "kana", K.split_contraction(F.col("raw")).alias("c"))
    return split.select("raw", "c.base", "c.suffix", "c.fixed", K.merge_contraction(F.col("kana"), F.col("c.suffix")).alias("kana"))


@query("f8_vowel_runs", f"WITH {LEX}, v AS (SELECT DISTINCT repeat(word[1], (length(word) % 11) + 2) AS run FROM lx WHERE word[1] IN ('a', 'i', 'u', 'e', 'o')) SELECT run, repeat(translate(run[1], 'aiueo', 'アイウエオ'), length(run)) AS kana FROM v")
def f8(spark, sf):
    from kanaforge.functions.text import vowel_run_kana

    runs = lexicon(spark, sf).where(F.col("word").rlike("^[aiueo]")).select(F.expr("repeat(substring(word, 1, 1), length(word) % 11 + 2)").alias("run")).distinct()
    return runs.select("run", vowel_run_kana("run").alias("kana"))


@query("f10_lang_engines")
def f10(spark, sf):
    words = P.plain_words(lines(spark, sf)).join(docs(spark, sf).select("doc_id", "lang"), "doc_id").select("lang", F.lower("word").alias("word")).distinct()
    return words.select("lang", "word", K.lang_column("lang", "word").alias("kana"))


@query("f14_kana_checks", f"WITH {LEX} SELECT word, kana, regexp_matches(kana, '^[ァ-ヶー]+$') AND length(kana) <= 14 AS ok FROM lx")
def f14(spark, sf):
    from kanaforge.functions.text import hira_to_kata, kana_ok

    hira = F.translate("kana", "アベセ", "あべせ")
    return lexicon(spark, sf).select("word", hira_to_kata(hira).alias("kana")).select("word", "kana", kana_ok("kana").alias("ok"))


@query("f15_kana_distance", f"WITH {LEX} SELECT a.word, {_lev('a.kana', 'b.kana')} AS distance FROM lx a JOIN lx b USING (word) WHERE a.source = 'hand' AND b.source = 'model'")
def f15(spark, sf):
    from kanaforge.functions.text import kana_distance

    both = hand(spark, sf).select("word", F.col("kana").alias("a")).join(lexicon(spark, sf).where("source = 'model'").select("word", F.col("kana").alias("b")), "word")
    return both.select("word", kana_distance("a", "b").cast("long").alias("distance"))


@query("r1_read_words")
def r1(spark, sf):
    return R.read_words(_kinds(spark, sf), hand(spark, sf))


@query("r1_lexicon_words", f"WITH {DL}, {DW}, {LEX} SELECT DISTINCT dw.word, kana FROM dw JOIN lx ON lx.word = dw.word WHERE source = 'hand' AND NOT regexp_matches(dw.word, '^(?:aa+|ii+|uu+|ee+|oo+)$')")
def r1_words(spark, sf):
    """What the lexicon decides of the words that it has as written: all but runs of one vowel."""
    read = R.read_words(_kinds(spark, sf), hand(spark, sf)).where("source = 'dict'")
    return read.join(hand(spark, sf).select("word"), "word", "left_semi").select("word", "kana")


_READ = f"""rd AS (SELECT word, CASE WHEN length(word) % 3 = 0 THEN NULL ELSE kana END AS kana, CASE WHEN length(word) % 3 = 0 THEN NULL WHEN length(word) % 2 = 0 THEN 'dict' ELSE 'rule' END AS source, length(word) % 2 = 0 AS confident,
  CASE WHEN length(word) % 4 = 0 THEN 'モ' END AS model, CASE WHEN length(word) % 5 = 0 THEN 'フ' END AS free FROM lx WHERE source = 'hand')"""


@query("r3_resolve", f"WITH {LEX}, {_READ}, o AS (SELECT *, CASE WHEN kana IS NULL THEN 6 WHEN NOT confident THEN 4 WHEN source = 'dict' THEN 0 ELSE 4 END AS own FROM rd) SELECT word, CASE WHEN model IS NOT NULL AND own > 2 THEN model WHEN free IS NOT NULL AND own > 3 THEN free ELSE kana END AS final, CASE WHEN model IS NOT NULL AND own > 2 THEN 'model' WHEN free IS NOT NULL AND own > 3 THEN 'free' ELSE source END AS final_source FROM o")
def r3(spark, sf):
    n = F.length("word")
    rows = hand(spark, sf).select("word", F.when(n % 3 != 0, F.col("kana")).alias("kana"), F.when(n % 3 == 0, None).when(n % 2 == 0, "dict").otherwise("rule").alias("source"), (n % 2 == 0).alias("confident"), F.when(n % 4 == 0, "モ").alias("model"), F.when(n % 5 == 0, "フ").alias("free"))
    return R.resolve(rows).select("word", "final", "final_source")


_ESCAPED = r"replace(replace(replace(replace({}, '\', '\\'), '{{', '\{{'), '|', '\|'), '}}', '\}}')"
_PLACED = r"""pw AS (SELECT doc_id, line_no, line, w, gap, unnest(range(len(w)))::INT AS word_no, unnest(w) AS word FROM (SELECT *, regexp_extract_all(line, '[A-Za-z]+') AS w, regexp_split_to_array(line, '[A-Za-z]+') AS gap FROM dl))"""


@query("r6_annotate", f"WITH {DL}, {LEX}, {_PLACED}, m AS (SELECT doc_id, line_no, string_agg({_ESCAPED.format('gap[word_no + 1]')} || CASE WHEN kana IS NULL THEN pw.word ELSE '{{' || pw.word || '|' || kana || '|dict}}' END, '' ORDER BY word_no) || max({_ESCAPED.format('gap[len(w) + 1]')}) AS markup FROM pw LEFT JOIN (SELECT word, kana FROM lx WHERE source = 'hand') h ON h.word = lower(pw.word) GROUP BY ALL) SELECT doc_id, line_no, coalesce(markup, {_ESCAPED.format('line')}) AS markup FROM dl LEFT JOIN m USING (doc_id, line_no)")
def r6(spark, sf):
    return R.annotate_words(lines(spark, sf), hand(spark, sf))


@query("r7_strip", f"WITH {DL} SELECT doc_id, line_no, line AS stripped FROM dl")
def r7(spark, sf):
    return R.annotate_words(lines(spark, sf), hand(spark, sf)).select("doc_id", "line_no", R.strip(F.col("markup")).alias("stripped"))


@query("j2_scope_overrides", f"SELECT doc_id, word, kana FROM (SELECT doc_id, min(o) AS o FROM (SELECT doc_id, 1 AS o FROM documents WHERE regexp_matches(source, '^src1') UNION ALL SELECT doc_id, 2 FROM documents WHERE regexp_matches(source, '^src2$') OR regexp_matches(text, 'Licensed under')) GROUP BY doc_id) JOIN (VALUES (1, 'the', 'ジ'), (1, 'an', 'アン'), (2, 'the', 'ザ')) v(o, word, kana) USING (o)")
def j2(spark, sf):
    table = spark.sql("SELECT * FROM VALUES (1, '^src1', CAST(NULL AS STRING), map('the', 'ジ', 'an', 'アン')), (2, '^src2$', 'Licensed under', map('the', 'ザ')) AS t(override_id, title_pattern, marker_pattern, words)")
    return R.scope_overrides(docs(spark, sf).withColumn("title", F.col("source")), table)


@query("j3_line_overrides", f"WITH {DL}, {DW}, k AS (SELECT DISTINCT norm AS word, line FROM dw JOIN dl USING (doc_id, line_no) WHERE norm IN ('the', 'of')) SELECT word, line, CASE WHEN word = 'the' AND regexp_matches(line, '^The') THEN 'ジ' WHEN word = 'the' AND regexp_matches(line, 'ing') THEN 'ザ' WHEN word = 'of' AND regexp_matches(line, 'and') THEN 'オブ' END AS override FROM k")
def j3(spark, sf):
    table = spark.sql("SELECT * FROM VALUES ('the', '^The', 'ジ', 1), ('the', 'ing', 'ザ', 2), ('of', 'and', 'オブ', 1) AS t(word, pattern, kana, ord)")
    found = lines(spark, sf).select("line", F.explode(F.array_distinct(F.filter(F.transform(F.regexp_extract_all("line", F.lit(r"[A-Za-zÀ-ɏ]++(?:['’][A-Za-zÀ-ɏ]++)*+"), F.lit(0)), lambda w: F.lower(w)), lambda w: w.isin("the", "of")))).alias("word"))
    return R.line_overrides(found.distinct(), table).select("word", "line", "override")


def _titles(spark, sf):
    """Part names as titles, read letter by letter with the last word drawn out."""
    name = F.lower(F.regexp_replace("p_name", "[^A-Za-z ]", ""))
    return spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_name").alias("title"), F.concat(F.replace(spelled(name), F.lit(" "), F.lit("")), F.lit("ー")).alias("pronunciation")).distinct()


def _title_words(spark, sf):
    words = _titles(spark, sf).select(F.explode(F.regexp_extract_all("title", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).select(F.lower("w").alias("word")).distinct()
    return words.select("word", spelled(F.col("word")).alias("kana"))


@query("g2_align_titles")
def g2(spark, sf):
    return G.align_titles(_titles(spark, sf), _title_words(spark, sf))


#: Titles: part names, their first and last words, each with a digit, with marks and in kana, and conversations' words.
_ONE = """t AS (SELECT DISTINCT title FROM (SELECT p_name AS title FROM part UNION ALL SELECT string_split(p_name, ' ')[1] FROM part UNION ALL SELECT string_split(p_name, ' ')[1] || '2' FROM part UNION ALL SELECT string_split(p_name, ' ')[1] || '!' FROM part
  UNION ALL SELECT string_split(p_name, ' ')[1] || 'の' FROM part UNION ALL SELECT p_name[1] FROM part UNION ALL SELECT '' UNION ALL SELECT word FROM lx))"""


@query("g5_single_word_titles", f"""WITH {LEX}, {_ONE}, w AS (SELECT title, regexp_extract_all(title, '[A-Za-z]+') AS w FROM t) SELECT title, lower(w[1]) AS word, CASE WHEN trim(title) = '' THEN 'bad' WHEN len(w) = 0 THEN 'no word' WHEN len(w) > 1 THEN 'several words' WHEN regexp_matches(title, '[0-9]') THEN 'digits'
  WHEN regexp_matches(title, '[ぁ-ゖァ-ヺ一-鿿]') THEN 'mixed' WHEN regexp_matches(title, '[^A-Za-z ]') THEN 'punctuation' WHEN length(w[1]) = 1 THEN 'single letter' WHEN lower(w[1]) IN (SELECT word FROM lx WHERE source = 'hand') THEN 'hand' WHEN lower(w[1]) IN (SELECT word FROM lx WHERE source = 'model') THEN 'known' END AS reason FROM w""")
def g5(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    first = F.split("p_name", " ")[0]
    forms = F.array("p_name", first, F.concat(first, F.lit("2")), F.concat(first, F.lit("!")), F.concat(first, F.lit("の")), F.left("p_name", F.lit(1)), F.lit(""))
    titles = part.select(F.explode(forms).alias("title")).unionByName(lexicon(spark, sf).select(F.col("word").alias("title"))).distinct()
    return G.single_word_titles(titles, lexicon(spark, sf).where("source = 'model'"), hand(spark, sf))


@query("g4_merge_overrides", f"WITH {LEX} SELECT word[1] AS title, word, kana FROM lx WHERE source = 'hand' AND word[1] IN ('a', 'e') UNION ALL SELECT word[1], word, kana FROM lx WHERE source = 'model' AND word[1] NOT IN (SELECT word[1] FROM lx WHERE source = 'hand' AND word[1] IN ('a', 'e'))")
def g4(spark, sf):
    rows = lexicon(spark, sf).select(F.substring("word", 1, 1).alias("title"), "word", "kana", "source")
    return G.merge_overrides(rows.where("source = 'hand' AND title IN ('a', 'e')").drop("source"), rows.where("source = 'model'").drop("source"))


@query("g6_evaluate", f"WITH {LEX}, g AS (SELECT word, kana, length(word) % 3 = 0 AS gap FROM lx WHERE source = 'hand'), a AS (SELECT word, min(kana) AS got FROM lx WHERE source = 'model' GROUP BY word) SELECT count(*) AS words, count(*) FILTER (kana = got) AS exact, count(*) FILTER (NOT coalesce(kana = got, false) AND gap) AS known_gaps, count(*) FILTER (NOT coalesce(kana = got, false) AND NOT gap) AS unexplained, avg({_lev('kana', "coalesce(got, '')")}) AS mean_distance FROM g LEFT JOIN a USING (word)")
def g6(spark, sf):
    gold = hand(spark, sf).select("word", "kana", (F.length("word") % 3 == 0).alias("known_gap"))
    return G.evaluate(gold, lexicon(spark, sf).where("source = 'model'").groupBy("word").agg(F.min("kana").alias("kana")))


@query("g3_accept", f"WITH {LEX}, p AS (SELECT a.word, a.kana AS expected, CASE WHEN length(a.word) % 4 = 0 THEN a.kana ELSE b.kana END AS piece FROM lx a JOIN lx b USING (word) WHERE a.source = 'hand' AND b.source = 'model') SELECT DISTINCT word, CASE WHEN length(word) < 2 THEN 'single letter' WHEN expected = piece THEN 'equal' WHEN expected[1] <> piece[1] THEN 'first sound' WHEN abs(length(expected) - length(piece)) > 2 THEN 'length' WHEN {_lev('expected', 'piece')} > length(expected) / 2 + 1 THEN 'distance' END AS reason FROM p")
def g3(spark, sf):
    both = hand(spark, sf).select("word", F.col("kana").alias("e")).join(lexicon(spark, sf).where("source = 'model'").select("word", F.col("kana").alias("m")), "word")
    piece = F.when(F.length("word") % 4 == 0, F.col("e")).otherwise(F.col("m"))
    return both.select("word", G.accept(F.col("word"), F.col("e"), piece).alias("reason")).distinct()




def _special(spark):
    """A table of special readings: a row or more of every kind."""
    return spark.sql("SELECT * FROM VALUES ('emoticon', 'b', 'ボー'), ('glued', 'at', 'エーティー'), ('acronym', 'lv', 'レベル'), ('masked', '****ed', 'ピーッド'), ('fragment', 'wa', 'ウェ'), ('echo', 'ny', 'ナイ'), ('notation', 'ph', 'ペーハー'), ('uncertain', 'kro', 'クロ') AS t(kind, key, kana)")


def _read(spark, sf, signals=None, overrides=None, **tables):
    """Tokens of the corpus in their lines, read by the cascade."""
    texts = R.with_document_tables(docs(spark, sf), overrides, "source")
    told = R.line_tokens(R.in_lines(P.split_lines(texts, keep=("song", "drawn")), hand(spark, sf), signals))
    return R.read_tokens(told, R.kinds_of(told, hand(spark, sf), **tables))


def _cascade(spark, sf):
    rules = spark.sql("SELECT * FROM VALUES (1, '^src1$', CAST(NULL AS STRING), map('the', 'ジ')), (2, '^src2$', 'Licensed under', map('an', 'アン')) AS t(override_id, title_pattern, marker_pattern, words)")
    learned = lexicon(spark, sf).where("source = 'model'").groupBy("word").agg(F.min("kana").alias("kana"))
    loans = hand(spark, sf).where("length(word) = 7").select(F.lit("fr").alias("lang"), F.col("word").alias("key"), "kana")
    homographs = spark.sql("SELECT * FROM VALUES ('de', 'die'), ('de', 'in'), ('fr', 'pour'), ('fr', 'plus') AS t(lang, word)")
    return _read(spark, sf, overrides=rules, special=_special(spark), learned=learned, loans=loans, homographs=homographs)


@query("r2_read_tokens")
def r2(spark, sf):
    """The flagship composite: tokens of the corpus through every step of the line-aware cascade."""
    return _cascade(spark, sf).select("doc_id", "line_no", "tok_no", "text", "line_lang", "readable", "suppressed", "kana", "source", "confident")


@query("a12_cascade_hits")
def a12_all(spark, sf):
    """What each layer of the whole cascade reads, by the language of the line; suppressed tokens count as such."""
    read = _cascade(spark, sf)
    return R.hit_report(read.select(F.coalesce("line_lang", F.lit("none")).alias("lang"), F.when(F.col("suppressed"), "suppressed").otherwise(F.col("source")).alias("source"), "confident"))


@query("a12_cascade_tokens", f"WITH {DL}, {TK} SELECT doc_id, line_no, count(*) AS tokens FROM tk GROUP BY ALL")
def a12_tokens(spark, sf):
    """Tokens of each line that come out of the cascade: the split of heavy hitters loses and doubles none."""
    return _cascade(spark, sf).groupBy("doc_id", "line_no").agg(F.count("*").alias("tokens"))


@query("r2_lexicon_slice", f"WITH {DL}, {TK}, {LEX}, fe AS (SELECT doc_id, line_no, line, count(*) AS words, count(*) FILTER (one) AS singles, count(*) FILTER (notation) AS strung FROM tk GROUP BY ALL) SELECT doc_id, line_no, tok_no, text, kana FROM tk JOIN fe USING (doc_id, line_no) JOIN (SELECT word, kana FROM lx WHERE source = 'hand') h ON h.word = lower(text) WHERE kind = 0 AND length(text) > 3 AND NOT regexp_matches(text, '^[A-Z]+$') AND NOT regexp_matches(gap, '[*＊]{{2}}$')")
def r2_slice(spark, sf):
    """What the lexicon alone decides of the cascade: whole words of more than three letters that it has."""
    read = _read(spark, sf, {x: s for x, s in L.SIGNALS.items() if x != "la"}).where("source = 'dict' AND kana IS NOT NULL AND length(text) > 3 AND NOT notation AND NOT chain").where(~F.col("text").rlike("^[A-Z]+$"))
    # a Latin line is read by its engine
    return read.join(hand(spark, sf).select(F.col("word").alias("_w")), F.lower("text") == F.col("_w"), "left_semi").select("doc_id", "line_no", "tok_no", "text", "kana")


@query("r4_provisional", f"WITH {LEX}, r AS (SELECT word, length(word)::VARCHAR AS ctx FROM lx WHERE source = 'hand'), w AS (SELECT DISTINCT word, length(word)::VARCHAR AS ctx, length(word) % 5 AS tries FROM lx WHERE source = 'model') SELECT r.word, r.ctx, w.word IS NOT NULL AS waiting FROM r LEFT JOIN w ON w.word = r.word AND w.ctx = r.ctx AND tries < 3")
def r4(spark, sf):
    n = F.length("word")
    rows = hand(spark, sf).select("word", n.cast("string").alias("ctx"))
    wanted = lexicon(spark, sf).where("source = 'model'").select("word", n.cast("string").alias("ctx"), (n % 5).alias("tries"))
    return R.provisional(rows, wanted)


@query("f12_units", f"WITH {LEX}, u(k, kana) AS (VALUES {', '.join(f'''('{a}', '{b}')''' for a, b in K.UNITS.items())}), w AS (SELECT DISTINCT word AS unit FROM lx UNION SELECT DISTINCT word[:2] FROM lx UNION SELECT DISTINCT word[:1] FROM lx) SELECT unit, after_digit, CASE WHEN after_digit THEN kana END AS kana FROM w CROSS JOIN (VALUES (true), (false)) d(after_digit) LEFT JOIN u ON k = unit")
def f12(spark, sf):
    kinds = lexicon(spark, sf).select(F.explode(F.array("word", F.substring("word", 1, 2), F.substring("word", 1, 1))).alias("unit")).distinct()
    both = kinds.select("unit", F.explode(F.array(F.lit(True), F.lit(False))).alias("after_digit"))
    return both.select("unit", "after_digit", K.unit_reading(F.col("unit"), F.col("after_digit")).alias("kana"))


@query("f20_day_key", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS events FROM events GROUP BY 1")
def f20(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("events"))


@query("a12_coverage_by_language", f"WITH {DL}, {DW}, {LEX}, r AS (SELECT d.lang, CASE WHEN h.word IS NULL THEN 'missed' ELSE 'dict' END AS source FROM dw JOIN documents d USING (doc_id) LEFT JOIN (SELECT word FROM lx WHERE source = 'hand') h ON h.word = norm) SELECT lang, source, count(*) AS tokens, count(*) FILTER (source = 'dict') AS confident FROM r GROUP BY ROLLUP (lang, source)")
def a12r(spark, sf):
    words = P.plain_words(lines(spark, sf)).join(docs(spark, sf).select("doc_id", "lang"), "doc_id")
    known = words.join(hand(spark, sf).select(F.col("word").alias("norm"), F.lit("dict").alias("source")), "norm", "left")
    return R.hit_report(known.select("lang", "source", F.col("source").isNotNull().alias("confident")))
