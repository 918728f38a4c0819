"""Rows of our own for every operator of the annotation library, invariants, and odd inputs."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from kanaforge.functions import kana as K
from kanaforge.functions import sounds
from kanaforge.functions import text as T
from kanaforge.functions.tokens import CHAIN, FIXED, LETTER, MASKED, ROMAJI, SYMBOL, WORD, places, tokenize
from kanaforge.operators import align, answers, cascade, language, lexicon, lines, readers
from kanaforge.sources import files
from kanaforge.streaming import annotate, learn, usage


def rows_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, line string").select("doc_id", F.lit(0).alias("line_no"), "line")


# -- scanner -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("青い stone と river、", [("stone", WORD), ("river", WORD)]),
        ("we'll re-open", [("we'll", WORD), ("re", CHAIN), ("open", CHAIN)]),
        ("a-line x-axis", [("a-line", WORD), ("x-axis", WORD)]),
        ("plan B/C/D だ", [("plan", WORD), ("B", LETTER), ("C", LETTER), ("D", LETTER)]),
        ("Q&A, J-pop", [("Q", LETTER), ("&", SYMBOL), ("A", LETTER), ("J-pop", WORD)]),
        ("U-U-U're", [("U", LETTER), ("U", LETTER), ("U're", LETTER)]),
        ("Nord-Ost-Wind", [("Nord", CHAIN), ("Ost", CHAIN), ("Wind", CHAIN)]),
        ("***ing d**k b○x", [("***ing", MASKED), ("d**k", WORD), ("b○x", WORD)]),
        ("S.A.K.U.R.A", [("S.A.K.U.R.A", ROMAJI)]),
        ("low p.h now", [("low", WORD), ("p.h", FIXED), ("now", WORD)]),
        ("x.yes", [("x", WORD), ("yes", WORD)]),
        ("", []),
        (None, []),
        ("77 ?!", []),
    ],
)
def test_scan(line, want):
    got = places(line)
    assert [(line[a:z], k) for a, z, k in got] == want


def test_scan_never_overlaps_and_keeps_every_letter():
    r = random.Random(1)
    for _ in range(3000):
        line = "".join(r.choice("aBé-'/&*~.:1○ しЖΩ") for _ in range(r.randint(0, 30)))
        end, covered = 0, set()
        for a, z, _ in places(line):
            assert end <= a < z
            end = z
            covered.update(range(a, z))
        assert {i for i, c in enumerate(line) if c in "aBéЖΩ"} <= covered


def test_flags_of_tokens(spark):
    got = {(r["doc_id"], r["text"]): r for r in tokenize(rows_of(spark, ["K: 250ml ;-p &Z& Ē", "星Y型 ABC9", "xx**yy ppが", "far" + " " * 40 + "off"]), with_line=True).collect()}
    at = lambda d, t: got[d, t]
    assert at(0, "K")["label"] and at(0, "ml")["after_digit"] and at(0, "p")["emoticon"] and at(0, "Z")["glued"] and at(0, "Ē")["diacritic"]
    assert at(1, "Y")["japanese_left"] and at(1, "Y")["japanese_right"] and at(1, "ABC")["before_digit"] and at(1, "Y")["other_word"]
    assert at(2, "pp")["censored"]
    # neighbours are found across any number of blanks
    assert (at(3, "far")["after"], at(3, "far")["after_spaced"], at(3, "off")["before"], at(3, "off")["before_spaced"]) == ("o", True, "r", True)
    assert not at(3, "far")["before_spaced"] and at(3, "far")["before"] == ""


def test_tokenize_as_a_table_function(spark):
    K.register(spark)
    assert [r["text"] for r in spark.sql("SELECT * FROM tokenize('red R/G/B light')").collect()] == ["red", "R", "G", "B", "light"]
    r = spark.sql("SELECT romaji_to_kana('hoshi') a, english_to_kana('night').kana b, lang_to_kana('fr', 'moi') c").first()
    assert tuple(r) == ("ホシ", "ナイト", "モワ")


@pytest.mark.parametrize(("text", "readable"), [("a", True), ("I", True), ("o", True), ("q", False), ("M", True), ("zz", False), ("ZZ", True), ("ZZZZ", False), ("stone", True), ("", False)])
def test_is_readable(spark, text, readable):
    no = F.lit(False)
    row = spark.createDataFrame([(text, text.lower())], "t string, n string")
    assert row.select(T.is_readable(F.col("t"), F.col("n"), F.lit("latin"), no, no, no, no, no).alias("r")).first()["r"] is readable


# -- engines -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("word", "kana"), [("hoshi", "ホシ"), ("kitte", "キッテ"), ("matcha", "マッチャ"), ("kin'en", "キンエン"), ("ryuu", "リュー"), ("stone", None), ("", None), (None, None), ("aaaa", None), ("su-pa", "スーパ"), ("xyz", None)])
def test_romaji(word, kana):
    assert K.romaji_to_kana(word) == kana


#: Words and readings as a published page on loanwords gives them.
GOLD = (
    "pit=ピット pet=ペット ham=ハム cap=キャップ london=ロンドン socks=ソックス kids=キッズ cat=キャット dog=ドッグ car=カー park=パーク card=カード link=リンク right=ライト phone=フォン love=ラブ vitamin=ビタミン visual=ヴィジュアル win=ウィン tourette=トゥレット two=トゥー video=ビデオ "
    "prince=プリンス dance=ダンス castle=キャッスル people=ピープル guitar=ギター coffee=コーヒー camera=カメラ music=ミュージック computer=コンピューター radio=ラジオ piano=ピアノ violin=バイオリン toy=トイ hamburger=ハンバーガー"
)
#: Loanwords of the list that have a form of their own: the rules alone read them otherwise, a lexicon has them.
SETTLED = "phone visual tourette guitar coffee camera music computer radio violin hamburger".split()
#: Words beside the list that the rules read otherwise, and why; no other may.
GAPS = {"tomato": ("トマト", "loan by letters"), "radish": ("ラディッシュ", "short vowel in an open syllable"), "iron": ("アイアン", "settled form"), "tour": ("ツアー", "old loan")}


def test_gold_words(spark):
    """25 of the 36 by the rules alone, all with a lexicon of the settled forms."""
    gold = [(w, k, w in SETTLED) for w, k in (x.split("=") for x in GOLD.split())] + [(w, k, True) for w, (k, _) in GAPS.items()]
    table = spark.createDataFrame(gold, "word string, kana string, known_gap boolean")
    r = align.evaluate(table, table.select("word", K.english_column("word").alias("r")).select("word", "r.kana")).first()
    assert (r["words"], r["unexplained"]) == (len(gold), 0) and all(reason for _, reason in GAPS.values())
    assert sum(K.english_to_kana(w)[0] == k for w, k, _ in gold[:36]) == 25
    listed = table.where("known_gap")
    read = cascade.read_words(listed.select("word"), listed.select("word", "kana")).select("word", "kana")
    assert align.evaluate(listed, read).first()["exact"] == len(SETTLED) + len(GAPS)


def test_long_words_are_read_to_their_end():
    start = time.time()
    assert K.english_to_kana("la" * 60_000)[0].startswith("ララララ") and len(K.english_to_kana("la" * 60_000)[0]) == 60_000
    assert time.time() - start < 10 and K.english_to_kana("la" * 60, most=4)[0] == "ララ"
    assert K.english_to_kana("zork", {"zork": "ゾーク"}) == ("ゾーク", True)


@pytest.mark.parametrize(("word", "kana"), [("fish", "フィッシュ"), ("match", "マッチ"), ("apple", "アップル"), ("table", "テーブル"), ("queen", "クイーン"), ("station", "ステイション"), ("knight", "ナイト"), ("home", "ホーム"), ("she", "シー"), ("fire", "ファイア"), ("care", "ケア"), ("street", "ストリート")])
def test_english_rules(word, kana):
    assert sounds.english(word) == kana


def test_english_is_never_empty_and_pure_kana():
    r = random.Random(2)
    for _ in range(5000):
        w = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(1, 30)))
        assert re.fullmatch("[ァ-ヶー]+", K.english_to_kana(w)[0]), w
    assert K.english_to_kana("") == ("", False) == K.english_to_kana(None)
    assert K.english_to_kana("love")[1] and not K.english_to_kana("brought")[1]


@pytest.mark.parametrize(
    ("lang", "words"),
    {
        "de": "liebe=リーベ nacht=ナハト stein=シュタイン zwei=ツヴァイ vogel=フォーゲル mädchen=メドヘン",
        "fr": "eau=オー bonjour=ボンジュール nuit=ニュイ chanson=シャンソン famille=ファミーユ",
        "la": "gloria=グロリア pacem=パケム terra=テッラ qui=クイ",
        "pt": "manhã=マニャン lua=ルア",
        "nl": "huis=ハウス boek=ブーク",
        "sw": "rafiki=ラフィキ nyota=ニョタ",
        "ru": "любовь=リュボヴ небо=ネボ",
        "el": "αγάπη=アガピ ήλιος=イリオス",
        "pinyin": "nǐ=ニ hǎo=ハウ zhōngguó=ジョングオ xuéxí=シュエシ",
    }.items(),
)
def test_languages_read_their_own_spelling(lang, words):
    got = {w.split("=")[0]: K.lang_to_kana(lang, w.split("=")[0]) for w in words.split()}
    assert all(re.fullmatch("[ァ-ヶー]+", k or "") for k in got.values()), got
    right = sum(got[w] == k for w, k in (x.split("=") for x in words.split()))
    assert right >= len(got) - 1, got


def test_engines_take_no_other_script():
    assert all(K.lang_to_kana(x, w) is None for x in sounds.LANGUAGES for w in ("", None, "カナ")) and K.lang_to_kana("xx", "word") is None


def test_contractions(spark):
    cases = {"I'll": ("i", "ll", None), "it's": ("it", "s", None), "can't": ("ca", "nt", "キャント"), "y’all": (None, None, "ヨール"), "plain": None, "rock'n'roll": None}
    rows = spark.createDataFrame([(w,) for w in cases], "w string")
    got = {r["w"]: r["c"] and tuple(r["c"]) for r in rows.select("w", K.split_contraction(F.col("w")).alias("c")).collect()}
    assert got == cases
    merged = spark.createDataFrame([("イット", "s", "イッツ"), ("キッド", "s", "キッズ"), ("ヒー", "s", "ヒーズ"), ("ユー", "re", "ユア"), ("アイ", "ll", "アイル"), ("アイ", "ve", "アイブ"), ("イズ", "nt", "イズント")], "k string, s string, want string")
    assert all(r["m"] == r["want"] for r in merged.select("want", K.merge_contraction(F.col("k"), F.col("s")).alias("m")).collect())


def test_letters_of_other_scripts_and_units(spark):
    rows = spark.createDataFrame([("ψ",), ("Ω",), ("ВДВ",), ("Ю",), ("мир",), ("km",)], "w string")
    got = {r["w"]: tuple(r)[1:] for r in rows.select("w", K.greek_letter(F.col("w")).alias("g"), K.cyrillic_letters(F.col("w")).alias("c"), K.unit_reading(F.col("w"), F.lit(True)).alias("u")).collect()}
    assert got["ψ"][0] == "プサイ" and got["Ω"][0] == "オーム" and got["ВДВ"][1] == "ヴェーデーヴェー" and got["Ю"][1] == "ユー" and got["мир"][1] is None and got["km"][2] == "キロ"


def test_folds(spark):
    r = spark.createDataFrame([("Ēkō", "Grüße", "tōkyō-é")], "a string, b string, c string").select(T.pure_macron("a").alias("a"), T.fold_language("b", "de").alias("b"), T.pure_macron("c").alias("c")).first()
    assert tuple(r) == (True, "gruesse", False)


# -- lines and languages -----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("line", "credit"),
    [("作曲：山田", True), ("Lyrics & Music: Mori", True), ("Vocals by Ann Lee", True), ("Mastered at Tower House by Jo", True), ("© 2020 Blue House", True), ("All rights reserved", True), ("Music of the night", False), ("music: only for you", False), ("Drums in the rain", False), ("", False), (None, False)],
)
def test_credit_lines(spark, line, credit):
    assert spark.createDataFrame([(line,)], "line string").select(lines.is_credit_line(F.col("line")).alias("c")).first()["c"] is credit


def test_credit_blocks_and_own_rules(spark):
    df = spark.createDataFrame([(1, 0, "Music: Mori"), (1, 1, "and someone"), (1, 2, "Bass: Kato"), (1, 3, "a song")], "doc_id long, line_no int, line string")
    assert [r["skipped"] for r in lines.credit_blocks(df).orderBy("line_no").collect()] == [True, True, True, False]
    mine = lines.Credits(roles=("Zither",), notices=("#",), deeds=("[Ww]oven",))
    assert [r["skipped"] for r in lines.credit_blocks(df.withColumn("line", F.lit("Zither: Mori")), mine).collect()] == [True] * 4


def test_line_features(spark):
    got = {r["doc_id"]: r for r in lines.line_features(lines.with_tokens(rows_of(spark, ["(o ^ o) / ~ * ♪ x !!", "A.B.C", "V, W, A", "red light", "か な", ""]))).collect()}
    assert got[0]["is_art"] and not got[1]["is_art"] and got[1]["letter_run"] and got[2]["letter_run"] and got[2]["all_units"] and not got[1]["all_units"]
    assert not got[3]["letter_run"] and got[3]["long_words"] == 2 and got[4]["has_kana"] and got[5]["words"] == 0


def test_romaji_lines(spark):
    lex = spark.createDataFrame([("do", "ドゥー"), ("me", "ミー"), ("so", "ソウ"), ("no", "ノウ"), ("to", "トゥー"), ("ka", "カ")], "word string, kana string")
    featured = lines.line_features(lines.with_tokens(rows_of(spark, ["do me so no to", "do me so no", "do me so no to the", "do do do do do"])))
    assert [r["doc_id"] for r in lines.romaji_lines(featured, lex).collect()] == [0]


@pytest.mark.parametrize(
    ("line", "lang"),
    [("wir sind nicht mehr allein", "de"), ("dans mes rêves tu es là", "fr"), ("onde você está agora, meu coração não", "pt"), ("ik heb het niet gezien", "nl"), ("pax in terra et lux mundi", "la"), ("leo watu wetu wana upendo sana", "sw"), ("wǒ ài nǐ", "pinyin"), ("wo ai ni zhe shi shenme", "pinyin"),
     ("we walked in the rain for you", None), ("夜の stone", None), ("тихая ночь", "ru"), ("καλή νύχτα", "el"), ("", None), ("JE SUIS TOI", None)],
)
def test_detect(spark, line, lang):
    assert language.detect(language.line_scores(rows_of(spark, [line]))).first()["lang"] == lang


def test_document_vote(spark):
    text = ["wir sind nicht mehr allein", "und das ist auch gut", "we walked in the rain", "Traumlichkeit"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "doc_id long, line_no int, line string")
    got = {r["line_no"]: r["line_lang"] for r in language.line_language(language.detect(language.line_scores(df))).collect()}
    assert got[0] == got[1] == got[3] == "de" and got[2] is None


def test_signals_from_tables(spark):
    langs = spark.sql("SELECT 'xx' lang, 0 ord, 2 least, 0 own_words, false marked, false plain, 0 strong, CAST(NULL AS STRING) parts")
    words = spark.sql("SELECT 'xx' lang, 'blorp' word, 2 points")
    none = spark.sql("SELECT '' lang, 0 ord, '' pattern, 0 points WHERE false")
    made = language.signals_of(langs, words, none, none)
    got = language.detect(language.line_scores(rows_of(spark, ["blorp blorp", "nothing"]), made), made).orderBy("doc_id").collect()
    assert [r["lang"] for r in got] == ["xx", None]


def test_long_vowels_and_echoes(spark):
    df = spark.createDataFrame([(1, "hear TO-\nTO-RE now"), (2, "no chain"), (3, None)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["word"]) for r in lines.long_vowel_words(df).collect()) == [(1, "RE"), (1, "TO")]
    assert [(r["doc_id"], r["norm"]) for r in lines.echo_fragments(rows_of(spark, ["reply, ly ly", "ly ly", "reply ly"])).collect()] == [(0, "ly")]


def test_a_line_is_read_in_one_pass(spark, monkeypatch):
    pieces = ["stone", "ly", "reply", "é", "Ça", "(o ^ o)", "V,", "W,", "A", "S.A.K.U.R.A", "***ing", "Q&A", "Nord-Ost", "the", "do", "me", "so", "no", "to", "石" * 40, "、" * 30, " " * 30, "5", "don't", "ärger", "Σας", "—", "b○x", "U-U-U're"]
    rng = random.Random(7)
    texts = [" ".join(rng.choices(pieces, k=rng.randrange(12))) for _ in range(300)] + [None, "ly reply ly", "do me so no to", "V W A"]
    monkeypatch.setattr(language, "ADDED_AT_ONCE", 5)
    one = rows_of(spark, texts).select("doc_id", readers.read_line(F.col("line"), language.SIGNALS).alias("r"))
    got = {r["doc_id"]: r["r"].asDict(recursive=True) for r in one.collect()}
    apart = lines.line_features(lines.with_tokens(rows_of(spark, texts)))
    words = language.line_words(F.col("line"))
    want = apart.select("*", lines.echoes(F.transform("s.text", lambda t: F.lower(t))).alias("echoes"), F.coalesce(F.size(words), F.lit(0)).alias("n"), language.points_column(words, language.SIGNALS).alias("points"))
    for r in (x.asDict(recursive=True) for x in want.collect()):
        here, shaped = got[r["doc_id"]], r["english_pairs"] == 0 and r["short_words"] >= max(lines.ROMAJI_KINDS, lines.ROMAJI_SHARE * r["words"])
        assert here["s"]["gap"] == [readers.near(g) for g in r["s"]["gap"]] and all(here["s"][x] == r["s"][x] for x in ("text", "start", "kind"))
        assert all(here[x] == r[x] for x in ("words", *readers.COUNTS, "strung", "all_units", "n", "points")) and sorted(here["echoes"]) == sorted(r["echoes"])
        assert here["short_kinds"] == (r["short_kinds"] if shaped else [])
    assert readers.near("石" * 1000) == "石" * 24 and readers.near(" " * 1000) == " " * 1000


# -- cascade -----------------------------------------------------------------------------------------------


def test_annotate_and_strip_are_inverse(spark):
    texts = ["青い stone と 🎌 river。", "none", "", r"{a|b} stone \ |x} \{river", "stone"]
    df = rows_of(spark, texts)
    spans = tokenize(df).where("text IN ('stone', 'river')").select("doc_id", "line_no", "start", "end", F.lit("カナ").alias("kana"), F.lit("dict").alias("source"), (F.col("text") == "river").alias("waiting"))
    got = {r["doc_id"]: r for r in cascade.annotate(df, spans).select("*", cascade.strip(F.col("markup")).alias("s")).collect()}
    assert [got[i]["s"] for i in range(len(texts))] == texts
    assert got[0]["markup"] == "青い {stone|カナ|dict} と 🎌 {river|カナ|dict?}。" and got[4]["markup"] == "{stone|カナ|dict}"


def test_lines_are_annotated_in_their_rows(spark):
    texts = ["Stone {a|b} stone\\river", "", None, "no word", "stonestone 石stone*rivers RIVER", "|"]
    lex = spark.sql("SELECT * FROM VALUES ('stone', 'ストーン'), ('river', 'リバー'), ('no', NULL) AS t(word, kana)")
    here, joined = (cascade.annotate_words(rows_of(spark, texts), lex, most=most) for most in (10_000, 0))
    plan = here._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Join" not in plan
    assert sorted(here.collect()) == sorted(joined.collect())
    got = {r["doc_id"]: r["markup"] for r in here.collect()}
    assert got[0] == "{Stone|ストーン|dict} \\{a\\|b\\} {stone|ストーン|dict}\\\\{river|リバー|dict}" and got[2] is None and got[4] == "stonestone 石{stone|ストーン|dict}*rivers {RIVER|リバー|dict}"
    assert [r["s"] for r in here.orderBy("doc_id").select(cascade.strip(F.col("markup")).alias("s")).collect()] == texts


def test_read_words_and_layer_orders(spark):
    assert T.layer_order(["rule", "rule", "nope", "dict"]) == ["rule", "dict", "romaji", "model", "free"]
    assert T.order_warnings(["rule", "dict"]) and not T.order_warnings(["dict", "rule"])
    words = spark.createDataFrame([("hoshi",), ("I'll",), ("can't",), ("ooo",), ("A.B",), ("light",), ("TKG",), ("MY",), ("tōkyō",), ("Stone!",), ("ＮＥＯＮ",), ("realize",)], "word string")
    lex = spark.createDataFrame([("hoshi", "スター"), ("i", "アイ"), ("stone", "イシ"), ("neon", "ネオン")], "word string, kana string")
    english = spark.createDataFrame([("my",)], "word string")
    by = lambda order: {r["word"]: (r["kana"], r["source"]) for r in cascade.read_words(words, lex, order, english).collect()}
    got = by(None)
    assert got["hoshi"] == ("スター", "dict") and got["I'll"] == ("アイル", "dict") and got["can't"] == ("キャント", "dict") and got["ooo"] == ("オオオ", "vowels") and got["A.B"] == ("エービー", "letters")
    assert got["light"][1] == "rule" and got["TKG"] == ("ティーケージー", "letters") and got["MY"][1] != "letters" and got["tōkyō"] == ("トーキョー", "romaji") and got["Stone!"] == ("イシ", "dict") and got["ＮＥＯＮ"] == ("ネオン", "dict")
    assert by(["romaji"])["hoshi"] == ("ホシ", "romaji") and by(None)["realize"][1] == "rule"


def test_overrides(spark):
    docs = spark.createDataFrame([(1, "Our Hymn", "x"), (2, "Other", "sign here"), (3, "Other", "x"), (4, None, None)], "doc_id long, title string, text string")
    table = spark.sql("SELECT * FROM VALUES (1, '^Our', CAST(NULL AS STRING), map('a', 'ア')), (2, 'zzz', 'sign', map('b', 'ビ')) AS t(override_id, title_pattern, marker_pattern, words)")
    assert sorted((r["doc_id"], r["word"]) for r in cascade.scope_overrides(docs, table).collect()) == [(1, "a"), (2, "b")]
    pairs = spark.sql("SELECT * FROM VALUES ('X', 'だけ', 'イー', 1), ('X', '.', 'エー', 2) AS t(word, pattern, kana, ord)")
    asked = spark.createDataFrame([("X", "Xだけ"), ("X", "other"), ("Y", "だけ")], "word string, line string")
    assert [r["override"] for r in cascade.line_overrides(asked, pairs).collect()] == ["イー", "エー", None]


def test_every_step_of_the_line_cascade(spark):
    special = spark.sql("SELECT * FROM VALUES ('emoticon', 'p', 'プー'), ('glued', 'at', 'エーティー'), ('acronym', 'gz', 'グズ'), ('masked', '***ing', 'ピーイング'), ('fragment', 'wa', 'ウェ'), ('echo', 'ly', 'ライ'), ('uncertain', 'krue', 'クル') AS t(kind, key, kana)")
    lex = [("stone", "ストーン"), ("river", "リバー"), ("do", "ドゥー"), ("me", "ミー"), ("so", "ソウ"), ("no", "ノウ"), ("to", "トゥー"), ("at", "アット"), ("box", "ボックス"), ("die", "ダイ"), ("amo", "エーモ")]
    texts = {
        "unit": ("45mm の", "mm", "ミリ", "letters"), "label": ("K: stone", "K", None, None), "art": ("(o ^ o) / ~ * ♪ x !!", "x", None, None), "song": ("stone の歌", "stone", "ウタ", "song"), "emoticon": (";-p stone", "p", "プー", "letters"),
        "small": ("ラCゃ", "C", "チ", "letters"), "between": ("ラR ア stone", "R", "ラ", "letters"), "a": ("aと", "a", "エイ", "letters"), "O": ("O stone", "O", "オー", "letters"), "watt": ("30Wの", "W", "ワット", "letters"), "units": ("V, W, A", "V", "ボルト", "letters"),
        "run": ("B, D, F", "D", "ディー", "letters"), "line": ("Jばかりの朝", "J", "イー", "dict"), "glued": ("Nさん", "N", "エヌ", "letters"), "other": ("U stone", "U", "ユー", "letters"), "article": ("A stone", "A", None, "any"), "digit": ("B4の紙", "B", "ビー", "letters"), "lone": ("Bの", "B", "ビー", "letters"),
        "and": ("Q&A", "&", "アンド", "letters"), "caps": ("ATドア", "AT", "エーティー", "letters"), "greek": ("ψ の", "ψ", "プサイ", "letters"), "time": ("PM6 の", "PM", "ピーエム", "letters"), "level": ("GZ だ", "GZ", "グズ", "dict"), "masked": ("***ing だ", "***ing", "ピーイング", "dict"), "mask": ("b○x だ", "b○x", "ボックス", "dict"),
        "cyrillic": ("Я らら", "Я", "ヤー", "letters"), "fragment": ("wa- だ", "wa", "ウェ", "dict"), "echo": ("reply ly ly", "ly", "ライ", "dict"), "chain": ("Ex-Hoshizora", "Hoshizora", "ホシゾラ", "romaji"), "short": ("Ex-Hoshizora", "Ex", "イーエックス", "letters"), "romaji": ("S.A.K.U.R.A", "S.A.K.U.R.A", "サクラ", "romaji"), "ph": ("p.h の値", "p.h", "ペーハー", "dict"),
        "guess": ("in the NEKO", "NEKO", "ネコ", "romaji"), "uncertain": ("in the KRUE", "KRUE", "クル", "rule"), "stop": ("in the KRUX", "KRUX", None, None), "learned": ("zorb だ", "zorb", "ゾーブ", "learned"), "dict": ("stone だ", "stone", "ストーン", "dict"), "loan": ("wir sind nicht mehr ein lied", "lied", "リート", "loan"), "engine": ("wir sind nicht mehr stein", "stein", "シュタイン", "lang"),
        "homograph": ("die wir nicht sind", "die", "ディー", "lang"), "latin": ("pax in terra et lux amo", "amo", "アモ", "lang"), "two": ("do だ", "do", "ドゥー", "dict"), "line of romaji": ("do me so no to", "do", "ド", "romaji"), "mute": ("a**stone", "a**stone", "any", "any"), "drawn": ("TO-TO-RE だ", "TO", "トー", "any"),
    }
    names = list(texts)
    rows = spark.createDataFrame([(i, 0, texts[n][0]) for i, n in enumerate(names)], "doc_id long, line_no int, line string")
    lexicon_table = spark.createDataFrame(lex, "word string, kana string")
    by_line = spark.sql("SELECT 'J' word, 'ばかり' pattern, 'イー' kana, 1 ord")
    song = spark.createDataFrame([(names.index("song"), {"stone": "ウタ"})], "doc_id long, song map<string,string>")
    by_doc = rows.join(song, "doc_id", "left").withColumn("drawn", lines.long_vowels(F.col("line")))
    told = cascade.line_tokens(cascade.in_lines(by_doc, lexicon_table, by_line=by_line))
    kinds = cascade.kinds_of(told, lexicon_table, special=special, learned=spark.sql("SELECT 'zorb' word, 'ゾーブ' kana UNION ALL SELECT 'stone', 'マチガイ'"), loans=spark.sql("SELECT 'de' lang, 'lied' key, 'リート' kana"), homographs=spark.sql("SELECT 'de' lang, 'die' word"), english=spark.sql("SELECT 'the' word"))
    read = cascade.read_tokens(told, kinds)
    got = {(names[r["doc_id"]], r["text"]): r for r in read.collect()}
    wrong = {}
    for name, (_, text, kana, source) in texts.items():
        r = got[name, text]
        if kana != "any" and source != "any" and (r["kana"], r["source"]) != (kana, source):
            wrong[name] = (r["kana"], r["source"], kana, source)
    assert not wrong, wrong
    assert not got["two", "do"]["confident"] and got["dict", "stone"]["confident"] and got["label", "K"]["suppressed"] and got["art", "x"]["suppressed"] and got["article", "A"]["kana"] and got["drawn", "TO"]["kana"].endswith("ー")


def test_resolve_and_provisional(spark):
    rows = spark.createDataFrame([("a", "ア", "dict", True, "モ", "フ"), ("b", "イ", "rule", False, "モ", None), ("c", "ウ", "letters", False, "モ", None), ("d", None, None, False, None, "フ"), ("e", "エ", "learned", True, "モ", None)], "w string, kana string, source string, confident boolean, model string, free string")
    assert [tuple(r) for r in cascade.resolve(rows).select("final", "final_source").collect()] == [("ア", "dict"), ("モ", "model"), ("ウ", "letters"), ("フ", "free"), ("エ", "learned")]
    waits = cascade.provisional(spark.createDataFrame([("a", "x"), ("b", "x")], "word string, ctx string"), spark.createDataFrame([("a", "x", 2), ("b", "x", 3)], "word string, ctx string, tries int"))
    assert {r["word"]: r["waiting"] for r in waits.collect()} == {"a": True, "b": False}


# -- lexicons and answers ----------------------------------------------------------------------------------


def test_build_masks_and_additions(spark):
    rows = spark.createDataFrame([("signal", "シグナル", "hand", 1), ("signal", "サイナル", "model", 3), ("Bad", "バ", "hand", 1), ("bad", "x", "model", 3), (None, "ア", "hand", 1), ("stop", "ストップ", "model", 3)], "word string, kana string, source string, priority int")
    built, counters = lexicon.build(rows, spark.createDataFrame([("stop",)], "word string"))
    assert [tuple(r)[:2] for r in built.collect()] == [("signal", "シグナル")]
    assert {(r["source"], r["status"]): r["rows"] for r in counters.collect()} == {("hand", "added"): 1, ("model", "skipped"): 1, ("hand", "bad_key"): 2, ("model", "bad_kana"): 1, ("model", "blocked"): 1}
    asked = spark.createDataFrame([("s○gnal",), ("plain",), ("○○",), ("X○X",)], "word string")
    curated = spark.createDataFrame([("x○x", "ピー")], "word string, kana string")
    assert {tuple(r) for r in lexicon.masked_lookup(asked, built, curated).collect()} == {("s○gnal", "シグナル"), ("X○X", "ピー")}
    more = lexicon.add_online(built, spark.createDataFrame([("New-Word", "ニュー"), ("signal", "ベツ"), ("bad", "latin")], "word string, kana string"))
    assert {(r["word"], r["kana"]) for r in more.collect()} == {("signal", "シグナル"), ("New-Word", "ニュー"), ("new-word", "ニュー"), ("newword", "ニュー")}


@pytest.mark.parametrize(("word", "kana", "ok"), [("bell", "スズ", False), ("they", "ゼイ", True), ("this", "ディス", True), ("apple", "リンゴ", True), ("Nguyen", "グエン", True), ("mnemonic", "ニモニック", True), ("pneumonia", "ニューモニア", True), ("tap", "ダニ", False), ("hour", "アワー", True)])
def test_first_sound(spark, word, kana, ok):
    df = spark.createDataFrame([(word, kana)], "w string, k string")
    r = df.select(answers.first_sound_ok(F.col("w"), F.col("k")).alias("ok"), answers.first_sound_ok(F.col("w"), F.col("k"), F.lit("de")).alias("foreign")).first()
    assert r["ok"] is ok and r["foreign"] is True


def test_parse_and_align_answers(spark):
    raw = spark.createDataFrame([(1, 'text {"1": "アップル", "b": "ボート"} more'), (2, '{"1": "ア", "b": "ボート", "c": "シ'), (3, None), (4, "nothing")], "batch long, content string")
    said = answers.parse_answers(raw)
    assert sorted(tuple(r) for r in said.collect()) == [(1, "1", "アップル", False), (1, "b", "ボート", False), (2, "1", "ア", True), (2, "b", "ボート", True)]
    asked = spark.createDataFrame([(1, 1, "apple"), (1, 2, "b"), (1, 3, "gone"), (2, 1, "cat"), (2, 3, "lost")], "batch long, item int, word string")
    got = {(r["batch"], r["item"]): (r["kana"], r["why"]) for r in answers.align_by_index(asked, said).collect()}
    assert got == {(1, 1): ("アップル", None), (1, 2): ("ボート", None), (1, 3): (None, "not given"), (2, 1): (None, "first sound"), (2, 3): (None, "requeue")}
    lenient = answers.align_by_index(asked, said, lambda word, kana, lang: F.lit(True))
    assert {r["item"]: r["kana"] for r in lenient.where("batch = 2").collect()}[1] == "ア"
    bodies = spark.createDataFrame([(1, "アップル\nボート\n漢字\n"), (2, "ア")], "batch long, body string")
    got = {(r["batch"], r["item"]): (r["kana"], r["why"]) for r in answers.align_by_line(asked, bodies).collect()}
    assert got[1, 1] == ("アップル", None) and got[1, 3] == (None, "not kana") and got[2, 1] == got[2, 3] == (None, "line count")


def test_promote_reasons(spark):
    rows = [("good", "グッド", 2, True), ("few", "フュー", 1, True), ("odd", "オド", 5, False), ("Up", "アップ", 2, True), ("hand", "ハンド", 2, True), ("und", "ウント", 2, True), ("same", "セイム", 2, True), ("bad", "bad", 2, True), ("do", "ドゥー", 3, True), ("nope", "ノープ", 3, True)]
    found = spark.createDataFrame(rows, "word string, kana string, lines long, consistent boolean")
    word = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    model = spark.createDataFrame([("same", "セイム"), ("good", "グド")], "word string, kana string")
    got = {r["word"]: (r["reason"], r["old_kana"]) for r in answers.promote(found, word("hand"), model, word("nope"), word("und")).collect()}
    assert got == {"good": (None, "グド"), "few": ("few lines", None), "odd": ("inconsistent", None), "Up": ("key", None), "hand": ("in hand lexicon", None), "und": ("foreign", None), "same": ("same", "セイム"), "bad": ("kana", None), "do": ("ambiguous", None), "nope": ("blocked", None)}
    mine = answers.promote(found, word("hand"), model, word("nope"), word("und"), lambda w, k: w == "good")
    assert {r["word"]: r["reason"] for r in mine.collect()}["good"] == "ambiguous"


# -- titles ------------------------------------------------------------------------------------------------


def test_align_cuts_at_the_least_distance_at_any_length():
    assert align.align([("ブルー", False), ("バード", False)], "ブルーバアド") == ["ブルー", "バアド"]
    assert align.align([("", True), ("ナイト", False)], "ヒャクナイト") == ["ヒャク", "ナイト"]
    assert align.align([("ア", False), ("イ", False)], "ア") is None
    long = ["ストーン", "リバー", "ナイト", "ハウス", "ガーデン"] * 8
    assert align.align([(k, False) for k in long], "".join(long)) == long  # 40 words, 150 kana


def test_align_titles(spark):
    title = " ".join(["Blue", "Bird"] * 15)
    titles = spark.createDataFrame([("Blue Bird", "ブルーバード"), ("Night 7", "ナイツセブン"), ("2nd Night", "セカンドナイト"), ("漢字", "カンジ"), ("A", None), (title, "ブルーバード" * 15)], "title string, pronunciation string")
    words = spark.createDataFrame([("blue", "ブルー"), ("bird", "バアド"), ("night", "ナイト")], "word string, kana string")
    got = {(r["title"], r["ord"]): (r["word"], r["piece"], r["reason"]) for r in align.align_titles(titles, words).collect()}
    assert got["Blue Bird", 0] == ("Blue", "ブルー", "equal") and got["Blue Bird", 1] == ("Bird", "バード", None) and got["Night 7", 0][2] is None
    assert got["2nd Night", 1] == ("Night", "ナイト", "equal") and got[title, 29] == ("Bird", "バード", None)


# -- sources -----------------------------------------------------------------------------------------------


def test_loans(spark, tmp_path):
    (tmp_path / "de.txt").write_text("# list\n\nArbeit:アルバイト\nnocolon\n:ア\nbad:abc\nx:ア\nx:イ\n", encoding="utf-8")
    loans, errors = files.read_loans(spark, str(tmp_path))
    assert [tuple(r) for r in loans.collect()] == [("de", "Arbeit", "アルバイト")]
    assert sorted(r["why"] for r in errors.collect()) == ["duplicate", "duplicate", "empty word", "no colon", "not kana"]


def test_titles_lists_and_snapshots(spark, tmp_path):
    (tmp_path / "t.json").write_text('[{"title": "Blue!", "pronunciation": "ぶるー ・"}, {"title": null}]', encoding="utf-8")
    assert [tuple(r) for r in files.read_titles(spark, str(tmp_path / "t.json")).collect()] == [("Blue!", "ブルー")]
    (tmp_path / "w.txt").write_text("The 100\n# note\nof 90\nx 80\naaaa 70\nstone 60\nriver 50\n", encoding="utf-8")
    assert [r["word"] for r in files.read_frequency_list(spark, str(tmp_path / "w.txt"), 3).collect()] == ["the", "of", "stone"]
    assert [r["word"] for r in files.read_frequency_list(spark, str(tmp_path / "w.txt"), 9, least=3).collect()] == ["the", "stone", "river"]
    folder = str(tmp_path / "snap")
    assert files.load_snapshot(spark, folder) is None
    for version, rows in ((3, [("old", "オールド")]), (12, [("new", "ニュー"), ("Bad", "バッド"), ("bad", "x")])):
        files.save_snapshot(spark.createDataFrame(rows, "word string, kana string"), folder, version)
    (tmp_path / "snap" / "v00000099").mkdir()  # never finished
    assert [tuple(r) for r in files.load_snapshot(spark, folder).collect()] == [("new", "ニュー")]


def test_page_blocks(spark):
    pages = ["<p>a &amp;lt; <b>b</b><script>x<y</script><!-- c --></p> d", "<div class='lyrics'>one<div class='line romaji-line'>ichi<div>deep</div></div><span class=translation>eins</span> two</div><pre><code>x</code> y</pre>end", "<ruby>字<rt>じ</rt></ruby>ok<br>more", None, "no tags", "<p>open <svg><g>gone"]
    got = [r["b"] for r in spark.createDataFrame([(p,) for p in pages], "h string").coalesce(1).select(files.page_blocks(F.col("h")).alias("b")).collect()]
    assert got == [["a &lt; b", "d"], ["one", "two", "end"], ["ok", "more"], None, ["no tags"], ["open"]]


# -- streams -----------------------------------------------------------------------------------------------


def test_learning_by_its_table():
    def said(*events):
        word = learn.Word()
        return [(r := word.take(*e)) and r[0] for e in events]

    assert said(("アイ", "x", ""), ("アイ", "y", "")) == ["pending", "learned"]
    assert said(("アイ", "x", ""), ("アイ", "x ", "")) == ["pending", None]
    assert said(("アイ", "", ""), ("アイ", "", ""), ("アイ", "y", "")) == ["pending", "pending", "pending"]
    assert said(("アイ", "x", ""), ("アイ", "y", ""), ("ウエ", "z", ""), ("ウエ", "q", ""), ("ウエ", "r", "")) == ["pending", "learned", "dropped", "pending", "learned"]
    assert said(("abc", "x", ""), ("アイ", "x", "アイ"), ("ア" * 15, "x", "")) == [None] * 3
    assert said(("アイ", "x", ""), ("", "", "", True), ("アイ", "y", "")) == ["pending", "forgotten", "pending"]


def test_batch_and_stream_agree(spark, tmp_path):
    rows = [("Word%d" % (i % 5), 1.7e9 + i // 5, i, "アイウ"[i * 7 % 3] * 2, "l%d" % (i % 4), "") for i in range(100)] + [("x", 1.7e9, 999, "アイ", "l", "")]
    made = spark.createDataFrame(rows, "word string, t double, n long, kana string, line string, local string").select("word", F.timestamp_seconds("t").alias("ts"), "n", "kana", "line", "local")
    df = learn.answers_of(made, normalise=lambda w: F.lower(w))
    want = sorted(tuple(r) for r in learn.batch(df).collect())
    assert want == sorted(tuple(r) for r in learn.batch(df.repartition(7)).collect()) and not any(r[0] == "x" for r in want)
    end = df.limit(1).withColumn("word", F.lit("end")).withColumn("ts", F.lit("2099-01-01").cast("timestamp")).withColumn("n", F.lit(99).cast("long"))  # lets the watermark pass all others
    for part in range(4):
        df.where(f"n div 25 = {part}").unionByName(end.where(f"{part} = 3")).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = learn.stream(source).writeStream.format("memory").queryName("learned").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert sorted(tuple(r) for r in spark.table("learned").where("word <> 'end'").collect()) == want and want
    assert {r["word"] for r in learn.learned(learn.batch(df)).collect()} <= {f"word{i}" for i in range(5)}


def test_usage(spark):
    df = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP'2026-01-01 10:00:00', 'a', 's1', 5), (2, TIMESTAMP'2026-01-01 23:00:00', 'a', 's1', 1), (3, TIMESTAMP'2026-01-02 00:00:00', 'a', 's2', 2) AS t(event_id, ts, kind, session_id, words)")
    assert sorted(r["requests"] for r in usage.daily(df).collect()) == [1, 2]
    assert sorted((r["event_id"], r["total"], r["today"]) for r in usage.running(df).collect()) == [(1, 1, 1), (2, 2, 2), (3, 3, 1)]
    assert {(r["session_id"], r["requests"], r["words"]) for r in usage.totals(df, "session_id").collect()} == {("s1", 2, 6), ("s2", 1, 2)}
    assert usage.sessions(df).count() == 3


def test_answer_cache(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES ('model', 'a', 'x', 'ア', false, TIMESTAMP'2026-01-01 00:00:00'), ('model', 'a', 'x', 'イ', false, TIMESTAMP'2026-01-02 00:00:00'), ('free', 'a', 'x', 'ウ', false, TIMESTAMP'2026-01-01 00:00:00'), ('free', 'b', 'x', NULL, true, TIMESTAMP'2026-03-20 00:00:00') AS t(kind, word, ctx, kana, is_miss, at)")
    assert sorted((r["kind"], r["word"], r["kana"]) for r in annotate.cached(rows).na.fill("-", ["kana"]).collect()) == [("free", "b", "-"), ("model", "a", "ア")]
    rows.orderBy("at").coalesce(1).write.parquet(f"{tmp_path}/in")
    query = annotate.cached(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("cache").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert sorted((r["kind"], r["word"]) for r in spark.table("cache").collect()) == [("free", "a"), ("free", "b"), ("model", "a")]
    kept, wanted = answers.retried(rows, spark.createDataFrame([("a", "x", 3), ("b", "x", 3)], "word string, ctx string, tries int"))
    assert kept.count() == 3 and {r["word"]: r["tries"] for r in wanted.collect()} == {"a": 3, "b": 0}
    assert answers.fresh(rows, F.lit("2026-02-15").cast("timestamp"), {"model": 180, "free": 30}).count() == 3


def test_annotated_stream(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES (1L, 0, 'river and stone', TIMESTAMP'2026-01-01 10:00:00'), (1L, 1, 'river and stone', TIMESTAMP'2026-01-01 10:01:00'), (2L, 0, 'zzz', TIMESTAMP'2026-01-01 10:02:00') AS t(doc_id, line_no, line, ts)")
    readings = spark.sql("SELECT * FROM VALUES ('river', 'リバー', 'dict'), ('and', 'アンド', 'dict') AS t(word, kana, source)")
    rows.coalesce(1).write.parquet(f"{tmp_path}/lines")
    source = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/lines")
    for name, make in (("tokens", lambda df: annotate.annotated(df, readings)), ("asked", lambda df: annotate.questions(annotate.annotated(df, readings)))):
        query = make(source).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert sorted(map(repr, spark.table(name).drop("ts").collect())) == sorted(map(repr, make(rows).drop("ts").collect()))
    assert sorted((r["key"], r["ctx"]) for r in spark.table("asked").collect()) == [("stone", "river and stone"), ("zzz", "zzz")]
    said = spark.sql("SELECT 'stone' key, 'river and stone' ctx, 'ストーン' kana, TIMESTAMP'2026-01-01 10:02:00' at")
    late = annotate.relabelled(annotate.annotated(rows, readings), said)
    assert [(r["text"], r["kana"]) for r in late.collect()] == [("stone", "ストーン")] * 2
    lex, out = spark.createDataFrame([("river", "リバー")], "word string, kana string"), []
    query = source.writeStream.foreachBatch(annotate.read_batches(lex, lambda df, n: out.extend(df.where("text = 'river'").collect()))).option("checkpointLocation", f"{tmp_path}/each").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert [(r["kana"], r["source"]) for r in out] == [("リバー", "dict")] * 2


# -- the contract ------------------------------------------------------------------------------------------


def test_registry_is_whole(spark):
    import __spark_entry__ as entry

    found, sql = entry.queries(), entry.oracle_sql()
    assert entry.FLAGSHIP in found and set(sql) <= set(found) and len(found) > 70
    assert entry.entry(spark).count() > 0


def test_partition_count_changes_nothing(spark):
    rows = [(i, j, "the light of river " + "und " * (j % 3)) for i in range(20) for j in range(5)]
    one = spark.createDataFrame(rows, "doc_id long, line_no int, line string").coalesce(1)
    both = [sorted(tuple(r) for r in language.detect(language.line_scores(df)).select("doc_id", "line_no", "lang").collect()) for df in (one, one.repartition(8))]
    assert both[0] == both[1]
