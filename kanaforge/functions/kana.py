"""Kana of words: romanised Japanese, letter names, contractions, English spelling.

Every engine is a small vectorised helper or a column expression; jobs call it once for each distinct word."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from kanaforge.functions.sounds import IRREGULAR, english, foreign

# -- romanised Japanese ------------------------------------------------------------------------------------

_ROWS = {
    "": "アイウエオ", "k": "カキクケコ", "g": "ガギグゲゴ", "s": "サシスセソ", "z": "ザジズゼゾ", "t": "タチツテト", "d": "ダヂヅデド",
    "n": "ナニヌネノ", "h": "ハヒフヘホ", "b": "バビブベボ", "p": "パピプペポ", "m": "マミムメモ", "r": "ラリルレロ",
}
#: Kana of the i-row that start a contracted sound, by the letters that stand for them.
_GLIDES = {"ky": "キ", "gy": "ギ", "sh": "シ", "sy": "シ", "j": "ジ", "zy": "ジ", "ch": "チ", "ty": "チ", "ny": "ニ", "hy": "ヒ", "by": "ビ", "py": "ピ", "my": "ミ", "ry": "リ"}
_ODD = {"ya": "ヤ", "yu": "ユ", "yo": "ヨ", "wa": "ワ", "wo": "ヲ", "fu": "フ", "tsu": "ツ", "shi": "シ", "chi": "チ", "ji": "ジ", "je": "ジェ", "she": "シェ", "che": "チェ", "fa": "ファ", "fi": "フィ", "fe": "フェ", "fo": "フォ", "vu": "ヴ", "va": "ヴァ", "vi": "ヴィ", "ve": "ヴェ", "vo": "ヴォ", "ti": "ティ", "di": "ディ"}


def _syllables() -> dict[str, str]:
    out = {c + v: row[i] for c, row in _ROWS.items() for i, v in enumerate("aiueo")}
    out |= {c + v: k + small for c, k in _GLIDES.items() for v, small in zip("auo", "ャュョ", strict=True)}
    return out | _ODD


SYLLABLES = _syllables()
_LONG = {"aa", "ii", "uu", "ee", "oo", "ou"}


def romaji_to_kana(word: str | None) -> str | None:
    """A word that is romanised Japanese from end to end; None where a letter is left over."""
    if not word or not re.fullmatch(r"[a-z'-]+", word) or not re.search("[aiueon]", word) or re.search("[aiueo]{4}", word):
        return None
    out, i = [], 0
    while i < len(word):
        rest = word[i:]
        if rest[0] == "-":
            if not out:
                return None
            out.append("ー")
            i += 1
        elif rest[0] == "'":
            i += 1
        elif len(rest) > 1 and rest[0] == rest[1] and rest[0] in "kgsztdhbpmrcfj":
            out.append("ッ")
            i += 1
        elif rest.startswith("tch"):
            out.append("ッ")
            i += 1
        elif rest[0] == "n" and (len(rest) == 1 or rest[1] not in "aiueoy"):
            out.append("ン")
            i += 1
        else:
            size = next((k for k in (3, 2, 1) if rest[:k] in SYLLABLES), 0)
            if not size:
                return None
            kana = SYLLABLES[rest[:size]]
            vowels = word[i + size - 1 : i + size + 1]
            out.append(kana)
            i += size
            if vowels in _LONG:
                out.append("ー")
                i += 1
    return "".join(out)


# -- letters -----------------------------------------------------------------------------------------------

#: Japanese names of the letters.
LETTER_NAMES = {
    "a": "エー", "b": "ビー", "c": "シー", "d": "ディー", "e": "イー", "f": "エフ", "g": "ジー", "h": "エイチ", "i": "アイ", "j": "ジェー", "k": "ケー", "l": "エル", "m": "エム",
    "n": "エヌ", "o": "オー", "p": "ピー", "q": "キュー", "r": "アール", "s": "エス", "t": "ティー", "u": "ユー", "v": "ブイ", "w": "ダブリュー", "x": "エックス", "y": "ワイ", "z": "ゼット", "&": "アンド",
}


def _literal(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def letters_to_kana(col: Column) -> Column:
    """Names of a string's letters, marks silent but `&`."""
    names = _literal(LETTER_NAMES)
    return F.array_join(F.transform(F.filter(F.split(F.regexp_replace(F.lower(col), "[^a-z&]", ""), ""), lambda c: c != ""), lambda c: names[c]), "")


def notation_to_kana(col: Column) -> Column:
    """Letters strung together by marks (2 to 12 of them); null for anything else."""
    return F.when(col.rlike(r"^[A-Za-z](?:[^A-Za-z0-9\s][A-Za-z]){1,11}$"), letters_to_kana(col))


def acronym_kana(raw: Column, known: Column, romaji: Column | None = None) -> Column:
    """Capitals read by name: without a vowel up to six, with one up to three and only where nothing else knows them:
    no lexicon or word list (known), and no romanised reading."""
    bare = ~raw.rlike("[AEIOUY]") & raw.rlike("^[A-Z]{2,6}$")
    free = ~known if romaji is None else ~known & romaji.isNull()
    return F.when(bare | (raw.rlike("^[A-Z]{2,3}$") & free), letters_to_kana(raw))


#: Sounds of contractions' suffixes.
SUFFIXES = {"re": "ア", "ll": "ル", "d": "ド", "ve": "ブ", "m": "ム", "nt": "ント"}
#: Contractions whose sound is not their base's and their suffix's.
WHOLE_CONTRACTIONS = {
    "don't": "ドント", "can't": "キャント", "won't": "ウォント", "ain't": "エイント", "aren't": "アーント", "weren't": "ワーント", "couldn't": "クドント", "wouldn't": "ウドント", "shouldn't": "シュドント", "mustn't": "マスント",
    "hadn't": "ハドント", "needn't": "ニードント", "they're": "ゼア", "we'll": "ウィル", "y'all": "ヨール",
}
_APOSTROPHES = "’ʼ＇"


def apostrophes(raw: Column) -> Column:
    """Lower case, with one kind of apostrophe."""
    return F.translate(F.lower(F.trim(raw)), _APOSTROPHES, "'" * len(_APOSTROPHES))


def _part(col: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(col, pattern, 1), F.lit(""))


def split_contraction(raw: Column) -> Column:
    """struct(base, suffix, fixed) of a contraction; null for other words. fixed: the sound of the whole, where settled."""
    low = apostrophes(raw)
    base = F.coalesce(_part(low, "^([a-z]+)n't$"), _part(low, "^([a-z]+)'(?:s|re|ll|d|ve|m)$"))
    suffix = F.when(low.rlike("^[a-z]+n't$"), "nt").otherwise(_part(low, "^[a-z]+'(s|re|ll|d|ve|m)$"))
    fixed = _literal(WHOLE_CONTRACTIONS)[low]
    return F.when(base.isNotNull() | fixed.isNotNull(), F.struct(base.alias("base"), suffix.alias("suffix"), fixed.alias("fixed")))


def merge_contraction(kana: Column, suffix: Column) -> Column:
    """A base's kana with its suffix: a last t or d takes s into its own sound, a long mark gives way before re."""
    cut = F.left(kana, F.greatest(F.length(kana) - 1, F.lit(0)))
    hiss = F.when(kana.endswith("ト"), F.concat(cut, F.lit("ツ"))).when(kana.endswith("ド"), F.concat(cut, F.lit("ズ"))).when(kana.endswith("ッ"), F.concat(kana, F.lit("ツ"))).otherwise(F.concat(kana, F.lit("ズ")))
    bare = F.when((suffix == "re") & kana.endswith("ー"), cut).otherwise(kana)
    return F.when(suffix == "s", hiss).otherwise(F.concat(bare, _literal(SUFFIXES)[suffix]))


# -- English and other languages by spelling ---------------------------------------------------------------


def english_to_kana(word: str | None, irregular: dict[str, str] = IRREGULAR, most: int | None = None) -> tuple[str, bool]:
    """(kana, confident) of an English word by spelling: never empty for a word with a letter; most: read only so many letters."""
    w = re.sub("[^a-z]", "", (word or "").lower())[:most]
    if not w:
        return "", False
    return english(w, irregular) or LETTER_NAMES[w[0]], w in irregular or not uncertain(w)


#: Spellings that stand for several sounds: digraphs, silent letters, runs of vowels and of consonants.
_UNCERTAIN = re.compile("th|wh|gh|oo|ou|ow|oa|oe|ea|ew|ui|^(?:wr|kn|ps|pn)|[aeiou]{3}|[^aeiouy]{5}")


def uncertain(word: str) -> bool:
    return bool(_UNCERTAIN.search(word))


def uncertain_spelling(col: Column) -> Column:
    return F.lower(col).rlike(_UNCERTAIN.pattern)


def lang_to_kana(lang: str, word: str | None) -> str | None:
    """Kana of a word of another language, by its spelling; None for an unknown language or no letters of it."""
    return foreign(lang, word) if word and lang else None


# -- columns -----------------------------------------------------------------------------------------------


def _map(values: pa.Array, f) -> list:
    known: dict = {}
    return [known[v] if v in known else known.setdefault(v, f(v)) for v in values.to_pylist()]


def _romaji(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for b in batches:
        yield pa.array(_map(b, romaji_to_kana), pa.string())


def _english(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for b in batches:
        got = _map(b, english_to_kana)
        yield pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.bool_())], ["kana", "confident"])


def _foreign(langs: pa.Array, words: pa.Array) -> pa.Array:
    return pa.array([lang_to_kana(a, b) for a, b in zip(langs.to_pylist(), words.to_pylist(), strict=True)], pa.string())


def romaji_column(word: Column | str) -> Column:
    return F.arrow_udf(_romaji, "string")(word)


def english_column(word: Column | str) -> Column:
    return F.arrow_udf(_english, "struct<kana:string,confident:boolean>")(word)


def lang_column(lang: Column | str, word: Column | str) -> Column:
    return F.arrow_udf(_foreign, "string")(lang, word)


def register(spark) -> None:
    """The engines as SQL functions, and the scanner as a table function."""
    spark.udf.register("romaji_to_kana", F.arrow_udf(_romaji, "string"))
    spark.udf.register("english_to_kana", F.arrow_udf(_english, "struct<kana:string,confident:boolean>"))
    spark.udf.register("lang_to_kana", F.arrow_udf(_foreign, "string"))
    from kanaforge.functions import tokens  # the scanner reads romanised words, so it imports this module

    tokens.register(spark)


# -- letters of other scripts, units -----------------------------------------------------------------------

#: Japanese names of the Greek letters, alpha to omega.
GREEK_NAMES = dict(zip("αβγδεζηθικλμνξοπρστυφχψω", "アルファ ベータ ガンマ デルタ イプシロン ゼータ イータ シータ イオタ カッパ ラムダ ミュー ニュー クサイ オミクロン パイ ロー シグマ タウ ウプシロン ファイ カイ プサイ オメガ".split(), strict=True))
#: Japanese names of the Cyrillic letters, as they are spelled out.
CYRILLIC_NAMES = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "アー ベー ヴェー ゲー デー イェー ヨー ジェー ゼー イー イー カー エル エム エヌ オー ペー エル エス テー ウー エフ ハー ツェー チェー シャー シシャー イェル ウィ イェーリ エー ユー ヤー".split(), strict=True))
#: Units, read so only right after a digit.
UNITS = {"km": "キロ", "kg": "キロ", "cm": "センチ", "mm": "ミリ", "m": "メートル", "g": "グラム", "mg": "ミリグラム", "l": "リットル", "ml": "ミリリットル", "hz": "ヘルツ", "khz": "キロヘルツ", "db": "デシベル", "kw": "キロワット"}
#: Capitals that stand for units.
UNIT_SYMBOLS = {"V": "ボルト", "W": "ワット", "A": "アンペア", "N": "ニュートン", "J": "ジュール", "K": "ケルビン", "F": "ファラド", "H": "ヘンリー"}


def greek_letter(text: Column) -> Column:
    """Name of a lone Greek letter; the capital omega is the unit ohm. Null for anything else."""
    return F.when(text.isin("Ω", "Ω"), "オーム").when(F.length(text) == 1, _literal(GREEK_NAMES)[F.lower(text)])


def cyrillic_letters(text: Column) -> Column:
    """Names of a lone Cyrillic letter, or of two to six capitals without a vowel; null for anything else."""
    names = _literal(CYRILLIC_NAMES)
    spelled = F.array_join(F.transform(F.filter(F.split(F.lower(text), ""), lambda c: c != ""), lambda c: names[c]), "")
    return F.when(text.rlike("^[А-Яа-яЁё]$") | text.rlike("^[БВГДЖЗЙКЛМНПРСТФХЦЧШЩ]{2,6}$"), spelled)


def unit_reading(norm: Column, after_digit: Column) -> Column:
    return F.when(after_digit, _literal(UNITS)[F.lower(norm)])


def unit_symbol(text: Column) -> Column:
    return _literal(UNIT_SYMBOLS)[text]
