"""Column functions over words and lines: folding, scripts, keys, kana classes. All stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The letters that count as western, as regular-expression classes.
LATIN = r"A-Za-zÀ-ɏḀ-ỿＡ-Ｚａ-ｚ"
CYRILLIC = r"Ѐ-ԯ"
GREEK = r"Ͱ-Ͽἀ-῿"
WESTERN = LATIN + CYRILLIC + GREEK
#: Marks that drop out of a word's look-up form: apostrophes, wave dashes, hyphens.
FOLDED_MARKS = "'’~～〜-‐‑–—"
_FULL = "".join(chr(c) for c in (*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)))
_HALF = "".join(chr(c - 0xFEE0) for c in (*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)))
_HIRA = "".join(chr(c) for c in range(0x3041, 0x3097))
_KATA = "".join(chr(c + 0x60) for c in range(0x3041, 0x3097))
#: Kana classes differ by purpose: lexicon, model answers, learned words.
KANA = {"lexicon": r"[゠-ヿー]+", "answer": r"[ァ-ヶー]+", "learned": r"[ァ-ヶーヿ]+"}
MAX_KANA = 14
CONTEXT_CHARS = 160
#: Marked Latin letters and their base letters; what has two base letters stands in DIGRAPHS.
MARKED = "àáâãäåāăąçćčďđèéêëēĕęěìíîïīĭłñńňòóôõöøōŏőřśšťùúûüūŭůűýÿźżž"
BASE = "aaaaaaaaacccddeeeeeeeeiiiiiilnnnooooooooorsstuuuuuuuuyyzzz"
DIGRAPHS = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"}
MACRONS = {"ā": "a-", "ē": "e-", "ī": "i-", "ō": "o-", "ū": "u-"}


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def fold_fullwidth(col: Column | str) -> Column:
    return F.translate(_c(col), _FULL, _HALF)


def wide(col: Column | str) -> Column:
    """Whether a text has a letter beyond ASCII: many patterns fit no other text, and this is told without reading letter by letter."""
    return F.octet_length(_c(col)) != F.length(_c(col))


def normalize_word(col: Column | str) -> Column:
    """Look-up form: half-width, lower case, no apostrophes, hyphens or wave dashes."""
    return F.translate(F.lower(fold_fullwidth(col)), FOLDED_MARKS, "")


def script_of(col: Column | str) -> Column:
    c = _c(col)
    return F.when(c.rlike(f"[{CYRILLIC}]"), "cyrillic").when(c.rlike(f"[{GREEK}]"), "greek").otherwise("latin")


def has_latin(col: Column | str) -> Column:
    return F.coalesce(_c(col).rlike(f"[{LATIN}]"), F.lit(False))


def has_western(col: Column | str) -> Column:
    return F.coalesce(_c(col).rlike(f"[{WESTERN}]"), F.lit(False))


def context_key(line: Column | str, most: int | None = CONTEXT_CHARS) -> Column:
    """A sentence as a key: white space folded, cut to a length (None: whole)."""
    folded = F.trim(F.regexp_replace(_c(line), r"\s+", " "))
    return folded if most is None else F.substring(folded, 1, most)


def context_hash(line: Column | str) -> Column:
    """Equal for the same sentence; null for an empty one."""
    folded = F.trim(F.regexp_replace(_c(line), r"\s+", " "))
    return F.when(folded != "", F.xxhash64(folded))


def fold_diacritics(col: Column | str) -> Column:
    c = F.lower(_c(col))
    for mark, base in DIGRAPHS.items():
        c = F.replace(c, F.lit(mark), F.lit(base))
    return F.translate(c, MARKED, BASE)


#: Letters that a language writes out in plain letters.
FOLDS = {"de": {"ä": "ae", "ö": "oe", "ü": "ue"}}


def fold_language(col: Column | str, lang: str) -> Column:
    """A language's word in plain letters, as its loan tables spell it; hyphens and apostrophes gone."""
    c = F.lower(_c(col))
    for mark, base in FOLDS.get(lang, {}).items():
        c = F.replace(c, F.lit(mark), F.lit(base))
    return F.translate(fold_diacritics(c), FOLDED_MARKS, "")


def pure_macron(col: Column | str) -> Column:
    """Whether a word has macrons and no other mark: it is romanised Japanese."""
    c = F.lower(_c(col))
    return F.coalesce(c.rlike(f"[{''.join(MACRONS)}]") & ~c.rlike(f"[^a-z{''.join(MACRONS)}'-]"), F.lit(False))


def fold_macrons(col: Column | str) -> Column:
    """Long vowels written with a macron become vowel and hyphen (romanised long marks)."""
    c = F.lower(_c(col))
    for mark, base in MACRONS.items():
        c = F.replace(c, F.lit(mark), F.lit(base))
    return c


def word_key(col: Column | str, most: int = 24) -> Column:
    """Key of an answer: folded letters only; null where nothing or too much is left."""
    k = F.regexp_replace(fold_diacritics(fold_fullwidth(col)), rf"[^a-z{CYRILLIC}{GREEK}]", "")
    return F.when(F.length(k).between(1, most), k)


def hira_to_kata(col: Column | str) -> Column:
    return F.translate(_c(col), _HIRA, _KATA)


def is_kana(col: Column | str, kind: str = "answer") -> Column:
    return F.coalesce(_c(col).rlike(f"^{KANA[kind]}$"), F.lit(False))


def kana_ok(col: Column | str, kind: str = "answer", most: int = MAX_KANA) -> Column:
    return is_kana(col, kind) & (F.length(_c(col)) <= most)


def kana_distance(a: Column | str, b: Column | str) -> Column:
    return F.levenshtein(_c(a), _c(b))


def vowel_run_kana(col: Column | str) -> Column:
    """The same vowel up to twelve times: its kana as often; null otherwise."""
    w = F.lower(_c(col))
    kana = F.translate(F.substring(w, 1, 1), "aiueo", "アイウエオ")
    return F.when(w.rlike(r"^([aiueo])\1{1,11}$"), F.repeat(kana, F.length(w)))


def is_readable(text: Column, norm: Column, script: Column, glued: Column, emoticon: Column, notation: Column, after_digit: Column, diacritic: Column) -> Column:
    """Which tokens deserve a reading."""
    n = F.length(norm)
    repeat = norm.rlike(r"^([bcdfghjklmnpqrstvwxyz])\1+$")
    single = F.when(glued & ~emoticon, False).when(emoticon, True).when(text.rlike("^[A-Z]$"), True).otherwise(diacritic | norm.isin("a", "i", "o"))
    return (
        F.when(F.coalesce(norm, F.lit("")) == "", False)
        .when(script != "latin", ~glued)
        .when(notation, True)
        .when(repeat & after_digit, n <= 3)
        .when(repeat, text.rlike("^[BCDFGHJKLMNPQRSTVWXYZ]{2,3}$"))
        .when(n == 1, single)
        .otherwise(True)
    )


def layer_order(wanted: list[str], known: tuple[str, ...] = ("dict", "romaji", "model", "free", "rule")) -> list[str]:
    """A configured layer order made whole: known layers once each, the missing ones appended."""
    kept = [x for x in dict.fromkeys(wanted) if x in known]
    return kept + [x for x in known if x not in kept]


def order_warnings(order: list[str]) -> list[str]:
    """Layers that the spelling rules, which always answer, leave nothing to."""
    at = order.index("rule") if "rule" in order else len(order)
    return [f"{x} is never reached: rule comes first" for x in order[at + 1 :] if x in ("dict", "romaji")]
