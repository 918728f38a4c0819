"""The scanner: western tokens of a line with their places, the text between them, and flags.

A worker finds the tokens of a line in one pass and returns columns only: texts, places, kinds and the gaps between
them. What a token's surroundings say (after a digit, glued to kana, a label ...) follows from its gaps in generated code.
Offsets are code points. Marks are taken from Unicode's classes where those say what is meant."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kanaforge.functions.kana import romaji_to_kana
from kanaforge.functions.text import CYRILLIC, GREEK, LATIN, WESTERN, normalize_word, script_of


def _of_class(*kinds: str, but: str = "") -> str:
    """Characters below U+FFFF of some Unicode categories, as the inside of a regular expression's class."""
    return re.escape("".join(c for c in map(chr, range(0x21, 0xFFFF)) if unicodedata.category(c) in kinds and c not in but))


#: Dashes of every kind, the minus and the long mark; what joins the parts of a word besides.
DASHES = _of_class("Pd") + "−ー"
JOINS = DASHES + "'’~～"
#: Circles that stand for a hidden letter.
CIRCLES = "○●◎◯〇⭕"
#: One such mark may string single letters together: dashes, connectors, signs, and marks that do not end or quote.
STRINGS = _of_class("Pd", "Pc", "Sm", "Po", but="<>!?;:,%@'\"’¡¿、。，．！？：；…‥†‡‰※＜＞％＠＂＇")
#: Kinds of tokens.
WORD, MASKED, CHAIN, LETTER, SYMBOL, FIXED, ROMAJI = range(7)

_PIECE = rf"[{WESTERN}]+(?:[{CIRCLES}]+[{WESTERN}]*|(?:[{JOINS}]|[*＊]+)[{WESTERN}]+)*"
_TOKEN = re.compile(rf"([{LATIN}](?:[{STRINGS}][{LATIN}])+(?![{WESTERN}]))|(?:[*＊]{{2,}})?{_PIECE}")
_DASH = re.compile(f"[{DASHES}]")
_SUFFIX = re.compile(r"['’](?:[sdm]|re|ll|ve)(?![A-Za-z])", re.I)
_LETTER = re.compile(f"[{WESTERN}]")
#: Letters strung by marks that are read as one word.
FIXED_WORDS = {"ph"}
#: Strung letters of so many that are romanised Japanese are one word too.
ROMAJI_LETTERS = 5


def _strung(line: str, start: int, end: int) -> list[tuple[int, int, int]]:
    """(start, end, kind) of letters strung by marks: one token, or one for each letter and `&`."""
    letters = "".join(_LETTER.findall(line, start, end)).lower()
    if letters in FIXED_WORDS:
        return [(start, end, FIXED)]
    if len(letters) >= ROMAJI_LETTERS and romaji_to_kana(letters):
        return [(start, end, ROMAJI)]
    out = [(i, i + 1, SYMBOL if line[i] == "&" else LETTER) for i in range(start, end) if line[i] == "&" or _LETTER.match(line[i])]
    if suffix := _SUFFIX.match(line, end):
        out[-1] = (end - 1, suffix.end(), LETTER)
    return out


def _worded(line: str, start: int, end: int) -> list[tuple[int, int, int]]:
    """(start, end, kind) of a word, or of its parts where dashes join parts of two letters and more."""
    if line[start] in "*＊":
        return [(start, end, MASKED)]
    places, at = [], start
    for m in _DASH.finditer(line, start, end):
        places.append((at, m.start(), CHAIN))
        at = m.end()
    places.append((at, end, CHAIN))
    return places if len(places) > 1 and min(b - a for a, b, _ in places) >= 2 else [(start, end, WORD)]


def places(line: str | None) -> list[tuple[int, int, int]]:
    """(start, end, kind) of a line's tokens, from left to right, without overlaps."""
    out: list[tuple[int, int, int]] = []
    done = 0
    for m in _TOKEN.finditer(line or ""):
        a, z = m.span()
        if a >= done:  # a strung letter's suffix was taken already
            out += _strung(line, a, z) if m.lastindex else _worded(line, a, z)
            done = out[-1][1]
    return out


def scanned(lines: list[str | None]) -> tuple[list[str], list[int], list[int], list[str], list[int], list[int]]:
    """Texts, starts, kinds and gaps of the tokens of lines, and where those and the gaps of each line begin."""
    texts, starts, kinds, gaps, sizes, gap_sizes = [], [], [], [], [0], [0]
    for line in lines:
        line, at = line or "", 0
        for m in _TOKEN.finditer(line):
            a, z = m.span()
            if a < at:  # a strung letter's suffix was taken already
                continue
            text = m[0]
            if text.isalpha() and "ー" not in text:  # a word without any mark: most are
                texts.append(text)
                starts.append(a)
                kinds.append(WORD)
                gaps.append(line[at:a])
                at = z
                continue
            for a, z, kind in _strung(line, a, z) if m.lastindex else _worded(line, a, z):
                texts.append(line[a:z])
                starts.append(a)
                kinds.append(kind)
                gaps.append(line[at:a])
                at = z
        gaps.append(line[at:])
        sizes.append(len(texts))
        gap_sizes.append(len(gaps))
    return texts, starts, kinds, gaps, sizes, gap_sizes


#: Fields of a scanned line.
SCAN_TYPE = "text:array<string>,start:array<int>,kind:array<int>,gap:array<string>"


def scan_arrays(texts: list[str], starts: list[int], kinds: list[int], gaps: list[str], sizes: list[int], gap_sizes: list[int]) -> list[pa.Array]:
    by = pa.array(sizes, pa.int32())
    return [pa.ListArray.from_arrays(by, pa.array(texts, pa.string())), pa.ListArray.from_arrays(by, pa.array(starts, pa.int32())), pa.ListArray.from_arrays(by, pa.array(kinds, pa.int32())), pa.ListArray.from_arrays(pa.array(gap_sizes, pa.int32()), pa.array(gaps, pa.string()))]


def _scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.StructArray.from_arrays(scan_arrays(*scanned(batch.to_pylist())), ["text", "start", "kind", "gap"])


def scan_column(line: Column | str) -> Column:
    """struct(text, start, kind, gap): arrays of a line's tokens, and of the texts before, between and after them."""
    return F.arrow_udf(_scan, f"struct<{SCAN_TYPE}>")(line)


def tokens_column(line: Column | str) -> Column:
    """Array of struct(text, start, kind, gap, gap_after, text_before, text_after) of a line's tokens."""
    return F.transform(
        F.array(scan_column(line)),
        lambda s: F.transform(
            F.arrays_zip(
                s["text"].alias("text"),
                s["start"].alias("start"),
                s["kind"].alias("kind"),
                F.slice(s["gap"], 1, F.size(s["text"])).alias("gap"),
                F.slice(s["gap"], 2, F.size(s["text"])).alias("gap_after"),
                F.slice(F.concat(F.array(F.lit("")), s["text"]), 1, F.size(s["text"])).alias("text_before"),
                F.slice(F.concat(s["text"], F.array(F.lit(""))), 2, F.size(s["text"])).alias("text_after"),
            ),
            lambda t: t,
        ),
    )[0]


#: Kana, Han and the marks of Japanese text that a letter may be glued to.
JAPANESE = "ぁ-ゖァ-ヺー一-鿿々"
_TOUCH = STRINGS + "^`´＾｀ﾟ゛゜"


def flags() -> dict[str, Column]:
    """What a token's text and gaps say of it, by name of the column."""
    text, gap, after, kind = F.col("text"), F.col("gap"), F.col("gap_after"), F.col("kind")
    one, strung = F.length(text) == 1, kind.isin(LETTER, SYMBOL)
    ends, begins = lambda p: gap.rlike(f"{p}$"), lambda p: after.rlike(f"^{p}")
    blank = lambda c: ~c.rlike(r"\S")
    return {
        "norm": normalize_word("text"),
        "script": script_of("text"),
        "notation": strung,
        "notation_word": kind == FIXED,
        "romaji_word": kind == ROMAJI,
        "symbol": kind == SYMBOL,
        "chain": kind == CHAIN,
        "glued": strung | ((kind == WORD) & one & (ends(f"[{_TOUCH}]") | begins(f"[{_TOUCH}]"))),
        "emoticon": (kind == WORD) & one & (ends("[:：;；].?") | begins(".?[:：;；]")),
        "after_digit": ends("[0-9０-９]"),
        "before_digit": begins("[0-9０-９]"),
        "label": (kind == WORD) & text.rlike("^[A-Z]$") & begins(r"\s*[:：]"),
        "diacritic": (kind == WORD) & text.rlike(r"[^\x00-\x7F]"),
        "before": F.when(blank(gap), F.right("text_before", F.lit(1))).otherwise(F.regexp_extract(gap, r"(\S)\s*$", 1)),
        "before_spaced": ends(r"\s") & ((F.col("text_before") != "") | ~blank(gap)),
        "after": F.when(blank(after), F.left("text_after", F.lit(1))).otherwise(F.regexp_extract(after, r"^\s*(\S)", 1)),
        "after_spaced": begins(r"\s") & ((F.col("text_after") != "") | ~blank(after)),
        "japanese_left": ends(f"[{JAPANESE}]"),
        "japanese_right": begins(f"[{JAPANESE}]"),
        "after_mask": ends("[*＊]{2}"),
        "censored": text.rlike(r"(?i)^([bcdfghjklmnpqrstvwxyz])\1{1,2}$") & (begins(r"[”’\"')）」』\]]?[ぁ-ゖ]") | ends(r"\*\*") | begins(r"\*\*")),
    }


def spread_tokens(rows: DataFrame, tokens: str) -> DataFrame:
    """rows with a row (tok_no, t) for each token. An outer generator, because Spark puts a filter on the array below an inner one,
    which would scan every line twice."""
    kept = [c for c in rows.columns if c != tokens]
    return rows.select(*kept, F.posexplode_outer(tokens).alias("tok_no", "t")).where("tok_no IS NOT NULL")


def tokenize(lines: DataFrame, with_line: bool = False) -> DataFrame:
    """(doc_id, line_no, tok_no, text, start, end, kind, flags...) of (doc_id, line_no, line), with_line also other_word:
    whether the line has another word of two letters and more. No exchange of any text."""
    scanned = lines.select("doc_id", "line_no", tokens_column("line").alias("ts"))
    if with_line:  # before the array is spread: else every token would carry it
        scanned = scanned.withColumn("_many", F.size(F.filter("ts", lambda t: F.length(t["text"]) >= 2)))
    many = ["_many"] if with_line else []
    rows = spread_tokens(scanned, "ts").select("doc_id", "line_no", *many, "tok_no", "t.*")
    columns = ["doc_id", "line_no", "tok_no", "text", "start", (F.col("start") + F.length("text")).alias("end"), "kind", *[c.alias(n) for n, c in flags().items()]]
    return rows.select(*columns, *([(F.col("_many") - F.when(F.length("text") >= 2, 1).otherwise(0) > 0).alias("other_word")] if with_line else []))


class Tokenize:
    """The scanner as a table function of SQL: SELECT * FROM tokenize('a line')."""

    def eval(self, line: str):
        for n, (a, z, kind) in enumerate(places(line)):
            yield n, line[a:z], a, z, kind


def register(spark) -> None:
    spark.udtf.register("tokenize", F.udtf(Tokenize, returnType="tok_no int, text string, start int, end int, kind int"))


__all__ = ["CYRILLIC", "GREEK", "flags", "places", "register", "scan_column", "tokenize", "tokens_column"]
