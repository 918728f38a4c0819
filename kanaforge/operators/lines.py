"""Lines and their gates: splitting, words, credits, ASCII art, line features, blocks of a document.

A line's features are worked out inside its row, over the array of its tokens, so they need no exchange."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kanaforge.functions.kana import UNIT_SYMBOLS, romaji_column
from kanaforge.functions.text import LATIN, WESTERN, normalize_word, script_of, wide
from kanaforge.functions.tokens import LETTER, SYMBOL, scan_column


@dataclass(frozen=True)
class Credits:
    """What production credits look like. roles stand at a line's start, as written; deeds are told with by or at."""

    roles: tuple[str, ...] = (
        "Lyrics?", "Lyricist", "Words?", "Music", "Song", "Compos(?:er|ed|ition)", "Arrange(?:r|d|ment)", "Produce[rd]", "Production", "Vocals?", "Singer", "Performer", "Guitars?", "Bass", "Drums?", "Keys",
        "Piano", "Strings?", "Violin", "Choir", "Programming", "Recording", "Mix(?:ed|ing)?", "Master(?:ed|ing)?", "Engineer(?:ed)?", "Artwork", "Illustrat(?:or|ed|ion)", "Video", "Translat(?:or|ed|ion)", "Label",
        "作词", "作詞", "词", "作曲", "曲", "编曲", "編曲", "制作人?", "製作", "监制", "演唱", "歌手?", "唄", "和声", "吉他", "贝斯", "鼓", "钢琴", "弦乐", "录音", "録音", "混音", "母带(?:处理)?", "工程师", "出品", "发行", "翻译", "訳詞", "絵", "映像", "動画",
    )
    notices: tuple[str, ...] = ("©", "℗", r"\([cCpP]\)", "[Cc]opyright", "COPYRIGHT", "[Aa]ll [Rr]ights [Rr]eserved", "(?:ISRC|UPC|EAN|JASRAC)(?:[^A-Za-z]|$)", "(?:[Ll]icensed|[Pp]ublished|[Dd]istributed|[Pp]resented) by ")
    deeds: tuple[str, ...] = ("[Rr]ecorded", "[Mm]ixed", "[Mm]astered", "[Pp]roduced", "[Pp]erformed", "[Aa]rranged", "[Cc]onducted", "[Ee]ngineered")

    def patterns(self) -> list[str]:
        """Patterns that Java and RE2 read alike; one that fits makes a line a credit."""
        role = f"(?:{'|'.join(self.roles)})"
        more = rf"(?:\s*[&/,、・＆／]\s*{role}){{0,4}}"
        names = r"(?:\s+[A-Z][\w.'&]*){0,3}"
        deed = f"(?:{'|'.join(self.deeds)})"
        return [
            rf"^\s*{role}{more}{names}\s*(?:[:：]|[-–—]\s|by\s)",
            rf"^\s*(?:{'|'.join(self.notices)})",
            rf"^\s*(?:[A-Za-z]+\s+){{0,2}}{deed}(?:\s*(?:&|,|and)\s*{deed}){{0,3}}\s(?:[^\n]{{0,80}}\s)?(?:by|at)\s",
        ]


CREDITS = Credits()
#: A line of single letters is art from so many other marks on.
ART_MARKS = 6
#: Distinct short words whose romanised reading is not the lexicon's, and the share of short words, of a romaji line.
ROMAJI_KINDS, ROMAJI_SHARE = 5, 0.6
#: A word: western letters with inner apostrophes. Possessive, for else Java's engine recurses once for each part.
WORD = rf"[{WESTERN}]++(?:['’][{WESTERN}]++)*+"
#: Pairs of letters that romanised Japanese does not have.
NOT_ROMAJI = "th|wh|ck|gh|ph|[qx]"


def split_lines(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, line_no, line, kept columns): a document's lines, empty ones too; a null text has none."""
    return docs.select("doc_id", *keep, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def plain_words(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, word_no, word, norm, script): runs of western letters with inner apostrophes."""
    found = F.regexp_extract_all("line", F.lit(WORD), F.lit(0))
    words = lines.select("doc_id", "line_no", F.posexplode(found).alias("word_no", "word"))
    return words.select("*", normalize_word("word").alias("norm"), script_of("word").alias("script"))


def is_credit_line(line: Column, rules: Credits = CREDITS) -> Column:
    """A role with a colon, `by` or a dash after it, a notice of rights, or a deed by or at someone."""
    first, *more = [line.rlike(p) for p in rules.patterns()]
    for x in more:
        first = first | x
    return F.coalesce(first, F.lit(False))


def credit_blocks(lines: DataFrame, rules: Credits = CREDITS) -> DataFrame:
    """lines with skipped: credit lines, and lines between two of them."""
    by_doc = Window.partitionBy("doc_id").orderBy("line_no")
    marked = lines.withColumn("credit", is_credit_line(F.col("line"), rules))
    between = F.coalesce(F.lag("credit").over(by_doc), F.lit(False)) & F.coalesce(F.lead("credit").over(by_doc), F.lit(False))
    return marked.withColumn("skipped", F.col("credit") | between)


def art_marks(line: Column) -> Column:
    """How many marks of a line are no letters, digits, kana, Han or Japanese punctuation."""
    return F.length(F.regexp_replace(line, rf"[{WESTERN}0-9０-９\s぀-ヿ一-鿿　-〿！-／]", ""))


def with_tokens(lines: DataFrame) -> DataFrame:
    """lines with s: the arrays of the scanner."""
    return lines.withColumn("s", scan_column("line"))


def line_features(scanned: DataFrame) -> DataFrame:
    """scanned (line, s) with counts of its tokens and the flags made of them, row by row."""
    texts, kinds = F.col("s.text"), F.col("s.kind")
    count = lambda xs, p: F.size(F.filter(xs, p))
    strung = count(kinds, lambda k: (k == LETTER) | (k == SYMBOL))
    single = lambda t: F.length(t) == 1
    capital = lambda t: t.rlike("^[A-Z]$")
    norms = F.col("_norms")
    short = F.filter(norms, lambda t: F.length(t) <= 3)
    rows = scanned.withColumn("_norms", F.transform(texts, normalize_word)).select(
        "*",
        F.size(texts).alias("words"),
        count(texts, single).alias("singles"),
        count(texts, capital).alias("capitals"),
        strung.alias("strung"),
        count(texts, lambda t: F.length(t) >= 2).alias("long_words"),
        F.size(short).alias("short_words"),
        F.array_distinct(short).alias("short_kinds"),
        count(norms, lambda t: t.rlike(NOT_ROMAJI)).alias("english_pairs"),
        F.array_distinct(F.filter(texts, capital)).alias("capital_kinds"),
    ).drop("_norms")
    return line_flags(rows).withColumn("all_units", (F.size("capital_kinds") >= 2) & (F.col("capitals") == F.col("singles")) & F.forall("capital_kinds", lambda c: c.isin(list(UNIT_SYMBOLS))))


def line_flags(rows: DataFrame) -> DataFrame:
    """Counted lines with the flags made of the counts."""
    art = (F.col("words") > 0) & (F.col("singles") == F.col("words")) & (F.col("strung") == 0) & (art_marks(F.col("line")) >= ART_MARKS)
    run = (F.col("strung") >= 2) | (F.col("capitals") >= 3) | F.col("line").rlike(r"(?:^|[^A-Za-z])[A-Z]\s?[,，、/・&]\s?[A-Z](?:[^A-Za-z]|$)")
    return rows.select(
        "*",
        F.coalesce(art, F.lit(False)).alias("is_art"),
        F.coalesce(run, F.lit(False)).alias("letter_run"),
        F.coalesce(wide("line") & F.col("line").rlike("[ぁ-ゖァ-ヺ]"), F.lit(False)).alias("has_kana"),
    )


#: Features that romaji_lines() needs.
ROMAJI_FEATURES = ("words", "short_words", "english_pairs", "short_kinds")


def romaji_lines(featured: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, line_no, romaji_line): lines of many short words whose romanised reading differs from the lexicon's.

    Only lines of short words without English letter pairs are looked at, and their distinct words are looked up."""
    shaped = featured.where((F.col("english_pairs") == 0) & (F.col("short_words") >= ROMAJI_SHARE * F.col("words")) & (F.size("short_kinds") >= ROMAJI_KINDS))
    words = shaped.select("doc_id", "line_no", F.explode("short_kinds").alias("word"))
    known = lexicon.where("length(word) <= 3").select("word", "kana").withColumn("romaji", romaji_column("word"))
    two_way = known.where("romaji IS NOT NULL AND romaji <> kana").select("word")
    return words.join(two_way, "word", "left_semi").groupBy("doc_id", "line_no").agg((F.count("*") >= ROMAJI_KINDS).alias("romaji_line")).where("romaji_line")


def placed_words(lines: DataFrame, word: str = rf"[{LATIN}]+") -> DataFrame:
    """Words with the place of each in its line (0-based code points): running sums over words and what is between."""
    pairs = F.arrays_zip(F.split("line", word).alias("gap"), F.regexp_extract_all("line", F.lit(word), F.lit(0)).alias("word"))
    rows = lines.select("doc_id", "line_no", F.posexplode(pairs).alias("word_no", "x")).select("doc_id", "line_no", "word_no", "x.gap", "x.word").where("word IS NOT NULL")
    so_far = Window.partitionBy("doc_id", "line_no").orderBy("word_no").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.length("gap") + F.length("word")).over(so_far) - F.length("word")
    return rows.select("doc_id", "line_no", "word_no", "word", start.cast("int").alias("start"))


def echoes(norms: Column) -> Column:
    """The fragments of 2 or 3 letters that occur twice and more in a line and end a longer word of it.

    Fragments are sorted, so that repeated ones are neighbours, and met with the ends of the longer words: linear in the line, but for the sort."""
    short = F.array_sort(F.filter(norms, lambda t: F.length(t).between(2, 3)))
    twice = F.transform(F.array(short), lambda s: F.filter(s, lambda x, i: x == F.get(s, i + 1)))[0]  # a variable: else sorted again for each
    fits = F.array_union(*[F.transform(F.filter(norms, lambda t: F.length(t) > F.lit(n)), lambda t: F.right(t, F.lit(n))) for n in (2, 3)])
    return F.array_intersect(twice, fits)


def echo_fragments(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, norm): the echoes of each line."""
    found = F.regexp_extract_all("line", F.lit(WORD), F.lit(0))
    return lines.select("doc_id", "line_no", F.transform(found, normalize_word).alias("w")).select("doc_id", "line_no", F.explode(echoes(F.col("w"))).alias("norm"))


#: Syllables in capitals of one or two consonants and a vowel, chained by tight hyphens, also over a line break.
CHAINED = r"\b[B-DF-HJ-NP-TV-Z]{1,2}[AEIOU](?:-\n?[B-DF-HJ-NP-TV-Z]{1,2}[AEIOU]\b)++"


def long_vowels(text: Column, pattern: str = CHAINED) -> Column:
    """Array of the syllables of such chains in a text."""
    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda chain: F.split(chain, "-\n?"))))


def long_vowel_words(docs: DataFrame, pattern: str = CHAINED) -> DataFrame:
    """(doc_id, word): the syllables of such chains; their readings are drawn out everywhere in the document."""
    return docs.select("doc_id", F.explode(long_vowels(F.col("text"), pattern)).alias("word")).distinct()


def japanese_documents(lines: DataFrame) -> DataFrame:
    """(doc_id, japanese): any line with kana; a document without words in any line passes."""
    return lines.groupBy("doc_id").agg((F.max(F.col("line").rlike("[ぁ-ゖァ-ヺ]")) | ~F.max(F.col("line").rlike(r"\S"))).alias("japanese"))


def primary_layer(blocks: DataFrame) -> DataFrame:
    """The block of each item to annotate: the first, or the first with kana where the first has none."""
    order = Window.partitionBy("item").orderBy(F.col("line").rlike("[ぁ-ゖァ-ヺ]").desc(), "ord")
    return blocks.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def scope_filter(blocks: DataFrame, kinds: list[str]) -> DataFrame:
    """Blocks of the given kinds; an empty choice keeps all."""
    return blocks.where(F.col("kind").isin(kinds)) if kinds else blocks


def skip_report(features: DataFrame) -> DataFrame:
    """(reason, lines): why lines got no annotation."""
    reason = F.when(is_credit_line(F.col("line")), "credit").when(F.col("is_art"), "art").when(F.col("words") == 0, "no_words").otherwise("annotated")
    return features.groupBy(reason.alias("reason")).agg(F.count("*").alias("lines"))
