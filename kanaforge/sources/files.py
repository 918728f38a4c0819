"""Readers and writers: loan lists, titles, frequency lists, bundles, snapshots, page text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kanaforge.functions.text import KANA, hira_to_kata

#: Subtrees of a page that hold no text to read.
SKIPPED = "script|style|noscript|template|textarea|ruby|rt|rp|code|pre|svg"


def parse_loans(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(loans, errors) of lines (lang, line): `word:kana`, the first colon splits; comments and blanks are skipped."""
    lines = rows.withColumn("line", F.trim("line")).where("line <> '' AND NOT line LIKE '#%'")
    split = lines.select("lang", "line", F.trim(F.substring_index("line", ":", 1)).alias("word"), F.trim(F.expr("substring(line, instr(line, ':') + 1)")).alias("kana"), F.contains("line", F.lit(":")).alias("_colon"))
    why = F.when(~F.col("_colon"), "no colon").when(F.col("word") == "", "empty word").when(~F.col("kana").rlike(f"^{KANA['lexicon']}$"), "not kana")
    marked = split.withColumn("why", why)
    good = marked.where("why IS NULL")
    twice = good.groupBy("lang", "word").count().where("count > 1").select("lang", "word")
    loans = good.join(twice, ["lang", "word"], "left_anti").select("lang", F.col("word").alias("key"), "kana")
    errors = marked.where("why IS NOT NULL").select("lang", "line", "why").unionByName(good.join(twice, ["lang", "word"], "left_semi").select("lang", "line", F.lit("duplicate").alias("why")))
    return loans, errors


def read_loans(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """parse_loans of a folder of text files; a file's stem is its language."""
    rows = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/.]+)\.[^/]*$", 1).alias("lang"), F.col("value").alias("line"))
    return parse_loans(rows)


def clean_titles(raw: DataFrame) -> DataFrame:
    """(title, pronunciation): readings as katakana without marks and spaces; rows without a title are dropped."""
    return raw.select("title", hira_to_kata(F.regexp_replace("pronunciation", r"[^ぁ-ゖァ-ヺー]", "")).alias("pronunciation")).where("title IS NOT NULL")


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """clean_titles of a JSON array of objects (title, pronunciation)."""
    return clean_titles(spark.read.schema("title string, pronunciation string").option("multiLine", True).json(path))


def frequency_words(ranked: DataFrame, top: int, least: int = 2, most: int = 14) -> DataFrame:
    """The first words by rank of (rank, word): plain letters of a length in between, no run of three alike."""
    word = F.lower(F.trim("word"))
    good = F.col("word").rlike("^[a-z]+$") & F.length("word").between(least, most) & ~F.col("word").rlike(r"(.)\1\1")
    return ranked.select("rank", word.alias("word")).where(good).orderBy("rank").limit(top)


def read_frequency_list(spark: SparkSession, path: str, top: int, least: int = 2, most: int = 14) -> DataFrame:
    """frequency_words of a text file: a word a line, the commonest first; what follows the word is not read."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("rank"), F.split(F.trim("value"), r"[\s,]+")[0].alias("word"))
    return frequency_words(lines.where("word <> '' AND NOT word LIKE '#%'"), top, least, most)


BUNDLE = "struct<version:int,learned:array<struct<word:string,kana:string>>,llm:array<struct<word:string,kana:string,lines:bigint,consistent:boolean>>,free:array<struct<word:string,kana:string>>>"


def write_bundle(learned: DataFrame, answers: DataFrame, free: DataFrame, parts: int = 64) -> DataFrame:
    """(part, bundle): the export as JSON texts, one for each part, so that no text holds everything.

    learned, free: (word, kana); answers: (word, kana, lines, consistent)."""
    part = F.pmod(F.crc32(F.encode("word", "UTF-8")), F.lit(parts)).cast("int")
    listed = lambda df, name, *fields: df.groupBy(part.alias("part")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    a, b, c = listed(learned, "learned", "word", "kana"), listed(answers, "llm", "word", "kana", "lines", "consistent"), listed(free, "free", "word", "kana")
    return a.join(b, "part", "full_outer").join(c, "part", "full_outer").select("part", F.to_json(F.struct(F.lit(1).alias("version"), "learned", "llm", "free")).alias("bundle"))


def bundle_fault(bundle: Column) -> Column:
    """Why a bundle text cannot be taken: broken (no JSON object, or of other types), version, or empty; null where it can."""
    strict = F.from_json(bundle, f"{BUNDLE[:-1]},_broken:string>", {"columnNameOfCorruptRecord": "_broken"})
    none = F.coalesce(F.size(strict["learned"]), F.lit(0)) + F.coalesce(F.size(strict["llm"]), F.lit(0)) + F.coalesce(F.size(strict["free"]), F.lit(0)) <= 0
    return F.when(bundle.isNull() | strict["_broken"].isNotNull(), "broken").when(F.coalesce(strict["version"] != 1, F.lit(True)), "version").when(none, "empty")


def bundle_errors(texts: DataFrame) -> DataFrame:
    """texts with why: the bundles that read_bundle() leaves out."""
    return texts.withColumn("why", bundle_fault(F.col("bundle"))).where("why IS NOT NULL")


def read_bundle(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(learned, answers, free) of bundle texts; bundle_errors() tells of those that are skipped."""
    parsed = texts.where(bundle_fault(F.col("bundle")).isNull()).select(F.from_json("bundle", BUNDLE).alias("b"))
    return tuple(parsed.select(F.explode(f"b.{name}").alias("x")).select("x.*") for name in ("learned", "llm", "free"))


def valid_snapshot(rows: DataFrame) -> DataFrame:
    """Rows of a learned store worth loading: lower-case keys and valid kana."""
    return rows.where(F.col("word").rlike("^[a-z]+$") & F.col("kana").rlike(f"^{KANA['learned']}$"))


def save_snapshot(rows: DataFrame, folder: str, version: int) -> str:
    path = f"{folder}/v{version:08d}"
    rows.write.mode("overwrite").parquet(path)
    return path


def load_snapshot(spark: SparkSession, folder: str) -> DataFrame | None:
    """The valid rows of the newest version that was written to its end; None where there is none."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath() for x in files.listStatus(where)] if files.exists(where) else []
    whole = [str(p) for p in found if re.fullmatch(r"v\d+", p.getName()) and files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return valid_snapshot(spark.read.parquet(max(whole, key=lambda p: int(p.rsplit("/v", 1)[1])))) if whole else None


#: Classes of layers that repeat a text in another form.
LAYERS = "romaji|romanized|romanization|translat(?:ion|ed)|transliteration|furigana|copy-mode"
_EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "em", "font", "i", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "u"}


class _Blocks(HTMLParser):
    """The visible texts of a page, one for each block; subtrees of skipped tags and classes are left out, however deep."""

    def __init__(self, tags: set[str], classes: re.Pattern):
        super().__init__(convert_charrefs=True)
        self.tags, self.classes = tags, classes
        self.out: list[str] = []
        self.text: list[str] = []
        self.open: list[str] = []
        self.skipping = 0  # how many of the open tags there were when a skipped one opened, plus one

    def end_block(self) -> None:
        if text := " ".join("".join(self.text).split()):
            self.out.append(text)
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag not in _INLINE:
            self.end_block()
        if tag in _EMPTY:
            return
        self.open.append(tag)
        named = next((v for k, v in attrs if k == "class"), None) or ""
        if not self.skipping and (tag in self.tags or any(map(self.classes.fullmatch, named.split()))):
            self.skipping = len(self.open)

    def handle_endtag(self, tag):
        if tag not in _INLINE:
            self.end_block()
        if tag in self.open:
            while self.open.pop() != tag:
                pass
            if len(self.open) < self.skipping:
                self.skipping = 0

    def handle_data(self, data):
        if not self.skipping:
            self.text.append(data)


def page_blocks(html: Column, skipped: str = SKIPPED, layers: str = LAYERS) -> Column:
    """Texts of a page by block, in order: no subtrees without text, no layers that repeat it; null for a null page."""

    @F.arrow_udf("array<string>")
    def blocks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tags, classes = set(skipped.split("|")), re.compile(f"(?:.*[-_])?(?:{layers})(?:[-_].*)?", re.I)
        for batch in batches:
            out = []
            for page in batch.to_pylist():
                if page is None:
                    out.append(None)
                    continue
                parser = _Blocks(tags, classes)
                parser.feed(page)
                parser.close()
                parser.end_block()
                out.append(parser.out)
            yield pa.array(out, pa.list_(pa.string()))

    return blocks(html)


def page_text(html: Column) -> Column:
    """A page's text without its tags: the simple form, in generated code, for pages without nested skipped tags."""
    bare = F.regexp_replace(html, "(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))
