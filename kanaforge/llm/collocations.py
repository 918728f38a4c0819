"""Phrase collocation mining by sorted suffixes (suffix-sigma).

Every word begins a suffix, cut to the longest phrase and to its piece of the text. Suffixes are shuffled in the order of
language and words, sorted in reverse, and one pass with a stack counts all of their prefixes, which are all phrases. The
parts of a phrase are joined afterwards.

Words travel as 64-bit codes (XXH64 with the language's hash as seed); a first pass counts the words, keeps the text of
frequent ones and proves that no two words share a code, or takes another seed. A task sorts about a million suffixes, adds
equal ones up, and sends each range of them as one compressed block, so a passage that is copied everywhere is one entry of a block. The
ranges are cut at quantiles of a bounded sample of distinct suffixes: a first word of a third of all rows is spread over as many tasks as
it fills. A prefix that may go on in the next range is counted in parts that are added up; all others below the least count are dropped at
once, which loses nothing, since no part of a phrase is rarer than the phrase. The sample only places the cuts.

Defined cases: a null text has no words, a null language is `und`; empty pieces and texts have no phrases; words are bytes between
blanks, of any length; repeated rows count each; ties of a score go to the more frequent phrase, then by bytes; an empty table gives an
empty one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kanaforge.llm.common import drop, materialize, utf8_values

#: Words of the longest phrase; least count of a candidate; share of its count at which a longer phrase replaces it, in hundredths.
LONGEST, LEAST, COVERED = 4, 30, 80
#: Phrases of a language that are returned.
TOP = 2000
#: Suffixes that a task sorts at once, and that a range holds, about.
SORTED, RANGE_ROWS = 1_000_000, 1_200_000
#: Distinct suffixes of the sample, in all and of a task at most; one place of STRIDE is looked at.
SAMPLE, TASK_SAMPLE, STRIDE = 100_000, 4_000, 61
#: Ranges at most, beyond which they hold more rows: bounds what is broadcast.
MAX_RANGES = 100_000
#: Bytes of a text that are split into words at once, words whose codes a worker remembers, words that it counts before it emits them.
CHUNK, REMEMBERED, COUNTED = 4 << 20, 400_000, 200_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else 46 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
_BLANK = re.compile(rb"[ \t.]")
_U64 = np.uint64


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in runs of bounded size; `.` stands between pieces."""
    text = text.translate(_LOWER)
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > CHUNK:
            cut = _BLANK.search(text, at + CHUNK)
            end = cut.start() if cut else end
        yield text[at:end].replace(b".", b" . ").split()
        at = end
    yield [b"."]


class Codes(dict):
    """Word -> code under one language and seed; 0 between pieces. Forgets when full."""

    def __init__(self, lang: str, seed: int, code_of: Callable[[bytes, int], int]):
        super().__init__({b".": 0})
        self.seed, self.code_of = code_of(lang.encode(), seed), code_of

    def __missing__(self, word: bytes) -> int:
        code = self.code_of(word, self.seed) or 1
        if len(word) <= 64:
            self[word] = code
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
            self[b"."] = 0
        return np.fromiter(map(self.__getitem__, words), _U64, len(words))


def suffixes(codes: np.ndarray, longest: int) -> np.ndarray:
    """longest x places: the suffix at each word, 0 behind its piece. The last longest - 1 places have no successors here."""
    n = len(codes) - longest + 1
    rows = np.empty((longest, max(n, 0)), _U64)
    if n <= 0:
        return rows
    rows[0] = codes[:n]
    for k in range(1, longest):
        rows[k] = np.where(rows[k - 1] == 0, 0, codes[k : k + n])
    return rows[:, rows[0] != 0]


def _key(rows: np.ndarray) -> np.ndarray:
    """Suffixes as bytes in the order of their codes."""
    return np.ascontiguousarray(rows.T.astype(">u8")).view(f"S{8 * len(rows)}").ravel()


def sorted_suffixes(codes: np.ndarray, longest: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(suffixes, counts) of a stream of codes in slices of `most` places: distinct, in reverse order.

    In a slice a code is as many as 21 bits, its rank among the slice's codes, so that three words are one sort key."""
    codes = np.concatenate([codes, np.zeros(longest, _U64)])
    for at in range(0, len(codes) - longest, most):
        known, ranks = np.unique(np.concatenate([codes[at : at + most + longest - 1], np.zeros(1, _U64)]), return_inverse=True)
        ids = suffixes(ranks[:-1].astype(_U64), longest)
        if not ids.shape[1]:
            continue
        keys = []
        for k in range(0, longest, 3):
            key = np.zeros(ids.shape[1], _U64)
            for column in ids[k : k + 3]:
                key = key << _U64(21) | column
            keys.append(key)
        order = np.lexsort(keys[::-1])
        changed = np.zeros(len(order), bool)
        changed[0] = True
        for key in keys:
            ordered = key[order]
            changed[1:] |= ordered[1:] != ordered[:-1]
        first = np.flatnonzero(changed)
        counts = np.diff(np.append(first, len(order)))
        yield known[ids[:, order[first[::-1]]].astype(np.int64)], counts[::-1]


def added_up(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct suffixes in reverse order, and the sum of the counts of each; rows are sorted runs, one behind another."""
    if not rows.shape[1]:
        return rows, counts
    order = np.argsort(_key(rows), kind="stable")[::-1]  # merges runs
    rows, counts = rows[:, order], counts[order]
    changed = np.append(True, (rows[:, 1:] != rows[:, :-1]).any(0))
    first = np.flatnonzero(changed)
    return rows[:, first], np.add.reduceat(counts, first)


def prefix_counts(rows: np.ndarray, counts: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, prefixes, counts, open) of all prefixes with at least that count, or that may go on beyond these rows.

    rows are in reverse order. A prefix stands on the stack from its first row to its last, so the stack at depth k changes where
    one of the first k words does; those changes are found for all rows at once."""
    n = rows.shape[1]
    changed = np.zeros(n, bool)
    changed[:1] = True
    sums = np.concatenate([[0], np.cumsum(counts)])
    for k in range(len(rows)):
        changed[1:] |= rows[k, 1:] != rows[k, :-1]
        begins = np.flatnonzero(changed)
        ends = np.append(begins[1:], n)
        whole = rows[k, begins] != 0
        begins, ends = begins[whole], ends[whole]
        total = sums[ends] - sums[begins]
        opened = (begins == 0) | (ends == n)
        keep = (total >= least) | opened
        yield k + 1, rows[: k + 1, begins[keep]], total[keep], opened[keep]


_CODEC = pa.Codec("zstd", 3)


def packed(rows: np.ndarray, counts: np.ndarray) -> bytes:
    n = rows.shape[1]
    wide = np.uint8 if int(counts.max(initial=0)) < 256 else np.int64
    raw = b"".join([np.ascontiguousarray(rows).tobytes(), counts.astype(wide).tobytes()])
    return n.to_bytes(8, "little") + np.dtype(wide).itemsize.to_bytes(1, "little") + _CODEC.compress(raw, asbytes=True)


def unpacked(block: bytes, longest: int) -> tuple[np.ndarray, np.ndarray]:
    n, size = int.from_bytes(block[:8], "little"), block[8]
    raw = _CODEC.decompress(block[9:], n * (8 * longest + size), asbytes=True)
    rows = np.frombuffer(raw, _U64, n * longest).reshape(longest, n)
    return rows, np.frombuffer(raw, np.uint8 if size == 1 else np.int64, n, 8 * longest * n).astype(np.int64)


def _texts(part: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    langs = part.column(1)
    for at, text in enumerate(utf8_values(part.column(0))):
        if text:
            yield langs[at].as_py(), text


def word_counts(docs: DataFrame, seed: int, longest: int, code_of: Callable[[bytes, int], int]) -> DataFrame:
    """(code, lang, word, n) of each task's words, and its sample of suffixes: (code: priority, lang null, word: the suffix's bytes)."""

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        coders: dict[str, Codes] = {}
        sample = np.zeros(0, f"S{8 * longest}"), np.zeros(0, _U64)

        def emit() -> Iterator[pa.RecordBatch]:
            for lang, counter in seen.items():
                counter.pop(b".", None)
                code = Codes(lang, seed, code_of)
                words = list(counter)
                for at in range(0, len(words), 50_000):
                    some = words[at : at + 50_000]
                    codes = code.of(some).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array([lang] * len(some), pa.string()), pa.array(some, pa.binary()), pa.array([counter[w] for w in some], pa.int64())], ["code", "lang", "word", "n"])
            seen.clear()

        for part in parts:
            for lang, text in _texts(part):
                counter = seen.setdefault(lang, Counter())
                code = coders.get(lang) or coders.setdefault(lang, Codes(lang, seed, code_of))
                for words in words_of(text):
                    counter.update(words)
                    at = xxhash.xxh64_intdigest(text[:64]) % STRIDE
                    picked = [w for i in range(at, len(words), STRIDE) for w in (*words[i : i + longest], b".")]
                    rows = suffixes(np.append(code.of(picked), np.zeros(longest, _U64)), longest)
                    if rows.shape[1]:
                        priority = np.array([xxhash.xxh64_intdigest(k) for k in np.ascontiguousarray(rows.T).view(f"V{8 * longest}").ravel()], _U64)
                        keys, priorities = np.concatenate([sample[0], _key(rows)]), np.concatenate([sample[1], priority])
                        if len(keys) > 2 * TASK_SAMPLE:
                            _, first = np.unique(priorities, return_index=True)
                            keys, priorities = keys[first[:TASK_SAMPLE]], priorities[first[:TASK_SAMPLE]]
                        sample = keys, priorities
                if len(coders) > 64:
                    coders.clear()
            if sum(map(len, seen.values())) > COUNTED:
                yield from emit()
        yield from emit()
        _, first = np.unique(sample[1], return_index=True)
        keys = [bytes(k).ljust(8 * longest, b"\0") for k in sample[0][first[:TASK_SAMPLE]]]
        yield pa.RecordBatch.from_arrays([pa.array(sample[1][first[:TASK_SAMPLE]].view(np.int64)), pa.nulls(len(keys), pa.string()), pa.array(keys, pa.binary()), pa.array([0] * len(keys), pa.int64())], ["code", "lang", "word", "n"])

    return docs.mapInArrow(scan, "code long, lang string, word binary, n long")


def blocks_of(docs: DataFrame, seed: int, longest: int, cuts: np.ndarray, code_of: Callable[[bytes, int], int], most: int) -> DataFrame:
    """(part, lang, block): each task's suffixes, sorted and added up, cut into ranges."""
    sent = docs.sparkSession.sparkContext.broadcast(cuts)

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders: dict[str, Codes] = {}
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def emit() -> Iterator[pa.RecordBatch]:
            for lang, runs in held.items():
                for rows, counts in sorted_suffixes(np.concatenate(runs), longest, most):
                    where = np.searchsorted(sent.value, _key(rows), side="right").astype(np.int32)
                    begins = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
                    data = [packed(rows[:, b:e], counts[b:e]) for b, e in zip(begins, np.append(begins[1:], len(where)), strict=True)]
                    for at in range(0, len(data), 1000):
                        some = data[at : at + 1000]
                        yield pa.RecordBatch.from_arrays([pa.array(where[begins[at : at + 1000]]), pa.array([lang] * len(some), pa.string()), pa.array(some, pa.binary())], ["part", "lang", "block"])
            held.clear()

        for part in parts:
            for lang, text in _texts(part):
                code = coders.get(lang) or coders.setdefault(lang, Codes(lang, seed, code_of))
                for words in words_of(text):
                    codes = code.of(words)
                    held.setdefault(lang, []).append(codes)
                    size += len(codes)
                if len(coders) > 64:
                    coders.clear()
                if size > most:
                    yield from emit()
                    size = 0
        yield from emit()

    return docs.mapInArrow(scan, "part int, lang string, block binary")


def frequent_prefixes(blocks: DataFrame, ranges: int, longest: int, least: int, most: int) -> DataFrame:
    """(lang, c1.., f, opened) of all phrases with at least the least count, and of those that may go on in another range (opened).

    Codes behind a phrase's end are null."""
    names = [f"c{k + 1}" for k in range(longest)]

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, counts, waiting = None, [], [], 0

        def compact() -> None:
            nonlocal rows, counts, waiting
            r, c = added_up(np.concatenate(rows, 1), np.concatenate(counts))
            rows, counts, waiting = [r], [c], 0

        def emit() -> Iterator[pa.RecordBatch]:
            if now is None:
                return
            compact()
            for k, prefixes, total, opened in prefix_counts(rows[0], counts[0], least):
                n = len(total)
                codes = [pa.array(prefixes[i].view(np.int64)) if i < k else pa.nulls(n, pa.int64()) for i in range(longest)]
                yield pa.RecordBatch.from_arrays([pa.array([now[1]] * n, pa.string()), *codes, pa.array(total), pa.array(opened)], ["lang", *names, "f", "opened"])

        for part in parts:
            for i in range(part.num_rows):
                key = part.column(0)[i].as_py(), part.column(1)[i].as_py()
                if key != now:
                    yield from emit()
                    now, rows, counts, waiting = key, [], [], 0
                r, c = unpacked(part.column(2)[i].as_py(), longest)
                rows.append(r)
                counts.append(c)
                waiting += len(c)
                if waiting > max(most, rows[0].shape[1]):
                    compact()
        yield from emit()

    ranged = blocks.repartitionById(ranges, F.col("part")).sortWithinPartitions("part", "lang")
    return ranged.mapInArrow(count, "lang string, " + ", ".join(f"{c} long" for c in names) + ", f long, opened boolean")


def count_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, code_of: Callable[[bytes, int], int] = xxhash.xxh64_intdigest, most: int = SORTED) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """(phrases, words, totals, scratch paths) of docs (text, lang).

    code_of: (word, seed) -> code of at most 64 bits; most: suffixes that a task sorts at once.
    phrases: (lang, c1.., f) from `least` occurrences on; words: (code, word) of the frequent ones; totals: (lang, n)."""
    spark = docs.sparkSession
    docs = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    seed = 0
    while True:
        counted, counted_path = materialize(word_counts(docs, seed, longest, code_of))
        seen = counted.where(F.col("lang").isNotNull())
        texts = seen.groupBy("code").agg(F.min("lang").alias("lang"), F.max("lang").alias("_lang"), F.min("word").alias("word"), F.max("word").alias("_word"), F.sum("n").alias("n"))
        clash = (F.col("word") != F.col("_word")) | (F.col("lang") != F.col("_lang"))
        words, words_path = materialize(texts.where((F.col("n") >= least) | clash).select("code", "word", clash.alias("clash")))
        if words.where("clash").isEmpty():
            break
        drop(spark, counted_path)
        drop(spark, words_path)
        seed += 1
    totals, totals_path = materialize(seen.groupBy("lang").agg(F.sum("n").alias("n")))
    places = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = min(MAX_RANGES, max(1, -(-places // RANGE_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    sample = counted.where(F.col("lang").isNull()).select("code", F.col("word").alias("key")).distinct().orderBy("code", "key").limit(SAMPLE).select("key").toArrow()
    keys = np.sort(np.array(sample["key"].to_pylist(), f"S{8 * longest}"))
    cuts = np.unique(keys[(np.arange(1, ranges) * len(keys)) // ranges]) if len(keys) else keys
    drop(spark, counted_path)

    names = [f"c{k + 1}" for k in range(longest)]
    counted, path = materialize(frequent_prefixes(blocks_of(docs, seed, longest, cuts, code_of, most), len(cuts) + 1, longest, least, most))
    whole = counted.where(~F.col("opened")).select("lang", *names, "f")
    parts = counted.where("opened").groupBy("lang", *names).agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    phrases, phrases_path = materialize(whole.unionByName(parts))
    drop(spark, path)
    return phrases, words.select("code", "word"), totals, [words_path, totals_path, phrases_path]


def _part(first: int, last: int, longest: int) -> list:
    """Columns c1.. of the words first to last (from 1), null behind."""
    return [(F.col(f"c{first + k}") if first + k <= last else F.lit(None).cast("long")).alias(f"c{k + 1}") for k in range(longest)]


def collocations(docs: DataFrame, top: int = TOP, longest: int = LONGEST, least: int = LEAST, covered: int = COVERED, **counting) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best `top` phrases of each language of docs (text, lang).

    A phrase of 2 to longest words with a occurrences, cut after its first words into parts with l and r, scores
    floor(2000000 * a / (l + r)) at its worst cut; phrases inside a longer one with at least covered hundredths of their
    occurrences are left out. All sums and products are decimals. counting: as in count_phrases()."""
    spark = docs.sparkSession
    phrases, words, totals, scratch = count_phrases(docs, longest, least, **counting)
    names = [f"c{k + 1}" for k in range(longest)]
    size = sum(F.col(c).isNotNull().cast("int") for c in names)
    sized = phrases.withColumn("words", size)

    # The parts of each cut, and every phrase inside a longer one, as keys of the phrase table.
    cuts, inner = None, None
    for n in range(2, longest + 1):
        own = sized.where(F.col("words") == n)
        for k in range(1, n):
            row = own.select("lang", *names, "f", F.lit(k).alias("k"), F.struct(*_part(1, k, longest)).alias("left"), F.struct(*_part(k + 1, n, longest)).alias("right"))
            cuts = row if cuts is None else cuts.unionByName(row)
        for m in range(2, n):
            for at in range(1, n - m + 2):
                row = own.select("lang", *_part(at, at + m - 1, longest), F.col("f").alias("longer"))
                inner = row if inner is None else inner.unionByName(row)

    keyed = phrases.select("lang", F.struct(*names).alias("_part"), F.col("f").alias("_f"))
    cuts, cuts_path = materialize(cuts)
    left = cuts.join(keyed.select("lang", F.col("_part").alias("left"), F.col("_f").alias("l")), ["lang", "left"])
    both = left.join(keyed.select("lang", F.col("_part").alias("right"), F.col("_f").alias("r")), ["lang", "right"])
    score = F.expr("CAST((CAST(2000000 AS DECIMAL(7,0)) * CAST(f AS DECIMAL(19,0))) div (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0))) AS BIGINT)")
    scored = both.withColumn("score", score).groupBy("lang", *names).agg(F.first("f").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored, scored_path = materialize(scored)
    if inner is not None:
        most = inner.groupBy("lang", *names).agg(F.max("longer").alias("longer"))
        most = most.select("lang", F.struct(*names).alias("_key"), "longer")
        scored = scored.withColumn("_key", F.struct(*names)).join(most, ["lang", "_key"], "left")
        scored = scored.where(F.col("longer").isNull() | (F.lit(100).cast("decimal(3,0)") * F.col("longer").cast("decimal(19,0)") < F.lit(covered).cast("decimal(3,0)") * F.col("a").cast("decimal(19,0)")))
    # All that can be among the first by score and count; only these need their words.
    ranked = scored.withColumn("_rank", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a")))).where(F.col("_rank") <= top)
    ranked, ranked_path = materialize(ranked.select("lang", *names, "a", "cut"))
    for c in names:
        ranked = ranked.join(words.select(F.col("code").alias(c), F.col("word").alias(f"_{c}")), c, "left")
    text = F.concat_ws(" ", *[F.decode(f"_{c}", "UTF-8") for c in names])
    named = ranked.select("lang", text.alias("phrase"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = named.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    result, _ = materialize(best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    for path in (*scratch, cuts_path, scored_path, ranked_path):
        drop(spark, path)
    return result
