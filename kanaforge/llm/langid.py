"""Language identification by interpolated Kneser-Ney character models, one for each language.

Word types are counted in each task and turned into padded character 4-grams, which are summed over all learning
documents by language; none is left out. Spark estimates the models: continuation counts, discounts from counts of
counts, context weights and interpolated probabilities are joins and aggregations over n-grams, order by order, each a
table in the shared folder. A row holds one n-gram of any language with its log-probability in each; an n-gram
that no language has falls back to its suffix with the weight of its context.

Scoring: while the tables fit into MOST_BYTES, which is checked before anything is collected, they are sent to the
executors as sorted arrays of 64-bit hashes, and a worker scores each word that it meets once. Beyond that, the distinct
words of the texts are scored by joins of their n-grams with the tables. Both ways give the same entropies.
The lowest length-normalised cross-entropy wins.

Rejection: a limit on the cross-entropy of each language (a high quantile over all its learning documents) gives the
column accepted; it never changes lang_pred.

Defined cases: null texts and texts without letters are `und` with score 0 and are not accepted; ties go to
the first language in order; rows with null lang are not learned from, so with no usable row all is `und`;
whole texts are read, a very long word in pieces; columns of any name pass through with their values, but for those
named like the outputs, which are replaced.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kanaforge.llm.common import id_bucket, packed, str_values, table

ORDER = 4
#: Quantile of the learning documents' cross-entropies that is the limit of a language.
QUANTILE = 0.995
HELD_MOD, HELD = 5, 0
#: Word types counted in a task before they are passed on.
FLUSH = 200_000
#: Words a worker remembers the scores of, and the longest that it remembers.
REMEMBERED, LONGEST = 300_000, 64
#: Characters scored at a time: a memory bound only.
PIECE = 1 << 17
#: Bytes of the sorted arrays up to which they are sent to the executors.
MOST_BYTES = 256 << 20
#: Bytes of an n-gram on its way to the arrays, by measure: its text in Arrow and as an object, its hash; each language's number in Arrow,
#: as an object's share, and in the array.
GRAM_BYTES = 110
#: Pieces of a text that are sent to all tasks where words are scored by joins; a piece has LONGEST characters at most.
FREQUENT = 20_000
#: Nats of cross-entropy that make the score fall by e.
TEMPERATURE = 0.1
OUTPUTS = ["lang_pred", "score", "accepted"]

_words = re.compile(r"[^\W\d_]+").findall
_BEFORE, _AFTER = "\x02" * (ORDER - 1), "\x03"


def words_of(text: str | None) -> list[str]:
    """Lower-case words; runs of numerals that are no digits, such as superscripts, are no words."""
    found = _words(text.lower()) if text else []
    return found if not text or text.isascii() else [w for w in found if w.isalpha() or any(map(str.isalpha, w))]


def grams_of(word: str) -> Iterator[str]:
    padded = _BEFORE + word + _AFTER
    return (padded[i : i + ORDER] for i in range(len(word) + 1))


def ngram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows (lang, text): 4-grams of padded words."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = defaultdict(Counter)

        def flush() -> Iterator[pa.RecordBatch]:
            for lang in list(words):
                got: Counter = Counter()
                for word, n in words.pop(lang).items():
                    for g in grams_of(word):
                        got[g] += n
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(got), pa.string()), pa.array(list(got), pa.string()), pa.array(list(got.values()), pa.int64())], ["lang", "gram", "n"])

        for part in parts:
            for lang, text in zip(part.column(0).to_pylist(), str_values(part.column(1)), strict=True):
                words[lang].update(words_of(text))
                if sum(map(len, words.values())) > FLUSH:
                    yield from flush()
        yield from flush()

    return docs.select("lang", "text").mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


# -- estimation --------------------------------------------------------------------------------------------


@dataclass
class Model:
    """langs: in order. grams: (size, gram, logs) of every n-gram; contexts: (size, gram, logs) of the weight of every
    context, both with a number for each language. unseen: log P of a character that no language has."""

    langs: list[str]
    grams: DataFrame | None = None
    contexts: DataFrame | None = None
    unseen: float = 0.0
    limits: dict[str, float] | None = None  # rejection limits, once calibrated


def _dense(rows: DataFrame, key: str, values: list[str], n: int, default: float) -> DataFrame:
    """(key, an array for each of values): rows (key, i, values) as one number for each language."""
    maps = rows.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct(*values)))).alias("m"))  # n entries at most
    places = F.array(*[F.lit(i) for i in range(n)])
    filled = lambda v: F.transform(places, lambda i: F.coalesce(F.try_element_at("m", i)[v].cast("double"), F.lit(default)))
    return maps.select(key, *[filled(v).alias(v) for v in values])


def kneser_ney(counts: DataFrame) -> Model:
    """The models of counts (lang, gram, n) with grams of ORDER characters."""
    counts = table(counts)
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not langs:
        return Model([])
    number = F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")) - 1
    levels = {ORDER: counts.select("gram", number.cast("int").alias("i"), "n")}
    for size in range(ORDER - 1, 0, -1):  # in how many contexts each suffix was seen
        levels[size] = table(levels[size + 1].groupBy(F.expr("substring(gram, 2)").alias("gram"), "i").agg(F.count("*").alias("n")))
    vocabulary = levels[1].select("gram").distinct().count() + 1
    below = None
    grams, contexts = [], []
    for size in range(1, ORDER + 1):
        rows = levels[size]
        found = {r["i"]: r for r in rows.groupBy("i").agg(F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two")).collect()}
        off = [min(0.95, max(0.1, r["one"] / max(r["one"] + 2 * r["two"], 1) if r["one"] + r["two"] else 0.5)) for r in (found[i] for i in range(len(langs)))]
        discount = F.array(*[F.lit(float(x)) for x in off])
        context = F.expr(f"substring(gram, 1, {size - 1})").alias("context")
        sums = rows.groupBy(context, "i").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        sums = sums.select("context", "i", "total", (F.element_at(discount, F.col("i") + 1) * F.col("kinds") / F.col("total")).alias("weight"))
        around = table(_dense(sums, "context", ["total"], len(langs), 0.0).join(_dense(sums, "context", ["weight"], len(langs), 1.0), "context"))
        counted = _dense(rows, "gram", ["n"], len(langs), 0.0).select("gram", "n", context, F.expr("substring(gram, 2)").alias("suffix")).join(around, "context")
        if below is None:
            counted = counted.withColumn("lower", F.array_repeat(F.lit(1 / vocabulary), len(langs)))
        else:
            counted = counted.join(below.select(F.col("gram").alias("suffix"), F.col("p").alias("lower")), "suffix")
        kept = F.zip_with(F.zip_with("n", discount, lambda n, d: F.greatest(n - d, F.lit(0.0))), "total", lambda x, t: F.when(t > 0, x / t).otherwise(0.0))
        p = F.zip_with(kept, F.zip_with("weight", "lower", lambda w, q: w * q), lambda a, b: a + b)
        below = table(counted.select("gram", p.alias("p")))
        logs = lambda c: F.transform(c, lambda x: F.log(F.greatest(x, F.lit(1e-12))).cast("float"))
        grams.append(below.select(F.lit(size).alias("size"), "gram", logs("p").alias("logs")))
        contexts.append(around.select(F.lit(size - 1).alias("size"), F.col("context").alias("gram"), logs("weight").alias("logs")))
    union = lambda dfs: table(_united(dfs))
    return Model(langs, union(grams), union(contexts), float(np.log(1 / vocabulary)))


def _united(dfs: list[DataFrame]) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df)
    return out


def fit(docs: DataFrame) -> Model:
    """A model from the rows (doc_id, text, lang) outside the hold-out with a lang, all of them."""
    return kneser_ney(ngram_counts(docs.where(learned_from())))


def learned_from() -> Column:
    return F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(id_bucket("doc_id", HELD_MOD), F.lit(-1)) != HELD)


# -- scoring with sorted arrays ----------------------------------------------------------------------------


def hashes(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the rows of a matrix of code points; the number of columns is part of the hash."""
    h = np.full(len(codes), codes.shape[1] + 1, np.uint64)
    for i in range(codes.shape[1]):
        h = (h ^ codes[:, i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


class Arrays:
    """A model's tables as sorted hash arrays, by n-gram size."""

    def __init__(self, model: Model):
        n = len(model.langs)
        self.n, self.unseen = n, model.unseen
        self.keys, self.logs = self._sorted(model.grams, range(1, ORDER + 1))
        self.context_keys, self.weights = self._sorted(model.contexts, range(ORDER))

    def _sorted(self, rows: DataFrame, sizes: range) -> tuple[list[np.ndarray], list[np.ndarray]]:
        got = rows.toArrow()
        size = got["size"].to_numpy()
        logs = got["logs"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, self.n)
        text = got["gram"].combine_chunks()
        keys, values = [], []
        for k in sizes:
            at = np.flatnonzero(size == k)
            codes = np.frombuffer("".join(text.take(pa.array(at)).to_pylist()).encode("utf-32-le"), np.uint32).reshape(len(at), k)
            h = hashes(codes)
            o = np.argsort(h)
            keys.append(h[o])
            values.append(logs[at[o]].astype(np.float32))
        return keys, values

    def log_probs(self, codes: np.ndarray) -> np.ndarray:
        """log P(last | others) of each row of code points, for each language."""
        out = np.zeros((len(codes), self.n))
        todo = np.arange(len(codes))
        for size in range(ORDER, 0, -1):
            keys, h = self.keys[size - 1], hashes(codes[todo, ORDER - size :])
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            out[todo[hit]] += self.logs[size - 1][at[hit]]
            todo = todo[~hit]
            if not len(todo):
                return out
            keys, h = self.context_keys[size - 1], hashes(codes[todo, ORDER - size : ORDER - 1])
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            out[todo[hit]] += self.weights[size - 1][at[hit]]
        out[todo] += self.unseen
        return out


class Scorer:
    """Scores words under one model, each once while it is remembered."""

    def __init__(self, arrays: Arrays):
        self.arrays = arrays
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, self.arrays.n), np.float32)

    def score(self, words: list[str]) -> np.ndarray:
        """The sum of log-probabilities of each word, for each language."""
        out = np.zeros((len(words), self.arrays.n))
        codes = np.frombuffer("".join(_BEFORE + w + _AFTER for w in words).encode("utf-32-le"), np.uint32)
        lengths = np.array([len(w) + 1 for w in words])
        owner = np.repeat(np.arange(len(words)), lengths)
        at = np.arange(len(owner)) + owner * (ORDER - 1)
        for a in range(0, len(at), PIECE):
            logs, own = self.arrays.log_probs(codes[at[a : a + PIECE, None] + np.arange(ORDER)]), owner[a : a + PIECE]
            firsts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            out[own[firsts]] += np.add.reduceat(logs, firsts, axis=0)
        return out

    def learn(self, words: list[str]) -> None:
        n = len(self.at)
        while len(self.rows) < n + len(words):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[n : n + len(words)] = self.score(words)
        self.at.update(zip(words, range(n, n + len(words)), strict=True))

    def entropies(self, texts: list[str | None]) -> np.ndarray:
        """Cross-entropy by character of each text and language; NaN without letters."""
        split = [words_of(t) for t in texts]
        if len(self.at) > REMEMBERED:
            self.clear()
        known = self.at
        new = list(dict.fromkeys(w for ws in split for w in ws if w not in known and len(w) <= LONGEST))
        for i in range(0, len(new), 20_000):
            self.learn(new[i : i + 20_000])
        out = np.full((len(texts), self.arrays.n), np.nan)
        for i, ws in enumerate(split):
            if ws:
                short = [known[w] for w in ws if len(w) <= LONGEST]
                total = self.rows[np.array(short, np.int64)].sum(0, dtype=np.float64)
                for w in ws if len(short) < len(ws) else ():
                    if len(w) > LONGEST:
                        total += self.score([w])[0]
                out[i] = -total / (sum(map(len, ws)) + len(ws))
        return out


#: What a worker process keeps between its tasks: the scorer of the model that it had last.
_KEPT: list[Scorer] = []


def kept_scorer(arrays: Arrays) -> Scorer:
    if not _KEPT or _KEPT[0].arrays is not arrays:
        _KEPT[:] = [Scorer(arrays)]
    return _KEPT[0]


def entropy_column(text: Column, arrays: Arrays, spark) -> Column:
    """Array of cross-entropies in the order of the model's languages; null without letters."""
    sent = spark.sparkContext.broadcast(arrays)

    @F.arrow_udf("array<double>")
    def entropies(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = kept_scorer(sent.value)
        for batch in batches:
            out: list = []
            for at in range(0, len(batch), 64):
                got = scorer.entropies(batch.slice(at, 64).to_pylist())
                out += [None if np.isnan(r[0]) else r for r in got]
            yield pa.array(out, pa.list_(pa.float64()))

    return entropies(text)


# -- scoring by joins --------------------------------------------------------------------------------------


def pieces_of(rows: DataFrame) -> DataFrame:
    """(id, piece, is_gram, n) of rows (id, text): the words of each row, counted in it; of longer ones than LONGEST the
    n-grams, so that no long text becomes a key."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for id_, text in zip(part.column(0).to_pylist(), str_values(part.column(1)), strict=True):
                words = Counter(words_of(text))
                grams: Counter = Counter()
                for word in [w for w in words if len(w) > LONGEST]:
                    n = words.pop(word)
                    for g in grams_of(word):
                        grams[g] += n
                for got, flag in ((words, False), (grams, True)):
                    yield pa.RecordBatch.from_arrays([pa.array([id_] * len(got), pa.int64()), pa.array(list(got), pa.string()), pa.array([flag] * len(got), pa.bool_()), pa.array(list(got.values()), pa.int64())], ["id", "piece", "is_gram", "n"])

    return rows.select("id", "text").mapInArrow(count, "id long, piece string, is_gram boolean, n long")


def _sum(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def gram_logs(grams: DataFrame, model: Model) -> DataFrame:
    """(gram, logs) of distinct grams of ORDER characters, by left joins with each order's table."""
    rows = grams.select("gram", F.array_repeat(F.lit(0.0), len(model.langs)).alias("logs"), F.lit(False).alias("done"))
    for size in range(ORDER, 0, -1):
        own = model.grams.where(F.col("size") == size).select(F.col("gram").alias("key"), F.col("logs").alias("p"))
        weight = model.contexts.where(F.col("size") == size - 1).select(F.col("gram").alias("context"), F.col("logs").alias("w"))
        rows = rows.withColumn("key", F.expr(f"right(gram, {size})")).withColumn("context", F.expr(f"substring(gram, {ORDER - size + 1}, {size - 1})"))
        rows = rows.join(own, "key", "left").join(weight, "context", "left")
        logs = F.when(F.col("done"), F.col("logs")).when(F.col("p").isNotNull(), _sum("logs", "p")).when(F.col("w").isNotNull(), _sum("logs", "w")).otherwise(F.col("logs"))
        rows = rows.select("gram", logs.alias("logs"), (F.col("done") | F.col("p").isNotNull()).alias("done"))
    return rows.select("gram", F.when(F.col("done"), F.col("logs")).otherwise(F.transform("logs", lambda x: x + model.unseen)).alias("logs"))


def _added(rows: DataFrame, key: str, weight: Column, n: int) -> DataFrame:
    """(key, logs): the weighted sum of the arrays logs of each key."""
    return rows.groupBy(key).agg(F.array(*[F.sum(F.col("logs")[i] * weight) for i in range(n)]).alias("logs"))


def joined_entropies(rows: DataFrame, model: Model) -> DataFrame:
    """(id, h) of the rows (id, text) with letters: distinct words are scored, rows sum their words."""
    counts, n = table(pieces_of(rows)), len(model.langs)
    padded = F.concat(F.lit(_BEFORE), "piece", F.lit(_AFTER))
    grams = F.transform(F.sequence(F.lit(1), F.length("piece") + 1), lambda i: F.substring(padded, i, F.lit(ORDER)))
    kinds = table(counts.where("NOT is_gram").select("piece").distinct().select("piece", F.explode(grams).alias("gram")).groupBy("piece", "gram").agg(F.count("*").alias("times")))
    asked = kinds.select("gram").unionByName(counts.where("is_gram").select(F.col("piece").alias("gram"))).distinct()
    logs = table(gram_logs(asked, model))
    words = _added(kinds.join(logs, "gram"), "piece", F.col("times"), n).withColumn("is_gram", F.lit(False))
    known = words.unionByName(logs.select(F.col("gram").alias("piece"), "logs", F.lit(True).alias("is_gram")))
    chars = F.when(F.col("is_gram"), F.col("n")).otherwise((F.length("piece") + 1) * F.col("n"))
    # The most frequent pieces are sent to all tasks, FREQUENT of bounded length; the others are exchanged, and none of them is hot.
    key = ["piece", "is_gram"]
    hot = table(counts.groupBy(*key).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), *key).limit(FREQUENT).join(known, key).drop("rows"))
    rest = counts.join(F.broadcast(hot.select(*key)), key, "left_anti").join(known, key)
    met = counts.join(F.broadcast(hot), key).unionByName(rest)
    sums = met.withColumn("chars", chars).groupBy("id").agg(F.sum("chars").alias("chars"), F.array(*[F.sum(F.col("logs")[i] * F.col("n")) for i in range(n)]).alias("logs"))
    return sums.select("id", F.transform("logs", lambda x: -x / F.col("chars")).alias("h"))


# -- decisions ---------------------------------------------------------------------------------------------


def scored(docs: DataFrame, model: Model, keep: Column, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(row, h): keep of each row of docs, and its cross-entropies; null without letters."""
    size = (model.grams.count() + model.contexts.count()) * (GRAM_BYTES + 12 * len(model.langs))
    if size <= most_bytes:
        return docs.select(keep.alias("row"), entropy_column(F.col("text"), Arrays(model), docs.sparkSession).alias("h"))
    rows = table(docs.select(keep.alias("row"), "text", F.monotonically_increasing_id().alias("id")))
    return rows.drop("text").join(joined_entropies(rows, model), "id", "left").select("row", "h")


def decided(rows: DataFrame, model: Model) -> DataFrame:
    """(row, lang_pred, score, accepted) of (row, h)."""
    names = F.array(*[F.lit(x) for x in model.langs])
    limits = F.array(*[F.lit(float((model.limits or {}).get(x, np.inf))) for x in model.langs])
    best = F.array_min("h")
    place = F.array_position("h", best).cast("int")
    share = 1 / F.aggregate("h", F.lit(0.0), lambda total, h: total + F.exp((best - h) / TEMPERATURE))
    none = F.col("h").isNull()
    return rows.select("row", F.when(none, "und").otherwise(F.element_at(names, place)).alias("lang_pred"), F.when(none, 0.0).otherwise(share).alias("score"), F.coalesce(best <= F.element_at(limits, place), F.lit(False)).alias("accepted"))


def limits_of(rows: DataFrame) -> dict[str, float]:
    """The rejection limit of each language from all rows (lang, h): one number a language."""
    found = rows.where("lang IS NOT NULL AND h IS NOT NULL").groupBy("lang").agg(F.percentile_approx(F.array_min("h"), QUANTILE, 10_000).alias("h"))
    return {r["lang"]: r["h"] for r in found.collect()}


def _outputs(docs: DataFrame, rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in OUTPUTS], *OUTPUTS)


def _nothing(docs: DataFrame) -> DataFrame:
    return docs.select(packed(docs).alias("row"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))


def identify(docs: DataFrame, model: Model, most_bytes: int = MOST_BYTES) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and accepted (all with letters, where the model was not calibrated)."""
    if not model.langs:
        return _outputs(docs, _nothing(docs))
    return _outputs(docs, decided(scored(docs, model, packed(docs), most_bytes), model))


def learn_and_identify(docs: DataFrame) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) of docs (doc_id, text, lang): learned from its own rows outside the
    hold-out, scored once, and calibrated on the scores of all of these."""
    model = fit(docs)
    ids = docs.select("doc_id")
    if not model.langs:
        return _outputs(ids, _nothing(ids))
    keep = F.struct("doc_id", F.when(learned_from(), F.col("lang")).alias("lang"))
    rows = table(scored(docs, model, keep))
    model.limits = limits_of(rows.select("row.lang", "h"))
    return _outputs(ids, decided(rows, model))


def held_out() -> Column:
    return F.coalesce(id_bucket("doc_id", HELD_MOD) == HELD, F.lit(False))
