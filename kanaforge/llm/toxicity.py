"""Toxicity: noisy-channel deobfuscation, then a linear score of the restored words.

A character trigram model is counted over every document. A token that may hide a word - look-alike marks or
digits beside letters, letters set apart by spaces or marks, a letter repeated three times or more - becomes a
lattice: each character may stand for itself, for the letters that it resembles, for nothing (a separator or a
repetition), at a channel cost. Viterbi search under the language model, over states of the last two letters,
restores the likeliest letters. A token without such signs has one path, itself, and needs no search.
The restored words (each once) are hashed into a logistic regression fitted by FTRL on a bounded sample.

Defined cases: null and empty texts score as the bias alone; whole texts are read; labels other than 0 or 1
are not learned from; with no usable labels every score is 0 and nothing is called toxic; equal texts score equally; other columns pass
through, columns named like the outputs are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kanaforge.llm.common import id_bucket, label_sample, labelled_texts, remember, str_values, utf8_values
from kanaforge.llm.linear import Ftrl, ordered, sigmoid

BITS = 18
DIM = 1 << BITS
#: At most so many labelled rows of each class are fitted; a documented bound on the training sample.
PER_CLASS = 5000
HELD_MOD, HELD = 4, 2
THRESHOLD = 0.3
EPOCHS = 4
#: Words a worker remembers, and the longest that it remembers.
REMEMBERED, LONGEST = 300_000, 64

#: Look-alike marks and the letters that they stand for.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Marks that may stand between the letters of a word.
SEPARATORS = ".-_*~'`^"
#: Channel costs in nats: a look-alike for its letter, a silent separator, a real space between set-apart
#: letters, a silent mark, a silent digit, a folded repetition, a mark or digit kept as it is.
LOOKALIKE, SILENT, BREAK, DROPPED, DROPPED_DIGIT, FOLDED, KEPT, KEPT_DIGIT = 0.7, 0.5, 1.0, 3.0, 8.0, 0.3, 4.0, 8.0
#: Symbols of the model: 0 everything else (also the word's edges), 1 to 26 the letters a to z, 27 any letter beyond ASCII.
SYMBOLS = 28

_CLASS = bytes(b - 96 if 97 <= b < 123 else b - 64 if 65 <= b < 91 else 27 if b >= 128 else 0 for b in range(256))


def trigram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of the 28^3 symbol trigrams over all documents: summed in each task, then by trigram."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember()
        total = np.zeros(SYMBOLS**3, np.int64)
        for part in parts:
            for t in utf8_values(part.column(0)):
                if t:
                    a = np.frombuffer(b" " + t.translate(_CLASS) + b" ", np.uint8).astype(np.int32)
                    a[0] = a[-1] = 0
                    total += np.bincount(a[:-2] * SYMBOLS**2 + a[1:-1] * SYMBOLS + a[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["gram", "n"])

    out = np.zeros(SYMBOLS**3)
    for r in docs.select(text).mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[r["gram"]] = r["n"]
    return out


def language_model(counts: np.ndarray) -> np.ndarray:
    """-log P(c | a, b), interpolated down to a uniform distribution (Witten-Bell)."""
    c3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for c in (c3.sum((0, 1)), c3.sum(0), c3):
        kinds, total = (c > 0).sum(-1, keepdims=True), c.sum(-1, keepdims=True)
        p = np.where(total > 0, (c + kinds * p) / np.maximum(total + kinds, 1), p)
    return -np.log(p)


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


class Restorer:
    """Restores hidden words under one language model; remembers what it has restored."""

    def __init__(self, cost: np.ndarray):
        self.cost = cost.reshape(SYMBOLS, SYMBOLS, SYMBOLS).tolist()
        self.known: dict[str, str] = {}

    def arcs(self, token: str, i: int) -> list[tuple[str, float]]:
        """What character i may stand for, with the channel's cost."""
        c = token[i]
        same = i > 0 and token[i - 1] == c
        if c.isalpha():
            run = same and (token[i - 2 : i - 1] == c or token[i + 1 : i + 2] == c)
            return [(c, 0.0), ("", FOLDED)] if run else [(c, 0.0)]
        if c == " ":
            return [("", SILENT), (" ", BREAK)]
        out = [(x, LOOKALIKE) for x in LOOKALIKES.get(c, "")]
        if c in SEPARATORS:
            out.append(("", SILENT))
        else:
            digit = c.isdigit()
            out += [("", FOLDED if same else DROPPED_DIGIT if digit else DROPPED), (c, KEPT_DIGIT if digit else KEPT)]
        return out

    def viterbi(self, token: str) -> str:
        """The letters of the cheapest path through the token's lattice; ties go to the first in letter order."""
        cost = self.cost
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for i in range(len(token)):
            arcs = [(x, symbol(x), k) for x, k in self.arcs(token, i) if x] , [k for x, k in self.arcs(token, i) if not x]
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (total, path) in best.items():
                for k in arcs[1]:
                    here = after.get((a, b))
                    if here is None or total + k < here[0]:
                        after[a, b] = (total + k, path)
                row = cost[a][b]
                for x, s, k in arcs[0]:
                    new = total + k + row[s]
                    here = after.get((b, s))
                    if here is None or new < here[0]:
                        after[b, s] = (new, (path, x))
            best = after
        _, path = min((total + self.cost[a][b][0], i, path) for i, ((a, b), (total, path)) in enumerate(sorted(best.items(), key=lambda s: s[0])))[::2]
        out = []
        while path:
            path, x = path
            out.append(x)
        return "".join(reversed(out))

    def restore(self, token: str) -> str:
        """A token without white space, or a run of single characters; both in lower case."""
        found = self.known.get(token)
        if found is None:
            bare = _EDGE(token)
            plain = _PLAIN(bare) and not _LONG_RUN(bare)
            found = bare if plain else self.viterbi(bare) if _LETTER(bare) else ""
            if len(token) <= LONGEST:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[token] = found
        return found


#: Opening and closing marks, and runs of three and more of any mark, are no part of a word.
_OPENING, _CLOSING = frozenset("\"'([{<.,;:?"), frozenset("\"')]}>.,;:?!")
_PLAIN = re.compile(r"[^\W\d_]*\Z").match
_LETTER = re.compile(r"[^\W\d_]").search
_LONG_RUN = re.compile(r"(.)\1\1").search
#: Three or more single characters, set apart by one space.
_APART = re.compile(r"(?<!\S)\S(?: \S){2,}(?!\S)").finditer


def _EDGE(token: str) -> str:
    """A token without the marks around it; each is looked at once."""
    if token.isalpha():
        return token
    mark = lambda c: not (c.isalnum() or c == "_" or c.isspace())
    start, end, size = 0, len(token), len(token)
    while start < end:
        c = token[start]
        run = start + 1
        while run < size and token[run] == c:
            run += 1
        if not (c in _OPENING or (mark(c) and run - start >= 3)):
            break
        start = run
    while end > start:
        c = token[end - 1]
        run = end - 1
        while run > start and token[run - 1] == c:
            run -= 1
        if not (c in _CLOSING or (mark(c) and end - run >= 3)):
            break
        end = run
    return token[start:end]


def restored_words(text: str | None, restorer: Restorer) -> set[str]:
    """The distinct words of a text after restoration."""
    low = (text or "").lower()
    words = set(map(restorer.restore, set(low.split())))
    for m in _APART(low):
        words.update(restorer.restore(m.group()).split())
    words.discard("")
    return words


def _slots(words: set[str], known: dict[str, int]) -> np.ndarray:
    out = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = crc32(w.encode("utf-8")) >> (32 - BITS)
            if len(w) <= LONGEST:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[w] = h
        out.append(h)
    return np.unique(np.array(out, np.int64))


#: What a worker process keeps between its tasks: the restorer of one model, and hashes of words.
_KEPT: dict[str, tuple[Restorer, dict[str, int]]] = {}


def kept(cost: np.ndarray) -> tuple[Restorer, dict[str, int]]:
    remember(_KEPT)
    key = str(hash(cost.tobytes()))
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Restorer(cost), {}
    return _KEPT[key]


def restore_words(docs: DataFrame, cost: np.ndarray, text: str = "text") -> Column:
    """A text's distinct restored words, in order (null: none)."""
    model = docs.sparkSession.sparkContext.broadcast(cost)

    @F.arrow_udf("array<string>")
    def words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        restorer, _ = kept(model.value)
        for batch in batches:
            yield pa.array([sorted(restored_words(t, restorer)) for t in str_values(batch)], pa.list_(pa.string()))

    return words(F.col(text))


def fit(docs: DataFrame, lab: DataFrame, per_class: int = PER_CLASS) -> tuple[np.ndarray, np.ndarray]:
    """(costs of the language model, weights of the score), both of fixed size."""
    cost = language_model(trigram_counts(docs))
    sample, importance = label_sample(lab, "toxic", HELD_MOD, HELD, per_class)
    model = docs.sparkSession.sparkContext.broadcast(cost)

    def slots(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, known = kept(model.value)
        for part in parts:
            rows = [_slots(restored_words(t, restorer), known).astype(np.int32) for t in str_values(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.int32()))], ["y", "at"])

    got = labelled_texts(docs, sample).mapInArrow(slots, "y int, at array<int>").toArrow()
    data = ordered([(np.asarray(at.values), y) for at, y in zip(got["at"], got["y"].to_pylist(), strict=True)])
    if not data:
        return cost, np.append(np.zeros(DIM, np.float32), np.float32(-np.inf))
    weights = Ftrl(DIM, alpha=0.7, l1=8.0, l2=0.5).fit([(at, np.ones(len(at)), y) for at, y in data], importance, EPOCHS).weights()
    return cost, weights.astype(np.float32)


def score_column(docs: DataFrame, cost: np.ndarray, weights: np.ndarray, text: str = "text") -> Column:
    model = docs.sparkSession.sparkContext.broadcast((cost, weights))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        restorer, known = kept(model.value[0])
        w = model.value[1]
        for batch in batches:
            raw = [float(w[_slots(restored_words(t, restorer), known)].sum() + w[-1]) for t in str_values(batch)]
            yield pa.array(sigmoid(np.array(raw)) if raw else [], pa.float64())

    return score(F.col(text))


def classify(docs: DataFrame, lab: DataFrame) -> DataFrame:
    """docs with score (higher: toxic likelier) and predicted (1 from the threshold on)."""
    cost, weights = fit(docs, lab)
    return docs.withColumn("score", score_column(docs, cost, weights)).withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def held_out() -> Column:
    return F.coalesce(id_bucket("doc_id", HELD_MOD) == HELD, F.lit(False))
