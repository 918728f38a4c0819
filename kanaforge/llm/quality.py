"""Quality classifier: hashed word n-gram logistic regression trained with FTRL updates.

Features of a text, all hashed into one space: its words and word pairs as written, and the same over word
shapes (letters, digits and marks, runs folded), which carry mark-up noise and shouting to unseen words; plus
the shares of repeated word pairs and of immediate word repeats. A score is the sparse dot product of the
text's features and the weights, through the logistic function.

Defined cases: null and empty texts have only the length and bias features, so all get one score; very long texts are
read whole; labels other than 0 or 1 are not learned from; with no usable labels every score is 0.5;
repeated rows and ties give equal scores; other columns pass through, and columns named like the outputs are
replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kanaforge.llm.common import id_bucket, label_sample, labelled_texts, remember, utf8_values
from kanaforge.llm.linear import Ftrl, ordered, sigmoid

DIM = 1 << 18
#: At most so many labelled rows of each class are fitted; a documented bound on the training sample.
PER_CLASS = 4000
#: Hold-out: rows whose crc32(doc_id) mod 5 is 0.
HELD_MOD, HELD = 5, 0
THRESHOLD = 0.3
EPOCHS = 3
#: Words a worker remembers the hashes of, and the longest that it remembers, in bytes.
REMEMBERED, LONGEST = 300_000, 64

_KIND = bytes(48 if 48 <= b < 58 else 65 if 65 <= b < 91 else 97 if 97 <= b < 123 or b >= 128 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.S).sub


class _Words(dict):
    """Word -> hash of the word << 32 | hash of its shape."""

    def __missing__(self, word: bytes) -> int:
        h = crc32(word) << 32 | crc32(_RUN(rb"\1", word.translate(_KIND)), 7)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = h
        return h


_WORDS = _Words()


def keep_words() -> None:
    """At the start of a task: its worker process keeps the words for its next tasks."""
    remember(_WORDS)


_ODD = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - 18)


def _slot(h: np.ndarray, salt: int) -> np.ndarray:
    return ((h * np.uint64(8) + np.uint64(salt)) * _ODD >> _SHIFT).astype(np.int64)


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates (with repeats) and values; their dot product with weights sums over both."""
    words = (text or b"").split()
    n = len(words)
    if not n:
        return np.array([_slot(np.array([n], np.uint64), 6)[0]]), np.array([1.0])
    h = np.array(list(map(_WORDS.__getitem__, words)), np.uint64)
    word, shape = h >> np.uint64(32), h & np.uint64(0xFFFFFFFF)
    at = [_slot(word, 0), _slot(shape, 1)]
    x = [np.full(n, n**-0.5), np.full(n, 4.0 / n)]
    rates = np.zeros(2)
    if n > 1:
        two = word[:-1] * np.uint64(31) + word[1:] * np.uint64(1_000_003)
        at += [_slot(two, 2), _slot(shape[:-1] * np.uint64(31) + shape[1:] * np.uint64(1_000_003), 3)]
        x += [np.full(n - 1, (n - 1) ** -0.5), np.full(n - 1, 4.0 / (n - 1))]
        rates = np.array([1 - len(np.unique(two)) / (n - 1), np.mean(word[:-1] == word[1:])])
    at.append(_slot(np.arange(2, dtype=np.uint64) * np.uint64(64) + (rates * 10).astype(np.uint64), 4))
    x.append(np.ones(2))
    at.append(_slot(np.array([int(n).bit_length()], np.uint64), 5))
    x.append(np.ones(1))
    return np.concatenate(at), np.concatenate(x)


def distinct(at: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same dot product over distinct coordinates, as training needs them."""
    where, back = np.unique(at, return_inverse=True)
    return where, np.bincount(back, weights=x)


def training_rows(sample: DataFrame, text: str = "text") -> DataFrame:
    """(y, at, x) of each row of a bounded sample (y, text)."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_words()
        for part in parts:
            rows = [distinct(*features(t)) for t in utf8_values(part.column(1))]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array([r[1].astype(np.float32) for r in rows], pa.list_(pa.float32()))], ["y", "at", "x"]
            )

    return sample.select("y", text).mapInArrow(batches, "y int, at array<int>, x array<float>")


def fit(docs: DataFrame, lab: DataFrame, per_class: int = PER_CLASS) -> np.ndarray:
    """Weights of the classifier, float32, dim + 1 with the bias last - a fixed size."""
    sample, importance = label_sample(lab, "quality", HELD_MOD, HELD, per_class)
    got = training_rows(labelled_texts(docs, sample)).toArrow()
    data = [(np.asarray(at.values), np.asarray(x.values), y) for at, x, y in zip(got["at"], got["x"], got["y"].to_pylist(), strict=True)]
    model = Ftrl(DIM, alpha=0.2, l1=0.02, l2=1.0).fit(ordered(data), importance, EPOCHS)
    return model.weights().astype(np.float32)


def score_column(docs: DataFrame, weights: np.ndarray, text: str = "text") -> Column:
    model = docs.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        keep_words()
        w = model.value
        for batch in batches:
            raw = []
            for t in utf8_values(batch):
                at, x = features(t)
                raw.append(float(w[at] @ x) + float(w[-1]))
            yield pa.array(sigmoid(np.array(raw)) if raw else [], pa.float64())

    return score(F.col(text))


def classify(docs: DataFrame, lab: DataFrame) -> DataFrame:
    """docs with score (higher: good quality likelier) and predicted (1 from the threshold on)."""
    return docs.withColumn("score", score_column(docs, fit(docs, lab))).withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def held_out() -> Column:
    return F.coalesce(id_bucket("doc_id", HELD_MOD) == HELD, F.lit(False))
