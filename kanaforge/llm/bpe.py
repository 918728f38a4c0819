"""Byte-level BPE over a rank file, encoding and decoding.

Each pre-token is merged through a hierarchical-bitmap rank queue: a bucket per merge rank holds the
linked-list positions whose pair has that rank, words of 64 bits over words of 64 bits mark the buckets in
use, find-first-set finds the lowest rank, and an entry whose pair has changed since is skipped. A step costs
the number of bitmap levels whatever the pre-token's length, so megabyte-long pre-tokens stay near-linear.

Defined cases: a null text encodes like an empty one (no ids); ids decode to exactly the bytes of the text;
texts that look like special tokens are ordinary text; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kanaforge.llm.common import remember, str_values

#: Pre-tokens a worker remembers in each of two generations; bounds its memory, never the result.
REMEMBERED = 400_000
#: Up to here one machine word marks the positions of a bucket.
SHORT_BYTES = 64
#: Longer pre-tokens are encoded again each time instead of being remembered.
REMEMBERED_CHARS = 64


#: Below U+0250 these are the letters, numbers and white space of the pattern's classes.
_LETTERS, _NUMBERS, _SPACES = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\\t-\\r \u0085\u00a0"
_BEYOND = re.compile("[^\0-\u024f]").search


def splitter(pattern: str):
    """Pre-tokens of a text. Texts below U+0250 go through the same pattern in the faster standard engine."""
    slow = regex.compile(pattern).findall
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_SPACES}{_LETTERS}{_NUMBERS}]").replace(r"\p{L}", f"[{_LETTERS}]").replace(r"\p{N}", f"[{_NUMBERS}]").replace(r"\S", f"[^{_SPACES}]").replace(r"\s", f"[{_SPACES}]")
    if "\\p" in plain or "\\P" in plain:
        return slow
    fast = re.compile(plain).findall
    return lambda text: slow(text) if _BEYOND(text) else fast(text)


class RankQueue:
    """Priority queue over a fixed range of ranks, positions within a rank from left to right."""

    __slots__ = ("buckets", "levels")

    def __init__(self, n_ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.levels: list[list[int]] = []
        n = max(n_ranks, 1)
        while True:
            n = (n + 63) >> 6
            self.levels.append([0] * n)
            if n == 1:
                break

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        at = rank
        for words in self.levels:
            word, bit = at >> 6, 1 << (at & 63)
            before = words[word]
            words[word] = before | bit
            if before:
                break
            at = word

    def pop(self) -> tuple[int, int] | None:
        at = 0
        for words in reversed(self.levels):
            word = words[at]
            if not word:
                return None
            at = (at << 6) | ((word & -word).bit_length() - 1)
        bucket = self.buckets[at]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[at]
            up = at
            for words in self.levels:
                word = up >> 6
                words[word] &= ~(1 << (up & 63))
                if words[word]:
                    break
                up = word
        return at, position


class Bpe:
    """Encoder and decoder of one vocabulary (bytes -> rank) with one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {str(r): b for b, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.split = splitter(pattern)
        self.queue = RankQueue(max(ranks.values()) + 1)

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        return self.encode_short(piece) if len(piece) <= SHORT_BYTES else self.encode_long(piece)

    def encode_short(self, piece: bytes) -> list[int]:
        """The same queue for pieces of a few bytes: two bitmap levels, and a bucket is a bitmap of positions."""
        get, n = self.ranks.get, len(piece)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        pair: list[int | None] = [None] * n
        bucket: dict[int, int] = {}
        words: dict[int, int] = {}
        top = 0
        for i in range(n - 1):
            r = pair[i] = get(piece[i : i + 2])
            if r is not None:
                if r in bucket:
                    bucket[r] |= 1 << i
                else:
                    bucket[r] = 1 << i
                    w = r >> 6
                    words[w] = words.get(w, 0) | 1 << (r & 63)
                    top |= 1 << w
        while top:
            w = (top & -top).bit_length() - 1
            word = words[w]
            r = w << 6 | (word & -word).bit_length() - 1
            places = bucket[r]
            low = places & -places
            if places == low:
                del bucket[r]
                word &= word - 1
                words[w] = word
                if not word:
                    top &= top - 1
            else:
                bucket[r] = places ^ low
            i = low.bit_length() - 1
            if pair[i] != r:
                continue  # stale
            j = after[i]
            k = after[i] = after[j]
            pair[j] = pair[i] = None
            if k < n:
                before[k] = i
                ends = ((before[i], k), (i, after[k]))
            else:
                ends = ((before[i], k),)
            for p, end in ends:
                if p >= 0:
                    new = get(piece[p:end])
                    if new != pair[p]:
                        pair[p] = new
                        if new is not None:
                            if new in bucket:
                                bucket[new] |= 1 << p
                            else:
                                bucket[new] = 1 << p
                                w = new >> 6
                                words[w] = words.get(w, 0) | 1 << (new & 63)
                                top |= 1 << w
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode_long(self, piece: bytes) -> list[int]:
        get, longest, queue, n = self.ranks.get, self.longest, self.queue, len(piece)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        pair = [-1] * n  # the rank of the pair that starts here; -1: none
        for i in range(n - 1):
            r = get(piece[i : i + 2])
            if r is not None:
                pair[i] = r
                queue.push(r, i)
        while (top := queue.pop()) is not None:
            r, i = top
            if pair[i] != r:
                continue  # stale
            j = after[i]
            k = after[j]
            pair[j] = -1
            after[i] = k
            if k < n:
                before[k] = i
                end = after[k]
                new = get(piece[i:end]) if end - i <= longest else None
                pair[i] = -1 if new is None else new
                if new is not None:
                    queue.push(new, i)
            else:
                pair[i] = -1
            p = before[i]
            if p >= 0:
                new = get(piece[p:k]) if k - p <= longest else None
                if new is None:
                    pair[p] = -1
                elif new != pair[p]:
                    pair[p] = new
                    queue.push(new, p)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def decode(self, ids: list[str]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Pieces(dict):
    """Pre-token -> its ids as decimal text joined by commas, in two generations of bounded size."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe, self.old = bpe, {}

    def __missing__(self, piece: str) -> str:
        found = self.old.get(piece)
        if found is None:
            found = ",".join(map(str, self.bpe.encode_piece(piece.encode("utf-8"))))
            if len(piece) > REMEMBERED_CHARS:
                return found
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[piece] = found
        return found

    def ids_text(self, text: str | None) -> str:
        return ",".join(map(self.__getitem__, self.bpe.split(text))) if text else ""


#: What a worker process keeps between its tasks: one vocabulary and the pieces that it has met.
_KEPT: dict[tuple, Pieces] = {}


def kept_pieces(path: str, pattern: str, ranks) -> Pieces:
    """The pieces of this worker process. ranks: the broadcast vocabulary of path."""
    remember(_KEPT)
    if (path, pattern) not in _KEPT:
        _KEPT.clear()
        _KEPT[path, pattern] = Pieces(Bpe(ranks.value, pattern))
    return _KEPT[path, pattern]


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token and its rank on each line. Its size is the vocabulary's, not the data's."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class BpeColumns:
    """Column expressions of one vocabulary; its ranks go to the executors once, as a broadcast of fixed size."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        ranks = spark.sparkContext.broadcast(read_ranks(path))

        def pieces() -> Pieces:
            return kept_pieces(path, pattern, ranks)

        @F.arrow_udf("array<int>")
        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known = pieces()
            for batch in batches:
                yield pa.array([[int(x) for x in s.split(",")] if s else [] for s in map(known.ids_text, str_values(batch))], pa.list_(pa.int32()))

        @F.arrow_udf("binary")
        def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            bpe = pieces().bpe
            for batch in batches:
                yield pa.array([None if ids is None else bpe.decode(list(map(str, ids))) for ids in batch.to_pylist()], pa.binary())

        @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
        def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known = pieces()
            for batch in batches:
                n, ids, decoded = [], [], []
                for text in str_values(batch):
                    s = known.ids_text(text)
                    parts = s.split(",") if s else []
                    n.append(len(parts))
                    ids.append(hashlib.sha256(s.encode()).hexdigest())
                    decoded.append(hashlib.sha256(known.bpe.decode(parts)).hexdigest())
                yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

        self._encode, self._decode, self._digest = encode, decode, digest

    def encode(self, text: Column | str) -> Column:
        """text -> array of ids."""
        return self._encode(text)

    def decode(self, ids: Column | str) -> Column:
        """array of ids -> the bytes that they stand for (null: null)."""
        return self._decode(ids)

    def digest(self, text: Column | str) -> Column:
        """Encode, then decode the ids again: (n_tokens, ids_sha256, decoded_sha256)."""
        return self._digest(text)


def tokenize(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with the ids of its text column; columns of docs stay, one named like out is replaced."""
    return docs.withColumn(out, BpeColumns(docs.sparkSession, path, pattern).encode(F.col(text)))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    return docs.select("doc_id", BpeColumns(docs.sparkSession, path, pattern).digest(F.col("text")).alias("d")).select("doc_id", "d.*")
