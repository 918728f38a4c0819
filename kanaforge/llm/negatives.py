"""Hard-negative mining by blocked dense matrix products.

Anchors are cut into blocks of bounded bytes. A block is broadcast and multiplied with every block of candidate rows
inside the tasks, in float64: components are integers, so a product is exact as long as its sums stay below 2^53, and
products that could pass it are made of Python's integers. The first pass keeps each anchor's best rows of its own label in each
task; those short lists are merged by ordering them, which gives the same as one list over all rows. The second pass
sends the positives' windows with the anchors and keeps the best rows of other labels inside each window.

Nothing but a block's anchors and their few positives is ever on the driver. A pass reads all candidates once, so
there are as many passes as blocks: the work is anchors x candidates by definition, and memory is bounded by block sizes.

Defined cases: rows with a null id, label or vector, or with a component that is null or not finite, take no part; repeated rows
count each, and an anchor is no positive of itself but its repetition is; vectors of different lengths have no score with
each other; vectors without components all score 0; components beyond 64 bits count as the nearest 64-bit number, and so do
scores; an anchor without positives or a positive without rows in its window gives no row; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kanaforge.llm.common import drop, materialize

#: Positives of an anchor, negatives of a positive.
POSITIVES, NEGATIVES = 5, 10
#: A negative's score is within these hundredths of its positive's.
LOW, HIGH = 30, 90
#: Bytes of an anchor block as float64, and the cells of one product.
BLOCK_BYTES, CELLS = 16 << 20, 4 << 20
#: Tasks' lists of an anchor are merged in as many groups first, so that no anchor's lists meet in one task at once.
MERGE_GROUPS = 64

_EXACT = 1 << 53
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_NONE = np.iinfo(np.int64).min


def quantised(rows: DataFrame, vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(uid, vec_id, label, v) of the rows that take part; v: floor(scale * x) of each component; uid names a row."""
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    v = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    return rows.where(whole).select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))


@dataclass
class Block:
    """Rows as arrays; all vectors have one length."""

    uid: np.ndarray
    vec_id: np.ndarray
    label: np.ndarray
    v: np.ndarray  # rows x length, int64

    @classmethod
    def of(cls, part: pa.RecordBatch | pa.Table) -> Iterator[Block]:
        """The rows of (uid, vec_id, label, v), one block for each length of a vector."""
        uid, vec_id, label = (part.column(i).to_numpy(zero_copy_only=False) if isinstance(part, pa.RecordBatch) else part.column(i).to_numpy() for i in range(3))
        lists = part.column(3)
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.diff(lists.offsets.to_numpy()))
        sizes = np.diff(lists.offsets.to_numpy())
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            v = flat[(ends[at] - size)[:, None] + np.arange(size)] if size else np.zeros((len(at), 0), np.int64)
            yield cls(uid[at], vec_id[at], label[at], v)

    def most(self) -> int:
        return max(int(self.v.max(initial=0)), -int(self.v.min(initial=0)))

    def __getitem__(self, at: slice) -> Block:
        return Block(self.uid[at], self.vec_id[at], self.label[at], self.v[at])


def products(a: Block, b: Block) -> np.ndarray:
    """Exact inner products as int64, held at the ends of 64 bits."""
    if a.most() * b.most() * a.v.shape[1] < _EXACT:
        return (a.v.astype(np.float64) @ b.v.astype(np.float64).T).astype(np.int64)
    wide = a.v.astype(object) @ b.v.astype(object).T
    return np.clip(wide, _LEAST, _MOST).astype(np.int64)


class Best:
    """The best k (score, then smallest id) of each of n lists, fed in blocks."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id, self.uid, self.used = np.full((n, k), _NONE), np.full((n, k), _MOST), np.zeros((n, k), np.int64), np.zeros(n, np.int64)

    def feed(self, first: int, scores: np.ndarray, fits: np.ndarray, rows: Block) -> None:
        """Rows that fit lists first, first + 1, ...; scores and fits: lists x rows."""
        mine = slice(first, first + len(scores))
        last, last_id = self.score[mine, -1][:, None], self.id[mine, -1][:, None]
        full = (self.used[mine] == self.k)[:, None]
        at, col = np.nonzero(fits & (~full | (scores > last) | ((scores == last) & (rows.vec_id[None, :] < last_id))))
        if not len(at):
            return
        touched = np.unique(at)
        old, slot = np.nonzero(np.arange(self.k)[None, :] < self.used[first + touched][:, None])
        where = np.concatenate([at, touched[old]])
        score = np.concatenate([scores[at, col], self.score[first + touched[old], slot]])
        ids = np.concatenate([rows.vec_id[col], self.id[first + touched[old], slot]])
        uid = np.concatenate([rows.uid[col], self.uid[first + touched[old], slot]])
        order = np.lexsort((uid, ids, ~score, where))
        where = where[order]
        begins = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
        place = np.arange(len(where)) - np.repeat(begins, np.diff(np.append(begins, len(where))))
        keep = place < self.k
        to, at_slot, order = first + where[keep], place[keep], order[keep]
        self.score[to, at_slot], self.id[to, at_slot], self.uid[to, at_slot] = score[order], ids[order], uid[order]
        np.maximum.at(self.used, to, at_slot + 1)

    def rows(self) -> tuple[np.ndarray, ...]:
        """(list, score, id, uid) of all that is kept."""
        at, slot = np.nonzero(np.arange(self.k)[None, :] < self.used[:, None])
        return at, self.score[at, slot], self.id[at, slot], self.uid[at, slot]


def _pieces(part: pa.RecordBatch, anchors: int) -> Iterator[Block]:
    step = max(1, CELLS // max(1, anchors))
    for block in Block.of(part):
        for at in range(0, len(block.uid), step):
            yield block[at : at + step]


def _lists(rows: DataFrame, sent, k: int, per_anchor: int) -> DataFrame:
    """(anchor, place, score, other_id, other_uid): each task's best k of every list of the block's anchors.

    sent: broadcast (blocks of anchors, low, high); without windows (None) a list holds rows of the anchor's label, else
    per_anchor lists hold rows of other labels with a score from low to high."""

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, low, high = sent.value
        best = [Best(len(g.uid) * per_anchor, k) for g in groups]
        total = sum(len(g.uid) for g in groups)
        for part in parts:
            for piece in _pieces(part, total):
                for g, group in enumerate(groups):
                    if group.v.shape[1] != piece.v.shape[1]:
                        continue
                    scores, same = products(group, piece), group.label[:, None] == piece.label[None, :]
                    if low is None:
                        best[g].feed(0, scores, same & (group.uid[:, None] != piece.uid[None, :]), piece)
                        continue
                    for p in range(per_anchor):
                        # Lists of one place lie together.
                        best[g].feed(p * len(group.uid), scores, ~same & (scores >= low[g][p][:, None]) & (scores <= high[g][p][:, None]), piece)
        for g, group in enumerate(groups):
            at, score, other, uid = best[g].rows()
            n = len(group.uid)
            columns = [group.uid[at % n] if n else at, (at // n if n else at).astype(np.int32), score, other, uid]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "place", "score", "other_id", "other_uid"])

    return rows.select("uid", "vec_id", "label", "v").mapInArrow(scan, "anchor long, place int, score long, other_id long, other_uid long")


def _merged(lists: DataFrame, k: int) -> DataFrame:
    """The best k of each (anchor, place), with rank from 1. Tasks' lists are merged in groups, then the groups."""
    order = [F.desc("score"), "other_id", "other_uid"]
    grouped = lists.withColumn("_group", F.pmod(F.xxhash64("other_uid"), F.lit(MERGE_GROUPS)))
    part = grouped.withColumn("_rank", F.row_number().over(Window.partitionBy("anchor", "place", "_group").orderBy(*order))).where(F.col("_rank") <= k).drop("_rank", "_group")
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "place").orderBy(*order))).where(F.col("rank") <= k)


def _windows(groups: list[Block], found: pa.Table, positives: int, low: int, high: int) -> tuple[list, list]:
    """For each group of anchors and place of a positive, the least and the greatest score of a negative."""
    lows, highs = [], []
    at = {int(u): (g, i) for g, group in enumerate(groups) for i, u in enumerate(group.uid)}
    for group in groups:
        lows.append(np.full((positives, len(group.uid)), _MOST))
        highs.append(np.full((positives, len(group.uid)), _LEAST))
    for uid, rank, score in zip(*(found.column(c).to_pylist() for c in ("anchor", "rank", "score")), strict=True):
        g, i = at[uid]
        least, most = -(-low * score // 100), high * score // 100
        lows[g][rank - 1, i], highs[g][rank - 1, i] = min(max(least, _LEAST), _MOST), min(max(most, _LEAST), _MOST)
    return lows, highs


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    rows: (uid, vec_id, label, v) as of quantised(); is_anchor: which of them are anchors. For each anchor, the best
    `positives` other rows of its label; for each of these the best `negatives` rows of other labels whose score is from
    low to high hundredths of the positive's. Higher scores come first, ties by smaller id."""
    spark = rows.sparkSession
    rows, rows_path = materialize(rows)
    anchors = rows.where(is_anchor)
    count, width = anchors.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    blocks = max(1, -(-count * (width + 8) * 8 // block_bytes))
    anchors, anchors_path = materialize(anchors.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int")).repartition(blocks, "block").sortWithinPartitions("block"))
    done: list[str] = []
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    for block in range(blocks if count else 0):
        mine_now = anchors.where(F.col("block") == block).select("uid", "vec_id", "label", "v").orderBy("uid").toArrow()
        groups = list(Block.of(mine_now)) if mine_now.num_rows else []
        if not groups:
            continue
        sent = spark.sparkContext.broadcast((groups, None, None))
        best, best_path = materialize(_merged(_lists(rows, sent, positives, 1), positives).select("anchor", "rank", "other_id", "score"))
        windows = _windows(groups, best.select("anchor", "rank", "score").toArrow(), positives, low, high)
        sent_windows = spark.sparkContext.broadcast((groups, *windows))
        found = _merged(_lists(rows, sent_windows, negatives, positives), negatives)
        names = anchors.where(F.col("block") == block).select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
        positive = best.select("anchor", (F.col("rank") - 1).alias("place"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
        out = found.join(positive, ["anchor", "place"]).join(names, "anchor")
        result, path = materialize(out.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
        done.append(path)
        drop(spark, best_path)
        sent.destroy()
        sent_windows.destroy()
    drop(spark, rows_path)
    drop(spark, anchors_path)
    return spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)
