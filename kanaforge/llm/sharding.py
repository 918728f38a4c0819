"""Sharding by histogram sort: exact splitters from counts below candidate keys, then one exchange.

Documents are ordered by (hash of the text, doc_id). In each round every task counts the bytes and rows of its
documents between the candidate boundaries; the sums are exact, a splitter is settled when the bytes below a
boundary are within tolerance of its target, and the rest get new candidates inside their bracket. Boundaries
between hashes are tried first, so that equal texts stay together; a text is cut, by doc_id, only where its copies
are so many that no boundary beside them is within SLACK of a shard's size, and `text_cut` marks its rows. Finer boundaries of the same histogram cut each shard into ranges of equal load,
and the rows are exchanged once, by range.

Law: `bytes` - each boundary is within SLACK of its target, or within one document where one is larger.
Defined cases: null texts count as one byte with crc32 0; repeated (doc_id, text) rows share a key, so a boundary never parts
them, and their slots are in no defined order; null ids sort first; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kanaforge.llm.common import table

SHARDS = 8
#: Accepted deviation of a splitter, as a share of a shard's ideal size.
TOLERANCE = 0.002
#: Deviation of a splitter, as a share of a shard's ideal size, that is accepted to keep equal texts together.
SLACK = 0.02
#: Candidates inside each open bracket in a round, and candidates of the first round.
PROBES, FIRST = 64, 4096
#: Rows that a range of the exchange holds, about.
RANGE_ROWS = 100_000
#: Ranges at most, beyond which they hold more rows: bounds what is broadcast.
MAX_RANGES = 20_000
LOW, HIGH = -(1 << 127), (1 << 127) - 1


def _pack(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Keys whose byte order is the order of (hi, lo), both signed 64-bit."""
    flip = np.uint64(1 << 63)
    both = np.stack([hi.view(np.uint64) ^ flip, lo.view(np.uint64) ^ flip], 1).astype(">u8")
    return np.ascontiguousarray(both).view("S16").ravel()


def _packed(keys: list[int]) -> np.ndarray:
    """The same for keys hi * 2^64 + (lo + 2^63) as Python integers."""
    return np.array([(k + (1 << 127)).to_bytes(16, "big") for k in keys], "S16")


def histogram(rows: DataFrame, bounds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Exact (bytes, rows) with a key below each bound. rows: (hi, lo, size)."""
    sent = rows.sparkSession.sparkContext.broadcast(_packed(bounds))
    n = len(bounds)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, seen = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        for part in parts:
            at = np.searchsorted(sent.value, _pack(*(part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))), side="right")
            np.add.at(size, at, part.column(2).to_numpy(zero_copy_only=False))
            seen += np.bincount(at, minlength=n + 1)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(size[used]), pa.array(seen[used])], ["at", "size", "seen"])

    got = rows.select("hi", "lo", "size").mapInArrow(count, "at int, size long, seen long").groupBy("at").agg(F.sum("size").alias("size"), F.sum("seen").alias("seen")).toArrow()
    size, seen = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    size[got["at"].to_numpy()], seen[got["at"].to_numpy()] = got["size"].to_numpy(), got["seen"].to_numpy()
    return np.cumsum(size)[:-1], np.cumsum(seen)[:-1]


def splitters(rows: DataFrame, total: int, count: int, targets: list[float], tolerance: float, load=lambda size, seen: size, slack: float = 0.0) -> list[int]:
    """A key for each ascending target load, settled to within tolerance, or to one key where a key holds more.

    Where one hash lies across the target, its nearer boundary is taken if that is within slack."""
    step = 1 << 64
    found: list[int | None] = [None] * len(targets)
    brackets = [(LOW, 0.0, HIGH, load(total, count)) for _ in targets]
    probes = sorted({LOW + (i * (1 << 128) // FIRST) for i in range(1, FIRST)})
    while probes:
        size, seen = histogram(rows, probes)
        loads = load(size, seen).astype(float) if len(probes) else np.zeros(0)
        ask: set[int] = set()
        for i, target in enumerate(targets):
            if found[i] is not None:
                continue
            lo, lo_load, hi, hi_load = brackets[i]
            at = int(np.searchsorted(loads, target))
            near = [(abs(loads[k] - target), probes[k]) for k in (at - 1, at) if 0 <= k < len(probes) and lo <= probes[k] <= hi]
            if near and min(near)[0] <= tolerance:
                found[i] = min(near)[1]
                continue
            if at > 0 and lo < probes[at - 1] < hi:
                lo, lo_load = probes[at - 1], loads[at - 1]
            if at < len(probes) and lo < probes[at] < hi:
                hi, hi_load = probes[at], loads[at]
            brackets[i] = (lo, lo_load, hi, hi_load)
            if hi - lo <= 1:
                found[i] = lo if target - lo_load <= hi_load - target else hi
                continue
            if hi - lo <= step and min(target - lo_load, hi_load - target) <= slack:  # one hash lies across the target
                found[i] = lo if target - lo_load <= hi_load - target else hi
                continue
            unit = step if hi - lo > step else 1  # whole hashes first
            inside = [lo + (hi - lo) * k // (PROBES + 1) for k in range(1, PROBES + 1)]
            if unit == step:
                base = -(1 << 127)
                inside = [base + -(-(k - base) // step) * step for k in inside]
            fresh = {k for k in inside if lo < k < hi}
            if not fresh and unit == step:  # one boundary at most between two hashes
                fresh = {lo + (hi - lo) * k // (PROBES + 1) for k in range(1, PROBES + 1)} - {lo, hi}
            if not fresh:
                fresh = {k for k in range(lo + 1, min(hi, lo + 1 + PROBES))}
            ask |= fresh
        probes = sorted(ask)
    return [int(k) for k in found]


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, hi, lo, size, text_crc32): the key and the size of every document."""
    utf8 = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return docs.select(
        "doc_id",
        F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()).alias("hi"),
        F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long").alias("lo"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(utf8).alias("text_crc32"),
    )


def assign(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, text_cut) of every document."""
    rows = table(keyed(docs))
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ideal = total / shards
    cuts = splitters(rows, total, count, [ideal * i for i in range(1, shards)], ideal * tolerance, slack=ideal * SLACK) if count else []
    ranges = min(MAX_RANGES, max(1, -(-count // range_rows), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    share = (lambda size, seen: size / total + seen / count) if count else None
    fine = splitters(rows, total, count, [2 * i / ranges for i in range(1, ranges)], 0.5 / ranges, share) if count else []
    bounds = sorted({*cuts, *fine})
    sent = rows.sparkSession.sparkContext.broadcast(_packed(bounds))

    @F.arrow_udf("int")
    def range_of(hi: pa.Array, lo: pa.Array) -> pa.Array:
        keys = _pack(hi.to_numpy(zero_copy_only=False), lo.to_numpy(zero_copy_only=False))
        return pa.array(np.searchsorted(sent.value, keys, side="right").astype(np.int32))

    ranged = table(rows.withColumn("part", range_of("hi", "lo")))
    # Rows before each range within its shard: as many numbers as there are ranges.
    sizes = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}
    places, shard, slot = [], 0, 0
    for part in range(len(bounds) + 1):
        while shard < len(cuts) and part > 0 and bounds[part - 1] >= cuts[shard]:
            shard, slot = shard + 1, 0
        places.append((part, shard, slot))
        slot += sizes.get(part, 0)
    where = rows.sparkSession.createDataFrame(places, "part int, shard int, before long")
    order = F.row_number().over(_by_key())
    cut = sorted({(k >> 64) for k in cuts if (k - LOW) % (1 << 64)})  # hashes of texts in two shards: fewer than shards
    return (
        ranged.withColumn("_row", order)
        .join(F.broadcast(where), "part")
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("_row") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("hi").isin(cut).alias("text_cut"))
    )


def _by_key():
    from pyspark.sql import Window

    return Window.partitionBy("part").orderBy("hi", "lo", "size")


def shard_column(places: DataFrame) -> Column:
    """The folder name of a document's shard, for writers that partition by it."""
    return F.format_string("shard-%05d", places["shard"])
