"""SimHash near-duplicates: fingerprints, and the links between them by the generalised pigeonhole principle.

Fingerprints of 64 bits link at tau or fewer differing bits. Correlated bits are grouped into m partitions.
If thresholds T_1..T_m add up to tau - m + 1, two linked fingerprints differ by at most T_i in some partition
i. Every fingerprint is indexed by each partition's exact value, and probes the values within T_i of its own;
its T_i are its own, allocated by dynamic programming on the candidates that each choice is estimated to give
and on the probes that it costs. The estimates come from counts of 16-bit blocks over all fingerprints (a
fixed size). A bucket's members are verified where they meet, and only a spanning forest of their links leaves
it, so a dense group never becomes all its pairs. A bucket of very many rows is not gathered but taken apart by the bits
that its partition does not hold, exactly. Components follow by large-star and small-star rounds.

Defined cases: null and empty texts (no words) have fingerprint zero and link like any other; fewer words than
a shingle holds give one shingle; whole texts are read, a slice of shingles at a time; equal fingerprints are
one node, so copies cost nothing; repeated ids share a component; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kanaforge.llm.common import packed, remember, table, utf8_values
from kanaforge.llm.graph import components

BITS = 64
#: Fixed by the fingerprint's definition.
SEED = 42
WORDS, TAU = 3, 3
#: Partitions of 64 / PARTS bits. Two give buckets of 32 bits: few false candidates up to billions of fingerprints.
PARTS = 2
#: Cost of a probe row against that of one candidate check, for the allocation.
PROBE_COST = 20.0
#: Shingles hashed at a time, and rows compared at a time: memory bounds only.
CHUNK, ROWS = 1 << 16, 256
#: Rows of a bucket that are gathered; larger ones are taken apart first, with the same links.
HOT = 1 << 13
#: Near copies: sets of five-word shingles with a Jaccard similarity of 4 / 5 or more.
NEAR_WORDS, NEAR = 5, (4, 5)
#: Candidates share all minima of a band: at 0.8 all bands miss with (1 - 0.8**5)**32 = 3e-6.
BANDS, BAND_ROWS = 32, 5
#: Shingles permuted at a time: a memory bound only.
BAND_CHUNK = 1 << 12
#: Shingles of a set in one row, and about how many sets and shingles of a bucket one task holds of each side.
SET_ROW, BLOCK_SETS, BLOCK_SHINGLES = 1 << 10, 1 << 10, 1 << 20
#: Shingles of a block that are multiplied at a time: a memory bound only.
COLUMNS = 1 << 12


# -- fingerprints ------------------------------------------------------------------------------------------


def majority(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half the hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[at : at + CHUNK], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def shingle_hashes(text: bytes | None, k: int = WORDS) -> np.ndarray:
    """XXH64 of the k-word shingles of the lower-cased text, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    lasts = ends[min(k, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, lasts, strict=False)], np.uint64)


def fingerprint(text: bytes | None, k: int = WORDS) -> int:
    h = shingle_hashes(text, k)
    return majority(h) if len(h) else 0


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    h = h + np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of the shingle fingerprint."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = pa.array(np.array([fingerprint(t) for t in utf8_values(part.column(1))], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), out], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text).mapInArrow(batches, f"doc_id {kind}, fp long")


# -- generalised pigeonhole --------------------------------------------------------------------------------


@dataclass
class Plan:
    """How fingerprints are taken apart: order of bits, block counts, partitions and total threshold."""

    order: np.ndarray  # bits, partition after partition
    blocks: np.ndarray  # counts of each 16-bit block's values, 4 x 65536
    total: int
    parts: int
    tau: int

    def permuted(self, fps: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(np.ascontiguousarray(fps, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return np.ascontiguousarray(np.packbits(bits[:, self.order], axis=1, bitorder="little")).view("<u8").ravel()


def bit_moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and in how many each pair of bits is set: 64 x 64 sums over all."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for part in parts:
            x = np.unpackbits(part.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += x.T @ x
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["n", "sums"])

    rows = fps.select("fp").mapInArrow(count, "n long, sums array<double>")
    summed = rows.select("n", F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("s"), F.sum("n").alias("n")).collect()
    both, n = np.zeros(BITS * BITS), 0
    for r in summed:
        both[r["pos"]], n = r["s"], r["n"]
    return n, both.reshape(BITS, BITS)


def correlated_order(n: int, both: np.ndarray, parts: int) -> np.ndarray:
    """Bits ordered so that each partition gathers the bits that correlate most: seed, then greedily the closest."""
    mean = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    close = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(close, 0)
    left, order = set(range(BITS)), []
    for part in range(parts):
        size = BITS * (part + 1) // parts - BITS * part // parts
        seed = max(left, key=lambda b: (round(close[b, sorted(left)].sum(), 9), -b))
        group = [seed]
        left.remove(seed)
        while len(group) < size:
            best = max(left, key=lambda b: (round(close[b, group].sum(), 9), -b))
            group.append(best)
            left.remove(best)
        order += sorted(group)
    return np.array(order)


def block_counts(fps: DataFrame, order: np.ndarray) -> np.ndarray:
    """Counts of the values of the four 16-bit blocks, over all fingerprints: 4 x 65536 numbers at any size."""
    plan = Plan(order, np.zeros(0), 0, 0, 0)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4 << 16, np.int64)
        for part in parts:
            blocks = plan.permuted(part.column(0).to_numpy(zero_copy_only=False).view(np.uint64)).view("<u2").reshape(-1, 4)
            for b in range(4):
                total[b << 16 : (b + 1) << 16] += np.bincount(blocks[:, b], minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "n"])

    got = fps.select("fp").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(4 << 16, np.int64)
    out[got["at"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(4, 1 << 16)


def ball_shares(blocks: np.ndarray, total: int, tau: int) -> np.ndarray:
    """Share of fingerprints whose block is at exactly 0..tau bits from each value: 4 x (tau+1) x 65536."""
    out = np.zeros((4, tau + 1, 1 << 16), np.float32)
    at = np.arange(1 << 16)
    for e in range(tau + 1):
        for bits in combinations(range(16), e):
            out[:, e] += blocks[:, at ^ sum(1 << b for b in bits)]
    return out / max(total, 1)


def ball(width: int, e: int) -> list[int]:
    """All masks of a partition with at most e bits set."""
    return [sum(1 << b for b in bits) for k in range(e + 1) for bits in combinations(range(width), k)] if e >= 0 else []


def estimates(plan: Plan, shares: np.ndarray, permuted: np.ndarray) -> np.ndarray:
    """Estimated candidates of each query for each partition and threshold 0..tau, blocks taken as independent."""
    per, out = 4 // plan.parts, []
    values = permuted.view("<u2").reshape(-1, 4)
    for p in range(plan.parts):
        at = np.zeros((len(permuted), plan.tau + 1))
        at[:, 0] = 1
        for b in range(p * per, (p + 1) * per):
            here, new = shares[b][:, values[:, b]].T, np.zeros_like(at)
            for e in range(plan.tau + 1):
                for d in range(e + 1):
                    new[:, e] += at[:, e - d] * here[:, d]
            at = new
        out.append(np.cumsum(at, 1) * plan.total)
    return np.stack(out, 1)


def allocate(plan: Plan, candidates: np.ndarray) -> np.ndarray:
    """Thresholds of each query (-1: partition not probed) that add up to tau - parts + 1 at the least cost."""
    width, parts, tau = BITS // plan.parts, plan.parts, plan.tau
    n = len(candidates)
    probes = np.array([0.0] + [PROBE_COST * len(ball(width, e)) for e in range(tau + 1)])
    if tau and parts > 1:  # very many candidates are not checked one by one, but taken apart (hot_links)
        ways = comb(2 * tau, tau)
        candidates = np.minimum(candidates, ways * PROBE_COST + candidates * ways / 2.0 ** ((BITS - width) // 2))
    cost = np.concatenate([np.zeros((n, parts, 1)), candidates], 2) + probes  # thresholds -1..tau
    top = tau + 1  # thresholds plus one add up to tau + 1
    best, choice = np.full((n, top + 1), np.inf), []
    best[:, 0] = 0
    for p in range(parts):
        new, pick = np.full((n, top + 1), np.inf), np.zeros((n, top + 1), np.int8)
        for used in range(top + 1):
            for t in range(used + 1):
                c = best[:, used - t] + cost[:, p, t]
                better = c < new[:, used]
                new[better, used], pick[better, used] = c[better], t
        best = new
        choice.append(pick)
    out, used = np.zeros((n, parts), np.int64), np.full(n, top)
    for p in reversed(range(parts)):
        t = choice[p][np.arange(n), used]
        out[:, p] = t - 1
        used = used - t
    return out


def bucket_rows(nodes: DataFrame, plan: Plan) -> DataFrame:
    """(bucket, probe, fp, rep) of every index entry and probe of every node (fp, rep)."""
    spark = nodes.sparkSession
    sent = spark.sparkContext.broadcast((plan, ball_shares(plan.blocks, plan.total, plan.tau)))

    def expand(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, shares = sent.value
        width = BITS // plan.parts
        masks = [[np.array(ball(width, e), np.uint64) for e in range(-1, plan.tau + 1)] for _ in range(plan.parts)]
        low = np.uint64((1 << width) - 1)
        for part in parts:
            for at in range(0, part.num_rows, 4096):
                piece = part.slice(at, 4096)
                fp, rep = piece.column(0).to_numpy(zero_copy_only=False), piece.column(1).to_numpy(zero_copy_only=False)
                turned = plan.permuted(fp.view(np.uint64))
                limits = allocate(plan, estimates(plan, shares, turned))
                keys, probe, who = [], [], []
                everyone = np.arange(len(fp))
                for p in range(plan.parts):
                    value = (turned >> np.uint64(p * width)) & low
                    top = np.uint64(p << width) if width < 64 else np.uint64(0)
                    keys.append(value | top)
                    probe.append(np.zeros(len(fp), bool))
                    who.append(everyone)
                    for t in range(plan.tau + 1):
                        ask = np.flatnonzero(limits[:, p] == t)
                        if len(ask):
                            m = masks[p][t + 1]
                            keys.append(((value[ask][:, None] ^ m) | top).ravel())
                            probe.append(np.ones(len(ask) * len(m), bool))
                            who.append(np.repeat(ask, len(m)))
                who = np.concatenate(who)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(probe)), pa.array(fp[who]), pa.array(rep[who])], ["bucket", "probe", "fp", "rep"])

    return nodes.select("fp", "rep").mapInArrow(expand, "bucket long, probe boolean, fp long, rep long")


def forest(fp: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (tau bits or fewer) among distinct fingerprints, as two index arrays."""
    left, a, b = np.arange(len(fp)), [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            reached = []
            for at in range(0, len(front), ROWS):
                some = front[at : at + ROWS]
                near = np.bitwise_count(fp[some][:, None] ^ fp[left]) <= tau
                hit = near.any(0)
                a.append(some[near[:, hit].argmax(0)])
                b.append(left[hit])
                reached.append(left[hit])
                left = left[~hit]
            front = np.concatenate(reached)
    return np.concatenate([*a, np.zeros(0, int)]).astype(int), np.concatenate([*b, np.zeros(0, int)]).astype(int)


def _solved(bucket: np.ndarray, fp: np.ndarray, rep: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """(u, v) of the spanning forests of the buckets; rows lie together by bucket."""
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    mixed = np.minimum.reduceat(fp, starts) != np.maximum.reduceat(fp, starts)
    ends = np.append(starts[1:], len(bucket))
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s, e in zip(starts[mixed].tolist(), ends[mixed].tolist(), strict=True):
        own, first = np.unique(fp[s:e], return_index=True)
        names = rep[s:e][first]
        a, b = forest(own, tau)
        us.append(names[a])
        vs.append(names[b])
    return np.concatenate(us), np.concatenate(vs)


def bucket_links(rows: DataFrame, plan: Plan, hot: int = HOT) -> DataFrame:
    """(u, v): representatives of linked fingerprints that met in a bucket with an index entry.

    Rows arrive by bucket, index entries first; a bucket that starts with a probe has none and is dropped. Two members of a bucket link whichever of them is indexed, so all distinct
    fingerprints of a bucket are compared, and a spanning forest of the links is kept. A bucket of more than `hot`
    rows is not gathered: its rows are passed on, taken apart by the bits that its partition does not hold, and
    meet again in many small buckets."""
    tau = plan.tau

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []
        size, passing, skipping = 0, None, None  # the buckets whose further rows are passed on, or dropped

        def links(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            none = pa.nulls(len(u), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), none, none], ["u", "v", "bucket", "fp"])

        def passed(bucket: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rep), pa.nulls(len(rep), pa.int64()), pa.array(bucket), pa.array(fp)], ["u", "v", "bucket", "fp"])

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal kept, size, passing, skipping
            if not kept:
                return
            bucket, probe, fp, rep = (np.concatenate(x) for x in zip(*kept, strict=True))
            if passing is not None and (going := bucket == passing).any():
                yield passed(bucket[going], fp[going], rep[going])
                bucket, probe, fp, rep = bucket[~going], probe[~going], fp[~going], rep[~going]
            goes_on = None
            if len(bucket):
                starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                sizes = np.diff(np.append(starts, len(bucket)))
                asked = probe[starts] | (bucket[starts] == skipping)  # its first row is no index entry, so none is
                many = ~asked & (sizes > hot)
                for i in np.flatnonzero(many).tolist():
                    a, z = starts[i], starts[i] + sizes[i]
                    yield passed(bucket[a:z], fp[a:z], rep[a:z])
                skipping = bucket[-1] if asked[-1] else skipping
                passing = bucket[-1] if many[-1] else passing
                goes_on = bucket[-1] if not last and not asked[-1] and not many[-1] else None
                small = np.repeat(~asked & ~many, sizes)
                bucket, probe, fp, rep = bucket[small], probe[small], fp[small], rep[small]
            cut = len(bucket) if goes_on is None else int(np.searchsorted(bucket, goes_on))
            if cut:
                yield links(*_solved(bucket[:cut], fp[:cut].view(np.uint64), rep[:cut], tau))
            kept = [[x[cut:] for x in (bucket, probe, fp, rep)]] if cut < len(bucket) else []
            size = len(bucket) - cut

        for part in parts:
            kept.append([part.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
            size += part.num_rows
            if size >= max(hot, 1 << 17):
                yield from flush(False)
        yield from flush(True)

    met = table(rows.repartition("bucket").sortWithinPartitions("bucket", "probe").mapInArrow(batches, "u long, v long, bucket long, fp long"))
    return met.where("bucket IS NULL").select("u", "v").unionByName(hot_links(met.where("bucket IS NOT NULL").select("bucket", "fp", F.col("u").alias("rep")), plan))


def hot_links(rows: DataFrame, plan: Plan) -> DataFrame:
    """(u, v) of buckets (bucket, fp, rep) that hold very many fingerprints.

    The bits outside of the bucket's partition are cut into 2 tau blocks. Linked fingerprints differ in tau blocks at
    most, so they agree in tau others: they meet under one of the choices of tau blocks, with their values. What meets
    there agrees in half of those bits besides its partition's, so no such bucket is large."""
    sent, tau, width = rows.sparkSession.sparkContext.broadcast(plan), plan.tau, BITS // plan.parts

    def expand(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, low = sent.value, (1 << width) - 1
        masks = []
        for p in range(plan.parts):
            bits = [b for b in range(BITS) if not p * width <= b < (p + 1) * width]
            blocks = [bits[len(bits) * i // (2 * tau) : len(bits) * (i + 1) // (2 * tau)] for i in range(2 * tau)]
            masks.append([np.uint64(sum(1 << b for block in some for b in block)) for some in combinations(blocks, tau)])
        for part in parts:
            for at in range(0, part.num_rows, 4096):
                bucket, fp, rep = (part.column(i).slice(at, 4096).to_numpy(zero_copy_only=False) for i in range(3))
                turned = plan.permuted(fp.view(np.uint64))
                kind = (bucket.view(np.uint64) >> np.uint64(width)).astype(np.int64) if width < BITS else np.zeros(len(bucket), np.int64)
                for p in np.unique(kind).tolist():
                    own = np.flatnonzero(kind == p)
                    for i, mask in enumerate(masks[p]):
                        key = _mix((turned[own] & mask) ^ _mix(bucket[own].view(np.uint64), 5), 7 + i)
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp[own]), pa.array(rep[own])], ["key", "fp", "rep"])

    def solve(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 3
        for part in parts:
            key, fp, rep = (np.concatenate([r, part.column(i).to_numpy(zero_copy_only=False)]) for i, r in enumerate(rest))
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if cut:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _solved(key[:cut], fp[:cut].view(np.uint64), rep[:cut], tau)], ["u", "v"])
            rest = [x[cut:] for x in (key, fp, rep)]
        if len(rest[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _solved(rest[0], rest[1].view(np.uint64), rest[2], tau)], ["u", "v"])

    if tau == 0:  # different fingerprints never link
        return rows.where(F.lit(False)).select(F.col("rep").alias("u"), F.col("rep").alias("v"))
    taken = rows.distinct().mapInArrow(expand, "key long, fp long, rep long")
    return taken.repartition("key").sortWithinPartitions("key").mapInArrow(solve, "u long, v long")


def linked(nodes: DataFrame, tau: int = TAU, parts: int = PARTS) -> DataFrame:
    """(u, v) links that connect the nodes (fp, rep) wherever fingerprints link; nodes has distinct fps."""
    n, both = bit_moments(nodes)
    order = correlated_order(n, both, parts)
    plan = Plan(order, block_counts(nodes, order), n, parts, tau)
    return bucket_links(bucket_rows(nodes, plan), plan)


def near_duplicates(docs: DataFrame, tau: int = TAU, parts: int = PARTS) -> DataFrame:
    """(doc_id, fp, component_id): the class of each document is the smallest doc_id that links reach."""
    prints = table(fingerprints(docs))
    nodes = table(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(linked(nodes.where("rep is not null"), tau, parts))
    named = table(nodes.join(found, nodes["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id")))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


# -- near copies by exact similarity -----------------------------------------------------------------------


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles of NEAR_WORDS words; empty for a text without words."""
    return np.unique(shingle_hashes(text, NEAR_WORDS))


def set_name(shingles: np.ndarray) -> int:
    """One number for equal sets."""
    return xxhash.xxh64_intdigest(np.ascontiguousarray(shingles, "<u8").tobytes(), SEED)


_FLIPS = _mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64), 1)[:, None]
_TURNS = _mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64), 2)[:, None] | np.uint64(1)


def bands(shingles: np.ndarray) -> np.ndarray:
    """A key for each band: the minima of BAND_ROWS permutations of the whole set."""
    least = np.full(BANDS * BAND_ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), BAND_CHUNK):
        least = np.minimum(least, ((shingles[at : at + BAND_CHUNK] ^ _FLIPS) * _TURNS).min(1))
    rows, key = least.reshape(BANDS, BAND_ROWS), np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(BAND_ROWS):
        key = _mix(key ^ rows[:, i], 3)
    return key


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, t, own, n, fp, bands): a hash of each document's text; name, size, fingerprint and band keys of its shingle set."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember()
        for part in parts:
            own, sizes, prints, keys = [], [], [], []
            for text in utf8_values(part.column(1)):
                found = shingle_set(text)
                own.append(set_name(found))
                sizes.append(len(found))
                prints.append(majority(found) if len(found) else 0)
                keys.append(bands(found).view(np.int64) if len(found) else np.zeros(0, np.int64))
            own, prints = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (own, prints))
            out = [part.column(0), part.column(2), own, pa.array(sizes, pa.int64()), prints, pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "t", "own", "n", "fp", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("t")).mapInArrow(batches, f"doc_id {kind}, t long, own long, n long, fp long, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(own, part, shingles) of the set of each row of docs: at most SET_ROW shingles in a row, so long texts make many rows."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, ROWS):
                own, piece, found = [], [], []
                for text in utf8_values(part.column(0).slice(at, ROWS)):
                    whole = shingle_set(text)
                    cuts = range(0, len(whole), SET_ROW)
                    own += [set_name(whole)] * len(cuts)
                    piece += range(len(cuts))
                    found += [whole[c : c + SET_ROW].view(np.int64) for c in cuts]
                names = pa.array(np.array(own, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([names, pa.array(piece, pa.int32()), pa.array(found, pa.list_(pa.int64()))], ["own", "part", "shingles"])

    return docs.select("text").mapInArrow(batches, "own long, part int, shingles array<long>")


def spanning(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of a symmetric matrix of links, as two index arrays."""
    left, a, b = np.flatnonzero(near.any(0)), [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            met = near[np.ix_(front, left)]
            hit = met.any(0)
            a.append(front[met[:, hit].argmax(0)])
            b.append(left[hit])
            front, left = left[hit], left[~hit]
    return np.concatenate([*a, np.zeros(0, int)]).astype(int), np.concatenate([*b, np.zeros(0, int)]).astype(int)


def near_forest(own: np.ndarray, side: np.ndarray, lengths: np.ndarray, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(u, v): a spanning forest of the pairs of sets with a Jaccard similarity of NEAR or more, in whole numbers.

    own, side and lengths belong to pieces of sets, whose shingles lie one after another. Where there are two sides,
    only pairs across them count. Common shingles are counted by products of 0/1 matrices, COLUMNS shingles at a time."""
    names, first, row = np.unique(own, return_index=True, return_inverse=True)
    if len(names) < 2:
        return names[:0], names[:0]
    owner = np.repeat(row, lengths)
    size = np.bincount(owner, minlength=len(names))
    order = np.argsort(shingles)
    ordered, owner = shingles[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    times = np.diff(np.append(starts, len(ordered)))
    shared = times > 1  # others are in no intersection
    column = np.repeat(np.where(shared, np.cumsum(shared) - 1, -1), times)
    owner, column = owner[column >= 0], column[column >= 0]
    both = np.zeros((len(names), len(names)), np.int64)
    for at in range(0, int(shared.sum()), COLUMNS):
        low, high = np.searchsorted(column, [at, at + COLUMNS])
        ones = np.zeros((len(names), int(column[high - 1]) - at + 1), np.float32)
        ones[owner[low:high], column[low:high] - at] = 1
        both += (ones @ ones.T).astype(np.int64)
    top, under = NEAR
    near = both * (top + under) >= top * (size[:, None] + size)
    np.fill_diagonal(near, False)
    sides = side[first]
    if sides.min() != sides.max():
        near &= sides[:, None] != sides
    a, b = spanning(near)
    return names[a], names[b]


def blocks(members: DataFrame) -> DataFrame:
    """(bucket, i, j, side, own) of members (bucket, own, n, component): where each set meets the others of its bucket.

    A bucket that one task can hold is one block (0, 0). Another is cut into numbered blocks, and every pair of them
    is a place of its own. The bucket's largest component has blocks of its own, which do not meet each other."""
    count = lambda m, w: F.greatest(F.ceil(m / BLOCK_SETS), F.ceil(w / BLOCK_SHINGLES)).cast("int")
    large = members.groupBy("bucket").agg(F.count("*").alias("m"), F.sum("n").alias("w")).where(count(F.col("m"), F.col("w")) > 1)
    groups = members.join(large.select("bucket"), "bucket", "left_semi").groupBy("bucket", "component").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    whole = groups.groupBy("bucket").agg(F.max(F.struct("m", "w", "component")).alias("top"), F.sum("m").alias("m"), F.sum("w").alias("w"))
    cut = whole.select(
        "bucket",
        F.col("top.component").alias("main"),
        count(F.col("top.m"), F.col("top.w")).alias("k"),
        count(F.col("m") - F.col("top.m"), F.col("w") - F.col("top.w")).alias("others"),
    )
    placed = members.join(cut, "bucket", "left")
    spread = F.xxhash64("own", F.lit(1))
    main = F.col("component") == F.col("main")
    side = F.when(F.col("main").isNull(), 0).when(main, F.pmod(spread, F.col("k"))).otherwise(F.col("k") + F.pmod(spread, F.col("others"))).cast("int")
    last = F.col("k") + F.col("others") - 1
    meets = F.when(F.col("main").isNull(), F.array(F.lit(0))).when(main, F.sequence("k", last)).otherwise(F.sequence(F.lit(0), last))
    sent = placed.select("bucket", "own", side.alias("side"), F.explode(meets).alias("other"))
    return sent.select("bucket", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "own")


def verified(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): in each bucket of members (bucket, own, n, component), links between the sets that have a Jaccard similarity
    of NEAR or more. They are verified where they meet, and only a spanning forest of them leaves a block."""

    def solve(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for part in parts:
            rest = yield from flush(part if rest is None else pa.concat_batches([rest, part]), False)
        if rest is not None:
            yield from flush(rest, True)

    def flush(rows: pa.RecordBatch, last: bool) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows:
            return rows
        keys = [rows.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        side, own = (rows.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
        starts = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], 0)]))
        ends = np.append(starts[1:], len(own))
        lists = rows.column(5)
        shingles, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy(zero_copy_only=False)
        lengths = np.diff(offsets)
        done = len(starts) if last else len(starts) - 1
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, e in zip(starts[:done].tolist(), ends[:done].tolist(), strict=True):
            u, v = near_forest(own[s:e], side[s:e], lengths[s:e], shingles[offsets[s] : offsets[e]])
            us.append(u)
            vs.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])
        return rows.slice(rows.num_rows if last else int(starts[-1]))

    met = blocks(members).join(sets, "own").select("bucket", "i", "j", "side", "own", "shingles")
    return met.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(solve, "u long, v long").distinct()


def print_pairs(nodes: DataFrame) -> DataFrame:
    """(u, v): sets (own, n, fp) whose fingerprints link at TAU bits or fewer, by the generalised pigeonhole principle:
    links that connect all of them, and each set with the first of those that have its fingerprint."""
    firsts = table(nodes.groupBy("fp").agg(F.min("own").alias("rep")))
    same = nodes.select("own", "fp").join(firsts, "fp").where("own <> rep").select(F.col("rep").alias("u"), F.col("own").alias("v"))
    across = linked(firsts).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return same.unionByName(across).distinct()


def near_links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v): links between sets (own, n, rep, fp, bands) that connect those which have linked fingerprints or share a
    bucket, and a similarity of NEAR or more.

    First come the links of the fingerprints, verified. The buckets of the bands serve for what these leave apart: of the
    buckets whose members are not connected yet, one of each list of members is verified, whole."""

    def sets_of(some: DataFrame) -> DataFrame:
        # ids and names only are exchanged for this choice; texts only of documents that have a candidate
        wanted = nodes.join(some.select("own").distinct(), "own", "left_semi").select("own", F.col("rep").alias("doc_id"))
        picked = shingle_sets(docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi"))
        return table(picked.join(wanted.select("own"), "own", "left_semi").dropDuplicates(["own", "part"]))

    pairs = table(print_pairs(nodes)).withColumn("bucket", F.xxhash64("u", "v"))
    ends = pairs.select("bucket", F.explode(F.array("u", "v")).alias("own"))
    ends = table(ends.join(nodes.select("own", "n"), "own").withColumn("component", F.col("own")))
    links = table(verified(ends, sets_of(ends)))
    found = components(links).withColumnRenamed("node", "own")
    named = table(nodes.join(found, "own", "left").select("own", "n", F.coalesce("component", "own").alias("component"), "bands"))
    entries = named.select("own", "n", "component", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket")
    met = table(entries.join(shared, "bucket"))
    listed = met.groupBy("bucket").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("own", F.lit(2))).alias("x"), F.bit_xor(F.xxhash64("own", F.lit(3))).alias("y"))
    once = listed.groupBy("m", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket")
    rest = table(met.join(once, "bucket", "left_semi").select("bucket", "own", "n", "component"))
    return links.unionByName(verified(rest, sets_of(rest)))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate group, with all columns of docs: of its smallest doc_id the text with the
    smallest set name, then hash. Rows without an id stay. Where an id has several texts, each is a document of its own; of rows with the
    same id and text one stays.

    Two documents link if their sets of five-word shingles have a Jaccard similarity of 0.8 or more, which is
    verified on the sets. Candidates are SimHash fingerprints of the sets at TAU bits or fewer, found and connected as
    near_duplicates() does. At 0.8 fingerprints differ in about 10 bits, with a spread of 3, too many for any
    pigeonhole; so sets that are not connected by then are also candidates if they share the minima of a band. How a copy was edited does
    not matter to a minimum, only the similarity does: a pair at 0.8 is missed with a probability of 3e-6, one above
    with less. Texts without words are one group."""
    prints = table(sketches(docs.where("doc_id is not null")))
    nodes = table(prints.groupBy("own").agg(F.first("n").alias("n"), F.min("doc_id").alias("rep"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    found = components(table(near_links(docs, nodes))).withColumnRenamed("node", "own")
    grouped = nodes.select("own", "rep").join(found, "own", "left").withColumn("component", F.coalesce("component", "own"))
    best = grouped.groupBy("component").agg(F.min(F.struct("rep", "own")).alias("best")).select(F.col("best.rep").alias("doc_id"), F.col("best.own").alias("own"))
    stays = prints.select("doc_id", "own", "t").join(best, ["doc_id", "own"]).groupBy("doc_id", "own").agg(F.min("t").alias("t")).select("doc_id", "t")
    gone = prints.select("doc_id", "t").distinct().join(stays, ["doc_id", "t"], "left_anti").select(F.col("doc_id").alias("_gone"), F.col("t").alias("_t2"))
    rows = docs.select(packed(docs).alias("row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_t"), F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("_own"))
    kept = rows.join(table(gone), (F.col("_id") == F.col("_gone")) & (F.col("_t") == F.col("_t2")), "left_anti").dropDuplicates(["_id", "_t", "_own"])
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
