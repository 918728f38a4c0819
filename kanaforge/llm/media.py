"""Media columns: ISO media containers walked box by box, payloads never decoded.

A container's nested boxes are read from their headers; the sample tables (stts, stsc, stsz or stz2, stco or co64,
stss) give, for each track, its kind, codec, duration and the byte range and time of every key frame. wrap() stores bytes losslessly as such a
container: one track of 8-bit samples in access units of 64, every 16th a sync unit, in chunks.

Defined cases: a null container has null info; bytes that are no container, a truncated one, one without tracks
and a fragmented one get a status that says so and no key frames, and so do tables whose counts, sizes, offsets or times do not
fit into the file, before anything of that size is allocated, and boxes nested deeper than DEEPEST; sizes of 64 bits and boxes that run to the
end are read; a track without stss has a key frame at every sample; a null text is wrapped like an empty one;
equal bytes give equal containers.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from kanaforge.llm.common import SLICE_ROWS, utf8_values

#: Bytes of an access unit, units between sync units, units of a chunk, samples a second.
UNIT, SYNC_EVERY, CHUNK_UNITS, RATE = 64, 16, 64, 8000
#: Boxes inside boxes, at most; files have about eight levels.
DEEPEST = 64
#: Bytes of containers that a worker hands over at once.
HANDED = 64 << 20
#: Boxes that hold boxes, as the format names them.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}

TRACK = "struct<kind:string,codec:string,timescale:bigint,duration:bigint,samples:bigint,keyframes:array<struct<start:bigint,length:bigint,time:bigint>>>"
INFO = f"struct<status:string,media_bytes:bigint,tracks:array<{TRACK}>>"


# -- writing -----------------------------------------------------------------------------------------------


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def ints(*values: int) -> bytes:
    return struct.pack(f">{len(values)}I", *values)


MATRIX = ints(0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def padded(data: bytes) -> bytes:
    """data with bytes 0 up to a positive multiple of the unit."""
    return data + bytes(-len(data) % UNIT or (UNIT if not data else 0))


def wrap(data: bytes) -> bytes:
    """A container whose media data is data, padded to whole units."""
    payload = padded(data)
    units = len(payload) // UNIT
    chunks = -(-units // CHUNK_UNITS)
    last = units - (chunks - 1) * CHUNK_UNITS
    runs = [(1, CHUNK_UNITS, 1)] if chunks > 1 or last == CHUNK_UNITS else [(1, last, 1)]
    if chunks > 1 and last != CHUNK_UNITS:
        runs.append((chunks, last, 1))
    wide = len(payload) + (1 << 20) > 0xFFFFFFFF
    ticks = units * UNIT
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    sync = np.arange(1, units + 1, SYNC_EVERY, dtype=">u4")
    head = box(b"ftyp", b"isom", ints(512), b"isomiso2")

    def moov(first: int) -> bytes:
        at = first + np.arange(chunks, dtype=np.int64) * (CHUNK_UNITS * UNIT)
        offsets = full(b"co64", ints(chunks), at.astype(">u8").tobytes()) if wide else full(b"stco", ints(chunks), at.astype(">u4").tobytes())
        times = (ints(0, 0), ints(RATE)) if ticks < 1 << 32 else (struct.pack(">QQ", 0, 0), ints(RATE))
        v = int(ticks >= 1 << 32)
        span = struct.pack(">Q" if v else ">I", ticks)
        table = box(
            b"stbl",
            full(b"stsd", ints(1), entry),
            full(b"stts", ints(1, units, UNIT)),
            full(b"stsc", ints(len(runs)), *(ints(*r) for r in runs)),
            full(b"stsz", ints(UNIT, units)),
            full(b"stss", ints(len(sync)), sync.tobytes()),
            offsets,
        )
        media = box(
            b"mdia",
            full(b"mdhd", *times, span, struct.pack(">HH", 0x55C4, 0), version=v),
            full(b"hdlr", ints(0), b"soun", bytes(12), b"\0"),
            box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", ints(1), full(b"url ", flags=1))), table),
        )
        track = full(b"tkhd", times[0], ints(1, 0), span, bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), MATRIX, ints(0, 0), version=v, flags=3)
        movie = full(b"mvhd", *times, span, ints(0x10000), struct.pack(">H", 0x100), bytes(10), MATRIX, bytes(24), ints(2), version=v)
        return box(b"moov", movie, box(b"trak", track, media))

    mdat = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if wide else struct.pack(">I4s", len(payload) + 8, b"mdat")
    size = len(head) + len(moov(0)) + len(mdat)
    return b"".join([head, moov(size), mdat, payload])


# -- reading -----------------------------------------------------------------------------------------------


class Broken(ValueError):
    pass


@dataclass
class Track:
    kind: str = ""  # `vide`, `soun` and so on, as the handler names it
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    count: int = 0
    sizes: np.ndarray | int = 0  # of each sample, or of all
    runs: np.ndarray = field(default_factory=lambda: np.zeros((0, 3), np.int64))  # first chunk, samples of a chunk
    chunks: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sync: np.ndarray | None = None
    times: np.ndarray | None = None  # samples, ticks of each

    def ranges(self) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) of every sample that the chunks hold."""
        n = self.count
        if not n or not len(self.chunks) or not len(self.runs):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        spans = np.diff(np.append(self.runs[:, 0], len(self.chunks) + 1)).clip(0, len(self.chunks))
        per = np.repeat(self.runs[:, 1], spans)[: len(self.chunks)]
        ends = np.cumsum(per)
        n = min(n, int(ends[-1])) if len(ends) else 0
        sizes = np.full(n, self.sizes, np.int64) if np.isscalar(self.sizes) else self.sizes[:n]
        chunk = np.searchsorted(ends, np.arange(n), side="right")
        before = np.cumsum(sizes) - sizes
        firsts = np.minimum((ends - per)[chunk], max(n - 1, 0))
        return self.chunks[chunk] + before - before[firsts], sizes

    def check(self, size: int) -> None:
        """Refuse tables that cannot belong to a file of so many bytes."""
        total = self.count * self.sizes if np.isscalar(self.sizes) else int(self.sizes.sum())
        if total > size or np.isscalar(self.sizes) and self.count and not self.sizes:
            raise Broken("malformed")
        if len(self.runs) and (self.runs[0, 0] < 1 or (np.diff(self.runs[:, 0]) <= 0).any() or self.runs[-1, 0] > max(len(self.chunks), 1)):
            raise Broken("malformed")
        if len(self.chunks) and (int(self.chunks.min()) < 0 or int(self.chunks.max()) > size) or len(self.runs) and int(self.runs[:, 1].min()) < 0:
            raise Broken("malformed")
        if self.times is not None and int(self.times[:, 0].sum()) < self.count:
            raise Broken("malformed")
        start, length = self.ranges()
        if len(start) and (int(start.min()) < 0 or int((start + length).max()) > size):
            raise Broken("malformed")

    def keyframes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, time) of every key frame; times in ticks, 0 where the file tells none."""
        start, length = self.ranges()
        at = np.arange(len(start)) if self.sync is None else self.sync[(self.sync >= 1) & (self.sync <= len(start))] - 1
        return start[at], length[at], self.time_of(at)

    def time_of(self, at: np.ndarray) -> np.ndarray:
        """When samples are decoded: the run of equal steps that each lies in, and its place there."""
        if self.times is None or not len(self.times):
            return np.zeros(len(at), np.int64)
        ends = np.cumsum(self.times[:, 0])
        begins = np.cumsum(self.times[:, 0] * self.times[:, 1]) - self.times[:, 0] * self.times[:, 1]
        run = np.searchsorted(ends, at, side="right")
        return begins[run] + (at - (ends - self.times[:, 0])[run]) * self.times[run, 1]


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, body start, body end) of the boxes side by side."""
    at = start
    while at < end:
        if at + 8 > end:
            raise Broken("truncated")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if body + 8 > end:
                raise Broken("truncated")
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        elif size == 0:
            size = end - at
        if kind == b"uuid":
            body += 16
        if size < body - at or at + size > end:
            raise Broken("truncated" if at + size > end else "malformed")
        yield kind, body, at + size
        at += size


def numbers(data: memoryview, at: int, end: int, count: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    if count < 0 or at + count * width > end:
        raise Broken("malformed")
    return np.frombuffer(data, kind, count, at).astype(np.int64)


def read_table(track: Track, kind: bytes, data: memoryview, at: int, end: int) -> None:
    if kind == b"mdhd":
        wide = data[at] == 1
        track.timescale, track.duration = struct.unpack_from(">IQ" if wide else ">II", data, at + (20 if wide else 12))
    elif kind == b"hdlr":
        track.kind = bytes(data[at + 8 : at + 12]).decode("latin-1")
    elif kind == b"stsd":
        track.codec = bytes(data[at + 12 : at + 16]).decode("latin-1") if struct.unpack_from(">I", data, at + 4)[0] else ""
    elif kind == b"stsz":
        size, track.count = struct.unpack_from(">II", data, at + 4)
        track.sizes = size or numbers(data, at + 12, end, track.count, ">u4")
    elif kind == b"stz2":
        bits, track.count = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
        if bits == 4:
            two = numbers(data, at + 12, end, (track.count + 1) // 2, "u1")
            track.sizes = np.stack([two >> 4, two & 15], 1).ravel()[: track.count]
        else:
            track.sizes = numbers(data, at + 12, end, track.count, "u1" if bits == 8 else ">u2")
    elif kind in (b"stco", b"co64"):
        track.chunks = numbers(data, at + 8, end, struct.unpack_from(">I", data, at + 4)[0], ">u4" if kind == b"stco" else ">u8")
    elif kind == b"stsc":
        track.runs = numbers(data, at + 8, end, 3 * struct.unpack_from(">I", data, at + 4)[0], ">u4").reshape(-1, 3)
    elif kind == b"stts":
        track.times = numbers(data, at + 8, end, 2 * struct.unpack_from(">I", data, at + 4)[0], ">u4").reshape(-1, 2)
    elif kind == b"stss":
        track.sync = numbers(data, at + 8, end, struct.unpack_from(">I", data, at + 4)[0], ">u4")


def walk(content: bytes) -> tuple[str, list[Track]]:
    """Status (`ok`, `not_iso`, `truncated`, `malformed`, `no_track`, `fragmented`) and the tracks."""
    data, tracks, seen = memoryview(content), list[Track](), set()
    todo = [(0, len(content), 0)]
    try:
        while todo:
            start, end, depth = todo.pop()
            inner = []
            for kind, at, stop in boxes(data, start, end):
                seen.add(kind)
                if depth == 0 and len(seen) == 1 and kind not in (b"ftyp", b"styp", b"moov", b"mdat", b"free", b"skip", b"wide", b"pnot"):
                    return "not_iso", []
                if kind == b"trak":
                    tracks.append(Track())
                    for k, a, z in descend(data, at, stop):
                        read_table(tracks[-1], k, data, a, z)
                    tracks[-1].check(len(content))
                elif kind in NESTED:
                    if depth >= DEEPEST:
                        raise Broken("malformed")
                    inner.append((at, stop, depth + 1))
            todo += reversed(inner)
    except (Broken, struct.error, IndexError) as e:
        return (str(e) if isinstance(e, Broken) and seen else "malformed" if seen else "not_iso"), []
    return ("ok" if tracks and b"moof" not in seen else "fragmented" if b"moof" in seen else "no_track"), tracks


def descend(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, body start, body end) of the boxes that hold no boxes, at any depth, in file order."""
    open_ = [boxes(data, start, end)]
    while open_:
        found = next(open_[-1], None)
        if found is None:
            open_.pop()
        elif found[0] not in NESTED:
            yield found
        elif len(open_) > DEEPEST:
            raise Broken("malformed")
        else:
            open_.append(boxes(data, found[1], found[2]))


def info(content: bytes | None) -> dict | None:
    """What INFO names, of every track in order; no payload byte is read."""
    if content is None:
        return None
    status, tracks = walk(content)
    out = []
    for t in tracks if status == "ok" else []:
        frames = t.keyframes()
        out.append({"kind": t.kind or None, "codec": t.codec or None, "timescale": t.timescale, "duration": t.duration, "samples": t.count, "keyframes": [{"start": int(s), "length": int(n), "time": int(at)} for s, n, at in zip(*frames, strict=True)]})
    return {"status": status, "media_bytes": len(content), "tracks": out}


def payload(content: bytes) -> bytes:
    """The samples of the first track, read through its tables."""
    _, tracks = walk(content)
    start, length = tracks[0].ranges()
    if not len(start):
        return b""
    ends = start + length
    gaps = np.flatnonzero(start[1:] != ends[:-1]) + 1  # neighbours are read at once
    firsts, lasts = np.concatenate([[0], gaps]), np.concatenate([gaps, [len(start)]]) - 1
    return b"".join(content[a:z] for a, z in zip(start[firsts].tolist(), ends[lasts].tolist(), strict=True))


# -- columns -----------------------------------------------------------------------------------------------


def _wrap(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        held, size = [], 0
        for text in utf8_values(batch):
            held.append(wrap(text or b""))
            size += len(held[-1])
            if size >= HANDED:
                yield pa.array(held, pa.binary())
                held, size = [], 0
        yield pa.array(held, pa.binary())


def _info(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    frames = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("time", pa.int64())]))
    track = pa.struct([("kind", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64()), ("keyframes", frames)])
    kind = pa.struct([("status", pa.string()), ("media_bytes", pa.int64()), ("tracks", pa.list_(track))])
    for batch in batches:
        yield pa.array([info(c) for at in range(0, len(batch), SLICE_ROWS) for c in batch.slice(at, SLICE_ROWS).to_pylist()], kind)


DIGEST = "struct<n_bytes:bigint,payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string,feature:string>"


def digest(text: bytes | None) -> tuple:
    """Store, read back, and describe one text."""
    raw = text or b""
    content = wrap(raw)
    status, tracks = walk(content)
    back = payload(content)
    start, length, time = tracks[0].keyframes()
    spans = crc32(np.stack([start, length, time], 1).astype("<i8").tobytes())
    t = tracks[0]
    feature = f"{status} {t.codec.strip()} {t.timescale} {t.duration} samples={t.count} keyframes={len(start)} first={start[0]}+{length[0]} last={start[-1]}+{length[-1]}@{time[-1]} ranges={spans:08x}"
    return len(raw), len(back), hashlib.sha256(back).hexdigest(), crc32(back[-UNIT:]), len(content), hashlib.sha256(content).hexdigest(), feature


def _digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        rows = [digest(t) for t in utf8_values(batch)]
        yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def wrap_column(text: Column | str) -> Column:
    """A text's UTF-8 bytes as a container."""
    return F.arrow_udf(_wrap, "binary")(text)


def info_column(content: Column | str) -> Column:
    """INFO of a container in a binary column."""
    return F.arrow_udf(_info, INFO)(content)


def digest_column(text: Column | str) -> Column:
    """DIGEST of a text: stored as a container, read back through its sample tables."""
    return F.arrow_udf(_digest, DIGEST)(text)
