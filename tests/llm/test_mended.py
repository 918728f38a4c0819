"""Inputs that once hung, crashed or lost rows, and an independent reader of containers."""

import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kanaforge.llm import media, quality, simhash, toxicity
from kanaforge.llm.linear import ordered


@pytest.mark.parametrize(("token", "bare"), [("a" + "!" * 40 + "a", None), ("a" + "!" * 100_000 + "a", None), ("x" + ".!?" * 50_000 + "x", None), ("***word!!!", "word"), ("(word).", "word"), ("'tis", "tis"), ("**w**", "**w**"), ("###", ""), ("a" + "#" * 100_000, "a"), ("é_!", "é_")])
def test_marks_around_a_word(token, bare):
    start = time.process_time()
    assert toxicity._EDGE(token) == (token if bare is None else bare)
    assert time.process_time() - start < 2


def test_toxicity_of_a_token_of_marks(spark):
    docs = spark.createDataFrame([(1, "a" + "!" * 50_000 + "a you idiot"), (2, "a" + "'" * 3000 + "b"), (3, "fine words")], "doc_id long, text string")
    lab = spark.createDataFrame([(3, 0), (1, 1)], "doc_id long, toxic int")
    assert toxicity.classify(docs, lab).count() == 3


def plain_boxes(data, at=0, end=None):
    """Every box of a container as (path, body), by a recursive reading of its own."""
    end = len(data) if end is None else end
    while at < end:
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8].decode("latin-1")
        body = data[at + 8 : at + size]
        yield kind, body, at + 8
        if kind in ("moov", "trak", "mdia", "minf", "stbl"):
            yield from plain_boxes(data, at + 8, at + size)
        at += size


def test_containers_by_an_independent_reader():
    for n in (0, 1, 64, 65, 4096, 4097, 70_000):
        raw = bytes(i * 7 % 251 for i in range(n))
        content = media.wrap(raw)
        found = {kind: (body, at) for kind, body, at in plain_boxes(content)}
        u32 = lambda kind, at, found=found: struct.unpack_from(">I", found[kind][0], at)[0]
        size, count = u32("stsz", 4), u32("stsz", 8)
        chunks = [u32("stco", 8 + 4 * i) for i in range(u32("stco", 4))]
        runs = [tuple(u32("stsc", 8 + 12 * i + 4 * k) for k in range(2)) for i in range(u32("stsc", 4))]
        per = [next(b for a, b in reversed(runs) if a <= c + 1) for c in range(len(chunks))]
        places = [chunks[c] + k * size for c in range(len(chunks)) for k in range(per[c])]
        steps = [u32("stts", 12 + 8 * i) for i in range(u32("stts", 4)) for _ in range(u32("stts", 8 + 8 * i))]
        assert len(places) == len(steps) == count
        assert b"".join(content[p : p + size] for p in places)[:n] == raw
        sync = [u32("stss", 8 + 4 * i) - 1 for i in range(u32("stss", 4))]
        (track,) = media.info(content)["tracks"]
        assert track["keyframes"] == [{"start": places[i], "length": size, "time": sum(steps[:i])} for i in sync]
        assert (track["duration"], track["samples"]) == (sum(steps), count)


def test_times_of_key_frames():
    track = media.Track(count=6, sizes=2, runs=np.array([[1, 6, 1]]), chunks=np.array([0]), sync=np.array([1, 3, 6]), times=np.array([[2, 10], [3, 100], [1, 1]]))
    assert track.keyframes()[2].tolist() == [0, 20, 320]


def test_deep_boxes_and_offsets_beyond_the_file():
    head = media.box(b"ftyp", b"isom", media.ints(0))
    for kind in (b"mdia", b"moov", b"udta"):
        inner = b""
        for _ in range(2000):
            inner = media.box(kind, inner)
        assert media.info(head + media.box(b"moov", media.box(b"trak", inner)))["status"] == "malformed"
        assert media.info(head + media.box(b"moov", inner))["status"] == "malformed"
    good = bytearray(media.wrap(b"some bytes " * 5))
    at = good.index(b"stco") + 12
    good[at : at + 4] = struct.pack(">I", (1 << 31) - 1)
    assert media.info(bytes(good)) == {"status": "malformed", "media_bytes": len(good), "tracks": []}
    short = bytearray(media.wrap(b"some bytes " * 50))
    at = short.index(b"stts") + 12
    short[at : at + 4] = struct.pack(">I", 1)
    assert media.info(bytes(short))["status"] == "malformed"


def test_large_containers_are_handed_over_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * 40_000_000) for i in range(2)] + [(9, None)], "doc_id long, text string").coalesce(1)
    assert sorted(r[0] for r in docs.select(F.length(media.wrap_column("text"))).collect())[1] > 40_000_000


def words(seed, n=60):
    r = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in r.integers(0, 3000, n))


def test_deduplicate_by_row_where_ids_repeat(spark):
    a, b, c = words(1), words(2), words(3)
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "y"), (3, c, "z"), (3, c, "z"), (4, c, "z"), (None, a, "n"), (None, a, "n"), (5, None, None), (6, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, t string")
    got = sorted(map(tuple, simhash.deduplicate(docs).collect()), key=repr)
    assert got == sorted([(1, a, "x"), (2, b, "y"), (3, c, "z"), (None, a, "n"), (None, a, "n"), (5, None, None)], key=repr)


def test_training_rows_in_one_order_and_ids_with_several_texts(spark):
    rows = [(np.array([3, 1], np.int32), 1), (np.array([2], np.int32), 1), (np.array([3, 0], np.int32), 1), (np.array([5, 5], np.int32), 0)]
    once = [r[0].tolist() for r in ordered(rows)]
    assert once == [r[0].tolist() for r in ordered(rows[::-1])] and len(once) == 4
    texts = [(i, words(i)) for i in range(40)] + [(i, words(100 + i)) for i in range(40)]
    lab = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    one, two = (quality.fit(docs.repartition(n, "text"), lab) for n in (2, 7))
    assert (one == two).all()
