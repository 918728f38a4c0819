"""The mixture against the target weights themselves."""

from heapq import heappop, heappush

import numpy as np
import pytest
from pyspark.sql import functions as F

from kanaforge.llm import mixing

WEIGHTS = [
    {"hot": 1000.0, **{f"s{i:02}": 100.1 for i in range(20)}},
    {f"s{i:04}": 1.0 + i % 7 for i in range(600)},
    {"a": 1e6, "b": 777.7, "c": 3.1, **{f"d{i}": 1e5 + 13 * i for i in range(10)}},
]


def one_pass(w, slots):
    """Earliest deadline first over all slots, one after the other."""
    waiting, ready, out = [(0, i, 0) for i in range(len(w))], [], []
    for t in range(slots):
        while waiting and waiting[0][0] <= t:
            _, i, j = heappop(waiting)
            heappush(ready, (-(-(j + 1) * mixing.UNIT // w[i]), i, j))
        _, i, j = heappop(ready)
        out.append((i, j))
        heappush(waiting, ((j + 1) * mixing.UNIT // w[i], i, j + 1))
    return out


@pytest.mark.parametrize(("weights", "slots"), [(WEIGHTS[0], 60_000), (WEIGHTS[1], 12_000), (WEIGHTS[2], 60_000)])
def test_frames_give_what_one_pass_gives_within_a_block_of_the_weights(spark, weights, slots):
    units = mixing.units(weights)
    assert sum(units.values()) == mixing.UNIT
    w = [units[s] for s in sorted(units)]
    rows = mixing.slots_of(spark, w, slots).where(F.col("mix_slot") < slots).orderBy("mix_slot").collect()
    got = [(r["kind"], r["mix_block"]) for r in rows]
    assert got == one_pass(w, slots)
    total, kinds = sum(weights.values()), np.array([k for k, _ in got])
    for i, s in enumerate(sorted(weights)):
        at = np.flatnonzero(kinds == i)
        j = np.arange(len(at))
        # the deviation is largest just after and just before a block runs
        assert (j + 1 - (at + 1) * (weights[s] / total) < 1 + 1e-6).all() and (at * (weights[s] / total) - j < 1 + 1e-6).all(), s


def test_windows_hold_after_ten_billion_slots(spark):
    units = mixing.units(WEIGHTS[0])
    w = [units[s] for s in sorted(units)]
    first = 10_000_000
    start = mixing.guessed(spark.range(first, first + 1).select(F.col("id").alias("frame")), mixing._array(w), 1024)
    r = mixing.scheduled(start, mixing._array(w), 1024).first()
    for t, x in enumerate(r["runs"], first * 1024):
        u = w[x["kind"]]
        assert x["block"] * mixing.UNIT // u <= t < -(-(x["block"] + 1) * mixing.UNIT // u)


def test_rows_follow_the_weights_and_the_rest_follows_them(spark):
    sizes = {"hot": 9000, **{f"s{i}": 1300 + 7 * i for i in range(6)}, "tiny": 9}
    rows = [(k * 100_000 + i, s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    got = mixing.positions(spark.createDataFrame(rows, "doc_id long, source string")).toPandas().sort_values("mix_pos")
    assert len(got) == len(rows) and got.mix_pos.is_unique and got.doc_id.is_unique
    weights = mixing.tempered(sizes)
    slots = got.drop_duplicates("mix_slot")
    assert (slots.mix_slot == np.arange(len(slots))).all() and slots.balanced.is_monotonic_decreasing
    first = slots[slots.balanced]
    t = np.arange(1, len(first) + 1)
    assert len(first) < len(slots)
    for s, w in weights.items():
        assert (abs((first.source == s).cumsum() - t * w / sum(weights.values())) < 1 + 1e-9).all()


def test_columns_of_any_name_keep_their_values(spark):
    names = ["_key", "turn", "slot", "_bucket", "_row", "before", "rank", "key", "n", "row", "mix_source", "stretch", "a.b"]
    rows = [(i, f"s{i % 3}", *[f"{c}{i}" for c in names]) for i in range(100)]
    df = spark.createDataFrame(rows, ["doc_id", "source", *names])
    for out in (mixing.positions(df), mixing.mixed(df)):
        assert sorted(tuple(r)[: len(names) + 2] for r in out.collect()) == sorted(rows)
    clash = df.withColumn("mix_slot", F.lit("own"))
    assert {r["mix_slot"] for r in mixing.mixed(clash).collect()} == {"own"} and mixing.positions(clash).schema["mix_slot"].dataType.simpleString() == "bigint"
