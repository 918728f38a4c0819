"""Versions of a store: damage of every kind falls back to the last whole one, and little is written and read twice."""

import glob
import os
import shutil

import pytest

from kanaforge.sources import files, versions

KINDS = "word string, kana string"


def table(spark, rows):
    return spark.createDataFrame(rows, KINDS)


def read(spark, folder):
    found = versions.load(spark, folder, KINDS)
    return found and sorted(map(tuple, found.collect()))


@pytest.fixture
def store(spark, tmp_path):
    folder = f"{tmp_path}/store"
    one = [(f"w{i}", "ア") for i in range(40)]
    two = [*one[:39], ("w39", "イ"), ("new", "ウ")]
    return folder, one, two, versions.save(table(spark, one), folder, buckets=8), versions.save(table(spark, two), folder, buckets=8)


def test_the_newest_version_is_read(spark, store):
    folder, one, two, first, second = store
    assert read(spark, folder) == sorted(two)
    a, b = ({r["bucket"]: (r["hash"], r["object"]) for r in spark.read.parquet(p).collect()} for p in (first, second))
    kept = [k for k in a if a[k] == b.get(k)]
    assert len(kept) >= 5 and all((a[k][0] == b[k][0]) == (a[k][1] == b[k][1]) for k in b if k in a)  # only what differs was written
    assert sorted(map(tuple, versions.drift(spark, folder, first, second, KINDS).collect())) == [("new", "extra"), ("w39", "changed")]
    shutil.rmtree(f"{folder}/objects/{a[kept[0]][1]}/bucket={kept[0]}")
    assert sorted(map(tuple, versions.drift(spark, folder, first, second, KINDS).collect())) == [("new", "extra"), ("w39", "changed")]  # same buckets are not read


@pytest.mark.parametrize("damage", ["manifest gone", "manifest cut", "half written", "file gone", "file cut", "rows changed", "rows doubled"])
def test_damage_falls_back(spark, store, damage):
    folder, one, two, first, second = store
    name = next(r["object"] for r in spark.read.parquet(second).collect() if r["object"] not in {x["object"] for x in spark.read.parquet(first).collect()})
    data = sorted(glob.glob(f"{folder}/objects/{name}/bucket=*/*.parquet"))
    for crc in glob.glob(f"{folder}/**/.*.crc", recursive=True):
        os.remove(crc)
    if damage == "manifest gone":
        os.remove(f"{second}/_SUCCESS")
    elif damage == "manifest cut":
        (part,) = glob.glob(f"{second}/*.parquet")
        os.truncate(part, os.path.getsize(part) // 2)
    elif damage == "half written":
        rows = spark.read.parquet(second).limit(5).collect()
        shutil.rmtree(second)
        spark.createDataFrame(rows, versions.MANIFEST).write.parquet(second)
    elif damage == "file gone":
        os.remove(data[0])
    elif damage == "file cut":
        os.truncate(data[0], os.path.getsize(data[0]) // 2)
    else:
        rows = spark.read.parquet(data[0]).collect()
        rows = [(r["word"], "エ") for r in rows] if damage == "rows changed" else rows * 2
        where = os.path.dirname(data[0])
        shutil.rmtree(where)
        table(spark, [tuple(r) for r in rows]).coalesce(1).write.parquet(where)
    assert read(spark, folder) == sorted(one)
    third = versions.save(table(spark, two), folder, buckets=8)  # and the store goes on
    assert third > first and read(spark, folder) in (sorted(two), sorted(one))


def test_no_version_and_an_empty_one(spark, tmp_path):
    assert versions.load(spark, f"{tmp_path}/none", KINDS) is None
    versions.save(table(spark, []), f"{tmp_path}/e")
    assert versions.load(spark, f"{tmp_path}/e", KINDS) is None or read(spark, f"{tmp_path}/e") == []


def test_bundles_that_are_left_out(spark):
    good = '{"version":1,"learned":[{"word":"a","kana":"ア"}]}'
    texts = spark.createDataFrame([(good,), (good[:-3],), ("",), (None,), ("[]",), ('{"version":"x"}',), ('{"version":2,"learned":[{"word":"a","kana":"ア"}]}',), ('{"version":1}',), ('{"version":1,"learned":{"word":1}}',)], "bundle string")
    why = [r["why"] for r in files.bundle_errors(texts).collect()]
    assert len(why) == 8 and set(why) <= {"broken", "version", "empty"} and why.count("version") >= 1
    assert [tuple(r) for r in files.read_bundle(texts)[0].collect()] == [("a", "ア")]
