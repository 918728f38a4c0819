"""Streams whose result must not depend on how they are cut into micro-batches, nor on the order of arrival."""

import random

import pytest
from pyspark.sql import functions as F

from kanaforge.streaming import annotate, learn, usage

BASE = 1_700_000_000


def run(source, make, name, folder):
    query = make(source).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/cp-{name}").trigger(availableNow=True).start()
    query.awaitTermination(400)
    assert query.exception() is None
    return source.sparkSession.table(name)


def cut(spark, rows, schema, time, parts, folder):
    """rows as a stream of so many files, each read in a micro-batch of its own."""
    for n in range(parts):
        part = rows[len(rows) * n // parts : len(rows) * (n + 1) // parts]
        if part:
            spark.createDataFrame(part, schema).withColumn(time, F.timestamp_seconds(time)).coalesce(1).write.parquet(f"{folder}/in/{n:03d}")
    kind = spark.createDataFrame([], schema).withColumn(time, F.timestamp_seconds(time)).schema
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")


LEARN = "word string, ts double, n long, kana string, line string, local string"


def learn_rows():
    r = random.Random(3)
    rows = [(f"word{r.choice([0, 0, 0, 1, 2])}", float(BASE + i * 600), i, r.choice(["アイ", "ウエ", "アイ", None]), f"l{r.randint(0, 3)}", r.choice(["", "", "ウエ"])) for i in range(160)]
    rows += [rows[5], rows[9]]  # repeated
    rows += [("word1", float(BASE + 200 * 86_400), 900, "アイ", "later", "")]  # after the word was forgotten
    early = sorted(rows[:-1], key=lambda x: x[1] + r.uniform(0, 80_000))  # late by less than a day
    return [*early, rows[-1], ("end", float(BASE + 400 * 86_400), 999, "アイ", "x", "")]


@pytest.mark.parametrize("parts", [1, 7, 25])
def test_learning_does_not_depend_on_micro_batches(spark, tmp_path, parts):
    rows = learn_rows()
    table = learn.answers_of(spark.createDataFrame(rows, LEARN).withColumn("ts", F.timestamp_seconds("ts")))
    want = sorted(map(tuple, learn.batch(table).where("word <> 'end'").collect()), key=repr)
    source = cut(spark, rows, LEARN, "ts", parts, tmp_path)
    got = run(source, lambda s: learn.stream(learn.answers_of(s)), f"learned{parts}", tmp_path)
    assert sorted(map(tuple, got.where("word <> 'end'").collect()), key=repr) == want
    assert {x[2] for x in want} == {"pending", "learned", "dropped"} and ("word1", 900, "pending", "アイ") in want


TOKENS = "doc_id long, line_no int, ts double, ctx string, tok_no int, text string, start int, `end` int, key string, kana string"
SAID = "key string, ctx string, kana string, at double"


def brute_answers(tokens, said):
    wait, out = 7 * 86_400, []
    for doc, line, ts, ctx, tok, text, start, end, key, kana in tokens:
        mine = sorted(((at, k) for k2, c2, k, at in said if (k2, c2) == (key, ctx) and k is not None))
        before = [x for x in mine if x[0] <= ts]
        after = [x for x in mine if x[0] > ts]
        took = before[-1] if before and ts - before[-1][0] <= wait else after[0] if after and after[0][0] - ts <= wait else None
        if kana is None and key is not None and took:
            out.append((key, ctx, doc, line, tok, text, start, end, took[1], int(ts * 1e6), int(took[0] * 1e6)))
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 9])
def test_waiting_tokens_come_out_again(spark, tmp_path, parts):
    r = random.Random(parts)
    day = 86_400
    tokens = [(i, 0, float(BASE + r.randint(0, 40) * day // 2 + i), f"c{i % 2}", 0, "Stone", 0, 5, r.choice(["stone", "stone", "river", None]), r.choice([None, None, None, "ア"])) for i in range(60)]
    tokens += [tokens[4]]
    said = [(r.choice(["stone", "river"]), f"c{i % 2}", r.choice(["ストーン", "イシ", None]), float(BASE + r.randint(0, 40) * day // 2 + 1000 + i)) for i in range(12)]
    want = brute_answers(tokens, said)
    table = annotate.answered(spark.createDataFrame(tokens, TOKENS).withColumn("ts", F.timestamp_seconds("ts")), spark.createDataFrame(said, SAID).withColumn("at", F.timestamp_seconds("at")))
    assert sorted(map(tuple, table.collect())) == want and len(want) > 10
    # arrival: by time, but for minutes; the last rows let the watermark pass all others
    tokens = sorted(tokens, key=lambda x: x[2] + r.uniform(0, 500)) + [(999, 0, float(BASE + 100 * day), "end", 0, "x", 0, 1, "end", None)]
    said = sorted(said, key=lambda x: x[3] + r.uniform(0, 500)) + [("end", "end", "エンド", float(BASE + 100 * day))]
    source = cut(spark, tokens, TOKENS, "ts", parts, tmp_path / "t"), cut(spark, said, SAID, "at", parts, tmp_path / "s")
    got = run(source[0], lambda s: annotate.answered(s, source[1]), f"answered{parts}", tmp_path)
    found = sorted(map(tuple, got.where("key <> 'end'").collect()))
    assert found == want


@pytest.mark.parametrize("parts", [1, 6])
def test_running_totals_of_a_stream(spark, tmp_path, parts):
    r = random.Random(5)
    rows = [(i, float(BASE + i * 3000), r.choice("aab")) for i in range(120)]
    table = spark.createDataFrame(rows, "event_id long, ts double, kind string").withColumn("ts", F.timestamp_seconds("ts"))
    want = sorted(map(tuple, usage.running(table).collect()))
    arrived = sorted(rows, key=lambda x: x[1] + r.uniform(0, 50_000)) + [(999, float(BASE + 100 * 86_400), "end")]
    got = run(cut(spark, arrived, "event_id long, ts double, kind string", "ts", parts, tmp_path), usage.running, f"totals{parts}", tmp_path)
    assert sorted(map(tuple, got.where("kind <> 'end'").collect())) == want and want[-1][3] > 30
