"""Near copies by kind of edit, held against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from kanaforge.llm import simhash


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b)


def words(r, n):
    return [f"word{r.randint(0, 5000)}" for _ in range(n)]


def edited(r, own, kind, part):
    n = max(1, int(part * len(own)))
    if kind == "appended":
        return own + words(r, n)
    if kind == "block":
        at = r.randrange(len(own) - n)
        return own[:at] + words(r, n) + own[at + n :]
    out = list(own)
    for at in r.sample(range(len(own)), max(1, n // 5)):
        out[at] = f"other{at}"
    return out


def test_every_copy_at_the_similarity_goes_and_nothing_below(spark):
    r, rows, near, far = random.Random(8), [], {}, {}
    for i in range(240):
        own = words(r, r.randint(150, 500))
        kind = ("appended", "block", "scattered")[i % 3]
        copy = edited(r, own, kind, r.choice([0.03, 0.08, 0.1, 0.15, 0.19, 0.3]))
        rows += [(i, " ".join(own)), (1000 + i, " ".join(copy))]
        kept = similarity(shingles(rows[-2][1]), shingles(rows[-1][1])) < 0.8
        (far if kept else near).setdefault(kind, set()).add(1000 + i)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x["doc_id"] for x in simhash.deduplicate(docs).collect()}
    assert all(len(near[k]) > 10 and len(far[k]) > 5 for k in ("appended", "block", "scattered"))
    assert {k: x & got for k, x in near.items()} == {k: set() for k in near}
    assert {k: x - got for k, x in far.items()} == {k: set() for k in far}


def test_members_that_miss_the_first_of_their_bucket_are_linked(spark):
    # 1 and 2 are both near 0 but not near each other; 4 is near 3 only and 3 shares most of 0
    base = [f"w{i}" for i in range(400)]
    rows = [(0, base), (1, base + [f"x{i}" for i in range(60)]), (2, base[50:]), (3, base[:250] + [f"y{i}" for i in range(150)]), (4, base[:250] + [f"y{i}" for i in range(140)])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    assert sorted(x["doc_id"] for x in simhash.deduplicate(docs).collect()) == [0, 3]


def test_bands_meet_as_often_as_the_similarity_says():
    r = np.random.default_rng(3)
    met = 0
    for _ in range(200):
        h = r.integers(0, 2**63, 900, dtype=np.uint64)
        met += (simhash.bands(h[:800]) == simhash.bands(h[80:880])).sum()  # 720 of 880
    assert abs(met / 200 / simhash.BANDS - (720 / 880) ** simhash.BAND_ROWS) < 0.03


def edits_of_one(n, length, most, seed):
    """Texts that differ from one base in up to `most` runs of words, so that their similarities lie around 0.8."""
    r = random.Random(seed)
    base = [f"w{i}" for i in range(length)]
    out = []
    for i in range(n):
        own = list(base)
        for at in r.sample(range(length), r.randint(0, most)):
            own[at] = f"x{i}y{at}"
        out.append(" ".join(own))
    return out


def members_of(texts):
    sets = {simhash.set_name(simhash.shingle_set(t.encode())): simhash.shingle_set(t.encode()) for t in texts}
    return {int(np.uint64(k).view(np.int64)): set(v.tolist()) for k, v in sets.items()}


def groups_of(nodes, links):
    up = {x: x for x in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for u, v in links:
        up[max(top(u), top(v))] = min(top(u), top(v))
    return {x: top(x) for x in nodes}


def brute_links(sets):
    return [(u, v) for u in sets for v in sets if u < v and 5 * len(sets[u] & sets[v]) >= 4 * len(sets[u] | sets[v])]


def nodes_and_docs(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return docs, simhash.sketches(docs).groupBy("own").agg(F.first("n").alias("n"), F.min("doc_id").alias("rep"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))


def test_fingerprints_find_copies_by_themselves(spark):
    # with no bands at all, the fingerprints at three bits link copies with a word changed, and the sets are verified
    texts = edits_of_one(2, 4000, 0, 1) + edits_of_one(1, 4000, 0, 1) + [" ".join([f"w{i}" for i in range(3999)] + ["other"]), " ".join(f"z{i}" for i in range(300))]
    docs, nodes = nodes_and_docs(spark, texts)
    got = simhash.near_links(docs, nodes.withColumn("bands", F.array().cast("array<long>"))).collect()
    assert len(got) == 1 and {got[0]["u"], got[0]["v"]} <= set(members_of(texts))


def test_a_group_around_the_similarity_leaves_as_a_forest(spark):
    texts = edits_of_one(160, 120, 6, 2)
    docs, nodes = nodes_and_docs(spark, texts)
    sets, links = members_of(texts), [tuple(x) for x in simhash.near_links(docs, nodes).collect()]
    want = groups_of(sets, brute_links(sets))
    assert groups_of(sets, links) == want and len(set(want.values())) > 5
    assert all((min(x), max(x)) in set(brute_links(sets)) for x in links)
    assert len(links) < len(brute_links(sets)) / 2


def test_large_buckets_are_cut_into_blocks_with_the_same_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_SETS", 7)
    texts = edits_of_one(60, 120, 6, 3) + [" ".join(f"l{i}" for i in range(3000)), " ".join(f"l{i}" for i in range(100, 3000))]
    docs, _ = nodes_and_docs(spark, texts)
    sets = members_of(texts)
    links = brute_links(sets)
    known = groups_of(sets, links[: len(links) // 2])  # as if a round before had found half of the links
    members = spark.createDataFrame([(1, x, len(sets[x]), known[x]) for x in sets], "bucket long, own long, n long, component long")
    places = simhash.blocks(members).groupBy("bucket", "i", "j").count().collect()
    assert len(places) > 3 and max(x["count"] for x in places) < 40
    found = [tuple(x) for x in simhash.verified(members, simhash.shingle_sets(docs).dropDuplicates(["own", "part"])).collect()]
    assert groups_of(sets, found + links[: len(links) // 2]) == groups_of(sets, links)
    assert all((min(x), max(x)) in set(links) for x in found)


def test_a_bucket_sends_its_sets_and_no_pairs(spark):
    # the join of a bucket with itself made 400 * 399 / 2 rows of this group, none of which links
    texts = [" ".join(f"w{i}" if i % 100 > 40 else f"x{k}y{i}" for i in range(200)) for k in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = members_of(texts)
    members = spark.createDataFrame([(1, x, len(sets[x]), x) for x in sets], "bucket long, own long, n long, component long")
    assert simhash.blocks(members).count() == len(sets) == 400
    assert simhash.verified(members, simhash.shingle_sets(docs)).count() == 0
