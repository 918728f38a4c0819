"""Sizes at which a bound would bite, and operators against plain restatements of what they compute."""

import random
import time
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kanaforge.llm import quality, sharding, simhash, toxicity
from kanaforge.llm.common import packed
from kanaforge.llm.graph import components
from kanaforge.llm.linear import Ftrl, sigmoid

WORDS = "the of and light river stone winter garden letter morning silver window forest engine market".split()


def text_of(seed, n=40):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (str(r.randint(0, 60)) if r.random() < 0.3 else "") for _ in range(n))


# -- hot buckets -------------------------------------------------------------------------------------------


def nodes(spark, fps):
    return spark.createDataFrame([(int(np.int64(np.uint64(x))), i) for i, x in enumerate(fps)], "fp long, rep long")


def classes(spark, fps, **how):
    found = components(simhash.linked(nodes(spark, fps), **how))
    to = {r["node"]: r["component"] for r in found.collect()}
    return [to.get(i, i) for i in range(len(fps))]


@pytest.mark.parametrize("parts", [1, 2, 4])
def test_hot_buckets_lose_no_link(spark, monkeypatch, parts):
    monkeypatch.setattr(simhash.bucket_links, "__defaults__", (64,))
    r = random.Random(parts)
    high = 0x1234567800000000
    fps = {high | r.getrandbits(20) for _ in range(800)} | {r.getrandbits(64) for _ in range(200)}
    fps |= {x ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for x in list(fps)[:200]}
    fps = sorted(fps)
    leader = list(range(len(fps)))

    def find(i):
        while leader[i] != i:
            i = leader[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and (a := find(i)) != (b := find(j)):
                leader[max(a, b)] = min(a, b)
    assert classes(spark, fps, parts=parts) == [find(i) for i in range(len(fps))]


def test_two_hundred_thousand_fingerprints_in_one_bucket(spark):
    r = np.random.default_rng(3)
    fps = np.unique(r.integers(0, 1 << 32, 200_000, dtype=np.uint64)) | np.uint64(0x1234567800000000)
    made = spark.createDataFrame(__import__("pandas").DataFrame({"fp": fps.view(np.int64), "rep": np.arange(len(fps))}))
    start = time.time()
    links = simhash.linked(made)
    assert links.count() > 0 and time.time() - start < 150
    assert all((int(fps[a]) ^ int(fps[b])).bit_count() <= 3 for a, b in links.limit(1000).collect())


# -- sharding against a full sort --------------------------------------------------------------------------


def test_shards_are_cuts_of_the_full_sort_and_keep_equal_texts(spark):
    texts = [text_of(i % 1200, 12) for i in range(2000)] + ["hot copy of a text"] * 2500
    df = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, part string")
    order = sharding.keyed(df).orderBy("hi", "lo").collect()
    got = {r["doc_id"]: r for r in sharding.assign(df, range_rows=200).collect()}
    place = [(got[r["doc_id"]]["shard"], got[r["doc_id"]]["slot"]) for r in order]
    assert place == sorted(place) and len(set(place)) == len(place)
    ideal = sum(r["size"] for r in order) / 8
    for s in range(1, 8):  # every boundary is near its target
        below = sum(r["size"] for r in order if got[r["doc_id"]]["shard"] < s)
        assert abs(below - s * ideal) <= sharding.SLACK * ideal + 20
    homes = {}
    for i, t in enumerate(texts):
        homes.setdefault(t, set()).add(got[i]["shard"])
    assert {t for t, h in homes.items() if len(h) > 1} == {texts[i] for i, r in got.items() if r["text_cut"]} == {"hot copy of a text"}


# -- restoring words against every path --------------------------------------------------------------------


def test_viterbi_finds_the_cheapest_of_all_paths():
    counts = np.zeros(toxicity.SYMBOLS**3)
    for t in ["you idiot and moron", "what a clown", "stupid trash scum"] * 20:
        a = [toxicity.symbol(c) for c in f" {t} "]
        for i in range(len(a) - 2):
            counts[a[i] * 784 + a[i + 1] * 28 + a[i + 2]] += 1
    restorer = toxicity.Restorer(toxicity.language_model(counts))

    def cost_of(token, path):
        a = b = 0
        total = 0.0
        for x, k in path:
            total += k
            if x:
                s = toxicity.symbol(x)
                total, a, b = total + restorer.cost[a][b][s], b, s
        return total + restorer.cost[a][b][0]

    r = random.Random(4)
    for _ in range(150):
        token = "".join(r.choice("idotmrn01$@.-!x") for _ in range(r.randint(1, 6)))
        best = min(cost_of(token, path) for path in product(*(restorer.arcs(token, i) for i in range(len(token)))))
        found = restorer.viterbi(token)
        ways = [p for p in product(*(restorer.arcs(token, i) for i in range(len(token)))) if "".join(x for x, _ in p) == found]
        assert min(cost_of(token, p) for p in ways) == pytest.approx(best)


# -- the learner, restated ---------------------------------------------------------------------------------


def test_ftrl_is_the_published_update():
    r = np.random.default_rng(2)
    rows = [(np.sort(r.choice(30, 5, replace=False)), r.normal(size=5), int(r.integers(2))) for _ in range(60)]
    alpha, beta, l1, l2, dim = 0.3, 1.0, 0.05, 0.5, 30
    z, n = [0.0] * (dim + 1), [0.0] * (dim + 1)

    def weight(i):
        if abs(z[i]) <= l1 and i < dim:
            return 0.0
        return -(z[i] - np.sign(z[i]) * l1) / ((beta + n[i] ** 0.5) / alpha + l2)

    model = Ftrl(dim, alpha, beta, l1, l2)
    for at, x, y in rows:
        both = [*zip(at.tolist(), x.tolist(), strict=True), (dim, 1.0)]
        p = float(sigmoid(sum(weight(i) * v for i, v in both)))
        new = {}
        for i, v in both:
            g = (p - y) * v * 2.0
            new[i] = (z[i] + g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * weight(i), n[i] + g * g)
        for i, (a, b) in new.items():
            z[i], n[i] = a, b
        model.update(at, x, y, 2.0)
    assert np.allclose(model.weights(), [weight(i) for i in range(dim + 1)])


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_ties_score_alike_and_long_tokens_are_read_and_not_kept(spark, operator):
    long = "qx" * 200_000
    rows = [(i, ("good clear words here " if i % 2 else "%%%% you idiot !!!! ") + text_of(i % 7, 8)) for i in range(200)] + [(500, long), (501, long), (502, ""), (503, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in operator.classify(docs, lab).collect()}
    assert got[500] == got[501] and got[502] == got[503] and all(0 <= s <= 1 for s in got.values())
    by_text = {}
    for i, t in rows:
        by_text.setdefault(t, set()).add(got[i])
    assert all(len(x) == 1 for x in by_text.values())
    word = long.encode() if operator is quality else long
    kept = quality._WORDS if operator is quality else toxicity.Restorer(toxicity.language_model(np.zeros(toxicity.SYMBOLS**3)))
    (kept[word], kept.__contains__(word)) if operator is quality else kept.restore(word)
    assert word not in (kept if operator is quality else kept.known)


# -- stages keep what they are given -----------------------------------------------------------------------


def test_stages_take_null_repeated_huge_and_clashing_rows(spark):
    texts = [(i, text_of(i)) for i in range(40)] + [(3, text_of(3)), (3, text_of(3)), (50, None), (51, ""), (52, text_of(52, 30_000)), (None, text_of(60)), (None, None), (53, "x" * 300_000)]
    rows = [(i, t, "en", f"s{(i or 0) % 3}", len(t) if t else None, f"own{k}", f"{k}", -k) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, _own int")
    folder = "/root/testdata/sf0.001"
    known = {tuple(r) for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        got = [tuple(r) for r in out.collect()]
        assert out.columns == docs.columns and set(got) <= known, name
        if name == "mixing":
            assert sorted(map(repr, got)) == sorted(map(repr, map(tuple, rows)))
        if name == "simhash":
            assert sum(r[0] == 3 for r in got) == 1 and sum(r[0] is None for r in got) == 2 and sum(r[0] in (50, 51) for r in got) == 1
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert last.count() == len(rows)


def test_packed_rows_keep_every_column(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a.b", "c`d", "row"])
    assert tuple(df.select(packed(df).alias("r")).first()["r"]) == (1, 2, 3)


def test_crc_rule_is_the_hold_out():
    assert zlib.crc32(b"7") % 5 != 0 and F is not None
