"""Order over hot keys, many rules, masks, heavy hitters: each held against a plain restatement at a size where one task or a plan would not do."""

import random
import re
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kanaforge.operators import answers, cascade, lexicon, lines, rules, spans


@pytest.fixture(scope="module")
def events(spark):
    """Half of the events are of one key, and many share a time."""
    r = random.Random(2)
    rows = [("hot" if r.random() < 0.5 else f"k{r.randint(0, 20)}", 1_700_000_000 + r.randint(0, 20_000) / 4, i, r.choice("abc")) for i in range(6000)]
    return spark.createDataFrame(rows, "key string, t double, n long, value string").withColumn("ts", F.timestamp_seconds("t")).drop("t").repartition(5)


def same(a, b):
    cols = sorted(b.columns)
    return sorted(map(tuple, a.select(*cols).collect()), key=repr) == sorted(map(tuple, b.select(*cols).collect()), key=repr)


def largest_share(df, name):
    """The largest partition of a table's rows of the hot key, as a share of all of them."""
    sizes = [r["count"] for r in df.where("key = 'hot'").groupBy(name).count().collect()]
    return max(sizes) / sum(sizes)


def test_ranks_are_exact(spark, events):
    got = spans.ranked(events, ["key", "ts", "n"], "place", parts=13)
    assert same(got, events.withColumn("place", F.row_number().over(Window.orderBy("key", "ts", "n")).cast("long")))
    assert largest_share(spans.laid_out(events, ["key", "ts", "n"], 13), "_range") < 0.35
    assert spans.ranked(events.where("false"), ["key"]).count() == 0


def test_carried_and_previous_values(events):
    w = Window.partitionBy("key").orderBy("ts", "n")
    value = F.when(F.col("n") % 7 == 0, F.col("value"))
    assert same(spans.carried(events, ["key"], ["ts", "n"], value, "last", parts=11), events.withColumn("last", F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    assert same(spans.previous(events, "key", ["ts", "n"], "value", "before", parts=11).withColumn("before", F.col("before.value")), events.withColumn("before", F.lag("value").over(w)))


@pytest.mark.parametrize("seconds", [1, 60, 100_000])
def test_trailing_windows_of_a_hot_key(events, seconds):
    at = F.unix_micros("ts")
    w = Window.partitionBy("key").orderBy(at)
    want = events.withColumn("recent", F.count("*").over(w.rangeBetween(-seconds * 1_000_000 + 1, 0))).withColumn("over", F.col("recent") > 3)
    assert same(answers.rate_limit(events, 3, seconds, "key"), want)
    order = Window.partitionBy("key").orderBy("ts", "n")
    changed = events.withColumn("_c", F.coalesce((F.col("value") != F.lag("value").over(order)).cast("int"), F.lit(0)))
    runs = changed.withColumn("changes", F.sum("_c").over(w.rangeBetween(-seconds * 1_000_000, 0))).withColumn("suppressed", F.col("changes") >= 3).drop("_c")
    assert same(answers.change_runs(events, seconds), runs)


def test_running_counts(events):
    order = Window.partitionBy("key").orderBy("ts", "n").rowsBetween(Window.unboundedPreceding, 0)
    assert same(spans.running_count(events, ["key"], "ts", ["n"], "so_far", 60), events.withColumn("so_far", F.count("*").over(order)))


def test_as_of_with_ties_nulls_and_hot_keys(spark):
    r = random.Random(4)
    left = [(r.choice(["hot", "hot", "a", None]), r.choice([r.randint(0, 500), None]), i) for i in range(2000)]
    right = [(r.choice(["hot", "hot", "a", "b"]), r.randint(0, 500), f"v{r.randint(0, 9)}") for _ in range(300)]
    got = spans.as_of(spark.createDataFrame(left, "k string, at long, row long"), spark.createDataFrame(right, "k string, at long, v string"), ["k"], "at", ["v"], parts=9)
    want = {i: max(((t, v) for k2, t, v in right if k2 == k and t <= at), default=(None, None))[1] if k is not None and at is not None else None for k, at, i in left}
    assert {x["row"]: x["found"] and x["found"]["v"] for x in got.collect()} == want


def test_tail_failures_of_an_endpoint(spark):
    log = spark.createDataFrame([("e", i, i, i < 5) for i in range(9)] + [("f", 1, 1, False), ("f", 1, 2, False), ("g", 1, 1, True)], "endpoint string, ts long, n long, ok boolean")
    assert {x["endpoint"]: (x["tail_failures"], x["stalled"]) for x in answers.health(log).collect()} == {"e": (4, True), "f": (2, True), "g": (0, False)}


# -- rules -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("pattern", "found"),
    [("river", {"river"}), ("^The", {"the"}), ("a(?:bc|de)f", {"bc", "de"}), ("xy(?:abc|def)+", {"abc", "def"}), ("(?i)Hello", {"hello"}), ("(?i)kiss", None), ("(?i)hard", {"hard"}), (r"\bword\b", {"word"}), ("a*b?", None), ("[ab]+", None), (r"\d{3}-x", {"-x"}), ("x|", None), ("(bad", None), (r"\p{Lu}abc", None), ("(?:abc){0,3}", None), ("(?:abc){2}", {"abc"}), ("ab|cd|ef", {"ab", "cd", "ef"}), ("(?=abc)d", {"d"})],
)
def test_required_literals(pattern, found):
    assert rules.required_literals(pattern) == (frozenset(found) if found else None)


def test_a_literal_is_never_required_in_vain():
    r = random.Random(9)
    parts = ["ab", "B", "[ab]", "(?:a|bc)", "c*", "(?:ab)+", ".", "^", "(?i:b)", "ß", "İ", "σ", "x?"]
    texts = ["".join(r.choice("abcABCßİσςsS. ") for _ in range(r.randint(0, 8))) for _ in range(150)]
    for _ in range(600):
        pattern = "".join(r.choice(parts) for _ in range(r.randint(1, 5)))
        finder = rules.Finder([pattern])
        for t in texts:
            if re.search(pattern, t):
                assert finder.hits(t) == [0], (pattern, t)


def test_fifty_thousand_rules(spark, monkeypatch):
    r = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    docs = spark.createDataFrame([(i, " ".join(r.choices(words, k=60)), f"src{i % 9}") for i in range(200)] + [(900, None, None)], "doc_id long, text string, title string").repartition(4)
    made = [(i, None, rf"\b{r.choice(words)} {r.choice(words)}\b" if i % 5 else rf"{r.choice(words)} w[12]\d+ {r.choice('w x')}", {"the": f"k{i}"}) for i in range(50_000)]
    made += [(50_001, "^src8$", None, {"the": "last"}), (50_002, None, None, {"the": "never"})]
    table = spark.createDataFrame(made, "override_id int, title_pattern string, marker_pattern string, words map<string,string>")
    start = time.time()
    got = {x["doc_id"]: x["override_id"] for x in cascade.matched_override(docs, table).select("doc_id", "override_id").collect()}
    took = time.time() - start
    compiled = [(n, m) for n, t, m, _ in made if m]
    want = {}
    for x in docs.collect():
        hit = [n for n, m in compiled if x["text"] and m.split(" ")[0].lstrip("\\b") in x["text"] and re.search(m, x["text"])]
        hit += [50_001] if x["title"] == "src8" else []
        want[x["doc_id"]] = min(hit, default=None)
    assert got == want and sum(v is not None for v in want.values()) > 50 and took < 120
    monkeypatch.setattr(rules, "CHUNK_RULES", 20_000)  # three passes
    assert {x["doc_id"]: x["override_id"] for x in cascade.matched_override(docs, table).select("doc_id", "override_id").collect()} == want


def test_no_rules_and_null_patterns(spark):
    df = spark.createDataFrame([("the river", "the"), (None, "the")], "line string, word string")
    none = spark.createDataFrame([], "word string, pattern string, kana string, ord int")
    assert [x["override"] for x in cascade.line_overrides(df, none).collect()] == [None, None]
    table = spark.createDataFrame([("the", None, "ア", 1), ("the", "river$", "イ", 3), ("the", "^the", "ウ", 2), ("a", "river", "エ", 0)], "word string, pattern string, kana string, ord int")
    assert [x["override"] for x in cascade.line_overrides(df, table).collect()] == ["ウ", None]


# -- heavy hitters, masks, long tokens ---------------------------------------------------------------------


def test_heavy_hitters_are_not_exchanged(spark):
    r = random.Random(6)
    tokens = spark.createDataFrame([("the" if r.random() < 0.3 else f"w{r.randint(0, 3000)}", r.choice(["de", None]), i) for i in range(20_000)], "text string, line_lang string, n0 long")
    kinds = tokens.groupBy("text", "line_lang").agg(F.count("*").alias("n")).withColumn("own", F.concat(F.lit("k-"), "text"))
    got = cascade.with_kinds(tokens, kinds, most=50)
    assert got.count() == 20_000 and got.where("own IS NULL OR own <> concat('k-', text)").count() == 0
    assert same(got.select("text", "line_lang", "n0"), tokens)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan
    rest = tokens.join(kinds.orderBy(F.desc("n"), "text").limit(50), ["text"], "left_anti")
    assert rest.groupBy("text").count().agg(F.max("count")).first()[0] < 0.01 * 20_000


def test_masks_over_many_words(spark):
    r = random.Random(8)
    entries = list({"".join(r.choice("abcdefgh") for _ in range(r.choice([3, 4, 4, 5]))) for _ in range(4000)})
    table = spark.createDataFrame([(w, "ア" if w[0] == "a" else "イ" * (1 + len(w) % 2) if r.random() < 0.7 else "ウ") for w in entries], "word string, kana string")
    known = {x["word"]: x["kana"] for x in table.collect()}
    masks = ["a○○", "b○○○", "○b○○c", "ab○", "a○cd", "ab○de", "abc○e", "○○○", "Z○○", "h○h○h", "*b*"] + ["".join(c if r.random() < 0.6 else "○" for c in w) for w in entries[:300]]
    want = {}
    for m in masks:
        if re.search("[a-zA-Z]", m) and re.search("[○*]", m):
            fits = {k for w, k in known.items() if len(w) == len(m) and all(a in "○*" or a == b for a, b in zip(m.lower(), w, strict=True))}
            if len(fits) == 1:
                want[m] = fits.pop()
    got = lexicon.masked_lookup(spark.createDataFrame([(m,) for m in masks], "word string"), table)
    assert {x["word"]: x["kana"] for x in got.collect()} == want and len(want) > 50


def test_patterns_take_long_tokens(spark):
    long = ["a'b" * 300_000, "x" * 1_000_000, "BA-" * 300_000 + "BA", "{" * 100_000, "\\" * 100_001, "the " * 200_000]
    df = spark.createDataFrame([(i, 0, x) for i, x in enumerate(long)], "doc_id long, line_no int, line string").repartition(3)
    assert lines.plain_words(df).where("doc_id = 0").count() == 1
    assert lines.echo_fragments(df).count() >= 0
    assert lines.long_vowel_words(df.withColumn("text", F.col("line"))).where("doc_id = 2").count() == 1
    reads = df.where("doc_id < 3").select("doc_id", "line_no", F.lit(0).alias("start"), F.length("line").alias("end"), F.lit("ア").alias("kana"))
    back = cascade.annotate(df, reads).select("doc_id", cascade.strip(F.col("markup")).alias("line"))
    assert {x["doc_id"]: x["line"] for x in back.collect()} == dict(enumerate(long))
