"""Operators 11 to 13 against plain restatements, and on the rows that break things."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kanaforge.llm import collocations, htmltext, negatives

# -- 11 ----------------------------------------------------------------------------------------------------

PARAGRAPHS = [
    "The harbour was quiet in the morning, and the boats lay side by side, each with its nets folded over the rail.",
    "Later, when the wind came up, the older men went out to look at the ropes, and the children stayed behind the wall.",
    "Short one.",
    "Nobody had expected the ferry before noon, but there it was, low in the water, loaded with timber, salt and mail.",
]
AROUND = {
    "menu": '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News, sport, weather and much more of the kind</a></li></ul></nav>',
    "header": '<header class="site"><a href="/">The Daily Site, all the news, every day, since the year it began</a></header>',
    "side": '<div class="sidebar"><p>Most read today, in the region, and in the town, with a long line of teasers to make it heavy, heavier, heaviest.</p></div>',
    "aside": "<aside><p>An aside with commas, more commas, and yet more commas, which is long enough to score well.</p></aside>",
    "cookie": '<div id="cookie-notice">We use cookies, many cookies, to make this site work, as you can see, and to measure.</div>',
    "ad": '<div class="ad-slot">Buy now, save more, pay less, smile often, sleep well, and tell your friends about it.</div>',
    "form": '<form action="/s"><p>Write to us, please, with your name, your town, and your opinion on the matter.</p><input name="q"><button>Send</button></form>',
    "script": '<script>if (a < b && "</p>") { document.write("<p>never, never, never</p>") }</script><style>p > a { margin: 0 }</style>',
    "comments": '<section class="comments"><h2>Comments</h2><div class="comment"><p>I read this, twice, and I agree with every word, as I always do, thank you.</p></div></section>',
    "footer": "<footer><p>All rights reserved, in all countries, for all time, by the owners of this very site.</p></footer>",
    "hidden": '<div style="display: none">Invisible, unseen, and yet long enough to be a paragraph of its own, or two.</div>',
}


def page(body, before=("header", "menu", "cookie", "ad"), after=("side", "aside", "form", "comments", "script", "footer")):
    return "<!doctype html><html><head><title>T</title></head><body>" + "".join(AROUND[k] for k in before) + body + "".join(AROUND[k] for k in after) + "</body></html>"


def paragraphs(tag="p"):
    return "".join(f"<{tag}>{p}</{tag}>" for p in PARAGRAPHS)


WHOLE = "\n".join(["Title & more", *PARAGRAPHS])


@pytest.mark.parametrize(
    "body",
    [
        f"<article><h1>Title &amp; more</h1>{paragraphs()}</article>",
        f"<main><h1>Title &#38; more</h1><section>{paragraphs()}</section></main>",
        f'<div class="content"><h1>Title &amp; more</h1>{paragraphs()}</div>',
        f'<div><div><h1>Title &amp;  more</h1>{paragraphs("div")}</div></div>',
        f'<table><tr><td><h1>Title &amp; more</h1>{paragraphs()}</td></tr></table>',
        f"<article><header><h1>Title &amp; more</h1><p>By a writer</p></header>{paragraphs()}<ul><li><a href=1>Other story</a></li><li><a href=2>Another story</a></li></ul></article>",
        "<article><h1>Title &amp; more" + "".join(f"<p><b>{p}<br>" for p in PARAGRAPHS) + "</article>",
        f'<h1>Title &amp; more</h1><div>{paragraphs()}</div>',
        f'<form id="page"><div class="story has-sidebar"><h1>Title &amp; more</h1>{paragraphs()}</div></form>',
        f"<article><h1>Title\n\t&amp;&nbsp;more</h1><!-- <p>gone, gone, gone</p> -->{paragraphs()}{AROUND['hidden']}{AROUND['comments']}</article>",
    ],
)
def test_main_text_of_a_page(body):
    assert htmltext.extract(page(body)) == WHOLE
    assert htmltext.extract(page(body).replace("</body></html>", "")) == WHOLE


def test_siblings_of_the_container_are_kept():
    one = f"<div class='text'>{paragraphs()}</div>"
    two = "<div class='text'><p>" + PARAGRAPHS[0] + "</p><p>" + PARAGRAPHS[1] + "</p></div>"
    got = htmltext.extract(page(f"<section>{one}{two}<p>Loose end, said the editor.</p><p><a href=x>More of this, and that</a></p></section>"))
    assert got == "\n".join([*PARAGRAPHS, PARAGRAPHS[0], PARAGRAPHS[1], "Loose end, said the editor."])


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("just text, no tags & all", "just text, no tags & all"),
        ("a < b and b > c", "a < b and b > c"),
        ("<p>a</p>b<p>c", "a\nb\nc"),
        ("<p>5 &lt; 6 &#x41;&#66; &unknown; &eacute;", "5 < 6 AB &unknown; é"),
        ("<body><div class=sidebar>only this</div></body>", "only this"),
        ("<p title='a>b'>quoted</p>", "quoted"),
        ('<p title="never closed>text</p><p>more', "text\nmore"),
        ("<p>one<script>x", "one"),
        ("<p>one</p><!-- open", "one"),
        ("<P>upper</P><LI>item", "upper\nitem"),
        ("<p>" + "x" * 1_000_000 + "</p>", "x" * 1_000_000),
    ],
)
def test_small_and_broken_pages(html, text):
    assert htmltext.extract(html) == text


@pytest.mark.parametrize("unit", ["<div>", "<", "<a href='", "<!--", "<b><i>", "<p a=\"", "</div>", "<table><td>", "&amp;", "<p>x", "<script>", "<li><ul>", "<noscript>", "<![CDATA[", "='", "<a>"])
def test_reading_is_linear(unit):
    def took(n):
        start = time.process_time()
        htmltext.extract(unit * n)
        return time.process_time() - start

    small = max(took(10_000), 0.02)
    assert took(80_000) < 8 * 4 * small


def test_extracted_columns(spark):
    rows = [(1, "u", f"<article>{paragraphs()}</article>", "x", 7), (2, None, None, "y", 8), (None, "v", "", None, None), (1, "u", f"<article>{paragraphs()}</article>", "x", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, `n.chars` int")
    got = htmltext.extracted(pages)
    assert got.columns == ["page_id", "url", "n.chars", "text", "n_chars"]
    found = sorted(map(tuple, got.collect()), key=repr)
    whole = "\n".join(PARAGRAPHS)
    assert found == sorted([(1, "u", 7, whole, len(whole)), (2, None, 8, "", 0), (None, "v", None, "", 0), (1, "u", 7, whole, len(whole))], key=repr)
    assert htmltext.extracted(pages.where("false")).count() == 0


# -- 12 ----------------------------------------------------------------------------------------------------


def brute_collocations(rows, top=2000, least=30):
    lower = {c: c + 32 for c in range(65, 91)}
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                f.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    longer = Counter()
    for (lang, p), c in f.items():
        if len(p) > 2 and c >= least:
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[lang, p[i : i + m]] = max(longer[lang, p[i : i + m]], c)
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least or 100 * longer[lang, p] >= 80 * a:
            continue
        score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, found in out.items() for i, (s, a, p, x, y) in enumerate(sorted(found)[:top]))


def phrase_rows(seed=3, n=150):
    r = random.Random(seed)
    words = "the of And river Stone été winter garden x y morning 東京".split(" ")
    rows = []
    for i in range(n):
        text = " ".join(r.choices(words, weights=[9, 5, 3, 1, 1, 1, 1, 1, 1, 1, 1], k=r.randint(0, 80)))
        text = "".join(c if r.random() > 0.01 else r.choice(".,;:!?\n\t\x0b  ") for c in text)
        rows.append((text, r.choice(["en", "en", "en", "de", "und", None])))
    rows += [("Same passage said again and again in every copy. " * 3, "en")] * 60  # copies
    rows += [(None, "en"), ("", "de"), (" \t. , ", None), ("one", "fr"), ("the " * 5000, "hot"), ("a" * 300_000 + " b", "long")]
    return rows


@pytest.mark.parametrize(("ranges", "block"), [(1_200_000, 1_000_000), (300, 500)])
def test_collocations(spark, monkeypatch, ranges, block):
    monkeypatch.setattr(collocations, "RANGE_ROWS", ranges)
    rows = phrase_rows()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, f int, phrase string").repartition(5)
    got = sorted(map(tuple, collocations.collocations(docs, most=block).collect()))
    assert got == brute_collocations(rows)
    assert len(got) > 50


def test_collocations_top_ties_and_empty(spark):
    rows = [(f"{a} {b}.", "en") for a in "abcd" for b in "efgh" for _ in range(40)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(map(tuple, collocations.collocations(docs, top=7).collect())) == brute_collocations(rows, top=7)
    assert collocations.collocations(docs.where("false")).count() == 0
    assert collocations.collocations(docs.select(F.lit(None).cast("string").alias("text"), "lang")).count() == 0


def test_words_of_long_texts_in_runs(monkeypatch):
    text = b"A b,c  d\te. " * 50
    whole = [w for run in collocations.words_of(text) for w in run]
    monkeypatch.setattr(collocations, "CHUNK", 7)
    assert [w for run in collocations.words_of(text) for w in run] == whole


def test_codes_that_clash_take_another_seed(spark, monkeypatch):
    lang = xxhash.xxh64_intdigest(b"en", seed=0)
    seeds = []
    counts = collocations.word_counts
    monkeypatch.setattr(collocations, "word_counts", lambda docs, seed, *more: seeds.append(seed) or counts(docs, seed, *more))
    rows = phrase_rows(n=60)
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = collocations.collocations(docs, code_of=lambda word, seed: 77 if seed == lang and word in (b"river", b"garden") else xxhash.xxh64_intdigest(word, seed=seed))
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows)
    assert seeds == [0, 1]


# -- 13 ----------------------------------------------------------------------------------------------------


def brute_negatives(rows, anchor, positives=5, negatives_=10):
    live = [(i, v, label) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    live = [(n, i, [math.floor(256 * float(np.float32(x))) for x in v], label) for n, (i, v, label) in enumerate(live)]
    clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    out = []
    for n, i, v, label in live:
        if i % anchor:
            continue
        scored = sorted((-clip(sum(a * b for a, b in zip(v, w, strict=True))), j, m, other == label) for m, j, w, other in live if m != n and len(w) == len(v))
        for p, j, _, _ in [s for s in scored if s[3]][:positives]:
            found = [s for s in scored if not s[3] and 30 * -p <= 100 * -s[0] <= 90 * -p][:negatives_]
            out += [(i, j, rank + 1, s[1], -p, -s[0]) for rank, s in enumerate(found)]
    return sorted(out)


def mined(spark, rows, anchor, **more):
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], "vec_id long, embedding array<float>, label int, score int, uid int").repartition(3)
    return sorted(map(tuple, negatives.mine(negatives.quantised(df), F.col("vec_id") % anchor == 0, **more).collect()))


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(0.1, 0.15, 8).astype(np.float32)], int(i % 3)) for i in range(300)]
    rows += [(1000 + i, rows[7][1], i % 3) for i in range(40)]  # ties
    rows += [rows[10], rows[10], rows[21]]  # repeated anchors
    rows += [(None, rows[0][1], 1), (2000, None, 1), (2010, rows[0][1], None), (2020, [0.1] * 7 + [None], 1), (2030, [0.1] * 7 + [float("nan")], 1), (2040, [float("inf")] * 8, 1)]
    rows += [(3000 + i, [0.2, 0.3 + i / 100], i % 2) for i in range(12)] + [(4000, [], 0), (4001, [], 0), (4002, [], 1)]
    return rows


def test_negatives(spark, vectors):
    want = brute_negatives(vectors, 10)
    assert mined(spark, vectors, 10) == want
    assert len(want) > 300


def test_negatives_in_many_blocks_and_small_products(spark, vectors, monkeypatch):
    monkeypatch.setattr(negatives, "CELLS", 64)
    assert mined(spark, vectors, 10, block_bytes=1000) == brute_negatives(vectors, 10)
    assert mined(spark, vectors, 10, positives=2, negatives=3) == brute_negatives(vectors, 10, 2, 3)


def test_negatives_beyond_float64(spark):
    r = np.random.default_rng(6)
    for scale in (3e6, 1e16):
        rows = [(i, [float(x) for x in (r.normal(1, 0.3, 4) * scale).astype(np.float32)], int(i % 2)) for i in range(60)]
        assert mined(spark, rows, 10) == brute_negatives(rows, 10)


def test_negatives_of_nothing(spark, vectors):
    assert mined(spark, vectors[:0], 10) == []
    assert mined(spark, vectors[1:9], 100) == []
    assert mined(spark, [vectors[0]], 10) == []
