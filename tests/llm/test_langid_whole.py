"""The language models hold every n-gram that was learned, seldom ones too."""

import random

from kanaforge.llm import langid


def test_no_ngram_of_a_large_script_is_left_out(spark):
    r = random.Random(2)
    words = ["".join(chr(0x4E00 + r.randrange(5000)) for _ in range(3)) for _ in range(40_000)]
    docs = spark.createDataFrame([(i, " ".join(words[i * 40 : i * 40 + 40]), "zh") for i in range(1000)], "doc_id long, text string, lang string")
    learned = [w for row in docs.where(~langid.held_out()).collect() for w in row["text"].split()]
    grams = {g for w in learned for g in langid.grams_of(w)}
    assert len(grams) > 50_000
    assert {r["gram"] for r in langid.fit(docs).grams.where(f"size = {langid.ORDER}").select("gram").collect()} == grams
