"""The pipeline over planted rows: what must go goes, clean documents stay, and ids are the library's."""

import hashlib
import random

import public_tokenizers
import tiktoken

import corpus_pipeline
from kanaforge.llm import bpe

WORDS = "the of and light river stone winter garden letter morning silver window forest engine market".split()


def text_of(seed, n=60):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (r.choice("abcdefgh") * 2 + str(r.randint(10, 99)) if r.random() < 0.4 else "") for _ in range(n))


def test_pipeline(spark, tmp_path):
    rows, labels, clean, junk, toxic, copies = [], [], set(), set(), set(), set()
    for i in range(600):
        words = text_of(i).split()
        if i % 6 == 1:
            words, _ = [w + "%%%" for w in words], junk.add(i)
        elif i % 6 == 2:
            words[5], words[30], _ = "idiot", "moron" if i % 4 else "idiot", toxic.add(i)
        else:
            clean.add(i)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i not in junk), int(i in toxic)))
    for k, i in enumerate(sorted(clean)[:40]):  # exact copies, and copies with one word changed
        words = rows[i][1].split()
        if k % 2:
            words[20] = "other"
        rows.append((1000 + i, " ".join(words)))
        copies.add(1000 + i)
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert clean <= set(got)
    assert len(set(got) & junk) <= 0.05 * len(junk) and len(set(got) & toxic) <= 0.05 * len(toxic)
    assert not {i for i in copies if i % 2 == 0 and dict(rows)[i] == dict(rows)[i - 1000]} & set(got)
    assert len(set(got) & copies) <= 2
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for i, r in got.items():
        ids = library.encode_ordinary(dict(rows)[i])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_stages_return_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), folder)
        assert out.columns == docs.columns and out.count() == 0, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "simhash", "mixing", "bpe"]
