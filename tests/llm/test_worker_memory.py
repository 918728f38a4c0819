"""What Python workers keep and are sent: one operator's words at a time, and batches of bounded bytes."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from kanaforge.llm import bpe, quality, simhash, toxicity
from kanaforge.llm.queries import BPE_RANKS

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def session(spark):
    before = spark.conf.get(BATCH)
    yield spark
    spark.conf.set(BATCH, before)


def test_a_worker_keeps_the_words_of_one_operator(session):
    docs = session.createDataFrame([(i, f"river stone {i} clear water no{i % 50}") for i in range(400)], "doc_id long, text string").repartition(8)
    cost = toxicity.language_model(np.zeros(toxicity.SYMBOLS**3))
    weights = np.zeros(quality.DIM + 1, np.float32)

    def kept(parts):
        from kanaforge.llm import bpe, quality, toxicity

        for part in parts:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (len(quality._WORDS), len(toxicity._KEPT), len(bpe._KEPT))], ["quality", "toxicity", "bpe"])

    def look():
        return [tuple(r) for r in docs.select("doc_id").mapInArrow(kept, "quality long, toxicity long, bpe long").collect()]

    runs = [
        lambda: docs.select(quality.score_column(docs, weights)).collect(),
        lambda: docs.select(toxicity.score_column(docs, cost, weights)).collect(),
        lambda: bpe.round_trip(docs, public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN).collect(),
        lambda: docs.select(quality.score_column(docs, weights)).collect(),
    ]
    for at, run in enumerate(runs):
        run()
        found = look()
        assert any(x[at % 3] for x in found) and all(sum(n > 0 for n in x) <= 1 for x in found), (at, found)


def test_what_a_worker_keeps_goes_when_another_operator_starts():
    quality.keep_words()
    quality._WORDS[b"river"]
    cost = toxicity.language_model(np.zeros(toxicity.SYMBOLS**3))
    restorer, _ = toxicity.kept(cost)
    assert restorer.restore("stone") == "stone" and not quality._WORDS
    assert toxicity.kept(cost)[0] is restorer  # tasks of the same operator share it
    quality.keep_words()
    assert not toxicity._KEPT
    quality._WORDS[b"river"]
    quality.keep_words()
    assert quality._WORDS
    simhash.remember()
    assert not quality._WORDS


def test_stages_send_texts_in_small_batches(session):
    docs = session.range(0, 400, 1, 1).selectExpr("id doc_id", "repeat(concat('x', id, ' '), 10000) text", "'en' lang", "'s' source", "1L n_chars")

    def sizes(parts):
        for part in parts:
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int64()), pa.array([part.nbytes], pa.int64())], ["n", "size"])

    for stage in (corpus_pipeline.keep_quality, corpus_pipeline.drop_toxic, corpus_pipeline.drop_near_copies, corpus_pipeline.encode):
        session.conf.set(BATCH, 64 << 20)
        stage(session, docs.limit(0), "/root/testdata/sf0.001")
        got = docs.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r["n"] for r in got) == 400 and max(r["size"] for r in got) <= 2 * corpus_pipeline.BATCH_BYTES, stage.__name__
