"""Operator 6: held-out accuracy, the label model's recovery of accuracies, odd rows."""

import zlib

import numpy as np
import pytest

from tagwave.llm.toxicity import label_model, prefix_hash, score, train

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = train(docs, labels)
    return model, docs, labels, {r.doc_id: r for r in score(docs, model).collect()}


def test_held_out_accuracy(scored):
    _, docs, labels, out = scored
    assert len(out) == docs.count()
    hits = [(out[r.doc_id].predicted, r.toxic) for r in labels.collect() if r.doc_id in out and out[r.doc_id].held_out]
    assert np.mean([p == t for p, t in hits]) > 0.93
    assert np.mean([t for p, t in hits if p]) > 0.9


def test_folds_and_scores(scored):
    _, _, _, out = scored
    for d, r in out.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)


def test_label_model_recovers_rates_and_discounts_copies():
    rng = np.random.default_rng(1)
    y = rng.random(6000) < 0.3
    rates = np.array([[0.1, 0.05, 0.2, 0.1], [0.7, 0.6, 0.3, 0.65]])
    fired = (rng.random((6000, 4)) < np.where(y[:, None], rates[1], rates[0])).astype(float)
    fired = np.hstack([fired, fired[:, 2:3], fired[:, 2:3]])  # a weak voter three times
    start = np.array([[0.2, 0.2, 0.2, 0.2, 0.2, 0.2], [0.5, 0.5, 0.4, 0.5, 0.4, 0.4]])
    q = label_model(fired, start, 0.3)
    assert np.mean((q > 0.5) == y) > 0.88


def test_odd_rows(spark, scored):
    model = scored[0]
    schema = "doc_id bigint, text string, score string, held_out int"
    rows = [(1, None, "x", 1), (2, "", None, None), (None, "You idiot, you worthless moron!", "x", 0),
            (4, "calm words " * 40000, "x", 0), (4, "calm words " * 40000, "x", 0)]
    out = score(spark.createDataFrame(rows, schema), model).collect()
    assert [r.doc_id for r in out] == [1, 2, None, 4, 4]
    assert out[0].score == out[1].score < 0.3 and out[2].score > 0.7 and out[4].score < 0.3
    empty = spark.createDataFrame([], schema)
    assert score(empty, model).collect() == []
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    bare = train(empty, labels)
    assert score(spark.createDataFrame(rows, schema), bare).collect()[2].predicted == 1
    assert prefix_hash("Idiot") == prefix_hash("idiot")
