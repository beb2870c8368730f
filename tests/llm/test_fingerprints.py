"""Operator 5: edited texts against plain Python, estimates against true set sizes, odd rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tagwave.llm.fingerprints import edited_fingerprints, merged, with_likeness, with_sketch

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def edited(texts):
    out = []
    for i, t in enumerate(texts):
        m = len(t) // 4
        out.append(t[:len(t) - m] + texts[(i + 1) % len(texts)][:m])
    return out


@pytest.fixture(scope="module")
def result(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    return rows, {r.doc_id: r for r in edited_fingerprints(docs).collect()}


def test_edited_texts(result):
    rows, out = result
    assert len(out) == len(rows)
    for (d, t), e in zip(rows, edited([t for _, t in rows])):
        assert out[d].n_chars == len(t)
        assert out[d].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()


def test_estimates_follow_the_true_sets(result):
    rows, out = result
    far = 0
    for (d, t), e in zip(rows, edited([t for _, t in rows])):
        a, b = shingles(t), shingles(e)
        if not a or not b:
            continue
        far += abs(out[d].jaccard_edited - len(a & b) / len(a | b)) > 0.15
        if len(a | b) <= 64:
            assert out[d].jaccard_edited == pytest.approx(len(a & b) / len(a | b))
        far += abs(out[d].near_edited - len(a & b) / min(len(a), len(b))) > 0.2
        assert out[d].near_edited >= out[d].jaccard_edited
    assert far <= 0.06 * len(rows)
    same = {}
    for d, t in rows:
        assert same.setdefault(t, out[d].fingerprint) == out[d].fingerprint


def test_merge_and_containment_of_unequal_texts(spark):
    long = " ".join(f"w{i}" for i in range(6000))
    part = " ".join(f"w{i}" for i in range(2000, 2900))
    df = spark.createDataFrame([(long, part)], "a string, b string")
    df = with_sketch(with_sketch(df, "a", "sa"), "b", "sb")
    df = with_likeness(df, "sa", "sb", "c", "j").withColumn("m", merged(F.col("sa"), F.col("sb")))
    r = df.first()
    assert r.c > 0.95 and r.j == pytest.approx(0.15, abs=0.06)
    assert r.m.hashes == sorted(set(r.sa.hashes) | set(r.sb.hashes))


def test_odd_rows(spark):
    schema = "doc_id bigint, text string, key string, sketch string"
    rows = [(1, "", "k", "s"), (2, None, "k", "s"), (3, "a", "k", "s"), (3, "a", "k", "s"), (3, "abcd efgh", "k", "s"),
            (None, "zzzz yyyy", None, None), (9, "word " * 60000, None, None)]
    out = edited_fingerprints(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == 7
    by = {(r.doc_id, r.n_chars): r for r in out}
    assert by[1, 0].edited_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[1, 0].near_next == 1.0 and by[2, 0].near_edited == 1.0 and by[2, 0].near_next == 0.0
    n = 300000
    assert by[9, n].edited_sha256 == hashlib.sha256((("word " * 60000)[:n - n // 4] + "zzzz yyyy").encode()).hexdigest()
    assert edited_fingerprints(spark.createDataFrame([], schema)).collect() == []
    one = edited_fingerprints(spark.createDataFrame([(5, "only one here", "k", "s")], schema)).first()
    assert one.near_next == 1.0
