"""Lexical search against a plain scorer, and its packed accumulators."""

import math
import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra.numpy import arrays

from tagwave.llm import lexical_search as S

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(docs, items, top=10):
    """[(item number, rank, doc_id, score)] by scoring every document for every item."""
    counted = [(d, Counter(terms_of(t))) for d, t in docs]
    held = [(d, c) for d, c in counted if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for number, (_, text) in enumerate(items):
        scored = []
        for d, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in terms_of(text) if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(number, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored)[:top])]
    return out


@settings(max_examples=60, deadline=None)
@given(arrays(np.int64, st.tuples(st.integers(1, 5), st.integers(1, 30)),
              elements=st.one_of(st.just(0), st.integers(0, 300), st.integers(0, 2**62))))
def test_packed_sums_round_trip(sums):
    assert (S.unpack_sums(S.pack_sums(sums), *sums.shape) == sums).all()


def test_search_equals_plain_scoring(spark):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(60)] + ["Éa", "日本", "x9", "THE", "the"]

    def text(n):
        return "".join(rnd.choice(words[: rnd.choice([5, 30, 65])]) + rnd.choice([" ", ", ", "-", "\n", "\x7f"]) for _ in range(n))

    docs = [(i, text(rnd.randint(0, 40))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, " ,;"), (None, text(20)), (303, docs[0][1]), (0, docs[0][1]), (304, text(30_000))]
    items = [(i, text(rnd.randint(1, 25))) for i in range(40)] + [(40, None), (41, "unseen"), (5, "w1 w1 w2"), (None, "w3")]
    d = spark.createDataFrame([(a, t, 1, "x") for a, t in docs], "doc_id long, text string, shard int, term string").repartition(3)
    q = spark.createDataFrame([(a, t, 0) for a, t in items], "item_id long, text string, slot int")
    wanted = sorted((items[n][0] if items[n][0] is not None else -1, k, d if d is not None else -1, s)
                    for n, k, d, s in plain_search(docs, items))
    for options in ({}, {"owners": 1}, {"owners": 7, "shard_rows": 16, "bundle_items": 3, "block_terms": 40}):
        got = sorted((r.item_id if r.item_id is not None else -1, r.rank, r.doc_id if r.doc_id is not None else -1, r.score)
                     for r in S.search(d, q, **options).collect())
        assert got == wanted


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert S.search(docs.limit(0), items).collect() == []
    assert S.search(docs, items.limit(0)).collect() == []
    assert S.search(docs.withColumn("text", docs.text.substr(0, 0)), items).collect() == []
    assert [tuple(r) for r in S.search(docs, items).collect()] == [(1, 1, 1, 2 * 287 * (10**9 // 1800))]
