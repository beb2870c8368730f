"""Operator 7: every token packed once, no overfull bin, bins downsized, cost no worse than one size."""

import random
import re

import pyarrow as pa

from tagwave.llm.packing import CAPACITIES, OVERHEAD, pack, pack_shard, token_counts

SF = "/root/testdata/sf0.001"


def test_every_token_once_and_bins_fit(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = pack(docs, shard_rows=60).cache()
    pattern = re.compile(r"[^\s!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]")
    expected = {r.doc_id: len(pattern.findall(r.text)) for r in docs.collect()}
    spans, bins = {}, {}
    for r in out.collect():
        spans.setdefault(r.doc_id, []).append((r.start_token, r.n_tokens))
        bins.setdefault((r.bin_id, r.capacity), []).append((r.place, r.n_tokens))
    for doc, parts in spans.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == expected[doc]
    assert set(spans) == {d for d, n in expected.items() if n}
    for (_, capacity), parts in bins.items():
        at = 0
        for place, n in sorted(parts):
            assert place == at
            at += n
        assert at <= capacity and capacity == min(c for c in CAPACITIES if c >= at)
    assert len({b for b, _ in bins}) == len(bins)


def test_joint_sizes_cost_no_more_than_any_single_size():
    rng = random.Random(1)
    lengths = sorted((min(8192, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(3000)), reverse=True)
    cost = pack_shard(lengths)[2]
    single = pack_shard(lengths, [8192])[2]
    assert sum(lengths) <= cost <= single
    assert cost <= 1.1 * (sum(lengths) + OVERHEAD * sum(lengths) / 8192)


def test_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (3, " \n ", 5), (4, "a b.", 5), (4, "a b.", 5), (5, "x " * 20000, 5), (None, "q", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, capacity int")
    out = pack(df).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in out) == [(0, 1), (4, 3), (4, 3), (5, 3616), (5, 8192), (5, 8192)]
    assert pack(df.limit(0)).collect() == []
    assert token_counts(pa.array([None, "", "a b. c's", "é-ü", "..."])).tolist() == [0, 0, 6, 3, 3]
