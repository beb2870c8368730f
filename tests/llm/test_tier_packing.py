"""Hierarchical packing: exact cover, tiers without padding, balanced steps, ids equal to the tokenizer's own."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tagwave.llm import queries
from tagwave.llm import tier_packing as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.01"


def check_cover(lengths, sequences, window=T.WINDOW):
    parts = [[] for _ in lengths]
    for sequence in sequences:
        total = sum(n for _, _, n in sequence)
        assert 0 < total <= window and total & (total - 1) == 0
        for doc, start, n in sequence:
            assert n > 0
            parts[doc].append((start, n))
    for doc, held in enumerate(parts):
        at = 0
        for start, n in sorted(held):
            assert start == at
            at += n
        assert at == lengths[doc]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 70), st.integers(1, 1024), st.integers(1, 9000)), max_size=60),
       st.sampled_from([(1024, 128), (64, 2), (256, 256)]))
def test_every_token_lies_in_one_piece(lengths, sizes):
    check_cover(lengths, T.pack_tiers(lengths, *sizes), sizes[0])


def test_whole_documents_stay_whole_where_they_fit():
    rnd = random.Random(3)
    lengths = [max(1, int(rnd.lognormvariate(6.2, 1))) for _ in range(5000)]
    sequences = T.pack_tiers(lengths)
    least = sum(-(-n // T.WINDOW) for n in lengths)
    assert sum(map(len, sequences)) < 1.1 * least
    tiers = {sum(n for _, _, n in s) for s in sequences}
    assert {1024, 512, 256} <= tiers
    # long windows were filled from shorter tiers, not by cutting alone
    filled = [s for s in sequences if sum(n for _, _, n in s) == 1024 and len(s) > 1]
    assert sum(all(n == lengths[d] for d, _, n in s) for s in filled) > len(filled) / 2


def test_equal_lengths_and_exact_sizes():
    for n in (1, 64, 128, 512, 700, 1023, 1024, 1025):
        check_cover([n] * 300, T.pack_tiers([n] * 300))
    assert T.pack_tiers([]) == []


def test_step_groups_are_balanced():
    rnd = random.Random(5)
    sequences = T.pack_tiers([rnd.randint(1, 3000) for _ in range(3000)])
    groups = T.step_groups(sequences, 16_384)
    tokens, cost = np.zeros(max(groups) + 1), np.zeros(max(groups) + 1)
    for g, s in zip(groups, sequences):
        tokens[g] += sum(n for _, _, n in s)
        cost[g] += sum(n * n for _, _, n in s)
    assert tokens.max() - tokens.min() <= 1024
    assert cost.max() / cost.mean() < 1.15


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab C'1,.\n\t é　中<|>\x1c\x85\xa0sßЖ😀"), max_size=14), max_size=30))
def test_ids_equal_the_tokenizer(texts):
    encode = T.encoder(PATH)
    texts = [*texts, "", "x<|endoftext|> y", "a  b", "end  ", "we'll, it's"]
    ids, off = encode(pa.array(texts), slice_bytes=40)
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == encode._slow_ids(texts)


def test_whole_table_round_trip(spark):
    from tokenizers import Tokenizer

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tokenizer = Tokenizer.from_file(PATH)
    wanted = {d: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for d, t in docs.items()}
    rows = queries.op12_tier_packing(spark, SF).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(wanted[r.doc_id][r.start:r.start + r.length])
        assert r.doc_tokens == len(wanted[r.doc_id])
    assert set(by_doc) == set(docs)
    for d, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0
            at += r.length
        assert at == len(wanted[d])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == pieces[0].capacity <= 1024 and at & (at - 1) == 0
        assert len({r.step_group for r in pieces}) == 1


def test_odd_rows(spark):
    rows = [(1, None, 7), (2, "", 7), (2, "", 7), (None, "word", 7), (4, "many words " * 40_000, 7), (5, "tie", 1), (6, "tie", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id long").repartition(2)
    out = T.pack(docs, PATH).collect()
    total = {}
    for r in out:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total[1] == 1 and total[2] == 2 and total[None] == 2 and total[4] > 80_000 and total[5] == total[6]
    assert T.pack(docs.limit(0), PATH).collect() == []
    with pytest.raises(ValueError):
        T.pack(docs, PATH, window=1000)
