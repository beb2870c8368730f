"""Operator 10: planted exact and edited copies, a brute-force aligner, clean rows and odd rows."""

import random

import numpy as np

import tagwave.llm.decontaminate as decontaminate_module
from tagwave.llm.decontaminate import GAP, MATCH, MISMATCH, align, decontaminate, leaks


def brute_align(a, b):
    best = 0
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            rows[i][j] = max(0, rows[i - 1][j - 1] + (MATCH if a[i - 1] == b[j - 1] else MISMATCH),
                             rows[i - 1][j] + GAP, rows[i][j - 1] + GAP)
            best = max(best, rows[i][j])
    return best


def test_alignment_score_matches_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(60):
        a = rng.integers(0, 6, rng.integers(1, 25)).astype(np.uint64)
        b = rng.integers(0, 6, rng.integers(0, 40)).astype(np.uint64)
        points, first, end = align(a, b)
        assert points == brute_align(a, b)
        if points:
            assert brute_align(a, b[first:end]) == points


def planted():
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(400)]
    common = "of the and that in to a is".split()
    word = lambda: rng.choice(common) if rng.random() < 0.4 else rng.choice(vocab)
    prose = lambda n: [word() for _ in range(n)]
    items = [prose(rng.choice([14, 25, 40, 59])) for _ in range(20)]
    docs, leaked = [], set()
    for d in range(120):
        body = prose(rng.choice([5, 60, 300]))
        if d % 4 == 0:
            item = list(rng.choice(items))
            for _ in range(0 if d % 8 else len(item) // 10):  # edited copies: one word in ten
                item[rng.randrange(len(item))] = rng.choice(vocab)
            at = rng.randrange(len(body) + 1)
            body[at:at] = item
            leaked.add(d)
        docs.append((d, " ".join(w.capitalize() + "," if rng.random() < 0.2 else w for w in body)))
    return docs, [(i, " ".join(w)) for i, w in enumerate(items)], leaked


def test_planted_copies_found_and_clean_rows_kept(spark):
    docs, items, leaked = planted()
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame(items, "item_id bigint, text string")
    assert {r.doc_id for r in leaks(docs, items).collect()} == leaked
    assert {r.doc_id for r in decontaminate(docs, items).collect()} == set(range(120)) - leaked


def test_edited_copies_beside_a_verbatim_one(spark):
    short, long = [f"s{i}" for i in range(16)], [f"l{i}" for i in range(40)]
    edit = lambda words, at: " ".join("other" if i in at else w for i, w in enumerate(words))
    docs = [(1, edit(short, ())), (2, edit(short, (5, 11))), (3, edit(long, ())), (4, edit(long, range(5, 40, 6))),
            (5, " ".join(long[:20])), (6, " ".join(short[:7]))]
    docs += [(10 + i, edit(short, (5, 11)) + f" tail{i}") for i in range(20)]
    found = leaks(spark.createDataFrame(docs, "doc_id bigint, text string"),
                  spark.createDataFrame([(1, " ".join(short)), (2, " ".join(long))], "item_id bigint, text string"))
    share = {r.doc_id: r.share for r in found.collect()}
    assert set(share) == {1, 2, 3, 4, 5, *range(10, 30)}
    assert share[2] == 26 / 32 and share[5] == 0.5


def test_a_phrase_of_many_items_makes_no_candidates(spark, monkeypatch):
    phrase = "which of the following is".split()
    tail = lambda name, n: [f"{name}{i}" for i in range(n)]
    items = [(i, " ".join(phrase + tail(f"i{i}x", 20))) for i in range(60)]
    docs = [(d, " ".join(tail(f"d{d}a", 30) + phrase + tail(f"d{d}b", 30))) for d in range(200)]
    docs.append((900, items[7][1]))
    seen = []
    real = decontaminate_module.written
    monkeypatch.setattr(decontaminate_module, "written", lambda df, name, *a: seen.append((name, real(df, name, *a))) or seen[-1][1])
    found = leaks(spark.createDataFrame(docs, "doc_id bigint, text string"),
                  spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert [(r.doc_id, r.item_id, r.share) for r in found] == [(900, 7, 1.0)]
    assert [r.key for name, t in seen if name == "windows" for r in t.collect()] == [found[0].key]


def test_recall_against_aligning_all_pairs(spark):
    rng = random.Random(9)
    words = [f"v{i}" for i in range(3000)]
    items = [[rng.choice(words) for _ in range(rng.choice([8, 16, 40]))] for _ in range(30)]
    items += [["choose", "the", "best", "answer", "for"] + [rng.choice(words) for _ in range(20)] for _ in range(30)]
    rows, kinds = [], {}
    for d in range(240):
        item, kind = list(rng.choice(items)), d % 4
        step = {0: 0, 1: 5, 2: 4, 3: 0}[kind]  # verbatim, every fifth word changed, every fourth, inserted words
        if step:
            item = [rng.choice(words) if i % step == step - 1 else w for i, w in enumerate(item)]
        if kind == 3:
            item = [x for i, w in enumerate(item) for x in ([w, rng.choice(words)] if i % 5 == 4 else [w])]
        rows.append((d, " ".join([rng.choice(words) for _ in range(20)] + item + [rng.choice(words) for _ in range(20)])))
        kinds[d] = kind
    number = {w: i for i, w in enumerate(sorted({w for r in rows for w in r[1].split()} | {w for i in items for w in i}))}
    code = lambda ws: np.array([number[w] for w in ws], np.uint64)
    texts, wanted = [code(t.split()) for _, t in rows], [code(i) for i in items]
    expected = {(d, i) for d, t in enumerate(texts) for i, w in enumerate(wanted)
                if np.isin(w, t).sum() >= len(w) / 2 and align(w, t)[0] >= len(w)}
    found = leaks(spark.createDataFrame(rows, "doc_id bigint, text string"),
                  spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert got <= expected
    for kind in range(4):
        of_kind = {p for p in expected if kinds[p[0]] == kind}
        assert len(of_kind) >= 50 and len(got & of_kind) >= 0.95 * len(of_kind), kind


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, 1), (2, "", 1), (3, "one two three four five six", 1), (3, "one two three four five six", 1),
         (3, "quite other words in this row here", 1), (None, "One, two; three four five six!", 1), (4, "yes", 1),
         (5, "filler " * 30000 + "one two three four five six", 1)],
        "doc_id bigint, text string, key int")
    items = spark.createDataFrame([(1, "one two three four five six"), (1, "one two three four five six"), (2, None),
                                   (3, ""), (4, "yes")], "item_id bigint, text string")
    kept = decontaminate(docs, items)
    assert kept.columns == ["doc_id", "text", "key"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]
    assert decontaminate(docs, items.limit(0)).count() == 8
    assert decontaminate(docs.limit(0), items).count() == 0


def test_only_texts_with_windows_travel(spark):
    texts = spark.createDataFrame([(k * 2**54, f"text {k}") for k in range(-500, 500)], "key bigint, text string")
    wanted = spark.createDataFrame([(k * 2**54,) for k in range(-500, 500, 7)], "key bigint")
    got = {r.key for r in decontaminate_module.likely_texts(texts, wanted).collect()}
    assert got >= {r.key for r in wanted.collect()} and len(got) < 200
    assert decontaminate_module.likely_texts(texts, wanted.limit(0)).collect() == []
