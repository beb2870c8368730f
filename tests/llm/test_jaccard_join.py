"""Operator 9 against brute force over explicit shingle sets."""

import random
import re

import numpy as np

from tagwave.llm import jaccard_join as J
from tagwave.llm.jaccard_join import jaccard_components, prefix_keys

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, n=3):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1)))


def brute(rows, words=3, percent=90):
    sets = [shingles(t, words) for _, t in rows]
    ids = [d for d, _ in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    low = {}
    for d, c in zip(ids, comp):
        low[c] = min(d, low.get(c, d))
    return sorted((d, len(s), low[c]) for d, s, c in zip(ids, sets, comp))


def made_texts(n=120, seed=4):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows, base = [], []
    for i in range(n):
        if base and rng.random() < 0.6:
            words = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                at = rng.randrange(len(words))
                words[at:at + rng.choice([0, 1])] = [rng.choice(vocab)]
        else:
            words = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 12, 40, 100, 250]))]
        base.append(words)
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w.upper() if rng.random() < 0.1 else w for w in words)))
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df, **kw).collect())


def test_matches_brute_force(spark):
    rows = made_texts() + [(500, None), (501, ""), (502, " \n\t"), (503, "é É"), (504, "É é"), (505, "x"), (506, "X")]
    assert run(spark, rows) == brute(rows)


def test_small_tiles_lose_no_link(spark):
    rows = made_texts(60, 9)
    assert run(spark, rows, tile=3) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, set_id string, component string")
    assert jaccard_components(df).collect() == []
    df = spark.createDataFrame([(1, "a b c d", "x", "y"), (2, "a b c d", None, None)],
                               "doc_id bigint, text string, set_id string, component string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard_components(df).collect()) == [(1, 1), (2, 1)]


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e"), (1, "q r s t u"), (1, "a b c d e"), (2, "q r s t u"), (None, "q r s t u"), (None, "z z z y")]
    out = jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in out) == [(0, 0), (0, 1), (1, 1), (1, 1), (1, 1), (2, 1)]


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(3)
    counts = rng.integers(1, 50, J.COUNTERS)
    for percent in (80, 90):
        for size in (1, 2, 5, 10, 19, 60, 400):
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            for _ in range(20):
                b = np.unique(np.concatenate([rng.permutation(a)[size * (100 - percent) // 200:], rng.integers(0, 2**63, size * (100 - percent) // 250, dtype=np.uint64)]))
                if 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)):
                    assert set(prefix_keys(a, counts, percent)) & set(prefix_keys(b, counts, percent))


def test_places_of_the_first_common_key_keep_linked_pairs():
    """Sets in one order: at their first common member, a linked pair is never ruled out by the places."""
    rng = np.random.default_rng(6)
    counts, kept, ruled_out = rng.integers(1, 50, J.COUNTERS), 0, 0
    for percent in (80, 90):
        for size in (2, 10, 60, 300):
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            for _ in range(40):
                change = rng.integers(0, 1 + size * (110 - percent) // 100)
                b = np.unique(np.concatenate([rng.permutation(a)[change:], rng.integers(0, 2**63, change // 2, dtype=np.uint64)]))
                keys = [prefix_keys(s, counts, percent).tolist() for s in (a, b)]
                common = [k for k in keys[0] if k in set(keys[1])]
                both = len(np.intersect1d(a, b))
                linked = 100 * both >= percent * (len(a) + len(b) - both)
                places = np.array([k.index(common[0]) for k in keys]) if common else None
                found = common and J.tile_pairs_of(np.array([len(a), len(b)]), np.array([1, 2]), places, None, 0, percent)
                assert found or not linked
                kept, ruled_out = kept + bool(found), ruled_out + (not found)
    assert kept and ruled_out


def test_five_words_and_eighty_percent(spark):
    rows = made_texts(150, 21)
    assert run(spark, rows, words=5, percent=80) == brute(rows, 5, 80)


def test_group_of_near_copies_around_a_base(spark, monkeypatch):
    """Copies that link to the base alone, or to some others, over several tiles and without rounds of centres as well."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(170)]
    rows = [(0, " ".join(base))]
    for i in range(1, 90):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"c{rng.randrange(50)}" for _ in range(60)) + " the same closing line of many pages here") for i in range(40)]
    wanted = brute(rows, 5, 80)
    assert run(spark, rows, words=5, percent=80, tile=8) == wanted
    monkeypatch.setattr(J, "ROUNDS", 1)
    monkeypatch.setattr(J, "centre_pairs", lambda found, *_: found.selectExpr("set_id AS a", "set_id AS b").limit(0))
    assert run(spark, rows, words=5, percent=80, tile=16) == wanted


def test_arrow_batches_of_sets_are_small(spark):
    docs = spark.createDataFrame([(i, f"{i} " + "word " * 2000) for i in range(3000)], "doc_id bigint, text string").coalesce(1)
    def sizes(batches):
        for batch in batches:
            yield J.pa.record_batch([J.pa.array([batch.nbytes])], names=["n"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    with J.small_batches(spark):
        inside = [r.n for r in docs.mapInArrow(sizes, "n bigint").collect()]
    assert sum(inside) > 30_000_000 and max(inside) < 5_000_000
    assert spark.conf.get(name, None) is None
    J.jaccard_components(docs.limit(20))
    assert spark.conf.get(name, None) is None


def test_linked_sets_share_a_part_and_others_none():
    """Linked sets of all sizes share a key; sets with a few common members, as chance makes them in large tables, share none."""
    rng = np.random.default_rng(12)
    linked = 0
    for percent in (80, 90):
        for size in (1, 2, 3, 5, 8, 10, 19, 20, 60, 150, 400):
            for _ in range(40):
                a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
                b = np.unique(np.concatenate([rng.permutation(a)[rng.integers(0, 1 + size * (100 - percent) // 150):],
                                              rng.integers(0, 2**63, rng.integers(0, 1 + size * (100 - percent) // 150), dtype=np.uint64)]))
                if 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)):
                    linked += 1
                    assert set(J.part_keys(a, percent)) & set(J.part_keys(b, percent)), (percent, size)
    assert linked > 600
    common = rng.integers(0, 2**63, 6, dtype=np.uint64)
    for _ in range(40):
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, 300, dtype=np.uint64)])) for _ in range(2))
        assert not set(J.part_keys(a, 90)) & set(J.part_keys(b, 90))


def test_sets_that_share_single_shingles_make_no_rows(spark):
    """Texts with one common passage each share its shingles, the rarest they have, but no key."""
    rng = random.Random(3)
    rows = [(i, " ".join([f"r{i // 2}", f"s{i // 2}", f"t{i // 2}"] + [f"w{rng.randrange(400)}" for _ in range(300)])) for i in range(60)]
    rows += [(100, rows[0][1] + " end")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = J.written(J.shingle_sets(docs, "doc_id", "text", 3, 90), "sets")
    of = {r.row_key: r for r in sets.collect()}
    held = {r.set_id for r in J.shared_rows(sets).collect()}
    near = {r.set_id for r in of.values() if r.doc_id in (0, 100)}
    assert len(near) == 2 and held == near
    assert run(spark, rows) == brute(rows)
