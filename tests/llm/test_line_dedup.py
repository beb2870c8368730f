"""Operator 2: exact and edited copies go, one line of each stays; compared with brute force; odd rows."""

import random

from pyspark.sql import functions as F

import pytest

from tagwave.llm import line_dedup
from tagwave.llm.line_dedup import dedup_lines, links


def grams(line):
    return {line[i:i + 5] for i in range(max(1, len(line) - 4))}


def brute(rows):
    """Lines kept per row, with links between all pairs of different lines."""
    seen, comp = [], {}
    for d, t in rows:
        for p, raw in enumerate((t or "").split("\n")):
            line = raw.strip(" \t\r").lower()
            if line:
                seen.append((d, p, line))
                comp.setdefault(line, line)
    names = sorted(comp)
    for i, a in enumerate(names):
        for b in names[:i]:
            x, y = grams(a), grams(b)
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
                old, new = comp[a], comp[b]
                comp = {k: new if c == old else c for k, c in comp.items()}
    first = {}
    for d, p, line in sorted(seen):
        first.setdefault(comp[line], (d, p))
    gone = {(d, p) for d, p, line in seen if first[comp[line]] != (d, p)}
    return {d: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (d, p) not in gone)
            for d, t in rows}


def test_matches_brute_force(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(200)]
    pool, rows = [], []
    for d in range(70):
        out = []
        for _ in range(rng.randint(0, 8)):
            if pool and rng.random() < 0.4:
                words = list(rng.choice(pool))
                if rng.random() < 0.6:
                    words[rng.randrange(len(words))] = rng.choice(vocab)
            else:
                words = [rng.choice(vocab) for _ in range(rng.choice([1, 3, 12, 30, 60]))]
            pool.append(words)
            out.append(rng.choice(["", "  "]) + " ".join(words) + rng.choice(["", "\r"]))
            if rng.random() < 0.2:
                out.append("")
        rows.append((d, "\n".join(out)))
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    expected = brute(rows)
    wrong = [d for d in expected if got[d] != expected[d]]
    assert len(wrong) <= 3, wrong  # banding may miss a link now and then


@pytest.mark.parametrize("few", [3, 32])
def test_all_lines_of_a_band_meet(spark, monkeypatch, few):
    """Four kinds of lines in one band, in turns by length: neither the first nor the one before is of a line's kind."""
    monkeypatch.setattr(line_dedup, "FEW", few)
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100)) for _ in range(4)]
    kinds = {b + "0123456789"[:i]: k for i in range(6) for k, b in enumerate(base)}
    found = (spark.createDataFrame([(x,) for x in kinds] * 2, "line string").withColumn("h", F.xxhash64("line")))
    signed = found.select("h", F.length("line").cast("int").alias("length"), F.array(F.lit(7).cast("bigint")).alias("bands"))
    group = {r.node: r.component for r in links(signed, found).collect()}
    h = {r.line: r.h for r in found.collect()}
    assert len({group.get(h[x]) for x in kinds}) == 4
    assert all((group[h[x]] == group[h[y]]) == (kinds[x] == kinds[y]) for x in kinds for y in kinds)


def test_odd_rows(spark):
    schema = "doc_id bigint, text string, n_chars bigint, key string, h int, line string"
    rows = [(1, None, 0, "k", 1, "l"), (2, "", 0, "k", 1, "l"), (3, "Same line here\n\n\nsame LINE here ", 9, "k", 1, "l"),
            (4, "same line here", 9, "k", 1, "l"), (4, "same line here", 9, "k", 1, "l"),
            (5, "漢字仮名交じり文" * 30, 9, None, None, None), (6, "漢字仮名交じり文" * 29, 9, None, None, None),
            (7, "x" * 150_000, 9, None, None, None), (None, "own line", 9, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    out = dedup_lines(df, length_col="n_chars")
    assert out.schema == df.schema
    got = sorted((r.doc_id or 0, r.text, r.n_chars) for r in out.where("doc_id <> 1 OR doc_id IS NULL").collect())
    assert got == [(0, "own line", 8), (2, "", 0), (3, "Same line here\n\n", 16), (4, "", 0), (4, "", 0),
                   (5, "漢字仮名交じり文" * 30, 240), (6, "", 0), (7, "x" * 150_000, 150_000)]
    assert out.where("doc_id = 1").first().text is None
    assert dedup_lines(df.limit(0)).collect() == []


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = dedup_lines(docs, length_col="n_chars").cache()
    assert out.count() == docs.count() and out.columns == docs.columns
    shown = out.select(F.explode(F.split("text", "\n")).alias("x")).select(F.lower(F.trim("x")).alias("x")).where("x <> ''")
    assert shown.groupBy("x").count().where("count > 1").count() == 0


def test_prefixes_that_share_too_little_make_no_pair(spark, monkeypatch):
    """In a wide band no pair of the similarity is lost, and pairs go whose prefixes share too little for it."""
    monkeypatch.setattr(line_dedup, "FEW", 3)
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(60)]
    texts = [[rng.choice(vocab) for _ in range(12)] for _ in range(40)]
    texts += [[*w[:11], rng.choice(vocab)] for w in texts[:20]]
    found = spark.createDataFrame([(" ".join(w),) for w in texts], "line string").withColumn("h", F.xxhash64("line")).cache()
    length = F.length("line").cast("int").alias("length")
    none = F.lit(None).cast("struct<h:bigint,length:int>").alias("o")
    rows = found.select("h", length, F.lit(1).cast("bigint").alias("band"), F.lit(len(texts)).cast("bigint").alias("n"), none)
    nothing = spark.createDataFrame([], "node bigint, component bigint")
    got = {(r.a, r.b) for r in line_dedup.other_pairs(rows, spark.createDataFrame([], "a bigint, b bigint"), nothing, found, 0.8).collect()}
    lines_ = {r.h: grams(r.line) for r in found.collect()}
    alike = {(a, b) for a in lines_ for b in lines_ if a < b and len(lines_[a] & lines_[b]) >= 0.8 * len(lines_[a] | lines_[b])}
    held = {}
    for r in line_dedup.rare_shingles(found.select("h", F.col("h").alias("group")), found, 0.8).collect():
        held.setdefault(r.shingle, set()).add(r.h)
    plain = {(a, b) for s in held.values() for a in s for b in s if a < b}
    assert alike and alike <= got <= plain and len(got) < len(plain)


def test_wide_band_of_half_alike_lines_makes_few_pairs(spark):
    """One band of near copies of one line, most of them just below the similarity: all that is similar is linked, and only pairs
    near the similarity are made, however many shingles the others share."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    base = [word() for _ in range(40)]
    texts = {" ".join(base)}
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(40), rng.choice([1, 2, 5, 6, 7])):
            words[at] = word()
        texts.add(" ".join(words))
    found = spark.createDataFrame([(t,) for t in texts], "line string").withColumn("h", F.xxhash64("line")).cache()
    sets = {r.h: grams(r.line) for r in found.collect()}
    share = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    alike = {p for p in share if share[p] >= 0.8}
    length = F.length("line").cast("int").alias("length")
    none = F.lit(None).cast("struct<h:bigint,length:int>").alias("o")
    rows = found.select("h", length, F.lit(1).cast("bigint").alias("band"), F.lit(len(texts)).cast("bigint").alias("n"), none)
    nothing, pairs = spark.createDataFrame([], "node bigint, component bigint"), spark.createDataFrame([], "a bigint, b bigint")
    got = {(r.a, r.b) for r in line_dedup.other_pairs(rows, pairs, nothing, found, 0.8).collect()}
    assert alike and alike <= got and min(share[p] for p in got) > 0.7 > sorted(share.values())[len(share) // 4]
    signed = found.select("h", length, F.array(F.lit(7).cast("bigint")).alias("bands"))
    group = {r.node: r.component for r in links(signed, found).collect()}
    low = {h: h for h in sets}
    for _ in sets:
        for a, b in alike:
            low[a] = low[b] = min(low[a], low[b])
    assert {h: group.get(h, h) for h in sets} == low


def test_every_shingle_of_a_line_is_signed(spark):
    """Lines of long words that differ at the heads of some words only: similar by their shingles, different by their words' heads."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(22))
    rows = []
    for k in range(0, 40, 2):
        words = [word() for _ in range(5)]
        near = [f"0{w[1:]}" if i in (1, 3) else w for i, w in enumerate(words)]
        x, y = (grams(" ".join(w)) for w in (words, near))
        assert len(x & y) >= 0.8 * len(x | y)
        rows += [(k, " ".join(words)), (k + 1, " ".join(near))]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute(rows)


def test_shingles_are_cut_at_characters(spark):
    """One shingle from each character on, characters of any width, one of a line that is shorter."""
    texts = ["abc", "abcdefg", "漢字仮名交じり", "a\U0001F600bc\U0001F601def", "aaaaaaaa", "a\u2028b cde"]
    got = {r.line: sorted(r.ring) for r in line_dedup.rings(spark.createDataFrame([(t,) for t in texts], "line string")
                                                           .withColumn("h", F.xxhash64("line"))).join(
        spark.createDataFrame([(t,) for t in texts], "line string").withColumn("h", F.xxhash64("line")), "h").collect()}
    one = spark.createDataFrame([(t, g) for t in texts for g in grams(t)], "line string, g string").select("line", F.xxhash64("g").alias("x"))
    want = {r.line: sorted(r.all) for r in one.groupBy("line").agg(F.collect_list("x").alias("all")).collect()}
    assert got == want
