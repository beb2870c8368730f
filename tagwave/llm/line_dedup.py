"""Fuzzy line dedup by MinHash (operator 2), in DataFrame functions only.

Lines are cut at line feeds and compared trimmed and in lower case; blank lines are never touched.

1. *Exact copies* share a 64-bit hash of the line and count as one line from here on.
2. *Signatures.* All ``CHARS``-character shingles of a line, the ones that are verified, are hashed. The hash range is a ring with
   ``BANDS`` fixed points; a band is the ``ROWS`` least hashes from its point on, min-hashes of
   one permutation, so it is equal in two lines with the chance of ``ROWS`` equal min-hashes.
3. *Banding.* Lines that share a band meet, if their lengths allow the similarity. First each is paired with the first of the
   band and the one before it in length order; that links large groups of near copies by few pairs. In bands of more than ``FEW``
   lines that these leave apart each then meets its neighbours in an order of least hashes. At last all other pairs of a band in
   different components meet whose bitmaps allow the similarity (exact: sets differ at least where their bitmaps do); lines
   of a band's largest component meet only those outside it. The test is the join's condition, so no other pair is made.
4. *Verification.* Pairs get the exact Jaccard similarity of their sets of ``CHARS``-character shingles;
   ``SIMILARITY`` or more makes a link. Sketches of the lines refuse the pairs that are far from it first, and a bitmap of fixed size over the wanted lines' hashes keeps nearly all
   other lines out of the shuffle that fetches the texts.
5. *Distributed union-find* over the links; of each component the first line, by document id and
   place, stays and all others go.

A null text stays null; a text all of whose lines go becomes empty, and its row stays. Lines shorter than a
shingle are one shingle. Rows are told apart by a hash of id and text, so equal rows are cut alike.
Null ids come first. An empty table gives an empty result. Other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, passing, written

CHARS = 5
BANDS, ROWS = 18, 6
SIMILARITY = 0.8
SKETCH, FAR = 16, 0.3  # least hashes of a line's sketch, and the share of them that similar lines surpass
FEW = 32  # lines of a band up to which no neighbours are paired before all meet
MARK_WORDS = 32  # 64-bit words of the bitmap of a line's shingles
BITMAP_BITS = 26  # of the bitmap over wanted lines: 8 MB, whatever their number

#: a shingle from each character on; a line shorter than a shingle is one
_SHINGLE = f"(?s)(?=(.{{{CHARS}}}|^.{{1,{CHARS - 1}}}\\z))."
_POINTS = [-(2**63) + i * (2**64 // BANDS) + 1 for i in range(BANDS)]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.withColumn("_line_key", F.xxhash64(F.col(id_col).cast("string"), text))


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, doc_id, place, line, h): the lines that are not blank, trimmed and in lower case."""
    keyed = _keyed(docs, id_col, text_col).select(
        F.col("_line_key").alias("key"), F.col(id_col).cast("bigint").alias("doc_id"),
        F.posexplode(F.split(F.col(text_col).cast("string"), "\n")).alias("place", "raw"))
    trimmed = F.btrim("raw", F.lit(" \t\r"))
    return keyed.where(trimmed != "").withColumn("line", F.lower(trimmed)).drop("raw").withColumn("h", F.xxhash64("line"))


def rings(found: DataFrame) -> DataFrame:
    """(h, length, ring): the sorted hashes of all different shingles of each line, those that are verified."""
    return with_shingles(found, "line", "ring").select("h", F.length("line").cast("int").alias("length"), F.sort_array("ring").alias("ring"))


def signatures(found: DataFrame) -> DataFrame:
    """(h, length, bands): the band keys of each line."""
    # a point's place in the sorted hashes: its place among hashes and points, less the points before it
    placed = rings(found).select("h", "length", F.concat("ring", F.slice("ring", 1, ROWS)).alias("ring"),
                           F.sort_array(F.concat("ring", F.array(*[F.lit(p) for p in _POINTS]))).alias("marked"))
    start = [(F.array_position("marked", F.lit(p)) - i).cast("int") for i, p in enumerate(_POINTS)]
    bands = [F.xxhash64(F.lit(i), F.slice("ring", s, ROWS)) for i, s in enumerate(start)]
    return placed.select("h", "length", F.array(*bands).alias("bands"))


def band_rows(signed: DataFrame) -> DataFrame:
    """(h, length, band, n, o): each line of a band with the band's first (``o``) and the one before, and, without ``o``, once
    each line of a band of ``n`` different lines in which some have not met so."""
    # no plain explode: its inferred filter on the array would compute the bands twice
    rows = signed.select("h", "length", F.explode_outer("bands").alias("band"))
    order = Window.partitionBy("band").orderBy("length", "h")
    met = (rows.select("h", "length", "band", F.lag(F.struct("h", "length")).over(order).alias("before"),
                       F.first(F.struct("h", "length")).over(order).alias("first"))
           .withColumn("new", F.col("before").isNull() | (F.col("before.h") != F.col("h")))  # copies are neighbours
           .withColumn("n", F.sum(F.col("new").cast("int")).over(Window.partitionBy("band"))))
    both = F.when(F.col("before").isNotNull(), F.array_distinct(F.array("before", "first")))
    none = F.when(F.col("new") & (F.col("n") > 3), F.array(F.lit(None).cast("struct<h:bigint,length:int>")))  # three lines all meet
    return met.where("n > 1").select("h", "length", "band", "n", F.explode(
        F.concat(F.coalesce(both, F.array()), F.coalesce(none, F.array()))).alias("o")).where("o IS NULL OR h <> o.h")


def _fit(a: Column, b: Column) -> Column:
    """Whether the lengths of two lines allow the similarity."""
    size = lambda c: F.greatest(c - (CHARS - 1), F.lit(1))  # noqa: E731  shingles of a line, repeats included
    # repeats only shrink a set, so half of the bound is allowed for them
    return F.least(size(a), size(b)) >= F.greatest(size(a), size(b)) * (SIMILARITY / 2)


def band_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): lines to compare first; each line of a band with the band's first and the one before."""
    return (rows.where("o IS NOT NULL").where(_fit(F.col("o.length"), F.col("length")))
            .select(F.least("h", "o.h").alias("a"), F.greatest("h", "o.h").alias("b")).distinct())


def apart_rows(rows: DataFrame, of_line: DataFrame) -> DataFrame:
    """(h, band, n, group, main): the lines of the bands whose lines are in several components (``of_line``), and whether a
    line is in the band's largest."""
    groups = of_line.select(F.col("node").alias("h"), "component")
    band, own = Window.partitionBy("band"), Window.partitionBy("band", "group")
    return written(rows.where("o IS NULL").select("h", "band", "n").join(groups, "h", "left")
                   .select("h", "band", "n", F.coalesce("component", "h").alias("group"))
                   .withColumn("apart", F.min("group").over(band) < F.max("group").over(band)).where("apart")
                   .withColumn("held", F.struct(F.count("*").over(own).alias("n"), "group"))
                   .select("h", "band", "n", "group", (F.max("held").over(band)["group"] == F.col("group")).alias("main")),
                   "wide-bands", True)


def neighbour_pairs(wide: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b): in bands of more than ``FEW`` lines each line with the two before it in the order of its least hashes under
    the band's own hash function, where lines of large similarity are close together."""
    many = written(wide.where(F.col("n") > FEW).select("h", "band", "group"), "many-rows", True)
    texts = in_bitmap(found.select("h", "line"), bitmap(many)).join(many.select("h").distinct(), "h").dropDuplicates(["h"])
    hashed = F.sort_array(F.transform("ring", lambda x: F.xxhash64(x, F.col("band"))))
    order = Window.partitionBy("band").orderBy("least", "h")
    line = F.struct("h", "group")
    near = (many.join(rings(texts).select("h", "ring"), "h").select("h", "band", "group", F.slice(hashed, 1, SKETCH).alias("least"))
            .select("h", "group", F.array(F.lag(line).over(order), F.lag(line, 2).over(order)).alias("before")))
    return (near.select("h", "group", F.explode("before").alias("o")).where("group <> o.group")
            .select(F.least("h", "o.h").alias("a"), F.greatest("h", "o.h").alias("b")).distinct())


def other_pairs(rows: DataFrame, met: DataFrame, of_line: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the other pairs of lines that share a band, are not in one component (``of_line``) yet and can be similar."""
    wide = apart_rows(rows, of_line).drop("n")
    bands = written(wide.groupBy("h").agg(F.collect_set("band").alias("bands")), "wide-lines", True)
    marked = written(wide.join(bands, "h").join(marks(bands.select("h"), found), "h"), "wide-marks", True)
    # lines of a band's largest component meet the others only
    side = lambda t, x: t.select("band", *[F.col(c).alias(f"{c}_{x}") for c in t.columns if c != "band"])
    differ = sum(F.bit_count(F.col(f"w{i}_a").bitwiseXOR(F.col(f"w{i}_b"))) for i in range(MARK_WORDS))
    # a pair's sets differ at least where their marks do; the rest is shared by halves
    total = F.col("size_a") + F.col("size_b")
    likely = (total - differ) * (1 + similarity) >= 2 * similarity * total - 1e-6
    first = F.array_min(F.array_intersect("bands_a", "bands_b")) == F.col("band")
    pairs = (side(marked.where("NOT main"), "a").join(side(marked, "b"), "band")
             .where("group_a <> group_b AND (main_b OR h_a < h_b)")
             .where(F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b") - 1e-9).where(likely).where(first))
    return (pairs.select(F.least("h_a", "h_b").alias("a"), F.greatest("h_a", "h_b").alias("b")).distinct()
            .join(met, ["a", "b"], "left_anti"))


def marks(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """(h, size, w0, w1, ..): of each wanted line (h) its number of different shingles and a bitmap of them."""
    texts = in_bitmap(found.select("h", "line"), bitmap(wanted)).join(wanted, "h").dropDuplicates(["h"])
    sets = with_shingles(texts, "line", "set").select("h", F.size("set").alias("size"), F.explode_outer("set").alias("s"))
    words = (sets.groupBy("h", F.shiftright("s", 6).bitwiseAND(MARK_WORDS - 1).alias("word"))
             .agg(F.max("size").alias("size"), F.bit_or(F.expr("shiftleft(1L, int(s & 63))")).alias("bits")))
    return words.groupBy("h").agg(F.max("size").alias("size"), *[
        F.bit_or(F.when(F.col("word") == i, F.col("bits")).otherwise(F.lit(0).cast("bigint"))).alias(f"w{i}") for i in range(MARK_WORDS)])


def _prefix_rest(length: Column, similarity: float) -> Column:
    """Shingles of a line beyond its prefix."""
    return F.ceil(length * similarity - 1e-9) - 1


def rare_shingles(wanted: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """(h, group, length, shingle): of each wanted line (h, group) its number of different shingles and so many of the rarest
    that two lines of the similarity share one of them: the prefix filter, which the tests hold the pairs against."""
    texts = in_bitmap(found.select("h", "line"), bitmap(wanted)).join(wanted, "h").dropDuplicates(["h"])
    sets = written(with_shingles(texts, "line", "set").select(
        "h", "group", F.size("set").alias("length"), F.explode_outer("set").alias("shingle")), "wide-shingles")
    counted = sets.join(sets.groupBy("shingle").count(), "shingle")
    order = Window.partitionBy("h").orderBy("count", "shingle")
    return (counted.withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= F.col("length") - _prefix_rest(F.col("length"), similarity))
            .select("h", "group", "length", "shingle"))


def band_texts(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(h, line): the texts of the lines that share a band with another one, each once."""
    wanted = written(rows.select("h").unionByName(rows.select(F.col("o.h").alias("h")).where("h IS NOT NULL")).distinct(), "band-lines", True)
    # an inner join: a semi join would be moved beneath the bitmap's
    return written(in_bitmap(found.select("h", "line"), bitmap(wanted)).join(wanted, "h").dropDuplicates(["h"]), "band-texts")


def links(signed: DataFrame, found: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, component): steps 3 to 5 for the lines that have a similar one."""
    with passing(signed.sparkSession) as keep:
        rows = written(band_rows(signed), "line-bands")
        found = band_texts(rows, found)
        met = written(band_pairs(rows), "line-pairs")
        near = written(verified(met, found, similarity), "line-links", True)
        of_line = components(near)
        for pairs in (lambda: neighbour_pairs(apart_rows(rows, of_line), found).join(met, ["a", "b"], "left_anti"),
                      lambda: other_pairs(rows, met, of_line, found, similarity)):
            others = written(pairs(), "other-pairs", True)
            if others.isEmpty():
                continue
            met = met.unionByName(others)
            more = written(verified(others, found, similarity), "other-links", True)
            if not more.isEmpty():
                near = near.unionByName(more)
                of_line = components(near)
        return keep(of_line)


def with_shingles(rows: DataFrame, line: str, out: str) -> DataFrame:
    """``rows`` with ``out``: hashes of the different ``CHARS``-character shingles of a line, each hashed by its bytes."""
    # one native pass cuts them all (a lambda that cuts each one takes several times as long)
    cut = F.regexp_extract_all(line, F.lit(_SHINGLE), F.lit(1))
    return rows.withColumn(out, F.array_distinct(F.transform(cut, lambda s: F.xxhash64(s))))


def bitmap(hashes: DataFrame) -> DataFrame:
    """(bucket, bits): the slots of the column ``h``, 2 ** 15 bits to a bucket, as hexadecimal text.
    Buckets without any slot are left out."""
    slot = _slot(F.col("h"))
    return (hashes.groupBy(F.bitmap_bucket_number(slot).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")))


def _slot(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BITMAP_BITS)


def in_bitmap(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """Rows whose ``h`` has its slot set: all wanted ones and, by chance, a few others."""
    # at most 2 ** (BITMAP_BITS - 15) buckets of 4 KB each: the broadcast is bounded
    near = rows.withColumn("_slot", _slot(F.col("h"))).join(
        F.broadcast(bits), F.bitmap_bucket_number(F.col("_slot")) == F.col("bucket"))
    at = F.bitmap_bit_position(F.col("_slot"))
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return near.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*rows.columns)


def verified(pairs: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose lines' exact Jaccard similarity is at least ``similarity``.

    Sketches of ``SKETCH`` least hashes first refuse pairs that are far below it (a share under ``FAR``, three
    standard errors under that of similar lines); the rest meet as texts, never as sets."""
    with passing(pairs.sparkSession) as keep:
        wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "wanted-lines", True)
        # an inner join: a semi join would be moved beneath the bitmap's
        texts = written(in_bitmap(found.select("h", "line"), bitmap(wanted)).join(wanted, "h").dropDuplicates(["h"]), "line-texts")
        sketches = written(rings(texts).select("h", F.slice("ring", 1, SKETCH).alias("s")), "line-sketches")
        both = (pairs.join(sketches.select(F.col("h").alias("a"), F.col("s").alias("x")), "a")
                .join(sketches.select(F.col("h").alias("b"), F.col("s").alias("y")), "b")
                .withColumn("least", F.slice(F.sort_array(F.array_union("x", "y")), 1, SKETCH)))
        shared = F.size(F.array_intersect(F.array_intersect("least", "x"), F.col("y")))
        near = written(both.select("a", "b", (shared / F.size("least")).alias("share")), "line-shares").where(F.col("share") >= FAR)
        met = (near.join(texts.select(F.col("h").alias("a"), F.col("line").alias("p")), "a")
               .join(texts.select(F.col("h").alias("b"), F.col("line").alias("q")), "b"))
        sets = with_shingles(with_shingles(met, "p", "x"), "q", "y")
        sized = written(sets.select("a", "b", F.size("x").alias("m"), F.size("y").alias("n"),
                                    F.size(F.array_intersect("x", "y")).alias("both")), "line-overlaps")
        return keep(sized.where(F.col("both") >= similarity * (F.col("m") + F.col("n") - F.col("both"))).select("a", "b"))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY
                  ) -> DataFrame:
    """(key, removed): per row key the places of its lines that go."""
    with passing(docs.sparkSession) as keep:
        found = lines(docs, id_col, text_col)
        of_line = links(signatures(found), found, similarity).withColumnRenamed("node", "h")
        places = written(found.select("key", "doc_id", "place", "h").join(of_line, "h", "left")
                         .select("key", "place", "doc_id", F.coalesce("component", "h").alias("group")), "line-places")
        order = F.struct(F.coalesce("doc_id", F.lit(-2**63)), "key", "place")
        first = written(places.groupBy("group").agg(F.min(order).alias("o"), F.count("*").alias("n")).where("n > 1")
                        .select("group", F.col("o.key").alias("key0"), F.col("o.place").alias("place0")), "first-lines")
        gone = places.join(first, "group").where("key <> key0 OR place <> place0")
        return keep(gone.groupBy("key").agg(F.collect_set("place").alias("removed")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None,
                similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the repeated lines cut from the text, and ``length_col``, if named, set to its new length."""
    gone = removed_lines(docs, id_col, text_col, similarity).select(F.col("key").alias("_line_key"),
                                                                   F.col("removed").alias("_line_removed"))
    all_lines = F.split(F.col(text_col).cast("string"), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size("_line_list") - 1), F.col("_line_removed"))
    text = F.array_join(F.transform(left, lambda i: F.get(F.col("_line_list"), i)), "\n")
    out = (_keyed(docs, id_col, text_col).join(gone, "_line_key", "left").withColumn("_line_list", all_lines)
           .withColumn("_line_text", F.when(F.col("_line_removed").isNull(), F.col(text_col)).otherwise(text))
           # generator output: neither the length nor a later filter makes the text again
           .withColumn(text_col, F.explode_outer(F.array("_line_text"))))
    if length_col:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.length(text_col).cast(kind))
    return out.select(*docs.columns)
