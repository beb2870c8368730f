"""Document fingerprints by threshold-scaled sketches (operator 5), in DataFrame functions only.

A text's words (between white space, lower case) give its 5-word shingles; a text of fewer words is one
shingle. The sketch keeps every distinct shingle hash below a fixed fraction, 1 / ``SCALE``, of the hash
range. Sketches of one fraction merge by union, and as the fraction is the same for all lengths, they
estimate how much of a short text lies in a long one, whatever their sizes.

A text whose fraction holds fewer than ``FLOOR`` hashes keeps its ``FLOOR`` smallest instead (all of
them, if it has no more), so short texts can be compared too. Each sketch carries the threshold up
to which it is whole: the fraction, or its largest hash, or the whole range. Two sketches are
compared below the smaller of their thresholds.

Null and empty texts, and texts of white space, have the empty sketch; it equals another empty one (likeness 1)
and nothing else (0). Repeated rows are fingerprinted alike. Equal ids follow a hash of the row,
a null id comes first. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scan import ordered_scan
from .common import written

WORDS = 5
SCALE = 8
FLOOR = 64

_LEAST = -(2**63)
_FRACTION = _LEAST + 2**64 // SCALE  # hashes below it are kept
_WHOLE = 2**63 - 1


def with_sketch(rows: DataFrame, text: str, out: str) -> DataFrame:
    """``rows`` with ``out``: struct (hashes: sorted array, upto: the threshold it is whole below)."""
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[ \\t\\n\\x0B\\f\\r]+"), "")
    starts = F.when(F.size("_words") > 0, F.sequence(F.lit(1), F.greatest(F.size("_words") - (WORDS - 1), F.lit(1))))
    hashes = F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i: F.xxhash64(F.slice("_words", i, WORDS)))
    few = F.slice(F.sort_array(F.array_distinct("_all")), 1, FLOOR)
    kept = F.when(F.size("_below") >= FLOOR, F.sort_array("_below")).otherwise(few)
    upto = F.when(F.size("_below") >= FLOOR, F.lit(_FRACTION)).when(F.size("_kept") < FLOOR, F.lit(_WHOLE)).otherwise(
        F.greatest(F.lit(_FRACTION), F.element_at("_kept", -1) + 1))
    return (rows.withColumn("_words", words).withColumn("_all", hashes).drop("_words")
            .withColumn("_below", F.array_distinct(F.filter("_all", lambda h: h < _FRACTION)))
            .withColumn("_kept", kept).withColumn("_upto", upto)
            .withColumn(out, F.struct(F.col("_kept").alias("hashes"), F.col("_upto").alias("upto")))
            .drop("_all", "_below", "_kept", "_upto"))


def merged(sketch: Column, other: Column) -> Column:
    """Sketch of two texts together: the union below the smaller threshold."""
    upto = F.least(sketch["upto"], other["upto"])
    return F.struct(F.sort_array(F.filter(F.array_union(sketch["hashes"], other["hashes"]), lambda h: h < upto)
                                 ).alias("hashes"), upto.alias("upto"))


def as_text(sketch: Column) -> Column:
    """A sketch as a string: its threshold and its hashes in hexadecimal."""
    digits = lambda h: F.lpad(F.hex(h), 16, "0")
    return F.concat(digits(sketch["upto"]), F.lit(":"), F.array_join(F.transform(sketch["hashes"], digits), ""))


def _compared(rows: DataFrame, a: str, b: str) -> DataFrame:
    """``rows`` with the counts ``_both``, ``_na``, ``_nb`` of two sketches below their common threshold."""
    upto = F.least(F.col(a)["upto"], F.col(b)["upto"])
    below = lambda s: F.filter(F.col(s)["hashes"], lambda h: h < F.col("_least"))
    return (rows.withColumn("_least", upto).withColumn("_a", below(a)).withColumn("_b", below(b))
            .withColumn("_na", F.size("_a")).withColumn("_nb", F.size("_b"))
            .withColumn("_both", F.size(F.array_intersect("_a", "_b"))).drop("_a", "_b", "_least"))


def with_likeness(rows: DataFrame, a: str, b: str, containment: str, jaccard: str) -> DataFrame:
    """``rows`` with the estimated share of the smaller shingle set that lies in the larger, and the
    estimated Jaccard similarity, both 0 to 1."""
    empty = (F.col("_na") == 0) & (F.col("_nb") == 0)
    share = lambda of: F.when(empty, 1.0).when(of == 0, 0.0).otherwise(F.col("_both") / of).cast("double")
    return (_compared(rows, a, b).withColumn(containment, share(F.least("_na", "_nb")))
            .withColumn(jaccard, share(F.col("_na") + F.col("_nb") - F.col("_both"))).drop("_na", "_nb", "_both"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint, that of its edited text (the last quarter replaced by the start of
    the next row's text, by id, the first following the last), and the likenesses of both pairs.

    The next row is found by a distributed scan over the keys. Each text, with its sketch, travels once to
    meet its key and sends the sketch and the start that is needed to the row before."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    given = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text")).withColumn(
        "key", F.xxhash64(F.col("doc_id").cast("string"), "text"))
    keys = given.select("doc_id", "key", F.length("text").alias("n")).distinct()
    # the row after, as the row before in descending order
    down = [F.col("doc_id").desc_nulls_last(), F.col("key").desc()]
    lagged = written(ordered_scan(keys, down, lags={"next_key": F.col("key")}), "next")
    first = lagged.orderBy(F.col("doc_id").asc_nulls_first(), "key").limit(1).select(F.col("key").alias("_first"))
    follow = written(lagged.join(F.broadcast(first), F.col("next_key").isNull(), "left")
                     .select("key", F.coalesce("next_key", "_first").alias("next_key"),
                             F.floor(F.col("n") / 4).cast("int").alias("take")), "follow")
    before = follow.select(F.col("next_key").alias("key"), F.col("key").alias("before_key"), "take")
    # both branches use the same columns of `sketched`, so they share one shuffle of the texts
    sketched = with_sketch(given, "text", "sketch").hint("merge")
    starts = (sketched.join(before, "key").select(
        F.col("before_key").alias("key"), F.substring("text", F.lit(1), F.col("take")).alias("start"),
        "take", F.col("doc_id").alias("next_id"), F.col("sketch").alias("next_sketch")).dropDuplicates(["key"]))
    n = F.length("text")
    joined = (sketched.join(starts, "key")
              .withColumn("edited", F.concat(F.substring("text", F.lit(1), n - F.col("take")), "start"))
              .select("doc_id", n.cast("bigint").alias("n_chars"), "next_id", "sketch", "next_sketch", "edited"))
    both = with_sketch(joined, "edited", "edited_sketch")
    out = with_likeness(both, "sketch", "edited_sketch", "near_edited", "jaccard_edited")
    out = with_likeness(out, "sketch", "next_sketch", "near_next", "jaccard_next")
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                      as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
                      "next_id", "near_edited", "near_next", "jaccard_edited", "jaccard_next")
