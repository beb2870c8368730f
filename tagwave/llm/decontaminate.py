"""Benchmark decontamination (operator 10): n-gram seeds, then Smith-Waterman alignment.

1. *Seeds.* Every run of 3 words of a test item (words: letters and digits, lower case) that at most ``RARE`` different
   items hold; where more hold it, the run of 6 words from the same place on the same terms; where more hold that too, the
   run of 12, whoever holds it; an item too short for the next length keeps its seeds. A bitmap of the seeds' hashes, of fixed size, lets one pass
   over the training texts drop nearly all n-grams that are no seed; what is left joins the seeds by hash.
2. *Candidates.* Every (document, item) pair with a hit. Rarity is counted over items alone: a verbatim copy elsewhere
   says nothing about an edited one, and a rare seed makes at most ``RARE`` pairs of a place in a text. A phrase of many
   items makes none, so a pair without 12 equal words in a row whose equal runs are all common to more than ``RARE``
   items, at 3 words and at 6, is not found.
3. *Alignment.* A window that holds too few of the item's words for ``min_share`` is dropped by counting them (an
   exact bound, as every match needs its word). Windows are cut from a text once, and only they travel to the items. The hits of a (document, item) pair give the diagonals at which
   the item may lie; for each group of near diagonals the local alignment of the item's words and the passage's words is scored
   (match 2, mismatch -1, gap -1), which finds edited copies too. The score's share of the
   item's full score decides: ``min_share`` or more is a leak.

Null, empty and wordless texts and items match nothing. Repeated items and rows each count (equal items
are aligned once); rows are told apart by a hash of id and text. The windows of one text are in memory at once, in
proportion to its hits. An empty table on either side gives no leaks. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written
from .line_dedup import bitmap, in_bitmap
from .shingles import fold, mix, shingle_hashes, signed, text_slices, word_hashes, word_spans

LENGTHS = (3, 6, 12)  # words of a seed, the next where more than RARE items hold it
RARE = 16
BITMAP_BITS = 23
MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SHARE = 0.5

_SLOT = np.uint64(64 - BITMAP_BITS)


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each row, and the rows' offsets into them."""
    plain = fold(data)
    starts, _, rows = word_spans(plain, off)
    return word_hashes(plain, starts), rows


def _grams(words: np.ndarray, rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-grams of ``length`` words (a shorter row is one): hash, row and word place of each."""
    hashes, at = shingle_hashes(words, rows, length)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(at))
    return mix(hashes, length), row, np.arange(len(hashes)) - at[row] if len(hashes) else np.zeros(0, np.int64)


def item_words(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, words): the word hashes of each item that has words."""

    def run(batches):
        for batch in batches:
            lists = []
            for _, _, data, off in text_slices(batch.column(1)):
                words, rows = _words(data, off)
                lists += [signed(words[rows[i]:rows[i + 1]]) for i in range(len(off) - 1)]
            yield pa.record_batch([batch.column(0), pa.array(lists, pa.list_(pa.int64()))], names=["item_id", "words"])

    return (items.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))
            .mapInArrow(run, "item_id bigint, words array<bigint>").where(F.size("words") > 0))


def item_seeds(words: DataFrame, rare: int = RARE) -> DataFrame:
    """(item_id, n_words, seed, item_place) for every seed of every item."""

    def run(batches):
        for batch in batches:
            lists = [np.array(x, np.int64).view(np.uint64) for x in batch.column(1).to_pylist()]
            rows = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            flat = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
            for level, length in enumerate(LENGTHS):
                hashes, row, place = _grams(flat, rows, length)
                yield pa.record_batch([batch.column(0).take(pa.array(row)), pa.array(np.diff(rows)[row]),
                                       pa.array(np.full(len(row), level, np.int32)), pa.array(signed(hashes)), pa.array(place)],
                                      names=["item_id", "n_words", "level", "seed", "item_place"])

    grams = written(words.mapInArrow(run, "item_id bigint, n_words bigint, level int, seed bigint, item_place bigint"), "grams")
    held = grams.where(F.col("level") < len(LENGTHS) - 1).select("level", "seed", "item_id").distinct()
    common = held.groupBy("level", "seed").count().where(F.col("count") > rare).select("level", "seed", F.lit(True).alias("common"))
    # an item without the next length keeps its seeds: each is half of it or more
    longer = F.try_element_at(F.array(*[F.lit(x) for x in LENGTHS]), F.col("level") + 2)
    marked = (grams.join(common, ["level", "seed"], "left")
              .withColumn("common", F.coalesce((F.col("n_words") >= longer) & F.col("common"), F.lit(False))))
    # the last start of a longer run stands for the places after it
    place = lambda level: F.least("item_place", F.greatest(F.col("n_words") - LENGTHS[level], F.lit(0)))
    out = marked.where("level = 0 AND NOT common")
    asked = marked.where("level = 0 AND common")
    for level in range(1, len(LENGTHS)):
        longer = asked.select("item_id", place(level).alias("item_place")).distinct()
        there = marked.where(F.col("level") == level).join(longer, ["item_id", "item_place"])
        out = out.unionByName(there.where(~F.col("common")))
        asked = there.where("common")
    return out.select("item_id", "n_words", "seed", "item_place")


def seed_bitmap(seeds: DataFrame) -> np.ndarray:
    """One bit (a byte here) per slot of the seeds' hashes; its size is fixed, whatever the items."""
    slots = seeds.select(F.shiftrightunsigned("seed", 64 - BITMAP_BITS).cast("int").alias("slot")).distinct().toPandas()
    bits = np.zeros(1 << BITMAP_BITS, bool)
    bits[slots.slot.to_numpy()] = True
    return np.packbits(bits)


def text_hits(texts: DataFrame, slots: np.ndarray) -> DataFrame:
    """(key, seed, place): n-grams of the texts whose slot is set. ``texts``: (key, text)."""
    shared = texts.sparkSession.sparkContext.broadcast(slots)  # 2 ** BITMAP_BITS bits: 1 MB

    def run(batches):
        bits = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            for first, _, data, off in text_slices(batch.column(1)):
                words, rows = _words(data, off)
                for length in LENGTHS:
                    hashes, row, place = _grams(words, rows, length)
                    hit = np.flatnonzero(bits[(hashes >> _SLOT).astype(np.int64)])
                    yield pa.record_batch([batch.column(0).take(pa.array(first + row[hit])), pa.array(signed(hashes[hit])),
                                           pa.array(place[hit])], names=["key", "seed", "place"])

    return texts.mapInArrow(run, "key bigint, seed bigint, place bigint")


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman score of two word sequences, and the first and the end place of the best
    local alignment in ``b``."""
    n = len(b)
    step = np.arange(n + 1) * -GAP
    row = np.zeros(n + 1, np.int64)
    begin = np.arange(n + 1)
    best, span = 0, (0, 0)
    for x in a:
        diag = row[:-1] + np.where(b == x, MATCH, MISMATCH)
        up = row[1:] + GAP
        new = np.zeros(n + 1, np.int64)
        new[1:] = np.maximum(np.maximum(diag, up), 0)
        source = np.arange(n + 1)
        source[1:] = np.where(new[1:] == 0, source[1:], np.where(diag >= up, begin[:-1], begin[1:]))
        run = np.maximum.accumulate(new + step)      # gaps in `a`: best of all places to the left
        left = run - step
        at = np.maximum.accumulate(np.where(new + step == run, np.arange(n + 1), 0))
        begin = np.where(left > 0, source[at], np.arange(n + 1))
        row = np.maximum(left, 0)
        top = int(row.argmax())
        if row[top] > best:
            best, span = int(row[top]), (int(begin[top]), top)
    return best, *span


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.xxhash64(F.col(id_col).cast("string"), text).alias("key"),
                       F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"))


def likely_texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``texts`` with a key of ``wanted`` and, by chance, a few others: a bitmap of fixed size over the wanted keys keeps
    the other texts out of the shuffle."""
    bits = bitmap(wanted.select(F.col("key").alias("h")))
    return in_bitmap(texts.withColumnRenamed("key", "h"), bits).withColumnRenamed("h", "key")


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
          item_text: str = "text", min_share: float = MIN_SHARE) -> DataFrame:
    """(key, doc_id, item_id, share, first_word, end_word): pairs whose alignment reaches
    ``min_share``, with the best passage's word places in the document."""
    # equal items are one from here on; `copies` names their ids
    given = written(item_words(items, item_id, item_text).withColumn("item", F.xxhash64("words")), "item-words")
    copies = given.select("item", "item_id")
    words = written(given.select(F.col("item").alias("item_id"), "words").dropDuplicates(["item_id"]), "different-items")
    seeds = written(item_seeds(words), "seeds")
    texts = _keyed(docs, id_col, text_col)
    with small_batches(docs.sparkSession):
        hits = written(text_hits(texts.select("key", "text"), seed_bitmap(seeds)), "hits")
    # one row per document, item and group of diagonals within an item's length
    diagonal = F.col("place") - F.col("item_place")
    places = (hits.join(seeds, "seed").withColumn("diagonal", diagonal)
              .groupBy("key", "item_id", "n_words", F.floor(F.col("diagonal") / F.col("n_words")).alias("at"))
              .agg(F.min("diagonal").alias("lo"), F.max("diagonal").alias("hi")))
    wanted = written(places.groupBy("key").agg(F.collect_list(F.struct(
        "item_id", F.greatest(F.col("lo") - F.col("n_words"), F.lit(0)).alias("lo"),
        (F.col("hi") + 2 * F.col("n_words")).alias("hi"))).alias("windows")), "windows")
    suspects = likely_texts(texts, wanted).join(wanted, "key").dropDuplicates(["key"])

    def cut(batches):
        for batch in batches:
            windows = batch.column(3)
            for first, end, data, off in text_slices(batch.column(2)):
                hashes, rows = _words(data, off)
                for i in range(end - first):
                    r = first + i
                    text, mine = hashes[rows[i]:rows[i + 1]], windows[r].values
                    item, lo, hi = (mine.field(k) for k in range(3))
                    near = [text[x:max(x, y)].tobytes() for x, y in zip(lo.to_pylist(), hi.to_pylist())]
                    yield pa.record_batch([pa.array([batch.column(0)[r].as_py()] * len(item), pa.int64()),
                                           pa.array([batch.column(1)[r].as_py()] * len(item), pa.int64()),
                                           item, lo, pa.array(near, pa.binary())],
                                          names=["key", "doc_id", "item_id", "lo", "near"])

    passages = suspects.select("key", "doc_id", "text", "windows").mapInArrow(
        cut, "key bigint, doc_id bigint, item_id bigint, lo bigint, near binary")

    def score(batches):
        for batch in batches:
            out = []
            for r in range(batch.num_rows):
                item = np.array(batch.column(4)[r].as_py(), np.int64).view(np.uint64)
                near = np.frombuffer(batch.column(3)[r].as_py(), np.uint64)
                lo = batch.column(5)[r].as_py()
                enough = np.isin(item, near).sum() >= min_share * len(item)
                points, a, b = align(item, near) if enough else (0, 0, 0)
                out.append((points / (MATCH * len(item)), lo + a, lo + b))
            share, a, b = zip(*out) if out else ((), (), ())
            yield pa.record_batch([*batch.columns[:3], pa.array(share, pa.float64()),
                                   pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                                  names=["key", "doc_id", "item", "share", "first_word", "end_word"])

    scored = (passages.join(words, "item_id").select("key", "doc_id", "item_id", "near", "words", "lo").mapInArrow(
        score, "key bigint, doc_id bigint, item bigint, share double, first_word bigint, end_word bigint")
              .where(F.col("share") >= min_share).join(copies, "item"))
    best = F.max(F.struct("share", (-F.col("first_word")).alias("f"), "end_word")).alias("m")
    with small_batches(docs.sparkSession):
        return written(scored.groupBy("key", "doc_id", "item_id").agg(best)
                       .select("key", "doc_id", "item_id", F.col("m.share").alias("share"),
                               (-F.col("m.f")).alias("first_word"), F.col("m.end_word").alias("end_word")), "leaks")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  **options) -> DataFrame:
    """``docs`` without the rows that hold a leak, all columns kept."""
    found = leaks(docs, items, id_col, text_col, **options).select(F.col("key").alias("_leak_key")).distinct()
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    return (docs.withColumn("_leak_key", key).join(found, "_leak_key", "left_anti").select(*docs.columns))
