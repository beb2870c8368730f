"""Ranked lexical search of a query set over all documents by pipelined term partitioning (operator 13).

Terms are the runs of ASCII letters and digits and of all non-ASCII characters, A-Z as a-z, compared by a 64-bit hash.
The terms are owned by ``owners`` partitions of the hash range:

1. Each task tokenizes its documents whole and writes, for each shard (at most ``SHARD_ROWS`` rows of one batch) and
   owner, one row of postings: the owner's terms in the shard and, for each, documents and frequencies. A
   bitmap of fixed size (2^23 bits of the query terms' hashes) keeps terms of no query out; a false hit costs only room.
2. Counts over all documents, term by term, give the integer weights.
3. Items travel in bundles of at most ``BUNDLE_ITEMS``. For each bundle and shard one row of state carries the sparse document
   accumulators (a mask and the non-zero sums in as few bytes as they need) from owner to owner: each stage cogroups
   the state with the owner's postings and adds the integer contributions of its terms.
4. After the last owner the ten best documents of each item and shard are selected, then the best of all shards.

Groups are bounded by a bundle and a shard, so a term that a third of all documents hold is spread over all shards. The query
set meets all documents in blocks of bundles of at most ``BLOCK_TERMS`` weights, which are sent to the executors block by block.

Null and empty texts and texts without a term match nothing and count for nothing. Very long texts are tokenized whole. Equal
scores are ordered by id, null ids last. Repeated rows of documents are documents of their own, repeated items are ranked each
for itself. Empty tables give an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .shingles import letter_codes, signed, text_slices, word_hashes, word_spans

TOP = 10
OWNERS = 4
SHARD_ROWS = 8192
BUNDLE_ITEMS = 256
BLOCK_TERMS = 1_000_000
BITMAP = 1 << 23

_GAPS = np.ones(256, bool)
for _first, _last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _GAPS[_first:_last + 1] = False
_CODES = letter_codes(_GAPS)


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of all rows in order, and the rows' offsets into them."""
    found, offs, at = [], [np.zeros(1, np.int64)], 0
    for _, _, data, off in text_slices(texts):
        starts, _, rows = word_spans(data, off, _GAPS)
        found.append(word_hashes(data, starts, _CODES))
        offs.append(rows[1:] + at)
        at += len(starts)
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), np.concatenate(offs)


def owner_of(terms: np.ndarray, owners: int) -> np.ndarray:
    """Owner of each term, by the upper half of its hash."""
    return ((terms >> 32) % owners).astype(np.int32)


def _counted(terms: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, row, frequency) of every distinct pair, by term (as a signed number) and row; rows must ascend."""
    terms = signed(terms)
    order = np.argsort(terms, kind="stable")
    terms, rows = terms[order], rows[order]
    new = np.ones(len(terms), bool)
    new[1:] = (terms[1:] != terms[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(new)
    return terms[at], rows[at], np.diff(np.append(at, len(terms)))


def query_terms(items: DataFrame, id_col: str, text_col: str, bundle_items: int, owners: int) -> tuple[DataFrame, DataFrame]:
    """The items (bundle, slot, item_id) and their terms (bundle, slot, owner, term, repeats), as written tables."""

    def run(batches):
        part, seen = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            terms, off = term_hashes(batch.column(1))
            number = seen + np.arange(batch.num_rows)
            bundle, slot = part + number // bundle_items, (number % bundle_items).astype(np.int32)
            seen += batch.num_rows
            term, row, repeats = _counted(terms, np.repeat(np.arange(batch.num_rows), np.diff(off)))
            yield pa.record_batch([pa.array(bundle), pa.array(slot), batch.column(0), pa.nulls(len(slot), pa.int32()),
                                   pa.nulls(len(slot), pa.int64()), pa.nulls(len(slot), pa.int64())], names=names)
            yield pa.record_batch([pa.array(bundle[row]), pa.array(slot[row]), pa.nulls(len(row), pa.int64()),
                                   pa.array(owner_of(term, owners)), pa.array(term), pa.array(repeats)], names=names)

    names = ["bundle", "slot", "item_id", "owner", "term", "repeats"]
    rows = items.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    made = written(rows.mapInArrow(run, "bundle bigint, slot int, item_id bigint, owner int, term bigint, repeats bigint"), "items")
    return (made.where("owner IS NULL").select("bundle", "slot", "item_id"),
            made.where("owner IS NOT NULL").select("bundle", "slot", "owner", "term", "repeats"))


def term_bitmap(terms: DataFrame) -> np.ndarray:
    """One bit for each hash modulo the bitmap's fixed size."""
    bit = F.col("term").bitwiseAND(F.lit(BITMAP - 1))
    words = (terms.select(F.shiftright(bit, 6).alias("word"), F.expr("shiftleft(1L, CAST(term & 63 AS INT))").alias("bits"))
             .groupBy("word").agg(F.bit_or("bits").alias("bits")))  # at most 131,072 rows
    out = np.zeros(BITMAP // 64, np.int64)
    for word, bits in words.collect():
        out[word] = bits
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def postings(docs: DataFrame, bitmap: np.ndarray, id_col: str, text_col: str, owners: int, shard_rows: int) -> DataFrame:
    """One row per shard and owner (owner -1: the shard's documents), as a written table."""
    packed = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap))  # 1 MB whatever the items

    def shards(batch):
        for k in range(-(-batch.num_rows // shard_rows)):
            yield batch.slice(k * shard_rows, shard_rows)

    def run(batches):
        part, shard = TaskContext.get().partitionId() << 33, 0
        known = np.unpackbits(packed.value).astype(bool)
        for batch in (s for b in batches for s in shards(b)):
            terms, off = term_hashes(batch.column(1))
            n = np.diff(off)
            held = known[(terms & np.uint64(BITMAP - 1)).astype(np.int64)]
            term, row, tf = _counted(terms[held], np.repeat(np.arange(batch.num_rows, dtype=np.uint16), n)[held])
            owner = owner_of(term, owners)
            out = [(-1, int((n > 0).sum()), int(n.sum()), batch.column(0).to_pylist(), [], n.astype("<i8").tobytes(), b"")]
            for k in range(owners):
                own = owner == k
                t, at = np.unique(term[own], return_index=True)
                out.append((k, 0, 0, t, np.diff(np.append(at, own.sum())), row[own].astype("<u2").tobytes(),
                            tf[own].astype("<u4").tobytes()))
            columns = list(zip(*out))
            yield pa.record_batch([pa.array([part + shard] * len(out)), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()),
                                   pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.list_(pa.int64())),
                                   pa.array(columns[4], pa.list_(pa.int32())), pa.array(columns[5], pa.binary()),
                                   pa.array(columns[6], pa.binary())],
                                  names=["shard", "owner", "docs", "length", "terms", "counts", "rows", "tfs"])
            shard += 1

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return written(rows.mapInArrow(run, "shard bigint, owner int, docs bigint, length bigint, terms array<bigint>, "
                                        "counts array<int>, rows binary, tfs binary"), "postings")


def pack_sums(sums: np.ndarray) -> bytes:
    """Accumulators as a mask and the non-zero sums, in as few bytes each as the largest needs."""
    flat = sums.ravel()
    mask = flat != 0
    kept = flat[mask]
    width = max(1, (int(kept.max()).bit_length() + 7) // 8) if len(kept) else 1
    planes = kept.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + np.packbits(mask).tobytes() + planes.T.tobytes()


def unpack_sums(packed: bytes, items: int, docs: int) -> np.ndarray:
    """The accumulators of ``items`` by ``docs``; nothing packed gives zeros."""
    out = np.zeros(items * docs, np.int64)
    if packed:
        cells = (items * docs + 7) // 8
        mask = np.unpackbits(np.frombuffer(packed, np.uint8, cells, 1), count=items * docs).astype(bool)
        planes = np.frombuffer(packed, np.uint8, offset=1 + cells).reshape(packed[0], -1)
        kept = np.zeros((planes.shape[1], 8), np.uint8)
        kept[:, :packed[0]] = planes.T
        out[mask] = kept.view("<i8").ravel()
    return out.reshape(items, docs)


def add_owner(sums: np.ndarray, scaled: np.ndarray, weights: tuple, terms: np.ndarray, counts: np.ndarray, rows: np.ndarray,
              tfs: np.ndarray) -> None:
    """Add one owner's contributions to the accumulators. ``scaled`` is 8 * m of each document; ``weights`` holds the
    bundle's (terms, slots, weights) of this owner by term, with repeats counted in."""
    term, slot, weight = weights
    ends = np.cumsum(counts)
    at = np.searchsorted(terms, term)
    hit = np.flatnonzero(at < len(terms))
    hit = hit[terms[at[hit]] == term[hit]]
    last, docs, part = -1, None, None
    for i in hit.tolist():
        k = int(at[i])
        if k != last:
            a, b = int(ends[k] - counts[k]), int(ends[k])
            docs, tf, last = rows[a:b], tfs[a:b], k
            part = (1_000_000_000 * tf) // (1000 * tf + scaled[docs])
        sums[slot[i], docs] += weight[i] * part


def best(sums: np.ndarray, ids: list, top: int) -> list[tuple[int, int | None, int]]:
    """(slot, doc id, score) of each item's best documents with a score above 0."""
    order_id = np.array([2**63 - 1 if i is None else i for i in ids], np.int64)
    missing = np.array([i is None for i in ids], bool)
    out = []
    for slot, row in enumerate(sums):
        least = max(1, int(np.partition(row, len(row) - top)[len(row) - top])) if len(row) > top else 1
        at = np.flatnonzero(row >= least)
        at = at[np.lexsort((order_id[at], missing[at], -row[at]))][:top]
        out.extend((slot, ids[d], int(row[d])) for d in at.tolist())
    return out


def _blocks(sizes: list[tuple[int, int]], most: int) -> list[list[int]]:
    """Bundles in blocks of at most ``most`` terms (one bundle at least)."""
    out, room = [], 0
    for bundle, n in sorted(sizes):
        if not out or n > room:
            out.append([])
            room = most
        out[-1].append(bundle)
        room -= n
    return out


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
           item_text_col: str = "text", top: int = TOP, owners: int = OWNERS, shard_rows: int = SHARD_ROWS,
           bundle_items: int = BUNDLE_ITEMS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` best documents with a score above 0.

    The score is the integer one of the operator's contract: term weights floor(1000 ln((2N+2)/(2df+1))), frequencies
    saturated by 10^9 tf div (1000 tf + 8 m), m growing with the document's length over the mean.
    """
    spark = docs.sparkSession
    named, terms = query_terms(items, item_id_col, item_text_col, bundle_items, owners)
    index = postings(docs, term_bitmap(terms), id_col, text_col, owners, shard_rows)
    total = index.where("owner = -1").agg(F.sum("docs"), F.sum("length")).first()
    n_docs, length = int(total[0] or 0), int(total[1] or 0)
    df = (index.where("owner >= 0").select(F.explode(F.arrays_zip("terms", "counts")).alias("p"))
          .groupBy(F.col("p.terms").alias("term")).agg(F.sum("p.counts").alias("df")))
    weight = F.floor(1000 * F.log((F.lit(2.0) * n_docs + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("bigint")
    weighted = written(terms.join(df, "term").select("bundle", "slot", "owner", "term", (weight * F.col("repeats")).alias("weight")),
                       "weights")
    sizes = [(r[0], r[1]) for r in weighted.groupBy("bundle").count().collect()]
    if not sizes:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    found = None
    for block in _blocks(sizes, block_terms):
        part = _search_block(index, weighted.where(F.col("bundle").isin(block)), block, n_docs, length, top, owners, bundle_items)
        found = part if found is None else found.unionByName(part)
    w = Window.partitionBy("bundle", "slot").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return ranked.join(named, ["bundle", "slot"]).select("item_id", "rank", "doc_id", "score")


def _search_block(index: DataFrame, weighted: DataFrame, bundles: list[int], n_docs: int, length: int, top: int, owners: int,
                  bundle_items: int) -> DataFrame:
    """Best documents per shard of one block's items: the bundles pass the owners one after the other."""
    rows = weighted.select("bundle", "owner", "term", "slot", "weight").toPandas()  # at most a block
    rows = rows.sort_values(["bundle", "owner", "term", "slot"])
    held = {key: (g.term.to_numpy(), g.slot.to_numpy(), g.weight.to_numpy()) for key, g in rows.groupby(["bundle", "owner"])}
    weights = index.sparkSession.sparkContext.broadcast(held)
    state_type = "bundle bigint, shard bigint, ids array<bigint>, lengths binary, sums binary"
    empty = (np.zeros(0, np.int64),) * 3
    nothing = pa.schema([("bundle", pa.int64()), ("shard", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.binary()),
                         ("sums", pa.binary())]).empty_table()

    def stage(owner: int):
        def run(key: tuple, state: pa.Table, found: pa.Table) -> pa.Table:
            if not state.num_rows:  # postings of no document
                return nothing
            bundle = key[0].as_py()
            ids = state.column("ids").combine_chunks()[0]
            n = np.frombuffer(state.column("lengths")[0].as_py(), "<i8")
            sums = unpack_sums(state.column("sums")[0].as_py(), bundle_items, len(n))
            for k in range(found.num_rows):
                add_owner(sums, 8 * (25 + (75 * n * n_docs) // length), weights.value.get((bundle, owner), empty),
                          found.column("terms")[k].values.to_numpy(), found.column("counts")[k].values.to_numpy(),
                          np.frombuffer(found.column("rows")[k].as_py(), "<u2"),
                          np.frombuffer(found.column("tfs")[k].as_py(), "<u4").astype(np.int64))
            return pa.table([pa.array([bundle]), pa.array([key[1].as_py()]), pa.array([ids.as_py()], pa.list_(pa.int64())),
                             pa.array([n.tobytes()], pa.binary()), pa.array([pack_sums(sums)], pa.binary())], schema=nothing.schema)

        return run

    def select(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ids = batch.column("ids")[k].as_py()
                out = best(unpack_sums(batch.column("sums")[k].as_py(), bundle_items, len(ids)), ids, top)
                slot, doc, score = zip(*out) if out else ((), (), ())
                yield pa.record_batch([pa.array([batch.column("bundle")[k].as_py()] * len(out), pa.int64()), pa.array(slot, pa.int32()),
                                       pa.array(doc, pa.int64()), pa.array(score, pa.int64())],
                                      names=["bundle", "slot", "doc_id", "score"])

    every = F.explode(F.array(*[F.lit(b).cast("bigint") for b in bundles])).alias("bundle")
    state = index.where("owner = -1 AND docs > 0").select(
        every, "shard", F.col("terms").alias("ids"), F.col("rows").alias("lengths"), F.lit(b"").cast("binary").alias("sums"))
    for owner in range(owners):
        own = index.where((F.col("owner") == owner) & (F.size("terms") > 0)).select(every, "shard", "terms", "counts", "rows", "tfs")
        keys = ["bundle", "shard"]
        state = state.groupBy(*keys).cogroup(own.groupBy(*keys)).applyInArrow(stage(owner), state_type)
    return state.mapInArrow(select, "bundle bigint, slot int, doc_id bigint, score bigint")

