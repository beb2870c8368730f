"""Variable-capacity best-fit packing of documents into training sequences (operator 7).

Each document is a number of tokens, by default its words (runs without white space or ASCII
punctuation) and single punctuation marks, counted by one vectorised pass over the texts. A document
longer than the largest capacity is cut into pieces of that capacity and a rest; every token lies in exactly one
piece. Pieces are dealt at random (a hash of the row) to shards of about ``shard_rows`` pieces, each packed as one bounded
group, longest pieces first:

* a piece goes to the open bin with the least room that still fits it (best fit);
* if none fits, a bin is opened of the least-cost size: all permitted opening sizes are tried, the
  whole shard is packed under each, and the one with the least total cost is kept;
* at the end each bin shrinks to the smallest permitted capacity that holds its contents, before costs are summed.

A bin's cost is its capacity plus ``overhead`` (the work of a sequence besides its tokens).

Null and empty texts, and texts of white space, have no tokens and no pieces. Equal lengths are
ordered by the row's hash, so a re-run packs alike; repeated rows are packed once each. An
empty table packs to an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written
from .shingles import text_slices

CAPACITIES = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 32
SHARD_ROWS = 10_000

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True


def token_counts(texts: pa.Array) -> np.ndarray:
    """Words and punctuation marks of each text; 0 for a null."""
    out = [np.zeros(0, np.int64)]
    for _, _, data, off in text_slices(texts):
        mark = _PUNCTUATION[data]
        word = ~(mark | _GAP[data])
        first = word.copy()
        first[1:] &= ~word[:-1]
        inner = off[:-1][off[:-1] < len(data)]
        first[inner] = word[inner]
        out.append(np.diff(np.concatenate([[0], np.cumsum(first | mark)])[off]))
    return np.concatenate(out)


def counted_tokens(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, _row, _tokens) for every row, ``_row`` being a hash of id and text."""

    def run(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(token_counts(batch.column(2)))],
                                  names=["doc_id", "_row", "_tokens"])

    text = F.col(text_col).cast("string")
    return rows.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.col(id_col).cast("string"), text).alias("_row"),
                       text.alias("text")).mapInArrow(run, "doc_id bigint, _row bigint, _tokens bigint")


def pieces(rows: DataFrame, tokens_col: str, capacity: int) -> DataFrame:
    """Rows cut to at most ``capacity`` tokens, with ``piece``, ``start_token`` and ``n_tokens``."""
    last = F.expr(f"CAST((`{tokens_col}` - 1) DIV {capacity} AS INT)")
    cut = rows.where(F.col(tokens_col) > 0).withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    return (cut.withColumn("start_token", F.col("piece").cast("bigint") * capacity)
            .withColumn("n_tokens", F.least(F.lit(capacity).cast("bigint"), F.col(tokens_col) - F.col("start_token"))))


def best_fit(lengths: Sequence[int], opening: int, capacities: Sequence[int]) -> list[int]:
    """Bin number of each length, in the given order; a new bin has the size ``opening``, or the
    smallest permitted one that holds the piece."""
    room_of: dict[int, list[int]] = {}
    rooms: list[int] = []  # sorted distinct free rooms of open bins
    out, bins = [], 0
    for length in lengths:
        at = bisect.bisect_left(rooms, length)
        if at < len(rooms):
            room = rooms[at]
            held = room_of[room]
            b = held.pop()
            if not held:
                del room_of[room]
                rooms.pop(at)
        else:
            b, bins = bins, bins + 1
            room = max(opening, capacities[bisect.bisect_left(capacities, length)])
        left = room - length
        if left:
            if left not in room_of:
                room_of[left] = []
                bisect.insort(rooms, left)
            room_of[left].append(b)
        out.append(b)
    return out


def pack_shard(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD
               ) -> tuple[list[int], dict[int, int], int]:
    """Bin of each length (longest first is the caller's order), the bins' final capacities and
    the total cost, under the cheapest opening size."""
    capacities = sorted(capacities)
    best = None
    for opening in capacities:
        bins = best_fit(lengths, opening, capacities)
        load: dict[int, int] = {}
        for b, length in zip(bins, lengths):
            load[b] = load.get(b, 0) + length
        final = {b: capacities[bisect.bisect_left(capacities, used)] for b, used in load.items()}
        cost = sum(final.values()) + overhead * len(final)
        if best is None or cost < best[2]:
            best = (bins, final, cost)
    return best


def pack(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens_col: str | None = None,
         capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, piece, start_token, n_tokens, bin_id, capacity, place): where each piece goes, and
    the token place inside its bin. ``tokens_col`` names a ready token count."""
    capacities = sorted(capacities)
    if tokens_col:
        counted = rows.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.col(id_col).cast("string")).alias("_row"),
                              F.col(tokens_col).cast("bigint").alias("_tokens"))
    else:
        counted = counted_tokens(rows, id_col, text_col)
    with small_batches(rows.sparkSession):
        cut = written(pieces(counted, "_tokens", capacities[-1]).drop("_tokens"), "pieces")
    shards = max(1, -(-cut.count() // shard_rows))
    dealt = cut.withColumn("_shard", F.pmod(F.xxhash64("_row", "doc_id", "piece"), F.lit(shards)))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_tokens", "_row", "piece", "doc_id"], ascending=[False, True, True, True])
        bins, final, _ = pack_shard(group.n_tokens.tolist(), capacities, overhead)
        group = group.assign(bin_id=[int(key[0]) * 2**32 + b for b in bins], capacity=[final[b] for b in bins])
        group["place"] = group.groupby("bin_id").n_tokens.cumsum() - group.n_tokens
        return group[["doc_id", "piece", "start_token", "n_tokens", "bin_id", "capacity", "place"]]

    return dealt.groupBy("_shard").applyInPandas(
        run, "doc_id bigint, piece int, start_token bigint, n_tokens bigint, bin_id bigint, capacity int, place bigint")
