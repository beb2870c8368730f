"""N-gram Jaccard join (operator 9): documents whose word-shingle sets reach a Jaccard threshold.

Exact: no link between different sets is lost, and none is guessed.

1. *Sets.* One pass hashes the shingles (64 bits) and keeps per document the set size, a 64-bit id of the set (a sum of mixed member
   hashes), a hashed bitmap signature and the set's keys.
2. *Keys.* Sizes fall into bands, each so narrow that a set can link only with sets of its band and the two beside it. Under a band two
   sets that reach the threshold differ in at most ``D`` members, whatever these are. So the members are dealt by hash over more
   than ``D`` parts, and at least one part is the same in both: a key is the hash of one whole part. A set has the keys of its own band
   and of the next one. Sets that share a single shingle, however rare or common, share no key. Empty parts make keys only of
   sets with more of them than spare parts. Keys of a single set go: each task sends its distinct keys once, packed, to find those that several hold.
3. *Centres.* Each key with unlinked sets names a centre, and each set meets the centre most of its keys name. What that
   links is one component from then on. ``ROUNDS`` rounds leave few keys with near sets of several components.
4. *Tiles.* The sets of such a key are ordered by size and cut into tiles of ``tile`` sets; tile pairs whose sizes
   can meet are compared as separate groups of bounded size, skipping pairs of one component. Only sizes and
   bitmaps travel to them (under ``FEW`` sets no bitmaps, and the pairs that the sizes allow).
5. *Checks.* For each pair, once whatever keys it shares, bit counts of the bitmaps bound the overlap from above; a pair that passes
   gets the exact intersection of the sorted arrays, which are made for the sets of such pairs only.
6. *Components* of the links, by distributed union-find; exact copies (equal sets) share one node from step 2.

No group is a component or a block of keys, so none grows with the corpus. Very long texts are hashed whole; a set's
array is one row (8 bytes a shingle). An empty table gives an empty result.
Null and empty texts and texts of white space have no shingles and link with nothing. Repeated
rows of one ``doc_id`` are equal or different texts like any other rows; each row is returned. A null id
counts as no smallest id, unless its component has no other.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scan import ordered_scan
from .common import components, passing, small_batches, written
from .lexical_search import BITMAP, term_bitmap
from .shingles import mix, shingle_hashes, signed, text_slices, word_hashes, word_spans

WORDS = 3          # words in a shingle
PERCENT = 90       # link when 100 * intersection >= PERCENT * union
TILE = 512         # sets in a tile
BITS = 2048        # bits in a bitmap signature
FEW = 8            # sets of a key whose pairs by size are few
COUNTERS = 1 << 23     # of a shingle sketch
BUCKET_KEYS = 1_000_000  # keys looked through for repeats in one task
ROUNDS = 2         # of centres before the tiles
FOREST_ROWS = 500_000  # links in one task of the local union-find

_SETS = pa.schema([("row_key", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.int64()),
                   ("bits", pa.binary()), ("keys", pa.list_(pa.int64()))])


def set_id(members: np.ndarray) -> np.uint64:
    """Id of a set, the same for equal sets whatever their texts."""
    return mix(np.array([mix(members, 22).sum(dtype=np.uint64) + np.uint64(len(members))], np.uint64))[0]


def size_band(n: int, percent: int) -> tuple[int, int, int]:
    """(number, least size, greatest size) of the band of sets with ``n`` members: a set of a band's greatest size can link
    with one of its least size, not with the band below that."""
    band, low = 0, 1
    while (high := 100 * low // percent) < n:
        band, low = band + 1, high + 1
    return band, low, high


def part_keys(members: np.ndarray, percent: int) -> np.ndarray:
    """The keys of one set: for its size band and the next one the hashes of its parts, of which linked sets share one."""
    band, _, high = size_band(len(members), percent)
    dealt, mixed, out = mix(members, 41), mix(members, 42), []
    for number, most in ((band, high), (band + 1, 100 * (high + 1) // percent)):
        differ = 2 * most * (100 - percent) // (100 + percent)  # members that only one of two linked sets has, at most
        spare = 2 + differ // 12
        parts = differ + 1 + spare
        place = (dealt % np.uint64(parts)).astype(np.int64)
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, place, mixed)
        keys = mix(mix(sums, 43) + np.arange(parts, dtype=np.uint64), 44 + number)
        held = np.bincount(place, minlength=parts) > 0
        # of the parts that two linked sets have alike more than ``spare``: all can be empty only where both sets have so many empty ones
        out.append(keys[held] if parts - held.sum() <= spare else keys)
    return np.unique(np.concatenate(out))


def prefix_keys(members: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """Those of a set's members, rare ones first, that a linked set's must meet: the plain prefix filter (its keys meet by chance
    ever more often as the corpus grows, so the join has ``part_keys``)."""
    n = len(members)
    place = counts[(members & np.uint64(COUNTERS - 1)).astype(np.int64)]
    return members[np.lexsort((members, place))[:n + (-percent * n // 100) + 1]]


def bitmap(members: np.ndarray) -> bytes:
    """A set's bitmap signature."""
    out = np.zeros(BITS, bool)
    out[(members % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


def _row_sets(col: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, _, data, off in text_slices(col):
        starts, _, rows = word_spans(data, off)
        hashes, at = shingle_hashes(word_hashes(data, starts), rows, words)
        for i in range(len(off) - 1):
            yield np.unique(hashes[at[i]:at[i + 1]])


def row_key(id_col: str, text_col: str) -> Column:
    """A row's hash: equal rows share it, rows of one id with different texts do not."""
    return F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string")).alias("row_key")


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, keyed: bool = True) -> DataFrame:
    """Steps 1 and 2: (row_key, doc_id, n_shingles, set_id, bits, keys) for each row of ``docs``; without ``keyed`` no keys."""
    def run(batches):
        for batch in batches:
            sizes, names, bits, keys = [], [], [], []
            for members in _row_sets(batch.column(2), words):
                sizes.append(len(members))
                names.append(set_id(members))
                bits.append(bitmap(members))
                keys.append(signed(part_keys(members, percent)) if keyed and len(members) else np.zeros(0, np.int64))
            off = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            yield pa.record_batch([
                batch.column(0), batch.column(1), pa.array(sizes, pa.int64()),
                pa.array(signed(np.array(names, np.uint64))),
                pa.array(bits, pa.binary()), pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))),
            ], schema=_SETS)

    plain = docs.select(row_key(id_col, text_col), F.col(id_col).cast("bigint").alias("doc_id"),
                        F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(run, "row_key bigint, doc_id bigint, n_shingles bigint, set_id bigint, bits binary, "
                                 "keys array<bigint>")


def with_several(rows: DataFrame, col: str) -> DataFrame:
    """Rows of the keys under which ``col`` has several values."""
    keys = rows.groupBy("key").agg(F.min(col).alias("lo"), F.max(col).alias("hi")).where("lo < hi").select("key")
    return rows.join(keys, "key", "left_semi")


def shared_rows(sets: DataFrame, total: int | None = None) -> DataFrame:
    """(key, set_id) of the keys that several different sets hold; ``total``: about the number of all keys, if known. Each key
    travels once with its set, in 14 bytes: the bucket that it is dealt to and 48 bits more stand for it, so what is sent grows as
    the input does. Different keys that agree in these bits only bring sets together that the bitmaps then tell apart."""
    if total is None:
        total = sets.agg(F.sum(F.size("keys"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_KEYS))

    def packed(names: list[np.ndarray], keys: list[np.ndarray]):
        names, keys = np.concatenate(names), mix(np.concatenate(keys).view(np.uint64), 3)
        bucket = (keys % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        low = (keys // np.uint64(buckets))[order].view(np.uint8).reshape(-1, 8)[:, :6]
        held = np.flatnonzero(np.diff(ends))
        for at in range(0, len(held), 64):
            some = held[at:at + 64]
            yield pa.record_batch([pa.array(some, pa.int64()), pa.array([low[ends[k]:ends[k + 1]].tobytes() for k in some], pa.binary()),
                                   pa.array([names[order[ends[k]:ends[k + 1]]].tobytes() for k in some], pa.binary())],
                                  names=["bucket", "keys", "names"])

    def local(batches):
        names, keys, seen = [], [], 0
        for batch in batches:
            lists = batch.column(1)
            keys.append(lists.flatten().to_numpy(zero_copy_only=False))
            names.append(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())))
            seen += len(keys[-1])
            if seen >= BUCKET_KEYS:
                yield from packed(names, keys)
                names, keys, seen = [], [], 0
        if seen:
            yield from packed(names, keys)

    def reduce(rows: pa.Table) -> pa.Table:
        low = np.concatenate([np.frombuffer(k, np.uint8).reshape(-1, 6) for k in rows.column("keys").to_pylist()])
        keys = np.zeros((len(low), 8), np.uint8)
        keys[:, :6] = low
        keys = keys.view(np.uint64).ravel()
        names = np.concatenate([np.frombuffer(n, np.int64) for n in rows.column("names").to_pylist()])
        order = np.lexsort((names, keys))
        keys, names = keys[order], names[order]
        new = np.ones(len(keys), bool)  # equal sets are one
        new[1:] = (keys[1:] != keys[:-1]) | (names[1:] != names[:-1])
        keys, names = keys[new], names[new]
        alike = keys[1:] == keys[:-1]
        several = np.zeros(len(keys), bool)
        several[1:] |= alike
        several[:-1] |= alike
        whole = mix(keys[several], 5 + rows.column("bucket")[0].as_py())
        return pa.table([pa.array(signed(whole)), pa.array(names[several])], names=["key", "set_id"])

    found = (sets.select("set_id", "keys").mapInArrow(local, "bucket bigint, keys binary, names binary")
             .groupBy("bucket").applyInArrow(reduce, "key bigint, set_id bigint"))
    return written(found, "shared-keys", few=True)


def local_forests(links: DataFrame, rows: int = FOREST_ROWS) -> DataFrame:
    """(a, b): each task's links, about ``rows`` of them, as stars around the smallest node of their local
    components. Connects what the links connect, with fewer rows and shorter paths."""
    tasks = max(1, -(-links.count() // rows))

    def run(batches):
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = find(x), find(y)
                root[max(x, y)] = min(x, y)
        stars = [(find(x), x) for x in root]
        yield pa.record_batch([pa.array([s for s, x in stars if s != x], pa.int64()),
                               pa.array([x for s, x in stars if s != x], pa.int64())], names=["a", "b"])

    return links.select("a", "b").coalesce(tasks).mapInArrow(run, "a bigint, b bigint")


def held_sets(docs: DataFrame, sets: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(set_id, members) of the wanted sets, each once, from the texts."""
    rows = written(sets.groupBy("set_id").agg(F.min("row_key").alias("row_key")).join(wanted, "set_id", "left_semi"), "wanted", few=True)
    known = sets.sparkSession.sparkContext.broadcast(np.packbits(term_bitmap(rows.select(F.col("row_key").alias("term")))))

    def likely(batches):
        bits = np.unpackbits(known.value).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(bits[batch.column(0).to_numpy(zero_copy_only=False) & (BITMAP - 1)]))

    def arrays(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made = [m.tobytes() for m in _row_sets(part.column(1), words)]
                yield pa.record_batch([part.column(0), pa.array(made, pa.binary())], names=["set_id", "members"])

    texts = docs.select(row_key(id_col, text_col), F.col(text_col).cast("string").alias("text")).mapInArrow(
        likely, "row_key bigint, text string")
    one = texts.join(rows, "row_key").dropDuplicates(["row_key"]).select("set_id", "text")
    return written(one.mapInArrow(arrays, "set_id bigint, members binary"), "held")


def _overlap_bound(maps_x: np.ndarray, maps_y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """What two sets can share at most, by the bits that only one of them has."""
    only_x = np.bitwise_count(maps_x & ~maps_y).sum(axis=-1, dtype=np.int64)
    only_y = np.bitwise_count(maps_y & ~maps_x).sum(axis=-1, dtype=np.int64)
    return np.minimum(nx - only_x, ny - only_y)


def bounded(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the bitmaps allow. ``marks``: (set_id, n, bits)."""

    def run(batches):
        for batch in batches:
            nx, ny = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 4))
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(batch.num_rows, BITS // 64) for k in (3, 5))
            most = _overlap_bound(x, y, nx, ny)
            yield pa.record_batch(batch.columns[:2], names=["a", "b"]).filter(pa.array(100 * most >= percent * (nx + ny - most)))

    side = lambda c: marks.select(F.col("set_id").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "bitsa", "nb", "bitsb").mapInArrow(
        run, "a bigint, b bigint")


def exact_links(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sets that reach the threshold, by the intersection of their sorted arrays."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.record_batch(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = pairs.join(held.select(F.col("set_id").alias("b"), F.col("members").alias("y")), "b")
    both = first.join(held.select(F.col("set_id").alias("a"), F.col("members").alias("x")), "a").select("a", "b", "x", "y")
    return both.mapInArrow(run, "a bigint, b bigint")


def open_rows(shared: DataFrame, links: DataFrame) -> DataFrame:
    """(key, set_id, n, comp) of the keys whose sets are in several components of the links so far."""
    labels = components(local_forests(links)).withColumnRenamed("node", "set_id")
    rows = shared.join(labels, "set_id", "left").select("key", "set_id", "n", F.coalesce("component", "set_id").alias("comp"))
    return written(with_several(rows, "comp"), "open", few=True)


def _sizes_meet(x: str, y: str, percent: int) -> Column:
    return (F.col(x) * percent <= F.col(y) * 100) & (F.col(y) * percent <= F.col(x) * 100)


def centre_pairs(rows: DataFrame, percent: int, turn: int) -> DataFrame:
    """Step 3: each set with the centre that most of its keys name."""
    centre = rows.groupBy("key").agg(F.min_by(F.struct("set_id", "n", "comp"), F.xxhash64("set_id", F.lit(turn))).alias("c"))
    named = (rows.join(centre, "key").select(F.col("c.set_id").alias("a"), F.col("set_id").alias("b"), F.col("c.n").alias("na"), "n",
                                             F.col("c.comp").alias("ca"), "comp").where("ca <> comp").where(_sizes_meet("na", "n", percent)))
    votes = named.groupBy("a", "b").agg(F.count(F.lit(1)).alias("votes"))
    return votes.groupBy("b").agg(F.max_by("a", F.struct("votes", "a")).alias("a")).select("a", "b")


def tile_pairs_of(size: np.ndarray, comp: np.ndarray, place: np.ndarray, maps: np.ndarray | None, left: int,
                  percent: int) -> list[tuple[int, int]]:
    """Pairs of different components that sizes, the key's places in sets of one order (0 without) and, if given, bitmaps allow: within all sets (``left`` 0), or
    of the first ``left`` with the others."""
    rest = size - place  # members from the key on
    out = []
    for i in range(left or len(size) - 1):
        others = np.arange(left or i + 1, len(size))
        others = others[(comp[others] != comp[i]) & (100 * np.minimum(size[others], size[i]) >= percent * np.maximum(size[others], size[i]))]
        most = np.minimum(rest[others], rest[i])
        others = others[100 * most >= percent * (size[i] + size[others] - most)]
        if len(others) and maps is not None:
            most = _overlap_bound(maps[i], maps[others], size[i], size[others])
            others = others[100 * most >= percent * (size[i] + size[others] - most)]
        out += [(i, j) for j in others.tolist()]
    return out


def _grouped(compare, batches):
    """Apply ``compare`` to each run of rows with the same first three columns and give out its pairs."""
    group: list[tuple] = []

    def pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    for batch in batches:
        out = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if group and group[0][:3] != row[:3]:
                out += compare(group)
                group = []
            group.append(row)
        yield pairs(out)
    yield pairs(compare(group) if group else [])


def tile_pairs(rows: DataFrame, marks: DataFrame, percent: int, tile: int) -> DataFrame:
    """Step 4: the distinct pairs (a, b) of different components under one key: of few sets by sizes, of more by bitmaps too."""
    ranked = written(ordered_scan(rows, [F.col("n"), F.col("set_id")], ["key"], rank="place", total="held")
                     .withColumn("tile", F.floor((F.col("place") - 1) / tile).cast("int")).drop("place"), "tiles", few=True)
    few = F.col("held") <= min(FEW, tile)
    many = ranked.where(~few)
    ends = many.groupBy("key", "tile").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    x, y = ends.alias("x"), ends.alias("y")
    meets = ((F.col("x.key") == F.col("y.key")) & (F.col("x.tile") <= F.col("y.tile"))
             & (F.col("y.lo") * percent <= F.col("x.hi") * 100) & (F.least("x.c0", "y.c0") < F.greatest("x.c1", "y.c1")))
    pairs = x.join(y, meets).select("x.key", F.col("x.tile").alias("i"), F.col("y.tile").alias("j"))
    sides = pairs.select("key", "i", "j", F.col("i").alias("tile")).unionByName(
        pairs.where("i <> j").select("key", "i", "j", F.col("j").alias("tile")))
    sent = many.join(sides, ["key", "tile"]).join(marks.select("set_id", "bits"), "set_id").select(
        "key", "i", "j", "tile", "set_id", "n", "comp", "bits")
    small = ranked.where(few).select("key", F.col("tile").alias("i"), F.col("tile").alias("j"), "tile", "set_id", "n", "comp",
                                     F.lit(None).cast("binary").alias("bits"))

    def compare(group: list[tuple]) -> list[tuple[int, int]]:
        _, i, j = group[0][:3]
        size, comp = (np.array([g[k] for g in group]) for k in (5, 6))
        maps = None if group[0][7] is None else np.frombuffer(b"".join(g[7] for g in group), np.uint64).reshape(len(group), -1)
        left = 0 if i == j else sum(g[3] == i for g in group)
        return [tuple(sorted((group[p][4], group[q][4]))) for p, q in tile_pairs_of(size, comp, np.zeros_like(size), maps, left, percent)]

    dealt = lambda part: (part.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "tile", "set_id")
                          .mapInArrow(lambda batches: _grouped(compare, batches), "a bigint, b bigint"))
    return dealt(sent).unionByName(dealt(small)).distinct()


def keyed_sets(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (row_key, doc_id, n_shingles, set_id), the keys that several sets hold (key, set_id, n) and the bitmaps (set_id, n, bits)
    of their sets. The lists of all keys, most of the bytes, are made on the way to the shuffle and never written."""
    with passing(docs.sparkSession) as keep:
        sets = written(shingle_sets(docs, id_col, text_col, words, percent, keyed=False).drop("keys"), "sets")
        total = sets.agg(F.sum(F.col("n_shingles") + 8)).first()[0] or 0
        found = shared_rows(shingle_sets(docs, id_col, text_col, words, percent), total)
        marks = written(sets.select("set_id", F.col("n_shingles").alias("n"), "bits").join(
            found.select("set_id").distinct(), "set_id", "left_semi").dropDuplicates(["set_id"]), "marks", few=True)
        shared = written(found.join(marks.select("set_id", "n"), "set_id").select("key", "set_id", "n"), "shared", few=True)
        return keep(sets.drop("bits")), keep(shared), keep(marks)


def set_links(docs: DataFrame, sets: DataFrame, shared: DataFrame, marks: DataFrame, id_col: str, text_col: str, words: int,
              percent: int, tile: int) -> DataFrame:
    """Links (a, b) of set ids that connect whatever the threshold connects."""
    held, links, rows = None, None, shared.withColumn("comp", F.col("set_id"))
    with passing(docs.sparkSession) as keep:
        for turn in range(ROUNDS + 1):
            last = turn == ROUNDS
            pairs = tile_pairs(rows, marks, percent, tile) if last else centre_pairs(rows, percent, turn)
            pairs = written(bounded(written(pairs, "pairs", few=True), marks, percent), "near-pairs", few=True)
            wanted = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
            if held is not None:  # what earlier rounds have made is not made again
                wanted = wanted.join(held.select("set_id"), "set_id", "left_anti")
            more = held_sets(docs, sets, wanted, id_col, text_col, words)
            held = more if held is None else held.unionByName(more)
            found = written(exact_links(pairs, held, percent), "found", few=True)
            links = found if links is None else links.unionByName(found)
            if not last:
                rows = open_rows(shared, links)
        return keep(links)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                       percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """(row_key, doc_id, n_shingles, component_id) for every row of ``docs``: the set size, and the smallest
    id that links reach. See the module's text for the steps and the odd cases."""
    with passing(docs.sparkSession) as keep:
        with small_batches(docs.sparkSession):
            sets, shared, marks = keyed_sets(docs, id_col, text_col, words, percent)
            links = set_links(docs, sets, shared, marks, id_col, text_col, words, percent, tile)
        joined = components(local_forests(links)).withColumnRenamed("node", "set_id")
        first = sets.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("first"))
        named = first.join(joined, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
        lowest = written(named.groupBy("component").agg(F.min("first").alias("component_id")), "lowest")
        of_set = written(written(named, "named").join(lowest, "component").select("set_id", "component_id"), "of-set")
        return keep(sets.select("row_key", "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_id")).alias("set_id"))
                    .join(of_set, "set_id", "left")
                    .select("row_key", "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))
