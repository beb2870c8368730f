"""Hierarchical multi-length packing of whole documents into training sequences (operator 12).

A document's tokens are the ids a byte-level BPE tokenizer gives its text, then an end token. Within a shard (the rows
of one Arrow batch of one task, at most 10,000 by Spark's default) documents are routed by length to context-size tiers:

1. Every full ``window`` of a long document is a sequence of its own; the rest, shorter than a window, goes to
   the tier of the next power of two (``window``, ``window / 2``, .. ``shortest``); still shorter rests wait as fillers.
2. Tiers are packed from the longest. Each rest of a tier opens a window of the tier's size, and the gap, less than half of
   it, is filled from shorter tiers: by one rest or by two that fit exactly if there are such, else by the longest that
   fits, and so on. What then remains is cut from the shortest rest at hand; its other part goes back to its tier.
3. The fillers still waiting share windows of the longest size. Only the last window of a shard can stay unfilled; its
   contents are cut into powers of two, so no sequence is padded.
4. Sequences are dealt to step groups of about ``step_tokens`` tokens, longest and costliest (sum of squared
   piece lengths, the attention's work) first, each to the group with the fewest tokens and then the least cost.

Nothing is shuffled: a text is tokenized, packed and checked where it is read, so a lost executor costs its tasks again and
memory holds one batch of texts. Sequence and step ids carry the task's partition number in their upper bits.

Null and empty texts are the end token alone. Very long texts give as many pieces as they need, within one task. Repeated rows
are documents of their own; equal lengths are taken last in, first out. A null id stays null. An empty table gives an
empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import heapq
import json
import zlib
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import text_slices

WINDOW = 1024
SHORTEST = 128
STEP_TOKENS = 65_536
END_TOKEN = 0
SLICE_BYTES = 24_000_000  # text whose distinct chunks are tokenized once

PACKED = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
          "offset bigint, capacity bigint, step_group bigint")


# --- tokenizing -----------------------------------------------------------------------------

def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 characters stand for themselves, the
    other bytes for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(others)}}


def _mask(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for first, last in ranges:
        out[first:last + 1] = True
    return out


_VISIBLE = _mask((0x21, 0x7E))
_LETTER = _mask((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))
_MARK = _VISIBLE & ~_LETTER
_MARK[ord("'")] = False  # contractions
_AFTER_SPACE = _VISIBLE | _mask((0xC3, 0xDF), (0xE4, 0xF4))  # starts no white space
_RARE = _mask((0x00, 0x08), (0x0B, 0x0C), (0x0E, 0x1F), (0x7F, 0x7F), (0xC2, 0xC2), (0xD4, 0xFF))


class Encoder:
    """Token ids of whole columns by the tokenizer of a ``tokenizers`` file.

    A byte-level BPE without normalizer never joins letters over an inner space, a line break or an ASCII mark after a
    letter; texts are cut there, and each distinct chunk of a slice is encoded once. Chunks of plain Latin, Greek and
    Cyrillic text go through ``tiktoken`` with the same vocabulary (the same ids, several times as fast), all others, and
    rows that hold a special token, through ``tokenizers``. Other kinds of tokenizer encode whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"].encode() for t in spec.get("added_tokens") or []]
        self.fast = self._fast(spec)

    @staticmethod
    def _fast(spec: dict):
        import tiktoken

        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if (spec.get("normalizer") or spec.get("post_processor") or model.get("type") != "BPE" or pre.get("type") != "ByteLevel"
                or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("dropout")
                or model.get("ignore_merges")):
            return None
        vocab, special = model["vocab"], {t["content"] for t in spec.get("added_tokens") or []}
        merged = ("".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"])
        if any(vocab.get(m) != 256 + i for i, m in enumerate(merged)):  # ids don't follow the merges
            return None
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in word): i for word, i in vocab.items() if word not in special}
        pattern = (r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s""")
        return tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _slow_ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.whole.encode_batch(texts, add_special_tokens=False)]

    def _chunk_starts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        cut = np.zeros(len(data), bool)
        if len(data) > 1:
            before, here = data[:-1], data[1:]
            cut[:-1] = (before == 32) & _AFTER_SPACE[here]
            cut[1:] |= ((here == 10) & _VISIBLE[before]) | (_LETTER[before] & _MARK[here])
        ends = off[1:][off[1:] > 0]
        cut[ends - 1] = False  # the last byte of a row looks at the next row's first
        starts = off[:-1][off[:-1] < len(data)]
        cut[starts] = True
        raw = data.tobytes() if self.special else b""
        if any(s in raw for s in self.special):
            for a, b in zip(off[:-1], off[1:]):
                if any(raw.find(s, a, b) >= 0 for s in self.special):
                    cut[a + 1:b] = False
        return np.flatnonzero(cut)

    def _slice_ids(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = self._chunk_starts(data, off)
        bounds = np.append(starts, len(data))
        chunks = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])
        coded = chunks.dictionary_encode()
        texts = coded.dictionary.cast(pa.large_string()).to_pylist()
        raw = coded.dictionary
        size = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
        rare = np.concatenate([[0], np.cumsum(_RARE[np.frombuffer(raw.buffers()[2], np.uint8)[:size[-1]]], dtype=np.int64)])
        slow = np.flatnonzero(rare[size[1:]] > rare[size[:-1]]).tolist()
        slow += [i for i, t in enumerate(texts) if any(s in t for s in (x.decode() for x in self.special))] if self.special else []
        apart = set(slow)
        ids = [None if i in apart else self.fast(t) for i, t in enumerate(texts)]
        for i, found in zip(slow, self._slow_ids([texts[i] for i in slow])):
            ids[i] = found
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum()))
        code = coded.indices.to_numpy(zero_copy_only=False)
        lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]), pa.array(flat))
        ends = np.concatenate([[0], np.cumsum(counts[code])])
        return lists.take(coded.indices).flatten().to_numpy(zero_copy_only=False), ends[np.searchsorted(starts, off)]

    def __call__(self, texts: pa.Array, slice_bytes: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, and the rows' offsets into them."""
        parts, offs, at = [], [np.zeros(1, np.int64)], 0
        for first, end, data, off in text_slices(texts, slice_bytes):
            if self.fast and len(data):
                ids, rows = self._slice_ids(data, off)
            else:
                lists = self._slow_ids([bytes(data[a:b]).decode() for a, b in zip(off[:-1], off[1:])])
                rows = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
                ids = np.fromiter(chain.from_iterable(lists), np.uint32, int(rows[-1]))
            parts.append(ids)
            offs.append(rows[1:] + at)
            at += int(rows[-1])
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), np.concatenate(offs).astype(np.int64)


@functools.cache
def encoder(path: str) -> Encoder:
    """One per worker process."""
    return Encoder(path)


def with_end(ids: np.ndarray, off: np.ndarray, end_token: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's ids followed by the end token."""
    rows = len(off) - 1
    out = np.full(len(ids) + rows, end_token, "<u4")
    keep = np.ones(len(out), bool)
    off = off + np.arange(rows + 1)
    keep[off[1:] - 1] = False
    out[keep] = ids
    return out, off


# --- packing --------------------------------------------------------------------------------

class _Rests:
    """Rests of documents by length, with the lengths at hand as bits of a number."""

    def __init__(self, window: int):
        self.window = window
        self.of = [[] for _ in range(window + 1)]
        self.bits = 0      # bit n: a rest of length n is at hand
        self.mirrored = 0  # bit window - n, for exact pairs

    def put(self, doc: int, start: int, length: int) -> None:
        if not self.of[length]:
            self.bits |= 1 << length
            self.mirrored |= 1 << (self.window - length)
        self.of[length].append((doc, start))

    def take(self, length: int) -> tuple[int, int, int]:
        doc, start = self.of[length].pop()
        if not self.of[length]:
            self.bits &= ~(1 << length)
            self.mirrored &= ~(1 << (self.window - length))
        return doc, start, length

    def longest(self, most: int) -> int:
        """Greatest length at hand up to ``most``; 0 if there is none."""
        return max(0, (self.bits & ((1 << (most + 1)) - 1)).bit_length() - 1)

    def pair(self, total: int) -> int:
        """A length at hand whose complement to ``total`` is at hand too; 0 if there is none."""
        both = self.bits & (self.mirrored >> (self.window - total)) & ((1 << total) - 1)
        while both:
            a = both.bit_length() - 1
            if a * 2 != total or len(self.of[a]) > 1:
                return a
            both &= ~(1 << a)
        return 0

    def shortest_over(self, least: int) -> int:
        above = self.bits >> (least + 1)
        return least + 1 + (above & -above).bit_length() - 1 if above else 0


def _fill(rests: _Rests, gap: int, window: list) -> int:
    """Fill ``gap`` from the rests; what stays unfilled when none are left."""
    while gap and rests.bits:
        length = rests.longest(gap)
        if length and length != gap:
            length = rests.pair(gap) or length
        if length:
            window.append(rests.take(length))
            gap -= length
        else:  # all are longer than the gap
            doc, start, length = rests.take(rests.shortest_over(gap))
            window.append((doc, start, gap))
            rests.put(doc, start + gap, length - gap)
            gap = 0
    return gap


def pack_tiers(lengths: Sequence[int], window: int = WINDOW, shortest: int = SHORTEST) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) pieces that hold every token of documents of these lengths; each
    sequence is as long as a power of two up to ``window``, itself one."""
    out, rests = [], _Rests(window)
    for doc, n in enumerate(lengths):
        whole = n - n % window
        out.extend([(doc, at, window)] for at in range(0, whole, window))
        if n > whole:
            rests.put(doc, whole, n - whole)
    last: list[tuple[int, int, int]] = []

    def open_window(tier: int, length: int) -> None:
        sequence = [rests.take(length)]
        if _fill(rests, tier - length, sequence):
            last.extend(sequence)  # nothing is left
        else:
            out.append(sequence)

    tier = window
    while tier >= shortest:
        while (length := rests.longest(tier)) > tier // 2:
            open_window(tier, length)
        tier //= 2
    while rests.bits:  # fillers
        open_window(window, rests.longest(window))
    out.extend(_powers(last))
    return out


def _powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """One unfilled sequence cut into sequences of distinct powers of two, the longest first."""
    total, out = sum(n for _, _, n in pieces), []
    waiting = pieces[::-1]
    while total:
        room = size = 1 << (total.bit_length() - 1)
        sequence = []
        while room:
            doc, start, n = waiting.pop()
            if n > room:
                waiting.append((doc, start + room, n - room))
                n = room
            sequence.append((doc, start, n))
            room -= n
        out.append(sequence)
        total -= size
    return out


def step_groups(sequences: list[list[tuple[int, int, int]]], step_tokens: int = STEP_TOKENS) -> list[int]:
    """Group of each sequence; the groups hold about ``step_tokens`` tokens each and as equal costs as the greedy deal gives."""
    tokens = [sum(n for _, _, n in s) for s in sequences]
    cost = [sum(n * n for _, _, n in s) for s in sequences]
    groups = max(1, round(sum(tokens) / step_tokens))
    heap, out = [(0, 0, g) for g in range(groups)], [0] * len(sequences)
    for i in sorted(range(len(sequences)), key=lambda i: (-tokens[i], -cost[i], i)):
        t, c, g = heap[0]
        out[i] = g
        heapq.heapreplace(heap, (t + tokens[i], c + cost[i], g))
    return out


# --- the operator ---------------------------------------------------------------------------

def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         shortest: int = SHORTEST, step_tokens: int = STEP_TOKENS, end_token: int = END_TOKEN) -> DataFrame:
    """One row per piece: its document, ``start`` and ``length`` in the document's ids, the checksum of its ids, the
    document's length, its ``sequence_id``, ``offset`` there, the sequence's ``capacity`` (a power of two) and ``step_group``.

    ``window`` and ``shortest`` are powers of two. ``tokenizer_path`` is a file every executor can read.
    """
    if window & (window - 1) or shortest & (shortest - 1) or not 1 < shortest <= window:
        raise ValueError("window and shortest must be powers of two, shortest at most window")

    def run(batches):
        encode, part = encoder(tokenizer_path), TaskContext.get().partitionId() << 36
        sequences_before = groups_before = 0
        for batch in batches:
            ids, off = with_end(*encode(batch.column(1)), end_token)
            size = np.diff(off)
            sequences = pack_tiers(size.tolist(), window, shortest)
            groups = step_groups(sequences, step_tokens)
            counts = [len(s) for s in sequences]
            doc, start, length = (np.fromiter(chain.from_iterable(map(chain.from_iterable, sequences)), np.int64).reshape(-1, 3).T
                                  if sequences else np.zeros((3, 0), np.int64))
            totals = np.array([sum(n for _, _, n in s) for s in sequences], np.int64)
            first = np.repeat(np.cumsum(totals) - totals, counts)
            begin = off[doc] + start
            crc = [zlib.crc32(ids[a:a + n]) for a, n in zip(begin.tolist(), length.tolist())]
            number = np.arange(len(sequences), dtype=np.int64)
            yield pa.record_batch([
                batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(size[doc]),
                pa.array(part + sequences_before + np.repeat(number, counts)), pa.array(np.cumsum(length) - length - first),
                pa.array(np.repeat(totals, counts)), pa.array(part + groups_before + np.repeat(np.array(groups, np.int64), counts)),
            ], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "capacity", "step_group"])
            sequences_before += len(sequences)
            groups_before += max(groups, default=-1) + 1

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, PACKED)
