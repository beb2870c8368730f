"""Vectorised word hashing over Arrow text columns, used inside Arrow tasks.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return; A-Z count as a-z. A word's hash is the sum over its bytes of a random number for the byte
times a random number for its place, then mixed; a shingle's hash combines its words' hashes in order. All of
a batch is hashed with a few numpy passes, in slices of bounded size, so memory does not depend
on text lengths beyond one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 500_000  # text hashed in one numpy pass

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_PLACE = _rng.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE[_SPACE] = 0


_ALNUM = np.full(256, 32, np.uint8)
_ALNUM[48:58] = np.arange(48, 58)
_ALNUM[65:91] = np.arange(97, 123)
_ALNUM[97:123] = np.arange(97, 123)
_ALNUM[128:] = np.arange(128, 256)
_LETTERS = _ALNUM.copy()
_LETTERS[48:58] = 32


def fold(data: np.ndarray, digits: bool = True) -> np.ndarray:
    """Bytes with A-Z and the Latin-1 capitals as small letters, and all ASCII but letters (and
    ``digits``) as spaces; the length stays."""
    out = (_ALNUM if digits else _LETTERS)[data]
    if len(out) > 1:
        capital = (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97) & (out[:-1] == 0xC3)
        out[1:][capital] += 0x20
    return out


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), with a seed."""
    h = h ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def text_slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into row ranges of at most ``limit`` bytes (or one row): yields first
    row, end row, the bytes and the rows' offsets into them. A null counts as an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    n = len(col)
    if not n:
        return
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        end = min(end, n)
        yield at, end, data[off[at]:off[end]], off[at:end + 1] - off[at]
        at = end


def word_spans(data: np.ndarray, off: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of all words, and each row's offsets into them. ``gaps`` marks the bytes between words."""
    size = len(data)
    if not size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~gaps[data]
    first = np.empty(size, bool)
    first[0] = True
    np.logical_not(word[:-1], out=first[1:])
    first[off[:-1][off[:-1] < size]] = True
    first &= word
    last = np.empty(size, bool)
    last[-1] = True
    np.logical_not(word[1:], out=last[:-1])
    ends = off[1:][off[1:] > 0]
    last[ends - 1] = True
    last &= word
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off).astype(np.int64)


def word_hashes(data: np.ndarray, starts: np.ndarray, codes: np.ndarray = _BYTE) -> np.ndarray:
    """Hash of each word, from its start to the next word's (bytes between words have the code 0)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    body = data[starts[0]:]
    begin = starts - starts[0]
    place = np.arange(len(body), dtype=np.int64)
    place -= np.repeat(begin, np.diff(np.append(begin, len(body))))
    return mix(np.add.reduceat(codes[body] * _PLACE[place & 4095], begin))


def letter_codes(gaps: np.ndarray) -> np.ndarray:
    """Byte codes for ``word_hashes`` with the bytes between words at 0."""
    return np.where(gaps, np.uint64(0), _BYTE)


def shingle_hashes(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside a row, in order, and the rows' offsets into them.
    A row of fewer words gives its whole sequence as one shingle; a row without words none."""
    count = np.diff(rows)
    made = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    off = np.concatenate([[0], np.cumsum(made)])
    # first word of each shingle
    first = np.arange(off[-1], dtype=np.int64) + np.repeat(rows[:-1] - off[:-1], made)
    out = np.zeros(off[-1], np.uint64)
    length = np.repeat(np.minimum(count, n), made)
    short = bool((count[count > 0] < n).any())
    for k in range(n):
        part = words[np.minimum(first + k, len(words) - 1)] * _WORD[k] if len(words) else out
        out += np.where(length > k, part, np.uint64(0)) if short else part
    return mix(out + length.astype(np.uint64)), off


def signed(h: np.ndarray) -> np.ndarray:
    """The same bits as signed longs, Spark's type."""
    return h.view(np.int64)
