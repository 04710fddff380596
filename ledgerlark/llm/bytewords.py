"""Words of texts and their hashes, worked out over whole Arrow batches with numpy.

Texts are looked at as UTF-8 bytes. A word is a longest run of bytes of a set
that holds all bytes from 0x80 on, so no character is ever cut. Hashes have 64
bits; two different words or shingles that meet inside one comparison share a
hash with a probability of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that white space parts: all but space and 0x09 to 0x0D.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of lower-case words of letters and digits: 0-9, a-z and all from 0x80 on.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_rng = np.random.Generator(np.random.PCG64(20_240_229))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = _rng.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
#: Bytes of words that are hashed at once; a longer word is a block of its own.
BLOCK = 1 << 20
#: Bytes of text that one call of a batch function gets, besides a longer single text.
SLICE = 2 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """x with all bits mixed (in place)."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `size` bytes of text, one row at least."""
    offsets, at = text_bytes(batch.column(column))[1], 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets[1:], offsets[at] + size, side="right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its texts; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of several texts: those of text i have the places first[i] to first[i + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word."""
        n = len(self.starts)
        out = np.empty(n, dtype=np.uint64)
        lengths = self.ends - self.starts
        total = np.concatenate([[0], np.cumsum(lengths)])
        powers = np.cumprod(np.full(64, _BASE, dtype=np.uint64))
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(total, total[at] + BLOCK, side="right")) - 1)
            own = lengths[at:to]
            if (longest := int(own.max())) > len(powers):
                powers = np.cumprod(np.full(longest, _BASE, dtype=np.uint64))
            begin = total[at:to] - total[at]
            within = np.arange(int(total[to] - total[at])) - np.repeat(begin, own)
            value = _BYTE[self.data[within + np.repeat(self.starts[at:to], own)]]
            value *= powers[within]
            out[at:to] = np.add.reduceat(value, begin)
            at = to
        out += lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return mixed(out)

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def words_of(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool = True) -> Words:
    """The words of texts given by text_bytes(), of bytes for which `kind` holds; with `lower`, A-Z become a-z."""
    if lower:
        data = LOWER[data]
    n = len(data)
    is_word = kind[data] if n else np.zeros(0, dtype=bool)
    before, after = np.empty(n, dtype=bool), np.empty(n, dtype=bool)
    if n:
        before[0], before[1:] = False, is_word[:-1]
        after[-1], after[:-1] = False, is_word[1:]
        inside = offsets[(offsets > 0) & (offsets < n)]
        before[inside] = False
        after[inside - 1] = False
    starts = np.flatnonzero(is_word & ~before)
    ends = np.flatnonzero(is_word & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets, side="left"))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each `size` consecutive words, whatever texts they belong to; place i is the window's first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, size * 0xA24BAED4963EE407 % 2**64, dtype=np.uint64)
    for j in range(size):
        out += hashes[j : j + n] * _STEP[j]
    return mixed(out)


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its `size`-word shingles.

    A text of fewer words, but not none, has one shingle: all its words.
    """
    hashes = words.hashes()
    full = windows(hashes, size)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(full[a : b - size + 1]))
        elif b > a:
            out.append(windows(hashes[a:b], int(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
