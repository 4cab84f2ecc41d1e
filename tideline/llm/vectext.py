"""Vectorised word tables over Arrow text columns.

An Arrow string column already is one UTF-8 buffer with offsets, so words, their 64-bit
fingerprints and their documents come from whole-buffer numpy operations instead of a Python loop
over words. Texts are taken whole; a block holds whole documents of about ``BLOCK`` bytes together
(a single longer document makes a block of its own), which bounds the memory of the intermediate
arrays to a small multiple of that.

Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 2 << 20
M64 = (1 << 64) - 1

_b = np.arange(256)
LOWER = _b.astype(np.uint8)
LOWER[65:91] += 32
#: Bytes of a word once A-Z are lower-cased: digits, letters, every byte of a non-ASCII character.
ALNUM = ((_b >= 48) & (_b <= 57)) | ((_b >= 97) & (_b <= 122)) | (_b >= 128)
#: Bytes of a word between ASCII white space.
SPACED = ~((_b == 32) | ((_b >= 9) & (_b <= 13)))
del _b


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: The base of fingerprints, and the bytes that share one run of powers.
BASE, STRETCH = 0x9E3779B97F4A7C15, 1 << 17


def _powers(base: int) -> np.ndarray:
    out = np.full(STRETCH + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_POWERS, _INVERSE = _powers(BASE), _powers(pow(BASE, -1, 1 << 64))


def keys(n: int) -> np.ndarray:
    """The multipliers of a slice's first n places (n up to STRETCH), as fingerprint() has them."""
    return _POWERS[:n]


@dataclass
class Words:
    """The words of a block of documents, in order."""

    buf: np.ndarray  # lower-cased bytes
    offsets: np.ndarray  # documents' byte offsets, n_docs + 1
    start: np.ndarray  # words' first bytes
    end: np.ndarray  # one past their last bytes
    first: np.ndarray  # index of each document's first word, n_docs + 1
    hash: np.ndarray | None = None  # words' fingerprints

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """Each word's document, by place in the block."""
        return np.repeat(np.arange(self.n_docs), self.counts())

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def text_blocks(column: pa.Array | pa.ChunkedArray, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) for blocks of whole texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not wide and not pa.types.is_string(column.type) and not pa.types.is_binary(column.type):
        column = column.cast(pa.string())
    _, raw, data = column.buffers()
    offsets = np.frombuffer(raw, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, whole[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def find_words(buf: np.ndarray, offsets: np.ndarray, kind: np.ndarray = ALNUM, fingerprints: bool = True) -> Words:
    """The words of texts that stand one after another in buf. A-Z are lower-cased, nothing else."""
    low = LOWER[buf]
    inside = kind[low]
    n = len(low)
    fresh = np.zeros(n + 1, bool)  # a text starts here
    fresh[offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    before[fresh] = False
    start = np.flatnonzero(inside & ~before[:n])
    after = np.zeros(n, bool)
    after[: n - 1] = inside[1:]
    after[fresh[1:]] = False
    end = np.flatnonzero(inside & ~after) + 1
    words = Words(low, offsets, start, end, np.searchsorted(start, offsets))
    if fingerprints:
        words.hash = fingerprint(low, start, end)
    return words


def fingerprint(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each slice low[start:end]. Slices must not be empty, and neither
    starts nor ends may go back. A slice's hash is a difference of running sums, divided by the power
    of its place, so it does not depend on where the slice stands."""
    h = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        base = int(start[i])
        j = int(np.searchsorted(end, base + STRETCH, "right"))
        if j <= i:  # one slice longer than a stretch
            h[i] = _long(low[base : int(end[i])])
            i += 1
            continue
        part = low[base : int(end[j - 1])]
        terms = part.astype(np.uint64)
        terms += np.uint64(1)
        terms *= _POWERS[: len(part)]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(terms, out=sums[1:])
        a, z = start[i:j] - base, end[i:j] - base
        h[i:j] = (sums[z] - sums[a]) * _INVERSE[a]
        i = j
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _long(part: np.ndarray) -> np.uint64:
    total = 0
    for at in range(0, len(part), STRETCH):
        piece = part[at : at + STRETCH].astype(np.uint64) + np.uint64(1)
        total += int((piece * _POWERS[: len(piece)]).sum()) * pow(BASE, at, 1 << 64)
    return np.uint64(total & M64)


def word_hash(word: str | bytes) -> int:
    """The fingerprint of one word, as find_words gives it."""
    raw = LOWER[np.frombuffer(word.encode() if isinstance(word, str) else word, np.uint8)]
    return int(fingerprint(raw, np.array([0]), np.array([len(raw)]))[0])


def lookup(table: np.ndarray, keys_: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted table, -1 where absent."""
    if not len(table):
        return np.full(len(keys_), -1, np.int64)
    at = np.searchsorted(table, keys_)
    at[at == len(table)] = 0
    return np.where(table[at] == keys_, at, -1)


class Index:
    """Places of keys in a sorted table of mixed fingerprints: one look at a bucket of the leading
    bits instead of a binary search. Buckets outnumber keys, so few keys share one."""

    def __init__(self, table: np.ndarray):
        bits = max(8, int(len(table)).bit_length() + 2)
        self.table = np.append(table, np.uint64(0))
        self.shift = np.uint64(64 - bits)
        first = np.searchsorted(table >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64))
        self.first = first[:-1].astype(np.int32)
        self.size = np.diff(first)
        self.crowded = self.size > 1
        self.last = len(table)

    def find(self, keys_: np.ndarray) -> np.ndarray:
        """Places, -1 where absent."""
        bucket = (keys_ >> self.shift).view(np.int64)
        at = self.first[bucket]
        hit = (self.table[at] == keys_) & (at < self.last)
        out = np.where(hit, at, np.int32(-1))
        more = np.flatnonzero(self.crowded[bucket] & ~hit)
        step = 1
        while len(more):
            hit = self.table[at[more] + step] == keys_[more]
            out[more[hit]] = at[more[hit]] + step
            more = more[~hit]
            step += 1
            more = more[self.size[bucket[more]] > step]
        return out


def ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The concatenation of arange(first[i], last[i])."""
    lens = np.maximum(last - first, 0)
    cum = np.cumsum(lens)
    total = int(cum[-1]) if len(cum) else 0
    kind = np.int32 if total < 1 << 31 and (not len(last) or int(last.max()) < 1 << 31) else np.int64
    out = np.repeat((first - cum + lens).astype(kind), lens)
    out += np.arange(total, dtype=kind)
    return out


def seg_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]]; 0 for empty segments. Each segment is summed by itself."""
    out = np.zeros(len(first) - 1, values.dtype if values.dtype != bool else np.int64)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        out[full] = np.add.reduceat(values.astype(out.dtype, copy=False), first[:-1][full])
    return out
