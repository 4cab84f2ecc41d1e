"""LM scoring with a probabilistic suffix tree over words.

States are contexts of any number of words, the root's of none. The root's distribution is the
smoothed unigram of the whole corpus. A longer context is a state of its own only if it occurs LEAST
times and a divergence test tells its next words from those of its longest proper suffix: each next
word seen KEEP times or more weighs by its occurrences less one, and the sum has to pay for all of
these. A state keeps these next words; what the others were seen, and a prior, is the share of its
longest suffix that is a state, down to the root, over the whole vocabulary and one unknown word. A
token is scored in the state of the longest retained suffix of what precedes it; a text's beginning is
a word of contexts.

Contexts grow by passes: of one word, of two, of three to eight, then of up to twice as many each time,
until none can be told apart any more; long ones stand in few texts, and only these are read again. A
context is extended only if it occurs LEAST times and the sum of c log(n / c) over the next words it keeps
could pay for one state: no extension, however long, can gain
more (by the log sum inequality the sums of all extensions by a word are no more than their suffix's).

Counts cover all training documents and the whole vocabulary. (context, next word) pairs are counted
by task, travel packed (a context once, its next words after it) to the part that their fingerprint
names, and are summed there; a context of one word is dealt to several parts by next words, so that the
most frequent one is no single task's. Kept pairs stay distributed tables. Broadcast are the HEAD most
frequent words, states and pairs, and bitmaps of bounded size that only say where a look-up is in
vain (of pairs a sixteenth of HEAD). All other tokens ask by blocks: those with the same next word after the
same longest state once, by packed keys that go to the parts of the counts; the answers come back to the block. Words and contexts are known by 64-bit fingerprints.

Edge cases: null and empty texts are one end token; without training documents every token has
probability 1; null ids belong to the training part; repeated ids are scored row by row; very long texts
are counted and scored whole. Only the id and the text are read, so other columns may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, give_back, trimmed, written
from .labelled import held_out
from .vectext import BASE, SPACED, Words, find_words, lookup, mix, ranges, text_blocks

ALPHA = 0.1
HEAD = 1 << 20
CLASSES = 1024  # the columns of Tree.log_p, a view of the most frequent next words; no limit of the tree
LEAST = 200  # a context's occurrences
KEEP = 4  # a next word's occurrences in it
LAMBDA = 30.0  # occurrences that a parent's distribution is worth
END = 0x454E44454E44454E  # the end's fingerprint, as a word of contexts the beginning's
BITS = 24  # a bitmap's slots
MOST_BITS = 27  # those of the pairs' bitmap, at most
FLUSH = 1 << 19  # pairs that a task counts at once
ROWS = 2048  # texts that a task is given at once
ASKED = 1 << 18  # tokens whose counts a task asks for at once
SPARSE = 5  # after a pass from so many words on, only the texts that still hold longer contexts are kept
SLICES = 8  # parts that a context of one word is dealt to


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


_TABLES: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """The powers of BASE and of its inverse, n or more."""
    if not _TABLES or len(_TABLES[0]) < n:
        size = max(n, 1 << 19)
        _TABLES[:] = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _TABLES.append(np.cumprod(table))
    return _TABLES


class _Windows:
    """Fingerprints of any words in a row, from running sums of powers; a context's is the same wherever it stands."""

    def __init__(self, token: np.ndarray):
        power, self.inverse = _powers(len(token) + 1)
        self.sums = np.zeros(len(token) + 1, np.uint64)
        np.cumsum((token + np.uint64(1)) * power[: len(token)], out=self.sums[1:])

    def before(self, at: np.ndarray, k) -> np.ndarray:
        """The contexts of k words before places."""
        begin = at - k
        return mix((self.sums[at] - self.sums[begin]) * self.inverse[begin] + np.asarray(k).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _one(word: np.ndarray) -> np.ndarray:
    """The context of one word."""
    return mix(word + np.uint64(1) + np.uint64(0xD6E8FEB86659FD93))


def _pair(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The fingerprint of a context and a next word."""
    return mix((context ^ np.uint64(0xA5A5A5A55A5A5A5A)) * np.uint64(0xD6E8FEB86659FD93) + token)


def _own(context: np.ndarray) -> np.ndarray:
    """The key of a state's occurrences, apart from those of words and pairs."""
    return mix(context ^ np.uint64(0x5354415445535441))


def _escape(context: np.ndarray) -> np.ndarray:
    """The key of what a state leaves to its suffix."""
    return mix(context ^ np.uint64(0x4553434150454553))


def _slots(h: np.ndarray, bits: int = BITS) -> np.ndarray:
    return (mix(h) >> np.uint64(64 - bits)).view(np.int64)


def _mapped(df: DataFrame, change, names: tuple[str, ...]) -> DataFrame:
    """Columns of bigint made from columns of bigint."""

    def run(batches):
        for batch in batches:
            out = change(*(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=list(names))

    return df.mapInArrow(trimmed(run), ", ".join(f"{n} bigint" for n in names))


def _bitmap(df: DataFrame, fingerprint=lambda h: h, bits: int = BITS) -> np.ndarray:
    """A bitmap of the fingerprints in df's columns: 2^bits / 8 bytes reach the driver whatever df's size."""

    def slots(batches):
        for batch in batches:
            s = np.unique(_slots(fingerprint(*(c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns)), bits))
            cut = np.flatnonzero(np.concatenate([[True], s[1:] >> 16 != s[:-1] >> 16])) if len(s) else s
            raw = [x.astype(np.uint16).tobytes() for x in np.split(s, cut[1:])] if len(s) else []
            yield pa.RecordBatch.from_arrays([pa.array((s[cut] >> 16).astype(np.int32)), pa.array(raw, pa.binary())], names=["range", "raw"])

    def merge(batches):
        at, found = None, np.zeros(1 << 16, bool)
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(found).tobytes()], pa.binary())], names=["range", "raw"])
        for batch in batches:
            for r, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if r != at:
                    if at is not None:
                        yield pack()
                    at = r
                    found[:] = False
                found[np.frombuffer(raw.as_buffer(), np.uint16)] = True
        if at is not None:
            yield pack()

    ddl = "range int, raw binary"
    parts = df.mapInArrow(slots, ddl).repartition("range").sortWithinPartitions("range").mapInArrow(trimmed(merge), ddl).toArrow()
    out = np.zeros(max(1, 1 << max(bits - 16, 0)) << 13, np.uint8)
    for r, raw in zip(parts["range"].to_pylist(), parts["raw"].to_pylist(), strict=True):
        out[r << 13 : (r + 1) << 13] = np.frombuffer(raw, np.uint8)
    return out


def _held(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = _slots(h, len(bitmap).bit_length() + 2)
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


class _Table:
    """Values by uniform 64-bit keys: a look at the bucket of the leading bits, then along it."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        order = np.argsort(keys)
        bits = max(8, len(keys).bit_length())
        self.keys, self.shift = np.append(keys[order], np.uint64(0)), np.uint64(64 - bits)
        self.values = [np.append(v[order], 0).astype(np.min_scalar_type(int(v.max()))) if len(v) else np.zeros(1, np.uint8) for v in values]
        self.first = np.searchsorted(keys[order] >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places, -1 where absent."""
        bucket = (keys >> self.shift).view(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        out = np.full(len(keys), -1, np.int32)
        todo = np.flatnonzero(at < end)
        while len(todo):
            here = at[todo]
            hit = self.keys[here] == keys[todo]
            out[todo[hit]] = here[hit]
            at[todo] += 1
            todo = todo[~hit & (here + 1 < end[todo])]
        return out

    def get(self, keys: np.ndarray) -> list[np.ndarray]:
        """The values, -1 where absent."""
        at = self.find(keys)
        return [np.where(at >= 0, v[at].astype(np.int64), -1) for v in self.values]


def _most(df: DataFrame, most: int, size: str, *columns: str) -> tuple[list[np.ndarray], bool, DataFrame]:
    """(columns of df's largest rows by size, so many at most; whether these are all; the other rows)."""
    band = F.floor(F.log2(size) * 16)
    total, least, all_ = 0, None, True
    for r in sorted(df.groupBy(band.alias("k")).agg(F.count("*").alias("n")).collect(), reverse=True):
        if total + r["n"] > most:
            all_ = False
            break
        total, least = total + r["n"], r["k"]
    top = band >= least if least is not None else F.lit(False)
    own = df.filter(top).select(*columns).toArrow()
    return [own[c].to_numpy().astype(np.int64) for c in columns], all_, df.filter(~top)


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(h, c): how often each word, by fingerprint, occurs in docs; the end counts once a text."""

    def run(batches):
        for batch in batches:
            parts = [np.full(batch.num_rows, END, np.uint64)]
            for _, _, buf, offsets in text_blocks(batch.column(0)):
                h, c = np.unique(find_words(buf, offsets, SPACED).hash, return_counts=True)
                parts.append(np.repeat(h, c))
            h, c = np.unique(np.concatenate(parts), return_counts=True)
            for lo in range(0, len(h), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(_signed(h[lo : lo + (1 << 18)])), pa.array(c[lo : lo + (1 << 18)].astype(np.int64))], names=["h", "c"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(trimmed(run), "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    table: DataFrame  # (h, c), all words
    rest: DataFrame  # (h, c), those that are not in head
    n: int
    v: int
    head: np.ndarray  # sorted fingerprints
    count: np.ndarray  # theirs

    def log_q(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + ALPHA) / (self.n + ALPHA * (self.v + 1)))


def vocabulary(train: DataFrame) -> Vocabulary:
    words = written(count_words(train), "words", ROWS)
    r = words.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    (h, c), _, rest = _most(words, HEAD, "c", "h", "c")
    h = h.view(np.uint64)
    order = np.argsort(h)
    return Vocabulary(words, rest, r["n"], r["v"], h[order], c[order])


def sequence(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints of a block's tokens, each text's after a beginning and with its end; places of
    the beginnings and one past the last end)."""
    first = words.first + 2 * np.arange(words.n_docs + 1)
    token = np.full(int(first[-1]), END, np.uint64)
    token[np.arange(len(words.start)) + 2 * words.doc() + 1] = words.hash
    return token, first


def _room(first: np.ndarray) -> np.ndarray:
    """How many words, the beginning too, stand before each token in its text."""
    return np.arange(int(first[-1])) - np.repeat(first[:-1], np.diff(first))


def _steps(lo: int) -> list[int]:
    """Lengths to look at before contexts of lo words; what grows at the last of them grew at all lengths."""
    return sorted({k for k in (1, 2, 4, 16, 64, 256, 1024, lo - 2, lo - 1) if 0 < k < lo})


def _packed(k, ctx, up, nxt, c, parts: int, slices: int):
    """(part, bytes) of counted pairs: by part, each context once, then its next words and counts."""
    times = -(-c // 255)  # larger counts take several entries
    if (times > 1).any():
        k, ctx, up, nxt = (np.repeat(x, times) for x in (k, ctx, up, nxt))
        last = np.cumsum(times) - 1
        few = np.full(len(k), 255, np.int64)
        few[last] = c - 255 * (times - 1)
        c = few
    part = ((mix(ctx) >> np.uint64(33)) + (mix(nxt) >> np.uint64(61)) % np.uint64(slices)) % np.uint64(parts)
    by = np.argsort(ctx)
    by = by[np.argsort(part[by].astype(np.uint16 if parts <= 1 << 16 else np.uint32), kind="stable")]
    k, ctx, up, nxt, c, part = k[by], ctx[by], up[by], nxt[by], c[by].astype(np.uint8), part[by]
    run = np.flatnonzero(np.concatenate([[True], (ctx[1:] != ctx[:-1]) | (part[1:] != part[:-1])]))
    size = np.diff(np.append(run, len(ctx))).astype(np.uint32)
    cut = np.flatnonzero(np.concatenate([[True], part[run][1:] != part[run][:-1]]))
    for i, j in zip(cut.tolist(), np.append(cut[1:], len(run)).tolist(), strict=True):
        own, rows = run[i:j], slice(run[i], run[j] if j < len(run) else len(ctx))
        head = np.array([j - i, rows.stop - rows.start], np.int64)
        yield int(part[run[i]]), b"".join(x.tobytes() for x in (head, ctx[own], up[own], nxt[rows], size[i:j], k[own], c[rows]))


def _unpacked(raw: bytes) -> tuple[np.ndarray, ...]:
    n, m = np.frombuffer(raw, np.int64, 2).tolist()
    at, out = 16, []
    for kind, length in ((np.uint64, n), (np.uint64, n), (np.uint64, m), (np.uint32, n), (np.uint32, n), (np.uint8, m)):
        out.append(np.frombuffer(raw, kind, length, at))
        at += out[-1].nbytes
    ctx, up, nxt, size, k, c = out
    return np.repeat(k, size), np.repeat(ctx, size), np.repeat(up, size), nxt, c.astype(np.int64)


def _grouped(held: list[tuple]) -> tuple[np.ndarray, ...]:
    """Each pair once, with its sum; empties held, so that no column is in memory twice for long."""
    columns = [list(x) for x in zip(*held, strict=True)]
    held.clear()
    k, ctx, up, nxt, c = (np.concatenate(columns.pop(0)) for _ in range(5))
    h = _pair(ctx, nxt)
    by = np.argsort(h)
    h = h[by]
    run = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    at = by[run]
    return k[at], ctx[at], up[at], nxt[at], np.add.reduceat(c[by], run)


def _whole_texts(token: np.ndarray, first: np.ndarray, at: np.ndarray):
    """(tokens, words before, places) of the texts that hold any of the places."""
    doc = np.searchsorted(first, at, "right") - 1
    some = np.unique(doc)
    room, lens = at - first[doc], np.diff(first)[some]
    begin = np.cumsum(lens) - lens
    return token[ranges(first[some], first[some + 1])], room, begin[np.searchsorted(some, doc)] + room


def _levels(texts: list[tuple], lo: int, hi: int):
    """(length, contexts, shorter ones, next words, counts) for contexts of lo to hi words. Places with the
    same words before them, up to hi, and the same next word are counted once, with their number."""
    if not texts:
        return
    begin = np.cumsum([0, *(len(t[0]) for t in texts)])
    token, room = (np.concatenate([t[i] for t in texts]) for i in (0, 1))
    at = np.concatenate([t[2] + b for t, b in zip(texts, begin, strict=False)])
    count, words = np.ones(len(at), np.int64), _Windows(token)
    if hi > lo:
        _, one, count = np.unique(_pair(words.before(at, np.minimum(room, hi)), token[at]), return_index=True, return_counts=True)
        at, room = at[one], room[one]
    up = words.before(at, lo - 1) if lo > 1 else np.zeros(len(at), np.uint64)
    for k in range(lo, hi + 1):
        ctx = words.before(at, k)
        yield k, ctx, up, token[at], count
        some = room > k
        at, room, count, up = at[some], room[some], count[some], ctx[some]
        if not len(at):
            break


def _places(token: np.ndarray, first: np.ndarray, lo: int, known: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The places whose contexts of lo words may be frequent, as _count() has it."""
    room, words = _room(first), _Windows(token)
    at = np.flatnonzero(room >= 1)
    counted = np.zeros(len(token), bool)  # whose contexts of lo - 1 words were counted
    for k in _steps(lo):
        at = at[room[at] >= k]
        counted[at] = k == lo - 1
        at = at[_held(known, words.before(at, k))]
    at = at[room[at] >= lo]
    if lo == 1:
        return at[_held(bits, words.before(at, 1))]
    told = np.flatnonzero(counted[at - 1])
    last = at[told] - 1
    return np.delete(at, told[~_held(bits, _pair(words.before(last, lo - 1), token[last]))])


def _holding(train: DataFrame, lo: int, known: np.ndarray, bits: np.ndarray) -> DataFrame:
    """The texts of train that a count of contexts of lo words and more has to read."""
    shared = train.sparkSession.sparkContext.broadcast((known, bits))

    def run(batches):
        known, bits = shared.value
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for begin, _, buf, offsets in text_blocks(batch.column(0)):
                token, first = sequence(find_words(buf, offsets, SPACED))
                at = _places(token, first, lo, known, bits)
                keep[begin + np.searchsorted(first, at, "right") - 1] = True
            if keep.any():
                yield batch.filter(pa.array(keep))

    return train.select("text").mapInArrow(trimmed(run), "text string")


def _count(train: DataFrame, lo: int, hi: int, known: np.ndarray, bits: np.ndarray, least: int, keep: int) -> DataFrame:
    """Of the contexts of lo to hi words: (k, ctx, up, next, c) for each next word seen keep times, and
    without a next word (k, ctx, up, n, own, m, kept): occurrences, then sum of c log c, number and
    occurrences of the next words kept; a context of one word has several of these to be summed. Shorter
    contexts grow only if known holds them. bits holds what may be a frequent context of lo words: words, or
    pairs of a shorter context and its next word; only these, and those of untold pairs, count and grow."""
    spark = train.sparkSession
    shared = spark.sparkContext.broadcast((known, bits))
    parts, slices = 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), SLICES if lo == 1 else 1

    def run(batches):
        known, bits = shared.value
        held, size, kept, waiting = [], 0, 0, []

        def grow():
            """Counts the contexts of lo to hi words of the texts that wait."""
            nonlocal held, size, kept
            for k, ctx, up, nxt, c in _levels(waiting, lo, hi):
                held.append((np.full(len(ctx), k, np.uint32), ctx, up, nxt, c))
                size += len(ctx)
                if size >= kept + FLUSH:
                    held.append(_grouped(held))
                    size = kept = len(held[0][0])
                    if kept >= FLUSH:
                        yield from sent(held.pop())
                        size, kept = 0, 0
            waiting.clear()
            give_back()

        def sent(rows):
            packed = _packed(*rows, parts, slices)
            del rows
            while found := list(islice(packed, 64)):
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([r for _, r in found], pa.binary())], names=["part", "raw"])

        for batch in batches:
            for _, _, buf, offsets in text_blocks(batch.column(0)):
                token, first = sequence(find_words(buf, offsets, SPACED))
                at = _places(token, first, lo, known, bits)
                if len(at):
                    waiting.append(_whole_texts(token, first, at))
                if sum(len(w[0]) for w in waiting) >= FLUSH // 2:
                    yield from grow()
        yield from grow()
        if size:
            yield from sent(_grouped(held))

    names = ["k", "ctx", "up", "next", "c", "n", "own", "m", "kept"]

    def close(held):
        k, ctx, up, nxt, c = _grouped(held)
        by = np.argsort(ctx)
        k, ctx, up, nxt, c = k[by], ctx[by], up[by], nxt[by], c[by]
        run = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
        again = c >= keep
        n, own, m, kept = (np.add.reduceat(x, run) for x in (c, again * c * np.log(c), again.astype(np.int64), c * again))
        if slices == 1:  # all of a context is here
            often = n >= least
            again &= np.repeat(often, np.diff(np.append(run, len(c))))
            run, n, own, m, kept = run[often], n[often], own[often], m[often], kept[often]
        none = [pa.nulls(len(run), pa.int64()), pa.nulls(len(run), pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(k[run].astype(np.int32)), pa.array(_signed(ctx[run])), pa.array(_signed(up[run])), *none, *(pa.array(x) for x in (n, own, m, kept))], names=names)
        for i in range(0, int(again.sum()), 1 << 16):
            some = np.flatnonzero(again)[i : i + (1 << 16)]
            none = [pa.nulls(len(some), t) for t in (pa.int64(), pa.float64(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(k[some].astype(np.int32)), *(pa.array(_signed(x[some])) for x in (ctx, up, nxt)), pa.array(c[some]), *none], names=names)

    def merge(batches):
        at, held, size, kept = None, [], 0, 0
        for batch in batches:
            for p, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if p != at and held:
                    yield from close(held)
                    held, size, kept = [], 0, 0
                at = p
                held.append(_unpacked(raw.as_py()))
                size += len(held[-1][0])
                if size >= kept + FLUSH:
                    held.append(_grouped(held))
                    size = kept = len(held[0][0])
        if held:
            yield from close(held)

    packed = train.select("text").mapInArrow(trimmed(run), "part int, raw binary")
    dealt = packed.repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(trimmed(merge), "k int, ctx bigint, up bigint, next bigint, c bigint, n bigint, own double, m bigint, kept bigint")


@dataclass
class Counts:
    train: DataFrame


def count_contexts(train: DataFrame, vocab: Vocabulary, text: str = "text") -> Counts:
    """The documents whose contexts grow() counts, pass by pass."""
    return Counts(train.select(F.col(text).cast("string").alias("text")))


@dataclass
class Tree:
    """Retained states but the root, and the counts of what follows them, as tables."""

    vocab: Vocabulary
    states: DataFrame  # (ctx, up, k, n, rest): rest is what their suffixes share
    pairs: DataFrame  # (ctx, next, c)
    known: np.ndarray  # a bitmap of the contexts that may be suffixes of states
    levels: list[int]  # how many words states have
    prior: float
    keep: int = KEEP  # what pairs occur, at least

    @property
    def two(self) -> np.ndarray:
        """The numbers in log_p of the states of two words and more."""
        return np.flatnonzero([0, *(r["k"] > 1 for r in self._listed())])

    def _listed(self):
        return self.states.orderBy("k", "ctx").collect()

    @property
    def log_p(self) -> np.ndarray:
        """A view of a small tree, for looking at it: by state, the root first, and by next word, the
        CLASSES most frequent; the last column is the rest's share of the root's."""
        v = self.vocab
        top = np.lexsort((v.head, -v.count))[:CLASSES]
        column = {int(h): i for i, h in enumerate(_signed(v.head[top]))}
        rows = [np.zeros(CLASSES + 1)]
        rows[0][: len(top)] = 10 ** v.log_q(v.count[top])
        rows[0][CLASSES] = 1 - rows[0][:CLASSES].sum()
        number, counts = {}, {}
        for r in self.pairs.collect():
            counts.setdefault(r["ctx"], []).append((column.get(r["next"], CLASSES), r["c"]))
        for r in self._listed():
            c = np.zeros(CLASSES + 1)
            for i, m in counts.get(r["ctx"], ()):
                c[i] += m
            number[r["ctx"]] = len(rows)
            rows.append((c + (self.prior + r["rest"]) * rows[number.get(r["up"], 0)]) / (r["n"] + self.prior))
        p = np.array(rows)
        p[:, CLASSES] /= p[0, CLASSES]
        return np.log10(np.maximum(p, 1e-300))


def grow(vocab: Vocabulary, counts: Counts, least: int | None = None, prior: float = LAMBDA) -> Tree:
    train = counts.train
    least = LEAST if least is None else least
    keep = min(KEEP, least)
    known = np.zeros((1 << BITS) // 8, np.uint8)
    total = F.lit(float(max(vocab.n, 1)))
    # A kept next word occurs keep times; others meet nothing.
    below = vocab.table.filter(F.col("c") >= keep).select(F.lit(0).cast("bigint").alias("up"), F.col("h").alias("next"), F.col("c").alias("c_up"), total.alias("n_up"))
    bits = _bitmap(vocab.table.filter(F.col("c") >= least).select("h"), _one)
    lo, hi, found, old = 1, 1, [], []  # old: tables of this pass, dropped after it
    while True:
        counted = written(_count(train, lo, hi, known, bits, least, keep), "pairs", ROWS)
        pairs = counted.filter("next IS NOT NULL").select("k", "ctx", "up", "next", "c")
        sums = counted.filter("next IS NULL").groupBy("ctx").agg(F.max("k").alias("k"), F.max("up").alias("up"), *[F.sum(x).alias(x) for x in ("n", "own", "m", "kept")])
        sums = written(sums.filter(F.col("n") >= least), "contexts")
        old += [counted, sums]
        # The next words of a context against those of the next shorter one, in this pass or the one before.
        seen = pairs.join(sums.select("ctx", "n"), "ctx").select("ctx", "up", "next", "c", "n", "k")
        if hi > lo:
            here = seen.filter(F.col("k") < hi).select(F.col("ctx").alias("up"), "next", F.col("c").alias("c_up"), F.col("n").cast("double").alias("n_up"))
            below = below.unionByName(here)
        gain = (F.col("c") - 1) * F.log(F.col("c") / F.col("n") * F.col("n_up") / F.col("c_up"))
        gains = seen.join(below, ["up", "next"]).groupBy("ctx").agg(F.sum(gain).alias("gain"))
        pays = F.col("gain") >= 0.25 * F.greatest("m", F.lit(1)) * F.log("n")
        states = written(sums.join(gains.filter("gain > 0"), "ctx").filter(pays).select("ctx", "up", "k", "n", (F.col("n") - F.col("kept")).alias("rest")), "states")
        grows = sums.filter(F.col("kept") * F.log("n") - F.col("own") >= 0.25 * np.log(least))
        found.append((states, written(pairs.join(states.select("ctx"), "ctx", "left_semi").select("ctx", "next", "c"), "followers")))
        known |= _bitmap(grows.select("ctx"))
        last = grows.filter(F.col("k") == hi).select("ctx", "n")
        if not last.limit(1).count():
            break
        # A next word that an extension keeps, its suffix keeps.
        last = pairs.join(last, "ctx")
        below = written(last.select(F.col("ctx").alias("up"), "next", F.col("c").alias("c_up"), F.col("n").cast("double").alias("n_up")), "suffixes")
        # A context that occurs often begins with one that has its last word as often.
        bits = _bitmap(pairs.filter((F.col("c") >= least) & (F.col("k") == hi)).select("ctx", "next"), _pair)
        later = [below]
        lo, hi = hi + 1, hi * (4 if hi == 2 else 2)
        if lo > SPARSE:
            train = written(_holding(train, lo, known, bits), "texts", ROWS)
            later.append(train)
        for table in old:
            drop_written(table)
        old = later
    for table in old:
        drop_written(table)
    states, followers = (reduce(DataFrame.unionByName, (f[i] for f in found)) for i in range(2))
    levels = sorted(r["k"] for r in states.select("k").distinct().collect())
    return Tree(vocab, states, followers, known, levels, prior, keep)


def score(docs: DataFrame, vocab: Vocabulary, tree: Tree, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for every row of docs."""
    spark = docs.sparkSession
    id_type = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("place"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not vocab.n:
        tokens = _scored(rows, id_type, None, 0.0, tree, parts)
        zero = F.lit(0.0)
        return tokens.select("doc_id", "n_tokens", F.lit(0).cast("bigint").alias("n_known"), zero.alias("base_score"), zero.alias("score"))
    all_n = vocab.n + ALPHA * (vocab.v + 1)
    pairs = _mapped(tree.pairs, lambda ctx, nxt, c: (_signed(_pair(ctx.view(np.uint64), nxt.view(np.uint64))), c), ("key", "val"))
    pairs = written(pairs, "keyed-pairs")
    (ctx, n, rest), all_states, more_states = _most(tree.states, HEAD, "n", "ctx", "n", "rest")
    (key, val), all_pairs, more_pairs = _most(pairs, HEAD >> 4, "val", "key", "val")
    # Where the head holds every word that can be a kept next word, another word's pairs need not be asked.
    every_next = len(vocab.head) == vocab.v or vocab.rest.agg(F.max("c")).first()[0] < tree.keep
    states = _Table(ctx.view(np.uint64), n, rest)
    may_pair = _bitmap(pairs.select("key"), bits=min(MOST_BITS, max(16, (16 * pairs.count()).bit_length())))
    words = _Table(vocab.head, vocab.count)
    shared = spark.sparkContext.broadcast((words, len(vocab.head) == vocab.v, states, all_states, _Table(key.view(np.uint64), val), all_pairs, tree.known, _bitmap(tree.states.select("ctx")), may_pair, every_next))
    rows = written(_scored(rows, id_type, shared, all_n, tree, parts), "scored", ROWS)
    more = [more_pairs, *(_mapped(more_states.select("ctx", x), lambda ctx, n, own=own: (_signed(own(ctx.view(np.uint64))), n), ("key", "val")) for own, x in ((_own, "n"), (_escape, "rest")))]
    more.append(vocab.rest.select(F.col("h").alias("key"), F.col("c").alias("val")))
    held = reduce(DataFrame.unionByName, more).mapInArrow(trimmed(_dealt(parts)), PACKED)
    asked = rows.filter("part >= 0").select("block", "part", "raw")
    answers = written(asked.unionByName(held).repartition("part").sortWithinPartitions("part", "block").mapInArrow(trimmed(_answered), PACKED), "answers")
    left = rows.filter("part = -1").select("block", "part", "raw")
    sums = "place bigint, k bigint, b double, m double"
    sums = answers.unionByName(left).repartition("block").sortWithinPartitions("block", "part").mapInArrow(trimmed(_summed(all_n, tree.prior)), sums)
    m, b, k = (F.coalesce(x, F.lit(0)) for x in ("m", "b", "k"))
    own = rows.filter("part IS NULL").drop("block", "part", "raw")
    return own.join(sums, "place", "left").select("doc_id", "n_tokens", (F.col("known") + k).alias("n_known"), (F.col("base") + b).alias("base_score"), (F.col("model") + m).alias("score"))


def _dealt(parts: int):
    """(block -1, part, bytes) of (key, val): a part's keys, then their values."""

    def run(batches):
        for batch in batches:
            key, val = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            part = _part(key.view(np.uint64), parts)
            by = np.argsort(part, kind="stable")
            key, val, part = key[by], val[by], part[by]
            cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else part
            raw = [key[i:j].tobytes() + val[i:j].tobytes() for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(part)], strict=False)]
            yield _packed_rows(np.full(len(cut), -1), part[cut], raw)

    return run


def _answered(batches):
    """For each block's keys of a part their values and one, 0 where absent; the part's table comes first."""
    at, held, keys, vals = None, [], None, None
    for batch in batches:
        blocks, parts, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
        for block, part, raw in zip(blocks, parts, batch.column(2), strict=True):
            if part != at:
                at, held, keys = part, [], None
            if block < 0:
                held.append(np.frombuffer(raw.as_buffer(), np.int64).reshape(2, -1).copy())
                continue
            if keys is None:
                keys, vals = np.concatenate([np.zeros((2, 0), np.int64), *held], axis=1)
                by = np.argsort(keys.view(np.uint64))
                keys, vals, held = keys.view(np.uint64)[by], vals[by], []
            found = lookup(keys, np.frombuffer(raw.as_buffer(), np.uint64))
            got = np.where(found >= 0, vals[found] + 1, 0) if len(vals) else np.zeros(len(found), np.int64)
            got = got.astype(np.min_scalar_type(int(got.max())))
            out.append((block, part, bytes([got.itemsize]) + got.tobytes()))
        if out:
            yield _packed_rows(*zip(*out, strict=True))


def _summed(all_n: float, prior: float):
    """(place, k, b, m) of each text of a block that asked: what the tokens that did add to its sums."""

    def close(left, got):
        place, asks, number, word, state, size, at, m, up, k, n, rest = _unzipped(left)
        told = np.concatenate([np.frombuffer(g, f"u{g[0]}", offset=1).astype(np.int64) - 1 for g in got])
        c, m, n, rest = (np.where(x >= 0, x, told[np.maximum(-1 - x, 0)]) for x in (word, m, n, rest))
        # The last state is the root. What of the root's share is left in a state; one that proved to be none leaves all.
        keeps, share = np.where(n >= 0, (prior + np.maximum(rest, 0)) / (np.maximum(n, 0) + prior), 1.0), np.ones(len(n))
        for level in np.unique(k[k > 0]):
            here = np.flatnonzero(k == level)
            share[here] = keeps[here] * share[up[here]]
        base = (np.maximum(c, 0) + ALPHA) / all_n
        p = share[state] * base
        of = np.repeat(np.arange(len(size)), size)
        p += np.bincount(of, np.where(n[at] >= 0, np.maximum(m, 0) / (np.maximum(n[at], 0) + prior), 0.0) * share[state[of]] / share[at], len(size))
        unsure = word < 0  # whose count was asked, and is in no sum yet
        first = np.cumsum(asks) - asks
        sums = [np.add.reduceat(x[number], first) for x in ((unsure & (c > 0)).astype(np.int64), np.where(unsure, np.log10(base), 0.0), np.log10(np.maximum(p, 1e-300)))]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (place, *sums)], names=["place", "k", "b", "m"])

    def run(batches):
        at, left, got = None, None, []
        for batch in batches:
            for block, part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if block != at:
                    if at is not None:
                        yield close(left, got)
                    at, got = block, []
                if part < 0:
                    left = raw.as_py()
                else:
                    got.append(raw.as_py())
        if at is not None:
            yield close(left, got)

    return run


PACKED = "block bigint, part int, raw binary"


def _packed_rows(blocks, parts, raw) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(parts, pa.int32()), pa.array(raw, pa.binary())], names=["block", "part", "raw"])


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)


def _zipped(*arrays: np.ndarray) -> bytes:
    """Arrays of integers, as one compressed string: the same bytes of all numbers stand together."""
    raw = b"".join(np.array([x.itemsize, len(x)], np.int64).tobytes() + np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() for x in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unzipped(raw: bytes) -> list[np.ndarray]:
    raw = pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True)
    at, out = 0, []
    while at < len(raw):
        width, n = np.frombuffer(raw, np.int64, 2, at).tolist()
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, width * n, at + 16).reshape(width, n).T).reshape(-1).view(f"i{width}"))
        at += 16 + width * n
    return out


class _Asking:
    """The tokens of some texts that lack counts. Those with the same next word after the same longest
    state are one situation: it is kept once and asks once, the tokens are its numbers."""

    def __init__(self):
        self.size, self.texts, self.kinds, self.pairs, self.states, self.n = 0, [], [], [], [], 0

    def add(self, place, first, tok, token, c, deep, walked) -> None:
        """tok: the tokens that ask; deep: each token's longest state; walked: (words, tokens, states, the next
        shorter states, n, rest, pairs' keys, m) by length. n, rest, m and c are -1 where they are to be asked."""
        kind, one, number = np.unique(_pair(deep[tok], token[tok]), return_index=True, return_inverse=True)
        asks = np.diff(np.searchsorted(tok, first))
        some = asks > 0
        self.texts.append((place[some], asks[some], number.reshape(-1) + self.n))
        one = tok[one]
        mark = np.full(len(token), -1, np.int64)
        mark[one] = np.arange(len(one)) + self.n
        self.kinds.append((kind, token[one], c[one], deep[one]))
        for k, at, ctx, up, n, rest, key, m in walked:
            here = np.flatnonzero(mark[at] >= 0)
            _, i = np.unique(ctx[here], return_index=True)
            i = here[i]
            self.states.append((ctx[i], up[i], np.full(len(i), k), n[i], rest[i]))
            here = here[m[here] != 0]
            self.pairs.append((mark[at[here]], ctx[here], key[here], m[here]))
        self.n += len(kind)
        self.size += len(tok)

    def sent(self, block: int, parts: int):
        """Rows (block, part, bytes): the keys to ask for, by part, and with part -1 what waits for them."""
        place, asks, number = (np.concatenate(x) for x in zip(*self.texts, strict=True))
        kind, word, c, deep = (np.concatenate(x) for x in zip(*self.kinds, strict=True))
        none = [np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64)]
        of, at, key, m = (np.concatenate([e, *x]) for e, x in zip(none, zip(*self.pairs, strict=True) if self.pairs else [[]] * 4, strict=True))
        none = [np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64)]
        ctx, up, k, n, rest = (np.concatenate([e, *x]) for e, x in zip(none, zip(*self.states, strict=True) if self.states else [[]] * 5, strict=True))
        self.__init__()
        # Situations of several blocks once, the most frequent first.
        _, one, same = np.unique(kind, return_index=True, return_inverse=True)
        same = same.reshape(-1)
        order = np.argsort(-np.bincount(same[number], minlength=len(one)), kind="stable")
        rank = np.empty(len(one), np.int64)
        rank[order] = np.arange(len(one))
        kept = np.zeros(len(kind), bool)
        kept[one] = True
        number = rank[same[number]]
        word, c, deep = (x[one[order]] for x in (word, c, deep))
        here = kept[of]
        of, at, key, m = rank[same[of[here]]], at[here], key[here], m[here]
        by = np.argsort(of, kind="stable")
        of, at, key, m = of[by], at[by], key[by], m[by]
        ctx, i = np.unique(ctx, return_index=True)
        up, k, n, rest = up[i], k[i], n[i], rest[i]
        state, at, up = (np.where(i >= 0, i, len(ctx)) for i in (lookup(ctx, x) for x in (deep, at, up)))
        # Known numbers stay, others become the places of their keys, from -1 down.
        asked, fields = [], [c, m, n, rest]
        for x, keys in zip(fields, (word, key, _own(ctx), _escape(ctx)), strict=True):
            asked.append(keys[x < 0])
        keys, i = np.unique(np.concatenate(asked), return_inverse=True)
        part = _part(keys, parts)
        by = np.argsort(part, kind="stable")
        found = np.empty(len(keys), np.int64)
        found[by] = np.arange(len(keys))
        found = -1 - found[i.reshape(-1)]
        for x in fields:
            todo = np.flatnonzero(x < 0)
            x[todo], found = found[: len(todo)], found[len(todo) :]
        n, rest, k, up = (np.append(x, e) for x, e in ((n, 0), (rest, 0), (k, 0), (up, len(ctx))))
        small = lambda x: x.astype(np.int32)
        left = _zipped(place, asks, small(number), c, small(state), small(np.bincount(of, minlength=len(one))), small(at), m, small(up), small(k), n, rest)
        keys, part = keys[by], part[by]
        cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        raw = [keys[i:j].tobytes() for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(keys)], strict=True)]
        return _packed_rows(np.full(len(raw) + 1, block), np.append(part[cut], -1), [*raw, left])


def _scored(rows: DataFrame, id_type: str, shared, all_n: float, tree: Tree, parts: int) -> DataFrame:
    """Of (place, doc_id, text): (place, doc_id, n_tokens, known, base, model), the sums over the tokens that
    broadcast tables tell all of; and rows (block, part, raw) of the other tokens, as _Asking has them."""
    prior, levels, keep = tree.prior, tree.levels, tree.keep
    names = ["place", "doc_id", "n_tokens", "known", "base", "model", "block", "part", "raw"]

    def filled(batch: pa.RecordBatch, types: list) -> pa.RecordBatch:
        own = dict(zip(batch.schema.names, batch.columns, strict=True))
        return pa.RecordBatch.from_arrays([own.get(x, None) if x in own else pa.nulls(batch.num_rows, t) for x, t in zip(names, types, strict=True)], names=names)

    def run(batches):
        words, all_words, states, all_states, pairs, all_pairs, known, retained, may_pair, every_next = shared.value if shared else (None,) * 10
        asking, block, types = _Asking(), TaskContext.get().partitionId() << 32, None
        for batch in batches:
            types = [pa.int64(), batch.column(1).type, pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int32(), pa.binary()]
            for lo, hi, buf, offsets in text_blocks(batch.column(2)):
                token, first = sequence(find_words(buf, offsets, SPACED))
                room = _room(first)
                begins = room == 0
                (c,) = words.get(token) if shared else (np.zeros(len(token), np.int64),)
                if not shared or all_words:
                    c[c < 0] = 0
                # A token's probability is plus + share * its word's.
                plus, share, asks, deep = np.zeros(len(token)), np.ones(len(token)), c < 0, np.zeros(len(token), np.uint64)
                # A kept next word occurs keep times, and is kept in all suffixes of the state.
                alive = (c >= keep) | ((c < 0) & (not every_next))
                walked = []
                at, windows = np.flatnonzero(room >= 1), _Windows(token)
                for k in levels if shared else ():
                    at = at[room[at] >= k]
                    if not len(at):
                        break
                    here, every = windows.before(at, k), at
                    some = _held(retained, here)
                    at, ctx = at[some], here[some]
                    n, rest = states.get(ctx)
                    if all_states:
                        at, ctx, n, rest = at[n >= 0], ctx[n >= 0], n[n >= 0], rest[n >= 0]
                    key = _pair(ctx, token[at])
                    m = np.zeros(len(at), np.int64)
                    may = np.flatnonzero(alive[at])
                    may = may[_held(may_pair, key[may])]
                    (m[may],) = pairs.get(key[may])
                    if all_pairs:
                        m = np.maximum(m, 0)
                    alive[at[(n >= 0) & (m == 0)]] = False
                    asks[at[(n < 0) | (m < 0)]] = True
                    walked.append((k, at, ctx, deep[at], n, rest, key, m))
                    deep[at] = ctx
                    keeps = (prior + np.maximum(rest, 0)) / (np.maximum(n, 0) + prior)
                    plus[at] = np.maximum(m, 0) / (np.maximum(n, 0) + prior) + keeps * plus[at]
                    share[at] *= keeps
                    at = every[_held(known, here)]
                asks[begins] = False
                q = (np.maximum(c, 0) + ALPHA) / all_n if shared else np.ones(len(token))
                told = (c >= 0) & ~begins  # a word's count enters at once

                def sums(x, first=first):
                    return pa.array(np.add.reduceat(x, first[:-1]))

                model = np.where(asks | begins, 0.0, np.log10(np.maximum(plus + share * q, 1e-300)))
                place = batch.column(0).slice(lo, hi - lo)
                own = [place, batch.column(1).slice(lo, hi - lo), pa.array(np.diff(first) - 1)]
                columns = [*own, sums((told & (c > 0)).astype(np.int64)), sums(np.where(told, np.log10(q), 0.0)), sums(model)]
                yield filled(pa.RecordBatch.from_arrays(columns, names=names[:6]), types)
                tok = np.flatnonzero(asks)
                if len(tok):
                    asking.add(place.to_numpy(), first, tok, token, c, deep, walked)
                if asking.size >= ASKED:
                    yield filled(asking.sent(block, parts), types)
                    block += 1
                    give_back()
        if asking.size:
            yield filled(asking.sent(block, parts), types)

    return rows.mapInArrow(trimmed(run), f"place bigint, doc_id {id_type}, n_tokens bigint, known bigint, base double, model double, block bigint, part int, raw binary")


def evaluate(docs: DataFrame, mod: int = 10, remainder: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): learned from the documents not held out."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    train = rows.filter(~held_out(mod, remainder))
    vocab = vocabulary(train)
    tree = grow(vocab, count_contexts(train, vocab))
    out = score(rows, vocab, tree)
    return out.select("doc_id", held_out(mod, remainder).alias("held_out"), "n_tokens", "n_known", F.lit(vocab.n).cast("bigint").alias("train_tokens"), "base_score", "score")
