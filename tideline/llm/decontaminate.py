"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words make one automaton per block of at most ``BLOCK_WORDS`` item words; documents
stream through it and keep the length of the longest match that ends at each word. A match as long
as a window marks the window's words; an item shorter than a window is one window of its own.
A table of the automaton's word pairs lets a task jump to stretches of text that could hold a
window, so the walk itself touches few words.

Memory of a task: the automaton (bounded by BLOCK_WORDS) and one block of documents. More items
than one block are handled by further automata, one after another over the same documents, so no
broadcast grows beyond the bound and no item is left out.

Edge cases: null or word-less texts have no words and no hits; items without words are ignored;
repeated items count once; ids keep their own type; other columns pass through untouched by name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import through, trimmed
from .vectext import ALNUM, find_words, lookup, text_blocks

WINDOW = 10
BLOCK_WORDS = 200_000
PAIR_BITS = 20


class SuffixAutomaton:
    """Of several word sequences; states know which items hold the window that ends in them."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int = WINDOW):
        self.window = window
        self.vocab = np.unique(np.concatenate([w for _, w in items])) if items else np.zeros(0, np.uint64)
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        coded = [(name, lookup(self.vocab, w).tolist()) for name, w in items]
        for _, word_ids in coded:
            last = 0
            for c in word_ids:
                last = self._extend(last, c)
        self.least = min((min(window, len(ids)) for _, ids in coded), default=0)
        self.pairs = np.zeros(1 << PAIR_BITS, bool)
        self.held: dict[int, set[str]] = {}  # by the state of a whole window
        self.short: dict[int, list[tuple[int, str]]] = {}  # by the state of a whole short item
        for name, ids in coded:
            a = np.array(ids, np.int64)
            self.pairs[self._pair(a[:-1], a[1:])] = True
            state = 0
            for k, c in enumerate(ids):
                state = self.next[state][c]
                if k + 1 >= window:
                    self.held.setdefault(self.window_state(state), set()).add(name)
            if 0 < len(ids) < window:
                self.short.setdefault(state, []).append((len(ids), name))
        self.has_short = bool(self.short)

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * 0x9E3779B1 + b * 0x85EBCA77) >> 7) & ((1 << PAIR_BITS) - 1)

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.len.append(length)
        return len(self.len) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of p's longest string followed by c; a copy of the target if that holds longer ones."""
        q = self.next[p][c]
        if self.len[q] == self.len[p] + 1:
            return q
        copy = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        fresh = self._state(self.len[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = fresh
            p = self.link[p]
        if p >= 0:
            self.link[fresh] = self._split(p, c)
        return fresh

    def window_state(self, state: int) -> int:
        """The state that holds the last ``window`` words of a match that long."""
        while self.len[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def stretches(self, ids: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
        """Word ranges, each inside one document, outside of which no window can be."""
        if not self.least or not len(ids):
            return []
        known = ids >= 0
        if self.least == 1:
            cut = np.zeros(len(ids) + 1, bool)
            cut[first] = True
            begin = np.flatnonzero(known & (np.concatenate([[True], ~known[:-1]]) | cut[:-1]))
            stop = np.flatnonzero(known & (np.concatenate([~known[1:], [True]]) | cut[1:])) + 1
            return list(zip(begin.tolist(), stop.tolist(), strict=True))
        good = known[:-1] & known[1:]
        at = np.flatnonzero(good)
        good[at] = self.pairs[self._pair(ids[at], ids[at + 1])]
        inner = first[1:-1]
        good[inner[(inner > 0) & (inner < len(ids))] - 1] = False
        edge = np.diff(np.concatenate([[0], good.astype(np.int8), [0]]))
        begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        keep = stop - begin >= self.least - 1
        return list(zip(begin[keep].tolist(), (stop[keep] + 1).tolist(), strict=True))

    def hits(self, ids: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, str | None, int]]:
        """(first word, last word + 1, item, state) of windows; state -1 for a short item's."""
        nxt, link, length, window = self.next, self.link, self.len, self.window
        for lo, hi in self.stretches(ids, first):
            state = n = 0
            for k, c in enumerate(ids[lo:hi].tolist(), lo):
                while state and c not in nxt[state]:
                    state = link[state]
                    n = length[state]
                if c in nxt[state]:
                    state = nxt[state][c]
                    n += 1
                if n >= window:
                    yield k + 1 - window, k + 1, None, self.window_state(state)
                if self.has_short:
                    up = state
                    while up > 0:
                        for size, name in self.short.get(up, ()):
                            if size <= n:
                                yield k + 1 - size, k + 1, name, -1
                        up = link[up]


def _digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def load_items(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[list[tuple[str, np.ndarray]]]:
    """Blocks of at most BLOCK_WORDS item words (or one longer item), streamed to the driver."""
    block, size = [], 0
    rows = benchmark.select(F.col(item_id).cast("string"), F.col(text).cast("string")).toLocalIterator()
    for name, words in ((r[0], r[1]) for r in rows):
        raw = np.frombuffer((words or "").encode(), np.uint8)
        found = find_words(raw, np.array([0, len(raw)])).hash
        if name is None or not len(found):
            continue
        if block and size + len(found) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((name, found))
        size += len(found)
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, items array<string>, spans array<struct<begin, end>>): spans are byte
    ranges of the UTF-8 text, in order, without overlap."""
    sc = docs.sparkSession.sparkContext
    automata = [sc.broadcast(SuffixAutomaton(block, window)) for block in load_items(benchmark, text=text)]
    id_type = docs.schema[doc_id].dataType.simpleString()
    spans = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, buf, offsets in text_blocks(batch.column(1)):
                words = find_words(buf, offsets, ALNUM)
                marks = np.zeros(len(words.start) + 1, np.int32)
                items: dict[int, set[str]] = {}
                for shared in automata:
                    a = shared.value
                    for begin, end, name, state in a.hits(lookup(a.vocab, words.hash), words.first):
                        marks[begin] += 1
                        marks[end] -= 1
                        at = int(np.searchsorted(words.first, begin, "right")) - 1
                        items.setdefault(at, set()).update((name,) if state < 0 else a.held[state])
                hit = np.cumsum(marks[:-1]) > 0
                n_hit = np.bincount(words.doc()[hit], minlength=hi - lo) if hit.any() else np.zeros(hi - lo, np.int64)
                cuts = [[] for _ in range(hi - lo)]
                for d in items:
                    a, b = words.first[d], words.first[d + 1]
                    edge = np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]]))
                    for p, q in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
                        cuts[d].append({"begin": int(words.start[a + p] - offsets[d]), "end": int(words.end[a + q - 1] - offsets[d])})
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(words.counts(), pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(items.get(d, ())) for d in range(hi - lo)], pa.list_(pa.string())), pa.array([_digest(items.get(d, set())) for d in range(hi - lo)]), pa.array(cuts, spans)],
                    names=["doc_id", "n_words", "n_hit", "items", "items_sha256", "spans"],
                )

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        trimmed(run), f"doc_id {id_type}, n_words bigint, n_hit bigint, items array<string>, items_sha256 string, spans array<struct<begin:bigint,end:bigint>>"
    )


def _without(raw: bytes, spans: list[tuple[int, int]]) -> str:
    """A text without these byte ranges, which are in order and apart."""
    parts, at = [], 0
    for begin, end in spans:
        parts.append(raw[at:begin])
        at = end
    return b"".join([*parts, raw[at:]]).decode("utf-8", "replace")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, max_length: int = 0, max_coverage: float = 0.5) -> DataFrame:
    """docs without the spans of more than max_length words that hold a test window; a document of
    which more than max_coverage of the words are hit goes as a whole. Other documents come out
    unchanged, nulls and repeated ids included."""
    sc = docs.sparkSession.sparkContext
    automata = [sc.broadcast(SuffixAutomaton(block, window)) for block in load_items(benchmark)]
    place = docs.columns.index(text)

    def change(batch):
        column = batch.column(place)
        keep, cut = np.ones(batch.num_rows, bool), {}
        for lo, _, buf, offsets in text_blocks(column):
            words = find_words(buf, offsets, ALNUM)
            hit = np.zeros(len(words.start) + 1, np.int32)
            for shared in automata:
                for begin, end, _, _ in shared.value.hits(lookup(shared.value.vocab, words.hash), words.first):
                    hit[begin] += 1
                    hit[end] -= 1
            inside = np.cumsum(hit[:-1]) > 0
            for d in np.unique(np.searchsorted(words.first, np.flatnonzero(inside), "right") - 1).tolist():
                a, b = words.first[d], words.first[d + 1]
                edge = np.diff(np.concatenate([[0], inside[a:b].astype(np.int8), [0]]))
                spans = [(int(p), int(q)) for p, q in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
                if inside[a:b].sum() > max_coverage * (b - a):
                    keep[lo + d] = False
                else:
                    ranges_ = [(int(words.start[a + p] - offsets[d]), int(words.end[a + q - 1] - offsets[d])) for p, q in spans if q - p > max_length]
                    cut[lo + d] = _without(buf[offsets[d] : offsets[d + 1]].tobytes(), ranges_)
        if cut:
            texts = column.to_pylist()
            for d, new in cut.items():
                texts[d] = new
            batch = batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))
        return batch if keep.all() else batch.filter(pa.array(keep))

    return through(docs, change)
