"""SentencePiece encoding by Gumbel top-k without replacement, and decoding.

A text's segmentations into vocabulary pieces are the paths of a lattice; a path's probability is the
product of its pieces' weights, normalised over all paths. A perturbed A-star search emits the k
paths with the largest Gumbel-perturbed log probabilities, which are k distinct samples without
replacement. Its queue holds groups of paths: all paths that share a path's first pieces and leave it
there. A group's exact log probability is known from the lattice's backward sums, so its best
perturbed value can be drawn (truncated by its parent's) before any of its paths is; the group with
the best value is opened next. Inclusion scores are 1 - exp(-exp(log_prob - kappa)), where kappa is
the best value left in the queue.

Every draw is a hash of (seed, row key, sample, place), so results depend on neither partitions nor
batches. No piece crosses certain places (before a word's mark, around characters of no longer
piece), so a lattice falls into units; equal units of a block share their lattice, and the first
path of all texts of a block is drawn step by step for all units at once.

Weights: piece of rank r in the vocabulary's own order of scores has log weight -theta * log(r + SHIFT).
Characters without a piece are spelled in byte pieces. A text's own U+2581 is spelled in bytes as
well, so decoding gives back every text exactly.

Edge cases: null and empty texts have one sample of no pieces with log_prob 0 and inclusion 1; a
text with fewer than k segmentations gives all it has, each with inclusion 1; very long texts are
whole; repeated keys draw the same numbers.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed
from .vectext import M64, Index, fingerprint, keys, mix, ranges, text_blocks

K = 2
SEED = 20
THETA = 1.0
SHIFT = 10.0
SPACE = 0x2581
OWN_SPACE = 0x110000  # a U+2581 of the text itself
BLOCK = 1 << 19
NOISE, DEPTH, NEAR = 37.5, 45.0, 640  # 37.5 > -log(2**-54)
_LEN = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Vocabulary:
    """index: of the fingerprints of all beginnings of pieces; piece: theirs or -1; log_w by piece;
    byte_ids: piece of each byte; text: the pieces' bytes, size of them, one after another at offsets."""

    index: Index
    piece: np.ndarray
    log_w: np.ndarray
    byte_ids: np.ndarray
    text: np.ndarray
    offsets: np.ndarray
    size: np.ndarray
    joined: np.ndarray  # by code point: whether it stands in a longer piece; the last entry is False
    longest: int


def vocabulary(pieces: list[str], scores: list[float], kinds: list[str], theta: float = THETA) -> Vocabulary:
    """kinds: "piece", "byte" or "control"."""
    normal = [i for i, k in enumerate(kinds) if k == "piece" and pieces[i]]
    order = sorted(normal, key=lambda i: (-scores[i], i))
    log_w = np.full(len(pieces), -np.inf)
    log_w[order] = -theta * np.log(np.arange(len(order)) + SHIFT)
    byte_ids = np.full(256, -1, np.int64)
    for i, k in enumerate(kinds):
        if k == "byte":
            byte_ids[int(pieces[i][3:5], 16)] = i
            log_w[i] = -theta * np.log(len(order) + SHIFT)
    if (byte_ids < 0).any():
        raise ValueError("the vocabulary lacks byte pieces")
    for i in normal:
        if "▁" in pieces[i].lstrip("▁"):
            raise ValueError("a piece holds a word's mark after other characters")
    own: dict[str, int] = {}
    for i in normal:
        for n in range(1, len(pieces[i])):
            own.setdefault(pieces[i][:n], -1)
    for i in normal:
        own[pieces[i]] = i
    names = list(own)
    flat = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32).astype(np.int64)
    lens = np.array([len(n) for n in names])
    ends = np.cumsum(lens)
    h = fingerprint(flat, ends - lens, ends)
    at = np.argsort(h)
    raw = [b"" if k == "control" else bytes([int(p[3:5], 16)]) if k == "byte" else p.replace("▁", " ").encode() for p, k in zip(pieces, kinds, strict=True)]
    points = {ord(c) for i in normal if len(pieces[i]) > 1 for c in pieces[i]}
    joined = np.zeros(max(points, default=0) + 2, bool)
    joined[list(points)] = True
    size = np.array([len(r) for r in raw], np.int32)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return Vocabulary(Index(h[at]), np.array([own[names[i]] for i in at.tolist()]), log_w, byte_ids, np.frombuffer(b"".join(raw), np.uint8), offsets, size, joined, max(len(pieces[i]) for i in normal))


def load(path: str, theta: float = THETA) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    kinds = ["byte" if sp.is_byte(i) else "control" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "piece" for i in range(n)]
    return vocabulary([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], kinds, theta)


@dataclass
class Lattice:
    """Of distinct units. Nodes are numbered by their distance from their unit's end, so the backward
    sums run over slices; node i's edges are first[i]:first[i + 1]."""

    first: np.ndarray
    source: np.ndarray
    to: np.ndarray
    piece: np.ndarray  # of an edge, or -1 - i for spelling i
    q: np.ndarray  # probability given the start
    log_q: np.ndarray
    begin: np.ndarray  # each unit's first node; its last one has the unit's number
    spelling: list[np.ndarray]

    def ids(self, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of these edges, one after another, how many each has)."""
        ids, n = self.piece[edge], np.ones(len(edge), np.int64)
        spelled = np.flatnonzero(ids < 0)
        if not len(spelled):
            return ids, n
        n[spelled] = np.array([len(x) for x in self.spelling])[-1 - ids[spelled]]
        out = np.repeat(ids, n)
        out[out < 0] = np.concatenate([self.spelling[i] for i in (-1 - ids[spelled]).tolist()])
        return out, n


def lattice(v: Vocabulary, cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> Lattice:
    """cp: code points; units are cp[start:end]."""
    lens = end - start
    m, c = len(lens), cp[ranges(start, end)].astype(np.int64)
    n = len(c)
    unit = np.repeat(np.arange(m, dtype=np.int32), lens)
    far = np.repeat(np.cumsum(lens), lens) - np.arange(n)
    longest = int(lens.max()) if m else 0
    place = np.argsort(far.astype(np.int16) if longest < 1 << 15 else far, kind="stable").astype(np.int32)
    far, owner = far[place].astype(np.int32), unit[place]
    node = np.empty(n + 1, np.int32)
    node[place] = np.arange(m, m + n, dtype=np.int32)
    key = keys(v.longest)
    plus = c.astype(np.uint64) + np.uint64(1)
    # What is still alive: the beginnings of pieces, of growing length.
    rows, at, left, acc = np.arange(n, dtype=np.int32), place, far, np.zeros(n, np.uint64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]] = []  # (rows, places, distances, length, pieces)
    many = np.zeros(n, np.int32)
    spelled = np.zeros(n, bool)
    for k in range(v.longest):
        if k:
            some = left > k
            rows, at, left, acc = rows[some], at[some], left[some], acc[some]
        if not len(rows):
            break
        acc += plus[at + k] * key[k]
        name = v.index.find(mix(acc + np.array(k + 1, np.uint64) * _LEN))
        some = name >= 0
        rows, at, left, acc = rows[some], at[some], left[some], acc[some]
        names = v.piece[name[some]]
        own = names >= 0
        found.append((rows[own], at[own], left[own], k + 1, names[own]))
        many[found[-1][0]] += 1
        if k == 0:
            spelled[:] = True
            spelled[found[-1][0]] = False
    spelled = np.flatnonzero(spelled) if n else np.zeros(0, np.int64)
    codes, back = np.unique(c[place[spelled]], return_inverse=True)
    spelling = [v.byte_ids[np.frombuffer(chr(SPACE if x == OWN_SPACE else x).encode("utf-8", "surrogatepass"), np.uint8)] for x in codes.tolist()]
    found.append((spelled, place[spelled], far[spelled], 1, -1 - back))
    many[spelled] += 1
    # Each length gives a place one edge at most, so edges go straight to their places.
    first = np.zeros(m + n + 1, np.int32)
    np.cumsum(many, out=first[m + 1 :])
    free = first[m:-1].copy()
    size = int(first[-1])
    to, piece = np.empty(size, np.int32), np.empty(size, np.int32)
    for rows, at, left, k, names in found:
        e = free[rows]
        free[rows] = e + 1
        to[e] = np.where(left == k, owner[rows], node[at + k])
        piece[e] = names
    source = np.repeat(np.arange(m, m + n, dtype=np.int32), many)
    weights = np.append(v.log_w, [len(x) * v.log_w[v.byte_ids[0]] for x in reversed(spelling)])
    log_q = weights[piece]  # a negative number counts from the end
    del found, free, many
    # Backward sums; weights are at most 1, so only long units come near to underflow.
    beta = np.zeros(m + n)
    bounds = m + np.searchsorted(far, np.arange(1, longest + 2))
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if lo == hi:
            continue
        a, b = int(first[lo]), int(first[hi])
        log_q[a:b] += beta[to[a:b]]
        cut = first[lo:hi] - a
        if log_q[a:b].min() < -600:
            most = np.maximum.reduceat(log_q[a:b], cut)
            beta[lo:hi] = most + np.log(np.add.reduceat(np.exp(log_q[a:b] - np.repeat(most, np.diff(first[lo : hi + 1]))), cut))
        else:
            beta[lo:hi] = np.log(np.add.reduceat(np.exp(log_q[a:b]), cut))
    log_q -= beta[source]
    np.minimum(log_q, 0.0, out=log_q)
    q = np.exp(log_q)
    begin = node[np.cumsum(lens) - lens]
    return Lattice(first, source, to, piece, q, log_q, begin, spelling)


def _uniform(key: np.ndarray, *numbers) -> np.ndarray:
    """In (0, 1): a hash of a key and of numbers."""
    x = key.astype(np.uint64)
    for k in numbers:
        x = mix(x + (np.atleast_1d(k).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _truncated(loc: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values with these locations, given that they are below top; -inf for location -inf."""
    out = np.full(len(loc), -np.inf)
    some = loc > -np.inf
    out[some] = loc[some] - np.logaddexp(np.log(-np.log(u[some])), loc[some] - top[some])
    return out


def _walk(x: Lattice, unit: np.ndarray, node: np.ndarray, key: np.ndarray, number: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """(edges, index of the occurrence of each) of random paths from node to the ends of units. key
    and number: each occurrence's row key and number in its text."""
    live, at, step = np.arange(len(unit), dtype=np.int32), node, 0
    ends = len(x.begin)  # nodes below this are the ends of units
    keep = at >= ends
    live, at = live[keep], at[keep]
    seeds = mix(mix(key + np.array(sample + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + number.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    found, who = [], []
    while len(live):
        u = _uniform(seeds[live], step)
        e = x.first[at]
        u -= x.q[e]
        more = np.flatnonzero(u >= 0)
        while len(more):  # a node has few edges, so they are tried in turn
            more = more[e[more] + 1 < x.first[at[more] + 1]]
            e[more] += 1
            u[more] -= x.q[e[more]]
            more = more[u[more] >= 0]
        found.append(e)
        who.append(live)
        at = x.to[e]
        keep = at >= ends
        live, at, step = live[keep], at[keep], step + 1
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    n = np.zeros(len(unit), np.int32)
    for w in who:
        n[w] += 1
    base = np.cumsum(n) - n
    edges, owner = np.zeros(int(n.sum()), np.int32), np.repeat(np.arange(len(unit), dtype=np.int32), n)
    for step, (e, w) in enumerate(zip(found, who, strict=True)):
        edges[base[w] + step] = e
    return edges, owner


@dataclass
class Paths:
    """One path for each text that has one, with the queue's groups along it."""

    first: np.ndarray  # by text
    edge: np.ndarray
    number: np.ndarray  # the occurrence in its text
    before: np.ndarray  # log probability of what comes before
    value: np.ndarray  # of the group that leaves the path here
    log_prob: np.ndarray  # by text
    gumbel: np.ndarray  # by text, -inf without a path


def _groups(x: Lattice, first, edge, number, gumbel, key, sample: int, since: np.ndarray, wanted: int) -> Paths:
    log_q = x.log_q[edge]
    total = np.zeros(len(first) - 1)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        total[full] = np.add.reduceat(log_q, first[:-1][full])
    value, before = np.full(len(edge), -np.inf), np.zeros(len(edge))

    def draw(docs: np.ndarray, most: int, deepest: float) -> np.ndarray:
        """Fills in the groups of the first places of these texts; whether that is enough for each."""
        lo = first[docs]
        hi = np.minimum(first[docs + 1], lo + most)
        lens = hi - lo
        at = ranges(lo, hi)
        own = np.repeat(np.arange(len(docs)), lens)
        part = log_q[at]
        cum = np.cumsum(part)
        cum -= part
        start = np.cumsum(lens) - lens
        cum -= np.repeat(cum[start], lens)
        before[at] = cum
        e = edge[at]
        k = np.flatnonzero((cum >= deepest) & (at >= np.repeat(lo + since[docs], lens)) & (x.first[x.source[e] + 1] - x.first[x.source[e]] > 1) & (x.q[e] < 1))
        d = docs[own[k]]
        value[at[k]] = _truncated(cum[k] + np.log1p(-x.q[e[k]]), gumbel[d], _uniform(key[d], sample, at[k] - first[d], 1 << 20))
        last = hi - 1
        done = (hi == first[docs + 1]) & (before[last] >= deepest)
        deep = before[last] < deepest
        return done | deep & (np.bincount(own[k][value[at[k]] > NOISE + deepest], minlength=len(docs)) > wanted)

    # A drawn value exceeds its location by less than NOISE, so groups far down a path cannot be among
    # the next ones; they are drawn only for texts whose nearer groups might not be enough.
    if len(full):
        again = full[~draw(full, NEAR, -DEPTH)]
        if len(again):
            draw(again, len(edge), -np.inf)
    return Paths(first, edge, number, before, value, total, gumbel)


def top_k(x: Lattice, unit: np.ndarray, first: np.ndarray, key: np.ndarray, k: int) -> tuple[list[Paths], np.ndarray]:
    """(the samples in falling order of their perturbed values, kappa) for texts whose occurrences
    of units are unit[first[i]:first[i + 1]]."""
    docs = len(first) - 1
    doc = np.repeat(np.arange(docs), np.diff(first))
    number = np.arange(len(unit)) - first[doc]
    edge, owner = _walk(x, unit, x.begin[unit], key[doc], number, 0)
    path_first = np.searchsorted(doc[owner], np.arange(docs + 1))
    root = -np.log(-np.log(_uniform(key, 0, 0, 1 << 21)))
    out = [_groups(x, path_first, edge, number[owner], root, key, 0, np.zeros(docs, np.int64), k + 1)]
    gone: dict[tuple[int, int, int], list[int]] = {}  # edges taken from a group: (text, path, place)

    def best(paths: Paths) -> np.ndarray:
        top = np.full(docs, -np.inf)
        full = np.flatnonzero(np.diff(paths.first))
        if len(full):
            top[full] = np.maximum.reduceat(paths.value, paths.first[:-1][full])
        return top

    tops = [best(out[0])]
    for j in range(1, k):
        pick_u, again_u = _uniform(key, j, 1 << 22).tolist(), np.log(-np.log(_uniform(key, j, 1 << 23))).tolist()
        which = np.argmax(tops, axis=0)
        value = np.max(tops, axis=0)
        heads: list[tuple[np.ndarray, np.ndarray]] = []  # (edges, numbers) up to where the new path leaves
        since = np.zeros(docs, np.int64)
        todo = np.flatnonzero(value > -np.inf)
        for d in todo.tolist():
            p = out[which[d]]
            a, b = int(p.first[d]), int(p.first[d + 1])
            place = int(np.argmax(p.value[a:b]))
            e = int(p.edge[a + place])
            node = int(x.source[e])
            taken = gone.setdefault((d, int(which[d]), place), [e])
            others = [o for o in range(int(x.first[node]), int(x.first[node + 1])) if o not in taken]
            w = [float(x.q[o]) for o in others]
            want, pick = pick_u[d] * math.fsum(w), len(others) - 1
            for i, one in enumerate(w):
                want -= one
                if want < 0:
                    pick = i
                    break
            left = math.fsum(one for i, one in enumerate(w) if i != pick)
            pick = others[pick]
            taken.append(pick)
            loc = float(p.before[a + place]) + math.log(left) if left > 0 else -math.inf
            p.value[a + place] = loc - np.logaddexp(again_u[d], loc - value[d]) if left > 0 else -math.inf
            heads.append((np.append(p.edge[a : a + place], np.int32(pick)), p.number[a : a + place + 1]))
            since[d] = place + 1
        for i in set(which[todo].tolist()):
            tops[i] = best(out[i])
        # The rest of the opened unit, then all later ones, are drawn afresh.
        opened = np.array([first[d] + h[1][-1] for d, h in zip(todo.tolist(), heads, strict=True)], np.int64)
        again = ranges(opened, first[todo + 1])
        begin = x.begin[unit[again]]
        at = np.cumsum(first[todo + 1] - opened) - (first[todo + 1] - opened)
        begin[at] = [x.to[h[0][-1]] for h in heads]
        tail, who = _walk(x, unit[again], begin, key[doc[again]], number[again], j)
        tail_first = np.searchsorted(doc[again][who], np.arange(docs + 1))
        tail_number = number[again][who]
        lens = np.zeros(docs, np.int64)
        parts_e, parts_n = [], []
        for d, (e, m) in zip(todo.tolist(), heads, strict=True):
            lo, hi = tail_first[d], tail_first[d + 1]
            parts_e += (e, tail[lo:hi])
            parts_n += (m, tail_number[lo:hi])
            lens[d] = len(e) + hi - lo
        new_first = np.concatenate([[0], np.cumsum(lens)])
        edges = np.concatenate(parts_e) if parts_e else np.zeros(0, np.int32)
        numbers = np.concatenate(parts_n) if parts_n else np.zeros(0, np.int64)
        out.append(_groups(x, new_first, edges, numbers, value, key, j, since, k + 1))
        tops.append(best(out[-1]))
    return out, np.max(tops, axis=0)


def units(buf: np.ndarray, offsets: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points with word marks, units' starts, ends, first unit by text)."""
    cp = np.frombuffer(buf.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[offsets]
    lens = np.diff(chars)
    some = (lens > 0).astype(np.int64)
    new = chars[:-1] + np.cumsum(some) - some  # where texts begin once each has its first mark
    full = np.full(len(cp) + int(some.sum()), SPACE, np.int64)
    at = np.arange(len(cp)) + np.repeat(np.cumsum(some), lens)
    full[at] = np.where(cp == 32, SPACE, np.where(cp == SPACE, OWN_SPACE, cp))
    n = len(full)
    if not n:
        return full, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    mark = full == SPACE
    alone = ~v.joined[np.minimum(full, len(v.joined) - 1)]
    cut = np.zeros(n, bool)
    cut[1:] = (mark[1:] & ~mark[:-1]) | alone[1:] | alone[:-1]
    cut[new[some > 0]] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], n)
    return full, start, end, np.searchsorted(start, np.append(new, n))


def decode_ids(v: Vocabulary, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts whose pieces are ids[first[i]:first[i + 1]]; the first mark goes."""
    lo, size = v.offsets[ids], v.size[ids]
    at = np.concatenate([[0], np.cumsum(size)])[first]
    raw = v.text[ranges(lo, lo + size)]
    some = at[1:] > at[:-1]
    return np.delete(raw, at[:-1][some]), at - np.concatenate([[0], np.cumsum(some)])


def row_keys(column: pa.Array, seed: int) -> np.ndarray:
    """A 64-bit key for each value, by its text; null has its own."""
    texts = column.cast(pa.string()).to_pylist()
    raw = [hashlib.blake2b(b"\0" if t is None else b"\1" + t.encode(), digest_size=8).digest() for t in texts]
    return mix(np.frombuffer(b"".join(raw), np.uint64) + np.uint64(seed * 0xD1342543DE82EF95 & M64))


def encode(docs: DataFrame, model: Vocabulary, k: int = K, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each text and sample: (doc_id, sample from 0, n_pieces, log_prob, inclusion,
    log_inclusion, ids binary: little-endian 16-bit (32-bit for larger vocabularies) piece numbers,
    round_trip: whether decoding gives the text back)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[doc_id].dataType.simpleString()
    wide = np.uint16 if len(model.log_w) <= 1 << 16 else np.uint32

    def run(batches):
        v = shared.value
        for batch in batches:
            seeds = row_keys(batch.column(0), seed)
            for lo, hi, buf, offsets in text_blocks(batch.column(1), BLOCK):
                n = hi - lo
                cp, start, end, first = units(buf, offsets, v)
                if len(start):
                    _, one, back = np.unique(fingerprint(cp, start, end), return_index=True, return_inverse=True)
                    x = lattice(v, cp, start[one], end[one])
                    paths, kappa = top_k(x, back, first, seeds[lo:hi], k)
                else:
                    paths, kappa = [], np.full(n, -np.inf)
                blank = np.diff(first) == 0
                for j in range(max(1, len(paths))):
                    if paths:
                        p = paths[j]
                        there = (p.gumbel > -np.inf) & (np.diff(p.first) > 0)
                        ids, size = x.ids(p.edge)
                        id_first = np.concatenate([[0], np.cumsum(size)])[p.first]
                        log_prob = p.log_prob
                    else:
                        there, ids, id_first, log_prob = np.zeros(n, bool), np.zeros(0, np.int64), np.zeros(n + 1, np.int64), np.zeros(n)
                    raw, raw_at = decode_ids(v, ids, id_first)
                    packed = ids.astype(wide)
                    rows = np.flatnonzero(there | blank if j == 0 else there)
                    with np.errstate(over="ignore", divide="ignore"):
                        gap = log_prob - kappa
                        # log(1 - exp(-exp(gap))), exact for gaps far below 0 too
                        log_inc = np.where(blank | (kappa == -np.inf), 0.0, np.where(gap < -30, gap, np.log(-np.expm1(-np.exp(np.minimum(gap, 30))))))
                    same = [raw[raw_at[d] : raw_at[d + 1]].tobytes() == buf[offsets[d] : offsets[d + 1]].tobytes() for d in rows.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(lo, n).take(pa.array(rows)), pa.array(np.full(len(rows), j, np.int32)), pa.array(np.diff(id_first)[rows]), pa.array(np.where(blank, 0.0, log_prob)[rows]),
                            pa.array(np.exp(log_inc)[rows]), pa.array(log_inc[rows]), pa.array([packed[id_first[d] : id_first[d + 1]].tobytes() for d in rows.tolist()], pa.binary()), pa.array(same, pa.bool_()),
                        ], names=["doc_id", "sample", "n_pieces", "log_prob", "inclusion", "log_inclusion", "ids", "round_trip"],
                    )

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        trimmed(run), f"doc_id {id_type}, sample int, n_pieces bigint, log_prob double, inclusion double, log_inclusion double, ids binary, round_trip boolean"
    )


def decode(encoded: DataFrame, model: Vocabulary, ids: str = "ids") -> DataFrame:
    """encoded with a column text: the decoded pieces. Null ids decode to null."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    wide = np.uint16 if len(model.log_w) <= 1 << 16 else np.uint32
    names = encoded.columns

    def run(batches):
        v = shared.value
        for batch in batches:
            texts = []
            for raw in batch.column(names.index(ids)).to_pylist():
                one = np.frombuffer(raw or b"", wide).astype(np.int64)
                texts.append(None if raw is None else decode_ids(v, one, np.array([0, len(one)]))[0].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(trimmed(run), f"{schema}, text string")
