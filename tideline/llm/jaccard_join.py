"""Exact Jaccard similarity self-join over word shingles in metric space.

Jaccard distance is a metric, but almost all pairs of texts are at distance 1, where a distance to a
pivot says nothing. So the space is first cut where texts do come close, then by pivots:

1.  Texts with equal shingle sets are one point (a set is known by a 64-bit fingerprint).
2.  Cells. All shingles are ordered, the rarest first. Two sets within the radius share a shingle
    among the first n - ceil(share * n) + 1 of each, so a point reaches the cells of these shingles
    only. How often shingles occur is counted over all texts in 2^24 slots; a coarse count can make a
    cell larger, but any one order of all shingles finds every link.
3.  A cell of at most SMALL points compares them pair by pair, without those that sizes, places in the
    order or folded sets (counts of shingles by buckets) rule out.
4.  Regions. A larger cell elects PIVOTS points, measures all distances to them and gives each point
    to its nearest pivot. A point at d from its nearest pivot is replicated to the region of each pivot
    within d + radius: of two linked points, the one farther from its own pivot reaches the other's
    region by the triangle inequality. Equal pivots of several cells make one region.
5.  A region whose points are in one component is done. A larger one than LARGE is a cell again, with
    pivots elected outside its largest component, while that makes regions smaller. All others are
    joined: the points outside the region's largest component meet all its points of other components
    whose distances to the pivot differ by no more than the radius. Both sides are dealt to blocks.

Every candidate is verified on its whole sets, so links are exact; only links that are needed to know
the components are looked for (regions don't compare points of a component with each other).

Nothing of the documents is collected: sets of candidates, links and labels are tables in the shared
folder, and labels spread by distributed minima with pointer jumping. The driver holds the 2^24 slots.

Edge cases: null, empty and blank texts have no shingles and stay alone; fewer words than a shingle
are one shingle; repeated ids are rows of their own and equal texts share a component; null ids are
kept and never name a component unless all its ids are null; an empty table gives an empty result.
Only the id and the text are read, so other columns may have any names.
"""

from __future__ import annotations

import itertools
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, release, trimmed, written
from .vectext import SPACED, find_words, mix, ranges, text_blocks

SHINGLE = 4
PERCENT = 85
#: Points of a cell that are compared pair by pair.
SMALL = 64
PIVOTS = 4
#: Points of a region that are split once more, and how often that is tried.
LARGE, LEVELS = 1 << 14, 3
#: Points that a task holds at once, and that pass them.
HELD, PASSING = 512, 2048
#: Buckets of a set's fold.
FINE = 256
#: Slots (2^BITS) that count shingles, in ranges of 2^16; levels of a count's logarithm to an octave.
BITS, OCTAVE = 24, 12
#: Hash values that tell which documents a join may need.
SLOTS = 1 << 20
#: Parts that a hot cell's join with its pivots is dealt to.
SALT = 16
_ROLL = mix(np.arange(101, 140, dtype=np.uint64)) | np.uint64(1)


def shingles(words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle fingerprints of each text, first by text)."""
    n, h = words.counts(), words.hash
    lens = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(lens)])
    x = np.zeros(int(first[-1]), np.uint64)
    if len(h) >= size:
        g = np.zeros(len(h) - size + 1, np.uint64)
        for k in range(size):
            g += h[k : len(h) - size + 1 + k] * _ROLL[k]
        full = n >= size
        at = ranges(words.first[:-1][full], words.first[:-1][full] + lens[full])
        x[np.repeat(full, lens)] = mix(g[at])
    for d in np.flatnonzero((n > 0) & (n < size)).tolist():  # the whole sequence as one
        w = h[words.first[d] : words.first[d + 1]]
        x[first[d]] = mix(np.array([(w * _ROLL[: len(w)]).sum() + np.uint64(len(w))], np.uint64))[0]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        x[a:b].sort()
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    keep[first[:-1][lens > 0]] = True
    return x[keep], np.concatenate([[0], np.cumsum(keep)])[first]


def set_ids(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A fingerprint of each text's set; 0 without shingles."""
    out = np.zeros(len(first) - 1, np.uint64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = mix(np.add.reduceat(mix(x ^ np.uint64(0xA0761D6478BD642F)), first[:-1][full]) + np.diff(first)[full].astype(np.uint64))
    return out


def folds(x: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Counts of each text's shingles by so many buckets."""
    docs = len(first) - 1
    at = np.repeat(np.arange(docs), np.diff(first)) * width + (mix(x + np.uint64(77)) % np.uint64(width)).astype(np.int64)
    counts = np.bincount(at, minlength=docs * width).reshape(docs, width)
    return np.minimum(counts, 255).astype(np.uint8)  # cutting counts off can only bring sets closer


def unfold(raw: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.uint8).reshape(-1, width).astype(np.int16)


def prefix_length(n: np.ndarray, share: Fraction) -> np.ndarray:
    """How many of a set's first shingles any set within the radius must share one of."""
    return n + (-share.numerator * n) // share.denominator + (n > 0)


def _parse(column, size: int):
    for lo, hi, buf, offsets in text_blocks(column):
        x, first = shingles(find_words(buf, offsets, SPACED), size)
        yield lo, hi, x, first


def _slot_rows(slots: list[np.ndarray]):
    """(range, slots within it) for slots that are at hand; copies of a slot stay."""
    s = np.sort(np.concatenate(slots)) if slots else np.zeros(0, np.uint32)
    cut = np.flatnonzero(np.concatenate([[True], (s[1:] >> 16) != (s[:-1] >> 16)])) if len(s) else np.zeros(0, np.int64)
    raw = [part.astype(np.uint16).tobytes() for part in np.split(s, cut[1:])] if len(s) else []
    return (s[cut] >> 16).astype(np.int32), raw


def _points(docs: DataFrame, size: int) -> DataFrame:
    """For every row of (doc_id, key, text): (doc_id, key, n_shingles, point, fine), and in rows of their
    own (range, slots): the slots of all shingles of the distinct texts of a batch."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            slots: list[np.ndarray] = []
            seen = np.zeros(0, np.uint64)
            kind = batch.schema.field(0).type

            def rows_of(slots, kind=kind):
                at, raw = _slot_rows(slots)
                none = [pa.nulls(len(at), t) for t in (kind, pa.int64(), pa.int64(), pa.int64(), pa.binary())]
                return pa.RecordBatch.from_arrays([*none, pa.array(at), pa.array(raw, pa.binary())], names=names)

            names = ["doc_id", "key", "n_shingles", "point", "fine", "range", "slots"]
            for lo, hi, x, first in _parse(batch.column(2), size):
                ids = set_ids(x, first)
                _, new = np.unique(ids, return_index=True)
                new = new[(ids[new] != 0) & ~np.isin(ids[new], seen)]
                seen = np.concatenate([seen, ids[new]])
                slots.append((mix(x[ranges(first[new], first[new + 1])]) >> np.uint64(64 - BITS)).astype(np.uint32))
                fine = pa.array([r.tobytes() for r in folds(x, first, FINE)], pa.binary())
                none = [pa.nulls(hi - lo, t) for t in (pa.int32(), pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(first)), pa.array(ids.view(np.int64)), fine, *none], names=names)
                if sum(map(len, slots)) > 1 << 22:
                    yield rows_of(slots)
                    slots = []
            yield rows_of(slots)

    return docs.mapInArrow(trimmed(run), f"doc_id {id_type}, key bigint, n_shingles bigint, point bigint, fine binary, range int, slots binary")


def _rarity(slots: DataFrame) -> np.ndarray:
    """The logarithm of each slot's count, in 1 / OCTAVE octaves up to 255; 2^BITS bytes whatever the input."""

    def run(batches):
        at, counts = None, np.zeros(1 << 16, np.int64)

        def level():
            raw = np.minimum(np.round(np.log2(counts + 1.0) * OCTAVE), 255).astype(np.uint8).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([raw], pa.binary())], names=["range", "levels"])

        for batch in batches:
            for r, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if r != at:
                    if at is not None:
                        yield level()
                    at = r
                    counts[:] = 0
                counts += np.bincount(np.frombuffer(raw.as_buffer(), np.uint16), minlength=1 << 16)
        if at is not None:
            yield level()

    found = slots.repartition("range").sortWithinPartitions("range").mapInArrow(trimmed(run), "range int, levels binary").toArrow()
    out = np.zeros(1 << BITS, np.uint8)
    for r, raw in zip(found["range"].to_pylist(), found["levels"].to_pylist(), strict=True):
        out[r << 16 : (r + 1) << 16] = np.frombuffer(raw, np.uint8)
    return out


def _postings(docs: DataFrame, rarity, share: Fraction, size: int, small: int) -> DataFrame:
    """(cell, point, n, nth, sure) of each distinct text of a batch and each shingle of its prefix. A row is
    sure to be in a large cell, and need not meet the cell's others, where small + 1 of its batch go there."""

    def run(batches):
        levels = rarity.value
        for batch in batches:
            seen = np.zeros(0, np.uint64)
            found: list[tuple] = []
            for _, _, x, first in _parse(batch.column(0), size):
                ids, n = set_ids(x, first), np.diff(first)
                _, new = np.unique(ids, return_index=True)
                new = new[(ids[new] != 0) & ~np.isin(ids[new], seen)]
                seen = np.concatenate([seen, ids[new]])
                order = levels[(mix(x) >> np.uint64(64 - BITS)).view(np.int64)].astype(np.uint64) << np.uint64(56) | x >> np.uint64(8)
                take = prefix_length(n[new], share)
                for d, k in zip(new.tolist(), take.tolist(), strict=True):
                    own = order[first[d] : first[d + 1]]
                    if k < len(own) // 2:
                        own.partition(k)
                        own[:k].sort()
                    else:
                        own.sort()
                found.append((order[ranges(first[new], first[new] + take)], np.repeat(ids[new], take), np.repeat(n[new], take), ranges(np.zeros(len(new), np.int64), take)))
            if not found:
                continue
            cell, point, n, nth = (np.concatenate(f) for f in zip(*found, strict=True))
            by = np.argsort(cell, kind="stable")
            c = cell[by]
            start = np.maximum.accumulate(np.where(np.concatenate([[True], c[1:] != c[:-1]]), np.arange(len(c)), 0)) if len(c) else by
            sure = np.zeros(len(c), bool)
            sure[by] = np.arange(len(c)) - start > small
            out = (cell.view(np.int64), point.view(np.int64), n.astype(np.int32), nth.astype(np.int32), sure)
            for lo in range(0, len(c), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(col[lo : lo + (1 << 16)]) for col in out], names=["cell", "point", "n", "nth", "sure"])

    return docs.select("text").mapInArrow(trimmed(run), "cell bigint, point bigint, n int, nth int, sure boolean")


def _similar_sizes(a: np.ndarray, b: np.ndarray, share: Fraction) -> np.ndarray:
    return share.denominator * np.minimum(a, b) >= share.numerator * np.maximum(a, b)


def _pairs_of(cell, point, n, nth, share: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of the cells of rows sorted by (cell, point) that sizes and places don't rule out."""
    at = np.arange(len(cell))
    start = np.maximum.accumulate(np.where(np.concatenate([[True], cell[1:] != cell[:-1]]), at, 0))
    i, j = np.repeat(at, at - start), ranges(start, at)
    ok = _similar_sizes(n[i], n[j], share)
    i, j = i[ok], j[ok]
    p, q = share.numerator, share.denominator
    need = -(-p * (n[i] + n[j]) // (p + q))
    ok = np.minimum(n[i] - nth[i], n[j] - nth[j]) + np.minimum(nth[i], nth[j]) >= need
    a, b = point[j[ok]], point[i[ok]]
    _, one = np.unique(mix(a.view(np.uint64)) + b.view(np.uint64), return_index=True)
    return a[one], b[one]


def _candidates(postings: DataFrame, share: Fraction, small: int) -> DataFrame:
    """(cell, a, b): pairs (a, b) of small cells, without a cell; points a of large cells, without b."""

    def members(cell, point):
        return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(point), pa.nulls(len(cell), pa.int64())], names=["cell", "a", "b"])

    def run(batches):
        none = [np.zeros(0, np.int64) for _ in range(4)]
        held, flows = none, None  # the open cell's rows; the large cell whose rows flow through

        def close(rows):
            """Batches for whole cells."""
            cell = rows[0]
            begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            count = np.diff(np.append(begin, len(cell)))
            large = np.repeat((count > small) | (cell[begin] == flows if flows is not None else False), count)
            if large.any():
                yield members(cell[large], rows[1][large])
            some = np.repeat(count > 1, count) & ~large
            if some.any():
                a, b = _pairs_of(*(r[some] for r in rows), share)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b)], names=["cell", "a", "b"])

        for batch in batches:
            sure = batch.column(4).to_numpy(zero_copy_only=False)
            cols = [batch.column(i).to_numpy().astype(np.int64, copy=False) for i in range(4)]
            if sure.any():
                yield members(cols[0][sure], cols[1][sure])
            rows = [np.concatenate([h, c[~sure]]) for h, c in zip(held, cols, strict=True)]
            if not len(rows[0]):
                continue
            keep = np.ones(len(rows[0]), bool)  # equal texts of several batches
            keep[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
            rows = [r[keep] for r in rows]
            last = rows[0] == rows[0][-1]
            if not last.all():
                yield from close([r[~last] for r in rows])
            held = [r[last] for r in rows]
            if held[0][0] == flows or len(held[0]) > small:
                flows = held[0][0]
                yield members(held[0], held[1])
                held = none
        if len(held[0]):
            yield from close(held)

    dealt = postings.repartition(F.when(F.col("sure"), F.col("point")).otherwise(F.col("cell"))).sortWithinPartitions("sure", "cell", "point")
    return dealt.mapInArrow(trimmed(run), "cell bigint, a bigint, b bigint")


def _near(a_n: np.ndarray, b_n: np.ndarray, gap: np.ndarray, share: Fraction) -> np.ndarray:
    """Whether sets of these sizes can be within the radius if they differ in gap shingles or more."""
    p, q = share.numerator, share.denominator
    return _similar_sizes(a_n, b_n, share) & (gap * (p + q) <= (a_n + b_n) * (q - p))


def _plausible(pairs: DataFrame, points: DataFrame, share: Fraction) -> DataFrame:
    """The pairs (a, b) that sizes and folded sets don't rule out."""
    own = points.select("point", "n_shingles", "fine")
    both = pairs.join(own.toDF("a", "a_n", "a_f"), "a").join(own.toDF("b", "b_n", "b_f"), "b")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                fa, fb = (unfold(batch.column(i).to_pylist(), FINE) for i in (4, 5))
                ok = pa.array(_near(batch.column(2).to_numpy(), batch.column(3).to_numpy(), np.abs(fa - fb).sum(1), share))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    return both.select("a", "b", "a_n", "b_n", "a_f", "b_f").mapInArrow(trimmed(run), "a bigint, b bigint")


def _sets(ids: DataFrame, docs: DataFrame, points: DataFrame, size: int) -> DataFrame:
    """(point, items) of the points in ids, and maybe of some others, from the texts of their representatives."""
    keys = written(points.join(ids, "point", "left_semi").select("key"), "keys")

    def sets(batches):
        for batch in batches:
            for lo, hi, x, first in _parse(batch.column(0), size):
                raw = [x[first[i] : first[i + 1]].tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([pa.array(set_ids(x, first).view(np.int64)), pa.array(raw, pa.binary())], names=["point", "items"])

    # The keys' hashes are cut to SLOTS values, so what is broadcast is bounded whatever the number of keys;
    # it spares most texts the join's shuffle.
    slot = F.pmod(F.col("key"), F.lit(SLOTS)).alias("slot")
    few = docs.withColumn("slot", slot).join(F.broadcast(keys.select(slot).distinct()), "slot", "left_semi").drop("slot")
    found = written(few.join(keys, "key", "left_semi").select("text").mapInArrow(trimmed(sets), "point bigint, items binary"), "sets")
    drop_written(keys)
    count = found.agg(F.count("*").alias("n"), F.count_distinct("point").alias("d")).first()
    # Rows of one id, or without one, may have brought a set several times.
    return found if count["n"] == count["d"] else found.groupBy("point").agg(F.first("items").alias("items"))


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _within(common, a_n, b_n, share: Fraction):
    return share.denominator * common >= share.numerator * (a_n + b_n - common)


def _compare(pairs: DataFrame, docs: DataFrame, points: DataFrame, share: Fraction, size: int) -> DataFrame:
    """(a, b, d, linked) for the pairs (a, b): Jaccard distances of their whole sets."""
    ids = pairs.select(F.col("a").alias("point")).union(pairs.select("b")).distinct()
    table = _sets(ids, docs, points, size)
    both = pairs.join(table.toDF("a", "a_s"), "a").join(table.toDF("b", "b_s"), "b").select("a", "b", "a_s", "b_s")

    def run(batches):
        for batch in batches:
            d, ok = [], []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                c = _common(x, y)
                d.append(1 - c / max(1, len(x) + len(y) - c))
                ok.append(_within(c, len(x), len(y), share))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d, pa.float64()), pa.array(ok, pa.bool_())], names=["a", "b", "d", "linked"])

    return written(both.mapInArrow(trimmed(run), "a bigint, b bigint, d double, linked boolean"), "compared")


def components(links: DataFrame) -> DataFrame:
    """(point, component): the smallest point reachable by links (a, b), for points that have any."""
    edges = written(links.union(links.select("b", "a")).distinct().toDF("a", "b"), "edges")
    labels = written(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("point"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = edges.join(labels.toDF("b", "l"), "b").groupBy("a").agg(F.min("l").alias("l")).withColumnRenamed("a", "point")
        low = labels.join(near, "point").select("point", F.col("component").alias("old"), F.least("component", "l").alias("to"))
        jump = labels.toDF("to", "far")
        new = written(low.join(jump, "to").select("point", "old", F.least("to", "far").alias("component")), "labels")
        drop_written(labels)
        labels = new.select("point", "component")
        if not new.filter("old != component").limit(1).count():
            drop_written(edges)
            return labels


def _elect(members: DataFrame, pivots: int, level: int) -> DataFrame:
    """(cell, pivot): some pivots of each cell, by hashes of points, the same in cells of the same points."""
    picks = [F.min(F.struct(F.xxhash64("point", F.lit(level * 100 + j)).alias("h"), F.col("point"))).getField("point") for j in range(pivots)]
    return members.groupBy("cell").agg(F.array_distinct(F.array(*picks)).alias("pivots")).select("cell", F.explode("pivots").alias("pivot"))


def _stars(members: DataFrame, pivots: DataFrame) -> DataFrame:
    """(cell, point, pivot) for each point and pivot of a cell; a hot cell's points are dealt to SALT parts."""
    dealt = members.withColumn("salt", F.pmod(F.xxhash64("point"), F.lit(SALT)))
    return dealt.join(pivots.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint")))), ["cell", "salt"]).select("cell", "point", "pivot")


def _regions(stars: DataFrame, compared: DataFrame, radius: float) -> DataFrame:
    """(region, point, d): each point with the pivots that the triangle inequality asks for, and its distance."""
    d = compared.select(F.col("a").alias("point"), F.col("b").alias("pivot"), "d")
    d = d.union(d.select("pivot", "point", "d"))
    own = stars.filter("point = pivot").withColumn("d", F.lit(0.0))
    each = stars.join(d, ["point", "pivot"]).select("cell", "point", "pivot", "d").union(own.select("cell", "point", "pivot", "d"))
    home = each.groupBy("cell", "point").agg(F.min("d").alias("home"), F.collect_list(F.struct("pivot", "d")).alias("to"))  # PIVOTS at most
    to = home.select("point", "home", F.inline("to")).filter(F.col("d") <= F.col("home") + radius + 1e-9)
    return to.select(F.col("pivot").alias("region"), "point", "d").distinct()


def _labelled(regions: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(region, point, d, component) and (region, main, all, edge) of regions of several components: the
    largest, the number of points, and of those outside it."""
    rows = regions.join(labels, "point", "left").select("region", "point", "d", F.coalesce("component", "point").alias("component"))
    held_by = rows.groupBy("region", "component").agg(F.count("*").alias("k"))
    open_ = held_by.groupBy("region").agg(F.max(F.struct("k", "component")).alias("m"), F.sum("k").alias("all")).filter("m.k < all")
    return rows, open_.select("region", F.col("m.component").alias("main"), "all", (F.col("all") - F.col("m.k")).alias("edge"))


def _join_regions(rows: DataFrame, open_: DataFrame, docs: DataFrame, points: DataFrame, share: Fraction, size: int, held: int, passing: int) -> DataFrame:
    """Links (a, b) that join components of a region; rows and open_ as _labelled() gives them."""
    sides = open_.withColumn("hs", F.ceil(F.col("edge") / held).cast("int")).withColumn("ps", F.ceil(F.col("all") / passing).cast("int"))
    rows = written(rows.join(sides, "region"), "region-rows")
    own = lambda n: F.pmod(F.xxhash64("point"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ("region", "h", "p", "side", "point", "component", "d")
    edge = rows.filter("component != main").withColumn("h", own("hs")).withColumn("p", every("ps")).withColumn("side", F.lit(0))
    flow = rows.withColumn("p", own("ps")).withColumn("h", every("hs")).withColumn("side", F.lit(1))
    table = _sets(rows.select("point").distinct(), docs, points, size)
    both = edge.select(*columns).union(flow.select(*columns)).join(table, "point").select(*columns, "items")
    dealt = both.repartition("region", "h", "p").sortWithinPartitions("region", "h", "p", "side")
    radius = float(1 - share) + 1e-9

    def run(batches):
        def flat():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        for _, block in itertools.groupby(flat(), key=lambda r: r[:3]):
            sets, point, comp, dist = [], [], [], []
            parent: dict[int, int] = {}
            a, b = [], []
            index = None

            def find(c, parent=parent):
                while (p := parent.get(c, c)) != c:
                    parent[c] = parent.get(p, p)
                    c = p
                return c

            for r in block:
                y = np.frombuffer(r[7], np.uint64)
                if not r[3]:
                    sets.append(y)
                    point.append(r[4])
                    comp.append(r[5])
                    dist.append(r[6])
                    continue
                if not sets:
                    break
                if index is None:
                    index = _Inverted(sets)
                    dist, label, n = np.array(dist), np.array(comp, np.int64), index.n
                some = (label != find(r[5])) & (np.abs(dist - r[6]) <= radius) & _similar_sizes(n, np.int64(len(y)), share)
                if not some.any():
                    continue
                some &= _within(index.common(y), n, len(y), share)
                for i in np.flatnonzero(some).tolist():
                    u, v = find(int(label[i])), find(r[5])
                    if u != v:
                        parent[max(u, v)] = min(u, v)
                        label[label == max(u, v)] = min(u, v)
                        a.append(min(point[i], r[4]))
                        b.append(max(point[i], r[4]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return written(dealt.mapInArrow(trimmed(run), "a bigint, b bigint"), "region-links")


class _Inverted:
    """Which of a block's sets hold a shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(s) for s in sets], np.int64)
        items, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.n)
        order = np.argsort(items, kind="stable")
        items, self.who = items[order], who[order]
        begin = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1]])) if len(items) else np.zeros(0, np.int64)
        self.items, self.first = items[begin], np.append(begin, len(items))

    def common(self, y: np.ndarray) -> np.ndarray:
        """How many shingles of y each set holds."""
        at = np.searchsorted(self.items, y)
        at[at == len(self.items)] = 0
        at = at[self.items[at] == y]
        return np.bincount(self.who[ranges(self.first[at], self.first[at + 1])], minlength=len(self.n))


def similarity_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, size: int = SHINGLE, pivots: int = PIVOTS, small: int = SMALL, large: int = LARGE, held: int = HELD, passing: int = PASSING) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: documents link when 100 * intersection >=
    percent * union of their shingle sets, and a component is named by its smallest doc_id."""
    if not 1 <= percent <= 100:
        raise ValueError("percent is from 1 to 100")
    share = Fraction(percent, 100)
    radius = float(1 - share)
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")).alias("key")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).select("doc_id", key, "text")
    parsed = written(_points(rows, size), "parsed")
    own = parsed.filter("range IS NULL").select("doc_id", "key", "n_shingles", "point", "fine")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("key"))).alias("r")
    points = own.filter("n_shingles > 0").groupBy("point").agg(first, F.first("n_shingles").alias("n_shingles"), F.first("fine").alias("fine"))
    points = written(points.select("point", F.col("r.doc_id").alias("rep"), F.col("r.key").alias("key"), "n_shingles", "fine"), "points")
    own = written(own.select("doc_id", "n_shingles", "point"), "own")
    rarity = docs.sparkSession.sparkContext.broadcast(_rarity(parsed.filter("range IS NOT NULL").select("range", "slots")))
    drop_written(parsed)
    found = written(_candidates(_postings(rows, rarity, share, size, small), share, small), "candidates")
    rarity.destroy()
    release(docs.sparkSession)
    pairs = written(found.filter("cell IS NULL").select("a", "b").distinct(), "pairs")
    members = written(found.filter("cell IS NOT NULL").select("cell", F.col("a").alias("point")).distinct(), "members")
    drop_written(found)
    pairs = _plausible(pairs, points, share)
    links, joined = [], None
    for level in range(LEVELS):
        crowded = members.limit(1).count() > 0
        if crowded:
            stars = written(_stars(members, _elect(members, pivots, level)), "stars")
            star = stars.filter("point != pivot").select(F.least("point", "pivot").alias("a"), F.greatest("point", "pivot").alias("b"))
            pairs = star if pairs is None else pairs.union(star)
        compared = _compare(written(pairs.distinct(), "pairs"), rows, points, share, size)
        links.append(compared.filter("linked").select("a", "b"))
        labels = components(_all(links))
        if not crowded:
            break
        regions, open_ = _labelled(written(_regions(stars, compared, radius), "regions"), labels)
        again = open_.filter(F.col("all") > large) if level < LEVELS - 1 else open_.limit(0)
        again = written(again, "large")
        joined = _join_regions(regions, open_.join(again.select("region"), "region", "left_anti"), rows, points, share, size, held, passing)
        links.append(joined)
        # The regions left are cells again; their new pivots are outside the largest component.
        members = written(regions.join(again, "region").select(F.col("region").alias("cell"), "point"), "members")
        if not members.limit(1).count():
            labels = components(_all(links))
            break
        pairs = None
    named = points.join(labels, "point", "left").select("point", F.coalesce("component", "point").alias("component"), "rep")
    names = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_point = named.join(names, "component").select("point", "component_id")
    out = own.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("point")).alias("point")).join(by_point, "point", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """docs with one document of each component, the one of the smallest id.

    Of rows of one id whose texts are equal (null counts as empty) one stays; which one, where other
    columns differ, the smallest hash of all columns decides. Rows without an id stay where a component
    has no id at all. Null and empty texts link with nothing, so each id keeps its own. Columns of any
    name come back as they were."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = similarity_components(rows, percent=percent, size=size)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("id")).distinct()
    # All columns travel in one struct, so no name of theirs can clash.
    given = docs.select(F.col(doc_id).alias("id"), F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256).alias("same"), F.struct(*docs.columns).alias("row"))
    here = given.alias("d").join(kept.alias("k"), F.col("d.id").eqNullSafe(F.col("k.id")), "left_semi")
    one = here.groupBy("id", "same").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
