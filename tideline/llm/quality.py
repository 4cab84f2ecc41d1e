"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors: one hashed bucket for each word, for each character
3- and 4-gram of its words with their edges, and for each immediate repetition of a word. A softmax
over two classes follows. Vectors and weights are trained by numpy stochastic gradient descent
(AdaGrad steps) on a bounded sample of labelled documents. Because the average is linear, a trained
model is one number for each bucket, so scoring is a gather and a sum over a document's features.

Memory: 2**BITS floats on each executor, and the features of at most 2 * PER_CLASS documents on the
driver. Edge cases: null and empty texts have no features and get the score of the bias alone;
a corpus without labels of both classes gets the share of label 1 (0.5 if none) as every score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import through, trimmed
from .labelled import held_out, training_sample
from .vectext import SPACED, Words, find_words, fingerprint, text_blocks

BITS = 18
DIM = 8
PER_CLASS = 1500
EPOCHS, STEPS = 12, 15_000  # passes over the sample, and steps at least
RATE = 0.3
GRAMS = (3, 4)
_REPEAT = 1  # the bucket of repetitions


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint32(0x9E3779B1)) ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)


def features(buf: np.ndarray, offsets: np.ndarray):
    """Yields (buckets, byte place of each feature) for a block of texts; case counts."""
    words: Words = find_words(buf, offsets, SPACED, fingerprints=False)
    if not len(words.start):
        return
    h = fingerprint(buf, words.start, words.end)
    yield (h >> np.uint64(64 - BITS)).astype(np.int64), words.start
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    inner = words.first[1:-1]
    same[inner[inner < len(h)]] = False
    yield np.full(int(same.sum()), _REPEAT, np.int64), words.start[same]
    inside = SPACED[buf]
    flat = np.where(inside, buf, np.uint8(32)).astype(np.uint32)
    n = len(flat)
    for size in GRAMS:
        if n < size:
            continue
        ok = np.ones(n - size + 1, bool)
        for k in range(1, size - 1):  # an edge may stand at either end, not inside
            ok &= inside[k : n - size + 1 + k]
        for k in range(1, size):
            cut = offsets[1:-1] - k
            ok[cut[(cut >= 0) & (cut < len(ok))]] = False
        g = np.full(n - size + 1, np.uint32(size))
        for k in range(size):
            g = g * np.uint32(0x01000193) + flat[k : n - size + 1 + k]
        at = np.flatnonzero(ok)
        yield _bucket(g[at]).astype(np.int64), at


@dataclass
class Model:
    value: np.ndarray  # logit of label 1 by bucket, averaged over a document
    bias: float

    def score(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        total, count = np.zeros(n), np.zeros(n)
        for buckets, at in features(buf, offsets):
            cum = np.concatenate([[0.0], np.cumsum(self.value[buckets], dtype=np.float64)])
            edge = np.searchsorted(at, offsets)
            total += cum[edge[1:]] - cum[edge[:-1]]
            count += np.diff(edge)
        logit = total / np.maximum(count, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def train(bags: list[tuple[int, np.ndarray, np.ndarray]], counts: dict[int, int], seed: int = 7) -> Model:
    """bags: (label, buckets, counts) by document. counts: labels by class in the whole corpus, from
    which each class's rows get their weight."""
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    have = [sum(b[0] == k for b in bags) for k in (0, 1)]
    if not have[0] or not have[1]:
        share = n1 / (n0 + n1) if n0 + n1 else 0.5
        return Model(np.zeros(1 << BITS, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    weight = [n0 / (n0 + n1) / have[0] * len(bags), n1 / (n0 + n1) / have[1] * len(bags)]
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out = rng.uniform(-1 / DIM, 1 / DIM, (DIM, 2)).astype(np.float32)
    bias = np.log(np.array([n0, n1], np.float32) / (n0 + n1))
    seen_v, seen_o, seen_b = np.full(1 << BITS, 1e-8, np.float32), np.full((DIM, 2), 1e-6, np.float32), np.full(2, 1e-2, np.float32)
    shares = [(c / c.sum()).astype(np.float32) for _, _, c in bags]
    for _ in range(max(EPOCHS, -(-STEPS // len(bags)))):
        for i in rng.permutation(len(bags)):
            label, buckets, _ = bags[i]
            share = shares[i]
            mean = share @ vectors[buckets]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            p *= weight[label]
            back, grad = out @ p, np.outer(mean, p)
            norm = share * np.float32(np.sqrt(back @ back / DIM))
            seen_v[buckets] += norm * norm
            vectors[buckets] -= (RATE * share / np.sqrt(seen_v[buckets]))[:, None] * back
            seen_o += grad * grad
            out -= RATE * grad / np.sqrt(seen_o)
            seen_b += p * p
            bias -= RATE * p / np.sqrt(seen_b) * 0.1
    touched = np.zeros(1 << BITS, bool)
    for _, buckets, _ in bags:
        touched[buckets] = True
    value = vectors @ (out[:, 1] - out[:, 0])
    value[~touched] = 0  # a feature that no training text has says nothing
    return Model(value.astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 5, remainder: int = 0, per_class: int = PER_CLASS) -> Model:
    sample, counts = training_sample(docs, labels, label, mod, remainder, per_class)

    def bag(batches):
        for batch in batches:
            for lo, hi, buf, offsets in text_blocks(batch.column(1)):
                found = list(features(buf, offsets))
                rows = []
                for d in range(hi - lo):
                    own = [b[slice(*np.searchsorted(at, offsets[d : d + 2]))] for b, at in found]
                    ids, n = np.unique(np.concatenate(own) if own else np.zeros(0, np.int64), return_counts=True)
                    rows.append((ids.astype(np.int32).tobytes(), n.astype(np.float32).tobytes()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["label", "ids", "n"])

    rows = sample.select("label", "text").mapInArrow(bag, "label int, ids binary, n binary").toLocalIterator()
    bags = [(r["label"], np.frombuffer(r["ids"], np.int32), np.frombuffer(r["n"], np.float32)) for r in rows if r["ids"]]
    bags.sort(key=lambda b: (b[0], len(b[1]), b[1].tobytes()))
    return train(bags, counts)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score): the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offsets in text_blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(shared.value.score(buf, offsets))], names=["doc_id", "score"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(trimmed(run), f"doc_id {id_type}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, mod: int = 5, remainder: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    out = score(docs, fit(docs, labels, mod=mod, remainder=remainder))
    return out.select("doc_id", held_out(mod, remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """docs without the texts that score below threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def change(batch):
        keep = np.ones(batch.num_rows, bool)
        for lo, hi, buf, offsets in text_blocks(batch.column(place)):
            keep[lo:hi] = shared.value.score(buf, offsets) >= threshold
        return batch if keep.all() else batch.filter(pa.array(keep))

    return through(docs, change)
