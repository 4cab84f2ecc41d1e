"""Training-order materialisation of token sequences as fixed-stride binary shards.

Texts are encoded with a byte-level vocabulary, each closed by an end token, and packed one after
another into sequences of ``length`` tokens; the last sequence of an input partition is filled up with
end tokens. A first pass counts every partition's sequences, which numbers them 0..N-1. A keyed
Feistel permutation over the smallest even-width binary domain, walked along its cycles until it is
below N, gives each sequence its slot in training order. Slots are cut into shards; each shard is
written once, in order, by the task that has its range: slot s stands at byte (s mod per_shard) *
stride of shard s // per_shard. A reader needs no index: to resume, it seeks.

A shard is written under a name of its task's own and then renamed, so a task that is lost and run
again leaves the same file. The writer checks that each shard's slots are complete; a partitioning that
changed between the passes is an error, never a wrong file.

Edge cases: null and empty texts are a lone end token; without documents there are no shards; long
texts run over as many sequences as they need; repeated ids are listed as they come.
"""

from __future__ import annotations

import base64
import math
import os
import zlib
from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vectext import mix

LENGTH = 1024
PER_SHARD = 4096
KEY = 0x5DEECE66D
ROUNDS = 6


def feistel(index: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """The slots of these indices: a permutation of 0..n-1 that depends on key."""
    half = max(1, math.ceil(max(1, (max(n, 2) - 1).bit_length()) / 2))
    low = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key & (1 << 64) - 1))
    out = index.astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        left, right = out[walk] >> np.uint64(half), out[walk] & low
        for k in keys:
            left, right = right, left ^ (mix(right + k) & low)
        out[walk] = left << np.uint64(half) | right
        walk = walk[out[walk] >= n]
    return out.astype(np.int64)


def unfeistel(slot: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """The inverse of feistel."""
    half = max(1, math.ceil(max(1, (max(n, 2) - 1).bit_length()) / 2))
    low = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key & (1 << 64) - 1))
    out = slot.astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        left, right = out[walk] >> np.uint64(half), out[walk] & low
        for k in keys[::-1]:
            left, right = right ^ (mix(left + k) & low), left
        out[walk] = left << np.uint64(half) | right
        walk = walk[out[walk] >= n]
    return out.astype(np.int64)


@dataclass
class Vocabulary:
    """A rank file's pieces and the pattern that splits texts before the merges."""

    ranks: dict[bytes, int]
    pattern: str
    end: int

    def encoding(self):
        import tiktoken

        return tiktoken.Encoding("shards", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})


#: The public pattern of the byte-level vocabularies; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load(path: str, pattern: str = PATTERN) -> Vocabulary:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return Vocabulary(ranks, pattern, len(ranks))


class Encoder:
    """Tokens of a text and the end token."""

    def __init__(self, vocab: Vocabulary):
        self.encode = vocab.encoding().encode_ordinary
        self.kind = np.dtype(np.uint16 if vocab.end < 1 << 16 else np.uint32)
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.end = vocab.end

    def count(self, text: str | None) -> int:
        return len(self.encode(text or "")) + 1

    def text(self, text: str | None) -> array:
        out = array(self.code, self.encode(text or ""))
        out.append(self.end)
        return out


def _sequences(batches, vocab: Vocabulary, length: int, count_only: bool):
    """Yields (tokens by sequence as a matrix, [ids of the documents in each]); or the token count at the end."""
    encoder = Encoder(vocab)
    kind = encoder.kind
    rest, rest_docs, total = np.zeros(0, kind), [], 0
    for batch in batches:
        if count_only:  # copies are encoded once a batch, here and below
            copies = Counter(batch.column(1).to_pylist())
            total += sum(encoder.count(t) * n for t, n in copies.items())
            continue
        known: dict[str | None, array] = {}
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            encoded = []
            for t in part.column(1).to_pylist():
                if t not in known:
                    known[t] = encoder.text(t)
                encoded.append(known[t])
            lens = np.array([len(x) for x in encoded])
            shift = len(rest)
            tokens = np.concatenate([rest, *(np.frombuffer(x, kind) for x in encoded)])
            stops = np.cumsum(lens) + shift
            full = len(tokens) // length
            held: list[list] = [list(rest_docs) if i == 0 else [] for i in range(full + 1)]
            for d, a, b in zip(part.column(0).to_pylist(), ((stops - lens) // length).tolist(), ((stops - 1) // length).tolist(), strict=True):
                for i in range(a, b + 1):
                    held[i].append(d)
            if full:
                yield tokens[: full * length].reshape(full, length), held[:full]
            rest, rest_docs = tokens[full * length :].copy(), held[full] if len(tokens) > full * length else []
    if count_only:
        yield total
    elif len(rest):
        yield np.concatenate([rest, np.full(length - len(rest), vocab.end, kind)]).reshape(1, length), [rest_docs]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def shard_path(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:08d}.bin"


def materialise(docs: DataFrame, folder: str, vocab: Vocabulary, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the shards when the result is computed: a row for each sequence, (slot, shard, offset,
    n_tokens, crc32, doc_ids). folder is one that all executors share."""
    spark: SparkSession = docs.sparkSession
    pin = "spark.sql.files.minPartitionNum"  # else the splits of files follow the executors of the moment
    if spark.conf.get(pin, None) is None:
        spark.conf.set(pin, str(spark.sparkContext.defaultParallelism))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    id_type = docs.schema[doc_id].dataType.simpleString()
    shared = spark.sparkContext.broadcast(vocab)
    stride = length * (2 if vocab.end < 1 << 16 else 4)

    def count(batches):
        total = next(iter(_sequences(batches, shared.value, length, True)))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([-(-total // length)], pa.int64())], names=["part", "n"])

    # One row for each input partition: what the driver gets grows with the number of tasks only.
    counts = {r["part"]: r["n"] for r in rows.mapInArrow(count, "part int, n bigint").collect()}
    base, n = {}, 0
    for part in sorted(counts):
        base[part], n = n, n + counts[part]
    shards = -(-n // per_shard)
    bases = spark.sparkContext.broadcast(base)
    id_list = pa.list_({"int": pa.int32(), "string": pa.string()}.get(id_type, pa.int64()))

    def permute(batches):
        part = TaskContext.get().partitionId()
        at, most = bases.value[part], bases.value[part] + counts[part]
        for matrix, held in _sequences(batches, shared.value, length, False):
            if at + len(matrix) > most:
                raise RuntimeError("the input's partitions changed between the passes")
            slot = feistel(np.arange(at, at + len(matrix)), n, key)
            at += len(matrix)
            for lo in range(0, len(matrix), 2048):
                some = slice(lo, lo + 2048)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((slot[some] // per_shard).astype(np.int32)), pa.array(slot[some]), pa.array([m.tobytes() for m in matrix[some]], pa.binary()), pa.array(held[some], id_list)], names=["shard", "slot", "tokens", "doc_ids"]
                )

    def write(batches):
        system, root = _filesystem(folder)
        system.create_dir(root, recursive=True)
        own = f".{os.getpid()}-{TaskContext.get().taskAttemptId()}"
        out, shard, expected = None, None, 0

        def close():
            if out is not None:
                out.close()
                if expected != min(n, (shard + 1) * per_shard):
                    raise RuntimeError(f"shard {shard} is not complete")
                system.move(shard_path(root, shard) + own, shard_path(root, shard))

        for batch in batches:
            crcs = []
            for s, slot, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if s != shard:
                    close()
                    shard, expected = s, s * per_shard
                    out = system.open_output_stream(shard_path(root, s) + own)
                if slot != expected:
                    raise RuntimeError(f"slot {expected} is missing")
                expected += 1
                raw = tokens.as_py()
                crcs.append(zlib.crc32(raw))
                out.write(raw)
            slots = batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(0), pa.array(slots % per_shard * stride), pa.array(np.full(len(slots), length, np.int32)), pa.array(crcs, pa.int64()), batch.column(3)], names=["slot", "shard", "offset", "n_tokens", "crc32", "doc_ids"]
            )
        close()

    ids = f"array<{id_type if id_type in ('int', 'string') else 'bigint'}>"
    placed = rows.mapInArrow(permute, f"shard int, slot bigint, tokens binary, doc_ids {ids}")
    placed = placed.repartitionById(max(1, shards), F.col("shard")).sortWithinPartitions("slot")
    return placed.mapInArrow(write, f"slot bigint, shard int, offset bigint, n_tokens int, crc32 bigint, doc_ids {ids}")


def read(folder: str, start: int = 0, length: int = LENGTH, per_shard: int = PER_SHARD, wide: bool = False):
    """Yields (slot, tokens) in training order from a slot on, by seeking."""
    system, root = _filesystem(folder)
    kind = np.dtype(np.uint32 if wide else np.uint16)
    stride, slot = length * kind.itemsize, start
    while True:
        path = shard_path(root, slot // per_shard)
        if system.get_file_info(path).type.name != "File":
            return
        with system.open_input_file(path) as f:
            f.seek(slot % per_shard * stride)
            while len(raw := f.read(stride)) == stride:
                yield slot, np.frombuffer(raw, kind)
                slot += 1
        if slot % per_shard:
            return
