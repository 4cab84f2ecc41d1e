"""URL filters by a sort-merge range join.

A host's labels are reversed and each closed with a comma (``com,example,www,``), so a host rule is
a prefix and the hosts it fits are one interval of sorted keys. URLs are range-partitioned and
sorted by key; a sweep over each partition keeps the stack of host rules whose intervals are open,
which are always nested. Each stack entry holds its path prefixes; the longest rule (host and path
together, then the longer host) that fits decides.

Rows are dealt by (key, salt), so a host with a third of all URLs still spreads over partitions.
Rules are taken in blocks of at most ``BLOCK_RULES``, one sweep over the same sorted partitions for
each block, so what is sent to executors is bounded whatever the number of rules.

Edge cases: a null URL, or one without ``://``, has an empty host and path and fits no rule; equal
rules with different verdicts resolve to block; other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATTERN = r"(?s)^.*?://([^/?#]*)([^?#]*)"
BLOCK_RULES = 100_000

Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PATTERN, 1), UPPER, SMALL)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PATTERN, 2)


def key_of(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(",")))


def rule_key(host: str) -> str:
    return ",".join(reversed(host.split("."))) + ","


def prepare(rules: Iterable[Rule]) -> list[tuple[str, list[tuple[str, str, str]]]]:
    """Sorted (key, [(path, rule, verdict)] by falling path length)."""
    by_key: dict[str, dict[str, tuple[str, str]]] = {}
    for verdict, host, path in rules:
        host = host.translate(str.maketrans(UPPER, SMALL))
        old = by_key.setdefault(rule_key(host), {}).get(path)
        by_key[rule_key(host)][path] = (host + path, "block" if old and "block" in (old[1], verdict) else verdict)
    return [(k, sorted(((p, *v) for p, v in paths.items()), key=lambda x: (-len(x[0]), x[0]))) for k, paths in sorted(by_key.items())]


def sweep(rows: Iterable[tuple[str, str]], rules: list[tuple[str, list[tuple[str, str, str]]]]) -> Iterable[tuple[str, str] | None]:
    """The (rule, verdict) of each (key, path), in ascending order of key. The stack holds (key,
    paths) of the nested rules open at the present key."""
    stack: list[tuple[str, list[tuple[str, str, str]]]] = []
    at = 0
    last, seen = None, {}
    for key, path in rows:
        if key != last:
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            while at < len(rules) and rules[at][0] <= key:
                while stack and not rules[at][0].startswith(stack[-1][0]):
                    stack.pop()
                if key.startswith(rules[at][0]):
                    stack.append(rules[at])
                at += 1
            last, seen = key, {}
        if not stack:
            yield None
            continue
        if path not in seen:
            best = None
            for _, paths in reversed(stack):  # longer hosts first, so they win ties
                for prefix, rule, verdict in paths:
                    if path.startswith(prefix):
                        if best is None or len(rule) > len(best[0]):
                            best = (rule, verdict)
                        break
            if len(seen) > 10_000:
                seen = {}
            seen[path] = best
        yield seen[path]


def blocks(rules: Iterable[Rule]) -> Iterable[list[Rule]]:
    block: list[Rule] = []
    for rule in rules:
        block.append(rule)
        if len(block) >= BLOCK_RULES:
            yield block
            block = []
    if block:
        yield block


def judge(df: DataFrame, rules: Iterable[Rule] | DataFrame, url: str = "url", key: str = "page_id", default: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict). rules: (verdict, host, path), or a DataFrame of them."""
    if isinstance(rules, DataFrame):
        rules = ((r[0], r[1], r[2]) for r in rules.select("verdict", "host", "path").toLocalIterator())
    spark = df.sparkSession
    key_type = df.schema[key].dataType.simpleString()
    u = F.col(url).cast("string")
    rows = df.select(F.col(key).alias("id"), host_of(u).alias("host"), path_of(u).alias("path"))
    rows = rows.select("id", "host", "path", key_of(F.col("host")).alias("key"), F.xxhash64("id").alias("salt"))
    none = F.lit(None).cast("string")
    rows = rows.repartitionByRange("key", "salt").sortWithinPartitions("key").select("id", "host", "path", "key", none.alias("rule"), none.alias("verdict"))
    for block in blocks(rules):
        shared = spark.sparkContext.broadcast(prepare(block))

        def run(batches, shared=shared):
            # One lazy sweep over the partition: the stack carries on from batch to batch.
            pending: list[pa.RecordBatch] = []

            def keys():
                for batch in batches:
                    pending.append(batch)
                    yield from zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)

            found = sweep(keys(), shared.value)
            for first in found:
                batch = pending.pop()
                best = [first, *(next(found) for _ in range(batch.num_rows - 1))]
                old_rule, old_verdict = batch.column(4).to_pylist(), batch.column(5).to_pylist()
                new = [(r, v) if b is None or r is not None and len(r) >= len(b[0]) else b for b, r, v in zip(best, old_rule, old_verdict, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([x[0] for x in new], pa.string()), pa.array([x[1] for x in new], pa.string())], names=["id", "host", "path", "key", "rule", "verdict"])

        rows = rows.mapInArrow(run, f"id {key_type}, host string, path string, key string, rule string, verdict string")
    return rows.select(F.col("id").alias(key), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
