"""Greedy selection of windows: exact folds over each media item's sorted candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _greedy(candidates: DataFrame, score: list[str], k: int, clashes) -> DataFrame:
    """(media_id, w_start, w_end, score columns) of the chosen, at most k for each media item."""
    keys = [(-F.col(s)).alias(f"_{i}") for i, s in enumerate(score)]
    row = F.struct(*keys, F.col("w_start").cast("double").alias("w_start"), F.col("w_end").cast("double").alias("w_end"))
    sorted_ = candidates.groupBy("media_id").agg(F.array_sort(F.collect_list(row)).alias("c"))
    take = lambda acc, x: F.when((F.size(acc) < k) & ~F.exists(acc, lambda s: clashes(x, s)), F.concat(acc, F.array(x))).otherwise(acc)
    chosen = sorted_.withColumn("c", F.aggregate("c", F.slice("c", 1, 0), take))
    out = chosen.select("media_id", F.explode("c").alias("x"))
    return out.select("media_id", F.col("x.w_start").alias("w_start"), F.col("x.w_end").alias("w_end"), *[(-F.col(f"x._{i}")).alias(s) for i, s in enumerate(score)])


def with_gap(candidates: DataFrame, k: int = 5, gap: float = 10.0, score: str = "score") -> DataFrame:
    """The best k that keep a gap from each other. Ties: the earlier start, then the earlier end."""
    return _greedy(candidates, [score], k, lambda x, s: (x["w_start"] < s["w_end"] + gap) & (x["w_end"] > s["w_start"] - gap))


def with_overlap(candidates: DataFrame, k: int = 5, most: float = 0.25, score: tuple[str, ...] = ("rank", "score")) -> DataFrame:
    """The best k of which none overlaps a better one by more than a share of the shorter."""

    def clashes(x, s):
        overlap = F.greatest(F.lit(0.0), F.least(x["w_end"], s["w_end"]) - F.greatest(x["w_start"], s["w_start"]))
        short = F.least(x["w_end"] - x["w_start"], s["w_end"] - s["w_start"])
        return (short > 0) & (overlap / short > most)

    return _greedy(candidates, list(score), k, clashes)


def surplus(candidates: DataFrame, k: int = 5, gap: float = 10.0, most: float = 0.25) -> DataFrame:
    """(media_id, w_start, w_end, score): twice as many as asked for without large overlaps, by rank and
    score; of these the best k by score that keep a gap."""
    pool = with_overlap(candidates, 2 * k, most)
    return with_gap(pool.select("media_id", "w_start", "w_end", "score"), k, gap)
