"""Dictionary matching: tokens meet a small lexicon by equality; fuzzy scores are computed once for each
distinct pair of keys, blocked by first letter and length, so their cost follows the vocabulary."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.text import fold, romanize, skeleton, tokens

# --- fixed values: thresholds of the fuzzy match ---
FUZZY_LENGTH, FUZZY_RATIO, SKELETON_LENGTH, SKELETON_RATIO, SUBSEQUENCE_SHARE, SUBSEQUENCE_SCORE, ACCEPT, LENGTH_GAP = 5, 0.82, 3, 0.80, 0.60, 0.85, 0.80, 3
# --- end of the fixed values ---


def loaded(lines: DataFrame, fallback: tuple[str, ...] = ()) -> DataFrame:
    """(phrase) of lines (phrase): lower-cased, without spaces at the ends, distinct, in order; empty ones
    and nulls go. Where nothing is left the fallback's phrases stand in."""
    found = lines.select(F.trim(F.lower("phrase")).alias("phrase")).filter("phrase != ''").distinct()
    if fallback and not found.limit(1).count():
        found = lines.sparkSession.createDataFrame([(p,) for p in sorted(set(fallback))], "phrase string")
    return found.orderBy("phrase")


def compiled(lexicon: DataFrame) -> DataFrame:
    """(grp, phrase, weight, words): the folded words of each phrase; phrases that fold to nothing go."""
    words = F.split(fold(romanize(F.col("phrase"))), " ")
    return lexicon.withColumn("words", F.filter(words, lambda w: w != "")).filter(F.size("words") > 0)


def folded_tokens(segments: DataFrame, keep: tuple[str, ...] = ("media_id", "seg_idx")) -> DataFrame:
    """(keep..., pos, token): the segments' tokens, each folded by itself. A token that folds to nothing
    (a number) is left out but keeps its place, so the words around it are not neighbours."""
    words = F.transform(tokens(romanize(F.col("text"))), fold)
    return segments.select(*keep, F.posexplode(words).alias("pos", "token")).filter("token != ''")


def small(df: DataFrame, most: int = 50_000) -> DataFrame:
    """df, broadcast if it has no more rows than most; else left to the optimizer's choice of join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def exact_hits(tokens: DataFrame, lexicon: DataFrame, keep: tuple[str, ...] = ("media_id", "seg_idx")) -> DataFrame:
    """(keep..., grp, phrase, weight, n): how often each phrase's words stand one after another.

    Each token meets the phrase words that equal it; a phrase is there where all its words agree on
    the place it begins at."""
    each = lexicon.select("grp", "phrase", "weight", F.size("words").alias("need"), F.posexplode("words").alias("word_pos", "token"))
    met = tokens.join(small(each), "token").withColumn("begin", F.col("pos") - F.col("word_pos"))
    whole = met.groupBy(*keep, "grp", "phrase", "weight", "need", "begin").agg(F.count("*").alias("k")).filter("k = need")
    return whole.groupBy(*keep, "grp", "phrase", "weight").agg(F.count("*").alias("n"))


def similarity(a: str, b: str) -> float:
    """1 for equal keys, 0.85 for a long enough subsequence, else a ratio of matching blocks of the
    keys or of their consonants if it is high enough, else 0."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    short, long = sorted((a, b), key=len)
    if len(long) >= FUZZY_LENGTH and len(short) >= SUBSEQUENCE_SHARE * len(long) and short[0] == long[0]:
        letters = iter(long)
        if all(c in letters for c in short):
            return SUBSEQUENCE_SCORE
    for x, y, least, enough in ((a, b, FUZZY_LENGTH, FUZZY_RATIO), (_consonants(a), _consonants(b), SKELETON_LENGTH, SKELETON_RATIO)):
        if min(len(x), len(y)) >= least and (ratio := SequenceMatcher(None, x, y).ratio()) >= enough:
            return ratio
    return 0.0


def _consonants(key: str) -> str:
    return "".join(c for c in key if c not in "aeiou \t\n")


def similarities(a: Column, b: Column) -> Column:
    """similarity, for columns: a batch of distinct pairs at a time."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([similarity(p, q) for p, q in zip(x, y, strict=True)], dtype=float)

    return run(a, b)


def fuzzy_pairs(tokens: DataFrame, lexicon: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """(token, entry, score): distinct tokens that no entry equals, with the entries like them. Entries
    are single folded words; both sides are distinct, so this follows the vocabulary, not the text."""
    entries = lexicon.filter(F.size("words") == 1).select(F.get("words", F.lit(0)).alias("entry")).distinct()
    new = tokens.select("token").distinct().join(small(entries), F.col("token") == F.col("entry"), "left_anti")
    block = lambda c: F.substring(c, 1, 1)
    near = new.withColumn("b", block("token")).join(small(entries.withColumn("b", block("entry"))), "b").filter(F.abs(F.length("token") - F.length("entry")) <= LENGTH_GAP)
    return near.select("token", "entry", similarities(F.col("token"), F.col("entry")).alias("score")).filter(F.col("score") >= accept)


def _grams(c: Column) -> Column:
    """The pairs of letters that stand side by side in a key."""
    return F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(2))), lambda g: F.length(g) == 2)


def _blocks(c: Column) -> Column:
    """Two keys whose similarity reaches ACCEPT share one of these: the first letter (equal keys and
    subsequences), or two letters side by side of the keys or of their consonants. Of keys of p and q letters
    with a ratio of 0.8, at least 0.4 (p + q) letters match, with 0.2 (p + q) breaks at most, so if p + q is
    over 5, some matching letters are neighbours in both."""
    return F.explode(F.array_distinct(F.concat(F.array(F.concat(F.lit("1"), F.substring(c, 1, 1))), F.transform(_grams(c), lambda g: F.concat(F.lit("k"), g)), F.transform(_grams(skeleton(c)), lambda g: F.concat(F.lit("s"), g)))))


def word_matches(found: DataFrame, lexicon: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """(token, word): distinct tokens with the words of phrases of several words that are like them."""
    words = lexicon.filter(F.size("words") > 1).select(F.explode("words").alias("word")).distinct()
    a, b = found.select("token").distinct().withColumn("b", _blocks(F.col("token"))), words.withColumn("b", _blocks(F.col("word")))
    near = a.join(small(b), "b").select("token", "word").distinct()
    return near.filter(similarities(F.col("token"), F.col("word")) >= accept)


def fuzzy_hits(found: DataFrame, lexicon: DataFrame, keep: tuple[str, ...] = ("media_id", "seg_idx"), accept: float = ACCEPT) -> DataFrame:
    """(keep..., grp, phrase, weight, n) for folded tokens, misspelt ones too: a token that equals no entry of
    one word counts for every such entry like it, and a phrase of several words stands wherever each of its
    words is like the token at its place. Scores are of distinct keys; only their matches meet the text."""
    one = lexicon.filter(F.size("words") == 1).select("grp", "phrase", "weight", F.get("words", F.lit(0)).alias("entry"))
    same = one.select("entry").distinct().select(F.col("entry").alias("token"), "entry")
    like = same.unionByName(fuzzy_pairs(found, lexicon, accept).select("token", "entry"))
    single = found.join(small(like.join(small(one), "entry").drop("entry")), "token").select(*keep, "grp", "phrase", "weight")
    several = lexicon.filter(F.size("words") > 1).select("grp", "phrase", "weight", F.size("words").alias("need"), F.posexplode("words").alias("word_pos", "word"))
    met = found.join(small(word_matches(found, lexicon, accept).join(small(several), "word")), "token").withColumn("begin", F.col("pos") - F.col("word_pos"))
    whole = met.groupBy(*keep, "grp", "phrase", "weight", "need", "begin").agg(F.count("*").alias("k")).filter("k = need")
    return single.union(whole.select(*keep, "grp", "phrase", "weight")).groupBy(*keep, "grp", "phrase", "weight").agg(F.count("*").alias("n"))


def group_scores(hits: DataFrame, keep: tuple[str, ...] = ("media_id", "seg_idx")) -> DataFrame:
    """(keep..., grp, score): weight times count, summed."""
    return hits.groupBy(*keep, "grp").agg(F.sum(F.col("weight") * F.col("n")).alias("score"))


def views(lexicon: DataFrame) -> DataFrame:
    """(phrase, first_group, last_weight, groups): a flat view; the first group and the last weight win."""
    order = F.struct("nth")
    return lexicon.groupBy("phrase").agg(F.min_by("grp", order).alias("first_group"), F.max_by("weight", order).alias("last_weight"), F.count("*").alias("groups"))


def genre_intent(texts: DataFrame, genres: tuple[tuple[str, str, float], ...], category: Column, most: float = 3.5) -> DataFrame:
    """texts (with text) with primary_genre, genre_score, keywords, confidence, fit. A keyword counts if
    the text's words, joined by spaces, contain it; the first genre wins ties. The keywords are a small
    literal, so there is no join."""
    joined = F.concat_ws(" ", F.regexp_extract_all(F.lower(romanize(F.col("text"))), F.lit("[a-z0-9]+"), F.lit(0)))
    names = list(dict.fromkeys(g for g, _, _ in genres))
    out = texts.withColumn("_t", joined)
    scores = []
    for i, genre in enumerate(names):
        own = [(k, w) for g, k, w in genres if g == genre]
        hits = F.filter(F.array(*[F.lit(k) for k, _ in own]), lambda k: F.contains(F.col("_t"), k))
        score = sum((F.when(F.contains(F.col("_t"), F.lit(k)), w).otherwise(0.0) for k, w in own), F.lit(0.0))
        scores.append(F.struct(score.alias("score"), F.lit(-i).alias("rank"), F.lit(genre).alias("genre"), hits.alias("hits")))
    out = out.withColumn("_b", F.array_max(F.transform(F.array(*scores), lambda s: F.struct(F.round(s["score"], 9).alias("score"), s["rank"].alias("rank"), s["genre"].alias("genre"), s["hits"].alias("hits")))))
    b, empty = F.col("_b"), F.coalesce(F.col("text"), F.lit("")) == ""
    fit = F.when(F.contains(b["genre"], F.lower(category)) | F.contains(F.lower(category), b["genre"]), 1.25).otherwise(1.0)
    found = {
        "primary_genre": F.when(empty, "default").when(b["score"] > 0, b["genre"]).otherwise("general"),
        "genre_score": F.when(empty, 0.5).otherwise(F.round(F.least(F.lit(1.0), b["score"] / most), 3)),
        "keywords": F.when(empty, F.lit("")).otherwise(F.concat_ws(",", F.slice(b["hits"], 1, 6))),
        "confidence": F.when(empty, 0.5).otherwise(F.round(F.least(F.lit(1.0), F.size(b["hits"]) * 0.25), 3)),
        "fit": F.when(empty, 1.0).otherwise(fit),
    }
    return out.withColumns(found).drop("_t", "_b")


def keys(words: DataFrame) -> DataFrame:
    """(word) with its folded key and skeleton."""
    return words.withColumn("key", fold(F.col("word"))).withColumn("skeleton", skeleton(F.col("key")))
