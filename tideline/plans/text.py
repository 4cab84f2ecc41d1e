"""Queries on texts and lexicons, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import text as fn
from tideline.operators import lexicon as ops
from tideline.plans import dims
from tideline.plans.speech import QUOTED, SEG
from tideline.sources import model

# The one-pass replacement, in SQL: the same units, looked up in a map.
UNITS = "|".join([*sorted(fn.FOLDS, key=lambda k: (-len(k), k)), "[\\s\\S]"])
FOLD_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in fn.FOLDS.items()) + "}"


def fold_sql(x: str) -> str:
    letters = f"regexp_replace(lower(coalesce({x}, '')), '[^a-z\\s]+', ' ', 'g')"
    return f"trim(regexp_replace(array_to_string(list_transform(regexp_extract_all({letters}, '{UNITS}'), lambda p: coalesce(({FOLD_MAP})[p], p)), ''), '\\s+', ' ', 'g'))"


LEX = f"lex(grp, phrase, weight) AS (VALUES {dims.sql_values(dims.LEXICON)})"
TOKENS = f"""tok AS (SELECT * FROM (SELECT media_id, seg_idx, w[k] AS token, k - 1 AS pos
FROM (SELECT media_id, seg_idx, w, unnest(range(1, len(w) + 1)) AS k
FROM (SELECT media_id, seg_idx, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-zऀ-ॿ0-9]+'), lambda t: {fold_sql('t')}) AS w FROM seg))) WHERE token <> '')"""
HITS = f"""lw AS (SELECT grp, phrase, weight, list_filter(string_split({fold_sql('phrase')}, ' '), lambda x: x <> '') AS words FROM lex),
le AS (SELECT grp, phrase, weight, len(words) AS need, words[k] AS token, k - 1 AS word_pos FROM (SELECT *, unnest(range(1, len(words) + 1)) AS k FROM lw)),
hit AS (SELECT media_id, seg_idx, grp, phrase, weight, count(*) AS n FROM (SELECT media_id, seg_idx, grp, phrase, weight, need, pos - word_pos AS b FROM tok JOIN le ON tok.token = le.token GROUP BY ALL HAVING count(*) = need) GROUP BY ALL)"""
GROUPS = "gs AS (SELECT media_id, seg_idx, grp, sum(weight * n) AS score FROM hit GROUP BY 1, 2, 3)"


def hits(spark, sf):
    segs = model.segments(spark, sf)
    return ops.exact_hits(ops.folded_tokens(segs), ops.compiled(dims.lexicon(spark)))


def fuzzy_hits(spark, sf):
    segs = model.segments(spark, sf)
    return ops.fuzzy_hits(ops.folded_tokens(segs), ops.compiled(dims.lexicon(spark)))


def words(spark, sf):
    docs = model.table(spark, sf, "documents")
    return docs.select(F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("word")).filter("word != ''").groupBy("word").agg(F.count("*").alias("docs"))


WORD_SQL = "wd AS (SELECT word, count(*) AS docs FROM (SELECT unnest(list_distinct(regexp_split_to_array(lower(text), '\\s+'))) AS word FROM documents) WHERE word <> '' GROUP BY 1)"


def romanized(spark, sf):
    """A fixture of Devanagari words, next to every conversation turn that holds none."""
    fixture = dims.rows(spark, [(w,) for w in ("भाई", "मारा", "क्या", "बवाल clutch", "ज़िंदगी", "हूँ", "कम॰ दिन", "plain text")], "text string")
    turns = model.segments(spark, sf).select("text")
    return fixture.unionByName(turns).select("text", fn.romanize(F.col("text")).alias("roman"))


def genres(spark, sf):
    segs = model.segments(spark, sf).withColumn("category", F.lit("Guide to music"))
    return ops.genre_intent(segs, dims.GENRES, F.col("category")).select("media_id", "seg_idx", "primary_genre", "genre_score", "keywords", "confidence", "fit")


_NAMES = list(dict.fromkeys(g for g, _, _ in dims.GENRES))
_JOINED = "array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')"
GENRE_SQL = (
    f"gv(genre, kw, weight, ord, kord) AS (VALUES {dims.sql_values([(g, k, w, _NAMES.index(g), i) for i, (g, k, w) in enumerate(dims.GENRES)])}),\n"
    f"gj AS (SELECT media_id, seg_idx, text, {_JOINED} AS j FROM seg),\n"
    "gsc AS (SELECT media_id, seg_idx, text, genre, ord, round(coalesce(sum(CASE WHEN contains(j, kw) THEN weight ELSE 0 END), 0), 9) AS score, count(*) FILTER (WHERE contains(j, kw)) AS hits, coalesce(list(kw ORDER BY kord) FILTER (WHERE contains(j, kw)), []) AS kws FROM gj CROSS JOIN gv GROUP BY ALL),\n"
    "gb AS (SELECT * FROM gsc QUALIFY row_number() OVER (PARTITION BY media_id, seg_idx ORDER BY score DESC, ord) = 1)"
)

QUERIES = {
    "tokenize_counts": (
        lambda s, sf: model.table(s, sf, "documents").select("doc_id", F.size(fn.tokens(F.col("text"))).cast("long").alias("tokens"), F.size(F.array_distinct(fn.tokens(F.col("text")))).cast("long").alias("distinct_tokens")),
        "SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-zऀ-ॿ0-9]+')) AS BIGINT) AS tokens, CAST(len(list_distinct(regexp_extract_all(text, '[A-Za-zऀ-ॿ0-9]+'))) AS BIGINT) AS distinct_tokens FROM documents",
    ),
    "numbers_questions": (
        lambda s, sf: model.table(s, sf, "documents").select("doc_id", F.size(fn.numbers(F.col("text"))).cast("long").alias("numbers"), fn.is_question(F.col("text")).alias("question")),
        f"SELECT doc_id, CAST(len(regexp_extract_all(text, '\\d+(?:\\.\\d+)?')) AS BIGINT) AS numbers, contains(text, '?') OR list_has_any(list_transform(regexp_extract_all(text, '[A-Za-zऀ-ॿ0-9]+'), lambda w: lower(w)), [{', '.join(map(QUOTED, fn.QUESTION_WORDS))}]) AS question FROM documents",
    ),
    "fold_keys": (lambda s, sf: ops.keys(words(s, sf)).select("word", "docs", "key"), f"WITH {WORD_SQL} SELECT word, docs, {fold_sql('word')} AS key FROM wd"),
    "skeleton_keys": (
        lambda s, sf: ops.keys(words(s, sf)).groupBy("skeleton").agg(F.count("*").alias("words"), F.sum("docs").alias("docs")),
        f"WITH {WORD_SQL} SELECT regexp_replace({fold_sql('word')}, '[aeiou\\s]', '', 'g') AS skeleton, count(*) AS words, CAST(sum(docs) AS BIGINT) AS docs FROM wd GROUP BY 1",
    ),
    "romanize": (romanized, None),
    "safe_path": (
        lambda s, sf: model.table(s, sf, "documents").select("doc_id", fn.safe_name(F.col("text")).alias("file"), fn.output_name(F.col("text"), F.col("doc_id") % 100, F.lit("reel"), F.lit(0.25)).alias("clip")),
        r"""SELECT doc_id, CASE WHEN cut = '' THEN 'untitled' ELSE cut END AS file, trim(substring(regexp_replace(t, '[^\p{L}\p{N} _-]', '_', 'g'), 1, 50)) || format('_clip{:02d}_reel_score0.25.mp4', doc_id % 100) AS clip
FROM (SELECT doc_id, t, CASE WHEN length(c) > 60 THEN regexp_replace(substring(c, 1, 60), '[. ]+$', '') ELSE c END AS cut
FROM (SELECT doc_id, substring(text, 1, 80) AS t, regexp_replace(regexp_replace(substring(text, 1, 80), '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '^[. ]+|[. ]+$', '', 'g') AS c FROM documents))""",
    ),
    "url_extract": (
        lambda s, sf: model.table(s, sf, "pages").select("page_id", fn.first_url(F.concat(F.lit("see "), F.col("url"), F.lit(" now")), r"[a-z0-9.-]*example\.(?:com|org)").alias("found")),
        r"SELECT page_id, nullif(regexp_extract('see ' || url || ' now', '(?i)(https?://(?:www\.|m\.)?(?:[a-z0-9.-]*example\.(?:com|org))/\S+)', 1), '') AS found FROM pages",
    ),
    "lexicon_hits_exact": (
        lambda s, sf: hits(s, sf).groupBy("media_id", "seg_idx", "grp").agg(F.sum("n").alias("n"), F.count("*").alias("phrases")),
        f"WITH {SEG}, {LEX}, {TOKENS}, {HITS} SELECT media_id, seg_idx, grp, CAST(sum(n) AS BIGINT) AS n, count(*) AS phrases FROM hit GROUP BY 1, 2, 3",
    ),
    "phrase_ngram_hits": (
        lambda s, sf: hits(s, sf).filter(F.contains("phrase", F.lit(" "))).select("media_id", "seg_idx", "grp", "phrase", "n"),
        f"WITH {SEG}, {LEX}, {TOKENS}, {HITS} SELECT media_id, seg_idx, grp, phrase, n FROM hit WHERE contains(phrase, ' ')",
    ),
    "group_scores": (
        lambda s, sf: ops.group_scores(hits(s, sf)).withColumn("score", F.round("score", 6)),
        f"WITH {SEG}, {LEX}, {TOKENS}, {HITS}, {GROUPS} SELECT media_id, seg_idx, grp, round(score, 6) AS score FROM gs",
    ),
    "lexicon_hits_fuzzy": (lambda s, sf: fuzzy_hits(s, sf).select("media_id", "seg_idx", "grp", "phrase", "n"), None),
    "group_scores_fuzzy": (lambda s, sf: ops.group_scores(fuzzy_hits(s, sf)).withColumn("score", F.round("score", 6)), None),
    "lexicon_views": (
        lambda s, sf: ops.views(dims.rows(s, [(*r, i) for i, r in enumerate((*dims.LEXICON, ("hype", "the", 0.3)))], "grp string, phrase string, weight double, nth int")),
        f"SELECT phrase, min_by(grp, nth) AS first_group, max_by(weight, nth) AS last_weight, count(*) AS groups FROM (VALUES {dims.sql_values([(*r, i) for i, r in enumerate((*dims.LEXICON, ('hype', 'the', 0.3)))])}) t(grp, phrase, weight, nth) GROUP BY 1",
    ),
    "fuzzy_match": (lambda s, sf: ops.fuzzy_pairs(ops.folded_tokens(model.segments(s, sf)), ops.compiled(dims.lexicon(s))).withColumn("score", F.round("score", 6)), None),
    "genre_intent": (
        genres,
        f"""WITH {SEG}, {GENRE_SQL} SELECT media_id, seg_idx, CASE WHEN text = '' THEN 'default' WHEN score > 0 THEN genre ELSE 'general' END AS primary_genre, CASE WHEN text = '' THEN 0.5 ELSE round(least(1.0, score / 3.5), 3) END AS genre_score,
array_to_string(kws[1:6], ',') AS keywords, CASE WHEN text = '' THEN 0.5 ELSE round(least(1.0, hits * 0.25), 3) END AS confidence, CASE WHEN contains('guide to music', genre) THEN 1.25 ELSE 1.0 END AS fit FROM gb""",
    ),
}
