"""Queries on transcript segments, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import speech as ops
from tideline.plans.dims import EMOTIONS, HOOKS
from tideline.plans.signals import rounded
from tideline.sources import model

TOKEN = "[A-Za-zऀ-ॿ0-9]+"


def timed_sql(lines: str) -> str:
    return f"""seg AS (SELECT media_id, seg_idx, text, wc AS word_count, coalesce(sum(wc) OVER (PARTITION BY media_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / 2.5 AS seg_start,
  sum(wc) OVER (PARTITION BY media_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE / 2.5 AS seg_end, wc::DOUBLE / 2.5 AS duration, CASE WHEN wc > 0 THEN 150.0::DOUBLE ELSE 0.0::DOUBLE END AS wpm
  FROM (SELECT media_id, seg_idx, text, len(regexp_extract_all(text, '{TOKEN}')) AS wc FROM ({lines})))"""


SEG = timed_sql("SELECT conv_id AS media_id, turn AS seg_idx, text FROM conversations")
SENT = timed_sql("SELECT media_id, k - 1 AS seg_idx, trim(parts[k]) AS text FROM (SELECT doc_id AS media_id, regexp_split_to_array(text, '[.!?\\n]+') AS parts, unnest(range(1, len(regexp_split_to_array(text, '[.!?\\n]+')) + 1)) AS k FROM documents) WHERE trim(parts[k]) <> ''")
GRID = "gr AS (SELECT media_id, unnest(range(0, CAST(ceil(last) AS BIGINT))) AS t FROM (SELECT media_id, max(seg_end) AS last FROM seg GROUP BY 1) WHERE last > 0)"
WORDS = "wt AS (SELECT media_id, seg_idx, nth, seg_start + (nth + 0.5::DOUBLE) * duration / word_count AS t FROM (SELECT *, unnest(range(0, word_count)) AS nth FROM seg WHERE word_count > 0))"
FLAT_ONE = "CASE WHEN max({0}) OVER m - min({0}) OVER m >= 1e-8 THEN ({0} - min({0}) OVER m) / (max({0}) OVER m - min({0}) OVER m) WHEN max({0}) OVER m > 1e-8 THEN 1.0 ELSE 0.0 END"
MET = "FROM gr LEFT JOIN seg ON seg.media_id = gr.media_id AND seg_end > gr.t AND seg_start < gr.t + 5"
SAID = f"said AS (SELECT gr.media_id, gr.t, coalesce(string_agg(text, ' ' ORDER BY seg_idx), '') AS said, coalesce(sum(CASE WHEN wpm > 180 THEN 3.0 WHEN wpm > 150 THEN 1.5 ELSE 0 END), 0) AS fast {MET} GROUP BY 1, 2)"
OVER_MAX = "CASE WHEN max({0}) OVER (PARTITION BY media_id) > 0 THEN {0} / max({0}) OVER (PARTITION BY media_id) ELSE 0 END"
QUOTED = lambda w: "'" + w.replace("'", "''") + "'"


def windows(spark, sf):
    """Windows of 30 seconds, every 20."""
    ends = model.segments(spark, sf).groupBy("media_id").agg(F.max("seg_end").alias("last"))
    each = ends.filter("last > 0").select("media_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor("last").cast("long"), F.lit(20).cast("long"))).alias("a"))
    return each.select("media_id", F.col("a").cast("double").alias("w_start"), (F.col("a") + 30).cast("double").alias("w_end"))


EMOTION_RAW = (
    "2.0 * (length(said) - length(replace(said, '!', ''))) + 1.5 * (length(said) - length(replace(said, '?', ''))) + CASE WHEN contains(said, '!!') THEN 3.0 ELSE 0 END + CASE WHEN contains(said, '??') THEN 2.0 ELSE 0 END"
    + " + 1.5 * (" + " + ".join(f"CAST(contains(lower(said), {QUOTED(w)}) AS INT)" for w in EMOTIONS) + ")"
    + " + 2.0 * len(list_filter(regexp_split_to_array(said, '\\s+'), lambda w: length(w) >= 3 AND upper(w) = w AND regexp_matches(w, '\\p{Lu}'))) + fast"
)

QUERIES = {
    "segments_from_turns": (lambda s, sf: model.segments(s, sf), f"WITH {SEG} SELECT media_id, seg_idx, text, CAST(word_count AS BIGINT) AS word_count, seg_start, seg_end, duration, wpm FROM seg"),
    "segments_from_documents": (
        lambda s, sf: model.sentences(s, sf).groupBy("media_id").agg(F.count("*").alias("sentences"), F.sum("word_count").alias("words"), F.round(F.max("seg_end"), 6).alias("seconds")),
        f"WITH {SENT} SELECT media_id, count(*) AS sentences, CAST(sum(word_count) AS BIGINT) AS words, round(max(seg_end), 6) AS seconds FROM seg GROUP BY 1",
    ),
    "word_timestamps": (lambda s, sf: rounded(ops.word_times(model.segments(s, sf)), "t"), f"WITH {SEG}, {WORDS} SELECT media_id, seg_idx, nth, round(t, 6) AS t FROM wt"),
    "speech_density": (
        lambda s, sf: rounded(ops.speech_density(model.segments(s, sf)), "density"),
        f"""WITH {SEG}, {GRID}, {WORDS}, c AS (SELECT gr.media_id, gr.t, count(wt.t) AS words FROM gr LEFT JOIN wt ON wt.media_id = gr.media_id AND wt.t >= gr.t AND wt.t < gr.t + 5 GROUP BY 1, 2)
SELECT media_id, t, words, round({FLAT_ONE.format('words')}, 6) AS density FROM c WINDOW m AS (PARTITION BY media_id)""",
    ),
    "speech_pace": (
        lambda s, sf: rounded(ops.speech_pace(model.segments(s, sf)), "pace"),
        f"""WITH {SEG}, {GRID}, o AS (SELECT gr.media_id, gr.t, greatest(0.0, least(seg_end, gr.t + 5) - greatest(seg_start, gr.t)) AS o, wpm {MET}),
p AS (SELECT media_id, t, round(CASE WHEN sum(o) > 0 THEN sum(o * wpm) / sum(o) ELSE 0.0 END, 6) AS raw FROM o GROUP BY 1, 2)
SELECT media_id, t, raw, round({FLAT_ONE.format('raw')}, 6) AS pace FROM p WINDOW m AS (PARTITION BY media_id)""",
    ),
    "speech_summary": (
        lambda s, sf: ops.speech_summary(model.segments(s, sf)),
        f"WITH {SEG} SELECT media_id, count(*) AS n_segments, CAST(sum(word_count) AS BIGINT) AS words, string_agg(text, ' ' ORDER BY seg_idx) AS transcript, CASE WHEN max(seg_end) > 0 THEN round(sum(word_count) / max(seg_end) * 60, 2) ELSE 0 END AS avg_wpm FROM seg GROUP BY 1",
    ),
    "hook_scores": (
        lambda s, sf: rounded(ops.hook_scores(model.segments(s, sf), HOOKS), "score"),
        f"""WITH {SEG}, {GRID}, {SAID}, h AS (SELECT media_id, t, CAST({' + '.join(f'CAST(contains(lower(said), {QUOTED(h)}) AS INT)' for h in HOOKS)} AS BIGINT) AS hooks FROM said)
SELECT media_id, t, hooks, round({OVER_MAX.format('hooks')}, 6) AS score FROM h""",
    ),
    "emotion_scores": (
        lambda s, sf: rounded(ops.emotion_scores(model.segments(s, sf), EMOTIONS), "raw", "score"),
        f"WITH {SEG}, {GRID}, {SAID}, e AS (SELECT media_id, t, CAST({EMOTION_RAW} AS DOUBLE) AS raw FROM said) SELECT media_id, t, round(raw, 6) AS raw, round({OVER_MAX.format('raw')}, 6) AS score FROM e",
    ),
    "window_snippet": (
        lambda s, sf: ops.window_snippet(model.segments(s, sf), windows(s, sf)),
        f"""WITH {SEG}, win AS (SELECT media_id, CAST(a AS DOUBLE) AS w_start, CAST(a + 30 AS DOUBLE) AS w_end FROM (SELECT media_id, unnest(range(0, CAST(floor(last) AS BIGINT) + 1, 20)) AS a FROM (SELECT media_id, max(seg_end) AS last FROM seg GROUP BY 1) WHERE last > 0)),
j AS (SELECT w.media_id, w_start, w_end, trim(coalesce(string_agg(text, ' ' ORDER BY seg_idx), '')) AS said FROM win w LEFT JOIN seg ON seg.media_id = w.media_id AND seg_end > w_start AND seg_start < w_end GROUP BY 1, 2, 3),
c AS (SELECT media_id, w_start, w_end, CASE WHEN length(said) > 150 THEN substring(said, 1, 147) || '...' ELSE said END AS snippet FROM j),
n AS (SELECT *, greatest(1, len(list_filter(regexp_split_to_array(snippet, '\\s+'), lambda w: w <> ''))) AS n FROM c)
SELECT media_id, w_start, w_end, snippet, round((length(snippet) - length(replace(snippet, '!', ''))) / n, 6) AS exclaims, round((length(snippet) - length(replace(snippet, '?', ''))) / n, 6) AS asks FROM n""",
    ),
}
