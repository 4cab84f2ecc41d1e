"""Queries on spectra of the activity series (frames of a day) and the trained virality model."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import audio, story, virality_model
from tideline.plans.signals import SIG, rounded
from tideline.plans.windows import nine, nine_features
from tideline.sources import model

DAY = 24


def features(spark, sf):
    return audio.features(audio.spectra(model.signal(spark, sf), DAY))


# The discrete transform by its definition; bins 1..12 of 24 samples, in three bands of four.
SPECTRA = f"""{SIG},
fr AS (SELECT media_id, t // {DAY} AS frame, t % {DAY} AS i, v FROM sig QUALIFY count(*) OVER (PARTITION BY media_id, t // {DAY}) = {DAY}),
mg AS (SELECT media_id, frame, k, sqrt(pow(sum(v * cos(2 * pi() * k * i / {DAY})), 2) + pow(sum(v * sin(2 * pi() * k * i / {DAY})), 2)) AS m FROM fr, range(1, {DAY // 2 + 1}) r(k) GROUP BY 1, 2, 3),
cm AS (SELECT *, sum(m) OVER (PARTITION BY media_id, frame ORDER BY k) AS c, sum(m) OVER (PARTITION BY media_id, frame) AS total, lag(m) OVER (PARTITION BY media_id, k ORDER BY frame) AS before FROM mg),
bd AS (SELECT media_id, frame, avg(x) AS contrast FROM (SELECT media_id, frame, (k - 1) // 4 AS b, log10((max(m) + 1) / (min(m) + 1)) AS x FROM mg GROUP BY 1, 2, 3) GROUP BY 1, 2),
ft AS (SELECT cm.media_id, cm.frame AS t, sum(m * k) / sum(m) AS centroid, any_value(contrast) AS contrast, (count(*) FILTER (WHERE c < 0.85 * total) + 1)::DOUBLE AS rolloff, coalesce(sum(greatest(0.0, m - before)) FILTER (WHERE before IS NOT NULL), 0.0) AS flux
  FROM cm JOIN bd ON cm.media_id = bd.media_id AND cm.frame = bd.frame GROUP BY 1, 2)"""
_SC = lambda c: f"CASE WHEN max({c}) OVER m - min({c}) OVER m < 1e-8 THEN 0 ELSE ({c} - min({c}) OVER m) / (max({c}) OVER m - min({c}) OVER m) END"


def trained(spark, sf):
    rows = story.feature_vector(nine(spark, sf), nine_features())
    out = virality_model.predict(virality_model.train(virality_model.corpus(spark)), rows)
    return out.select("media_id", "w_start", F.round("virality", 4).alias("virality"), F.round("virality_ml", 4).alias("virality_ml"))


QUERIES = {
    "spectral_features": (
        lambda s, sf: rounded(features(s, sf), "centroid", "contrast", "rolloff", "flux", digits=5),
        f"WITH {SPECTRA} SELECT media_id, t, round(centroid, 5) AS centroid, round(contrast, 5) AS contrast, rolloff, round(flux, 5) AS flux FROM ft",
    ),
    "spectral_excitement": (
        lambda s, sf: rounded(audio.excitement(features(s, sf)), "spectral", "beat", digits=5),
        f"""WITH {SPECTRA}, sc AS (SELECT media_id, t, 0.40 * {_SC('centroid')} + 0.35 * {_SC('contrast')} + 0.25 * {_SC('rolloff')} AS s, {_SC('flux')} AS f FROM ft WINDOW m AS (PARTITION BY media_id)),
sm AS (SELECT media_id, t, sum(s) OVER (PARTITION BY media_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4 AS s, sum(f) OVER (PARTITION BY media_id ORDER BY t ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) / 2 AS b FROM sc)
SELECT media_id, t, round({_SC('s')}, 5) AS spectral, round({_SC('b')}, 5) AS beat FROM sm WINDOW m AS (PARTITION BY media_id)""",
    ),
    "gbt_virality": (trained, None),
}
