"""Queries on event streams; over a table they give what the finished stream would."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.sources import model
from tideline.streaming import density


def _times(df, *names):
    return df.withColumns({n: F.unix_seconds(n) for n in names})


QUERIES = {
    "hopping_activity": (
        lambda s, sf: _times(density.hopping(model.table(s, sf, "events")), "w_start", "w_end"),
        """WITH e AS (SELECT event_type, epoch_us(ts) // 3600000000 AS h, value FROM events)
SELECT event_type AS media_id, CAST(w AS BIGINT) * 3600 AS w_start, CAST(w + 5 AS BIGINT) * 3600 AS w_end, count(*) AS events, round(sum(value), 4) AS total FROM (SELECT event_type, value, unnest(range(h - 4, h + 1)) AS w FROM e) GROUP BY event_type, w""",
    ),
    "user_sessions": (
        lambda s, sf: density.sessions(model.table(s, sf, "events")).select("user_id", F.unix_micros("s_start").alias("s_start"), F.unix_micros("s_end").alias("s_end"), "events"),
        """WITH o AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 1800000000 THEN 0 ELSE 1 END AS fresh FROM events),
r AS (SELECT user_id, t, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT user_id, min(t) AS s_start, max(t) + 1800000000 AS s_end, count(*) AS events FROM r GROUP BY user_id, run""",
    ),
}
