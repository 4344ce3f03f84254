"""Queries over streams: events arrive in files, a stream takes them in batches, and the stored result is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import new_path
from ..streaming import live
from .catalog import micros, query


def _events(t) -> DataFrame:
    at = F.timestamp_micros(micros("ts"))  # as UTC, whatever the session's time zone
    rows = t("events").select("event_id", at.alias("ts"), "user_id", "event_type", "value")
    return live.arrivals(rows, "ts", new_path(rows.sparkSession, "arrivals"))


def _run(stream: DataFrame) -> DataFrame:
    spark = stream.sparkSession
    return live.run(stream, new_path(spark, "live"), new_path(spark, "live-checkpoint"))


@query("""SELECT event_type, epoch_us(w) // 1000000 AS start, count(*) AS n, CAST(max(value) AS DOUBLE) AS most FROM
    (SELECT event_type, value, unnest([time_bucket(INTERVAL 30 MINUTES, ts), time_bucket(INTERVAL 30 MINUTES, ts) - INTERVAL 30 MINUTES]) AS w FROM events) GROUP BY event_type, w""")
def live_sliding_windows(t):
    """Events of each type in hours that begin every half hour, from a stream."""
    found = live.sliding(_events(t), ["event_type"], "ts", "1 hour", "30 minutes", "10 minutes", F.count(F.lit(1)).alias("n"), F.max("value").alias("most"))
    return _run(found).filter("event_type is not null").select("event_type", F.unix_seconds("start").alias("start"), "n", "most")


_STRETCHES = """SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
    (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) {silent} THEN 1 ELSE 0 END AS new FROM events)"""


@query(f"SELECT user_id, min(epoch_us(ts)) AS start, count(*) AS n FROM ({_STRETCHES.format(silent='>= 21600000000')}) GROUP BY user_id, s")
def live_sessions(t):
    """Each user's stretches without six silent hours, from a stream."""
    found = live.sessions(_events(t), ["user_id"], "ts", "6 hours", "10 minutes", F.count(F.lit(1)).alias("n"))
    return _run(found).filter("user_id is not null").select("user_id", F.unix_micros("start").alias("start"), "n")


_STEP = "CASE WHEN f.s = r.s THEN list_transform(list_zip(f.v, r.x), lambda z: z[1] * (least(f.n, 20) / (least(f.n, 20) + 1)) + z[2] / (least(f.n, 20) + 1)) ELSE r.x END"


@query(f"""WITH RECURSIVE r AS (SELECT user_id, event_id, (epoch_us(ts) // 1000) AS ms, s, [value, CAST(event_id % 7 + 1 AS DOUBLE)] AS x, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS k FROM
      (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS s FROM (SELECT *, CASE WHEN (epoch_us(ts) // 1000) - (epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) // 1000) > 86400000 THEN 1 ELSE 0 END AS new FROM events))),
    f AS (SELECT user_id, k, s, ms, 1 AS n, list_transform(x, lambda y: y / sqrt(list_sum(list_transform(x, lambda z: z * z)))) AS v FROM r WHERE k = 1 UNION ALL
      SELECT user_id, k, s, ms, n, list_transform(v, lambda y: y / sqrt(list_sum(list_transform(v, lambda z: z * z)))) FROM
        (SELECT r.user_id, r.k, r.s, r.ms, CASE WHEN f.s = r.s THEN least(f.n + 1, 100) ELSE 1 END AS n, {_STEP} AS v FROM f JOIN r ON r.user_id = f.user_id AND r.k = f.k + 1))
    SELECT user_id, CAST(first AS BIGINT) AS began_ms, CAST(n AS BIGINT) AS n, round(v[1], 6) AS x, round(v[2], 6) AS y FROM (SELECT *, min(ms) OVER (PARTITION BY user_id, s) AS first, row_number() OVER (PARTITION BY user_id, s ORDER BY k DESC) AS back FROM f) WHERE back = 1""")  # fmt: skip
def live_voices(t):
    """Each user's running voiceprint, given out and forgotten after a silent day, from a stream with state and timers."""
    samples = _events(t).withColumn("vector", F.array("value", (F.col("event_id") % 7 + 1).cast("double")))
    samples = samples.withColumn("vector", F.when(F.col("value").isNotNull(), F.col("vector")).otherwise(F.array().cast("array<double>"))).fillna({"user_id": -1, "event_id": -1})
    with live.rocks(samples.sparkSession):
        found = _run(live.voices(samples, "user_id", "ts", "event_id", "vector", 86_400))
    return found.filter("key >= 0").select(F.col("key").alias("user_id"), "began_ms", "n", F.round(F.col("voice")[0], 6).alias("x"), F.round(F.col("voice")[1], 6).alias("y"))
