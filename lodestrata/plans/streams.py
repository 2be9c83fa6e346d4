"""Structured Streaming queries over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.runtime import table
from lodestrata.streaming import log


def _events(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    return log.event_log(spark, path, spark.read.parquet(path).schema).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_window_counts(spark, sf_dir):
    return log.settled(log.window_counts(_events(spark, sf_dir), "event_type")).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def stream_sessions(spark, sf_dir):
    return log.settled(log.sessions(_events(spark, sf_dir), "user_id")).groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


def repeat_deferral(spark, sf_dir):
    return log.settled(log.deferred_stream(_events(spark, sf_dir)), "append")


def repeat_deferral_batch(spark, sf_dir):
    return log.deferred(table(spark, sf_dir, "events"))


DEFERRED = f"""WITH RECURSIVE r AS (SELECT user_id, event_type, event_id, epoch_us(ts) / 1000000.0 AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts), event_id) AS k FROM events),
x AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id, event_type ORDER BY k) > {log.FORGET_S} AS lost FROM r),
s AS (SELECT user_id, event_type, 0::BIGINT AS k, 0::BIGINT AS event_id, 0 AS n, -1.0::DOUBLE AS until, false AS again, false AS shown FROM events GROUP BY ALL
UNION ALL SELECT user_id, event_type, k, event_id, n, CASE WHEN shown THEN CASE WHEN n >= {log.LIMIT} THEN t + {log.DEFER_S} ELSE -1.0 END ELSE until END, again, shown FROM (
    SELECT *, shown_ AS shown, CASE WHEN shown_ THEN CASE WHEN until >= 0 THEN 1 ELSE n_ + 1 END ELSE n_ END AS n, (again_ OR (shown_ AND until >= 0)) AS again FROM (
        SELECT *, NOT (until >= 0 AND (again_ OR t < until)) AS shown_ FROM (
            SELECT x.user_id, x.event_type, x.k, x.event_id, x.t, CASE WHEN coalesce(lost, false) THEN 0 ELSE s.n END AS n_, CASE WHEN coalesce(lost, false) THEN -1.0 ELSE s.until END AS until, CASE WHEN coalesce(lost, false) THEN false ELSE s.again END AS again_
            FROM s JOIN x ON x.user_id = s.user_id AND x.event_type = s.event_type AND x.k = s.k + 1))))
SELECT user_id, event_type, event_id, shown FROM s WHERE k > 0"""

QUERIES = {f.__name__: f for f in (stream_window_counts, stream_sessions, repeat_deferral, repeat_deferral_batch)}
ORACLE_SQL = {
    "repeat_deferral": DEFERRED, "repeat_deferral_batch": DEFERRED,
    "stream_window_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
s AS (SELECT user_id, sum(CASE WHEN p IS NULL OR ts > p + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g),
n AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM n GROUP BY 1""",
}
