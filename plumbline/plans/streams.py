"""Progress queries on the batch plan of the streaming operators. The windows are an addition of this engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query, table
from ..streaming import progress as P


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("latest_progress", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS n FROM events GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return P.latest(_events(spark, d)).select("user_id", "status", "n")


@query("terminal_progress", "SELECT user_id, arg_min(event_type, (ts, event_id)) AS status FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return P.until_terminal(_events(spark, d), ("purchase", "error")).select("user_id", "status")


@query("events_tumbling", "SELECT epoch_ms(time_bucket(INTERVAL 1 HOUR, ts)) AS start_ms, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return P.tumbling(_events(spark, d)).select(F.unix_millis("window.start").alias("start_ms"), "n", F.round("total", 4).alias("total"))


@query("events_sliding", "SELECT epoch_ms(s) AS start_ms, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return P.sliding(_events(spark, d)).select(F.unix_millis("window.start").alias("start_ms"), "n")


@query("events_session", """
    WITH m AS (SELECT user_id, ts, sum(CASE WHEN b IS NULL OR ts - b >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events))
    SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM m GROUP BY user_id, g""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return P.sessions(_events(spark, d)).select("user_id", F.unix_micros("session_window.start").alias("start_us"), "n")
