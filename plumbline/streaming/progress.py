"""Progress as a stream: the latest state of each key, until a terminal one; windows over event time as an addition."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream over Parquet files of events; ts becomes a timestamp, which watermarks need."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def latest(events: DataFrame, key: str = "user_id", status: str = "event_type", ts: str = "ts", seq: str = "event_id") -> DataFrame:
    """The latest status of each key, and how many came. Works on batches and, in update or complete mode, on streams."""
    order = F.struct(ts, seq)
    return events.groupBy(key).agg(F.max_by(status, order).alias("status"), F.max(ts).alias("at"), F.count("*").alias("n"))


def until_terminal(events: DataFrame, terminal: tuple[str, ...], key: str = "user_id", status: str = "event_type", ts: str = "ts", seq: str = "event_id") -> DataFrame:
    """The first terminal status of each key and when it came; keys without one don't appear."""
    order = F.struct(ts, seq)
    return events.where(F.col(status).isin(*terminal)).groupBy(key).agg(F.min_by(status, order).alias("status"), F.min(ts).alias("at"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None, ts: str = "ts") -> DataFrame:
    own = events.withWatermark(ts, late) if late else events
    return own.groupBy(F.window(ts, width)).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str | None = None, ts: str = "ts") -> DataFrame:
    own = events.withWatermark(ts, late) if late else events
    return own.groupBy(F.window(ts, width, step)).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", key: str = "user_id", late: str | None = None, ts: str = "ts") -> DataFrame:
    own = events.withWatermark(ts, late) if late else events
    return own.groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("n"))


def ingest_once(stream: DataFrame, table_path: str, keys: list[str], checkpoint: str, then: Callable[[DataFrame], DataFrame] | None = None):
    """Appends a stream's rows to a Parquet table, leaving out keys that it already holds: repeats of a batch do no harm."""

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        out = (then(batch) if then else batch).dropDuplicates(keys)
        try:
            held = spark.read.parquet(table_path).select(*keys)
        except Exception as e:  # the table isn't there before the first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        else:
            out = out.join(held, keys, "left_anti")
        out.write.mode("append").parquet(table_path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(events: DataFrame, fields: list[str], key: str = "user_id", ts: str = "ts", seq: str = "event_id") -> DataFrame:
    """The latest known value of each field by key: a later event without a field leaves it as it was. Batches and streams."""
    order = F.struct(ts, seq)
    return events.groupBy(key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields], F.max(ts).alias("at"))


def done_of_total(events: DataFrame, totals: DataFrame, terminal: tuple[str, ...], key: str = "user_id", status: str = "event_type") -> DataFrame:
    """(key, done, total): how many of a key's steps have ended, never more than its total. totals (key, total) is static."""
    done = events.groupBy(key).agg(F.count_if(F.col(status).isin(*terminal)).alias("done"))
    return done.join(totals, key).withColumn("done", F.least("done", "total"))


def with_fallback(states: DataFrame, stored: DataFrame, keys: DataFrame, key: str = "user_id") -> DataFrame:
    """The state of each asked key: the live one, else the stored one, else none."""
    out = keys.join(states.select(key, F.col("status").alias("_live")), key, "left").join(stored.select(key, F.col("status").alias("_held")), key, "left")
    return out.select(key, F.coalesce("_live", "_held").alias("status"), F.when(F.col("_live").isNotNull(), "live").when(F.col("_held").isNotNull(), "stored").otherwise("none").alias("origin"))
