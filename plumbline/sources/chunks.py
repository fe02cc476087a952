"""Chunk tables: JSON-lines rows, collections, idempotent loads, partitioned sinks, store-to-store checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

CHUNK = T.StructType([T.StructField("id", T.StringType()), T.StructField("doc", T.StringType()), T.StructField("collection", T.StringType()), T.StructField("section_id", T.StringType()), T.StructField("section_title", T.StringType()), T.StructField("division", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("doc_type", T.StringType()), T.StructField("page_pdf", T.IntegerType()), T.StructField("chunk_index", T.IntegerType()), T.StructField("tables", T.ArrayType(T.StringType())), T.StructField("content", T.StringType())])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = CHUNK, text: str = "content") -> DataFrame:
    """Rows of JSON lines; malformed lines and blank texts are left out."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED").where(F.trim(text) != "")


def read_pages(spark: SparkSession, path: str, text: str = "text") -> DataFrame:
    """Pages (doc, page_num, text) of text files whose pages are set apart by form feeds."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc"), "value")
    return whole.select("doc", F.posexplode(F.split("value", "\f")).alias("_p", text)).select("doc", (F.col("_p") + 1).alias("page_num"), text)


def resolve_collections(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(target, collection): the longest known name that equals the target or begins it before an underscore.

    Each target asks for its own beginnings, so the join is on equal names, however many are known.
    """
    parts = F.split("target", "_")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "_"))
    asked = wanted.select("target", F.explode_outer(heads).alias("head"))
    return asked.join(known.select(F.col("collection").alias("name")), F.col("head") == F.col("name"), "left").groupBy("target").agg(F.max_by("name", F.length("name")).alias("collection"))


def new_rows(rows: DataFrame, held: DataFrame) -> DataFrame:
    """Rows of documents that their collection doesn't hold yet."""
    return rows.join(held.select("doc", "collection").distinct(), ["doc", "collection"], "left_anti")


def write_collection(rows: DataFrame, path: str, by: str = "collection") -> None:
    """Replaces the partitions that the rows belong to, and only these."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def copy_report(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """(key, n_source, n_target, state): copied, missing, or mismatch for partial copies."""
    a, b = source.groupBy(key).agg(F.count("*").alias("n_source")), target.groupBy(key).agg(F.count("*").alias("n_target"))
    both = a.join(b, key, "full").select(key, F.coalesce("n_source", F.lit(0)).alias("n_source"), F.coalesce("n_target", F.lit(0)).alias("n_target"))
    return both.withColumn("state", F.when(F.col("n_source") == F.col("n_target"), "copied").when(F.col("n_target") == 0, "missing").otherwise("mismatch"))


def live(rows: DataFrame, as_of: str, expires: str = "expires_at") -> DataFrame:
    """Rows that haven't expired at a given time."""
    return rows.where(F.col(expires) > F.lit(as_of).cast("timestamp"))


def ordered_chunks(rows: DataFrame, index: str = "chunk_index", key: str = "id") -> DataFrame:
    """Rows with pos, their place from 0 in order of index (0 where there is none), then key.

    Range partitions are numbered for themselves and shifted by the sizes of those before; only these sizes reach the driver.
    """
    spark = rows.sparkSession
    order = [F.coalesce(index, F.lit(0)), F.col(key)]
    placed = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    own = placed.withColumn("_m", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_m", 33))
    ends = own.groupBy("_p").agg(F.count("*").alias("_n"))
    shift = ends.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_s"))
    return own.join(F.broadcast(shift), "_p").withColumn("pos", F.col("_s") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_p", "_s")
