"""Idempotent ingest with an index of keys, so that a batch opens only the parts of its table that may hold its keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits for each key of a part's filter and how many of them a key sets: about one key in 450 is taken for another.
BITS, PROBES = 16, 4


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    """PROBES places for each 64-bit hash."""
    x = h.view(np.uint64)
    step = (x >> np.uint64(32)) | np.uint64(1)
    return ((x[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)).astype(np.int64)


def key_filter(hashes: np.ndarray) -> bytes:
    """A Bloom filter of hashes, BITS bits for each."""
    size = max(8, -(-len(hashes) * BITS // 8) * 8)
    bits = np.zeros(size, np.uint8)
    bits[_places(hashes, size).ravel()] = 1
    return np.packbits(bits).tobytes()


def may_hold(found: bytes, hashes: np.ndarray) -> np.ndarray:
    """Whether a filter may hold each hash; true for all that it was made of."""
    bits = np.unpackbits(np.frombuffer(found, np.uint8))
    return bits[_places(hashes, len(bits))].all(axis=1)


class KeyedTable:
    """A Parquet table of rows with distinct keys, in parts: one for each batch and bucket of the keys' hashes.

    Beside it stands an index with a row for each part: the least and greatest key and a filter of all its keys. A part counts
    when the index names it, so a batch that failed half-way is written again whole. Files of one batch are never opened
    by another one whose keys can't be in them: what a batch reads of the table follows its own keys, not the table's size.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: list[str], buckets: int = 16) -> None:
        self.spark, self.root, self.schema, self.keys, self.buckets = spark, root.rstrip("/"), schema, keys, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        #: Parts that the last add() opened.
        self.opened: list[str] = []

    def _index(self) -> DataFrame:
        schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("part", T.StringType()), T.StructField("n", T.LongType()), T.StructField("low", self.schema[self.keys[0]].dataType), T.StructField("high", self.schema[self.keys[0]].dataType), T.StructField("keys", T.BinaryType())])
        if not self._fs.exists(self._path(f"{self.root}/index")):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/index/*")

    def _data(self) -> DataFrame:
        at = f"{self.root}/data"
        inner = T.StructType([*self.schema.fields, T.StructField("part", T.StringType())])
        if not self._fs.exists(self._path(at)):
            return self.spark.createDataFrame([], inner)
        return self.spark.read.schema(inner).option("basePath", at).parquet(at)

    def read(self) -> DataFrame:
        """All rows of the parts that count."""
        return self._data().join(F.broadcast(self._index().select("part")), "part", "left_semi").select(*self.schema.fieldNames())

    def _parts_to_open(self, new: DataFrame) -> list[str]:
        """Names of the parts that may hold a key of new: by bucket and range first, then by their filters."""
        first = self.keys[0]
        asked = new.groupBy("bucket").agg(F.min(first).alias("least"), F.max(first).alias("most"))
        near = self._index().drop("keys").join(asked, "bucket").where((F.col("low") <= F.col("most")) & (F.col("high") >= F.col("least")) | F.col("low").isNull() | F.col("least").isNull())
        names = [r["part"] for r in near.select("part").collect()]  # as many as parts in reach of the batch
        if not names:
            return []
        wanted = self._index().where(F.col("part").isin(names)).select("bucket", "part", "keys")

        def test(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            h = left["h"].to_numpy(np.int64)
            return pd.DataFrame({"part": [p for p, k in zip(right["part"], right["keys"], strict=True) if len(h) and may_hold(bytes(k), h).any()]}, dtype="object")

        hit = new.select("bucket", "h").groupBy("bucket").cogroup(wanted.groupBy("bucket")).applyInPandas(test, "part string")
        return sorted(r["part"] for r in hit.collect())

    def add(self, rows: DataFrame, batch: int) -> int:
        """Appends the rows whose keys the table doesn't hold, one for each key, and returns their number. A batch that the index
        has is left as it is; what a failed attempt at it left is removed first."""
        counted = f"{self.root}/index/batch={batch:09d}"
        total = lambda: self._index().where(F.col("part").startswith(f"{batch:09d}-")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if self._fs.exists(self._path(f"{counted}/_SUCCESS")):
            return total()
        for left in self._fs.globStatus(self._path(f"{self.root}/data/part={batch:09d}-*")) or ():
            self._fs.delete(left.getPath(), True)
        own = rows.select(*self.schema.fieldNames()).dropDuplicates(self.keys)
        h = F.xxhash64(*self.keys)
        own = own.withColumn("h", h).withColumn("bucket", F.pmod("h", F.lit(self.buckets)).cast("int"))
        mine = F.concat_ws("-", F.lit(f"{batch:09d}"), F.col("bucket").cast("string"))
        self.opened = earlier = self._parts_to_open(own)
        if earlier:
            held = self._data().where(F.col("part").isin(earlier)).select(*[F.col(k).alias(f"_h_{k}") for k in self.keys])
            own = own.join(held, [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in self.keys], "left_anti")
        own.withColumn("part", mine).drop("h", "bucket").repartition("part").write.mode("append").partitionBy("part").parquet(f"{self.root}/data")
        written = self._data().where(F.col("part").startswith(f"{batch:09d}-")).select(*self.keys, "part", h.alias("h"))
        low = self.keys[0]

        def summed(frame: pd.DataFrame) -> pd.DataFrame:
            known = frame[low].dropna()
            whole = len(known) == len(frame)
            return pd.DataFrame({"bucket": [int(frame["part"].iloc[0].rsplit("-")[-1])], "part": [frame["part"].iloc[0]], "n": [len(frame)], "low": [known.min() if whole else None], "high": [known.max() if whole else None], "keys": [key_filter(frame["h"].to_numpy(np.int64))]})

        entries = written.groupBy("part").applyInPandas(summed, self._index().schema)
        entries.write.mode("overwrite").parquet(counted)
        return total()

    def follow(self, stream: DataFrame, checkpoint: str):
        """Adds a stream's batches."""
        return stream.writeStream.foreachBatch(lambda rows, n: self.add(rows, n) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
