"""Shared pieces of the training-data operators: tables in the shared folder, global order, byte views of text."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the session runs on one machine a temporary folder is set in its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def table_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def drop_table(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            drop_table(spark, path)
    except Exception:  # the JVM may be gone; the shared folder is then cleaned with the job
        return


_OPEN = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that materialise() writes inside go when the block ends, save those written with outlives."""
    stack = _OPEN.__dict__.setdefault("stack", [])
    held: set[str] = set()
    stack.append(held)
    try:
        yield
    finally:
        stack[:] = [x for x in stack if x is not held]
        for path in held:
            drop_table(spark, path)


@contextmanager
def collecting(held: set[str]) -> Iterator[None]:
    """Puts the paths of tables that outlive their operators into held; whoever asked drops them later."""
    stack = _OPEN.__dict__.setdefault("stack", [])
    stack.append(held)
    try:
        yield
    finally:
        stack[:] = [x for x in stack if x is not held]


#: Lets a statement's shuffle files go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """Statements inside drop their shuffle files when they end, not when the driver next collects garbage: what they
    have written is read from its table, so nothing asks for these files again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame, label: str, *, outlives: bool = False) -> DataFrame:
    """Writes the frame as Parquet into the shared folder and reads it back.

    This cuts lineage in a way that survives lost executors, and fixes row numbers and partition ids.
    The table lasts as long as the innermost scratch() block, the one around it with outlives, or the program.
    """
    return materialise_at(df, label, outlives=outlives)[0]


def materialise_at(df: DataFrame, label: str, *, outlives: bool = False) -> tuple[DataFrame, str]:
    """As materialise, also returning the path so that the caller can drop_table() it sooner."""
    spark = df.sparkSession
    path = table_path(spark, label)
    with releasing(spark):
        df.write.parquet(path)
    blocks_ = getattr(_OPEN, "stack", [])[: -1 if outlives else None]
    if blocks_:
        blocks_[-1].add(path)
    else:
        atexit.register(_drop_at_exit, spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def global_index(df: DataFrame, keys: list[Column], name: str, label: str) -> tuple[DataFrame, int]:
    """Numbers rows from 0 in the order of keys over the whole frame, without one task that sorts all.

    Rows are range-partitioned by all keys (so a hot prefix of the key is split), numbered in each
    partition, and shifted by the sizes of the partitions before: as many numbers as partitions reach the driver.
    """
    spark = df.sparkSession
    placed = (
        df.repartitionByRange(partitions(spark), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_m", F.monotonically_increasing_id())
    )
    table = materialise(placed, label)
    sizes = table.groupBy(F.shiftright("_m", 33).cast("int").alias("_p")).agg(F.count("*").alias("_n")).collect()
    start, offsets = 0, []
    for p, n in sorted((r["_p"], r["_n"]) for r in sizes):
        offsets.append((p, start))
        start += n
    shift = spark.createDataFrame(offsets, "_p int, _start long")
    out = (
        table.withColumn("_p", F.shiftright("_m", 33).cast("int"))
        .join(F.broadcast(shift), "_p")
        .withColumn(name, F.col("_start") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_p", "_m", "_start")
    )
    return out, start


def with_keys(df: DataFrame, keys: DataFrame, name: str, most: int = 2_000_000) -> DataFrame:
    """Rows of df whose long column name is among the distinct keys; a null key matches nothing.

    Up to ``most`` keys (counted first; 8 bytes each) are broadcast, so that the rows aren't shuffled; more are joined by shuffle.
    """
    few = keys.count() <= most
    return df.join(F.broadcast(keys) if few else keys, name, "left_semi")


def without_keys(df: DataFrame, keys: DataFrame, name: str, most: int = 2_000_000) -> DataFrame:
    """The other rows."""
    few = keys.count() <= most
    return df.join(F.broadcast(keys) if few else keys, name, "left_anti")


def free_name(taken: list[str], base: str) -> str:
    """base, with underscores before it while a column has that name."""
    low = {c.lower() for c in taken}
    while base.lower() in low:
        base = f"_{base}"
    return base


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of a string or binary Arrow array: all bytes, and n + 1 offsets into them. A null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    first = int(offsets[0]) if len(offsets) else 0
    last = int(offsets[-1]) if len(offsets) else 0
    raw = np.frombuffer(data, np.uint8)[first:last] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - first


def blocks(batch: pa.RecordBatch, column: str, most: int = 16 << 20):
    """Slices of a batch whose texts have about ``most`` bytes at most (one longer text stands alone)."""
    i = batch.schema.get_field_index(column)
    _, offs = byte_view(batch.column(i))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offs, offs[at] + most, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixing function (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E6C63D0876A9A47)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated runs start, start + 1, ... of the given lengths."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
