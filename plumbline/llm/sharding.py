"""Sharding along a Hilbert curve over quantised metadata, with per-shard bounds for file pruning."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import global_index, materialise


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer cells (rows of n coordinates below 2**bits).

    The coordinates are transposed by the exclusive-or passes of Skilling (2004), then their bits interleave.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _ordinal(column: Column) -> Column:
    """An order-keeping number of the first seven UTF-8 bytes of a string (null: as empty)."""
    head = F.substring(F.coalesce(column, F.lit("")).cast("binary"), 1, 7)
    return F.conv(F.rpad(F.hex(head), 14, "0"), 16, 10).cast("long")


def _cell(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds lie below the value."""
    spread = F.array(*[F.lit(int(b)) for b in bounds]) if bounds else F.array().cast("array<bigint>")
    return F.size(F.filter(spread, lambda b: b < value)).cast("int")


def curve_shards(
    df: DataFrame,
    n_shards: int,
    *,
    text: str = "text",
    key: str = "doc_id",
    categories: tuple[str, ...] = ("lang", "source"),
    bits: int = 5,
    accuracy: int = 10000,
) -> DataFrame:
    """Cuts all rows into n_shards runs of a Hilbert curve whose row counts differ by one at most.

    Dimensions are the categories and the byte size, each quantised at approximate quantiles (a bounded
    summary, merged on the map side) into at most 2**bits ordered cells. Inside a cell, rows follow text
    checksum, key and input order, so equal texts of equal metadata are neighbours, and a cell with most
    of the rows is split over partitions and shards.

    Returns key, size, text_crc32, one cell per dimension, curve, shard, slot and the categories.
    Null or empty text: size 8, checksum 0. Null categories: as empty. Null keys sort first. Repeated rows
    are kept. An empty table gives no rows. Other columns of df are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    meta = materialise(
        df.select(
            F.col(key),
            *[F.col(c) for c in categories],
            (F.octet_length(body).cast("long") + 8).alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
        ).withColumn("_row", F.monotonically_increasing_id()),
        "shard-meta",
    )
    scales = {c: _ordinal(F.col(c)) for c in categories} | {"size": F.col("size")}
    cuts = [i / 2**bits for i in range(1, 2**bits)]
    found = meta.agg(*[F.percentile_approx(x, cuts, accuracy).alias(f"q_{c}") for c, x in scales.items()]).first()
    coded = meta
    for c, x in scales.items():
        bounds = sorted(set(found[f"q_{c}"] or []))
        coded = coded.withColumn(f"cell_{c}", _cell(x, bounds))
    names = [f"cell_{c}" for c in scales]

    @F.pandas_udf("long")
    def curve(cells: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index(cells.to_numpy(np.int64), bits))

    coded = coded.withColumn("curve", curve(F.struct(*names)))
    numbered, n = global_index(coded, [F.col(c) for c in ("curve", "text_crc32", key, "_row")], "_at", "shard-order")
    base, more = divmod(n, n_shards)
    head = more * (base + 1)
    at, wide = F.col("_at"), F.lit(max(base, 1))
    return (
        numbered.withColumn("shard", F.when(at < head, F.floor(at / (base + 1))).otherwise(more + F.floor((at - head) / wide)).cast("int"))
        .withColumn("slot", F.when(at < head, at % (base + 1)).otherwise((at - head) % wide).cast("long"))
        .drop("_at", "_row")
    )


def shard_bounds(shards: DataFrame, columns: tuple[str, ...] = ("lang", "source", "size")) -> DataFrame:
    """Smallest and largest value of each column by shard: what a reader needs to skip shards."""
    return shards.groupBy("shard").agg(
        F.count("*").alias("rows"), *[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    )


def shards_for(bounds: DataFrame, **ranges: tuple) -> DataFrame:
    """Shards whose bounds meet all the closed ranges given by column."""
    keep = F.lit(True)
    for c, (low, high) in ranges.items():
        keep = keep & (F.col(f"max_{c}") >= F.lit(low)) & (F.col(f"min_{c}") <= F.lit(high))
    return bounds.where(keep).select("shard")


def write_shards(df: DataFrame, shards: DataFrame, path: str, key: str = "doc_id") -> None:
    """Writes the rows of df in the folders shard=0, shard=1, ... of path, each sorted by slot; key must be unique."""
    placed = df.join(shards.select(key, "shard", "slot"), key)
    placed.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
