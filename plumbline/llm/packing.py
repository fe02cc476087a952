"""Harmonic packing of token sequences: pieces in reciprocal-capacity classes, each class's bins with a fixed count."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .bpe import WORDS, Codec, codec_of, tokenizer_source
from .common import blocks, materialise

#: Fill from which a piece isn't cut further.
FULL_ENOUGH = 0.96


class _Fast:
    """Encodes as a Codec does, by the compiled merges of another public library over the same vocabulary."""

    def __init__(self, codec: Codec) -> None:
        self.plain = tiktoken.Encoding("own", pat_str=WORDS.pattern, mergeable_ranks=codec.tokens, special_tokens=codec.special)

    def encode(self, text: str) -> np.ndarray:
        return self.plain.encode_to_numpy(text, allowed_special="all")


def _encoder(source: bytes):
    """That encoder if ids follow the order of merges, as it needs; else the codec itself."""
    codec = codec_of(source)
    if not hasattr(codec, "fast"):
        order = sorted(codec.made, key=lambda t: codec.made[t][2])
        ranked = all(len(k) > 1 or v < 256 for k, v in codec.tokens.items()) and order == sorted(order)
        codec.fast = _Fast(codec).encode if ranked else lambda text: np.frombuffer(codec.encode([text])[0], "<u4")
    return codec.fast


def pieces_of(length: int, capacity: int) -> list[int]:
    """Lengths into which a document is cut: whole capacities, then pieces that fill their class's bins well.

    A rest r belongs to class capacity // r, whose bins hold that many pieces. While such bins would stay emptier than
    FULL_ENOUGH, the largest capacity // k that fits is cut off; pieces of that size fill their bins.
    """
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        if rest * k >= FULL_ENOUGH * capacity:
            out.append(rest)
            break
        size = capacity // (k + 1)
        out.append(size)
        rest -= size
    return out


class _Bins:
    """Open bins of the classes; a bin of class k closes with its k-th piece."""

    def __init__(self, capacity: int, first: int) -> None:
        self.capacity, self.next = capacity, first
        self.open: dict[int, list[tuple[int, int]]] = {}

    def add(self, row: int, length: int) -> list[tuple[int, int, int]]:
        """(row, sequence, offset) of the pieces of the bin that closes, if one does."""
        k = self.capacity // length
        held = self.open.setdefault(k, [])
        held.append((row, length))
        if len(held) < k:
            return []
        self.open[k] = []
        return self._close(held)

    def _close(self, held: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        out, at = [], 0
        for row, length in held:
            out.append((row, self.next, at))
            at += length
        self.next += 1
        return out


def pack(df: DataFrame, tokenizer: str, *, text: str = "text", key: str = "doc_id", capacity: int = 1024, end: int = 0) -> DataFrame:
    """Packs the tokens of all texts, each with the id end after it, into sequences of at most capacity tokens.

    Each task fills the bins of its classes alone. What its open bins hold, less than one bin for each class, meets
    the rest of that class in a window over class and hash slots, and the last open bins go into one first-fit step
    over at most one bin of each class and slot. No step depends on how often a text or key occurs.

    Returns a row for each piece: key, start, length, ids_crc32 (little-endian unsigned 32-bit ids), doc_tokens,
    sequence_id and offset. Null texts count as empty: one piece that is the end id. Null keys are kept, repeated rows
    are packed like others, an empty table gives no rows. Other columns of df are not read.
    """
    spark = df.sparkSession
    source = spark.sparkContext.broadcast(tokenizer_source(tokenizer))
    kind = df.schema[key].dataType
    names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([T.StructField("key", kind)] + [T.StructField(n, T.LongType()) for n in names[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(source.value)
        bins = _Bins(capacity, (TaskContext.get().partitionId() + 1) << 32)
        waiting: dict[int, tuple] = {}  # pieces of open bins, fewer than one bin for each class
        number = 0
        for batch in batches:
            for part in blocks(batch, "text", 4 << 20):
                rows: list[tuple] = []
                for doc, own in zip(part.column("key").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.append(encode(own or "").astype("<u4"), np.uint32(end)).astype("<u4")
                    n, at = len(ids), 0
                    for size in pieces_of(n, capacity):
                        waiting[number] = (doc, at, size, zlib.crc32(ids[at : at + size].tobytes()), n)
                        for row, sequence, offset in bins.add(number, size):
                            rows.append((*waiting.pop(row), sequence, offset))
                        number += 1
                        at += size
                yield _rows(rows, kind)
        yield _rows([(*x, None, None) for x in waiting.values()], kind)

    def _rows(rows: list[tuple], kind: T.DataType) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_type

        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        types = [to_arrow_type(kind)] + [pa.int64()] * (len(names) - 1)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    placed = materialise(df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema), "pieces")
    done = placed.where("sequence_id is not null")

    # Open bins: numbered within (class, slot), with as many slots as keep each window at thousands of rows.
    left = placed.where("sequence_id is null").select("key", "start", "length", "ids_crc32", "doc_tokens")
    slots = max(1, placed.rdd.getNumPartitions() // 64)
    left = left.withColumn("k", F.floor(F.lit(capacity) / F.col("length")).cast("int")).withColumn("slot", F.pmod(F.xxhash64("start", "ids_crc32", "doc_tokens"), F.lit(slots)))
    order = Window.partitionBy("k", "slot").orderBy("start", "length", "ids_crc32", "doc_tokens", "key")
    left = left.withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy("k", "slot")))
    left = left.withColumn("bin", F.floor(F.col("i") / F.col("k")).cast("long"))
    left = materialise(left, "open-bins")
    full = left.where("(bin + 1) * k <= n")
    before = Window.partitionBy("k", "slot", "bin").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    # Numbers of tasks start at 1 << 32; these lie below: class, slot and bin have their own digits.
    full = full.select("key", "start", "length", "ids_crc32", "doc_tokens", ((F.col("bin") * F.lit(slots) + F.col("slot")) * F.lit(2 * capacity) + F.col("k")).alias("sequence_id"), "offset")

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_ = [f for f in frames if len(f)]
        if not all_:
            return
        rest = pd.concat(all_).sort_values(["length", "start", "ids_crc32", "doc_tokens"], ascending=[False, True, True, True]).reset_index(drop=True)
        room: list[int] = []
        sequence, offset = [], []
        for size in rest["length"]:
            for b, free in enumerate(room):
                if size <= free:
                    break
            else:
                b = len(room)
                room.append(capacity)
            sequence.append(-1 - b)
            offset.append(capacity - room[b])
            room[b] -= size
        yield rest.assign(sequence_id=sequence, offset=offset)[names]

    last = left.where("(bin + 1) * k > n").select("key", "start", "length", "ids_crc32", "doc_tokens").coalesce(1).mapInPandas(fit, schema)
    out = done.unionAll(full.select(*names)).unionAll(last)
    return out.withColumnRenamed("key", key)
