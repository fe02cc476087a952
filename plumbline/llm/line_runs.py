"""Repeated runs of lines, by a suffix array over line-ID sequences that grows by distributed prefix doubling."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, drop_table, free_name, global_index, materialise, materialise_at, scratch

_ORDER = ["doc", "row", "pos"]


def _ranked(pairs: DataFrame, keys: list[str], label: str) -> tuple[DataFrame, str]:
    """Positions whose key occurs more than once, with its rank in the order of keys and the first place that has it."""
    place = F.struct(*_ORDER)
    groups = pairs.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(place).alias("first")).where("_n > 1").drop("_n")
    with scratch(pairs.sparkSession):
        ranks, _ = global_index(groups, [F.col(k) for k in keys], "_rank", f"{label}-ranks")
        return materialise_at(pairs.join(ranks, keys).select(*_ORDER, F.col("_rank").alias("rank"), "first"), label, outlives=True)


def least_windows(words: np.ndarray, min_words: int) -> np.ndarray:
    """Pairs (low, high) of lines of one text: from each line, forwards and backwards, the least window with min_words words."""
    upto = np.cumsum(words)
    before, at = upto - words, np.arange(len(words))
    high = np.maximum(np.searchsorted(upto, before + min_words), at)
    low = np.minimum(np.searchsorted(before, upto - min_words, side="right") - 1, at)
    pairs = np.concatenate([np.stack([at, high], axis=1)[high < len(words)], np.stack([low, at], axis=1)[low >= 0]])
    return np.unique(pairs, axis=0)


def repeated_runs(lines: DataFrame, windows: DataFrame) -> DataFrame:
    """Places (row, pos) of lines that belong to a later copy of one of the windows.

    lines has doc, row, pos and line (an ID); windows has row, low and n (lines). Round k ranks the sequences of 2**k
    lines: from the ranks of its two halves, each sequence that occurs again gets its place in the order of all. Suffixes
    with equal rank are an interval of the suffix array whose common prefix has 2**k lines or more. Sequences that occur
    once, and those cut off by the end of a text, are settled and leave, so later rounds hold only what repeats longer.
    A window of 2**k lines is a sequence of its round, whose first place the rank's group gives. Windows have to follow from
    their lines alone, as those of least_windows() do, so that each place of the sequence is a window too.
    A longer one, of up to 2**(k+1) - 1 lines, is known by the ranks of its first and its last 2**k lines.

    With the windows of least_windows() this finds just the lines of earlier matches that have the words: a match can be
    cut at its ends until it is the least window that starts at a line of it, or the least one that ends with the line.
    """
    (level, path), width = _ranked(lines.select(*_ORDER, F.col("line").alias("key")), ["key"], "line-order"), 1
    most = windows.agg(F.max("n")).first()[0] or 0
    place, found = F.struct("doc", "row", "low"), []
    while width <= most and not level.isEmpty():
        whole = windows.where(F.col("n") == width).withColumnRenamed("low", "pos").join(level, ["row", "pos"])
        later = whole.where(F.struct(*_ORDER) > F.col("first"))
        found.append(materialise(later.select("row", F.col("pos").alias("low"), (F.col("pos") + F.col("n") - 1).alias("high")), "runs"))
        if width > 1:
            sized = windows.where(F.col("n").between(width + 1, 2 * width - 1)).withColumn("last", F.col("low") + F.col("n") - width)
            heads = level.select("doc", "row", F.col("pos").alias("low"), F.col("rank").alias("head"))
            tails = level.select("row", F.col("pos").alias("last"), F.col("rank").alias("tail"))
            known, sized_path = materialise_at(sized.join(heads, ["row", "low"]).join(tails, ["row", "last"]), "windows")
            firsts = known.groupBy("n", "head", "tail").agg(F.min(place).alias("first"), F.count("*").alias("_n")).where("_n > 1")
            later = known.join(firsts, ["n", "head", "tail"]).where(place > F.col("first"))
            found.append(materialise(later.select("row", "low", (F.col("low") + F.col("n") - 1).alias("high")), "runs"))
            drop_table(lines.sparkSession, sized_path)
        if 2 * width > most:
            break
        after = level.select("row", (F.col("pos") - width).alias("pos"), F.col("rank").alias("next"))
        pairs = level.drop("first").join(after, ["row", "pos"])
        (level, longer), width = _ranked(pairs, ["rank", "next"], "line-order"), width * 2
        drop_table(lines.sparkSession, path)
        path = longer
    spans = reduce(DataFrame.unionAll, found) if found else None
    if spans is None:
        return lines.sparkSession.createDataFrame([], "row long, pos int")
    return spans.select("row", F.explode(F.sequence("low", "high")).alias("pos")).distinct()


def without_repeated_runs(df: DataFrame, *, text: str = "text", key: str = "doc_id", min_words: int = 10) -> DataFrame:
    """Deletes later copies of repeated line runs from a text column; the first copy in order of key and line stays.

    A run is any number of consecutive lines that occurs again, in the same or another text, and has at least
    min_words words (split at white space), so that short separators stay. Adds n_lines and n_removed. All rows and
    columns stay; columns that had these two names are replaced. A text that loses all lines becomes empty. Null texts stay
    null, with 0 lines. Null keys come first. Among repeated rows the first one read keeps its lines.
    """
    df = df.drop("n_lines", "n_removed")
    names = [f.name for f in df.schema]
    spot = free_name(names, "gone")
    docs = materialise(df.select(F.struct(*names).alias("own"), F.monotonically_increasing_id().alias("row")), "line-texts")
    with scratch(df.sparkSession):
        body = F.col(f"own.{text}")
        lines = materialise(
            docs.select(F.col(f"own.{key}").alias("doc"), "row", F.posexplode(F.split(body, "\n")).alias("pos", "body")).select(
                "doc", "row", "pos", F.xxhash64("body").alias("line")
            ),
            "lines",
        )

        def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in blocks(batch, "body"):
                    numbers, pairs = [], [np.zeros((0, 2), np.int64)]
                    for row, own in zip(part.column("row").to_pylist(), part.column("body").to_pylist(), strict=True):
                        pairs.append(least_windows(np.array([len(x.split()) for x in own.split("\n")]), min_words))
                        numbers.append(np.full(len(pairs[-1]), row, np.int64))
                    both = np.concatenate(pairs).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(numbers)), pa.array(both[:, 0]), pa.array(both[:, 1] - both[:, 0] + 1)], ["row", "low", "n"])

        windows = materialise(docs.select("row", body.alias("body")).where("body is not null").mapInArrow(bounds, "row long, low int, n int"), "line-windows")
        gone = materialise(repeated_runs(lines, windows).groupBy("row").agg(F.collect_list("pos").alias("gone")), "gone-lines", outlives=True)
    # A shuffle at every size: all lines that go are no broadcast, and disk grows with the input from small tables on.
    joined = docs.join(gone.hint("shuffle_merge"), "row", "left").select(*[F.col(f"own.{c}").alias(c) for c in names], F.col("gone").alias(spot))
    others = [c for c in names if c != text]
    schema = T.StructType([*df.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text):
                texts, counts, removed = [], [], []
                for own, drop in zip(part.column(text).to_pylist(), part.column(spot).to_pylist(), strict=True):
                    split = [] if own is None else own.split("\n")
                    out = set(drop or ())
                    texts.append(own if not out else "\n".join(x for i, x in enumerate(split) if i not in out))
                    counts.append(len(split))
                    removed.append(len(out))
                new = {text: pa.array(texts, pa.string()), "n_lines": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64())}
                columns = {c: part.column(c) for c in others} | new
                yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema], schema.fieldNames())

    return joined.mapInArrow(run, schema)
