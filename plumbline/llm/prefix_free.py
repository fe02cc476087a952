"""Exact removal of long repeated byte strings, by prefix-free parsing.

A rolling hash over k bytes has triggers: the positions where it is least among v neighbours. They cut texts into
phrases, alike wherever the bytes are alike. Every string of the asked length holds at least one trigger that its
own bytes decide. Strings of a text whose first and last such trigger agree form one class; the phrases between
those triggers are the class's core. Only cores, one for some hundred bytes of text, are sorted over the corpus:
in that order neighbours with the same core, and with the same phrases around it, are occurrences of one string.
Where the phrases around equal cores differ, shorter runs of the class's strings are sorted, at last single strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, byte_view, drop_table, free_name, materialise, materialise_at, mix64, partitions, scratch, with_keys, without_keys
from .shingles import _powers

_BLOCK = 2 << 20
_BYTE = np.random.default_rng(977).integers(0, 2**64, 256, np.uint64)
#: place: first start of a class, how many more it has, its phase (where the class's first trigger lies in steps of
#: _STEP, so that its strings are cut alike in all texts) and its kind, in one number.
_FOUND = "core long, wide long, key long, place long"
_NAMES = ["core", "wide", "key", "place"]
_STEP = 8
#: Starts within a text have 28 bits.
_LONGEST = (1 << 28) - 1
#: Kinds of rows: a covered interval of a text, a class (or string) to be sorted, one that is known to be repeated.
COVER, ROW, KNOWN = 0, 1, 2


def _place(low, more, phase, kind):
    return (((np.asarray(low, np.int64) << 28) + more << 3) + phase << 2) + kind


def _low(place):
    return place >> 33


def _more(place):
    return (place >> 5) & ((1 << 28) - 1)


def _kind(column: str = "place"):
    return F.col(column).bitwiseAND(F.lit(3))


def _sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    return sums, down


def _hash(sums: np.ndarray, down: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hashes of the byte strings [low, high), the same wherever they stand."""
    return mix64((sums[high] - sums[low]) * down[low] + (high - low).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def _least_at(x: np.ndarray, v: int) -> np.ndarray:
    """Position of the least of x[j : j + v] for each j, the first one at ties (by prefix and suffix minima of blocks)."""
    n = len(x)
    if n < v:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << 28) - 1)
    packed = (x & ~low) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // v) * v, np.uint64(2**64 - 1))
    padded[:n] = packed
    grid = padded.reshape(-1, v)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[: n - v + 1], ahead[v - 1 : n]) & low).astype(np.int64)


def classes(raw: np.ndarray, offsets: np.ndarray, length: int, k: int, v: int) -> dict[str, np.ndarray]:
    """Classes of the strings of the given length in a block of texts: core and wide hashes, text number, first and last start."""
    span = length - k - v + 1
    starts, ends = offsets[:-1], offsets[1:]
    counts = np.maximum(0, ends - starts - length + 1)
    if span < 0 or not counts.any():
        return {c: np.zeros(0, np.int64) for c in ("core", "wide", "text", "phase", "low", "high")}
    sums, down = _sums(raw)
    at = np.arange(len(raw) - k + 1)
    least = _least_at(_hash(sums, down, at, at + k), v)
    own = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    text = np.repeat(np.arange(len(starts)), counts)
    first, last = least[own], least[own + span]
    new = np.ones(len(own), bool)
    new[1:] = (first[1:] != first[:-1]) | (last[1:] != last[:-1]) | (text[1:] != text[:-1])
    i = np.flatnonzero(new)
    j = np.append(i[1:], len(own)) - 1
    low, high, a, b = own[i], own[j], first[i], last[i]
    core = _hash(sums, down, a, b + k)
    wide = mix64(_hash(sums, down, low, high + length) + (a - low).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + core)
    t = text[i]
    return {"core": core.view(np.int64), "wide": wide.view(np.int64), "text": t, "phase": (a - starts[t]) % _STEP, "low": low - starts[t], "high": high - starts[t]}


def strings(raw: np.ndarray, offsets: np.ndarray, length: int, text: np.ndarray, phase: np.ndarray, low: np.ndarray, high: np.ndarray, step: int) -> dict[str, np.ndarray]:
    """Classes cut into cells of step starts, as classes() gives them. A cell's core is what all strings that start in it share.

    Cells lie alike around the class's first trigger in every text; at the ends of a class they may be used in part.
    """
    sums, down = _sums(raw)
    shift = phase % step
    first, last = (low - shift) // step, (high - shift) // step
    n = last - first + 1
    which = np.repeat(np.arange(len(n)), n)
    cell = (np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))) * step + shift[which]
    start, end = np.maximum(cell, low[which]), np.minimum(cell + step - 1, high[which])
    at = offsets[:-1][text[which]]
    core = _hash(sums, down, at + cell + step - 1, at + cell + length)
    wide = mix64(_hash(sums, down, at + start, at + end + length) + (start - cell).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + core)
    return {"core": core.view(np.int64), "wide": wide.view(np.int64), "text": text[which], "phase": phase[which], "low": start, "high": end}


def _batch(core, wide, key, place) -> pa.RecordBatch:
    n = len(place)
    return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(np.asarray(x), n), pa.int64()) for x in (core, wide, key, place)], _NAMES)


def _runs(low: np.ndarray, high: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of intervals [low, high) by owner, in order."""
    if not len(low):
        return low, high, owner
    o = np.lexsort((low, owner))
    low, high, owner = low[o].astype(np.int64), high[o].astype(np.int64), owner[o]
    # Owners are set apart so that one running maximum serves all.
    group = np.concatenate([[0], np.cumsum(owner[1:] != owner[:-1])]) * (int(high.max()) + 1)
    top = np.maximum.accumulate(high + group)
    new = np.concatenate([[True], (low + group)[1:] > top[:-1]])
    i = np.flatnonzero(new)
    return low[i], (top - group)[np.append(i[1:], len(low)) - 1], owner[i]


def _local(c: dict[str, np.ndarray], keys: np.ndarray, length: int) -> Iterator[pa.RecordBatch]:
    """Rows of a block: what is repeated inside it is covered at once and goes on as one known row for each string.

    A cover's number of further starts reaches over its last string, so that low + more is its end.
    """
    text, low, high = c["text"], c["low"], c["high"]
    _, first, inverse, counts = np.unique(c["wide"], return_index=True, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    a, b, t = _runs(low[again], high[again] + length, text[again])
    yield _batch(0, 0, keys[t], _place(a, b - a, 0, COVER))
    kind = np.where(counts > 1, KNOWN, ROW)
    yield _batch(c["core"][first], c["wide"][first], keys[text[first]], _place(low[first], (high - low)[first], c["phase"][first], kind))


def _first_pass(texts: DataFrame, length: int, k: int, v: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text", _BLOCK):
                raw, offsets = byte_view(part.column("text"))
                if len(offsets) > 1 and int(np.diff(offsets).max()) > _LONGEST:
                    raise ValueError(f"a text has more than {_LONGEST} bytes")
                c = classes(raw, offsets, length, k, v)
                if len(c["text"]):
                    yield from _local(c, part.column("key").to_numpy(), length)

    return texts.mapInArrow(run, _FOUND)


def _string_pass(texts: DataFrame, open_: DataFrame, length: int, step: int) -> DataFrame:
    """The open classes of each text, cut into cells of step starts."""
    asked = materialise(open_.groupBy("key").agg(F.collect_set("place").alias("places")), "open")
    joined = with_keys(texts, asked.select("key"), "key").join(asked, "key").select("key", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text", _BLOCK // 2):
                raw, offsets = byte_view(part.column("text"))
                text = np.repeat(np.arange(part.num_rows), np.asarray(part.column("places").value_lengths()))
                place = np.asarray(part.column("places").flatten())
                low = _low(place)
                c = strings(raw, offsets, length, text, (place >> 2) & 7, low, low + _more(place), step)
                if len(c["text"]):
                    yield from _local(c, part.column("key").to_numpy(), length)

    return joined.mapInArrow(run, _FOUND)


def _settle(rows: pd.DataFrame, length: int, open_: bool) -> Iterator[pd.DataFrame]:
    """Rows in order of (core, wide, ...): what is covered (kind COVER), and the classes that stay open (kind ROW)."""
    n = len(rows)
    core, wide, place = (rows[c].to_numpy() for c in ("core", "wide", "place"))
    kind = place & 3
    same = np.zeros(n + 1, bool)
    same[1:n] = wide[1:] == wide[:-1]
    # A known row was covered where it was found.
    cover = (same[:-1] | same[1:]) & (kind == ROW)
    yield rows[cover].assign(core=0, wide=0, place=_place(_low(place[cover]), _more(place[cover]) + length, 0, COVER))
    if open_:
        kin = np.zeros(n + 1, bool)
        kin[1:n] = (core[1:] == core[:-1]) & (wide[1:] != wide[:-1])
        stay = kin[:-1] | kin[1:]
        yield rows[stay].assign(core=0, wide=0, place=place[stay] - kind[stay] + ROW)


def _sorted_pass(rows: DataFrame, length: int, label: str, open_: bool) -> tuple[DataFrame, str]:
    """Sorts rows over range partitions and settles them; the ends of neighbouring partitions meet in a last small step."""
    order = ["core", "wide", "key", "place"]
    placed = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    schema = _FOUND + ", part int, end int"
    columns = [*_NAMES, "part", "end"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last, any_ = TaskContext.get().partitionId(), None, False
        for frame in frames:
            if not len(frame):
                continue
            if not any_:
                yield frame.iloc[:1].assign(part=part, end=0)[columns]
            any_ = True
            # The last row stays to meet the next batch. Meeting a row twice does no harm: intervals are united later.
            both = frame if last is None else pd.concat([last, frame], ignore_index=True)
            for out in _settle(both, length, open_):
                yield out.assign(part=-1, end=0)[columns]
            last = both.iloc[-1:]
        if any_:
            yield last.assign(part=part, end=1)[columns]

    found, path = materialise_at(placed.select(*_NAMES).mapInPandas(run, schema), label)

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_ = [f for f in frames if len(f)]
        if all_:
            # First and last row of each partition; a partition with one row counts once.
            ends = pd.concat(all_).sort_values(["part", "end"]).drop_duplicates(["part", *_NAMES])
            for out in _settle(ends[_NAMES].reset_index(drop=True), length, open_):
                yield out[_NAMES]

    edges = found.where("part >= 0").select("part", "end", *_NAMES).coalesce(1).mapInPandas(meet, _FOUND)
    return found.where("part < 0").select(*_NAMES).unionAll(edges), path


def repeated_spans(df: DataFrame, *, text: str = "text", length: int = 400, k: int = 16, v: int = 240) -> DataFrame:
    """Of each distinct text, byte intervals covered by a string of that length that starts anywhere else too.

    Returns key (xxhash64 of the text) and places: intervals as numbers (_low, and _more bytes from there), which may
    overlap. Texts without such a string don't appear.
    """
    if k + v > length:
        raise ValueError("a string must hold a trigger: k + v may not exceed length")
    with scratch(df.sparkSession):
        return _spans(df, text, length, k, v)


def _spans(df: DataFrame, text: str, length: int, k: int, v: int) -> DataFrame:
    spark = df.sparkSession
    texts = df.where(F.octet_length(text) >= length).select(F.xxhash64(F.col(text)).alias("key"), F.col(text).cast("binary").alias("text"))
    found, path = materialise_at(_first_pass(texts, length, k, v), "phrases")
    covers = []
    # Open classes are settled cell by cell, then string by string. Each table goes when what it covers is taken out.
    for step in (_STEP, 1, 0):
        covers.append(materialise(found.where(_kind() == COVER).select("key", "place"), "covers"))
        settled, sorted_path = _sorted_pass(found.where(_kind() != COVER), length, f"order-{step}", step > 0)
        covers.append(materialise(settled.where(_kind() == COVER).select("key", "place"), "covers"))
        drop_table(spark, path)
        if step:
            open_ = settled.where(_kind() == ROW).select("key", "place").distinct()
            found, path = materialise_at(_string_pass(texts, open_, length, step), f"strings-{step}")
        drop_table(spark, sorted_path)
    return materialise(reduce(DataFrame.unionAll, covers).distinct().groupBy("key").agg(F.collect_list("place").alias("places")), "spans", outlives=True)


def _to_characters(raw: bytes, low: int, high: int) -> tuple[int, int]:
    """The whole UTF-8 characters inside [low, high)."""
    while low < high and raw[low] & 0xC0 == 0x80:
        low += 1
    while high > low and high < len(raw) and raw[high] & 0xC0 == 0x80:
        high -= 1
    return low, high


def without_repeats(df: DataFrame, *, text: str = "text", length: int = 400, out: str = "kept", whole_characters: bool = False, k: int = 16, v: int | None = None) -> DataFrame:
    """Replaces a text column by what stays without repeated strings of the given length, as bytes, with n_bytes,
    n_removed and n_spans (maximal removed runs). Other columns stay. With whole_characters, characters that a run
    covers only in part stay, so that the bytes are valid UTF-8. Triggers are the least of v positions,
    three fifths of the length if v is not given: smaller v, more classes; larger v, shorter and less telling cores.

    A null text counts as empty. Equal texts lose the same bytes, so copies of at least that length lose all.
    Texts shorter than the length stay whole. Repeated rows are texts of their own. Columns that had the
    new names are replaced.
    """
    df = df.drop(*({"n_bytes", "n_removed", "n_spans", out} - {text}))
    others = [f.name for f in df.schema if f.name != text]
    key, places, body = (free_name(others, n) for n in ("key", "places", "body"))
    spans = repeated_spans(df, text=text, length=length, k=k, v=length * 3 // 5 if v is None else v).toDF(key, places)
    whole = df.select(*others, F.coalesce(F.col(text), F.lit("")).cast("binary").alias(body), F.xxhash64(text).alias(key))
    # Texts that lose nothing stay where they are.
    hit = with_keys(whole, spans.select(key), key).join(spans, key)
    rest = without_keys(whole, spans.select(key), key).withColumn(places, F.lit(None).cast("array<long>"))
    joined = hit.select(*others, body, places).unionAll(rest.select(*others, body, places))
    more = [("n_bytes", T.LongType(), pa.int64()), ("n_removed", T.LongType(), pa.int64()), ("n_spans", T.LongType(), pa.int64()), (out, T.BinaryType(), pa.binary())]
    schema = T.StructType([df.schema[c] for c in others] + [T.StructField(n, t) for n, t, _ in more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, body):
                rows = []
                for raw, held in zip(*(part.column(c).to_pylist() for c in (body, places)), strict=True):
                    if held is None:
                        rows.append((len(raw), 0, 0, raw))
                        continue
                    held = np.array(held, np.int64)
                    low = _low(held)
                    a, b, _ = _runs(low, low + _more(held), np.zeros(len(low), np.int64))
                    runs = list(zip(a.tolist(), b.tolist(), strict=True))
                    if whole_characters:
                        runs = [r for x, y in runs if (r := _to_characters(raw, x, y))[0] < r[1]]
                    pieces, at = [], 0
                    for x, y in runs:
                        pieces.append(raw[at:x])
                        at = y
                    pieces.append(raw[at:])
                    rows.append((len(raw), sum(y - x for x, y in runs), len(runs), b"".join(pieces)))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in others] + [pa.array(list(x), t) for x, (_, _, t) in zip(columns, more, strict=True)], [*others, *(n for n, _, _ in more)])

    return joined.mapInArrow(run, schema)
