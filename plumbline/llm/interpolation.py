"""A language model by deleted interpolation: n-gram estimates mixed by the frequency of their context, with weights
that expectation-maximisation learns on texts whose counts were left out."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import blocks, byte_view, materialise, mix64, scratch
from .shingles import word_hashes, words

#: Bytes of text in a block, the unit within which n-grams are counted before they are shuffled.
_BLOCK = 8 << 20
#: Tokens for each part of the n-gram keys.
_PART = 1 << 20
_END, _START = np.uint64(0), np.uint64(0xC2B2AE3D27D4EB4F)
_ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)]
_KEPT, _DELETED, _OTHER = 0, 1, 2
_COUNTS = "block long, n_order int, part int, total array<long>, kept array<long>"
_EVENTS = [("b3", "int"), ("b2", "int"), ("k3", "long"), ("c3", "long"), ("k2", "long"), ("c2", "long"), ("k1", "long"), ("h", "long")]


def bucket(counts: np.ndarray) -> np.ndarray:
    """Context-frequency buckets: 0 for a context that wasn't seen, else the number of binary digits of its count."""
    return np.frexp(counts.astype(np.float64))[1]


def encoded(df: DataFrame, fold: Column) -> DataFrame:
    """Blocks of texts of one fold from (key, text): their keys, token counts (end included), distinct token hashes by
    falling frequency, and each token's place among these in two planes of 16 bits. Words are known by 64-bit hashes."""
    kind = to_arrow_type(df.schema["key"].dataType)
    schema = T.StructType(
        [T.StructField("block", T.LongType()), T.StructField("fold", T.IntegerType()), T.StructField("keys", T.ArrayType(df.schema["key"].dataType)), T.StructField("lengths", T.ArrayType(T.IntegerType())),
         T.StructField("vocabulary", T.ArrayType(T.LongType())), T.StructField("low", T.BinaryType()), T.StructField("high", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for f in (_KEPT, _DELETED, _OTHER):
                own = batch.filter(pc.equal(batch.column("fold"), f))
                for part in blocks(own, "text", _BLOCK):
                    raw, offsets = byte_view(part.column("text"))
                    starts, ends, at = words(raw, offsets)
                    lengths = np.diff(at) + 1
                    tokens = np.insert(word_hashes(raw, starts, ends), at[1:], _END)
                    distinct, place, counts = np.unique(tokens, return_inverse=True, return_counts=True)
                    order = np.argsort(-counts, kind="stable")
                    codes = np.argsort(order)[place].astype(np.uint32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([block], pa.int64()), pa.array([f], pa.int32()), pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("key").cast(kind)),
                            pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), pa.array(lengths, pa.int32())),
                            pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), pa.array(distinct[order].view(np.int64))),
                            pa.array([(codes & 0xFFFF).astype("<u2").tobytes()], pa.binary()), pa.array([(codes >> 16).astype("<u2").tobytes()], pa.binary()),
                        ],
                        schema.fieldNames(),
                    )
                    block += 1

    return df.select("key", "text", fold.alias("fold")).mapInArrow(run, schema)


class _Block:
    """A block's tokens, each an event with the tokens before it as its history."""

    def __init__(self, lengths: np.ndarray, vocabulary: np.ndarray, low: bytes, high: bytes) -> None:
        codes = np.frombuffer(low, "<u2").astype(np.uint32) | np.frombuffer(high, "<u2").astype(np.uint32) << np.uint32(16)
        self.lengths = lengths
        self.tokens = vocabulary.view(np.uint64)[codes]
        self.firsts = np.cumsum(lengths) - lengths

    def keys(self, order: int) -> np.ndarray:
        """A key for each event's n-gram of that order; starts stand before the first token."""
        out = self.tokens * _ODD[0] + np.uint64(order)
        before = self.tokens
        for k in range(1, order):
            before = np.concatenate([[_START], before[:-1]])
            before[self.firsts] = _START
            out = mix64(out) + before * _ODD[k]
        return mix64(out)

    def before(self, counts: np.ndarray, first: int) -> np.ndarray:
        """Of the counts of one order by event, those of the event before: how often this event's history of that length
        was seen, as each n-gram that doesn't end a text is the history of one event. At a text's start: first."""
        out = np.concatenate([[0], counts[:-1]])
        out[self.firsts] = first
        return out


def _block_of(table: pa.Table) -> _Block:
    lengths, vocabulary = (table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("lengths", "vocabulary"))
    return _Block(lengths.astype(np.int64), vocabulary, table.column("low")[0].as_py(), table.column("high")[0].as_py())


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of keys: sorted keys fall into parts one after another."""
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def counted(texts: DataFrame, order: int, parts: int) -> DataFrame:
    """(block, n_order, part, total, kept): for the sorted distinct n-grams of each block how often they occur in all
    texts that are learned from, and in those that aren't deleted (only for blocks of deleted texts, else null).

    A block sends each of its distinct n-grams once, in ranges of their hashes, so a frequent n-gram is as many numbers
    as there are blocks. Block -1 has, by part, the distinct n-grams and their occurrences in all and in kept texts.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(i, 1)])
                keys, n = np.unique(_block_of(row).keys(order), return_counts=True)
                edges = np.searchsorted(_part_of(keys, parts), np.arange(parts + 1))
                some = np.flatnonzero(np.diff(edges))
                at = pa.array(np.append(edges[some], len(keys)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(some, pa.int32()), pa.array(np.full(len(some), row.column("block")[0].as_py())), pa.array(np.full(len(some), row.column("fold")[0].as_py()), pa.int32()),
                        pa.ListArray.from_arrays(at, pa.array(keys.view(np.int64))), pa.ListArray.from_arrays(at, pa.array(n, pa.int32())),
                    ],
                    ["part", "block", "fold", "grams", "n"],
                )

    def total(table: pa.Table) -> pa.Table:
        grams = table.column("grams").combine_chunks()
        sizes = np.diff(grams.offsets.to_numpy())
        distinct, place = np.unique(grams.flatten().to_numpy().view(np.uint64), return_inverse=True)
        n = table.column("n").combine_chunks().flatten().to_numpy().astype(np.float64)
        fold = np.repeat(table.column("fold").to_numpy(), sizes)
        kept = np.bincount(place, np.where(fold == _KEPT, n, 0.0), len(distinct)).astype(np.int64)
        every = kept + np.bincount(place, np.where(fold == _DELETED, n, 0.0), len(distinct)).astype(np.int64)
        ends = np.cumsum(sizes)
        part = table.column("part")[0].as_py()
        out = [{"block": -1, "n_order": order, "part": part, "total": np.array([(every > 0).sum(), every.sum()]), "kept": np.array([(kept > 0).sum(), kept.sum()])}]
        for block, f, a, b in zip(table.column("block").to_pylist(), table.column("fold").to_pylist(), ends - sizes, ends, strict=True):
            own = place[a:b]
            out.append({"block": block, "n_order": order, "part": part, "total": every[own], "kept": kept[own] if f == _DELETED else None})
        longs = pa.list_(pa.int64())
        return pa.table({"block": pa.array([r["block"] for r in out], pa.int64()), "n_order": pa.array([order] * len(out), pa.int32()), "part": pa.array([part] * len(out), pa.int32()), "total": pa.array([r["total"] for r in out], longs), "kept": pa.array([r["kept"] for r in out], longs)})

    sent = texts.mapInArrow(split, "part int, block long, fold int, grams array<long>, n array<int>")
    return sent.groupBy("part").applyInArrow(total, _COUNTS)


@dataclass(frozen=True)
class Corpus:
    """Distinct tokens, tokens and texts that a model's estimates rest on."""

    distinct: int
    tokens: int
    texts: int


@dataclass(frozen=True)
class Weights:
    """The share of the maximum-likelihood estimate at each order, by bucket of the context for orders 3 and 2; the
    rest goes to the next lower order, and below order 1 to one more than the distinct tokens alike."""

    three: np.ndarray
    two: np.ndarray
    one: float

    def probability(self, n: tuple[np.ndarray, ...], corpus: Corpus) -> np.ndarray:
        """Of events with counts (k3, c3, k2, c2, k1): n-gram and context for orders 3 and 2, token for order 1."""
        k3, c3, k2, c2, k1 = n
        one = self.one if corpus.tokens else 0.0
        out = one * k1 / max(corpus.tokens, 1) + (1 - one) / (corpus.distinct + 1)
        for share, k, c in ((self.two, k2, c2), (self.three, k3, c3)):
            mine = np.where(c > 0, share[bucket(c)], 0.0)
            out = mine * (k / np.maximum(c, 1)) + (1 - mine) * out
        return out


def _filled(shares: dict[int, float]) -> np.ndarray:
    """A share for each bucket: of those without an event the next lower one's, else the next higher one's, else a half."""
    out, last = np.zeros(65), shares[min(shares)] if shares else 0.5
    for b in range(1, 65):
        last = out[b] = shares.get(b, last)
    return out


def learned(events: DataFrame, corpus: Corpus, *, rounds: int = 40, gain: float = 1e-5) -> Weights:
    """Weights by expectation-maximisation over the deleted texts' events (b3, b2, k3, c3, k2, c2, k1, h times), whose
    counts leave these texts out. Each round is one aggregation; as many sums as pairs of buckets reach the driver.

    The lower order of each bucket has one occurrence more than it has, so that no share becomes 1. Ends when a round
    gains less than gain in the mean log-likelihood, or after so many rounds.
    """
    ratio = lambda k, c: F.when(F.col(c) > 0, F.col(k) / F.col(c)).otherwise(0.0)
    known = materialise(events.select("b3", "b2", ratio("k3", "c3").alias("e3"), ratio("k2", "c2").alias("e2"), (F.col("k1") / max(corpus.tokens, 1)).alias("e1"), "h"), "events")
    w = Weights(_filled({}), _filled({}), 0.5)
    before = None
    for _ in range(rounds):
        share = lambda a, b: F.get(F.lit(a.tolist()), F.col(b))
        p1 = F.lit(w.one) * F.col("e1") + F.lit((1 - w.one) / (corpus.distinct + 1))
        step = known.withColumn("s3", share(w.three, "b3")).withColumn("s2", share(w.two, "b2")).withColumn("p1", p1)
        step = step.withColumn("p2", F.col("s2") * F.col("e2") + (1 - F.col("s2")) * F.col("p1")).withColumn("p3", F.col("s3") * F.col("e3") + (1 - F.col("s3")) * F.col("p2"))
        step = step.withColumn("r3", F.col("s3") * F.col("e3") / F.col("p3")).withColumn("r2", F.col("s2") * F.col("e2") / F.col("p2")).withColumn("r1", F.lit(w.one) * F.col("e1") / F.col("p1"))
        h, rest3 = F.col("h"), F.col("h") * (1 - F.col("r3"))
        rest2 = rest3 * (1 - F.col("r2"))
        sums = step.groupBy("b3", "b2").agg(
            F.sum(h * F.ln("p3")).alias("fit"), F.sum(h).alias("n"), F.sum(h * F.col("r3")).alias("a3"), F.sum(rest3).alias("z3"), F.sum(rest3 * F.col("r2")).alias("a2"), F.sum(rest2).alias("z2"), F.sum(rest2 * F.col("r1")).alias("a1"), F.sum(rest2 * (1 - F.col("r1"))).alias("z1"),
        ).collect()
        if not sums:
            break
        shares: dict[str, dict[int, float]] = {}
        for b in ("b3", "b2"):
            near: dict[int, list[float]] = {}
            for r in sums:
                if r[b] > 0:
                    held = near.setdefault(r[b], [0.0, 1.0])
                    held[0] += r[f"a{b[1]}"]
                    held[1] += r[f"z{b[1]}"]
            shares[b] = {k: a / (a + z) for k, (a, z) in near.items()}
        a1, z1 = sum(r["a1"] for r in sums), 1.0 + sum(r["z1"] for r in sums)
        w = Weights(_filled(shares["b3"]), _filled(shares["b2"]), a1 / (a1 + z1))
        now = sum(r["fit"] for r in sums) / sum(r["n"] for r in sums)
        if before is not None and now - before < gain:
            break
        before = now
    return w


def _aligned(table: pa.Table, column: str) -> dict[int, np.ndarray]:
    """Counts of each order for the sorted distinct n-grams of a block."""
    table = table.sort_by([("n_order", "ascending"), ("part", "ascending")])
    orders = table.column("n_order").to_numpy()
    out = {}
    for k in (1, 2, 3):
        own = table.filter(pa.array(orders == k))
        out[k] = own.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False) if own.num_rows else np.zeros(0, np.int64)
    return out


def _counts_of(block: _Block, counts: dict[int, np.ndarray], texts: int) -> tuple[np.ndarray, ...]:
    """(k3, c3, k2, c2, k1) of each event of a block."""
    k = [counts[order][np.unique(block.keys(order), return_inverse=True)[1]] for order in (3, 2, 1)]
    return k[0], block.before(k[1], texts), k[1], block.before(k[2], texts), k[2]


def score(df: DataFrame, learn: Column, *, text: str = "text", key: str = "doc_id", deleted: int = 10) -> DataFrame:
    """log10 probabilities of all whole texts under a model of three-word sequences that is learned from the rows where learn is true.

    Tokens are words [^\\x20\\x09-\\x0D]+ with A-Z as a-z and one end. Of the texts to learn from about one in ``deleted``
    (by a hash of key and text) is deleted while the mixture weights are learned: they maximise the probability of
    these texts under counts without them. The final estimates count all texts to learn from. A token that wasn't seen is
    one more kind; probabilities of all kinds sum to 1.

    Returns a row for each row of df: key, learned, n_tokens, n_known, train_tokens, base_score (the sum of
    log10((c + 1) / (N + V + 1))) and score. Null and empty texts and texts without words are one end; null keys stay;
    where learn is null the row isn't learned from; repeated rows count each. Without any text to learn from all scores
    are 0. An empty table gives no rows. Other columns of df aren't read.
    """
    chosen = F.pmod(F.xxhash64("key", "text"), F.lit(deleted)) == 0
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    fold = F.when(~F.col("learn"), _OTHER).when(chosen, _DELETED).otherwise(_KEPT)
    with scratch(df.sparkSession):
        return _scored(rows, fold, key)


def _scored(rows: DataFrame, fold: Column, key: str) -> DataFrame:
    texts = materialise(encoded(rows, fold), "encoded")
    sizes = {r["fold"]: r for r in texts.groupBy("fold").agg(F.sum(F.size("keys")).alias("texts"), F.sum(F.octet_length("low") / 2).alias("tokens")).collect()}
    parts = max(1, int(sum(r["tokens"] for r in sizes.values())) // _PART)
    counts = reduce(DataFrame.unionAll, [materialise(counted(texts, order, parts), f"grams{order}") for order in (1, 2, 3)])
    own, sums = counts.where("block >= 0"), {}
    for name in ("total", "kept"):
        r = counts.where("block = -1 AND n_order = 1").agg(F.sum(F.get(name, F.lit(0))).alias("v"), F.sum(F.get(name, F.lit(1))).alias("n")).first()
        folds = (_KEPT, _DELETED) if name == "total" else (_KEPT,)
        sums[name] = Corpus(r["v"] or 0, r["n"] or 0, sum(sizes[f]["texts"] for f in folds if f in sizes))
    full, kept = sums["total"], sums["kept"]
    names = [n for n, _ in _EVENTS]

    def events(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({n: pa.array([], pa.int32() if t == "int" else pa.int64()) for n, t in _EVENTS})
        k3, c3, k2, c2, k1 = _counts_of(_block_of(left), _aligned(right, "kept"), kept.texts)
        order = np.lexsort((k1, c2, k2, c3, k3))
        all_ = np.stack([k3, c3, k2, c2, k1])[:, order]
        first = np.flatnonzero(np.concatenate([[True], (all_[:, 1:] != all_[:, :-1]).any(axis=0)]))
        k3, c3, k2, c2, k1 = all_[:, first]
        values = [bucket(c3), bucket(c2), k3, c3, k2, c2, k1, np.diff(np.append(first, len(order)))]
        return pa.table({n: pa.array(v, pa.int32() if t == "int" else pa.int64()) for (n, t), v in zip(_EVENTS, values, strict=True)})

    some = own.where("kept IS NOT NULL").drop("total")
    found = texts.where(F.col("fold") == _DELETED).groupBy("block").cogroup(some.groupBy("block")).applyInArrow(events, ", ".join(f"{n} {t}" for n, t in _EVENTS))
    weights = learned(found.groupBy(*names[:-1]).agg(F.sum("h").alias("h")), kept)

    kind = rows.schema["key"].dataType
    schema = T.StructType(
        [T.StructField(key, kind), T.StructField("learned", T.BooleanType())] + [T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")] + [T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]
    )
    typed = to_arrow_type(kind)

    def score_block(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], f) for f in (typed, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], schema.fieldNames())
        block = _block_of(left)
        n = _counts_of(block, _aligned(right, "total"), full.texts)
        base = np.log10((n[4] + 1) / (full.tokens + full.distinct + 1))
        own = np.log10(weights.probability(n, full))
        over = lambda x: np.add.reduceat(x, block.firsts)
        m = len(block.lengths)
        learnt = left.column("fold")[0].as_py() != _OTHER
        values = [left.column("keys").combine_chunks().flatten().cast(typed), pa.array(np.full(m, learnt)), pa.array(block.lengths), pa.array(over((n[4] > 0).astype(np.int64))), pa.array(np.full(m, full.tokens, np.int64)), pa.array(over(base)), pa.array(over(own))]
        return pa.table(values, schema.fieldNames())

    out = texts.groupBy("block").cogroup(own.drop("kept").groupBy("block")).applyInArrow(score_block, schema)
    return materialise(out, "scores", outlives=True)
