"""Nearest neighbours by shifted Hilbert curves: several orders of projected vectors, merged windows, exact rerank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import global_index, materialise
from .sharding import hilbert_index


@dataclass
class Curves:
    """Projections, cell bounds and shifts of each curve, fitted to a bounded sample."""

    axes: np.ndarray  # (curves, dimensions, axes)
    bounds: np.ndarray  # (curves, axes, cells - 1)
    shifts: np.ndarray  # (curves, axes)
    bits: int

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """Curve positions, one column for each curve. Cells are equally filled, then moved by the shift."""
        out = []
        for axes, bounds, shift in zip(self.axes, self.bounds, self.shifts, strict=True):
            flat = vectors @ axes
            cells = np.stack([np.searchsorted(bounds[j], flat[:, j]) + shift[j] for j in range(flat.shape[1])], axis=1)
            out.append(hilbert_index(cells, self.bits + 1))
        return np.stack(out, axis=1)


def fit_curves(sample: np.ndarray, curves: int, axes: int, bits: int, seed: int = 3) -> Curves:
    rnd = np.random.default_rng(seed)
    d = sample.shape[1]
    axes = min(axes, d, 62 // (bits + 1))
    parts = [np.linalg.qr(rnd.standard_normal((d, d)))[0][:, :axes] for _ in range(curves)]
    cuts = np.arange(1, 2**bits) / 2**bits
    bounds = [np.quantile(sample @ p, cuts, axis=0).T for p in parts]
    return Curves(np.stack(parts), np.stack(bounds), rnd.integers(0, 2**bits, (curves, axes)), bits)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _best(query: np.ndarray, rows: np.ndarray, vectors: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> list[tuple]:
    """(query number, row, id, distance) of the k nearest allowed rows of each query; distances from plain differences."""
    rough = (query * query).sum(1)[:, None] + (vectors * vectors).sum(1) - 2 * (query @ vectors.T)
    rough[~allowed] = np.inf
    out = []
    for q in range(len(query)):
        own = rough[q]
        if len(own) > k:
            near = np.flatnonzero(own <= np.partition(own, k - 1)[k - 1] + 1e-9 * (1 + abs(own[np.isfinite(own)]).max(initial=0)))
        else:
            near = np.arange(len(own))
        near = near[np.isfinite(own[near])]
        exact = np.sqrt(((vectors[near] - query[q]) ** 2).sum(1))
        order = np.lexsort((rows[near], ids[near], exact))[:k]
        out += [(q, int(rows[near[i]]), int(ids[near[i]]), float(exact[i])) for i in order]
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def nearest(
    df: DataFrame,
    is_query: Column,
    k: int = 10,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    curves: int = 4,
    axes: int = 7,
    bits: int = 6,
    block: int = 2048,
    sample: int = 4096,
    probes: int = 64,
    recall: float = 0.96,
) -> DataFrame:
    """The k nearest rows by Euclidean distance of each query row, found in windows around it on several curves.

    Curves are fitted to the sample rows with the least key hashes. All rows are put in order on every curve by range
    partitions. How far windows must reach is measured: up to probes queries are compared with all rows, and the
    smallest window that meets the share recall of their true neighbours on some curve is used for all queries. Blocks
    of each curve get the queries whose windows touch them; their best rows are merged and ranked by exact distance.
    On vectors with structure windows stay short; on isotropic noise of many dimensions they reach over much of the
    table, since then no order keeps neighbours together.

    Returns query_id, rank (from 1), vec_id and score; ties to the smaller id. A row is never its own neighbour, but
    repeated rows are neighbours of each other. Vectors that are null, empty, zero or hold null or non-finite
    components take no part, nor do vectors of another length than most of the sample. Rows with a null key take no
    part. An empty table gives no rows.
    """
    spark = df.sparkSession
    wide = df.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("asks"))
    seen = wide.select("v").orderBy(F.xxhash64("id")).limit(sample).collect()
    out_schema = "query_id long, rank int, vec_id long, score double"
    if not seen:
        return spark.createDataFrame([], out_schema)
    sizes, counts = np.unique([len(r["v"]) for r in seen], return_counts=True)
    d = int(sizes[counts.argmax()])
    model = spark.sparkContext.broadcast(fit_curves(np.array([r["v"] for r in seen if len(r["v"]) == d]), curves, axes, bits))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.asarray(batch.column("v").flatten()).reshape(batch.num_rows, d)
            keys = model.value.keys(v) if batch.num_rows else np.zeros((0, curves), np.int64)
            steps = pa.array(np.arange(batch.num_rows + 1) * curves, pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(steps, pa.array(keys.ravel(), pa.int64()))], [*batch.schema.names, "keys"])

    rows = materialise(wide.where(F.size("v") == d).withColumn("row", F.monotonically_increasing_id()).mapInArrow(place, "id long, v array<double>, asks boolean, row long, keys array<long>"), "vectors")
    spread = rows.select("row", F.posexplode("keys").alias("curve", "key"))
    ordered, total = global_index(spread, [F.col("curve"), F.col("key"), F.col("row")], "at", "curve-order")
    n = total // curves
    ordered = ordered.select("row", "curve", (F.col("at") - F.col("curve").cast("long") * n).alias("at"))

    # The window, from the true neighbours of a bounded number of queries.
    asked = rows.where("asks").orderBy(F.xxhash64("id"), "row").limit(probes).select("row", "v").collect()
    if not asked:
        return spark.createDataFrame([], out_schema)
    probe = spark.sparkContext.broadcast((np.array([r["row"] for r in asked]), np.array([r["v"] for r in asked])))

    def truth(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, q = probe.value
        for f in frames:
            if len(f):
                r = f["row"].to_numpy()
                found = _best(q, r, _matrix(f["v"]), f["id"].to_numpy(), r[None, :] != own[:, None], k)
                yield pd.DataFrame([(int(own[a]), b, c, e) for a, b, c, e in found], columns=["query", "row", "id", "score"])

    by_query = Window.partitionBy("query").orderBy("score", "id", "row")
    true = rows.select("row", "v", "id").mapInPandas(truth, "query long, row long, id long, score double").withColumn("r", F.row_number().over(by_query)).where(F.col("r") <= k)
    a, b = ordered.select(F.col("row").alias("query"), "curve", F.col("at").alias("qa")), ordered.select("row", "curve", F.col("at").alias("ra"))
    gaps = true.select("query", "row").join(a, "query").join(b, ["row", "curve"]).groupBy("query", "row").agg(F.min(F.abs(F.col("qa") - F.col("ra"))).alias("gap"))
    window = int(np.quantile([r["gap"] for r in gaps.select("gap").collect()] or [n], recall)) + 1

    placed = ordered.join(rows.select("row", "id", "v", "asks"), "row")
    base = placed.select(*[F.col(c).alias(f"base_{c}") for c in ("curve", "row", "at", "v", "id")], F.floor(F.col("at") / block).alias("base_block"))
    queries = placed.where("asks").select("row", "curve", "at", "v", F.explode(F.sequence(F.floor(F.greatest(F.col("at") - window, F.lit(0)) / block), F.floor(F.least(F.col("at") + window, F.lit(n - 1)) / block))).alias("block"))

    def meet(key_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["query", "row", "id", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in names})
        own, at = left["row"].to_numpy(), left["at"].to_numpy()
        r, ra = right["base_row"].to_numpy(), right["base_at"].to_numpy()
        found = []
        for i in range(0, len(own), 256):
            s = slice(i, i + 256)
            allowed = (np.abs(at[s, None] - ra) <= window) & (own[s, None] != r)
            found += [(int(own[i + q]), row, id_, score) for q, row, id_, score in _best(_matrix(left["v"].iloc[s]), r, _matrix(right["base_v"]), right["base_id"].to_numpy(), allowed, k)]
        return pd.DataFrame(found, columns=names)

    met = queries.groupBy("curve", "block").cogroup(base.groupBy("base_curve", "base_block")).applyInPandas(meet, "query long, row long, id long, score double")
    met = met.groupBy("query", "row").agg(F.first("id").alias("id"), F.min("score").alias("score")).withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    return met.join(rows.select(F.col("row").alias("query"), F.col("id").alias("query_id")), "query").select("query_id", "rank", F.col("id").alias("vec_id"), "score")
