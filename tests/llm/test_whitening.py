"""Whitening against one eigendecomposition of all vectors; merging against one decomposition; odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import whitening as W
from plumbline.llm.queries import op13_merged_whitening


def by_hand(vectors):
    """vec_id -> deviation, whitened coordinates; and the shares, from the covariance matrix's eigenvectors."""
    x = np.array([np.floor(np.array(v, np.float64) * 1024).astype(np.int64) + 100_000 for v in vectors.values()])
    n, sums = len(x), x.sum(axis=0)
    mid = (x * n - sums) / n
    values, basis = np.linalg.eigh(mid.T @ mid / n)
    top = np.argsort(-values)[:8]
    deviations = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    return n, dict(zip(vectors, deviations, strict=True)), dict(zip(vectors, mid @ basis[:, top] / np.sqrt(values[top]), strict=True)), values[top] / values.sum()


def test_embeddings_as_by_hand(spark, sf_dir):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    n, deviations, coordinates, shares = by_hand(vectors)
    got = op13_merged_whitening(spark, sf_dir).collect()
    assert len(got) == 8 * len(vectors) and {(r["vec_id"], r["component"]) for r in got} == {(v, c) for v in vectors for c in range(1, 9)}
    signs = {}
    for r in got:
        mine, other = r["whitened"], coordinates[r["vec_id"]][r["component"] - 1]
        sign = signs.setdefault(r["component"], np.sign(mine * other))
        assert mine == pytest.approx(sign * other, abs=1e-7)
        assert (r["n"], r["deviation"]) == (n, deviations[r["vec_id"]]) and r["explained"] == pytest.approx(shares[r["component"] - 1], rel=1e-9)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_merges_lose_nothing():
    rnd = np.random.default_rng(2)
    x = rnd.integers(-1000, 1000, (90, 12)) + 100_000 + np.arange(90)[:, None] * 7
    held = None
    for at, to in ((0, 1), (1, 4), (4, 50), (50, 51), (51, 90)):
        own = W.summary_of(x[at:to])
        held = own if held is None else W.merged(own, held)
    mid = x - x.mean(axis=0)
    assert held.n == 90 and held.sums == tuple(x.sum(axis=0).tolist())
    assert held.factor.T @ held.factor == pytest.approx(mid.T @ mid, rel=1e-10, abs=1e-5)


def test_rounds_of_merges(spark):
    rows = [(i, [float(np.sin(i * k)) for k in range(1, 6)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(37, "vec_id")
    grid = W.on_grid(df, "embedding", "grid", 1024, 0)
    one = W.fit(grid.coalesce(1), "grid")
    many = W.fit(grid, "grid", fan=2)
    assert (one.n, one.sums) == (many.n, many.sums) and one.factor.T @ one.factor == pytest.approx(many.factor.T @ many.factor, rel=1e-9, abs=1e-3)


def test_odd_vectors(spark):
    good = {i: [float((i * 7) % 5), float(i % 3), 1.0] for i in range(12)}
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]), (104, [float("inf"), 0.0, 0.0]), (105, [1e300, 0.0, 0.0]), (106, [1.0, 2.0])]
    rows = [*good.items(), *bad, (None, [9.0, 9.0, 1.0]), (3, good[3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("mine") for c in ("n", "grid", "key", "vector", "part")})
    got = W.whiten(df).collect()
    assert len(got) == 14 * 2 and {r["component"] for r in got} == {1, 2}  # the third place is the same for all
    assert {r["vec_id"] for r in got} == {*good, None} and {r["n"] for r in got} == {14}
    equal = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert W.whiten(equal).collect() == [] and W.whiten(df.limit(0)).collect() == []
    single = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert W.whiten(single).collect() == []


def test_deviations_beyond_a_long_are_null():
    x = np.array([[0, 0], [1 << 39, 5], [3, 1 << 39]], np.int64)
    w = W.Whitening.of(W.summary_of(x), 2)
    sums = x.sum(axis=0).tolist()
    want = [sum((3 * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x.tolist()]
    assert w.deviations(x) == [v if v < 1 << 63 else None for v in want] and None in w.deviations(x)
