"""Nearest rows by blocks against all pairs by the JVM's expression: ties, odd vectors, many probes."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

import plumbline.registry  # noqa: F401
from plumbline.functions.vectors import cosine
from plumbline.operators.questions import vector_legs
from plumbline.operators.retrieval import vector_topk_batch

ODD = [None, [], [1.0], [0.0] * 8, [None] + [1.0] * 7, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [1e-200] * 8, [1e200] * 8, [1e-120] * 8]


@pytest.fixture(scope="module")
def vectors(spark):
    rnd = np.random.default_rng(5)
    base = [[float(np.float32(x)) for x in rnd.normal(size=8)] for _ in range(300)]
    rows = base + [base[7]] * 40 + ODD + ODD[:4] + [[-x for x in base[7]]]
    return spark.createDataFrame([(int(i), r) for i, r in zip(rnd.permutation(len(rows)), rows, strict=True)] + [(None, base[3])], "vec_id int, embedding array<double>").repartition(4).cache()


def rows_of(df, *columns):
    return sorted(map(repr, df.select(*columns).collect()))


def by_all_pairs(vectors, probes, k):
    pairs = vectors.select(F.col("vec_id").alias("id"), "embedding").crossJoin(probes).where("id <> probe_id")
    scored = pairs.withColumn("similarity", cosine(F.col("embedding"), F.col("probe"), 0.0))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("probe_id").orderBy(F.desc("similarity"), "id"))).where(F.col("rank") <= k)


@pytest.mark.parametrize("most", [4096, 30])
def test_batches_against_all_pairs(spark, vectors, most):
    probes = vectors.where("vec_id % 3 = 0").select(F.col("vec_id").alias("probe_id"), F.col("embedding").alias("probe"))
    found = vector_topk_batch(vectors, probes, 5, most=most)
    columns = ["probe_id", "id", "rank", "similarity"]
    assert rows_of(found, *columns) == rows_of(by_all_pairs(vectors, probes, 5), *columns)
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("few", [4096, 30])
def test_legs_against_all_pairs(spark, vectors, few):
    own = vectors.where("vec_id IS NOT NULL").select(F.col("vec_id").alias("id"), "embedding")
    probes = own.where("id % 4 = 1").select(F.col("id").alias("query_id"), F.lit(0).alias("variant_no"), F.col("embedding").alias("probe"))
    scored = own.crossJoin(probes).withColumn("s", cosine(F.col("embedding"), F.col("probe"), 0.0)).where("s > 0")
    rank = F.row_number().over(Window.partitionBy("query_id", "variant_no").orderBy(F.desc(F.round("s", 9)), "id"))
    columns = ["query_id", "variant_no", "id", "rank"]
    assert rows_of(vector_legs(own, probes, 7, few=few), *columns) == rows_of(scored.withColumn("rank", rank).where("rank <= 7"), *columns)


def test_none(spark, vectors):
    probes = vectors.select(F.col("vec_id").alias("probe_id"), F.col("embedding").alias("probe"))
    assert vector_topk_batch(vectors, probes.limit(0), 5).collect() == [] and vector_topk_batch(vectors.limit(0), probes, 5, most=1).collect() == []
