"""Ingest by keys: what is kept, what is opened, batches that come again or fail, and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import plumbline.registry  # noqa: F401
from plumbline.streaming import ingest as I

ROW = T.StructType([T.StructField("k", T.LongType()), T.StructField("j", T.StringType()), T.StructField("v", T.IntegerType())])


@pytest.fixture
def held(spark, tmp_path):
    return I.KeyedTable(spark, f"file://{tmp_path}/t", ROW, ["k", "j"], buckets=4)


def rows(spark, *values):
    return spark.createDataFrame(list(values), ROW)


def test_filters_hold_what_they_were_made_of():
    rnd = np.random.default_rng(1)
    h = rnd.integers(-(2**63), 2**63 - 1, 5000)
    found = I.key_filter(h)
    other = rnd.integers(-(2**63), 2**63 - 1, 20_000)
    assert I.may_hold(found, h).all() and I.may_hold(found, other).mean() < 0.01 and I.key_filter(h[:0])


def test_only_new_keys_stay(spark, held):
    assert held.read().count() == 0
    assert held.add(rows(spark, (1, "a", 1), (1, "a", 1), (2, None, 2), (None, "x", 3)), 0) == 3
    assert held.add(rows(spark, (1, "a", 9), (1, "b", 4), (2, None, 9), (None, "x", 9), (None, None, 5)), 1) == 2
    want = {(1, "a", 1), (2, None, 2), (None, "x", 3), (1, "b", 4), (None, None, 5)}
    assert {tuple(r) for r in held.read().collect()} == want
    held.add(rows(spark, (1, "a", 9), (1, "b", 4), (2, None, 9), (None, "x", 9), (None, None, 5)), 1)
    assert {tuple(r) for r in held.read().collect()} == want and held.read().count() == 5
    assert held.add(rows(spark), 2) == 0 and held.read().count() == 5


def test_parts_out_of_reach_stay_shut(spark, held):
    make = lambda a, b: spark.range(a, b).select(F.col("id").alias("k"), F.lit("j").alias("j"), F.lit(0).alias("v"))
    for n in range(5):
        assert held.add(make(n * 1000, n * 1000 + 1000), n) == 1000
        assert held.opened == []  # ranges that don't meet
    one = rows(spark, (2500, "j", 1), (9999, "j", 1))
    assert held.add(one, 5) == 1 and 1 <= len(held.opened) <= 2 and all(p.startswith("000000002-") for p in held.opened[:1])
    odd = spark.range(0, 40).select((F.col("id") * 100 + 50).alias("k"), F.lit("new").alias("j"), F.lit(0).alias("v"))
    assert held.add(odd, 6) == 40 and len(held.opened) <= 4  # in range, but the filters rule nearly all out


def test_a_batch_that_failed_is_written_again(spark, held, tmp_path):
    held.add(rows(spark, (1, "a", 1)), 0)
    half = spark.createDataFrame([(7, "z", 7, "000000001-0"), (8, "z", 8, "000000001-1")], T.StructType([*ROW.fields, T.StructField("part", T.StringType())]))
    half.write.mode("append").partitionBy("part").parquet(f"file://{tmp_path}/t/data")
    assert {tuple(r) for r in held.read().collect()} == {(1, "a", 1)}
    held.add(rows(spark, (7, "z", 70), (1, "a", 5)), 1)
    assert {tuple(r) for r in held.read().collect()} == {(1, "a", 1), (7, "z", 70)}


def test_a_stream(spark, held, tmp_path):
    for n, batch in enumerate([[(1, "a", 1), (2, "a", 2)], [(2, "a", 9), (3, "a", 3)]]):
        rows(spark, *batch).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        held.follow(spark.readStream.schema(ROW).parquet(f"file://{tmp_path}/in"), f"file://{tmp_path}/state").awaitTermination()
        assert held.read().count() == 2 + n
    assert {tuple(r) for r in held.read().collect()} == {(1, "a", 1), (2, "a", 2), (3, "a", 3)}
