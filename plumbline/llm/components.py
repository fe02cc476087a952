"""Connected components of an edge table, by alternating stars; nothing of the graph reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialise_at


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """Of edges (a, b) between long nodes: node and root, the smallest node of its component; roots themselves included.

    Each round contracts stars around larger, then smaller neighbours (Kiveris et al. 2014) and is written to the
    shared folder. Nodes without an edge don't appear. Null ends and loops are ignored; no edges give no rows.
    """
    now, path = materialise_at(edges.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 999_983)).first())

    seen = None
    for _ in range(most_rounds):
        step = _small_star(_large_star(now)).where("u <> v").distinct()
        after, new = materialise_at(step, "stars")
        drop_table(edges.sparkSession, path)
        now, path, before, seen = after, new, seen, mark(after)
        if seen == before:
            break
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
