"""Reports: summaries, roll-ups, sequential groups, effective checklists, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def status_summary(df: DataFrame, status: str) -> DataFrame:
    return df.agg(F.count_if(F.col(status) == "pass").alias("passed"), F.count_if(F.col(status) == "warning").alias("warnings"), F.count_if(F.col(status) == "fail").alias("failed"))


def phase_rollup(df: DataFrame, phase: str, start: str, finish: str, critical: Column) -> DataFrame:
    return df.groupBy(phase).agg(F.count("*").alias("n"), F.min(start).alias("start"), F.max(finish).alias("finish"), F.sum(F.when(critical, 1).otherwise(0)).alias("n_critical"))


def oldest_of_each(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; null keys are one key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def sequential_groups(df: DataFrame, partition: str, order: list[str], category: str) -> DataFrame:
    """(partition, grp, category, n, first): runs of equal categories in order."""
    w = Window.partitionBy(partition).orderBy(*order)
    change = F.when(F.lag(F.struct(category)).over(w).isNull() | ~F.lag(category).over(w).eqNullSafe(F.col(category)), 1).otherwise(0)
    marked = df.withColumn("grp", F.sum(change).over(w))
    return marked.groupBy(partition, "grp", category).agg(F.count("*").alias("n"), F.min(order[0]).alias("first"))


def effective_rows(own: DataFrame, shared: DataFrame, owner: str, owners: DataFrame) -> DataFrame:
    """Each owner's own rows if there are any, else the shared ones."""
    without = owners.select(owner).distinct().join(own.select(owner).distinct(), owner, "left_anti")
    return own.unionByName(without.join(F.broadcast(shared), F.lit(True)).select(*own.columns))


def compare_runs(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    a, b = left.select(key, F.col(value).alias("left_value")), right.select(key, F.col(value).alias("right_value"))
    return a.join(b, key).withColumn("changed", ~F.col("left_value").eqNullSafe(F.col("right_value")))


def examples(df: DataFrame, group: str, item: str, k: int) -> DataFrame:
    """(group, text): the k first items joined by '; ', with how many more there are. Only k items of each group meet in one place."""
    r = F.row_number().over(Window.partitionBy(group).orderBy(item))
    top = df.withColumn("_r", r).where(F.col("_r") <= k).groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(item)), "; ").alias("text"))
    counts = df.groupBy(group).agg(F.count("*").alias("n"))
    more = F.when(F.col("n") > k, F.concat(F.lit(" and "), (F.col("n") - k).cast("string"), F.lit(" more"))).otherwise("")
    return top.join(counts, group).select(group, F.concat("text", more).alias("text"))


def usage_totals(calls: DataFrame, group: str, counts: list[str]) -> DataFrame:
    """Calls and sums of token counts, for each group and (group null) for all."""
    total = sum((F.col(c) for c in counts), F.lit(0))
    return calls.rollup(group).agg(F.count("*").alias("calls"), *[F.sum(c).cast("long").alias(c) for c in counts], F.sum(total).cast("long").alias("total"))


def stability(runs: DataFrame, key: str, item: str) -> DataFrame:
    """(key, stable, ids): the distinct items that repeated runs gave; stable with one at most."""
    return runs.groupBy(key).agg(F.array_sort(F.collect_set(item)).alias("ids")).select(key, (F.size("ids") <= 1).alias("stable"), "ids")


def with_builtins(asked: DataFrame, catalog: DataFrame, k: int = 8) -> DataFrame:
    """Checks as asked for, with the kind and depth of the catalog where it knows them; a depth that isn't positive becomes k."""
    known = catalog.select("check_key", F.col("check_type").alias("_type"), F.col("sp_top_k").alias("_k"), F.lit(True).alias("_known"))
    depth = F.when(F.col("_known"), F.col("_k")).otherwise(F.col("sp_top_k"))
    out = asked.join(known, "check_key", "left").withColumn("check_type", F.coalesce("_type", "check_type")).withColumn("sp_top_k", F.when(depth > 0, depth).otherwise(k))
    return out.drop("_type", "_k", "_known")
