"""Loops of networks of any size: strongly connected components by colours that spread forwards and marks that spread back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def _spread(values: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, id, v): the least v of all ids from which an id can be reached, its own included; null if there is none.

    Only ids whose value changed tell their neighbours, and values meet before they are shuffled. Each round is a table.
    """
    now = written(values.select("project_id", "id", "v", F.col("v").isNotNull().alias("fresh")), "loop-values")
    while not now.where("fresh").isEmpty():
        told = now.where("fresh").select("project_id", F.col("id").alias("a"), "v").join(edges, ["project_id", "a"]).groupBy("project_id", F.col("b").alias("id")).agg(F.min("v").alias("m"))
        better = F.coalesce(F.col("m") < F.col("v"), F.col("m").isNotNull())
        now = written(now.join(told, ["project_id", "id"], "left").select("project_id", "id", F.when(better, F.col("m")).otherwise(F.col("v")).alias("v"), better.alias("fresh")), "loop-values")
    return now.drop("fresh")


def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges from ids that something leads to, to ids that lead somewhere: all others are in no loop."""
    into, out = edges.select("project_id", F.col("b").alias("a")).distinct(), edges.select("project_id", F.col("a").alias("b")).distinct()
    return written(edges.join(into, ["project_id", "a"], "left_semi").join(out, ["project_id", "b"], "left_semi"), "loop-edges")


def strong_components(links: DataFrame, trims: int = 2) -> DataFrame:
    """(project_id, task_id, component, size) of activities in loops; component is the least id of those that reach each other.

    links: project_id, pred, succ; null ones are left out and repeated ones count once. A link from an activity to itself makes
    a loop of one. In each turn every id takes the least id that reaches it as colour; ids of a colour that reach its namesake are
    a component, and links between colours or to a component go. Rounds grow with the longest path, not with the number of
    activities: no project is held by one task, and the driver sees only whether rows are left.
    """
    whole = written(links.select("project_id", F.col("pred").alias("a"), F.col("succ").alias("b")).dropna().distinct(), "loop-edges")
    found = [whole.where("a = b").select("project_id", F.col("a").alias("task_id"), F.col("a").alias("component"))]
    edges = whole.where("a <> b")
    while True:
        for _ in range(trims):
            edges = _trimmed(edges)
        if edges.isEmpty():
            break
        ids = edges.select("project_id", F.explode(F.array("a", "b")).alias("id")).distinct()
        colours = _spread(ids.withColumn("v", F.col("id")), edges)
        ends = {c: colours.select("project_id", F.col("id").alias(c), F.col("v").alias(f"colour_{c}")) for c in "ab"}
        same = written(edges.join(ends["a"], ["project_id", "a"]).join(ends["b"], ["project_id", "b"]).where("colour_a = colour_b").select("project_id", "a", "b"), "loop-edges")
        back = same.select("project_id", F.col("b").alias("a"), F.col("a").alias("b"))
        marks = _spread(colours.select("project_id", "id", F.when(F.col("id") == F.col("v"), 0).alias("v")), back)
        inside = marks.where("v = 0").select("project_id", "id")
        members = colours.join(inside, ["project_id", "id"], "left_semi").select("project_id", F.col("id").alias("task_id"), F.col("v").alias("component"))
        found.append(members)
        for c in "ab":
            same = same.join(inside.withColumnRenamed("id", c), ["project_id", c], "left_anti")
        edges = written(same, "loop-edges")
    every = reduce(DataFrame.unionByName, found)
    # A loop of one may lie in a larger component, and a component of one without such a link is no loop.
    sizes = every.groupBy("project_id", "component").agg(F.count_distinct("task_id").alias("size"))
    alone = found[0].select("project_id", "component")
    kept = sizes.where("size > 1").unionByName(sizes.where("size = 1").join(alone, ["project_id", "component"], "left_semi"))
    one = every.join(kept, ["project_id", "component"]).groupBy("project_id", "task_id").agg(F.max(F.struct("size", "component")).alias("s"))
    return one.select("project_id", "task_id", "s.component", "s.size")


def loop_links(links: DataFrame, components: DataFrame) -> DataFrame:
    """The links inside a loop, with its component: one of each loop's must go before dates can be computed."""
    of = lambda c: components.select("project_id", F.col("task_id").alias(c), F.col("component").alias(f"_{c}"))
    both = links.join(of("pred"), ["project_id", "pred"]).join(of("succ"), ["project_id", "succ"]).where("_pred = _succ")
    return both.withColumnRenamed("_pred", "component").drop("_succ")
