"""Stores that queries write into the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..registry import query, table
from ..session import shared_folder
from ..sources.graph_store import GraphStore
from ..streaming.ingest import KeyedTable
from .schedule import _ACT_SQL, _LINK_SQL, activities, links

_NODE = T.StructType([T.StructField("project_id", T.LongType()), T.StructField("node", T.StringType()), T.StructField("start", T.DateType()), T.StructField("duration", T.DoubleType()), T.StructField("note", T.StringType())])
_EDGE = T.StructType([T.StructField("project_id", T.LongType()), T.StructField("pred", T.StringType()), T.StructField("succ", T.StringType()), T.StructField("rel_type", T.StringType()), T.StructField("lag_days", T.IntegerType())])

# Tenants are made of many orders: their activities are nodes, the links between them edges.
_GRAPH_SQL = f"""WITH {_ACT_SQL}, {_LINK_SQL}, n0 AS (SELECT project_id % 40 AS t, project_id || '/' || seq AS node, start, duration, l_partkey FROM act),
    n1 AS (SELECT t, node, start, CASE WHEN t % 2 = 0 AND l_partkey % 3 = 0 THEN duration + 1 ELSE duration END AS duration, CASE WHEN t % 2 = 0 AND l_partkey % 3 = 0 THEN 'longer' END AS note FROM n0 WHERE t % 5 <> 0 AND NOT (t % 3 = 0 AND l_partkey % 7 = 0)),
    e1 AS (SELECT project_id % 40 AS t, count(*) AS n_edges, sum(lag_days) AS lags FROM link WHERE project_id % 40 % 5 <> 0 GROUP BY 1)"""


def graph_store(spark: SparkSession, d: str) -> GraphStore:
    """All activities and links of 40 tenants, loaded, changed twice in the same way, thinned out, and some tenants wiped."""
    act = activities(spark, d)
    tenant = F.col("project_id") % 40
    name = lambda p, s: F.concat_ws("/", F.col(p).cast("string"), F.col(s).cast("string"))
    nodes = act.select(tenant.alias("project_id"), name("project_id", "seq").alias("node"), "start", "duration", "l_partkey")
    edges = links(act).select(tenant.alias("project_id"), name("project_id", "pred").alias("pred"), name("project_id", "succ").alias("succ"), "rel_type", "lag_days")
    store = GraphStore(spark, f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}", {"nodes": _NODE, "edges": _EDGE})
    store.merge("nodes", nodes, ["node"])
    store.merge("edges", edges, ["pred", "succ"])
    change = nodes.where("project_id % 2 = 0 AND l_partkey % 3 = 0").select("project_id", "node", (F.col("duration") + 1).alias("duration"), F.lit("longer").alias("note"))
    for _ in range(2):
        store.merge("nodes", change, ["node"])
    store.merge("nodes", nodes.limit(0), ["node"], without=nodes.where("project_id % 3 = 0 AND l_partkey % 7 = 0"))
    store.wipe(spark.range(0, 40, 5).withColumnRenamed("id", "project_id"))
    return store


@query("graph_nodes", f"{_GRAPH_SQL} SELECT t AS project_id, node, start, duration, note FROM n1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return graph_store(spark, d).read("nodes")


@query("graph_degrees", f"{_GRAPH_SQL} SELECT n.t AS project_id, n_nodes, total, n_edges, lags FROM (SELECT t, count(*) AS n_nodes, sum(duration) AS total FROM n1 GROUP BY 1) n JOIN e1 USING (t)")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and edges of each tenant that is left."""
    store = graph_store(spark, d)
    nodes = store.read("nodes").groupBy("project_id").agg(F.count("*").alias("n_nodes"), F.sum("duration").alias("total"))
    return nodes.join(store.read("edges").groupBy("project_id").agg(F.count("*").alias("n_edges"), F.sum("lag_days").alias("lags")), "project_id")


@query("ingest_batches", "SELECT event_id, user_id, event_type, value, CAST(event_id % 3 AS INTEGER) AS batch FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    """All events in three batches that overlap: each keeps the events that no batch before it brought, and its own copy of them."""
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    schema = T.StructType([*events.schema.fields, T.StructField("batch", T.IntegerType())])
    held = KeyedTable(spark, f"{shared_folder(spark)}/events-{uuid.uuid4().hex}", schema, ["event_id"], buckets=8)
    for n in range(3):
        held.add(events.where(F.col("event_id") % 3 <= n).withColumn("batch", F.lit(n)), n)
    held.add(events.withColumn("batch", F.lit(2)), 2)  # a batch that comes again
    return held.read()
