"""Scalar functions, loads and small rules as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as X
from ..operators import chunking as C
from ..registry import query, table
from ..sources import chunks as S


def _one(spark: SparkSession, d: str, name: str, key: str, column) -> DataFrame:
    return table(spark, d, name).select(key, column)


@query("hours_to_days", "SELECT o_orderkey, CAST(round_even(o_custkey / CASE WHEN o_orderkey % 3 = 0 THEN 8.0 ELSE 10.0 END, 0) AS INTEGER) AS days FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _one(spark, d, "orders", "o_orderkey", D.hours_to_days(F.col("o_custkey").cast("double"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(None).cast("double")).otherwise(10.0)).alias("days"))


@query("serial_date", "SELECT o_orderkey, DATE '1899-12-30' + CAST(35000 + o_custkey AS INTEGER) AS day FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _one(spark, d, "orders", "o_orderkey", D.serial_date(F.col("o_custkey") + 35000).alias("day"))


@query("long_date_parse", "SELECT * FROM (VALUES (0, DATE '2024-01-05'), (1, DATE '2024-01-05'), (2, DATE '2024-01-05'), (3, DATE '2024-01-05'), (4, NULL)) v(id, day)")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = list(enumerate(["January 5, 2024", "5 January 2024", "1/5/2024", "2024-01-05", "soon"]))
    return spark.createDataFrame(rows, "id int, t string").select("id", D.long_date(F.col("t")).alias("day"))


@query("effective_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + CASE WHEN o_orderpriority = '1-URGENT' THEN 7 ELSE 0 END AS day FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("o_orderpriority") == "1-URGENT", "U").otherwise("N")
    return _one(spark, d, "orders", "o_orderkey", D.effective_date(F.col("o_orderdate").cast("date"), code).alias("day"))


@query("section_of_table", "SELECT l_orderkey, l_linenumber, CAST(100 + l_partkey % 900 AS VARCHAR) || '.05' AS section FROM lineitem")
def _(spark: SparkSession, d: str) -> DataFrame:
    number = F.concat((F.lit(100) + F.col("l_partkey") % 900).cast("string"), F.lit(".05-"), F.col("l_linenumber").cast("string"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.section_of_table(number).alias("section"))


@query("fence_strip", "SELECT * FROM (VALUES (0, '{}'), (1, 'plain'), (2, 'x')) v(id, body)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(0, "```json\n{}\n```"), (1, " plain "), (2, "a ```\nx\n``` b")], "id int, t string").select("id", X.without_fence(F.col("t")).alias("body"))


@query("key_normalise", "SELECT event_id, event_type AS k FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _one(spark, d, "events", "event_id", X.plain_key(F.concat(F.lit("a.B."), F.upper("event_type"))).alias("k"))


@query("pred_list", "SELECT l_orderkey, array_to_string(list_sort(list(l_partkey))[1:4], ', ') || CASE WHEN count(*) > 4 THEN ' +' || (count(*) - 4) ELSE '' END AS preds FROM lineitem GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_partkey")).alias("p"))
    return own.select("l_orderkey", X.short_list(F.transform("p", lambda x: x.cast("string"))).alias("preds"))


@query("numbered_parse", "SELECT * FROM (VALUES (0, 'one|two three'), (1, '')) v(id, parts)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(0, "1. one\n2.  two three\nx"), (1, "none")], "id int, t string").select("id", F.array_join(X.numbered_lines(F.col("t")), "|").alias("parts"))


@query("federal_number", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'NHP-' || lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') || '(104)' END AS number FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Project NHP-"), F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0"), F.lit("(104), state"))).otherwise("no number")
    return _one(spark, d, "orders", "o_orderkey", X.federal_number(text).alias("number"))


@query("preview", "SELECT doc_id, CASE WHEN length(text) > 300 THEN text[1:300] || '...' ELSE text END AS preview FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _one(spark, d, "documents", "doc_id", X.preview(F.col("text")).alias("preview"))


@query("text_layer_hint", "SELECT doc_id, CASE WHEN length(trim(text, ' ')) >= 40 THEN text[1:4000] END AS hint FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _one(spark, d, "documents", "doc_id", X.text_layer(F.col("text")).alias("hint"))


@query("conflicting_sources", "SELECT doc_id, (quality IS NOT NULL AND toxic IS NOT NULL AND quality <> toxic) AS conflict FROM labels")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _one(spark, d, "labels", "doc_id", X.conflicting(F.col("quality"), F.col("toxic")).alias("conflict"))


@query("table_markdown", "SELECT 0 AS id, '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 |  |' AS md")
def _(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(0, [["a", "b"], ["1"]])], "id int, g array<array<string>>").select("id", C.table_markdown(F.col("g")).alias("md"))


@query("narrative_heading", "SELECT * FROM (VALUES (0, true), (1, true), (2, false), (3, false)) v(id, heading)")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = list(enumerate(["Project Overview", "CRITICAL PATH", "1. Numbered item", "a plain sentence."]))
    return spark.createDataFrame(rows, "id int, t string").select("id", C.narrative_heading(F.col("t")).alias("heading"))


@query("collection_resolve", "SELECT DISTINCT source AS target, CASE WHEN source = 'src1' OR starts_with(source, 'src1_') THEN 'src1' WHEN source = 'src2' THEN 'src2' END AS collection FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([("src1",), ("src2",)], "collection string")
    return S.resolve_collections(table(spark, d, "documents").select(F.col("source").alias("target")).distinct(), known)


@query("load_guard", "SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.lit("c").alias("collection"))
    held = table(spark, d, "labels").select(F.col("doc_id").alias("doc"), F.lit("c").alias("collection"))
    return S.new_rows(rows, held).select(F.col("doc").alias("doc_id"))


@query("copy_report", """SELECT source, n_source, n_target, CASE WHEN n_source = n_target THEN 'copied' WHEN n_target = 0 THEN 'missing' ELSE 'mismatch' END AS state
    FROM (SELECT source, count(*) AS n_source, count(*) FILTER (lang = 'en') AS n_target FROM documents GROUP BY 1)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "lang")
    return S.copy_report(docs, docs.where("lang = 'en'"), "source")


@query("ttl_filter", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("expires_at"))
    return S.live(rows, "2024-01-15 00:00:00").select("event_id")


@query("project_type", "SELECT l_orderkey, CASE WHEN avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) >= 0.5 AND count(*) FILTER (l_linestatus = 'F') = 0 THEN 'pavement' ELSE 'state' END AS kind FROM lineitem GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    ratio, structures = F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)), F.count_if(F.col("l_linestatus") == "F")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.when((ratio >= 0.5) & (structures == 0), "pavement").otherwise("state").alias("kind"))
