"""Report and rule queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports as P
from ..operators import rules as U
from ..registry import query, table


@query("status_summary", "SELECT count(*) FILTER (o_orderstatus = 'F') AS passed, count(*) FILTER (o_orderstatus = 'P') AS warnings, count(*) FILTER (o_orderstatus = 'O') AS failed FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return P.status_summary(table(spark, d, "orders").select(F.when(s == "F", "pass").when(s == "P", "warning").when(s == "O", "fail").alias("status")), "status")


@query("phase_rollup", "SELECT o_orderpriority AS phase, count(*) AS n, min(CAST(o_orderdate AS DATE)) AS start, max(CAST(o_orderdate AS DATE)) AS finish, CAST(sum(CASE WHEN o_totalprice > 300000 THEN 1 ELSE 0 END) AS BIGINT) AS n_critical FROM orders GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("phase"), F.col("o_orderdate").cast("date").alias("day"), "o_totalprice")
    return P.phase_rollup(o, "phase", "day", "day", F.col("o_totalprice") > 300000)


@query("accuracy_by_category", "SELECT coalesce(lang, 'all') AS category, count(*) AS total, CAST(sum(quality) AS BIGINT) AS correct, round(100.0::DOUBLE * sum(quality) / count(*), 2) AS percent FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)")
def _(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    out = own.rollup("lang").agg(F.count("*").alias("total"), F.sum("quality").alias("correct"))
    return out.select(F.coalesce("lang", F.lit("all")).alias("category"), "total", "correct", F.round(F.lit(100.0) * F.col("correct") / F.col("total"), 2).alias("percent"))


@query("collection_rollup", "SELECT coalesce(source, 'total') AS collection, count(*) AS n FROM documents GROUP BY ROLLUP (source)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").rollup("source").agg(F.count("*").alias("n")).select(F.coalesce("source", F.lit("total")).alias("collection"), "n")


@query("dedupe_oldest", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return P.oldest_of_each(table(spark, d, "orders"), ["o_custkey", "o_orderpriority"], [F.asc_nulls_last("o_orderdate"), F.asc("o_orderkey")]).select("o_orderkey")


@query("sequential_groups", """
    WITH m AS (SELECT conv_id, turn, length(text) > 200 AS long, sum(CASE WHEN (length(text) > 200) IS DISTINCT FROM lag(length(text) > 200) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS grp
      FROM (SELECT *, lag(1) OVER (PARTITION BY conv_id ORDER BY turn) AS z FROM conversations))
    SELECT conv_id, CAST(grp AS BIGINT) AS grp, long, count(*) AS n, min(turn) AS first FROM m GROUP BY ALL""".replace(
    "sum(CASE WHEN (length(text) > 200) IS DISTINCT FROM lag(length(text) > 200) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS grp\n      FROM (SELECT *, lag(1) OVER (PARTITION BY conv_id ORDER BY turn) AS z FROM conversations)",
    "sum(CASE WHEN z IS DISTINCT FROM (length(text) > 200) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS grp\n      FROM (SELECT *, lag(length(text) > 200) OVER (PARTITION BY conv_id ORDER BY turn) AS z FROM conversations)",
))
def _(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "conversations").withColumn("long", F.char_length("text") > 200)
    return P.sequential_groups(own, "conv_id", ["turn"], "long")


@query("effective_checklist", """
    WITH own AS (SELECT o_custkey AS user_id, o_orderpriority AS item FROM orders WHERE o_orderstatus = 'P'), shared AS (SELECT DISTINCT o_orderpriority AS item FROM orders)
    SELECT user_id, item FROM own UNION ALL SELECT c_custkey, item FROM customer, shared WHERE c_custkey NOT IN (SELECT user_id FROM own)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    own = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("item"))
    shared = o.select(F.col("o_orderpriority").alias("item")).distinct()
    return P.effective_rows(own, shared, "user_id", table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")))


@query("recent_conversations", "SELECT conv_id, n_turns FROM (SELECT conv_id, max(turn) AS last, count(*) AS n_turns FROM conversations GROUP BY 1) ORDER BY last DESC, conv_id LIMIT 40")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last"), F.count("*").alias("n_turns")).orderBy(F.desc("last"), "conv_id").limit(40).select("conv_id", "n_turns")


@query("message_history", "SELECT conv_id, turn, role FROM conversations WHERE role = 'user'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "role")


@query("run_compare", "SELECT o_orderkey, o_orderpriority AS left_value, CASE WHEN o_orderkey % 5 = 0 THEN '1-URGENT' ELSE o_orderpriority END AS right_value, (o_orderkey % 5 = 0 AND o_orderpriority <> '1-URGENT') AS changed FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("v"))
    return P.compare_runs(o, o.withColumn("v", F.when(F.col("o_orderkey") % 5 == 0, "1-URGENT").otherwise(F.col("v"))), "o_orderkey", "v")


@query("examples_list", """
    WITH t AS (SELECT p_brand, 'item ' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS item FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY item) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM t)
    SELECT p_brand, string_agg(item, '; ' ORDER BY item) || CASE WHEN max(n) > 10 THEN ' and ' || (max(n) - 10) || ' more' ELSE '' END AS text FROM r WHERE r <= 10 GROUP BY p_brand""")
def _(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "part").select("p_brand", F.concat(F.lit("item "), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("item"))
    return P.examples(own, "p_brand", "item", 10)


@query("verdict_derive", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'Fail' WHEN l_linestatus = 'O' THEN 'Missing' ELSE 'Pass' END AS verdict, CASE WHEN l_returnflag = 'R' THEN 'fail' WHEN l_linestatus = 'O' THEN 'warning' ELSE 'pass' END AS status FROM lineitem")
def _(spark: SparkSession, d: str) -> DataFrame:
    one, none = F.array(F.lit("x")), F.array().cast("array<string>")
    v = U.derive(F.when(F.col("l_returnflag") == "R", one).otherwise(none), F.when(F.col("l_linestatus") == "O", one).otherwise(none))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", v.alias("verdict")).withColumn("status", U.ui_status(F.col("verdict")))


@query("item_validate", "SELECT * FROM (VALUES (0, 'b', ''), (1, '', 'zz'), (2, '', '')) v(id, orphaned, invented)")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = [(0, ["a"], ["a", "b"], "uses a."), (1, ["a", "zz"], ["a"], "a and zzz"), (2, ["105.03"], ["105.03"], "see 105.03, ok")]
    df = spark.createDataFrame(rows, "id int, found array<string>, expected array<string>, evidence string")
    return df.select("id", U.validate_items(F.col("found"), F.col("expected"), F.col("evidence")).alias("v")).select("id", F.array_join("v.orphaned", "|").alias("orphaned"), F.array_join("v.invented", "|").alias("invented"))


_LAT, _LON = "39.0 + (p_partkey % 240) / 100.0", "-75.5 + (p_partkey % 160) / 100.0"
_SEGMENTS = " ".join(f"WHEN lon <= {b[1]} THEN {a[0]} + (lon - ({a[1]})) * ({(b[0] - a[0]) / (b[1] - a[1])!r})" for a, b in zip(U.DIVIDING_LINE, U.DIVIDING_LINE[1:], strict=False))


@query("polyline_region", f"""
    WITH p AS (SELECT p_partkey, CAST({_LAT} AS DOUBLE) AS lat, CAST({_LON} AS DOUBLE) AS lon FROM part), q AS (SELECT *, lat - CASE WHEN lon <= {U.DIVIDING_LINE[0][1]} THEN {U.DIVIDING_LINE[0][0]} {_SEGMENTS} ELSE {U.DIVIDING_LINE[-1][0]} END AS delta, (lat BETWEEN 38.90 AND 41.40 AND lon BETWEEN -75.60 AND -73.85) AS inside FROM p)
    SELECT p_partkey, CASE WHEN inside THEN CASE WHEN delta > 0 THEN 'NORTH' ELSE 'SOUTH' END END AS region, (inside AND abs(delta) < 0.015) AS borderline FROM q""")
def _(spark: SparkSession, d: str) -> DataFrame:
    lat, lon = (F.lit(39.0) + (F.col("p_partkey") % 240) / 100.0), (F.lit(-75.5) + (F.col("p_partkey") % 160) / 100.0)
    return table(spark, d, "part").select("p_partkey", U.region(lat, lon).alias("r")).select("p_partkey", "r.region", "r.borderline")


@query("milestone_pick", """
    WITH g AS (SELECT l_orderkey AS project, count(*) FILTER (l_linenumber IN (6, 7)) AS i, max(CASE WHEN l_linenumber IN (6, 7) THEN CAST(l_shipdate AS DATE) END) AS f, count(*) FILTER (l_returnflag = 'R') AS n, max(CASE WHEN l_returnflag = 'R' THEN CAST(l_shipdate AS DATE) END) AS gg FROM lineitem GROUP BY 1)
    SELECT project, CASE WHEN i = 1 THEN f WHEN i = 0 AND n = 1 THEN gg END AS finish FROM g""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("project"), F.col("l_linenumber").cast("string").alias("task_id"), F.col("l_returnflag").alias("name"), F.col("l_shipdate").cast("date").alias("finish"), F.lit(None).cast("date").alias("start"))
    return U.pick_milestone(rows, "project", ("6", "7"), "^R$")


@query("next_sort_order", "SELECT o_custkey, coalesce(max(o_orderkey), -1) + 1 AS next FROM orders GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg((F.coalesce(F.max("o_orderkey"), F.lit(-1)) + 1).alias("next"))


@query("owner_filter", "SELECT o_orderkey FROM orders WHERE o_custkey = 7 OR nullif(o_orderpriority, '5-LOW') IS NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Own rows, and shared ones: those without an owner."""
    return table(spark, d, "orders").where((F.col("o_custkey") == 7) | F.nullif("o_orderpriority", F.lit("5-LOW")).isNull()).select("o_orderkey")
