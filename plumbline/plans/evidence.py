"""Queries of rules, searches, links, progress and schedule exports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import graph as G
from ..operators import retrieval as R
from ..operators import rules as U
from ..registry import query, table
from ..sources import chunks as S
from ..sources import xer
from ..streaming import progress as P
from .retrieval import _COS, _TOKENS, _list_sql, _probe
from .schedule import _ACT_SQL, activities


@query("resolved_point", """SELECT c_custkey, CAST(CASE c_custkey % 3 WHEN 0 THEN 40.5 ELSE 40.25 END AS DOUBLE) AS lat, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN CAST(-74.5 AS DOUBLE) ELSE -(73 + c_nationkey * CAST(0.1 AS DOUBLE)) END AS lon, CASE WHEN c_custkey % 5 = 0 THEN 'longitude' ELSE '' END AS missing FROM customer""")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    lon = F.when(k % 5 >= 2, F.lit(73.0) + F.col("c_nationkey") * 0.1)
    r = U.resolved_point(F.when(k % 3 == 0, "40 30 00 N"), F.when(k % 5 == 1, "74 30 0 W"), F.lit(40.25), lon)
    return table(spark, d, "customer").select("c_custkey", r.alias("r")).select("c_custkey", "r.lat", "r.lon", F.array_join("r.missing", ",").alias("missing"))


@query("region_check", "SELECT c_custkey, CASE WHEN c_nationkey % 4 = 0 THEN 'Missing' ELSE 'Pass' END AS status FROM customer")
def _(spark: SparkSession, d: str) -> DataFrame:
    lat = F.when(F.col("c_nationkey") % 4 != 0, F.lit(40.5) - F.col("c_nationkey") * 0.05)
    return table(spark, d, "customer").select("c_custkey", U.region_status(U.region(lat, F.lit(-74.5))["region"]).alias("status"))


_ITEMS_SQL = """it AS (SELECT l_orderkey AS project_id, l_partkey, CASE WHEN l_partkey % 6 = 0 THEN 'Mobilization' WHEN l_suppkey % 5 = 0 AND l_orderkey % 3 = 0 THEN 'Bridge deck' WHEN l_partkey % 3 <> 1 THEN 'MILLING of ' || l_partkey ELSE 'Seeding' END AS description,
    CASE WHEN l_quantity > 10 THEN l_discount * 10 END AS confidence FROM lineitem)"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("l_partkey")
    text = F.when(p % 6 == 0, "Mobilization").when((F.col("l_suppkey") % 5 == 0) & (F.col("l_orderkey") % 3 == 0), "Bridge deck").when(p % 3 != 1, F.concat(F.lit("MILLING of "), p)).otherwise("Seeding")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("project_id"), p.alias("item"), text.alias("description"), F.when(F.col("l_quantity") > 10, F.col("l_discount") * 10).alias("confidence"))


@query("project_types", f"""WITH {_ITEMS_SQL}, g AS (SELECT project_id, count(*) AS n, count(*) FILTER (WHERE description LIKE 'MILLING%') AS m, count(*) FILTER (WHERE description = 'Bridge deck') AS s FROM it WHERE description <> 'Mobilization' GROUP BY 1),
    k AS (SELECT o_orderkey AS project_id, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN 'Federal' WHEN s = 0 AND 2 * m >= n THEN 'Pavement Preservation' ELSE 'State' END AS kind FROM orders LEFT JOIN g ON project_id = o_orderkey)
    SELECT project_id, kind, CASE kind WHEN 'Federal' THEN 55 WHEN 'State' THEN 40 ELSE 25 END AS minimum FROM k""")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    projects = table(spark, d, "orders").select(k.alias("project_id"), F.when(k % 7 == 0, "0049303").alias("federal_no"), F.when(k % 11 == 0, "NHP-0049(303)").alias("narrative_no"))
    return U.project_types(projects, _items(spark, d))


@query("item_coverage", f"""WITH {_ITEMS_SQL}, g AS (SELECT project_id, count(*) FILTER (WHERE description <> 'Mobilization') AS total, count(*) FILTER (WHERE description = 'Mobilization') AS excluded, count(*) FILTER (WHERE description <> 'Mobilization' AND confidence IS NULL) AS uncovered,
    count(*) FILTER (WHERE description <> 'Mobilization' AND confidence < 0.6) AS low, count(*) FILTER (WHERE description <> 'Mobilization' AND confidence >= 0.6) AS covered FROM it GROUP BY 1)
    SELECT *, CASE WHEN uncovered > 0 THEN 'Fail' WHEN low > 0 THEN 'Missing' ELSE 'Pass' END AS status FROM g""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return U.item_coverage(_items(spark, d))


@query("award_gap_rule", """WITH p AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CASE WHEN o_custkey % 9 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_custkey % 90 AS INTEGER) END AS b, CASE o_orderkey % 3 WHEN 0 THEN 55 WHEN 1 THEN 40 ELSE 25 END AS least FROM orders),
    n AS (SELECT o_orderkey, least, CASE WHEN b IS NOT NULL THEN (SELECT count(*) FROM range(a + 1, b + 1, INTERVAL 1 DAY) t(r) WHERE isodow(r) <= 5) END AS gap FROM p)
    SELECT o_orderkey, CASE WHEN gap IS NULL THEN 'Missing' WHEN gap >= least THEN 'Pass' ELSE 'Fail' END AS status FROM n""")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    own = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("a"), F.when(F.col("o_custkey") % 9 != 0, F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_custkey") % 90).cast("int"))).alias("b"), F.when(k == 0, 55).when(k == 1, 40).otherwise(25).alias("least"))
    cal = D.calendar_days(spark, "1990-01-01", "2006-12-31")
    return D.work_days_between(own, cal, "a", "b").select("o_orderkey", U.status(U.gap_rule(F.col("work_days"), F.col("least"))).alias("status"))


@query("cost_gap_full", """WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 7000 WHEN o_orderkey % 4 = 2 THEN 12500000 ELSE 62000000 END AS cost, CASE WHEN o_custkey % 6 <> 0 THEN CAST(o_custkey % 120 AS INTEGER) - 10 END AS gap FROM orders)
    SELECT o_orderkey, CASE WHEN gap IS NULL OR cost IS NULL OR cost < 10000 THEN 'Missing' WHEN gap >= CASE WHEN cost <= 50000000 THEN 60 ELSE 90 END THEN 'Pass' ELSE 'Fail' END AS status FROM p""")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    cost = F.when(k == 0, "no amount").when(k == 1, "$7,000.00").when(k == 2, "$12.5 million").otherwise("about $62M in all")
    day = F.col("o_orderdate").cast("date")
    final = F.when(F.col("o_custkey") % 6 != 0, F.date_add(day, (F.col("o_custkey") % 120).cast("int") - 10))
    return table(spark, d, "orders").select("o_orderkey", U.status(U.cost_gap(cost, day, final)).alias("status"))


@query("export_calendar", """SELECT s_suppkey, ['Mon', 'Tue'] AS work_days, [DATE '1899-12-30' + CAST(44000 + s_suppkey AS INTEGER)] AS exceptions, [DATE '1899-12-30' + 44500] AS overrides FROM supplier""")
def _(spark: SparkSession, d: str) -> DataFrame:
    shift = "(0||0(s|08:00|f|16:00)())"
    text = F.concat(F.lit(f"(0||CalendarData()((0||DaysOfWeek()((0||1()())(0||2()({shift}))(0||3()({shift}))(0||4()())(0||5()())(0||6()())(0||7()())))(0||Exceptions()((0||0(d|"), (F.col("s_suppkey") + 44000).cast("string"), F.lit(f")())(0||1(d|44500)({shift})))))"))
    c = D.export_calendar(text)
    return table(spark, d, "supplier").select("s_suppkey", c.alias("c")).select("s_suppkey", "c.work_days", "c.exceptions", "c.overrides")


def _export(spark: SparkSession, d: str) -> DataFrame:
    """Each order as a schedule export: a calendar of ten hours, a header, a task for each line item, some twice."""
    act = activities(spark, d).select("project_id", "seq", "l_partkey", "duration", "start")
    tab = lambda *c: F.concat_ws("\t", *[x if not isinstance(x, str) else F.lit(x) for x in c])
    head = act.select("project_id").distinct()
    parts = [
        head.select("project_id", F.lit(i).alias("n"), line.alias("line"))
        for i, line in enumerate([tab("%T", "CALENDAR"), tab("%F", "clndr_id", "clndr_name", "day_hr_cnt", "clndr_data"), tab("%R", "c1", "Ten", "10", ""), tab("%T", "PROJECT"), tab("%F", "proj_id", "proj_short_name"), tab("%R", F.col("project_id").cast("string"), "P"), tab("%R", "none", "Q"), tab("%T", "TASK"), tab("%F", "proj_id", "task_code", "task_name", "clndr_id", "status_code", "act_start_date", "target_drtn_hr_cnt", "remain_drtn_hr_cnt")])
    ]
    status = F.when(F.col("seq") == 1, "TK_Complete").when(F.col("seq") == 2, "TK_Active").otherwise("TK_NotStart")
    rows = lambda base, code, name: act.select("project_id", (F.lit(base) + F.col("seq")).alias("n"), tab("%R", F.col("project_id").cast("string"), code, name, F.when(F.col("l_partkey") % 2 == 0, "c1").otherwise("lost"), status, F.when(F.col("seq") <= 2, F.concat(F.col("start").cast("string"), F.lit(" 08:00"))).otherwise(""), (F.col("duration") * 10).cast("string"), (F.col("duration") * 5).cast("string")).alias("line"))
    code = F.concat(F.lit("A"), F.col("seq"))
    parts += [rows(100, code, F.lit("old")), rows(10000, code, F.concat(F.lit("part "), "l_partkey"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return xer.tables(out.select(F.col("project_id").cast("string").alias("file"), F.col("n").alias("line_no"), "line"))


@query("xer_activities", f"""WITH {_ACT_SQL} SELECT project_id, seq, 'part ' || l_partkey AS name, CASE seq WHEN 1 THEN 'Complete' WHEN 2 THEN 'In Progress' ELSE 'Not Started' END AS status, CASE WHEN seq <= 2 THEN start END AS actual_start,
    CAST(round_even(CAST(duration AS DOUBLE) * 10 / CASE WHEN l_partkey % 2 = 0 THEN 10 ELSE 8 END, 0) AS INTEGER) AS original, CAST(round_even(CAST(duration AS DOUBLE) * 5 / CASE WHEN l_partkey % 2 = 0 THEN 10 ELSE 8 END, 0) AS INTEGER) AS remaining FROM act""")
def _(spark: SparkSession, d: str) -> DataFrame:
    out = xer.full_activities(_export(spark, d))
    return out.select(F.col("project_id").cast("long").alias("project_id"), F.substring("task_id", 2, 9).cast("int").alias("seq"), "name", "status", "actual_start", "original", "remaining")


@query("xer_projects", f"""WITH {_ACT_SQL} SELECT CAST(project_id AS VARCHAR) AS file, CAST(project_id AS VARCHAR) AS project_id, 'P' AS name, 2 * count(*) AS n_tasks, true AS is_main FROM act GROUP BY project_id
    UNION ALL SELECT DISTINCT CAST(project_id AS VARCHAR), 'none', 'Q', 0, false FROM act""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return xer.projects(_export(spark, d))


@query("web_search", f"""WITH t AS (SELECT doc_id, {_TOKENS} AS t FROM documents), j AS (SELECT doc_id, t, ' ' || array_to_string(t, ' ') || ' ' AS j FROM t),
    h AS (SELECT doc_id, t FROM j WHERE (contains(j, ' the ') AND contains(j, ' of the ') AND NOT contains(j, ' with ')) OR contains(j, ' und '))
    SELECT doc_id, round(len(list_filter(t, lambda x: x = 'the')) / (len(list_filter(t, lambda x: x = 'the')) + 1.0) + len(list_filter(t, lambda x: x = 'of')) / (len(list_filter(t, lambda x: x = 'of')) + 1.0) + len(list_filter(t, lambda x: x = 'und')) / (len(list_filter(t, lambda x: x = 'und')) + 1.0), 6) AS rank_score FROM h""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return R.web_search(table(spark, d, "documents"), 'the "of the" -with OR und', None).select("doc_id", F.round("rank_score", 6).alias("rank_score"))


_HYBRID_WORDS = "len(list_filter(t, lambda x: x = '{0}')) / (len(list_filter(t, lambda x: x = '{0}')) + 1.0)"


@query("hybrid_search", f"""WITH k AS (SELECT doc_id AS id, row_number() OVER (ORDER BY s DESC, doc_id) AS rank FROM (SELECT doc_id, {_HYBRID_WORDS.format('und')} + {_HYBRID_WORDS.format('nicht')} AS s FROM (SELECT doc_id, {_TOKENS} AS t FROM documents) WHERE list_contains(t, 'und') AND list_contains(t, 'nicht') ORDER BY s DESC, doc_id LIMIT 50)),
    v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM (SELECT e.vec_id, {_COS} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE {_COS} > 0 ORDER BY s DESC, e.vec_id LIMIT 50)),
    u AS (SELECT id, rank, 0 AS l, 0.6 AS w FROM v UNION ALL SELECT id, rank, 1, 0.4 FROM k), f AS (SELECT id, sum(CAST(w AS DOUBLE) / (60 + rank)) AS score, min(l * 1000 + rank) AS first FROM u GROUP BY 1),
    s AS (SELECT f.*, source, row_number() OVER (PARTITION BY coalesce(source, CAST(id AS VARCHAR)) ORDER BY score DESC, first) AS r FROM f LEFT JOIN documents ON doc_id = id) SELECT id, source AS section, round(score, 6) AS score FROM s WHERE r = 1 ORDER BY score DESC, first LIMIT 10""")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("section"))
    return R.hybrid_search(docs, table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "what is und nicht?", _probe(spark, d, 7), 10)


@query("session_vector_search", f"""SELECT e.vec_id, round({_COS}, 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q WHERE e.label = 2 AND e.vec_id % 5 <> 0 AND {_COS} >= 0.0 ORDER BY {_COS} DESC, e.vec_id LIMIT 8""")
def _(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "embeddings").withColumn("expires_at", F.when(F.col("vec_id") % 5 == 0, F.lit("2024-01-01")).otherwise("2034-01-01").cast("timestamp"))
    found = R.live_search(own, F.col("label") == 2, "2025-01-01", lambda df: R.vector_topk(df, _probe(spark, d, 3), 8, floor=0.0, inclusive=True))
    return found.select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("session_text_search", f"SELECT doc_id FROM (SELECT doc_id, {_TOKENS} AS t, lang FROM documents) WHERE lang = 'en' AND doc_id % 5 <> 0 AND list_contains(t, 'the') AND list_contains(t, 'that')")
def _(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents").withColumn("expires_at", F.when(F.col("doc_id") % 5 == 0, F.lit("2024-01-01")).otherwise("2034-01-01").cast("timestamp"))
    return R.live_search(own, F.col("lang") == "en", "2025-01-01", lambda df: R.web_search(df, "the that", None)).select("doc_id")


@query("static_passages", f"""WITH v AS (SELECT *, row_number() OVER (ORDER BY s DESC, vec_id) - 1 AS p FROM (SELECT e.vec_id, {_COS} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 9) q WHERE {_COS} > 0.1 ORDER BY s DESC, e.vec_id LIMIT 5))
    SELECT string_agg('[cite:csm-' || p || '] vector ' || vec_id, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY p) AS passages, count(*) AS n FROM v""")
def _(spark: SparkSession, d: str) -> DataFrame:
    found = R.vector_topk(table(spark, d, "embeddings"), _probe(spark, d, 9), 5, floor=0.1).withColumn("text", F.concat(F.lit("vector "), "vec_id"))
    return R.tagged_passages(found, "csm", [F.desc("similarity"), F.asc("vec_id")])


@query("narrative_search", f"SELECT e.vec_id, round({_COS}, 4) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 11) q ORDER BY {_COS} DESC, e.vec_id LIMIT 5")
def _(spark: SparkSession, d: str) -> DataFrame:
    return R.vector_topk(table(spark, d, "embeddings"), _probe(spark, d, 11), 5).select("vec_id", F.round("similarity", 4).alias("similarity"))


@query("entity_link_named", """SELECT DISTINCT event_id AS entity, 'A' || n AS activity FROM (SELECT event_id, unnest([event_id % 50, event_id % 30]) AS n FROM events) WHERE n > 5 AND n < 45""")
def _(spark: SparkSession, d: str) -> DataFrame:
    entities = table(spark, d, "events").select(F.col("event_id").alias("entity"), F.array(F.concat(F.lit("A"), F.col("event_id") % 50)).alias("activity_ids"), F.concat(F.lit("see A"), F.col("event_id") % 30, F.lit(", late")).alias("text"))
    return G.link_named(entities, spark.range(6, 45).select(F.concat(F.lit("A"), "id").alias("activity")))


@query("entity_link_dated_words", """WITH e AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CASE o_custkey % 3 WHEN 0 THEN 'bridge' WHEN 1 THEN 'drain' ELSE 'road' END AS w FROM orders), a AS (SELECT p_partkey, DATE '1996-01-01' + CAST(p_partkey % 300 AS INTEGER) AS d, CASE p_partkey % 2 WHEN 0 THEN 'bridge' ELSE 'road' END AS w FROM part)
    SELECT o_orderkey AS entity, p_partkey AS activity, CAST(0.5 AS DOUBLE) AS confidence FROM e JOIN a ON a.w = e.w AND length(a.w) >= 5 AND a.d BETWEEN e.d - 3 AND e.d + 3""")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_custkey") % 3
    e = table(spark, d, "orders").select(F.col("o_orderkey").alias("entity"), F.col("o_orderdate").cast("date").alias("date"), F.when(k == 0, "The Bridge!").when(k == 1, "drain off").otherwise("road").alias("name"))
    a = table(spark, d, "part").select(F.col("p_partkey").alias("activity"), F.date_add(F.lit("1996-01-01").cast("date"), (F.col("p_partkey") % 300).cast("int")).alias("date"), F.when(F.col("p_partkey") % 2 == 0, "new bridge").otherwise("road").alias("name"))
    return G.link_dated_words(e, a)


@query("progress_merged", "SELECT user_id, arg_max(event_type, (ts, event_id)) FILTER (WHERE event_id % 3 <> 0) AS status, arg_max(value, (ts, event_id)) FILTER (WHERE event_id % 4 <> 0) AS value FROM events GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("status"), F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("value"))
    return P.merged(own, ["status", "value"]).select("user_id", "status", "value")


@query("progress_counter", "SELECT user_id, least(count(*) FILTER (WHERE event_type IN ('purchase', 'error')), 10 + user_id % 5) AS done, 10 + user_id % 5 AS total FROM events GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return P.done_of_total(e, e.select("user_id", (F.col("user_id") % 5 + 10).alias("total")).distinct(), ("purchase", "error"))


@query("progress_fallback", """WITH live AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS s FROM events WHERE user_id % 3 = 0 GROUP BY 1), held AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS s FROM events WHERE user_id % 2 = 0 GROUP BY 1), k AS (SELECT DISTINCT user_id FROM events)
    SELECT user_id, coalesce(live.s, held.s) AS status, CASE WHEN live.s IS NOT NULL THEN 'live' WHEN held.s IS NOT NULL THEN 'stored' ELSE 'none' END AS origin FROM k LEFT JOIN live USING (user_id) LEFT JOIN held USING (user_id)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return P.with_fallback(P.latest(e.where("user_id % 3 = 0")), P.latest(e.where("user_id % 2 = 0")), e.select("user_id").distinct())


@query("load_guard_collection", "SELECT doc_id FROM documents n WHERE NOT EXISTS (SELECT 1 FROM documents h WHERE h.doc_id % 2 = 0 AND h.source = n.source AND h.lang = n.lang)")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("doc"), F.col("lang").alias("collection"))
    return S.new_rows(rows, rows.where("doc_id % 2 = 0")).select("doc_id")
