"""Schedule queries: each order is a project, its line items are activities in order, linked to the next ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dates as D
from ..operators import graph as G
from ..operators import schedule as S
from ..registry import query, table

_HOLIDAYS = ("1996-01-01", "1996-07-04", "1997-12-25", "1998-12-25", "1999-01-01")
_SATURDAYS = ("1996-07-06", "1998-10-03")
_FIRST, _LAST = "1990-01-01", "2006-12-31"
_CAL_SQL = f"""cal AS (SELECT d, w, CAST(sum(CASE WHEN w THEN 1 ELSE 0 END) OVER (ORDER BY d) AS INTEGER) AS ord FROM (SELECT CAST(r AS DATE) AS d,
    CAST(r AS DATE)::VARCHAR NOT IN {_HOLIDAYS} AND (CAST(r AS DATE)::VARCHAR IN {_SATURDAYS} OR isodow(r) <= 5) AS w FROM range(DATE '{_FIRST}', DATE '{_LAST}' + 1, INTERVAL 1 DAY) t(r)))"""
_ORDERS_SQL = "o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_custkey % 40 - 10 AS INTEGER) AS b, CAST(o_orderkey % 11 - 5 AS INTEGER) AS n, o_totalprice FROM orders)"


def _calendar(spark: SparkSession) -> DataFrame:
    return D.calendar_days(spark, _FIRST, _LAST, exceptions=_HOLIDAYS, overrides=_SATURDAYS)


def _orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("a", F.col("o_orderdate").cast("date"))
    return o.select("o_orderkey", "a", F.date_add("a", (F.col("o_custkey") % 40 - 10).cast("int")).alias("b"), (F.col("o_orderkey") % 11 - 5).cast("int").alias("n"), "o_totalprice")


@query("work_days_between", f"WITH {_CAL_SQL}, {_ORDERS_SQL} SELECT o_orderkey, y.ord - x.ord AS work_days FROM o JOIN cal x ON x.d = a JOIN cal y ON y.d = b")
def _(spark: SparkSession, d: str) -> DataFrame:
    return D.work_days_between(_orders(spark, d), _calendar(spark), "a", "b").select("o_orderkey", "work_days")


@query("add_work_days", f"""WITH {_CAL_SQL}, {_ORDERS_SQL}, wd AS (SELECT ord, d FROM cal WHERE w)
    SELECT o_orderkey, CASE WHEN n = 0 THEN a ELSE wd.d END AS due FROM o JOIN cal c ON c.d = a LEFT JOIN wd ON wd.ord = CASE WHEN n > 0 THEN c.ord + n ELSE c.ord - CAST(c.w AS INTEGER) + n + 1 END""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return D.add_work_days(_orders(spark, d), _calendar(spark), "a", F.col("n"), "due").select("o_orderkey", "due")


@query("weekday_rule", f"WITH {_ORDERS_SQL} SELECT o_orderkey, isodow(b) IN (2, 4) AS satisfied FROM o")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).select("o_orderkey", F.weekday("b").isin(1, 3).alias("satisfied"))


@query("winter_rule", f"WITH {_ORDERS_SQL} SELECT o_orderkey, (month(b) * 100 + day(b) >= 1215 OR month(b) * 100 + day(b) <= 315) AS in_winter FROM o")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).select("o_orderkey", D.in_winter(F.col("b")).alias("in_winter"))


@query("regional_deadline", f"WITH {_ORDERS_SQL} SELECT o_orderkey, month(b) * 100 + day(b) < CASE WHEN o_orderkey % 2 = 0 THEN 1001 ELSE 1015 END AS satisfied FROM o")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).select("o_orderkey", D.before_deadline(F.col("b"), F.col("o_orderkey") % 2 == 0).alias("satisfied"))


@query("business_gap_rule", f"WITH {_CAL_SQL}, {_ORDERS_SQL} SELECT o_orderkey, (y.ord - x.ord) >= 10 AS satisfied FROM o JOIN cal x ON x.d = a JOIN cal y ON y.d = b")
def _(spark: SparkSession, d: str) -> DataFrame:
    return D.work_days_between(_orders(spark, d), _calendar(spark), "a", "b").select("o_orderkey", (F.col("work_days") >= 10).alias("satisfied"))


@query("cost_gap_rule", f"""WITH {_ORDERS_SQL}, c AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) * 200 AS cost, CAST(b - a AS INTEGER) * 4 AS gap FROM o)
    SELECT o_orderkey, CASE WHEN cost < 10000 OR cost > 5000000000 THEN 'Missing' WHEN gap < CASE WHEN cost <= 50000000 THEN 60 ELSE 90 END THEN 'Fail' ELSE 'Pass' END AS status FROM c""")
def _(spark: SparkSession, d: str) -> DataFrame:
    cost, gap = F.col("o_totalprice").cast("decimal(18,2)") * 200, F.datediff("b", "a") * 4
    need = F.when(cost <= 50000000, 60).otherwise(90)
    return _orders(spark, d).select("o_orderkey", F.when((cost < 10000) | (cost > 5000000000), "Missing").when(gap < need, "Fail").otherwise("Pass").alias("status"))


_SEQ = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus)"
_ACT_SQL = f"""act AS (SELECT l_orderkey AS project_id, CAST(seq AS INTEGER) AS seq, l_quantity AS duration, CASE WHEN l_partkey % 9 = 0 THEN 'Complete' ELSE 'Not Started' END AS status,
    CASE l_suppkey % 6 WHEN 0 THEN 'CS_MSO' WHEN 1 THEN 'CS_MEO' WHEN 2 THEN 'CS_MSOA' END AS constraint_type, CAST(l_shipdate AS DATE) AS start, l_partkey, l_suppkey, l_discount FROM (SELECT *, {_SEQ} AS seq FROM lineitem))"""
_LINK_SQL = "link AS (SELECT p.project_id, p.seq AS pred, s.seq AS succ, CASE (p.seq + p.project_id) % 4 WHEN 0 THEN 'SF' WHEN 1 THEN 'FS' WHEN 2 THEN 'SS' ELSE 'FF' END AS rel_type, CAST(p.l_partkey % 5 - 1 AS INTEGER) AS lag_days FROM act p JOIN act s ON p.project_id = s.project_id AND s.seq = p.seq + 1)"


def activities(spark: SparkSession, d: str) -> DataFrame:
    """Line items in a total order of each order, as activities."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))
    kind = F.when(F.col("l_suppkey") % 6 == 0, "CS_MSO").when(F.col("l_suppkey") % 6 == 1, "CS_MEO").when(F.col("l_suppkey") % 6 == 2, "CS_MSOA")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("project_id"), seq.alias("seq"), F.col("l_quantity").alias("duration"),
        F.when(F.col("l_partkey") % 9 == 0, "Complete").otherwise("Not Started").alias("status"), kind.alias("constraint_type"),
        F.col("l_shipdate").cast("date").alias("start"), "l_partkey", "l_suppkey", "l_discount",
    )


def links(act: DataFrame) -> DataFrame:
    """From each activity to the next: both come from one window over the project, without a join."""
    w = Window.partitionBy("project_id").orderBy("seq")
    kind = F.element_at(F.array(F.lit("SF"), F.lit("FS"), F.lit("SS"), F.lit("FF")), ((F.col("seq") + F.col("project_id")) % 4 + 1).cast("int"))
    return act.withColumn("succ", F.lead("seq").over(w)).where("succ is not null").select("project_id", F.col("seq").alias("pred"), "succ", kind.alias("rel_type"), (F.col("l_partkey") % 5 - 1).cast("int").alias("lag_days"))


@query("cpm_fs_longest_path", f"""WITH RECURSIVE {_ACT_SQL}, p AS (SELECT project_id, seq, duration AS f FROM act WHERE seq = 1
    UNION ALL SELECT a.project_id, a.seq, p.f + a.duration FROM p JOIN act a ON a.project_id = p.project_id AND (a.seq = p.seq + 1 OR a.seq = p.seq + 3))
    SELECT project_id, seq, max(f) AS early_finish FROM p GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return S.chained_finishes(activities(spark, d).select("project_id", "seq", "duration"))


def _cpm(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    act = activities(spark, d)
    link = links(act).select("project_id", F.col("pred").cast("string").alias("pred"), F.col("succ").cast("string").alias("succ"), "rel_type", "lag_days")
    own = act.select("project_id", F.col("seq").cast("string").alias("task_id"), F.col("duration").cast("int").alias("duration"), (F.col("l_suppkey") % 3).cast("string").alias("calendar_id"), "constraint_type", F.when(F.col("l_suppkey") % 5 == 0, F.col("start")).alias("constraint_date"), "start")
    calendars = spark.sql("SELECT * FROM VALUES ('0', array(0,1,2,3,4), array(DATE'1997-12-25'), array(DATE'1998-10-03')), ('1', array(0,1,2,3,4,5,6), array(), array()) AS c(calendar_id, weekdays, exceptions, overrides)")
    return S.critical_path(own, link, calendars), link


@query("cpm_full")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _cpm(spark, d)[0]


@query("open_ends", f"""WITH {_ACT_SQL}, {_LINK_SQL} SELECT project_id, seq, os AS open_start, oe AS open_finish FROM (SELECT project_id, seq,
    NOT EXISTS (SELECT 1 FROM link l WHERE l.project_id = a.project_id AND l.succ = a.seq AND rel_type IN ('FS', 'SS')) AS os, NOT EXISTS (SELECT 1 FROM link l WHERE l.project_id = a.project_id AND l.pred = a.seq AND rel_type IN ('FS', 'FF')) AS oe
    FROM act a WHERE status <> 'Complete') WHERE os OR oe""")
def _(spark: SparkSession, d: str) -> DataFrame:
    act = activities(spark, d)
    link = links(act)
    return S.open_ends(act.withColumnRenamed("seq", "task_id"), link).withColumnRenamed("task_id", "seq")


@query("prohibited_lag", f"WITH {_ACT_SQL}, {_LINK_SQL} SELECT project_id, pred, succ, rel_type, lag_days FROM link WHERE (rel_type = 'FS' AND lag_days <> 0) OR lag_days < 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    return S.prohibited_lags(links(activities(spark, d)))


@query("mandatory_constraints", f"WITH {_ACT_SQL} SELECT project_id, seq, constraint_type FROM act WHERE constraint_type IN ('CS_MANDSTART', 'CS_MSO', 'CS_MANDFIN', 'CS_MEO')")
def _(spark: SparkSession, d: str) -> DataFrame:
    return S.mandatory_constraints(activities(spark, d)).select("project_id", "seq", "constraint_type")


_DELTA_SQL = "st AS (SELECT project_id, seq, CAST(CASE WHEN project_id % 3 = 0 THEN 3 WHEN l_suppkey % 4 = 0 THEN l_partkey % 7 - 3 ELSE 0 END AS INTEGER) AS x FROM act)"


def _compared(spark: SparkSession, d: str) -> DataFrame:
    """Stored starts against computed ones that differ by a known number of days."""
    shift = F.when(F.col("project_id") % 3 == 0, 3).when(F.col("l_suppkey") % 4 == 0, F.col("l_partkey") % 7 - 3).otherwise(0).cast("int")
    own = activities(spark, d).select("project_id", F.col("seq").alias("task_id"), "start", F.date_add("start", shift).alias("early_start"))
    return S.comparisons(own.select("project_id", "task_id", "start"), own.select("project_id", "task_id", "early_start"), {"start": "early_start"})


@query("reconcile_deltas", f"WITH {_ACT_SQL}, {_DELTA_SQL} SELECT project_id, seq, 'start' AS field, x AS delta FROM st WHERE abs(x) > 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _compared(spark, d).where(F.abs("delta") > 1).withColumnRenamed("task_id", "seq")


@query("systematic_offset", f"""WITH {_ACT_SQL}, {_DELTA_SQL}, g AS (SELECT project_id % 99 AS grp, x, count(*) AS n FROM st GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY grp) AS total FROM g)
    SELECT grp, 'start' AS field, x AS delta, round(CAST(n AS DOUBLE) / CAST(total AS DOUBLE), 6) AS share FROM t WHERE total >= 10 AND x <> 0 AND CAST(n AS DOUBLE) / CAST(total AS DOUBLE) >= 0.8""")
def _(spark: SparkSession, d: str) -> DataFrame:
    grouped = _compared(spark, d).withColumn("project_id", F.col("project_id") % 99)
    return S.systematic_offset(grouped).select(F.col("project_id").alias("grp"), "field", "delta", F.round("share", 6).alias("share"))


@query("predecessors_two_hop", f"""WITH {_ACT_SQL}, {_LINK_SQL} SELECT project_id, succ, pred, 1 AS hops FROM link
    UNION ALL SELECT a.project_id, a.succ, b.pred, 2 FROM link a JOIN link b ON a.project_id = b.project_id AND a.pred = b.succ""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return S.paths_two_hops(links(activities(spark, d)))


@query("wbs_path", """WITH RECURSIVE n AS (SELECT CAST(r_regionkey AS INTEGER) AS id, CAST(NULL AS INTEGER) AS parent, r_name AS name FROM region UNION ALL SELECT 100 + n_nationkey, n_regionkey, n_name FROM nation),
    p AS (SELECT id, name AS path, 1 AS depth FROM n WHERE parent IS NULL UNION ALL SELECT n.id, p.path || ' > ' || n.name, p.depth + 1 FROM n JOIN p ON n.parent = p.id) SELECT id, path, depth FROM p""")
def _(spark: SparkSession, d: str) -> DataFrame:
    top = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.lit(None).cast("int").alias("parent"), F.col("r_name").alias("name"))
    low = table(spark, d, "nation").select((F.lit(100) + F.col("n_nationkey")).alias("id"), F.col("n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    return G.tree_paths(top.unionAll(low))


@query("coverage_buckets", """WITH m AS (SELECT p_partkey, max(l_discount * 10) AS c FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 45 GROUP BY 1)
    SELECT CASE WHEN c IS NULL THEN 'uncovered' WHEN c < 0.6 THEN 'low' ELSE 'covered' END AS bucket, count(*) AS n FROM m GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    covers = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("item"), (F.col("l_discount") * 10).alias("confidence"))
    return G.coverage(table(spark, d, "part").select(F.col("p_partkey").alias("item")), covers).groupBy("bucket").agg(F.count("*").alias("n"))


@query("uncovered_items", "SELECT p_partkey AS item FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def _(spark: SparkSession, d: str) -> DataFrame:
    covers = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("item"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("item")).join(covers, "item", "left_anti")


@query("entity_link_exact", "SELECT event_id, p_partkey FROM events JOIN part ON p_partkey = CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT)")
def _(spark: SparkSession, d: str) -> DataFrame:
    entities = table(spark, d, "events").select(F.col("event_id").alias("entity"), F.col("props").alias("text"))
    acts = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("activity"))
    return G.link_exact(entities, acts).select(F.col("entity").alias("event_id"), F.col("activity").cast("long").alias("p_partkey"))


@query("entity_link_date_band", """WITH e AS (SELECT event_id, event_type, CAST(ts AS DATE) AS d FROM events), a AS (SELECT p_partkey, p_size, DATE '2024-01-01' + CAST(p_partkey % 400 * 3 AS INTEGER) AS d FROM part)
    SELECT event_type, p_size, count(*) AS n FROM e JOIN a ON a.d BETWEEN e.d - 3 AND e.d + 3 GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    entities = table(spark, d, "events").select("event_id", "event_type", F.col("ts").cast("date").alias("d"))
    acts = table(spark, d, "part").select("p_partkey", "p_size", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 400 * 3).cast("int")).alias("d"))
    # Equal days and kinds are counted before they meet, so no pair of an event and a part is built.
    some = entities.groupBy("event_type", "d").agg(F.count("*").alias("_n"))
    others = acts.groupBy("p_size", "d").agg(F.count("*").alias("_m"))
    return G.link_dates(some, others, "d", 3).groupBy("event_type", "p_size").agg(F.sum(F.col("_n") * F.col("_m")).alias("n"))


_NAMED_SQL = """e AS (SELECT l_orderkey * 10 + l_linenumber AS entity, p_brand AS project, trim(regexp_replace(lower(CASE l_linenumber % 4 WHEN 0 THEN 'Install ' || p_name || ', ' || year(l_shipdate) WHEN 1 THEN p_name WHEN 2 THEN split_part(p_name, ' ', 2)
      ELSE translate(p_name, substr('aeion', CAST(l_suppkey % 5 AS INTEGER) + 1, 1), '') || '#' END), '[^a-z0-9 ]', '', 'g')) AS name FROM lineitem JOIN part ON p_partkey = l_partkey),
    a AS (SELECT DISTINCT p_brand AS project, p_name AS activity FROM part), n AS (SELECT DISTINCT project, name FROM e WHERE length(name) >= 5),
    t AS (SELECT n.project, n.name, activity, CASE WHEN contains(n.name, activity) AND length(activity) >= 0.45 * length(n.name) THEN 0.9::DOUBLE WHEN contains(activity, n.name) THEN 0.85::DOUBLE END AS confidence FROM n JOIN a ON a.project = n.project AND length(activity) >= 5)"""


def _named(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Line items as entities whose names are made of their part's name; the parts of a brand are a project's activities."""
    k, name = F.col("l_linenumber") % 4, F.col("p_name")
    letter = F.substr(F.lit("aeion"), (F.col("l_suppkey") % 5 + 1).cast("int"), F.lit(1))
    text = F.when(k == 0, F.concat(F.lit("Install "), name, F.lit(", "), F.year("l_shipdate").cast("string"))).when(k == 1, name).when(k == 2, F.split_part(name, F.lit(" "), F.lit(2))).otherwise(F.concat(F.replace(name, letter, F.lit("")), F.lit("#")))
    parts = table(spark, d, "part")
    e = table(spark, d, "lineitem").join(parts, F.col("p_partkey") == F.col("l_partkey")).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("entity"), F.col("p_brand").alias("project"), text.alias("name"))
    return e, parts.select(F.col("p_brand").alias("project"), F.col("p_name").alias("activity"), F.col("p_name").alias("name")).distinct()


@query("entity_link_contained", f"WITH {_NAMED_SQL} SELECT DISTINCT e.project, entity, activity, confidence FROM e JOIN t USING (project, name) WHERE confidence IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The tiers of containment: names inside names. Line items with one number are one entity with several names, and show all its tiers."""
    return G.link_contained(*_named(spark, d), within=["project"])


@query("entity_link_fuzzy")
def _(spark: SparkSession, d: str) -> DataFrame:
    """All tiers; SQL has no such match ratio, so tests hold this one against all pairs."""
    return G.link_names(*_named(spark, d), within=["project"])


@query("entity_link_methods", f"""WITH {_NAMED_SQL}, h AS (SELECT DISTINCT e.project, entity, activity, confidence FROM e JOIN t USING (project, name) WHERE confidence IS NOT NULL)
    SELECT project, confidence, count(*) AS n, count(DISTINCT entity) AS n_entities, count(DISTINCT activity) AS n_activities, min(entity) AS first FROM h GROUP BY 1, 2""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Links of each project by their confidence, as the graph's report counts them."""
    found = G.link_contained(*_named(spark, d), within=["project"])
    return found.groupBy("project", "confidence").agg(F.count("*").alias("n"), F.countDistinct("entity").alias("n_entities"), F.countDistinct("activity").alias("n_activities"), F.min("entity").alias("first"))


@query("deep_paths", """WITH RECURSIVE n AS (SELECT doc_id AS id, CASE WHEN doc_id % 150 = 0 THEN NULL WHEN doc_id % 150 = 140 THEN -1 WHEN doc_id % 7 = 0 THEN doc_id - least(7, doc_id % 150) ELSE doc_id - 1 END AS parent, source AS name FROM documents),
    p AS (SELECT id, name AS path, 1 AS depth FROM n WHERE parent IS NULL UNION ALL SELECT n.id, p.path || ' > ' || n.name, p.depth + 1 FROM p JOIN n ON n.parent = p.id)
    SELECT id, md5(path) AS path, CAST(depth AS INTEGER) AS depth FROM p""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Trees up to 140 levels deep, with branches and parents that nobody knows."""
    i = F.col("doc_id")
    up = F.when(i % 150 == 0, None).when(i % 150 == 140, F.lit(-1)).when(i % 7 == 0, i - F.least(F.lit(7), i % 150)).otherwise(i - 1)
    found = G.tree_paths(table(spark, d, "documents").select(i.alias("id"), up.alias("parent"), F.col("source").alias("name")))
    return found.select("id", F.md5(F.col("path").cast("binary")).alias("path"), "depth")
