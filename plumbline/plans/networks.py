"""Network queries: critical paths, driving chains, gates, roll-ups and facts over the schedule's activities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import loops as L
from ..operators import network as N
from ..operators import schedule as S
from ..operators import selection as W
from ..registry import query, table
from .schedule import _ACT_SQL, _LINK_SQL, activities, links

_DAY0 = "DATE '1970-01-01'"
_EVERY_DAY = "SELECT * FROM VALUES ('w', array(0,1,2,3,4,5,6), CAST(array() AS ARRAY<DATE>), CAST(array() AS ARRAY<DATE>)) AS c(calendar_id, weekdays, exceptions, overrides)"
# Activities with a state of progress: of each project the first ones are done or under way, the others open.
_NET_SQL = f"""{_ACT_SQL}, {_LINK_SQL}, net AS (SELECT project_id, seq, CAST(duration AS INTEGER) AS n, CAST(start - {_DAY0} AS INTEGER) AS st,
    CASE WHEN seq = 1 AND project_id % 3 = 0 THEN 'Complete' WHEN seq = 1 AND project_id % 3 = 1 THEN 'In Progress' ELSE 'Not Started' END AS status,
    CASE WHEN constraint_type = 'CS_MSOA' THEN CAST(start - {_DAY0} AS INTEGER) END AS msoa FROM act),
    tip AS (SELECT project_id, min(st) AS data, max(seq) AS last FROM net GROUP BY 1)"""


def _net(spark: SparkSession, d: str, act: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    act = activities(spark, d) if act is None else act
    first = F.col("seq") == 1
    status = F.when(first & (F.col("project_id") % 3 == 0), "Complete").when(first & (F.col("project_id") % 3 == 1), "In Progress").otherwise("Not Started")
    n = F.col("duration").cast("int")
    own = act.select(
        "project_id", F.lpad(F.col("seq").cast("string"), 6, "0").alias("task_id"), F.lit("w").alias("calendar_id"), n.alias("remaining"), status.alias("status"), "start",
        F.when(status != "Not Started", F.col("start")).alias("actual_start"), F.when(status == "Complete", F.date_add("start", n - 1)).alias("actual_finish"),
        F.when(F.col("constraint_type") == "CS_MSOA", "CS_MSOA").alias("constraint_type"), F.when(F.col("constraint_type") == "CS_MSOA", F.col("start")).alias("constraint_date"),
    )
    name = lambda c: F.lpad(c.cast("string"), 6, "0")
    one = links(act).select("project_id", name(F.col("pred")).alias("pred"), name(F.col("succ")).alias("succ"), "rel_type", "lag_days")
    two = act.where("seq > 2").select("project_id", name(F.col("seq") - 2).alias("pred"), name(F.col("seq")).alias("succ"), F.lit("FS").alias("rel_type"), F.lit(0).alias("lag_days"))
    return own, one.unionAll(two), spark.sql(_EVERY_DAY)


_ASK = "CASE l.rel_type WHEN 'FS' THEN p.hi + l.lag_days WHEN 'SS' THEN p.lo + l.lag_days WHEN 'FF' THEN p.hi + l.lag_days - a.n ELSE p.lo + l.lag_days - a.n END"
_CAP = "CASE l.rel_type WHEN 'FS' THEN s.llo - l.lag_days WHEN 'SS' THEN s.llo - l.lag_days + a.n WHEN 'FF' THEN s.lhi - l.lag_days ELSE s.lhi - l.lag_days + a.n END"
_CPM_SQL = f"""WITH RECURSIVE {_NET_SQL}, f AS (SELECT project_id, seq, data, last, CASE WHEN status = 'Not Started' THEN greatest(data, msoa) ELSE st END AS lo,
      CASE status WHEN 'Complete' THEN st + n WHEN 'In Progress' THEN data + n ELSE greatest(data, msoa) + n END AS hi, CAST(NULL AS INTEGER) AS hi2 FROM net JOIN tip USING (project_id) WHERE seq = 1
    UNION ALL SELECT a.project_id, a.seq, p.data, p.last, greatest(p.data, {_ASK}, p.hi2, a.msoa), greatest(p.data, {_ASK}, p.hi2, a.msoa) + a.n, p.hi
      FROM f p JOIN net a ON a.project_id = p.project_id AND a.seq = p.seq + 1 JOIN link l ON l.project_id = p.project_id AND l.pred = p.seq),
    e AS (SELECT project_id, max(hi) AS fin FROM f GROUP BY 1),
    b AS (SELECT a.project_id, a.seq, fin, CASE WHEN a.status = 'Complete' THEN f.lo ELSE fin - a.n END AS llo, CASE WHEN a.status = 'Complete' THEN f.hi ELSE fin END AS lhi, CAST(NULL AS INTEGER) AS llo2
      FROM net a JOIN tip USING (project_id) JOIN e USING (project_id) JOIN f ON f.project_id = a.project_id AND f.seq = a.seq WHERE a.seq = tip.last
    UNION ALL SELECT a.project_id, a.seq, s.fin, CASE WHEN a.status = 'Complete' THEN f.lo ELSE least({_CAP}, s.llo2) - a.n END, CASE WHEN a.status = 'Complete' THEN f.hi ELSE least({_CAP}, s.llo2) END, s.llo
      FROM b s JOIN net a ON a.project_id = s.project_id AND a.seq = s.seq - 1 JOIN f ON f.project_id = a.project_id AND f.seq = a.seq JOIN link l ON l.project_id = a.project_id AND l.pred = a.seq)"""


@query("cpm_links", f"""{_CPM_SQL} SELECT f.project_id, f.seq, {_DAY0} + f.lo AS early_start, {_DAY0} + (f.hi - 1) AS early_finish, {_DAY0} + b.llo AS late_start, {_DAY0} + (b.lhi - 1) AS late_finish,
    CASE WHEN a.status <> 'Complete' THEN b.llo - f.lo END AS total_float, a.status <> 'Complete' AND b.llo - f.lo <= 0 AS is_critical FROM f JOIN b USING (project_id, seq) JOIN net a USING (project_id, seq)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return N.critical_path(*_net(spark, d)).select("project_id", F.col("task_id").cast("int").alias("seq"), "early_start", "early_finish", "late_start", "late_finish", "total_float", "is_critical")


_SEGMENTS_SQL = f"""{_ACT_SQL}, cut AS (SELECT project_id, seq, duration, sum(CASE WHEN seq = 1 OR pk % 5 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY project_id ORDER BY seq) AS g
      FROM (SELECT *, lag(l_partkey) OVER (PARTITION BY project_id ORDER BY seq) AS pk FROM act)),
    seg AS (SELECT project_id, g, sum(duration) AS total, count(*) AS n, min(seq) AS head FROM cut GROUP BY 1, 2)"""


def _segments(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Finish-to-start networks that fall into runs of activities."""
    act = activities(spark, d)
    name = lambda c: F.lpad(F.col(c).cast("string"), 6, "0")
    link = links(act).join(act.select("project_id", F.col("seq").alias("pred"), "l_partkey"), ["project_id", "pred"]).where("l_partkey % 5 <> 0")
    own = act.select("project_id", name("seq").alias("task_id"), F.lit("w").alias("calendar_id"), F.col("duration").cast("int").alias("duration"), F.lit("1996-01-01").cast("date").alias("start"))
    return own, link.select("project_id", name("pred").alias("pred"), name("succ").alias("succ"), F.lit("FS").alias("rel_type"), F.lit(0).alias("lag_days")), spark.sql(_EVERY_DAY)


_CHAIN_SQL = f"""{_SEGMENTS_SQL}, best AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY n DESC, head) AS r FROM (SELECT *, max(total) OVER (PARTITION BY project_id) AS most FROM seg) WHERE total = most AND n > 1),
    chain AS (SELECT c.project_id, CAST(r - 1 AS INTEGER) AS chain, CAST(row_number() OVER (PARTITION BY c.project_id, c.g ORDER BY seq) - 1 AS INTEGER) AS pos, c.seq FROM cut c JOIN best b ON b.project_id = c.project_id AND b.g = c.g WHERE r <= 3)"""


@query("critical_chains", f"WITH {_CHAIN_SQL} SELECT * FROM chain")
def _(spark: SparkSession, d: str) -> DataFrame:
    return N.driving_chains(*_segments(spark, d)).select("project_id", "chain", "pos", F.col("task_id").cast("int").alias("seq"))


@query("critical_path_read", f"WITH {_CHAIN_SQL} SELECT c.project_id, c.chain, c.pos, c.seq, a.start, a.l_partkey FROM chain c LEFT JOIN act a ON a.project_id = c.project_id AND a.seq = c.seq AND a.l_suppkey % 7 <> 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    facts = activities(spark, d).where("l_suppkey % 7 <> 0").select("project_id", F.lpad(F.col("seq").cast("string"), 6, "0").alias("task_id"), "start", "l_partkey")
    return N.chain_facts(N.driving_chains(*_segments(spark, d)), facts).select("project_id", "chain", "pos", F.col("task_id").cast("int").alias("seq"), "start", "l_partkey")


@query("negative_float", f"""WITH {_SEGMENTS_SQL} SELECT project_id, seq, CAST(30 - total AS INTEGER) AS total_float FROM cut JOIN seg USING (project_id, g) WHERE total > 30""")
def _(spark: SparkSession, d: str) -> DataFrame:
    projects = table(spark, d, "orders").select(F.col("o_orderkey").alias("project_id"), F.lit("1996-01-30").cast("date").alias("must_finish"))
    return S.negative_float(N.critical_path(*_segments(spark, d), projects)).select("project_id", F.col("task_id").cast("int").alias("seq"), "total_float")


@query("project_rollup", f"""WITH {_SEGMENTS_SQL}, m AS (SELECT *, max(total) OVER (PARTITION BY project_id) AS most FROM seg)
    SELECT project_id, CAST(sum(n) AS BIGINT) AS computed, CAST(sum(CASE WHEN total = most THEN n ELSE 0 END) AS BIGINT) AS critical, DATE '1996-01-01' + CAST(max(most) - 1 AS INTEGER) AS finish FROM m GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return N.project_rollup(N.critical_path(*_segments(spark, d)))


@query("cpm_gate", """SELECT o_orderkey AS project_id, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40) THEN CASE WHEN o_totalprice > 100000 THEN 'Pass' ELSE 'Fail' END ELSE 'Missing' END AS status FROM orders""")
def _(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.rules import status

    verdicts = table(spark, d, "orders").select(F.col("o_orderkey").alias("project_id"), F.lit("negative_float").alias("rule"), (F.col("o_totalprice") > 100000).alias("satisfied"))
    cpm = table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("project_id"), F.col("l_shipdate").cast("date").alias("early_start"))
    return S.gated(verdicts, cpm).select("project_id", status(F.col("satisfied")).alias("status"))


@query("calendar_warnings", f"""WITH {_ACT_SQL}, lost AS (SELECT l_suppkey % 20 AS c, project_id, seq, row_number() OVER (PARTITION BY l_suppkey % 20 ORDER BY project_id, seq) AS r FROM act WHERE l_suppkey % 20 >= 5)
    SELECT CAST(c AS VARCHAR) AS calendar_id, count(*) AS n, string_agg(CASE WHEN r <= 8 THEN CAST(seq AS VARCHAR) END, ', ' ORDER BY r) AS first FROM lost GROUP BY c""")
def _(spark: SparkSession, d: str) -> DataFrame:
    act = activities(spark, d).select("project_id", F.col("seq").alias("task_id"), (F.col("l_suppkey") % 20).cast("string").alias("calendar_id"))
    return N.unknown_calendars(act, spark.range(5).select(F.col("id").cast("string").alias("calendar_id")))


@query("dangling_links", f"""WITH {_ACT_SQL}, e AS (SELECT project_id, seq - 1 - CAST(l_partkey % 3 AS INTEGER) AS pred FROM act WHERE seq > 1)
    SELECT e.project_id, count(*) FILTER (WHERE a.seq IS NULL) AS n FROM e LEFT JOIN act a ON a.project_id = e.project_id AND a.seq = e.pred GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    act = activities(spark, d)
    every = act.where("seq > 1").select("project_id", (F.col("seq") - 1 - (F.col("l_partkey") % 3).cast("int")).alias("pred"), F.col("seq").alias("succ"))
    return S.dangling_links(every, act.withColumnRenamed("seq", "task_id"))


@query("constraint_rows", f"""WITH {_ACT_SQL} SELECT project_id, seq, constraint_type AS type, start AS date FROM act WHERE constraint_type IS NOT NULL
    UNION ALL SELECT project_id, seq, 'CS_MEOB', start + 5 FROM act WHERE l_partkey % 4 = 0""")
def _(spark: SparkSession, d: str) -> DataFrame:
    act = activities(spark, d).withColumn("constraint_date", F.col("start")).withColumn("constraint_type2", F.when(F.col("l_partkey") % 4 == 0, "CS_MEOB").otherwise("None")).withColumn("constraint_date2", F.date_add("start", 5))
    return S.constraints(act.withColumnRenamed("seq", "task_id")).withColumnRenamed("task_id", "seq")


_CMP_SQL = f"""{_ACT_SQL}, cmp AS (SELECT project_id, seq, CAST(CASE WHEN l_suppkey % 4 = 0 THEN l_partkey % 5 - 2 ELSE 0 END AS INTEGER) AS ds, CAST(CASE WHEN l_suppkey % 7 = 0 THEN l_partkey % 9 - 4 ELSE 0 END AS INTEGER) AS ff, l_partkey % 11 = 0 AS cs, l_partkey % 13 = 0 AS cc FROM act),
    state AS (SELECT project_id, seq, CASE WHEN abs(ds) > 1 THEN 'mismatch' WHEN abs(ff) > 1 THEN 'note' WHEN cs <> cc THEN 'critical_flag' ELSE 'clean' END AS state FROM cmp)"""


def _states(spark: SparkSession, d: str) -> DataFrame:
    act = activities(spark, d).withColumnRenamed("seq", "task_id")
    ds = F.when(F.col("l_suppkey") % 4 == 0, F.col("l_partkey") % 5 - 2).otherwise(0).cast("int")
    ff = F.when(F.col("l_suppkey") % 7 == 0, F.col("l_partkey") % 9 - 4).otherwise(0).cast("int")
    stored = act.select("project_id", "task_id", "start", F.lit(10).alias("free_float"))
    computed = act.select("project_id", "task_id", F.date_add("start", ds).alias("early_start"), (F.lit(10) + ff).alias("computed_free"))
    flags = act.select("project_id", "task_id", (F.col("l_partkey") % 11 == 0).alias("stored_critical"), (F.col("l_partkey") % 13 == 0).alias("is_critical"))
    return S.reconciled(S.comparisons(stored, computed, {"start": "early_start"}, {"free_float": "computed_free"}), flags)


@query("reconcile_states", f"WITH {_CMP_SQL} SELECT * FROM state")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _states(spark, d).withColumnRenamed("task_id", "seq")


@query("reconcile_counts", f"WITH {_CMP_SQL} SELECT project_id, count(*) AS checked, count(*) FILTER (WHERE state = 'mismatch') AS mismatched, count(*) FILTER (WHERE state = 'note') AS notes, count(*) FILTER (WHERE state <> 'mismatch') AS clean FROM state GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return S.reconciliation_counts(_states(spark, d))


@query("open_ends_rule", f"""WITH {_ACT_SQL}, {_LINK_SQL}, o AS (SELECT project_id, seq, NOT EXISTS (SELECT 1 FROM link l WHERE l.project_id = a.project_id AND l.succ = a.seq AND rel_type IN ('FS', 'SS')) OR NOT EXISTS (SELECT 1 FROM link l WHERE l.project_id = a.project_id AND l.pred = a.seq AND rel_type IN ('FS', 'FF')) AS open
      FROM act a WHERE status <> 'Complete' AND seq NOT IN (1, 7)) SELECT project_id, count(*) AS n FROM o WHERE open GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    act = activities(spark, d)
    return S.open_ends(act.withColumnRenamed("seq", "task_id"), links(act), exempt=("1", "7")).groupBy("project_id").agg(F.count("*").alias("n"))


@query("activity_wbs", "SELECT n_name AS wbs, count(*) AS n, min(CAST(o_orderdate AS DATE)) AS first FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    act = table(spark, d, "orders").select(F.lit(1).alias("project_id"), F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("part"), F.col("o_orderdate").cast("date").alias("start"))
    part_of = table(spark, d, "customer").select(F.lit(1).alias("project_id"), F.col("c_custkey").alias("part"), F.col("c_nationkey").alias("wbs_id"))
    wbs = table(spark, d, "nation").select(F.lit(1).alias("project_id"), F.col("n_nationkey").alias("wbs_id"), F.col("n_name").alias("wbs"))
    return W.along(act, part_of, wbs, ["project_id"], "part", "wbs_id").groupBy("wbs").agg(F.count("*").alias("n"), F.min("start").alias("first"))


@query("phase_groups", """WITH m AS (SELECT l_orderkey, CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE [l_returnflag, l_linestatus] END AS path, CAST(l_shipdate AS DATE) AS s, CAST(l_shipdate AS DATE) + 3 AS f FROM lineitem WHERE l_quantity > 1)
    SELECT l_orderkey AS project_id, CASE WHEN path IS NULL THEN 'General' ELSE path[1] || ' > ' || path[2] END AS phase, count(*) AS n, min(s) AS start, max(f) AS finish FROM m GROUP BY 1, 2""")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = F.when(F.col("l_partkey") % 10 != 0, F.array("l_returnflag", "l_linestatus"))
    act = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("project_id"), path.alias("wbs_path"), F.when(F.col("l_quantity") <= 1, "Finish Milestone").otherwise("Task").alias("task_type"), F.col("l_shipdate").cast("date").alias("start"), F.date_add("l_shipdate", 3).alias("finish"))
    return W.phase_groups(act)


@query("roster", """SELECT l_orderkey AS project_id, [l_returnflag, l_linestatus] AS path, CAST(l_shipdate AS DATE) AS start, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) NULLS LAST, l_partkey, l_linenumber, l_extendedprice) AS place FROM lineitem""")
def _(spark: SparkSession, d: str) -> DataFrame:
    act = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("project_id"), F.array("l_returnflag", "l_linestatus").alias("path"), F.col("l_shipdate").cast("date").alias("start"), "l_partkey", "l_linenumber", "l_extendedprice")
    return W.roster(act, "project_id", "path", "start", ["l_partkey", "l_linenumber", "l_extendedprice"]).select("project_id", "path", "start", F.col("place").cast("long").alias("place"))


@query("milestones_two_ways", """SELECT o_orderkey, COALESCE(CASE WHEN o_custkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) END, CASE WHEN o_custkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) + 9 END) AS start_first,
    COALESCE(CASE WHEN o_custkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) + 9 END, CASE WHEN o_custkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) END) AS finish_first FROM orders""")
def _(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    own = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 3 != 0, day).alias("start"), F.when(F.col("o_custkey") % 5 != 0, F.date_add(day, 9)).alias("finish"))
    return own.select("o_orderkey", W.start_first().alias("start_first"), W.finish_first().alias("finish_first"))


@query("digest_text", """WITH ph AS (SELECT o_orderpriority AS phase, count(*) AS n, min(CAST(o_orderdate AS DATE)) AS s, max(CAST(o_orderdate AS DATE)) AS f, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS c FROM orders GROUP BY 1 ORDER BY 1 LIMIT 15),
    ln AS (SELECT 1 AS sec, row_number() OVER (ORDER BY phase) AS pos, phase || ': ' || n || ' activities, ' || CAST(s AS VARCHAR) || ' to ' || CAST(f AS VARCHAR) || ', ' || c || ' critical' AS line FROM ph UNION ALL SELECT 2, 1, 'Mismatches: ' || count(*) FROM lineitem WHERE l_quantity > 45)
    SELECT string_agg(line, chr(10) ORDER BY sec, pos) AS digest, count(*) AS n_lines FROM ln""")
def _(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.reports import phase_rollup

    own = table(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    phases = phase_rollup(own, "o_orderpriority", "day", "day", F.col("o_orderstatus") == "F").orderBy("o_orderpriority").limit(15)
    line = F.format_string("%s: %d activities, %s to %s, %d critical", "o_orderpriority", "n", F.col("start").cast("string"), F.col("finish").cast("string"), "n_critical")
    bad = table(spark, d, "lineitem").where("l_quantity > 45").agg(F.format_string("Mismatches: %d", F.count("*")).alias("line"))
    parts = phases.select(F.lit(1).alias("sec"), F.col("o_orderpriority").alias("pos"), line.alias("line")).unionAll(bad.select(F.lit(2), F.lit(""), "line"))
    return W.as_text(parts, ["sec", "pos"], "line", "digest")


@query("facts_blocks", f"""WITH {_ACT_SQL}, {_LINK_SQL}, p AS (SELECT DISTINCT project_id FROM act),
    x AS (SELECT project_id, 1 AS sec, pred * 1000 + succ AS pos, 'lag ' || pred || ' ' || succ || ' ' || lag_days AS line FROM link WHERE lag_days <> 0 UNION ALL SELECT project_id, 2, seq, 'constraint ' || seq || ' ' || constraint_type FROM act WHERE constraint_type IS NOT NULL),
    y AS (SELECT * FROM x UNION ALL SELECT project_id, s, 0, 'none' FROM p, (VALUES (1), (2)) v(s) WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.project_id = p.project_id AND x.sec = s))
    SELECT project_id, string_agg(line, chr(10) ORDER BY sec, pos) AS facts, count(*) AS n_lines FROM y GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    act = activities(spark, d)
    lag = links(act).where("lag_days <> 0").select("project_id", F.lit(1).alias("sec"), (F.col("pred") * 1000 + F.col("succ")).alias("pos"), F.format_string("lag %d %d %d", "pred", "succ", "lag_days").alias("line"))
    pin = act.where("constraint_type IS NOT NULL").select("project_id", F.lit(2).alias("sec"), F.col("seq").alias("pos"), F.format_string("constraint %d %s", "seq", "constraint_type").alias("line"))
    return W.facts(lag.unionAll(pin), act.select("project_id").distinct(), "project_id", sections=(1, 2))


# Links onwards, some back by one to three places and some to the activity itself.
_LOOPS_SQL = f"""WITH RECURSIVE {_ACT_SQL}, e AS (SELECT project_id, pred, succ FROM (SELECT project_id, seq AS pred, seq + 1 AS succ FROM act WHERE l_partkey % 4 <> 0 UNION ALL SELECT project_id, seq, CAST(seq - 1 - l_suppkey % 3 AS INTEGER) FROM act WHERE l_suppkey % 5 = 0 UNION ALL SELECT project_id, seq, seq FROM act WHERE l_partkey % 31 = 0) WHERE succ >= 1),
    r AS (SELECT DISTINCT project_id, pred AS a, succ AS b FROM e UNION SELECT r.project_id, r.a, e.succ FROM r JOIN e ON e.project_id = r.project_id AND e.pred = r.b),
    m AS (SELECT x.project_id, x.a AS task_id, x.b AS other FROM r x JOIN r y ON x.project_id = y.project_id AND x.a = y.b AND x.b = y.a), c AS (SELECT project_id, task_id, min(other) AS component, count(DISTINCT other) AS size FROM m GROUP BY 1, 2)"""


def _loops(spark: SparkSession, d: str) -> DataFrame:
    act = activities(spark, d)
    seq, s = F.col("seq"), F.col("l_suppkey")
    ends = F.array(F.when(F.col("l_partkey") % 4 != 0, seq + 1), F.when(s % 5 == 0, (seq - 1 - s % 3).cast("int")), F.when(F.col("l_partkey") % 31 == 0, seq))
    return act.select("project_id", seq.alias("pred"), F.explode(ends).alias("succ")).where("succ >= 1")


@query("network_loops", f"{_LOOPS_SQL} SELECT * FROM c")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Activities that lie in loops of their project's links."""
    return L.strong_components(_loops(spark, d))


@query("loop_links", f"{_LOOPS_SQL} SELECT e.*, x.component FROM e JOIN c x ON x.project_id = e.project_id AND x.task_id = e.pred JOIN c y ON y.project_id = e.project_id AND y.task_id = e.succ AND y.component = x.component")
def _(spark: SparkSession, d: str) -> DataFrame:
    links = _loops(spark, d)
    return L.loop_links(links, L.strong_components(links))
