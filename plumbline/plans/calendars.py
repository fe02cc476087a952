"""Critical paths over networks with everything in them: weekends, holidays, milestones, all constraints, branches and loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import network as N
from ..registry import query
from .schedule import _ACT_SQL, _HOLIDAYS, _SATURDAYS, activities

_D0 = "DATE '1970-01-01'"
_FROM, _TO, _BASE = "1985-01-01", "2015-12-31", 5479  # _BASE: days from 1970 to _FROM
_RULES = ["CS_MSOA", "CS_MANDSTART", "CS_ALAP", "CS_MEOA", "CS_MANDFIN", "CS_MEOB", "CS_MSOB"]


def _inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Activities, links, calendars and projects. Even projects have levels of effort, odd ones loops."""
    act = activities(spark, d)
    name = lambda c: F.lpad(c.cast("string"), 6, "0")
    pid, seq, part, supp = (F.col(c) for c in ("project_id", "seq", "l_partkey", "l_suppkey"))
    kind = F.when((part % 13 == 0) & (pid % 2 == 0), "TT_LOE").when(part % 13 == 1, "TT_Mile").when(part % 13 == 2, "TT_FinMile").otherwise("TT_Task")
    n = F.when((part % 17 == 0) | (part % 13).isin(1, 2), 0).otherwise(F.col("duration").cast("int"))
    status = F.when((seq == 1) & (pid % 3 == 0), "Complete").when((seq == 1) & (pid % 3 == 1), "In Progress").otherwise("Not Started")
    rule = F.get(F.array(*map(F.lit, _RULES)), (part % 19).cast("int"))
    own = act.select(
        "project_id", name(seq).alias("task_id"), F.when(supp % 11 == 0, "lost").when(supp % 3 == 0, "w7").otherwise("w5").alias("calendar_id"), n.alias("remaining"), status.alias("status"), "start",
        F.when(status != "Not Started", F.col("start")).alias("actual_start"), F.when(status == "Complete", F.date_add("start", n)).alias("actual_finish"), kind.alias("task_type"),
        rule.alias("constraint_type"), F.when(rule.isNotNull(), F.date_add("start", (supp % 9 - 4).cast("int"))).alias("constraint_date"),
        F.when(part % 23 == 0, "CS_MEOB").alias("constraint_type2"), F.when(part % 23 == 0, F.date_add("start", 20)).alias("constraint_date2"),
    )
    link = lambda where, a, b, kind, lag: act.where(where).select("project_id", name(a).alias("pred"), name(b).alias("succ"), kind.alias("rel_type"), lag.cast("int").alias("lag_days"))
    first = F.get(F.array(*map(F.lit, ("FS", "SS", "FF", "SF"))), (supp % 4).cast("int"))
    every = link(seq > 1, seq - 1, seq, first, part % 4 - 1)
    every = every.unionAll(link((seq > 1) & (part % 7 == 0), seq - 1, seq, F.lit("FF"), F.lit(1)))
    every = every.unionAll(link((seq > 2) & ((part % 2 == 0) | (part % 29 == 0)), seq - 2, seq, F.lit("FS"), F.lit(0)))
    every = every.unionAll(link((seq > 3) & (part % 3 == 0), seq - 3, seq, F.lit("SS"), F.lit(2)))
    every = every.unionAll(link((seq > 2) & (part % 29 == 0) & (pid % 2 == 1), seq, seq - 2, F.lit("FS"), F.lit(0)))
    dates = lambda days: "CAST(array(" + ", ".join(f"DATE '{x}'" for x in days) + ") AS ARRAY<DATE>)"
    calendars = spark.sql(f"SELECT * FROM VALUES ('w5', array(0,1,2,3,4), {dates(_HOLIDAYS)}, {dates(_SATURDAYS)}), ('w7', array(0,1,2,3,4,5,6), {dates([])}, {dates([])}) AS c(calendar_id, weekdays, exceptions, overrides)")
    least = act.groupBy("project_id").agg(F.min("start").alias("s"))
    data = F.when(pid % 5 == 0, F.date_add("s", 3))
    projects = least.select("project_id", data.alias("data_date"), F.when(pid % 10 == 0, F.date_add("s", 7)).alias("plan_start"), F.when(pid % 4 == 0, F.date_add("s", 45)).alias("must_finish"))
    return own, every, calendars, projects


def _rank(c: str, d: str) -> str:
    return f"(CASE {c} WHEN 'w7' THEN {d} WHEN 'w5' THEN b5[{d} - {_BASE} + 1] ELSE bw[{d} - {_BASE} + 1] END)"


def _at(c: str, k: str) -> str:
    return f"(CASE {c} WHEN 'w7' THEN {k} WHEN 'w5' THEN d5[{k} + 1] ELSE dw[{k} + 1] END)"


def _morning(c: str, d: str) -> str:
    return _at(c, _rank(c, d))


def _morning_before(c: str, d: str) -> str:
    return _at(c, f"{_rank(c, f'({d} + 1)')} - 1")


def _evening(c: str, d: str) -> str:
    return f"({_at(c, _rank(c, f'({d} - 1)'))} + 1)"


def _evening_before(c: str, d: str) -> str:
    return f"({_at(c, f'{_rank(c, d)} - 1')} + 1)"


def _add(c: str, d: str, n: str) -> str:
    return f"(CASE WHEN {n} = 0 THEN {d} WHEN {n} > 0 THEN {_at(c, f'{_rank(c, d)} + {n} - 1')} + 1 ELSE {_at(c, f'{_rank(c, d)} + {n}')} END)"


def _layers(source: str, *layers: dict[str, str]) -> str:
    """Subqueries, each adding columns that may use those of the one before."""
    for columns in layers:
        source = f"(SELECT *, {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source})"
    return source


_ONE_CALENDAR = "SELECT list(b ORDER BY d) AS b, list(d ORDER BY d) FILTER (WHERE w) AS d FROM (SELECT d, w, CAST(coalesce(sum(CASE WHEN w THEN 1 ELSE 0 END) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS b FROM ({}))"
_DAYS = f"SELECT CAST(CAST(r AS DATE) - {_D0} AS INTEGER) AS d, {{}} AS w FROM range(DATE '{_FROM}', DATE '{_TO}' + 1, INTERVAL 1 DAY) t(r)"
_FIVE = f"CAST(r AS DATE)::VARCHAR NOT IN {_HOLIDAYS} AND (CAST(r AS DATE)::VARCHAR IN {_SATURDAYS} OR isodow(r) <= 5)"
_CALENDAR_SQL = f"k5 AS ({_ONE_CALENDAR.format(_DAYS.format(_FIVE))}), kw AS ({_ONE_CALENDAR.format(_DAYS.format('isodow(r) <= 5'))}), k AS (SELECT k5.b AS b5, k5.d AS d5, kw.b AS bw, kw.d AS dw FROM k5, kw)"
_W = "OVER (PARTITION BY project_id ORDER BY seq)"
_NET_W = "OVER (PARTITION BY net.project_id ORDER BY net.seq)"
_NODES_SQL = f"""{_ACT_SQL}, raw AS (SELECT project_id, seq, CAST(start - {_D0} AS INTEGER) AS st, CASE WHEN l_suppkey % 11 = 0 THEN 'lost' WHEN l_suppkey % 3 = 0 THEN 'w7' ELSE 'w5' END AS c,
      CASE WHEN l_partkey % 13 = 0 AND project_id % 2 = 0 THEN 'out' WHEN l_partkey % 13 = 1 THEN 'start' WHEN l_partkey % 13 = 2 THEN 'end' WHEN l_partkey % 17 = 0 THEN 'start' ELSE 'work' END AS kind,
      CASE WHEN l_partkey % 17 = 0 OR l_partkey % 13 IN (1, 2) THEN 0 ELSE CAST(duration AS INTEGER) END AS n,
      CASE WHEN seq = 1 AND project_id % 3 = 0 THEN 'Complete' WHEN seq = 1 AND project_id % 3 = 1 THEN 'In Progress' ELSE 'Not Started' END AS state,
      {_RULES!r}[CAST(l_partkey % 19 AS INTEGER) + 1] AS r1, CAST(start - {_D0} AS INTEGER) + CAST(l_suppkey % 9 - 4 AS INTEGER) AS d1, l_partkey % 23 = 0 AS meob2,
      ['FS', 'SS', 'FF', 'SF'][CAST(l_suppkey % 4 AS INTEGER) + 1] AS t1, CAST(l_partkey % 4 - 1 AS INTEGER) AS l1, l_partkey % 7 = 0 AS f1, l_partkey % 2 = 0 OR l_partkey % 29 = 0 AS x2, l_partkey % 3 = 0 AS x3,
      seq > 2 AND l_partkey % 29 = 0 AND project_id % 2 = 1 AS back FROM act),
    tip AS (SELECT project_id, min(st) AS s, max(seq) AS last, count(*) FILTER (WHERE back) AS cycles, coalesce(min(st) FILTER (WHERE kind <> 'out'), CAST(DATE '2000-01-03' - {_D0} AS INTEGER)) AS s_in FROM raw GROUP BY 1),
    net AS (SELECT raw.*, CASE WHEN project_id % 5 = 0 THEN s + 3 ELSE s_in END AS data, greatest(CASE WHEN project_id % 5 = 0 THEN s + 3 ELSE s_in END, CASE WHEN project_id % 10 = 0 THEN s + 7 END) AS floor,
      CASE WHEN project_id % 4 = 0 THEN s + 45 END AS must, last, cycles, kind <> 'out' AND state <> 'Complete' AS open,
      lead(t1) {_W} AS nt1, lead(l1) {_W} AS nl1, lead(f1) {_W} AS nf1, lead(x2, 2) {_W} AS nx2, lead(x3, 3) {_W} AS nx3, lead(c) {_W} AS nc1, lead(c, 2) {_W} AS nc2, lead(c, 3) {_W} AS nc3, lead(kind <> 'out' AND state = 'Not Started') {_W} AS no1,
      lead(kind <> 'out' AND state = 'Not Started', 2) {_W} AS no2, lead(kind <> 'out' AND state = 'Not Started', 3) {_W} AS no3 FROM raw JOIN tip USING (project_id))"""
_NONE = "CAST(NULL AS INTEGER)"
_EARLY = _layers(
    "(SELECT a.*, p.lo AS plo, p.hi AS phi, p.c AS pc, p.lo1 AS qlo, p.hi1 AS qhi, p.c1 AS qc, p.lo2 AS rlo, p.hi2 AS rhi, p.c2 AS rc, k.* FROM f p JOIN net a ON a.project_id = p.project_id AND a.seq = p.seq + 1, k)",
    {"ask": f"CASE WHEN t1 IN ('FS', 'FF') THEN {_add('pc', 'phi', 'l1')} ELSE {_add('pc', 'plo', 'l1')} END", "ff": f"CASE WHEN f1 THEN {_add('pc', 'phi', '1')} END", "a3": f"CASE WHEN x3 THEN {_add('rc', 'rlo', '2')} END", "a2": "CASE WHEN x2 THEN qhi END"},
    {"a1": f"greatest(CASE WHEN t1 IN ('FS', 'SS') THEN ask ELSE {_add('c', 'ask', '-n')} END, {_add('c', 'ff', '-n')})"},
    {"low0": "greatest(data, coalesce(greatest(a1, a2, a3), floor))"},
    {"low1": "CASE r1 WHEN 'CS_MSOA' THEN greatest(low0, d1) WHEN 'CS_MANDSTART' THEN d1 ELSE low0 END"},
    {"low2": f"CASE WHEN kind = 'end' THEN {_evening('c', 'low1')} ELSE {_morning('c', 'low1')} END"},
    {"hi2b": f"CASE WHEN kind = 'work' THEN {_add('c', 'low2', 'n')} ELSE low2 END"},
    {"hi3": f"CASE r1 WHEN 'CS_MEOA' THEN greatest(hi2b, {_evening('c', '(d1 + 1)')}) WHEN 'CS_MANDFIN' THEN d1 + 1 ELSE hi2b END"},
    {"low3": f"CASE WHEN r1 = 'CS_MANDFIN' THEN CASE WHEN kind = 'work' THEN {_add('c', 'hi3', '-n')} ELSE hi3 END ELSE low2 END"},
    {"m0": _morning("c", "data")},
    {"hi_on": f"CASE WHEN n > 0 THEN {_add('c', 'm0', 'n')} ELSE {_evening('c', 'data')} END"},
)
_EARLY_SQL = f"""f AS (SELECT project_id, 0 AS seq, {_NONE} AS lo, {_NONE} AS hi, CAST(NULL AS VARCHAR) AS c, {_NONE} AS lo1, {_NONE} AS hi1, CAST(NULL AS VARCHAR) AS c1, {_NONE} AS lo2, {_NONE} AS hi2, CAST(NULL AS VARCHAR) AS c2, {_NONE} AS a1, {_NONE} AS a2, {_NONE} AS a3 FROM tip
    UNION ALL SELECT project_id, seq, CASE WHEN kind = 'out' THEN NULL WHEN state = 'Not Started' THEN low3 ELSE st END, CASE WHEN kind = 'out' THEN NULL WHEN state = 'Complete' THEN st + n + 1 WHEN state = 'In Progress' THEN hi_on ELSE hi3 END, c,
      plo, phi, pc, qlo, qhi, qc, CASE WHEN kind <> 'out' AND state = 'Not Started' THEN a1 END, CASE WHEN kind <> 'out' AND state = 'Not Started' THEN a2 END, CASE WHEN kind <> 'out' AND state = 'Not Started' THEN a3 END FROM {_EARLY}),
    fin AS (SELECT project_id, coalesce(max(hi), 0) AS fin FROM f GROUP BY 1)"""
_LATE = _layers(
    """(SELECT a.*, f.lo, f.hi, coalesce(a.must + 1, fin) AS over, s.llo AS slo, s.lhi AS shi, s.llo1 AS tlo, s.lhi1 AS thi, s.llo2 AS ulo, s.lhi2 AS uhi, k.*
      FROM b s JOIN net a ON a.project_id = s.project_id AND a.seq = s.seq - 1 JOIN f ON f.project_id = a.project_id AND f.seq = a.seq JOIN fin ON fin.project_id = a.project_id, k)""",
    {"cap": f"CASE WHEN nt1 IN ('FS', 'SS') THEN {_add('c', 'slo', '-nl1')} ELSE {_add('c', 'shi', '-nl1')} END", "capf": f"CASE WHEN nf1 THEN {_add('c', 'shi', '-1')} END", "c2": "CASE WHEN nx2 THEN tlo END", "cap3": f"CASE WHEN nx3 THEN {_add('c', 'ulo', '-2')} END"},
    {"c1": f"CASE WHEN nt1 IN ('FS', 'FF') THEN cap ELSE {_add('c', 'cap', 'n')} END", "c3": _add("c", "cap3", "n")},
    {"h0": "coalesce(least(c1, capf, c2, c3), over)"},
    {"mb": _morning_before("c", "d1")},
    {"h1": f"CASE r1 WHEN 'CS_MEOB' THEN least(h0, d1 + 1) WHEN 'CS_MSOB' THEN least(h0, CASE WHEN n > 0 THEN {_add('c', 'mb', 'n')} ELSE d1 END) ELSE h0 END"},
    {"h2": "CASE WHEN meob2 THEN least(h1, st + 21) ELSE h1 END"},
    {"lh": f"CASE WHEN kind = 'start' THEN {_morning_before('c', 'h2')} ELSE {_evening_before('c', 'h2')} END"},
    {"ll": f"CASE WHEN kind = 'work' THEN {_add('c', 'lh', '-n')} ELSE lh END", "keep": "state = 'Complete' OR coalesce(r1 IN ('CS_MANDSTART', 'CS_MANDFIN'), false)"},
)
# What is kept of a complete or excluded activity doesn't bind the ones before it.
_LATE_SQL = f"""b AS (SELECT project_id, last + 1 AS seq, {_NONE} AS own_lo, {_NONE} AS own_hi, {_NONE} AS llo, {_NONE} AS lhi, {_NONE} AS llo1, {_NONE} AS lhi1, {_NONE} AS llo2, {_NONE} AS lhi2 FROM tip
    UNION ALL SELECT project_id, seq, CASE WHEN keep THEN lo ELSE ll END, CASE WHEN keep THEN hi ELSE lh END, CASE WHEN open THEN CASE WHEN keep THEN lo ELSE ll END END, CASE WHEN open THEN CASE WHEN keep THEN hi ELSE lh END END, slo, shi, tlo, thi FROM {_LATE})"""


def _distance(c: str, a: str, b: str) -> str:
    return f"({_rank(c, b)} - {_rank(c, a)})"


_SOLVED_SQL = f"""WITH RECURSIVE {_CALENDAR_SQL}, {_NODES_SQL}, {_EARLY_SQL}, {_LATE_SQL},
    x AS (SELECT net.*, k.*, f.lo, f.hi, own_lo, own_hi, f.a1, f.a2, f.a3, lead(f.a1) {_NET_W} AS na1, lead(f.a2, 2) {_NET_W} AS na2, lead(f.a3, 3) {_NET_W} AS na3,
      lead(f.lo) {_NET_W} AS nlo1, lead(f.lo, 2) {_NET_W} AS nlo2, lead(f.lo, 3) {_NET_W} AS nlo3
      FROM net JOIN f ON f.project_id = net.project_id AND f.seq = net.seq JOIN b ON b.project_id = net.project_id AND b.seq = net.seq, k),
    fl AS (SELECT *, CASE WHEN open THEN {_distance('c', 'lo', 'own_lo')} END AS tf, CASE WHEN no1 THEN {_distance('nc1', 'na1', 'nlo1')} END AS s1, CASE WHEN no2 AND nx2 THEN {_distance('nc2', 'na2', 'nlo2')} END AS s2, CASE WHEN no3 AND nx3 THEN {_distance('nc3', 'na3', 'nlo3')} END AS s3 FROM x),
    out AS (SELECT project_id, seq, kind, state, c, lo, hi, own_lo, own_hi, tf, CASE WHEN open THEN coalesce(least(s1, s2, s3), tf) END AS ff, kind <> 'out' AND coalesce(tf <= 0, false) AS is_critical, kind = 'out' AS excluded, cycles, a1, a2, a3, st, must, r1, d1, meob2 FROM fl)"""


def _shown(kind: str, a: str, b: str) -> tuple[str, str]:
    both = "kind = 'work' OR state <> 'Not Started'"
    return f"CASE WHEN {both} OR kind = 'start' THEN {a} ELSE {b} - 1 END", f"CASE WHEN {both} OR kind = 'end' THEN {b} - 1 ELSE {a} END"


_FIRST, _LAST = _shown("kind", "lo", "hi")
_LATE_FIRST, _LATE_LAST = _shown("kind", "own_lo", "own_hi")


@query("cpm_calendars", f"""{_SOLVED_SQL} SELECT project_id, seq, {_D0} + CASE WHEN excluded THEN st ELSE {_FIRST} END AS early_start, {_D0} + CASE WHEN NOT excluded THEN {_LAST} END AS early_finish, {_D0} + CASE WHEN NOT excluded THEN {_LATE_FIRST} END AS late_start,
    {_D0} + CASE WHEN NOT excluded THEN {_LATE_LAST} END AS late_finish, tf AS total_float, ff AS free_float, is_critical, excluded, CAST(cycles AS INTEGER) AS cycle_edges FROM out""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Early and late dates, both floats and loops of every activity."""
    found = N.critical_path(*_inputs(spark, d))
    return found.select("project_id", F.col("task_id").cast("int").alias("seq"), "early_start", "early_finish", "late_start", "late_finish", "total_float", "free_float", "is_critical", "excluded", "cycle_edges")


_DRIVING_SQL = f"""{_SOLVED_SQL}, lim AS (SELECT project_id, greatest(0, coalesce(min(tf), 0)) AS most FROM out GROUP BY 1), cr AS (SELECT project_id, seq FROM out JOIN lim USING (project_id) WHERE tf <= most),
    dl AS (SELECT o.project_id, o.seq - v.back AS p, o.seq AS s FROM out o, (VALUES (1), (2), (3)) v(back) WHERE CASE v.back WHEN 1 THEN a1 WHEN 2 THEN a2 ELSE a3 END = lo),
    de AS (SELECT dl.* FROM dl JOIN cr x ON x.project_id = dl.project_id AND x.seq = p JOIN cr y ON y.project_id = dl.project_id AND y.seq = s),
    pa AS (SELECT project_id, p AS head, s AS tail, [s, p] AS path FROM de UNION ALL SELECT pa.project_id, de.p, tail, list_append(path, de.p) FROM pa JOIN de ON de.project_id = pa.project_id AND de.s = pa.head),
    g1 AS (SELECT project_id, arg_min(path, (-len(path), path)) AS path FROM pa GROUP BY 1),
    g2 AS (SELECT pa.project_id, arg_min(pa.path, (-len(pa.path), pa.path)) AS path FROM pa JOIN g1 USING (project_id) WHERE NOT list_has_any(pa.path, g1.path) GROUP BY 1),
    g3 AS (SELECT pa.project_id, arg_min(pa.path, (-len(pa.path), pa.path)) AS path FROM pa JOIN g1 USING (project_id) JOIN g2 USING (project_id) WHERE NOT list_has_any(pa.path, g1.path) AND NOT list_has_any(pa.path, g2.path) GROUP BY 1),
    g AS (SELECT 0 AS chain, * FROM g1 UNION ALL SELECT 1, * FROM g2 UNION ALL SELECT 2, * FROM g3)"""


@query("driving_branches", f"{_DRIVING_SQL} SELECT project_id, chain, CAST(unnest(range(len(path))) AS INTEGER) AS pos, CAST(unnest(list_reverse(path)) AS INTEGER) AS seq FROM g")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Driving chains where paths branch and meet."""
    return N.driving_chains(*_inputs(spark, d)).select("project_id", "chain", "pos", F.col("task_id").cast("int").alias("seq"))


@query("network_warnings", f"""{_SOLVED_SQL}, fn AS (SELECT project_id, max(hi) AS fin, any_value(must) AS must, count(*) FILTER (WHERE NOT excluded) AS n FROM out GROUP BY 1),
    w AS (SELECT project_id, 'loop ' || lpad(CAST(seq - 2 AS VARCHAR), 6, '0') || ' > ' || lpad(CAST(seq - 1 AS VARCHAR), 6, '0') || ' > ' || lpad(CAST(seq AS VARCHAR), 6, '0') || '; ' || lpad(CAST(seq AS VARCHAR), 6, '0') || ' > ' || lpad(CAST(seq - 2 AS VARCHAR), 6, '0') || ' left out' AS warning FROM raw WHERE back
      UNION ALL SELECT project_id, lpad(CAST(seq AS VARCHAR), 6, '0') || ': as late as possible, but kept at its early dates' FROM out WHERE r1 = 'CS_ALAP' AND NOT excluded AND state = 'Not Started'
      UNION ALL SELECT project_id, 'must finish ' || ({_D0} + must) || ', before the computed finish ' || ({_D0} + (fin - 1)) FROM fn WHERE must + 1 < fin
      UNION ALL SELECT project_id, 'no activity to schedule' FROM fn WHERE n = 0
      UNION ALL SELECT project_id, 'calendar lost is not known; Monday to Friday for ' || count(*) || ': ' || string_agg(lpad(CAST(seq AS VARCHAR), 6, '0'), ', ' ORDER BY seq) FROM out WHERE c = 'lost' AND NOT excluded GROUP BY 1 HAVING count(*) <= 8)
    SELECT project_id, warning, count(*) AS n FROM w GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """What was assumed: loops, late wishes, finishes that come too late, unknown calendars (violated mandatory dates are held by tests)."""
    found = N.network_warnings(*_inputs(spark, d)).where(~F.col("warning").contains("mandatory"))
    return found.groupBy("project_id", "warning").agg(F.count("*").alias("n"))
