import datetime as dt

from pyspark.sql import functions as F

from plumbline.functions import dates as D
from plumbline.operators import schedule as S

D_ = dt.date
ACT = "project_id long, task_id string, duration int, calendar_id string, constraint_type string, constraint_date date, start date"
LINK = "project_id long, pred string, succ string, rel_type string, lag_days int"
CAL = "calendar_id string, weekdays array<int>, exceptions array<date>, overrides array<date>"


def run(spark, acts, links, cals=()):
    a = spark.createDataFrame([(1, t, n, c, k, kd, D_(2024, 1, 1)) for t, n, c, k, kd in acts], ACT)
    out = S.critical_path(a, spark.createDataFrame([(1, *x) for x in links], LINK), spark.createDataFrame(list(cals), CAL))
    return {r["task_id"]: r for r in out.collect()}


def test_finish_to_start_over_a_weekend(spark):
    r = run(spark, [("A", 5, None, None, None), ("B", 2, None, None, None), ("C", 1, None, None, None)], [("A", "B", "FS", 0), ("A", "C", "FS", 0)])
    assert (r["A"]["early_finish"], r["B"]["early_start"], r["B"]["early_finish"]) == (D_(2024, 1, 5), D_(2024, 1, 8), D_(2024, 1, 9))
    assert (r["B"]["total_float"], r["C"]["total_float"], r["C"]["is_critical"]) == (0, 1, False)


def test_start_to_start_lag_and_own_calendar(spark):
    r = run(spark, [("A", 5, "w", None, None), ("B", 2, None, None, None)], [("A", "B", "SS", 2)], [("w", [0, 1, 2, 3, 4, 5, 6], [D_(2024, 1, 2)], [])])
    assert r["B"]["early_start"] == D_(2024, 1, 4) and r["A"]["early_finish"] == D_(2024, 1, 6)


def test_cycles_are_broken_and_counted(spark):
    r = run(spark, [("A", 1, None, None, None), ("B", 1, None, None, None)], [("A", "B", "FS", 0), ("B", "A", "FS", 0)])
    assert r["A"]["cycle_edges"] == 1 and r["B"]["early_start"] == D_(2024, 1, 2)


def test_mandatory_start_pins_the_late_dates(spark):
    r = run(spark, [("A", 1, None, "CS_MSO", D_(2024, 1, 10)), ("B", 9, None, None, None)], [])
    assert r["A"]["early_start"] == r["A"]["late_start"] == D_(2024, 1, 10) and r["A"]["is_critical"]


def test_no_links_no_activities(spark):
    assert run(spark, [], []) == {}
    assert run(spark, [("A", None, None, None, None)], [])["A"]["total_float"] == 0


def test_adding_work_days_inverts_counting(spark):
    cal = D.calendar_days(spark, "2023-01-01", "2025-12-31", exceptions=("2024-01-01",), overrides=("2024-01-06",))
    days = spark.sql("SELECT explode(sequence(DATE'2024-01-02', DATE'2024-02-01')) AS a").withColumn("n", F.lit(7))
    out = D.work_days_between(D.add_work_days(days, cal, "a", F.col("n"), "b"), cal, "a", "b").collect()
    assert all(r["work_days"] == 7 for r in out)


def test_open_ends_and_links_to_unknown_activities(spark):
    acts = spark.createDataFrame([(1, "A", "Not Started"), (1, "B", None), (1, "C", "Complete")], "project_id long, task_id string, status string")
    links = spark.createDataFrame([(1, "A", "B", "FS", 0), (1, "A", "X", "FS", 0)], LINK)
    assert S.known_links(links, acts).count() == 1
    assert {(r["task_id"], r["open_start"], r["open_finish"]) for r in S.open_ends(acts, links).collect()} == {("A", True, False), ("B", False, True)}


def net(spark, rows, links, project=None):
    """Rows of (task_id, changes) on an open week from Monday, 1 January 2024."""
    from plumbline.operators import network as N

    names = ["remaining", "status", "actual_start", "actual_finish", "task_type", "constraint_type", "constraint_date", "start"]
    kinds = "project_id long, task_id string, calendar_id string, remaining int, status string, actual_start date, actual_finish date, task_type string, constraint_type string, constraint_date date, start date"
    acts = spark.createDataFrame([(1, t, "w", *[({"start": D_(2024, 1, 1)} | c).get(k) for k in names]) for t, c in rows], kinds)
    cal = spark.createDataFrame([("w", [0, 1, 2, 3, 4], [], [])], CAL)
    own = None if project is None else spark.createDataFrame([(1, project)], "project_id long, must_finish date")
    args = (acts, spark.createDataFrame([(1, *x) for x in links], LINK), cal, own)
    return {r["task_id"]: r for r in N.critical_path(*args).collect()}, N.driving_chains(*args).orderBy("chain", "pos").collect(), [r["warning"] for r in N.network_warnings(*args).collect()]


def test_progress_keeps_actual_dates(spark):
    rows = [("A", {"status": "Complete", "actual_start": D_(2024, 1, 1), "actual_finish": D_(2024, 1, 2)}), ("B", {"status": "In Progress", "actual_start": D_(2024, 1, 1), "remaining": 2}), ("C", {"remaining": 1})]
    r, _, _ = net(spark, rows, [("A", "C", "FS", 0), ("B", "C", "FS", 0)])
    assert (r["A"]["total_float"], r["A"]["is_critical"], r["A"]["late_finish"]) == (None, False, D_(2024, 1, 2))
    assert (r["B"]["early_start"], r["B"]["early_finish"], r["C"]["early_start"]) == (D_(2024, 1, 1), D_(2024, 1, 2), D_(2024, 1, 3))


def test_milestones_and_excluded_activities(spark):
    rows = [("A", {"remaining": 5}), ("F", {"task_type": "TT_FinMile"}), ("S", {"task_type": "TT_Mile"}), ("L", {"task_type": "TT_LOE", "remaining": 90})]
    r, chains, _ = net(spark, rows, [("A", "F", "FS", 0), ("A", "S", "FS", 0)])
    assert r["F"]["early_start"] == r["F"]["early_finish"] == D_(2024, 1, 5) and r["S"]["early_start"] == D_(2024, 1, 8)
    assert r["L"]["excluded"] and r["L"]["total_float"] is None and not r["A"]["excluded"]


def test_finish_on_or_after_must_finish_and_warnings(spark):
    rows = [("A", {"remaining": 1, "constraint_type": "CS_MEOA", "constraint_date": D_(2024, 1, 10)}), ("B", {"remaining": 1}), ("C", {"remaining": 1, "constraint_type": "CS_MSO", "constraint_date": D_(2024, 1, 2)})]
    r, _, said = net(spark, rows, [("A", "B", "FS", 0), ("A", "C", "FS", 0)], D_(2024, 1, 9))
    assert r["A"]["early_finish"] == D_(2024, 1, 10) and r["B"]["total_float"] == -2
    assert any("must finish" in x for x in said) and any(x.startswith("C: mandatory start") for x in said)


def test_disjoint_chains(spark):
    rows = [(t, {"remaining": 2}) for t in "ABCDEFG"]
    links = [("A", "B", "FS", 0), ("B", "C", "FS", 0), ("D", "E", "FS", 0), ("E", "F", "FS", 0)]
    r, chains, _ = net(spark, rows, links)
    assert [(c["chain"], c["task_id"]) for c in chains] == [(0, "A"), (0, "B"), (0, "C"), (1, "D"), (1, "E"), (1, "F")]
    assert r["A"]["on_driving_path"] and not r["G"]["on_driving_path"] and r["G"]["total_float"] == 4


def test_more_than_a_thousand_calendars(spark):
    from plumbline.operators import network as N

    n = 1100
    acts = spark.range(n).selectExpr("id AS project_id", "'A' AS task_id", "CAST(id AS STRING) AS calendar_id", "1 AS duration", "DATE'2024-01-01' AS start")
    cal = spark.range(n).selectExpr("CAST(id AS STRING) AS calendar_id", "array(5) AS weekdays", "CAST(array() AS ARRAY<DATE>) AS exceptions", "CAST(array() AS ARRAY<DATE>) AS overrides")
    links = spark.createDataFrame([], LINK)
    assert {r["early_start"] for r in N.critical_path(acts, links, cal).select("early_start").collect()} == {D_(2024, 1, 6)}
