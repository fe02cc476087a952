"""Schedule texts word for word, with odd and missing values."""

import datetime as dt

from plumbline.operators import rendering as R

ACTS = "project_id long, task_id string, seq int, name string, phase string, start date, finish date, duration int, total_float int, calendar_id string, constraint_type string, constraint_date date, predecessors array<string>"
DAY = dt.date(2024, 3, 4)


def texts(lines):
    return {r["project_id"]: r["text"] for r in R.schedule_texts(lines).collect()}


def test_stored_values_alone(spark):
    rows = [
        (1, "B", 2, None, "", None, None, None, None, None, "None", None, None),
        (1, "A", 1, "Dig", "P > Q", DAY, dt.date(2024, 3, 8), 5, -2, "c", "CS_MSO", None, ["X"] * 6),
        (1, "M", 3, "Done", None, None, DAY, 0, -9, "zz", "", None, []),
    ]
    found = texts(R.schedule_lines(spark.createDataFrame(rows, ACTS)))
    wanted = [
        "# Project Schedule", "",
        *[R.MILESTONES[0], "", *R.MILESTONES[1:]], "| M | Done | 2024-03-04 | -9 | — | — | — |", "",
        *[R.NEGATIVE[0], "", *R.NEGATIVE[1:]], "| M | Done | — | 2024-03-04 | -9 | — |", "| A | Dig | 2024-03-04 | 2024-03-08 | -2 | P > Q |", "",
        *[R.CONSTRAINED[0], "", *R.CONSTRAINED[1:]], "| A | Dig | CS_MSO | — | P > Q |", "",
        "## Phase: General  (1 activities, dates unknown)", "", *R.PHASE, "| B |  | — | — | — | — | — | — | — |", "",
        "## Phase: P > Q  (1 activities, 2024-03-04 → 2024-03-08)", "", *R.PHASE, "| A | Dig | 2024-03-04 | 2024-03-08 | 5 | -2 | — | — | X, X, X, X +2 |", "",
    ]
    assert found == {1: "\n".join(wanted)}


def test_many_differences_and_excluded_activities(spark):
    acts = spark.createDataFrame([(1, "A", 1, "a", None, DAY, DAY, 3, 4, None, None, None, None), (1, "L", 2, "l", None, None, None, 3, 1, None, None, None, None)], ACTS)
    cpm = spark.createDataFrame([(1, "A", DAY, DAY, 0, True, False), (1, "L", None, None, None, False, True)], "project_id long, task_id string, early_start date, early_finish date, total_float int, is_critical boolean, excluded boolean")
    chains = spark.createDataFrame([(1, 0, 0, "A"), (1, 0, 1, "gone")], "project_id long, chain int, pos int, task_id string")
    links = spark.createDataFrame([(1, "A", "gone", "SS", -2)], "project_id long, pred string, succ string, rel_type string, lag_days int")
    projects = spark.createDataFrame([(1, "", DAY, None)], "project_id long, project_name string, data_date date, must_finish date")
    checked = spark.createDataFrame([(1, 20, 0, 20, 0, 0, 1, ["one", "two"]), (9, 1, 1, 0, 0, 0, 1, [])], "project_id long, checked int, clean int, float_mismatches int, date_mismatches int, critical_flag_diffs int, tolerance int, assessment array<string>")
    some = spark.createDataFrame([(1, i, f"T{i}", "total_float", None, str(i), None) for i in range(20)], "project_id long, seq int, task_id string, field string, computed string, stored string, delta_days int")
    found = texts(R.schedule_lines(acts, None, cpm, chains, links, projects, checked, some))
    assert list(found) == [1]
    text = found[1]
    assert "Data date: 2024-03-04. Computed project finish: 2024-03-04. 1 activities are on" in text and "Project:" not in text
    assert "**Critical chain 1:**\n1. A — a (start 2024-03-04, finish 2024-03-04, total float 0)\n2. gone —  (start None, finish None, total float None) (SS-2 from A)\n\n## CPM Validation" in text
    assert "(tolerance ±1 day).\n\n- one\n- two\n\n| Activity |" in text
    assert "| T14 | total_float | None | 14 | — |\n| … | +5 more rows | | | |\n\n## Phase" in text and "| T15 |" not in text
    assert "| A | a | 2024-03-04 | 2024-03-04 | 3 | 0 (P6: 4) | Yes | — | — |\n| L | l | — | — | 3 | 1 | — | — | — |" in text


def test_empty(spark):
    assert R.schedule_texts(R.schedule_lines(spark.createDataFrame([], ACTS))).count() == 0


def test_sections_share_the_activities(spark, sf_dir):
    """Line items are put in order once, not in the plan of each section."""
    from plumbline.registry import QUERIES

    assert "l_linenumber" not in QUERIES["schedule_sections"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
