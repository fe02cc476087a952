"""Name links against all pairs."""

import datetime as dt
import difflib
import re

import numpy as np
import pytest

import plumbline.registry  # noqa: F401  (before its plans)
from plumbline.operators.graph import link_contained, link_names
from plumbline.plans.schedule import _named


def normal(x):
    return re.sub("[^a-z0-9 ]", "", x.lower()).strip()


def by_hand(entities, activities):
    out = {}
    known = {}
    for project, entity, name in entities:
        for other, activity, title in activities:
            e, a = normal(name or ""), normal(title or "")
            if project != other or len(e) < 5 or len(a) < 5:
                continue
            if (e, a) not in known:
                if a in e and len(a) / len(e) >= 0.45:
                    known[e, a] = 0.9
                elif e in a:
                    known[e, a] = 0.85
                else:
                    r = difflib.SequenceMatcher(None, e, a).ratio()
                    known[e, a] = round(r, 3) if r >= 0.75 else None
            if known[e, a]:
                key = (project, entity, activity)
                out[key] = max(out.get(key, 0), known[e, a])
    return {(*k, v) for k, v in out.items()}


def rows_of(df):
    return [(r["project"], r["entity"], r["activity"], r["confidence"]) for r in df.collect()]


def test_parts_against_all_pairs(spark, sf_dir):
    """All parts against 10,000 names or more, and no nested loop in the plan."""
    entities, activities = _named(spark, sf_dir)
    e, a = ([(r["project"], r[c], r["name"]) for r in df.collect()] for df, c in ((entities, "entity"), (activities, "activity")))
    found = link_names(entities, activities, within=["project"])
    got = rows_of(found)
    assert len(got) == len(set(got)) and set(got) == by_hand(e, a)
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyz "])
def test_made_names_against_all_pairs(spark, letters):
    rnd = np.random.default_rng(len(letters))
    base = ["".join(rnd.choice(list(letters), int(rnd.integers(3, 30)))) for _ in range(40)]

    def worn(x):
        x = list(x)
        for _ in range(int(rnd.integers(0, 6))):
            i = int(rnd.integers(0, len(x))) if x else 0
            x[i : i + int(rnd.integers(0, 2))] = rnd.choice(list(letters), int(rnd.integers(0, 3)))
        return "".join(x)

    entities = [(i % 2, i, worn(x)) for i, x in enumerate(base * 3)] + [(0, 900, None), (None, 901, "abcdef"), (0, 902, ""), (1, 903, "ab" * 400)]
    activities = [(i % 2, i, x.upper() + "!") for i, x in enumerate(base)] + [(1, 900, "ab" * 390), (0, 901, None), (0, 5, base[4])]
    make = lambda rows, c: spark.createDataFrame(rows, f"project int, {c} int, name string")
    got = rows_of(link_names(make(entities, "entity"), make(activities, "activity"), within=["project"]))
    assert len(got) == len(set(got)) and set(got) == by_hand(entities, activities)


def test_nothing_to_link(spark):
    none = spark.createDataFrame([], "entity int, name string")
    some = spark.createDataFrame([(1, "some name")], "activity int, name string")
    assert link_names(none, some).collect() == [] and link_names(some.withColumnRenamed("activity", "entity"), some.limit(0)).collect() == []
    with pytest.raises(ValueError):
        link_names(none, some, least=0.5)


def test_an_entity_with_two_names_has_both_tiers(spark):
    """Line items may share a number: SQL keeps each distinct confidence, link_names() the best one."""
    entities = spark.createDataFrame([(1, "Install old gear, 1996"), (1, "gear, old gear"), (1, "d gear"), (2, "d gear")], "entity int, name string")
    activities = spark.createDataFrame([(7, "old gear")], "activity int, name string")
    tiers = link_contained(entities, activities).collect()
    assert sorted(map(tuple, tiers)) == [(1, 7, 0.85), (1, 7, 0.9), (2, 7, 0.85)]
    assert sorted(map(tuple, link_names(entities, activities).collect())) == [(1, 7, 0.9), (2, 7, 0.85)]


def test_line_items_that_share_a_number(spark, tmp_path):
    """Two parts of a brand under one number, against SQL."""
    import duckdb

    from plumbline.registry import ORACLE, QUERIES

    spark.createDataFrame([(1, 1, 5, 4, dt.date(1996, 1, 1)), (1, 1, 6, 4, dt.date(1996, 1, 1))], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate date").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(5, "Brand#1", "old gear"), (6, "Brand#1", "ld gear")], "p_partkey long, p_brand string, p_name string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    c = duckdb.connect()
    for t in ("lineitem", "part"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name, n in (("entity_link_contained", 3), ("entity_link_methods", 2)):
        df, sql = QUERIES[name](spark, str(tmp_path)), c.sql(ORACLE[name])
        got = sorted(tuple(r[k] for k in sql.columns) for r in df.collect())
        assert len(got) == n and got == sorted(sql.fetchall())


def test_pairs_of_dated_words_are_not_shuffled(spark):
    """Pairs that share words and days are one row each, without a shuffle of pairs."""
    from plumbline.operators.graph import link_dated_words

    day = dt.date(1996, 1, 5)
    entities = spark.createDataFrame([(1, "old bridge drain", day), (1, "bridge", dt.date(1996, 1, 7)), (2, "bridge", dt.date(1997, 1, 1)), (3, None, day)], "entity int, name string, date date")
    activities = spark.createDataFrame([(7, "drain bridge", day), (7, "drain", dt.date(1996, 1, 8)), (8, "bridge", dt.date(1996, 1, 10))], "activity int, name string, date date")
    found = link_dated_words(entities, activities)
    assert sorted(map(tuple, found.collect())) == [(1, 7, 0.5), (1, 8, 0.5)]
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_days_are_counted_before_they_meet(spark, sf_dir):
    from plumbline.registry import QUERIES

    plan = QUERIES["entity_link_date_band"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 3
