"""Every query with SQL returns the rows that DuckDB returns."""

import math

import duckdb
import pytest

from plumbline.registry import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.isoformat().replace("T00:00:00", "") if hasattr(v, "isoformat") else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf_dir, duck, name):
    df, sql = QUERIES[name](spark, sf_dir), duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(list(sql.columns), sql.fetchall())
