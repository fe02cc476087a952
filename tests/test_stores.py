"""The graph store: merges, commits, wipes and what they leave alone; tables on pages with odd words."""

import os

import pytest
from pyspark.sql import types as T

import plumbline.registry  # noqa: F401
from plumbline.operators import geometry as G
from plumbline.sources.graph_store import GraphStore

NODE = T.StructType([T.StructField("project_id", T.LongType()), T.StructField("node", T.StringType()), T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])


def files(root, project):
    out = {}
    for top, _, names in os.walk(root):
        for n in names:
            if f"project_id={project}/" in f"{top}/" and n.endswith(".parquet"):
                out[f"{top}/{n}"] = os.stat(f"{top}/{n}").st_mtime_ns
    return out


@pytest.fixture
def store(spark, tmp_path):
    return GraphStore(spark, f"file://{tmp_path}", {"nodes": NODE, "edges": T.StructType([T.StructField("project_id", T.LongType()), T.StructField("x", T.StringType())])}), str(tmp_path)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_merges(spark, store):
    g, root = store
    assert g.read("nodes").collect() == [] and rows_of(g.superseded("nodes")) == []
    make = lambda rows, s="project_id long, node string, a int, b string": spark.createDataFrame(rows, s)
    g.merge("nodes", make([(1, "x", 1, "old"), (1, "y", 2, None), (2, "x", 3, "two"), (None, "z", 4, "lost"), (1, None, 5, "no name")]), ["node"])
    before = files(root, 2)
    change = make([(1, "x", None, "new"), (1, "w", 7, None), (1, "w", 6, "more"), (1, None, 8, None)])
    g.merge("nodes", change, ["node"])
    once = rows_of(g.read("nodes"))
    g.merge("nodes", change, ["node"])
    assert rows_of(g.read("nodes")) == once == sorted([(1, "x", 1, "new"), (1, "y", 2, None), (1, "w", 7, "more"), (1, None, 8, "no name"), (2, "x", 3, "two")], key=repr)
    g.merge("nodes", make([]), ["node"], without=make([(1, "y", None, None), (1, None, None, None), (9, "q", None, None)]))
    assert rows_of(g.read("nodes")) == sorted([(1, "x", 1, "new"), (1, "w", 7, "more"), (2, "x", 3, "two")], key=repr)
    g.merge("nodes", make([(1, "v")], "project_id long, node string"), ["node"])
    assert (1, "v", None, None) in rows_of(g.read("nodes")) and before and files(root, 2) == before


def test_a_wipe_touches_one_project(spark, store):
    g, root = store
    for kind, schema, rows in (("nodes", "project_id long, node string", [(1, "x"), (2, "x")]), ("edges", "project_id long, x string", [(1, "e"), (2, "e")])):
        g.merge(kind, spark.createDataFrame(rows, schema), ["node"] if kind == "nodes" else ["x"])
    others, own = files(root, 2), files(root, 1)
    g.wipe(spark.createDataFrame([(1,), (7,), (None,)], "project_id long"))
    assert files(root, 2) == others and files(root, 1) == own and len(others) == 2
    assert {r["project_id"] for k in ("nodes", "edges") for r in g.read(k).collect()} == {2} and rows_of(g.superseded("nodes")) == [(1, 1)]
    g.merge("nodes", spark.createDataFrame([(1, "again")], "project_id long, node string"), ["node"])
    assert rows_of(g.read("nodes").where("project_id = 1")) == [(1, "again", None, None)]


def test_readers_see_commits_only(spark, store):
    g, root = store
    g.merge("nodes", spark.createDataFrame([(1, "x", 1)], "project_id long, node string, a int"), ["node"])
    # A writer that fails before its commit leaves files that nobody reads.
    spark.createDataFrame([(1, "half", 9, None, 2)], "project_id long, node string, a int, b string, v long").write.mode("append").partitionBy("project_id", "v").parquet(f"file://{root}/nodes")
    assert rows_of(g.read("nodes")) == [(1, "x", 1, None)]
    os.makedirs(f"{root}/commits/{2:012d}")
    with pytest.raises(RuntimeError):
        g._commit(2, spark.createDataFrame([("nodes", 1, 2)], "kind string, project_id long, v long"))
    with pytest.raises(ValueError):
        GraphStore(spark, f"file://{root}", {"x": T.StructType([])})


WORD = "doc int, page int, x0 double, x1 double, top double, bottom double, text string"


def line(page, top, *cells, doc=1):
    return [(doc, page, 50.0 + 100 * i, 90.0 + 100 * i, float(top), float(top) + 10, c) for i, c in enumerate(cells)]


def tables(spark, rows):
    found = G.lines(spark.createDataFrame(rows, WORD))
    return {(r["page"], r["idx"]): r for r in G.with_footnotes(G.with_captions(G.find_tables(found), found), found).collect()}


def test_captions_and_notes(spark):
    rows = line(1, 100, "Table 1.1 far") + line(1, 130, "TABLE 902.03.01-2 Near one") + line(1, 170, "a", "b") + line(1, 184, "c", "d")
    rows += line(1, 200, "* first") + line(1, 214, "goes on") + line(1, 228, "Note: second") + line(1, 300, "1. too far")
    rows += line(2, 100, "Table 5.5 too high") + line(2, 161, "a", "b") + line(2, 175, "c", "d") + line(2, 189, "e", "f", "g") + line(2, 203, "h", "i", "j") + line(2, 217, "2) last")
    got = tables(spark, rows)
    assert got[1, 1]["table_id"] == "902.03.01-2" and got[1, 1]["title"] == "Near one" and got[1, 1]["notes"] == ["* first goes on", "Note: second"] and got[1, 1]["rows"] == [["a", "b"], ["c", "d"]]
    assert got[2, 1]["table_id"] == "p2_t1" and got[2, 1]["notes"] == [] and got[2, 2]["n_cells"] == 3 and got[2, 2]["notes"] == ["2) last"] and len(got) == 3


def test_odd_words(spark):
    rows = [(1, 1, None, 1.0, 2.0, 3.0, "x"), (1, 1, 1.0, 2.0, 2.0, 3.0, None)] + line(1, 50, "a", "b") + line(None, 50, "a", "b", doc=None) + line(None, 64, "c", "d", doc=None) + line(3, 50, "a", "b") * 2
    got = G.find_tables(G.lines(spark.createDataFrame(rows, WORD))).collect()
    assert [(r["doc"], r["n_rows"]) for r in got] == [(None, 2)]
    assert tables(spark, [(1, 1, None, None, None, None, "x")]) == {} and G.find_tables(G.lines(spark.createDataFrame([], WORD))).count() == 0
