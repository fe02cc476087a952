from pyspark.sql import functions as F

from plumbline.external import expand, hashed_embedding
from plumbline.functions import text as X
from plumbline.functions.vectors import cosine
from plumbline.operators import chunking as C
from plumbline.operators import graph as G
from plumbline.operators import retrieval as R
from plumbline.operators import rules as U
from plumbline.sources import chunks, xer
from plumbline.streaming import progress


def test_entry_imports_and_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_fuse_keeps_ranks_of_null_ids_and_adds_repeats(spark):
    a = spark.createDataFrame([(None, 1), (7, 2), (7, 3)], "id long, rank int")
    b = spark.createDataFrame([(7, 1), (8, 2)], "id long, rank int")
    out = {r["id"]: r for r in R.fuse([(a, 1.0), (b, 0.5)]).collect()}
    assert abs(out[7]["score"] - (1 / 62 + 1 / 63 + 0.5 / 61)) < 1e-12 and out[7]["query_count"] == 2
    assert set(out) == {7, 8}


def test_vector_topk_with_zero_and_null_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in R.vector_topk(df, [1.0, 0.0], 5).collect()] == [1, 4]
    assert df.select(cosine(F.col("embedding"), F.col("embedding"), 0.0).alias("c")).where("vec_id = 2").first() is not None


def test_windows_and_stitching_give_the_tokens_back(spark):
    df = spark.createDataFrame([(1, [str(i) for i in range(1711)]), (2, ["a"]), (3, [])], "k int, t array<string>")
    w = C.token_windows(df, "k", F.col("t"), 750, 100, 12)
    assert w.agg(F.max("n_tokens")).first()[0] == 750
    assert {r["k"]: r["tokens"] for r in C.stitch(w, "k").collect()} == {1: [str(i) for i in range(1711)], 2: ["a"]}


def test_stitching_keeps_repetitive_texts_whole(spark):
    made = {1: ["x"] * 1500, 2: ["a", "b", "c"] * 700}
    df = spark.createDataFrame(list(made.items()), "k int, t array<string>")
    w = C.token_windows(df, "k", F.col("t"), 600, 100)
    assert {r["k"]: r["tokens"] for r in C.stitch(w, "k").collect()} == made


def test_clean_query_falls_back(spark):
    df = spark.createDataFrame([("What is the?",), ("What about 421.03",)], "t string")
    assert [r[0] for r in df.select(X.clean_query(F.col("t"))).collect()] == ["What is the?", "about 421 03"]


def test_best_links_prefer_confidence_then_tier(spark):
    df = spark.createDataFrame([(1, "a", 0.9, 2, 0), (1, "a", 0.9, 1, 5), (1, "a", 0.5, 0, 1)], "entity int, activity string, confidence double, tier int, seq int")
    assert G.best_links(df).first()["tier"] == 1


def test_region_outside_the_bounds_is_null(spark):
    df = spark.createDataFrame([(40.5, -74.5), (39.5, -74.5), (10.0, -74.5)], "lat double, lon double")
    assert [r[0]["region"] for r in df.select(U.region(F.col("lat"), F.col("lon"))).collect()] == ["NORTH", "SOUTH", None]


def test_expand_and_embed_offline(spark):
    df = spark.createDataFrame([(1, "What is RAP?")], "id int, text string")
    assert [r["variant"] for r in expand(df).orderBy("variant_no").collect()] == ["What is RAP?", "rap"]
    v = df.select(hashed_embedding(16)(F.col("text"))).first()[0]
    assert abs(sum(x * x for x in v) - 1) < 1e-5


def test_schedule_export(spark, tmp_path):
    text = "ERMHDR\t1\n%T\tPROJECT\n%F\tproj_id\tproj_short_name\n%R\t1\tmain\n%R\t2\tother\n%T\tTASK\n%F\tproj_id\ttask_id\ttask_code\ttarget_drtn_hr_cnt\n%R\t1\t10\tA\t20\n%R\t1\t11\tA\t28\n%R\t1\t12\tB\n%T\tTASKPRED\n%F\tproj_id\tpred_task_id\ttask_id\tpred_type\tlag_hr_cnt\n%R\t1\t10\t12\tPR_SS\t8\n"
    (tmp_path / "a.xer").write_text(text)
    rows = xer.tables(xer.read_lines(spark, str(tmp_path / "a.xer")))
    assert {(r["task_id"], r["duration"]) for r in xer.activities(rows).collect()} == {("A", 4), ("B", None)}  # 28 h: 3.5 days, to even
    assert [(r["rel_type"], r["lag_days"]) for r in xer.links(rows).collect()] == [("SS", 1)]
    assert xer.main_project(rows).first()["name"] == "main"


def test_jsonl_and_idempotent_collections(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id":"1","doc":"d","collection":"s","content":"x"}\nnot json\n{"id":"2","doc":"d","collection":"s","content":"  "}\n')
    rows = chunks.read_jsonl(spark, str(tmp_path / "c.jsonl"))
    assert [r["id"] for r in rows.collect()] == ["1"]
    assert chunks.new_rows(rows, rows).count() == 0
    known = spark.createDataFrame([("specs",), ("specs_2019",)], "collection string")
    wanted = spark.createDataFrame([("specs_2019_x",), ("specs",), ("none",)], "target string")
    assert {r["target"]: r["collection"] for r in chunks.resolve_collections(wanted, known).collect()} == {"specs_2019_x": "specs_2019", "specs": "specs", "none": None}


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    source = tmp_path / "events"
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(source))
    q = progress.latest(progress.event_stream(spark, str(source))).writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = progress.latest(events.withColumn("ts", F.col("ts").cast("timestamp")))
    key = lambda df: sorted((r["user_id"], r["status"], r["n"]) for r in df.collect())
    assert key(spark.table("latest")) == key(want)


def test_ingest_twice_keeps_one_copy(spark, sf_dir, tmp_path):
    source, table = tmp_path / "in", str(tmp_path / "out")
    spark.read.parquet(f"{sf_dir}/events.parquet").limit(50).write.parquet(str(source))
    for k in range(2):
        q = progress.ingest_once(progress.event_stream(spark, str(source)), table, ["event_id"], str(tmp_path / f"check{k}"))
        q.awaitTermination(120)
    assert spark.read.parquet(table).count() == 50


def test_probes_in_blocks_find_the_same_rows(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    probes = e.where("vec_id % 5 = 0").select(F.col("vec_id").alias("probe_id"), F.col("embedding").alias("probe"))
    few, many = (sorted((r["probe_id"], r["rank"], r["id"]) for r in R.vector_topk_batch(e, probes, 3, most=most).collect()) for most in (4096, 2))
    assert few == many and len(few) == 3 * probes.count()


def test_pages_between_the_ends_of_uneven_groups(spark):
    pages = spark.createDataFrame([("hot", i) for i in range(50)] + [("two", 100), ("two", 101), ("four", 200), ("four", 201), ("four", 202), ("four", 203), (None, 300)], "doc string, page long")
    got = {r["page"] for r in C.without_ends(pages, "doc", "page", first=2, last=1).collect()}
    assert got == {*range(2, 49), 202}
    assert C.without_ends(pages.limit(0), "doc", "page", first=2, last=1).count() == 0


def test_postings_of_asked_words_are_those_of_the_index(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    asked = spark.createDataFrame([(1, ["the", "and"]), (2, ["the", "no-such-word"])], "query_id int, terms array<string>")
    all_, some = (sorted(map(tuple, p.where("lexeme IN ('the', 'and')").collect())) for p in (R.keyword_postings(docs), R.keyword_postings(docs, asked=asked)))
    assert all_ == some and len(some) > 0


def test_paths_of_deep_trees_and_loops(spark):
    from plumbline.operators.graph import tree_paths

    rows = [(i, i - 1 if i else None, str(i)) for i in range(300)] + [(1000, 1001, "a"), (1001, 1002, "b"), (1002, 1000, "c"), (1003, 1000, "below a loop"), (2000, 9999, "lost"), (3000, 3000, "itself"), (4000, None, None), (4001, 4000, "x")]
    got = {r["id"]: (r["path"], r["depth"]) for r in tree_paths(spark.createDataFrame(rows, "id int, parent int, name string")).collect()}
    assert got.keys() == {*range(300), 4000, 4001} and got[299] == (" > ".join(map(str, range(300))), 300) and got[4001] == (None, 2)
    assert tree_paths(spark.createDataFrame([], "id int, parent int, name string")).count() == 0
