"""The pipeline's stages against brute-force versions, each on its own input."""

import importlib.util
import os
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def load(name, path):
    spec = importlib.util.spec_from_file_location(name, path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


force = load("operators_by_force", os.path.join(os.path.dirname(os.path.abspath(__file__)), "test_operators.py"))


def test_stages(spark, sf_dir):
    import corpus_pipeline
    from plumbline.llm.common import materialise

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, out = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialise(stage(spark, docs, sf_dir), "test-stage")
        out[name] = (before, docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            assert docs.where(F.col("n_chars") != F.char_length("text")).count() == 0

    before, after = out["toxicity"]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    ids = {r["doc_id"] for r in after.select("doc_id").collect()}
    trained = [k for k in labels if k is not None and not force.gated.is_held_out(k)]
    assert sum((k in ids) == (not labels[k]) for k in trained) >= 0.95 * len(trained)

    before, after = out["line_dedup"]
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    gone = force.lines_by_force(rows, 10)
    want = {k: "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in gone) for k, t in rows}
    assert {r["doc_id"]: r["text"] for r in after.collect()} == {k: t for k, t in want.items() if t.strip() or not any(g[0] == k for g in gone)}

    before, after = out["near_dedup"]
    groups = force.near_by_force([(r["doc_id"], r["text"]) for r in before.collect()], 80)
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(k for k, _, c in groups if k == c)

    before, after = out["repeat_dedup"]
    rows = [(r["doc_id"], r["text"].encode()) for r in before.collect()]
    kept = {k: x[3] for (k, _), x in zip(rows, force.repeats_by_force([t for _, t in rows], 200), strict=True)}
    got = {r["doc_id"]: r["text"] for r in after.collect()}
    assert all(got[k] == kept[k].decode("utf-8", "ignore") or len(got[k].encode()) - len(kept[k]) <= 6 for k in got)
    assert {k for k, t in kept.items() if t.decode("utf-8", "ignore").strip()} <= set(got)

    before, after = out["pack"]
    pieces = Counter(r["doc_id"] for r in after.collect())
    assert set(pieces) == {r["doc_id"] for r in before.collect()}
    sizes = after.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert max(r["n"] for r in sizes) <= 1024 and np.mean([r["n"] for r in sizes]) > 700


def test_stages_take_odd_rows(spark, sf_dir):
    import corpus_pipeline

    odd = spark.createDataFrame(force.ODD, force.DOC)
    for df in (force.clashing(odd, "row", "score", "gone", "places", "key"), odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, sf_dir)
            assert (out.count() > 0) == (not df.isEmpty())
            if name == "toxicity":  # rows without words stay, whatever their score
                assert out.where(F.col("doc_id").isin(1, 2, 3)).count() == (0 if df.isEmpty() else 3)
            if name != "pack":
                assert out.columns == df.columns


def test_passages_of_short_words_go(spark):
    import corpus_pipeline

    own = [" ".join(f"{a}{k}word{i}" for i in range(60)) for k, a in enumerate("abc")]
    passage = " ".join(f"{i:x}s" if i % 2 else f"p{i:04d}" for i in range(51))
    assert 200 <= len(passage.encode()) < 256
    rows = [(k, f"{x}\n{passage}\n{x[::-1]}" if k < 2 else x, "en", "a", 0) for k, x in enumerate(own)]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeat_dedup(spark, spark.createDataFrame(rows, force.DOC), "").collect()}
    assert len(got) == 3 and got[2] == own[2] and not any(passage in got[k] for k in (0, 1))
