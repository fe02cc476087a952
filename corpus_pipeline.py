"""The corpus pipeline: stages over documents, each written as Parquet and reread by the next."""

from __future__ import annotations

import atexit
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import gated, line_runs, lsh_forest, packing, prefix_free
from plumbline.llm.common import collecting, drop_table, free_name, materialise, materialise_at
from plumbline.llm.queries import byte_bpe_path, toxicity_model

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Tables that the results of earlier stages read.
_LEFT: set[str] = set()


def _drop_left(spark: SparkSession, read: list[str]) -> None:
    for path in [p for p in _LEFT if not any(f"/{p.rsplit('/', 1)[-1]}/" in x for x in read)]:
        drop_table(spark, path)
        _LEFT.discard(path)


def _drop_at_exit(spark: SparkSession) -> None:
    try:
        _drop_left(spark, [])
    except Exception:  # the JVM may be gone; the shared folder is then cleaned with the job
        return


def _tidy(stage: Stage) -> Stage:
    """A stage's input is what the one before has written, so tables that earlier stages left are dropped first, save
    those that the input reads. Stages of one session run one after another."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not _LEFT:
            atexit.register(_drop_at_exit, spark)
        _drop_left(spark, docs.inputFiles())
        with collecting(_LEFT):
            return stage(spark, docs, sf_dir)

    return run_stage


def _as_documents(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    if "n_chars" in like.columns:
        df = df.withColumn("n_chars", F.char_length("text").cast(like.schema["n_chars"].dataType))
    return df.select(*like.columns)


@_tidy
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the gated network scores below 0.3; those without words stay."""
    score = free_name(docs.columns, "score")
    scored = gated.with_toxicity(docs, toxicity_model(spark, sf_dir), out=score)
    return scored.where((F.col(score) < 0.3) | ~gated.has_words(F.col("text"))).select(*docs.columns)


@_tidy
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; documents that lose all their lines go."""
    kept = line_runs.without_repeated_runs(docs)
    return _as_documents(kept.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S")), docs)


@_tidy
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8): the one with the least doc_id."""
    row = free_name(docs.columns, "row")
    rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "near-rows")
    groups = lsh_forest.near_duplicates(rows, key=row, percent=80).select(row, "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col(row).alias("r"))
    first = groups.join(rows.select(row, "doc_id"), row).groupBy("component_id").agg(F.min(order).alias("m"))
    return rows.join(first.select(F.col("m.r").alias(row)), row, "left_semi").select(*docs.columns)


@_tidy
def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings of 200 bytes (under 50 words) that repeat; documents that lose all go."""
    kept = prefix_free.without_repeats(docs, length=200, out="text", whole_characters=True).withColumn("text", F.col("text").cast("string"))
    return _as_documents(kept.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S")), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents in sequences of 1024 tokens."""
    return packing.pack(docs, byte_bpe_path(), capacity=1024, end=0)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("repeat_dedup", repeat_dedup),
    ("pack", pack),
]

#: SQL can't express a trained network or signature orders; tests/llm holds the pipeline against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; a stage's table goes when the next one's is written."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, path = materialise_at(docs, f"stage-{name}")
            if held:
                drop_table(spark, held)
            held = path
    return docs
