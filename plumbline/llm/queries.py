"""The queries opN_<name>: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, curves, gated, interpolation, line_runs, lsh_forest, media, packing, pages, prefix_free, sharding, spelling, whitening


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards under the law ``rows``; see sharding.curve_shards."""
    shards = sharding.curve_shards(_read(spark, sf_dir, "documents"), 24)
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        "curve", "cell_lang", "cell_source", "cell_size",
    )


def op2_text_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a stored PNG, read back; see media.with_text_image and media.with_image_features."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return media.with_image_features(media.with_text_image(docs))


def op3_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents; see lsh_forest.near_duplicates."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return lsh_forest.near_duplicates(docs, percent=85)


def op9_prefix_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without strings of 400 bytes that repeat anywhere; see prefix_free.without_repeats.

    text is what stays, with a replacement character where a run's end cuts one.
    """
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    kept = prefix_free.without_repeats(docs, length=400)
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), text.alias("text"))


def byte_bpe_path() -> str:
    """The public byte-level vocabulary that op8 and op10 name."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def toxicity_model(spark: SparkSession, sf_dir: str) -> gated.Network:
    """The network, trained on a bounded sample of the labelled documents (gated.labelled_sample), with the toxic share of all labels."""
    known = _read(spark, sf_dir, "labels")
    texts, labels = gated.labelled_sample(_read(spark, sf_dir, "documents"), known)
    return gated.train(texts, labels, prior=gated.toxic_share(known))


def op4_gated_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; see gated.with_toxicity."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = gated.with_toxicity(docs, toxicity_model(spark, sf_dir))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_curve_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows of every hundredth vector; see curves.nearest."""
    return curves.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op6_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without later copies of all repeated non-blank line runs; see line_runs.without_repeated_runs."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_runs.without_repeated_runs(docs, min_words=1)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages; see pages.main_text."""
    found = pages.main_text(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens; see packing.pack."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, byte_bpe_path(), capacity=1024, end=0)


def op10_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded; see bpe.round_trip."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, byte_bpe_path()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their spelling's form and root; see spelling.variants."""
    return spelling.variants(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under a model learned from those that aren't held out; see interpolation.score."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return interpolation.score(docs, ~held_out).select(
        "doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op13_merged_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of all embeddings; see whitening.whiten."""
    return whitening.whiten(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=8)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hilbert_shards": op1_hilbert_shards,
    "op2_text_images": op2_text_images,
    "op3_lsh_forest": op3_lsh_forest,
    "op4_gated_toxicity": op4_gated_toxicity,
    "op5_curve_neighbours": op5_curve_neighbours,
    "op6_line_runs": op6_line_runs,
    "op7_site_templates": op7_site_templates,
    "op8_harmonic_packing": op8_harmonic_packing,
    "op9_prefix_free": op9_prefix_free,
    "op10_trie_bpe": op10_trie_bpe,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_deleted_interpolation": op12_deleted_interpolation,
    "op13_merged_whitening": op13_merged_whitening,
}

#: What separates words where lines are counted (white space of Python's str.split), as a regular-expression class.
_SPACE = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: DuckDB SQL where it can express a query; the other queries are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op3_lsh_forest": rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS t FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(t[i:i + 4], ' ') AS g FROM (SELECT doc_id, t, unnest(range(1, greatest(len(t) - 4, 1) + 1)) AS i FROM w WHERE len(t) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * x >= 85 * (p.n + q.n - x)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d),
        m AS (SELECT d, min(c) AS c FROM r GROUP BY 1)
        SELECT m.d AS doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, m.d = m.c AS kept FROM m LEFT JOIN n ON n.doc_id = m.d""",
    # A line with words is a window; a blank one is looked up with the blank lines before the next such line, and after the last one.
    "op6_line_runs": rf"""WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
        p AS (SELECT *, CASE WHEN regexp_matches(line, '[^{_SPACE}]') THEN pos END AS w FROM l),
        t AS (SELECT *, max(w) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS low,
            min(w) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS high FROM p),
        x AS (SELECT doc_id, low AS a, pos AS b FROM t WHERE low IS NOT NULL UNION SELECT doc_id, pos, high FROM t WHERE high IS NOT NULL),
        c AS (SELECT x.*, md5(array_to_string(ls[a + 1:b + 1], chr(10))) AS body FROM x JOIN d USING (doc_id)),
        r AS (SELECT *, row_number() OVER (PARTITION BY body, b - a ORDER BY doc_id, a) AS copy FROM c),
        g AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS pos, true AS gone FROM r WHERE copy > 1),
        k AS (SELECT doc_id, count(*) AS n_lines, count(gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (gone IS NULL), '') AS kept
            FROM l LEFT JOIN g USING (doc_id, pos) GROUP BY 1)
        SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(kept) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
}
