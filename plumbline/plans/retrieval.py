"""Retrieval queries over the driver's tables: documents are chunks (source: section), embeddings their vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..registry import query, table

_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _probe(spark: SparkSession, d: str, vec_id: int) -> list[float]:
    """One query vector: a single row, looked up by its id."""
    return list(table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0])


def _similar(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("vector_topk", f"SELECT e.vec_id, round({_COS}, 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_COS} DESC, e.vec_id LIMIT 10")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _similar(R.vector_topk(table(spark, d, "embeddings"), _probe(spark, d, 0), 10))


@query("vector_topk_filtered", f"SELECT e.vec_id, round({_COS}, 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label = 3 ORDER BY {_COS} DESC, e.vec_id LIMIT 10")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _similar(R.vector_topk(table(spark, d, "embeddings"), _probe(spark, d, 0), 10, where=F.col("label") == 3))


@query("vector_threshold_strict", f"SELECT e.vec_id, round({_COS}, 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 5) q WHERE {_COS} > 0.2 ORDER BY {_COS} DESC, e.vec_id LIMIT 50")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _similar(R.vector_topk(table(spark, d, "embeddings"), _probe(spark, d, 5), 50, floor=0.2))


@query("vector_threshold_inclusive", f"SELECT e.vec_id, round({_COS}, 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 5) q WHERE {_COS} >= 0.25 ORDER BY {_COS} DESC, e.vec_id LIMIT 50")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _similar(R.vector_topk(table(spark, d, "embeddings"), _probe(spark, d, 5), 50, floor=0.25, inclusive=True))


@query("vector_topk_batch", f"""
    SELECT probe_id, vec_id, rank, round(s, 6) AS similarity FROM (
      SELECT q.vec_id AS probe_id, e.vec_id, {_COS} AS s, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS INTEGER) AS rank
      FROM embeddings e JOIN (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0) q ON e.vec_id <> q.vec_id) WHERE rank <= 5""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Every fiftieth vector as a probe, against all rows."""
    e = table(spark, d, "embeddings")
    probes = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("probe_id"), F.col("embedding").alias("probe"))
    found = R.vector_topk_batch(e, probes, 5)
    return found.select("probe_id", F.col("id").alias("vec_id"), "rank", F.round("similarity", 6).alias("similarity"))


_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_TF = "(len(list_filter(t, lambda x: x = '{0}')) / (len(list_filter(t, lambda x: x = '{0}')) + 1.0))"


@query("keyword_and_search", f"SELECT doc_id, round({_TF.format('the')} + {_TF.format('that')} + {_TF.format('with')}, 6) AS rank_score FROM (SELECT doc_id, {_TOKENS} AS t FROM documents) WHERE list_contains(t, 'the') AND list_contains(t, 'that') AND list_contains(t, 'with') ORDER BY {_TF.format('the')} + {_TF.format('that')} + {_TF.format('with')} DESC, doc_id LIMIT 20")
def _(spark: SparkSession, d: str) -> DataFrame:
    return R.keyword_topk(table(spark, d, "documents"), ["the", "that", "with"], 20).select("doc_id", F.round("rank_score", 6).alias("rank_score"))


@query("keyword_phrase_search", f"SELECT doc_id FROM (SELECT doc_id, {_TOKENS} AS t FROM documents) WHERE contains(' ' || array_to_string(t, ' ') || ' ', ' of the ')")
def _(spark: SparkSession, d: str) -> DataFrame:
    return R.keyword_topk(table(spark, d, "documents"), phrase=["of", "the"], k=None).select("doc_id")


@query("keyword_negation_search", f"SELECT doc_id FROM (SELECT doc_id, {_TOKENS} AS t FROM documents) WHERE list_contains(t, 'and') AND NOT list_contains(t, 'with')")
def _(spark: SparkSession, d: str) -> DataFrame:
    return R.keyword_topk(table(spark, d, "documents"), ["and"], None, without=["with"]).select("doc_id")


@query("keyword_batch_postings", f"""
    WITH p AS (SELECT doc_id, lexeme, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS lexeme FROM documents) GROUP BY ALL),
    q AS (SELECT * FROM (VALUES (1, 'the'), (1, 'and'), (2, 'und'), (2, 'die'), (3, 'les')) v(query_id, lexeme)),
    h AS (SELECT query_id, doc_id, count(*) AS found, sum(tf / (tf + 1.0)) AS s FROM p JOIN q USING (lexeme) GROUP BY ALL),
    n AS (SELECT query_id, count(*) AS n FROM q GROUP BY ALL)
    SELECT query_id, doc_id, rank, round(s, 6) AS rank_score FROM (SELECT h.*, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS INTEGER) AS rank FROM h JOIN n USING (query_id) WHERE found = n) WHERE rank <= 5""")
def _(spark: SparkSession, d: str) -> DataFrame:
    queries = spark.createDataFrame([(1, ["the", "and"]), (2, ["und", "die"]), (3, ["les"])], "query_id int, terms array<string>")
    found = R.keyword_batch(R.keyword_postings(table(spark, d, "documents"), asked=queries), queries, 5)
    return found.select("query_id", F.col("id").alias("doc_id"), "rank", F.round("rank_score", 6).alias("rank_score"))


def _list(spark: SparkSession, d: str, vec_id: int, k: int) -> DataFrame:
    top = R.vector_topk(table(spark, d, "embeddings"), _probe(spark, d, vec_id), k)
    return R.ranked(top, [F.desc("similarity"), F.asc("vec_id")]).select(F.col("vec_id").alias("id"), "rank", "similarity")


def _list_sql(vec_id: int, k: int) -> str:
    return f"(SELECT vec_id AS id, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM (SELECT e.vec_id, {_COS} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {vec_id}) q ORDER BY s DESC, e.vec_id LIMIT {k}))"


@query("rrf_fuse_weighted", f"""
    WITH u AS (SELECT id, rank, 0 AS l, 0.6 AS w FROM {_list_sql(0, 30)} UNION ALL SELECT id, rank, 1, 0.4 FROM {_list_sql(1, 30)})
    SELECT id, round(sum(CAST(w AS DOUBLE) / (60 + rank)), 6) AS score FROM u GROUP BY id""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return R.fuse([(_list(spark, d, 0, 30), 0.6), (_list(spark, d, 1, 30), 0.4)]).select("id", F.round("score", 6).alias("score"))


@query("rrf_multi_query", f"""
    WITH u AS (SELECT id, rank, 0 AS l FROM {_list_sql(0, 40)} UNION ALL SELECT id, rank, 1 FROM {_list_sql(1, 40)} UNION ALL SELECT id, rank, 2 FROM {_list_sql(2, 40)})
    SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, count(DISTINCT l) AS query_count FROM u GROUP BY id""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return R.fuse([(_list(spark, d, i, 40), 1.0) for i in range(3)]).select("id", F.round("score", 6).alias("score"), "query_count")


def _legs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    words = R.keyword_topk(table(spark, d, "documents"), ["the", "that"], 60)
    return _list(spark, d, 0, 60), R.ranked(words, [F.desc("rank_score"), F.asc("doc_id")]).select(F.col("doc_id").alias("id"), "rank")


_KEYWORD_SQL = f"(SELECT doc_id AS id, row_number() OVER (ORDER BY s DESC, doc_id) AS rank FROM (SELECT doc_id, {_TF.format('the')} + {_TF.format('that')} AS s FROM (SELECT doc_id, {_TOKENS} AS t FROM documents) WHERE list_contains(t, 'the') AND list_contains(t, 'that') ORDER BY s DESC, doc_id LIMIT 60))"
_FUSED_SQL = f"""u AS (SELECT id, rank, 0 AS l, 0.6 AS w FROM {_list_sql(0, 60)} UNION ALL SELECT id, rank, 1, 0.4 FROM {_KEYWORD_SQL}),
    f AS (SELECT id, sum(CAST(w AS DOUBLE) / (60 + rank)) AS score, min(l * 1000 + rank) AS first FROM u GROUP BY id)"""


@query("hybrid_section_dedup", f"""
    WITH {_FUSED_SQL},
    s AS (SELECT f.*, coalesce(nullif(source, ''), CAST(id AS VARCHAR)) AS section FROM f LEFT JOIN documents ON doc_id = id),
    r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY score DESC, first) AS rn FROM s)
    SELECT id, section, round(score, 6) AS score FROM r WHERE rn = 1 ORDER BY r.score DESC, first LIMIT 12""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: both legs, weighted fusion, the best row of each section, the twelve best."""
    a, b = _legs(spark, d)
    sections = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("section"))
    found = R.dedup_sections(R.fuse([(a, 0.6), (b, 0.4)]), sections, 12)
    return found.select("id", F.coalesce(F.nullif("section", F.lit("")), F.col("id").cast("string")).alias("section"), F.round("score", 6).alias("score"))


@query("hybrid_debug_ranks", f"SELECT coalesce(a.id, b.id) AS id, CAST(a.rank AS INTEGER) AS vector_rank, CAST(b.rank AS INTEGER) AS keyword_rank FROM {_list_sql(0, 60)} a FULL JOIN {_KEYWORD_SQL} b ON a.id = b.id")
def _(spark: SparkSession, d: str) -> DataFrame:
    a, b = _legs(spark, d)
    return a.select("id", F.col("rank").alias("vector_rank")).join(b.select("id", F.col("rank").alias("keyword_rank")), "id", "full")


_CHUNKS = "SELECT doc_id, source, lang, text, CAST(100 + doc_id % 20 AS VARCHAR) || '.' || lpad(CAST(doc_id % 7 AS VARCHAR), 2, '0') AS section_id FROM documents"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    number = F.concat((F.lit(100) + F.col("doc_id") % 20).cast("string"), F.lit("."), F.lpad((F.col("doc_id") % 7).cast("string"), 2, "0"))
    return table(spark, d, "documents").select("doc_id", "source", "lang", "text", number.alias("section_id"))


@query("anchor_pin", f"SELECT doc_id, section_id FROM ({_CHUNKS}) WHERE section_id = '105.03' OR starts_with(section_id, '105.03.') OR section_id = '110' OR starts_with(section_id, '110.') ORDER BY doc_id, section_id LIMIT 12")
def _(spark: SparkSession, d: str) -> DataFrame:
    return R.pin(_chunks(spark, d), ["105.03", "110"], [], 12, order="doc_id").select("doc_id", "section_id")


@query("check_retrieval", f"""
    WITH c AS ({_CHUNKS}), p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id, section_id) AS pos FROM (SELECT * FROM c WHERE section_id = '105.03' OR starts_with(section_id, '105.03.') ORDER BY doc_id, section_id LIMIT 4)),
    {_FUSED_SQL},
    rest AS (SELECT id AS doc_id, row_number() OVER (ORDER BY score DESC, first) AS pos FROM f WHERE id NOT IN (SELECT doc_id FROM p))
    SELECT doc_id, segment, CAST(pos AS INTEGER) AS pos FROM (SELECT doc_id, 0 AS segment, pos FROM p UNION ALL SELECT doc_id, 1, pos FROM rest) ORDER BY segment, pos LIMIT 8""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Pinned passages first, then the fused ones without them."""
    pinned = R.ranked(R.pin(_chunks(spark, d), ["105.03"], [], 4, order="doc_id"), [F.col("doc_id"), F.col("section_id")], "pos").select("doc_id", F.lit(0).alias("segment"), "pos")
    a, b = _legs(spark, d)
    rest = R.fuse([(a, 0.6), (b, 0.4)]).withColumnRenamed("id", "doc_id").join(pinned.select("doc_id"), "doc_id", "left_anti")
    rest = R.ranked(rest, [F.desc("score"), F.asc("first_list"), F.asc("first_rank")], "pos").select("doc_id", F.lit(1).alias("segment"), "pos")
    return pinned.unionAll(rest).orderBy("segment", "pos").limit(8)


_REFS = [(0, "See 105.03 and 106.01; 105.03 again."), (1, "Under 107.02 and 106.01."), (2, "As in 108.11, 105.03."), (3, "No reference.")]
_REFS_SQL = "(VALUES " + ", ".join(f"({i}, '{t}')" for i, t in _REFS) + ") v(pos, text)"


@query("xref_top_refs", f"""
    WITH r AS (SELECT pos, unnest(regexp_extract_all(text, '\\b\\d{{3}}\\.\\d{{2}}\\b')) AS ref, unnest(range(len(regexp_extract_all(text, '\\b\\d{{3}}\\.\\d{{2}}\\b')))) AS p FROM {_REFS_SQL})
    SELECT ref, count(*) AS n FROM r WHERE ref <> '107.02' GROUP BY ref ORDER BY n DESC, min(pos * 100 + p) LIMIT 3""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return R.top_references(spark.createDataFrame(_REFS, "pos int, text string"), ["107.02"], 3)


@query("xref_follow", f"""
    WITH c AS ({_CHUNKS}), r AS (SELECT DISTINCT ref FROM (SELECT unnest(regexp_extract_all(text, '\\b\\d{{3}}\\.\\d{{2}}\\b')) AS ref FROM {_REFS_SQL}))
    SELECT doc_id, section_id, CAST(rank AS INTEGER) AS rank FROM (SELECT doc_id, section_id, row_number() OVER (PARTITION BY section_id ORDER BY doc_id) AS rank FROM c JOIN r ON section_id = ref) WHERE rank <= 2""")
def _(spark: SparkSession, d: str) -> DataFrame:
    refs = R.top_references(spark.createDataFrame(_REFS, "pos int, text string"), [], 100).select(F.col("ref").alias("section_id"))
    found = _chunks(spark, d).join(F.broadcast(refs), "section_id")
    return R.best_per_group(found, ["section_id"], [F.col("doc_id")], 2).select("doc_id", "section_id", "rank")


@query("amendment_lookup", f"""
    WITH m AS (SELECT o_orderkey AS amendment_id, CAST(100 + o_custkey % 25 AS VARCHAR) || '.' || lpad(CAST(o_custkey % 9 AS VARCHAR), 2, '0') AS section_id, CAST(o_orderdate AS DATE) AS bdc_date FROM orders)
    SELECT amendment_id, section_id, bdc_date FROM m WHERE section_id IN (SELECT section_id FROM ({_CHUNKS}))""")
def _(spark: SparkSession, d: str) -> DataFrame:
    section = F.concat((F.lit(100) + F.col("o_custkey") % 25).cast("string"), F.lit("."), F.lpad((F.col("o_custkey") % 9).cast("string"), 2, "0"))
    m = table(spark, d, "orders").select(F.col("o_orderkey").alias("amendment_id"), section.alias("section_id"), F.col("o_orderdate").cast("date").alias("bdc_date"))
    return R.amendments(_chunks(spark, d), m).select("amendment_id", "section_id", "bdc_date")


@query("citation_validate", """
    WITH ch AS (SELECT doc_id AS chunk_id, source AS section, n_chars AS page, doc_id AS pos FROM documents),
    ci AS (SELECT doc_id AS cite_id, CASE WHEN doc_id % 3 = 0 THEN -doc_id - 1 ELSE doc_id END AS chunk_id, CASE WHEN doc_id % 2 = 0 THEN 'SRC' || (doc_id % 25) ELSE 'none' END AS section FROM labels),
    s AS (SELECT lower(section) AS sec, arg_min(page, pos) AS page FROM ch GROUP BY 1)
    SELECT cite_id, ci.chunk_id, ci.section, coalesce(ch.page, s.page) AS page, (ch.page IS NOT NULL OR s.page IS NOT NULL) AS verified
    FROM ci LEFT JOIN ch USING (chunk_id) LEFT JOIN s ON lower(ci.section) = s.sec""")
def _(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("section"), F.col("n_chars").alias("page"), F.col("doc_id").alias("pos"))
    cites = table(spark, d, "labels").select(
        F.col("doc_id").alias("cite_id"), F.when(F.col("doc_id") % 3 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("chunk_id"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("SRC"), (F.col("doc_id") % 25).cast("string"))).otherwise("none").alias("section"),
    )
    return R.valid_citations(cites, chunks)


@query("citation_per_page", "SELECT conv_id, turn, CAST(rank AS INTEGER) AS rank FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rank FROM conversations) WHERE rank <= 3")
def _(spark: SparkSession, d: str) -> DataFrame:
    return R.best_per_group(table(spark, d, "conversations"), ["conv_id"], [F.desc(F.char_length("text")), F.asc("turn")], 3).select("conv_id", "turn", "rank")


@query("context_assembly", "SELECT string_agg('[' || rank || '] ' || source || chr(10) || lang, chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS n_chunks FROM (SELECT row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank, source, lang FROM documents) WHERE rank <= 8")
def _(spark: SparkSession, d: str) -> DataFrame:
    top = table(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(12)
    chunks = R.ranked(top, [F.desc("n_chars"), F.asc("doc_id")]).select("rank", F.col("source").alias("section"), F.col("lang").alias("text"))
    return R.assemble_context(chunks)


@query("retrieval_probe", f"""
    WITH t AS (SELECT q.vec_id AS probe_id, q.label AS ql, e.label, {_COS} AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS rank
      FROM embeddings e JOIN (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q ON e.vec_id <> q.vec_id)
    SELECT probe_id, count(*) AS n_rows, round(max(s), 6) AS top_similarity, bool_or(label = ql) AS anchor_in_top FROM t WHERE rank <= 5 GROUP BY probe_id""")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    probes = e.where("vec_id % 50 = 0")
    found = R.vector_topk_batch(e, probes.select(F.col("vec_id").alias("probe_id"), F.col("embedding").alias("probe")), 5)
    own = found.join(e.select(F.col("vec_id").alias("id"), "label"), "id").join(probes.select(F.col("vec_id").alias("probe_id"), F.col("label").alias("ql")), "probe_id")
    return own.groupBy("probe_id").agg(F.count("*").alias("n_rows"), F.round(F.max("similarity"), 6).alias("top_similarity"), F.bool_or(F.col("label") == F.col("ql")).alias("anchor_in_top"))


