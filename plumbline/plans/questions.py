"""All texts of benchmark as questions over all documents, in one job: documents are chunks, embeddings their vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..external import expand
from ..functions import stems as S
from ..functions.text import QUESTION_WORDS
from ..operators import fulltext as X
from ..operators import questions as Q
from ..registry import query, table
from ..session import written
from .fulltext import _INDEX, _RANKED

_K = 5
# Questions ask for two of a text's longer words; every fourth one names a section too, which weighs the keyword leg more.
_BASE_SQL = f"""WITH ch AS (SELECT doc_id, CAST(100 + doc_id % 20 AS VARCHAR) || '.' || lpad(CAST(doc_id % 7 AS VARCHAR), 2, '0') AS section, text || ' See ' || CAST(100 + doc_id * 7 % 20 AS VARCHAR) || '.' || lpad(CAST(doc_id * 3 % 7 AS VARCHAR), 2, '0') || ' and ' || CAST(100 + doc_id // 7 % 20 AS VARCHAR) || '.' || lpad(CAST(doc_id // 7 % 7 AS VARCHAR), 2, '0') || '.' AS text FROM documents),
    bq AS (SELECT item_id AS query_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 5) AS w FROM benchmark),
    qu AS (SELECT query_id, 'What is ' || coalesce(w[1], '') || ' ' || coalesce(w[2], '') || CASE WHEN query_id % 4 = 1 THEN ' in section 105.03' ELSE '' END || '?' AS query FROM bq),
    cl AS (SELECT query_id, query, array_to_string(list_filter(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 1 AND w NOT IN ({", ".join(f"'{w}'" for w in QUESTION_WORDS)})), ' ') AS cleaned FROM qu),
    va AS (SELECT query_id, 0 AS variant_no, query AS variant, cleaned FROM cl UNION ALL SELECT query_id, 1, cleaned, cleaned FROM cl WHERE cleaned <> query),
    wt AS (SELECT *, CASE WHEN regexp_matches(variant, '\\b\\d{{3}}\\.\\d{{2}}\\b|(?i)\\bsection\\s+\\d+\\b') THEN 0.3 ELSE 0.6 END AS vw, CASE WHEN regexp_matches(variant, '\\b\\d{{3}}\\.\\d{{2}}\\b|(?i)\\bsection\\s+\\d+\\b') THEN 0.7 ELSE 0.4 END AS kw FROM va),
    {_INDEX.replace("FROM documents", "FROM ch")},
    q0 AS (SELECT query_id * 10 + variant_no AS query_id, unnest(string_split(cleaned, ' ')) AS word, unnest(range(len(string_split(cleaned, ' ')))) AS item FROM va),
    q AS (SELECT query_id, 0 AS alt, item, false AS without, 0 AS off, word FROM q0 WHERE word NOT IN ({", ".join(f"'{w}'" for w in S.STOP_WORDS)}) AND word <> ''), {_RANKED},
    vr AS (SELECT va.query_id, variant_no, e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], p.embedding::DOUBLE[]) AS s FROM va JOIN embeddings p ON p.vec_id = va.query_id + variant_no, embeddings e),
    vl AS (SELECT *, row_number() OVER (PARTITION BY query_id, variant_no ORDER BY round(s, 9) DESC, id) AS rank FROM vr WHERE s > 0),
    bo AS (SELECT vl.query_id, vl.variant_no, id, rank, 0 AS leg, CAST(vw AS DOUBLE) AS w FROM vl JOIN wt USING (query_id, variant_no) WHERE rank <= 25 UNION ALL SELECT wt.query_id, wt.variant_no, doc_id, rank, 1, CAST(kw AS DOUBLE) FROM r JOIN wt ON wt.query_id * 10 + wt.variant_no = r.query_id WHERE rank <= 25),
    f1 AS (SELECT query_id, variant_no, id, sum(w / (60 + rank)) AS score, min(leg * 1000 + rank) AS first FROM bo GROUP BY 1, 2, 3),
    f2 AS (SELECT f1.*, coalesce(section, CAST(id AS VARCHAR)) AS g FROM f1 LEFT JOIN ch ON doc_id = id),
    f3 AS (SELECT *, row_number() OVER (PARTITION BY query_id, variant_no ORDER BY round(score, 9) DESC, first, id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, variant_no, g ORDER BY round(score, 9) DESC, first, id) AS rn FROM f2) WHERE rn = 1),
    m1 AS (SELECT query_id, id, any_value(g) AS g, sum(1.0::DOUBLE / (60 + rank)) AS score, min(variant_no * 1000 + rank) AS first, count(*) AS n_variants FROM f3 WHERE rank <= {_K} GROUP BY 1, 2),
    m2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first, id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, g ORDER BY round(score, 9) DESC, first, id) AS rn FROM m1) WHERE rn = 1),
    main AS (SELECT query_id, id, section, rank, score, n_variants, text FROM m2 LEFT JOIN ch ON doc_id = id WHERE rank <= {_K})"""
_REFS_SQL = f"""{_BASE_SQL}, nm AS (SELECT query_id, rank, unnest(regexp_extract_all(text, '{Q.REFERENCE}', 1)) AS ref, unnest(range(len(regexp_extract_all(text, '{Q.REFERENCE}', 1)))) AS i FROM main),
    ct AS (SELECT query_id, ref, count(*) AS n, min(rank * 100000 + i) AS first FROM nm WHERE NOT EXISTS (SELECT 1 FROM main x WHERE x.query_id = nm.query_id AND x.section = nm.ref) GROUP BY 1, 2),
    tr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, first) AS ref_no FROM ct) WHERE ref_no <= 3),
    rp AS (SELECT lexeme AS ref, doc_id, count(*) AS n FROM p WHERE lexeme IN (SELECT ref FROM tr) GROUP BY 1, 2), rh AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY n DESC, doc_id) AS hit FROM rp),
    ad AS (SELECT tr.query_id, tr.ref, ref_no, hit, rh.doc_id AS id, section, text FROM tr JOIN rh ON rh.ref = tr.ref AND hit <= 2 JOIN ch USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM main x WHERE x.query_id = tr.query_id AND x.section = ch.section)),
    a1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ref_no, hit) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, section ORDER BY ref_no, hit) AS rn FROM ad) WHERE rn = 1)"""


def _setup(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, questions, what is retrieved (a table)."""
    i = F.col("doc_id")
    number = lambda a, b: F.concat((F.lit(100) + a % 20).cast("string"), F.lit("."), F.lpad((b % 7).cast("string"), 2, "0"))
    chunks = table(spark, d, "documents").select(i.alias("id"), number(i, i).alias("section"), F.concat("text", F.lit(" See "), number(i * 7, i * 3), F.lit(" and "), number(F.floor(i / 7), F.floor(i / 7)), F.lit(".")).alias("text"))
    w = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda x: F.length(x) >= 5)
    word = lambda k: F.coalesce(F.get(w, F.lit(k)), F.lit(""))
    asked = F.concat(F.lit("What is "), word(0), F.lit(" "), word(1), F.when(F.col("item_id") % 4 == 1, " in section 105.03").otherwise(""), F.lit("?"))
    questions = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), asked.alias("query"))
    variants = expand(questions, "query").select("query_id", F.col("variant_no").cast("int").alias("variant_no"), "variant")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    probes = variants.select("query_id", "variant_no", (F.col("query_id") + F.col("variant_no")).alias("v")).join(vectors.select(F.col("id").alias("v"), F.col("embedding").alias("probe")), "v").drop("v")
    index = X.positions(chunks, id_col="id", asked=Q.asked_terms(variants))
    return chunks, questions, written(Q.retrieve(variants, index, vectors, probes, chunks.select("id", "section"), _K), "found")


@query("question_retrieval", f"{_BASE_SQL} SELECT query_id, id, section, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, n_variants FROM main")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The best chunks of every question: variants, both legs, fusion, one chunk for each section."""
    return _setup(spark, d)[2].withColumn("score", F.round("score", 6))


@query("question_references", f"{_REFS_SQL} SELECT query_id, ref, id, section, CAST(place AS INTEGER) AS place FROM a1")
def _(spark: SparkSession, d: str) -> DataFrame:
    """What the found chunks refer to, for all questions at once."""
    chunks, _, found = _setup(spark, d)
    return Q.follow_references(found, None, chunks)


@query("question_answers", f"""{_REFS_SQL}, al AS (SELECT query_id, 0 AS part, rank AS place, id, section, text FROM main UNION ALL SELECT query_id, 1, place, id, section, text FROM a1),
    nb AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY part, place) AS n FROM al WHERE text IS NOT NULL),
    am AS (SELECT CAST(100 + o_custkey % 25 AS VARCHAR) || '.' || lpad(CAST(o_custkey % 9 AS VARCHAR), 2, '0') AS section, CAST(o_orderdate AS DATE) AS day, 'Change ' || o_orderkey AS text FROM orders WHERE o_orderpriority = '1-URGENT'),
    cx AS (SELECT query_id, count(*) AS n_chunks, string_agg('[' || n || '] ' || section || chr(10) || text, chr(10) || chr(10) ORDER BY n) AS body, string_agg('[' || n || ']', ' ' ORDER BY n) AS own FROM nb GROUP BY 1),
    ax AS (SELECT query_id, count(*) AS n_amendments, string_agg('Amendment of ' || am.section || ': ' || am.text, chr(10) || chr(10) ORDER BY day, am.section, am.text) AS head FROM (SELECT DISTINCT query_id, section FROM nb) JOIN am USING (section) GROUP BY 1)
    SELECT query_id, CASE WHEN query_id % 4 = 1 THEN 'keyword-heavy' ELSE 'semantic' END AS kind, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_amendments, 0) AS n_amendments, md5(concat_ws(chr(10) || chr(10), head, body)) AS context, coalesce(n_chunks, 0) AS n_verified FROM qu LEFT JOIN cx USING (query_id) LEFT JOIN ax USING (query_id)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Every question from its variants to its checked citations, in one job."""
    chunks, questions, found = _setup(spark, d)
    c = F.col("o_custkey")
    number = F.concat((F.lit(100) + c % 25).cast("string"), F.lit("."), F.lpad((c % 9).cast("string"), 2, "0"))
    amendments = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(number.alias("section"), F.col("o_orderdate").cast("date").alias("day"), F.concat(F.lit("Change "), F.col("o_orderkey").cast("string")).alias("text"))
    out = Q.answer(questions, found, written(Q.follow_references(found, None, chunks), "added"), chunks, amendments)
    verified = F.size(F.filter("citations", lambda x: x["verified"]))
    return out.select("query_id", "kind", F.col("n_chunks").cast("long").alias("n_chunks"), F.col("n_amendments").cast("long").alias("n_amendments"), F.md5(F.col("context").cast("binary")).alias("context"), verified.cast("long").alias("n_verified"))
