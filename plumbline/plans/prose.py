"""Queries of headings, blocks, windows, tables and amendments over lines that the driver's tables give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking as C
from ..operators import retrieval as R
from ..registry import query, table
from .schedule import _ACT_SQL, activities



def _tokens_sql(column: str) -> str:
    return rf"regexp_extract_all({column}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')"


# One printed line for each activity: by place a division, section, subsection, text, sub-subsection or text again.
_LINES_SQL = f"""{_ACT_SQL}, ln AS (SELECT project_id, seq, seq // 3 AS page, l_partkey, CASE seq % 6 WHEN 1 THEN 'division' WHEN 2 THEN 'section' WHEN 3 THEN 'subsection' WHEN 5 THEN 'sub_subsection' END AS level,
    CASE seq % 6 WHEN 1 THEN 'DIVISION ' || (100 + project_id % 9) WHEN 2 THEN 'SECTION ' || (100 + project_id % 9) WHEN 3 THEN (100 + project_id % 9) || '.0' || (seq % 10) WHEN 5 THEN (100 + project_id % 9) || '.03.0' || (seq % 10) END AS id,
    CASE seq % 6 WHEN 1 THEN 'WORK ' || l_partkey WHEN 2 THEN 'PLACE ' || l_suppkey WHEN 3 THEN 'GENERAL WORK' WHEN 5 THEN 'Small part ' || l_partkey ELSE 'plain words ' || l_partkey || ', on and on.' END AS title FROM act),
    lt AS (SELECT *, CASE seq % 6 WHEN 1 THEN id || ' – ' || title WHEN 2 THEN id || ' – ' || title WHEN 3 THEN id || ' ' || title WHEN 5 THEN id || ' ' || title ELSE title END AS line FROM ln)"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    k, number = F.col("seq") % 6, (F.col("project_id") % 9 + 100).cast("string")
    tail = (F.col("seq") % 10).cast("string")
    text = (
        F.when(k == 1, F.concat(F.lit("DIVISION "), number, F.lit(" – WORK "), "l_partkey")).when(k == 2, F.concat(F.lit("SECTION "), number, F.lit(" – PLACE "), "l_suppkey"))
        .when(k == 3, F.concat(number, F.lit(".0"), tail, F.lit(" GENERAL WORK"))).when(k == 5, F.concat(number, F.lit(".03.0"), tail, F.lit(" Small part "), "l_partkey"))
        .otherwise(F.concat(F.lit("plain words "), "l_partkey", F.lit(", on and on.")))
    )
    return activities(spark, d).select("project_id", F.col("seq").alias("line_no"), F.expr("CAST(seq DIV 3 AS INT)").alias("page"), text.alias("line"))


@query("heading_parts", f"WITH {_LINES_SQL} SELECT project_id, seq AS line_no, level, id, CASE WHEN level IS NOT NULL THEN title END AS title FROM lt")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).withColumn("h", X.heading_parts(F.col("line"))).select("project_id", "line_no", "h.level", "h.id", "h.title")


_BLOCKS_SQL = f"""{_LINES_SQL}, st AS (SELECT *, sum(CASE WHEN level IN ('subsection', 'sub_subsection') THEN 1 ELSE 0 END) OVER w AS block, last_value(CASE level WHEN 'section' THEN 0 WHEN 'subsection' THEN 1 WHEN 'sub_subsection' THEN 1 END IGNORE NULLS) OVER w AS open,
    coalesce(last_value(CASE WHEN level = 'division' THEN title END IGNORE NULLS) OVER w, '') AS division FROM lt WINDOW w AS (PARTITION BY project_id ORDER BY seq)),
    bl AS (SELECT project_id, CAST(block AS BIGINT) AS block, max(CASE WHEN level LIKE 'sub%' THEN id END) AS section_id, max(CASE WHEN level LIKE 'sub%' THEN title END) AS section_title, max(CASE WHEN level LIKE 'sub%' THEN division END) AS division, max(CASE WHEN level LIKE 'sub%' THEN page END) AS page, string_agg(line, chr(10) ORDER BY seq) AS text
      FROM st WHERE open = 1 AND level IS DISTINCT FROM 'division' GROUP BY 1, 2)"""


@query("section_blocks", f"WITH {_BLOCKS_SQL} SELECT * FROM bl")
def _(spark: SparkSession, d: str) -> DataFrame:
    return C.section_blocks(_lines(spark, d), "project_id")


@query("whole_document", "SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return C.whole_document(table(spark, d, "conversations"), "conv_id", "turn")


def _windows_sql(size: int, overlap: int) -> str:
    return rf"""WITH t AS (SELECT doc_id, {_tokens_sql('text')} AS t, {_tokens_sql("source || ' ' || lang")} AS h FROM documents),
    w AS (SELECT doc_id, t, h, {size} - {overlap} - len(h) AS step, unnest(range(0, CASE WHEN len(t) > {size} THEN CAST(ceil((len(t) - {size}) / CAST({size} - {overlap} - len(h) AS DOUBLE)) AS BIGINT) ELSE 0 END + 1)) AS i FROM t WHERE len(t) > 0),
    s AS (SELECT *, CASE WHEN i = 0 THEN 0 ELSE {size} - {overlap} + (i - 1) * step END AS start FROM w)
    SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(start AS INTEGER) AS start, md5(array_to_string(CASE WHEN i = 0 THEN t[1:{size}] ELSE list_concat(h, t[start + 1:start + {size} - len(h)]) END, ' ')) AS digest FROM s"""


def _header_windows(spark: SparkSession, d: str, size: int, overlap: int) -> DataFrame:
    header = X.model_tokens(F.concat("source", F.lit(" "), "lang"))
    out = C.header_windows(table(spark, d, "documents"), ["doc_id"], X.model_tokens(F.col("text")), header, size, overlap)
    return out.select("doc_id", "chunk_index", "start", F.md5(F.array_join("tokens", " ").cast("binary")).alias("digest"))


@query("header_windows_750_100", _windows_sql(750, 100))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _header_windows(spark, d, 750, 100)


@query("header_windows_800_150", _windows_sql(800, 150))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _header_windows(spark, d, 800, 150)


@query("heading_runs", rf"""WITH l AS (SELECT project_id, seq, CASE WHEN seq % 4 = 0 THEN 'Scope Of Work' WHEN seq % 4 = 2 AND l_partkey % 3 = 0 THEN 'See Below' ELSE 'the work ' || l_partkey || ' goes on.' END AS line, seq % 4 = 0 AS head FROM ({_ACT_SQL.removeprefix('act AS (').removesuffix(')')})),
    r AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY project_id ORDER BY seq) AS run FROM l)
    SELECT project_id, CAST(run AS BIGINT) AS run, coalesce(max(CASE WHEN head THEN line END), 'Introduction') AS heading, string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY seq) AS text FROM r GROUP BY 1, 2 HAVING count(*) FILTER (WHERE NOT head) > 0""")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("seq") % 4
    line = F.when(k == 0, "Scope Of Work").when((k == 2) & (F.col("l_partkey") % 3 == 0), "See Below").otherwise(F.concat(F.lit("the work "), "l_partkey", F.lit(" goes on.")))
    return C.heading_runs(activities(spark, d).select("project_id", F.col("seq").alias("line_no"), line.alias("line")), "project_id")


@query("page_at_token", rf"""WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents),
    o AS (SELECT doc_id, line_no, coalesce(sum(len({_tokens_sql('line')})) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, sum(len({_tokens_sql('line')})) OVER (PARTITION BY doc_id) AS total FROM l),
    w AS (SELECT DISTINCT doc_id, unnest(range(0, CAST(total AS BIGINT) + 1, 500)) AS at FROM o)
    SELECT w.doc_id, w.at, CAST(max(o.line_no) // 3 AS VARCHAR) AS page FROM w JOIN o ON o.doc_id = w.doc_id AND o.off <= w.at GROUP BY 1, 2""")
def _(spark: SparkSession, d: str) -> DataFrame:
    each = C.lines(table(spark, d, "documents"), "doc_id").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")
    offsets = C.token_offsets(each, "doc_id", "line_no", "line")
    marks = offsets.groupBy("doc_id", F.col("offset").cast("long").alias("at")).agg(F.expr("max(line_no) DIV 3").cast("string").alias("page"))
    ends = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.size(X.model_tokens(F.col("text"))).cast("long"), F.lit(500).cast("long"))).alias("at"))
    return R.as_of(ends, marks, "doc_id", "at", "page")


@query("document_title", """WITH l AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ['MP ' || p_partkey, 'BUREAU OF WORKS', 'GUIDE TO ' || upper(replace(p_name, '#', '')) || ' AND MORE'] WHEN 1 THEN ['PURPOSE: TO DO SOME WORK', 'plain'] ELSE ['  TESTS OF THE WORK  ', 'x'] END AS a FROM part)
    SELECT p_partkey, coalesce(list_filter(list_transform(a, lambda x: trim(x)), lambda x: regexp_full_match(x, '[A-Z][A-Z\\s,/()&.''-]+') AND len(string_split(x, ' ')) >= 4)[1], 'UNKNOWN MATERIAL PROCEDURE') AS title FROM l""".replace("\\\\s", "\\s"))
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    long = F.array(F.concat(F.lit("MP "), "p_partkey"), F.lit("BUREAU OF WORKS"), F.concat(F.lit("GUIDE TO "), F.upper(F.regexp_replace("p_name", "#", "")), F.lit(" AND MORE")))
    a = F.when(k == 0, long).when(k == 1, F.array(F.lit("PURPOSE: TO DO SOME WORK"), F.lit("plain"))).otherwise(F.array(F.lit("  TESTS OF THE WORK  "), F.lit("x")))
    return table(spark, d, "part").select("p_partkey", X.document_title(a).alias("title"))


@query("footnotes", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN ['1. First ' || p_partkey || ' goes on', '* Star'] WHEN 1 THEN ['Note: only ' || p_size] ELSE [] END AS notes FROM part""")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    a = F.when(k == 0, F.array(F.lit("lost"), F.concat(F.lit("1. First "), "p_partkey"), F.lit(" goes on"), F.lit("* Star"))).when(k == 1, F.array(F.concat(F.lit("Note: only "), "p_size"), F.lit(" "))).otherwise(F.array(F.lit("none")))
    return table(spark, d, "part").select("p_partkey", X.footnotes(a).alias("notes"))


@query("item_tokens", """WITH t AS (SELECT p_partkey, 'see ' || CASE p_partkey % 4 WHEN 0 THEN '105.07.1' WHEN 1 THEN '1105.07.1' WHEN 2 THEN 'item m100.' ELSE 'M1000' END AS text FROM part)
    SELECT p_partkey, p_partkey % 4 = 0 AS dotted, p_partkey % 4 = 2 AS coded FROM t""")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    text = F.concat(F.lit("see "), F.when(k == 0, "105.07.1").when(k == 1, "1105.07.1").when(k == 2, "item m100.").otherwise("M1000"))
    return table(spark, d, "part").select("p_partkey", X.names_item(text, F.lit("105.07.01")).alias("dotted"), X.names_item(text, F.lit("M100")).alias("coded"))


@query("numbered_errors", """SELECT p_partkey, ['a' || p_size, 'b'] AS lines, CASE WHEN p_partkey % 3 = 2 THEN 'expected 3 lines, found 2' END AS error FROM part""")
def _(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("Here:\n1. a"), "p_size", F.lit("\n2. b\nend"))
    r = X.numbered_or_error(text, F.when(F.col("p_partkey") % 3 == 2, 3).otherwise(2))
    return table(spark, d, "part").select("p_partkey", r.alias("r")).select("p_partkey", "r.lines", "r.error")


@query("summary_lines", """SELECT p_partkey, p_brand || CASE WHEN p_partkey % 2 = 0 THEN ' table ' ELSE ' section ' END || p_size || ' ' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END || ' (' || p_type || ')' || CASE WHEN p_partkey % 2 = 0 THEN ' — tabular data.' ELSE '.' END AS summary FROM part""")
def _(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("p_partkey") % 2 == 0, "table").otherwise("text")
    return table(spark, d, "part").select("p_partkey", X.summary_line(kind, F.col("p_brand"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")), F.col("p_type")).alias("summary"))


@query("fact_lines", "SELECT c_custkey, 'Name: ' || c_name || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE chr(10) || 'Segment: ' || c_mktsegment END || chr(10) || 'Nation: ' || c_nationkey AS facts FROM customer")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", X.fact_lines(("Name", F.col("c_name")), ("Segment", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment"))), ("Nation", F.col("c_nationkey"))).alias("facts"))


def _grid() -> tuple:
    return F.array(F.array(F.lit("Name"), F.lit("Size")), F.array(F.col("p_name"), F.col("p_size").cast("string")))


@query("table_chunks", """SELECT p_partkey, 'TABLE ' || p_partkey || chr(10) || chr(10) || '| Name | Size |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_name || ' | ' || p_size || ' |' || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || chr(10) || '1. ' || p_brand ELSE '' END AS content FROM part""")
def _(spark: SparkSession, d: str) -> DataFrame:
    notes = F.when(F.col("p_partkey") % 2 == 0, F.array(F.concat(F.lit("1. "), "p_brand"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "part").select("p_partkey", C.table_chunk(F.concat(F.lit("TABLE "), "p_partkey"), _grid(), notes).alias("content"))


@query("row_chunks", """WITH n AS (SELECT p_brand, p_partkey, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
    SELECT p_brand, CAST(r - 1 AS INTEGER) AS row, 'Key | Name' || chr(10) || p_partkey || ' | ' || p_name AS content FROM n WHERE n + 1 > 5""")
def _(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("a"))
    rows = F.concat(F.array(F.array(F.lit("Key"), F.lit("Name"))), F.transform("a", lambda x: F.array(x["p_partkey"].cast("string"), x["p_name"])))
    return C.row_chunks(g.select("p_brand", rows.alias("rows")), "p_brand", "rows", least=5)


@query("flat_header", "SELECT p_partkey, [p_brand || ' — a', p_brand || ' — b', 'c', 'd'] AS header FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = F.array(F.array(F.col("p_brand"), F.lit(""), F.lit("c"), F.lit("d")), F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit(" ")))
    return table(spark, d, "part").select("p_partkey", C.flat_header(rows).alias("header"))


@query("amendment_blocks", """WITH p AS (SELECT p_partkey, 'The work on ' || p_name || ' is done as the drawings show it, and paid by the piece.' AS body FROM part)
    SELECT p_partkey, CAST(1 AS BIGINT) AS block, '107.11.01' AS section_id, 'Risks' AS section_title, 'replaced' AS change_type, body AS amendment_text FROM p
    UNION ALL SELECT p_partkey, 2, '108.02', 'Start of work', 'amended', body || chr(10) || 'More.' FROM p WHERE p_partkey % 2 = 0""")
def _(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("The work on "), "p_name", F.lit(" is done as the drawings show it, and paid by the piece."))
    second = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("\n108.02 Start of work\n"), body, F.lit("\nMore."))).otherwise("\n108.02 Start of work\ntoo short")
    text = F.concat(F.lit("lost\n107.11.01 Risks\nREPLACE THE FIRST PART:\nBDC25S-03 Page 2 of 5\n"), body, second, F.lit("\nRecommended By: x\nyes and so on, for more than forty characters of text"))
    return C.amendment_blocks(table(spark, d, "part").select("p_partkey", text.alias("text")), "p_partkey")
