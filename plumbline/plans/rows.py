"""Text expressions over texts that differ from row to row, with SQL that parses them for itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as X
from ..operators import retrieval as R
from ..operators import rules as U
from ..registry import query, table

_A = "CAST(100 + doc_id % 20 AS VARCHAR) || '.' || lpad(CAST(doc_id % 7 AS VARCHAR), 2, '0')"
_B = "CAST(100 + doc_id * 3 % 20 AS VARCHAR) || '.' || lpad(CAST(doc_id * 5 % 7 AS VARCHAR), 2, '0')"
_NAMED_SQL = f"""n AS (SELECT doc_id, left(replace(text, chr(10), ' '), 30) || ' see ' || {_A} || ', ' || {_B} || '; ' || {_A} || ' and Table ' || {_B} || '-' || (doc_id % 3) || ', TABLE  ' || {_A} || ', table ' || {_B} || '-' || (doc_id % 3) || ' under Section ' || (100 + doc_id % 50) || chr(10) || chr(10) || '999.99' AS text FROM documents)"""


def _named(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    number = lambda a, b: F.concat((F.lit(100) + a % 20).cast("string"), F.lit("."), F.lpad((b % 7).cast("string"), 2, "0"))
    a, b, k = number(i, i), number(i * 3, i * 5), (i % 3).cast("string")
    parts = [F.left(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(30)), " see ", a, ", ", b, "; ", a, " and Table ", b, "-", k, ", TABLE  ", a, ", table ", b, "-", k, " under Section ", (i % 50 + 100).cast("string"), "\n\n999.99"]
    return table(spark, d, "documents").select("doc_id", F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts]).alias("text"))


_FIRST = "string_split(text, chr(10) || chr(10))[1]"
_ONCE = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


@query("anchors_of_rows", f"""WITH {_NAMED_SQL}, x AS (SELECT doc_id, list_transform(regexp_extract_all(regexp_replace({_FIRST}, '{X.CAPTION}', ' ; ', 'g'), '{X.SECTION_ANCHOR}'), lambda x: regexp_replace(upper(x), '^SECTION\\s+', '')) AS s,
      list_transform(regexp_extract_all({_FIRST}, '{X.CAPTION}'), lambda x: regexp_replace(upper(x), '\\s+', ' ', 'g')) AS t FROM n)
    SELECT doc_id, array_to_string({_ONCE.format('s')}, '|') AS sections, array_to_string({_ONCE.format('t')}, '|') AS tables FROM x""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Sections and tables that a first paragraph names, each once, in the order of their first mention."""
    a = X.anchors(F.col("text"))
    return _named(spark, d).select("doc_id", F.array_join(a["sections"], "|").alias("sections"), F.array_join(a["tables"], "|").alias("tables"))


@query("captions_of_rows", f"WITH {_NAMED_SQL} SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '{X.CAPTION}'), lambda x: regexp_replace(upper(x), '\\s+', ' ', 'g')))), '|') AS captions FROM n")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).select("doc_id", F.array_join(X.captions(F.col("text")), "|").alias("captions"))


_CHANGES = ["is deleted", "REPLACE it", "is added to", "to add this", "is changed to", "as amended", "Deleted and replaced"]


@query("change_of_rows", f"SELECT doc_id, CASE WHEN contains(u, 'DELETE') THEN 'deleted' WHEN contains(u, 'REPLACE') THEN 'replaced' WHEN contains(u, 'ADDED') OR contains(u, ' ADD ') THEN 'added' WHEN contains(u, 'CHANGE') THEN 'changed' ELSE 'amended' END AS change FROM (SELECT doc_id, upper(left(text, 40) || ' ' || {_CHANGES!r}[CAST(n_chars % 7 AS INTEGER) + 1] || ' ' || substr(text, 41, 400)) AS u FROM documents)")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Instructions inside running text."""
    change = F.get(F.array(*map(F.lit, _CHANGES)), (F.col("n_chars") % 7).cast("int"))
    text = F.concat(F.left("text", F.lit(40)), F.lit(" "), change, F.lit(" "), F.substr("text", F.lit(41), F.lit(400)))
    return table(spark, d, "documents").select("doc_id", X.change_type(text).alias("change"))


@query("long_dates_of_rows", """SELECT o_orderkey, CAST(coalesce(try_strptime(t, '%B %d, %Y'), try_strptime(t, '%d %B %Y'), try_strptime(t, '%m/%d/%Y'), try_strptime(t, '%Y-%m-%d')) AS DATE) AS day FROM (SELECT o_orderkey, trim(CASE o_custkey % 6
      WHEN 0 THEN strftime(o_orderdate, ' %B %-d, %Y') WHEN 1 THEN strftime(o_orderdate, '%-d %B %Y') WHEN 2 THEN strftime(o_orderdate, '%-m/%-d/%Y ') WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 4 THEN strftime(o_orderdate, '%Y in %B') END) AS t FROM orders)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Dates of orders as people write them, in four ways, and two that are none."""
    k, day = F.col("o_custkey") % 6, F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(day, " MMMM d, yyyy")).when(k == 1, F.date_format(day, "d MMMM yyyy")).when(k == 2, F.concat(F.date_format(day, "M/d/yyyy"), F.lit(" "))).when(k == 3, F.date_format(day, "yyyy-MM-dd")).when(k == 4, F.date_format(day, "yyyy 'in' MMMM"))
    return table(spark, d, "orders").select("o_orderkey", D.long_date(text).alias("day"))


_EVIDENCE = "'Item A' || l_partkey || ', M' || l_suppkey || '0 and ' || (l_partkey % 300 + 100) || '.0' || (l_suppkey % 9) || '.'"


@query("items_of_rows", f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_EVIDENCE} AS e, ['A' || l_partkey, 'M' || l_suppkey, (l_partkey % 300 + 100) || '.0' || (l_suppkey % 9), 'A' || (l_partkey // 10)] AS found, ['A' || l_partkey, 'B' || l_suppkey] AS expected FROM lineitem),
    y AS (SELECT *, list_transform(regexp_extract_all(lower(e), '[a-z]?[0-9]+(?:\\.[0-9]+)?'), lambda t: t) AS tokens FROM x)
    SELECT l_orderkey, l_linenumber, count(*) AS n, sum(len(list_filter(expected, lambda i: NOT list_contains(found, i)))) AS orphaned, sum(len(list_filter(found, lambda i: NOT list_contains(tokens, lower(i))))) AS invented FROM y GROUP BY 1, 2""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Items against the evidence of their own row: expected ones that weren't found, found ones that nobody wrote."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    text = lambda *xs: F.concat(*[x.cast("string") if not isinstance(x, str) else F.lit(x) for x in xs])
    number = text(p % 300 + 100, ".0", s % 9)
    evidence = text("Item A", p, ", M", s, "0 and ", number, ".")
    found = F.array(text("A", p), text("M", s), number, text("A", F.floor(p / 10)))
    own = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", U.validate_items(found, F.array(text("A", p), text("B", s)), evidence).alias("v"))
    return own.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.sum(F.size("v.orphaned")).alias("orphaned"), F.sum(F.size("v.invented")).alias("invented"))


@query("references_of_rows", f"""WITH {_NAMED_SQL}, r AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b\\d{{3}}\\.\\d{{2}}\\b')) AS ref, unnest(range(len(regexp_extract_all(text, '\\b\\d{{3}}\\.\\d{{2}}\\b')))) AS p FROM n)
    SELECT ref, count(*) AS n FROM r WHERE ref NOT IN ('999.99', '107.00') GROUP BY ref ORDER BY n DESC, min(doc_id * 1000 + p) LIMIT 5""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The section numbers that all texts name most often, without those that are known."""
    return R.top_references(_named(spark, d), ["999.99", "107.00"], 5, order="doc_id")
