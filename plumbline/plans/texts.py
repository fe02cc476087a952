"""Text and chunking queries: documents are pages (source: document), literals stand for headings and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking as C
from ..registry import query, table


def _values(rows: list[str]) -> str:
    return "(VALUES " + ", ".join(f"({i}, '{x.replace(chr(39), chr(39) * 2)}')" for i, x in enumerate(rows)) + ") v(id, text)"


def _frame(spark: SparkSession, rows: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(rows)), "id int, text string")


_STOP = "[" + ", ".join(f"'{w}'" for w in X.QUESTION_WORDS) + "]"
_WORDS = r"list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g')), ' '), lambda w: length(w) > 1 AND NOT list_contains(" + _STOP + ", w))"
_QUESTIONS = ["What is the maximum percentage of RAP allowed?", "section 105", "What is the?", "Which AASHTO standard is required for 421.03?", "HMA compaction and QC", "How is the bridge painted?", "Table 5 of the list"]


@query("clean_query", f"SELECT id, CASE WHEN len({_WORDS}) > 0 THEN array_to_string({_WORDS}, ' ') ELSE text END AS cleaned FROM (SELECT CAST(item_id AS BIGINT) AS id, text FROM benchmark UNION ALL SELECT -1 - id, text FROM {_values(_QUESTIONS)})")
def _(spark: SparkSession, d: str) -> DataFrame:
    more = _frame(spark, _QUESTIONS).select((-1 - F.col("id")).cast("long").alias("id"), "text")
    return table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text").unionAll(more).select("id", X.clean_query(F.col("text")).alias("cleaned"))


def _kind_sql(heavy: str, mixed: str, rest: str) -> str:
    return f"CASE WHEN regexp_matches(text, '{X.SECTION_NUMBER}') OR regexp_matches(text, '{X.KEYWORD_TERMS}') THEN {heavy} WHEN regexp_matches(text, '{X.DOMAIN_TERMS}') THEN {mixed} ELSE {rest} END"


@query("classify_query", f"SELECT id, CAST({_kind_sql('0.3', '0.45', '0.6')} AS DOUBLE) AS vector_weight, CAST({_kind_sql('0.7', '0.55', '0.4')} AS DOUBLE) AS keyword_weight, {_kind_sql(chr(39) + 'keyword-heavy' + chr(39), chr(39) + 'mixed' + chr(39), chr(39) + 'semantic' + chr(39))} AS kind FROM (SELECT CAST(item_id AS BIGINT) AS id, text FROM benchmark UNION ALL SELECT -1 - id, text FROM {_values(_QUESTIONS)})")
def _(spark: SparkSession, d: str) -> DataFrame:
    more = _frame(spark, _QUESTIONS).select((-1 - F.col("id")).cast("long").alias("id"), "text")
    return table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text").unionAll(more).select("id", X.classify_query(F.col("text")).alias("c")).select("id", "c.*")


_HEADINGS = ["105.07.02 Working Drawings for x", "105.07 WORKING DRAWINGS", "7.2 Final Submission", "DIVISION 100 - GENERAL", "SECTION 105 — CONTROL OF WORK", "NJDOT B-10 – Method", "plain text", "105.7 lower", ""]


@query("heading_detect", f"SELECT id, CASE {' '.join(f'WHEN regexp_matches(text, {chr(39)}{p}{chr(39)}) THEN {chr(39)}{k}{chr(39)}' for k, p in X.HEADINGS.items())} END AS level FROM {_values(_HEADINGS)}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _frame(spark, _HEADINGS).select("id", X.heading(F.col("text")).alias("level"))


_CAPTIONS = ["See Table 105.05-1 and TABLE  A, table 5.", "Read the table carefully.", "TABLE 3A then Table 3A", "none"]


@query("caption_extract", f"SELECT id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '{X.CAPTION}'), lambda x: upper(regexp_replace(x, '\\s+', ' ', 'g'))))), '|') AS captions FROM {_values(_CAPTIONS)}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _frame(spark, _CAPTIONS).select("id", F.array_join(X.captions(F.col("text")), "|").alias("captions"))


_CHECKS = ["Verify 105.07 and SECTION 703 per Table 105.05-1.\n\nAlso 999.99.", "Nothing here", "105.07.02, 105.07.02 and TABLE A"]


@query("anchor_extract", f"SELECT id, array_to_string(list_transform(regexp_extract_all(regexp_replace(string_split(text, chr(10) || chr(10))[1], '{X.CAPTION}', ' ; ', 'g'), '{X.SECTION_ANCHOR}'), lambda x: regexp_replace(upper(x), '^SECTION\\s+', '')), '|') AS sections, array_to_string(list_transform(regexp_extract_all(string_split(text, chr(10) || chr(10))[1], '{X.CAPTION}'), lambda x: upper(x)), '|') AS tables FROM {_values(_CHECKS[:2] + ['105.07.02 and TABLE A'])}")
def _(spark: SparkSession, d: str) -> DataFrame:
    found = _frame(spark, [*_CHECKS[:2], "105.07.02 and TABLE A"]).select("id", X.anchors(F.col("text")).alias("a"))
    return found.select("id", F.array_join("a.sections", "|").alias("sections"), F.array_join("a.tables", "|").alias("tables"))


@query("printed_page", "SELECT doc_id, CAST(coalesce(CASE WHEN regexp_matches(last, '^\\d{1,9}$') THEN CAST(last AS INTEGER) END, greatest(1, doc_id - 12)) AS INTEGER) AS page FROM (SELECT doc_id, list_filter(list_transform(string_split(CASE WHEN doc_id % 2 = 0 THEN text || chr(10) || doc_id ELSE text END, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')[-1] AS last FROM documents)")
def _(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("\n"), F.col("doc_id").cast("string"))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", X.printed_page(text, F.col("doc_id"), 12).alias("page"))


_ORDERS = ["The first paragraph is deleted.", "REPLACE it", "The following is added", "Please add this", "is changed to", "as amended", "deleted and replaced"]


@query("change_type", f"SELECT id, CASE WHEN contains(upper(text), 'DELETE') THEN 'deleted' WHEN contains(upper(text), 'REPLACE') THEN 'replaced' WHEN contains(upper(text), 'ADDED') OR contains(upper(text), ' ADD ') THEN 'added' WHEN contains(upper(text), 'CHANGE') THEN 'changed' ELSE 'amended' END AS change_type FROM {_values(_ORDERS)}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _frame(spark, _ORDERS).select("id", X.change_type(F.col("text")).alias("change_type"))


_MONEY_SQL = "CAST(CAST(nullif(replace(regexp_extract(text, '(\\d[\\d,]*(?:\\.\\d+)?)', 1), ',', ''), '') AS DECIMAL(20,4)) * CASE WHEN regexp_matches(text, '(?i)\\d\\s*(?:MM|M|million)\\b') THEN 1000000 ELSE 1 END AS DOUBLE)"
_AMOUNTS = ["$12,500,000.00", "12.5 million", "$50M", "about 3MM", "none", "50,000,000"]


@query("money_parse", f"SELECT id, {_MONEY_SQL} AS amount FROM (SELECT id, text FROM {_values(_AMOUNTS)} UNION ALL SELECT 1000 + o_orderkey, '$' || CAST(o_totalprice AS DECIMAL(18,2)) FROM orders)")
def _(spark: SparkSession, d: str) -> DataFrame:
    more = table(spark, d, "orders").select((F.lit(1000) + F.col("o_orderkey")).alias("id"), F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("text"))
    both = _frame(spark, _AMOUNTS).select(F.col("id").cast("long").alias("id"), "text").unionAll(more)
    return both.select("id", X.money(F.col("text")).cast("double").alias("amount"))


@query("boilerplate_lines", """
    WITH l AS (SELECT DISTINCT source, doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents),
    n AS (SELECT source, count(DISTINCT doc_id) AS pages FROM documents GROUP BY 1)
    SELECT source, line, n_pages FROM (SELECT source, line, count(DISTINCT doc_id) AS n_pages FROM l WHERE line <> '' GROUP BY ALL) JOIN n USING (source) WHERE n_pages >= greatest(2.0, 0.02 * pages)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return C.boilerplate(table(spark, d, "documents"), "source", "doc_id", sample=None, share=0.02)


@query("boilerplate_strip", """
    WITH l AS (SELECT source, doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents),
    n AS (SELECT source, count(DISTINCT doc_id) AS pages FROM documents GROUP BY 1),
    b AS (SELECT source, line FROM (SELECT source, line, count(DISTINCT doc_id) AS n_pages FROM l WHERE line <> '' GROUP BY ALL) JOIN n USING (source) WHERE n_pages >= greatest(2.0, 0.02 * pages))
    SELECT doc_id, count(*) AS n_lines FROM l ANTI JOIN b USING (source, line) GROUP BY doc_id""")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    kept = C.without_boilerplate(docs, C.boilerplate(docs, "source", "doc_id", sample=None, share=0.02), "source", "doc_id")
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_lines"))


_PAGES = ["Activity ID Activity Name Orig Dur\nA1000 x", "plain\ntext", "1/2/24 a\n3/4/2024 b\nc", "A1000 x\nM200 y\nz", ""]
_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')"


@query("gantt_filter", f"""SELECT id, (n > 0 AND (w >= 3 OR dt >= 0.3 * n OR co >= 0.35 * n)) AS is_schedule FROM (SELECT id, len(l) AS n, {' + '.join(f"CAST(contains(lower(array_to_string(l[1:6], ' ')), '{h}') AS INTEGER)" for h in X.SCHEDULE_HEADERS)} AS w,
    len(list_filter(l, lambda x: regexp_matches(x, '{X.PRINTED_DATE}'))) AS dt, len(list_filter(l, lambda x: regexp_matches(x, '{X.ACTIVITY_CODE}'))) AS co FROM (SELECT id, {_LINES} AS l FROM (SELECT CAST(-1 - id AS BIGINT) AS id, text FROM {_values(_PAGES)} UNION ALL SELECT doc_id, text FROM documents)))""")
def _(spark: SparkSession, d: str) -> DataFrame:
    own = _frame(spark, _PAGES).select((-1 - F.col("id")).cast("long").alias("id"), "text")
    both = own.unionAll(table(spark, d, "documents").select("doc_id", "text"))
    return both.select("id", X.is_schedule_page(F.col("text")).alias("is_schedule"))


@query("page_filter", "SELECT doc_id FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, count(*) OVER (PARTITION BY source) AS pages FROM documents) WHERE page > 2 AND page <= pages - 1 AND trim(text, ' ') <> '' AND text <> '[NO TEXT]'")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Pages between front matter (two) and tail (one) of each document, without blank ones."""
    docs = table(spark, d, "documents")
    inner = C.without_ends(docs.select("source", "doc_id", "text"), "source", "doc_id", first=2, last=1)
    return inner.where((F.trim("text") != "") & (F.col("text") != "[NO TEXT]")).select("doc_id")


@query("line_blocks", """
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
    m AS (SELECT *, sum(CASE WHEN length(line) < 60 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM l)
    SELECT doc_id, CAST(block AS BIGINT) AS block, count(*) AS n_lines, CAST(min(line_no) AS INTEGER) AS first FROM m WHERE block > 0 GROUP BY doc_id, block""")
def _(spark: SparkSession, d: str) -> DataFrame:
    found = C.blocks(C.lines(table(spark, d, "documents"), "doc_id"), "doc_id", "line_no", F.char_length("line") < 60)
    return found.select("doc_id", "block", "n_lines", "first")


_MODEL = r"regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')"


def _window_sql(size: int, overlap: int, header: int) -> str:
    step = size - header - overlap
    return f"""WITH t AS (SELECT doc_id, len({_MODEL}) AS n FROM documents), w AS (SELECT doc_id, n, unnest(range(CAST(1 + CASE WHEN n > {size} THEN ceil((n - {size}) / {step}.0) ELSE 0 END AS BIGINT))) AS i FROM t WHERE n > 0)
    SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(s AS INTEGER) AS start, CAST(least(n - s, CASE WHEN i = 0 THEN {size} ELSE {size - header} END) AS INTEGER) AS n_tokens FROM (SELECT *, CASE WHEN i = 0 THEN 0 ELSE {size - overlap} + (i - 1) * {step} END AS s FROM w)"""


for _size, _overlap, _header in ((750, 100, 12), (600, 100, 0), (500, 50, 0), (800, 150, 0)):

    @query(f"token_windows_{_size}_{_overlap}", _window_sql(_size, _overlap, _header))
    def _(spark: SparkSession, d: str, size: int = _size, overlap: int = _overlap, header: int = _header) -> DataFrame:
        found = C.token_windows(table(spark, d, "documents"), "doc_id", X.model_tokens(F.col("text")), size, overlap, header)
        return found.select("doc_id", "chunk_index", "start", "n_tokens")


@query("chunk_stitch", f"SELECT doc_id, len({_MODEL}) AS n_tokens, md5(array_to_string({_MODEL}, ' ')) AS digest FROM documents WHERE len({_MODEL}) > 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 600 tokens, stitched together again: the tokens of the text come back."""
    windows = C.token_windows(table(spark, d, "documents"), "doc_id", X.model_tokens(F.col("text")), 600, 100)
    return C.stitch(windows, "doc_id").select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ").cast("binary")).alias("digest"))


@query("html_blocks", "SELECT page_id, regexp_extract(m, '^<(h1|li|p)>', 1) AS tag, count(*) AS n, CAST(sum(length(regexp_replace(m, '^<[a-z0-9]+>', ''))) AS BIGINT) AS chars FROM (SELECT page_id, unnest(regexp_extract_all(html, '<(?:h1|li|p)>[^<]+')) AS m FROM pages) GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return C.html_blocks(table(spark, d, "pages"), "page_id").groupBy("page_id", "tag").agg(F.count("*").alias("n"), F.sum(F.char_length("body")).alias("chars"))


_TABLES = [(0, [["Item", "Qty"]] + [[f"a{i}", str(i)] for i in range(12)]), (1, [["x", ""], ["Low", "High"], ["1", "2"]]), (2, [["a"] + [""] * 10, ["b"] + [""] * 10]), (3, [["k", "v"], ["1", "2"]])]


@query("table_classify", "SELECT * FROM (VALUES (0, 'lookup'), (1, 'multi_header'), (2, 'wide_sparse'), (3, 'simple')) v(id, kind)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(_TABLES, "id int, grid array<array<string>>").select("id", C.table_kind(F.col("grid")).alias("kind"))


@query("table_to_sentences", "SELECT * FROM (VALUES (0, 'Item: pipe, Qty: 4, Field3: x'), (1, 'Item: sand')) v(id, sentence)")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = [(0, ["Item", "Qty", ""], ["pipe", "4", "x"]), (1, ["Item", "Qty"], ["sand", "N/A", "-"])]
    return spark.createDataFrame(rows, "id int, h array<string>, r array<string>").select("id", C.table_sentences(F.col("h"), F.col("r")).alias("sentence"))


@query("header_fill", "SELECT * FROM (VALUES (0, 'A|A|B|B'), (1, '|x|x')) v(id, header)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(0, ["A", "", "B", ""]), (1, ["", "x", " "])], "id int, h array<string>").select("id", F.array_join(C.filled_header(F.col("h")), "|").alias("header"))


@query("coordinate_parse", "SELECT id, CAST(v AS DOUBLE) AS degrees FROM (VALUES (0, 40.1925), (1, -74.5), (2, -74.74), (3, -10.5)) t(id, v)")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = ["40° 11' 33\" N", "74 30 00 W", "74.74", "-10.5"]
    return _frame(spark, rows).select("id", F.round(X.coordinate(F.col("text")), 6).alias("degrees"))


@query("non_physical_items", f"""SELECT p_partkey, ({' OR '.join(f"contains(lower(name), '{p}')" for p in X.NON_PHYSICAL)}) AS excluded FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_name || ' Field Office' ELSE p_name END AS name FROM part)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 7 == 0, F.concat("p_name", F.lit(" Field Office"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", X.non_physical(name).alias("excluded"))
