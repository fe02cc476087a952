"""Tables on pages: the words of web pages, set in lines, some of them in columns, with captions above and notes below."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import FOOTNOTE
from ..operators import geometry as G
from ..registry import query, table

# Word i of a page stands on line i // 5; of seven lines, three are columns, the one before may be a caption, the one after a note.
_WORDS_SQL = """w0 AS (SELECT page_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM (SELECT page_id, list_filter(string_split_regex(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+'), lambda x: x <> '') AS w FROM pages)),
    w1 AS (SELECT page_id, i // 5 AS ln, i % 5 AS col, word, i // 250 AS page, 40.0::DOUBLE + 14 * (i // 5 % 50) AS base FROM w0),
    w2 AS (SELECT page_id, page, ln, col, base, CASE WHEN ln % 7 = 2 AND page_id % 4 <> 3 AND col = 0 THEN 'Table' WHEN ln % 7 = 2 AND page_id % 4 <> 3 AND col = 1 THEN ln || '.' || (page_id % 10)
      WHEN ln % 7 = 6 AND page_id % 2 = 0 AND col = 0 THEN '1.' ELSE word END AS word, ln % 7 IN (3, 4, 5) AS wide FROM w1)"""


def _words(spark: SparkSession, d: str) -> DataFrame:
    found = F.filter(F.split(F.regexp_replace("html", "<[^>]*>", " "), r"[ \t\n\r]+"), lambda x: x != "")
    own = table(spark, d, "pages").select("page_id", F.posexplode(found).alias("i", "word"))
    ln, col, pid = F.floor(F.col("i") / 5), F.col("i") % 5, F.col("page_id")
    caption = (ln % 7 == 2) & (pid % 4 != 3)
    text = F.when(caption & (col == 0), "Table").when(caption & (col == 1), F.concat(ln.cast("string"), F.lit("."), (pid % 10).cast("string"))).when((ln % 7 == 6) & (pid % 2 == 0) & (col == 0), "1.").otherwise(F.col("word"))
    x0 = 50.0 + col * F.when((ln % 7).isin(3, 4, 5), 100).otherwise(45)
    top = 40.0 + 14 * (ln % 50) + (col % 2)
    return own.select(pid.alias("doc"), F.floor(F.col("i") / 250).alias("page"), x0.alias("x0"), (x0 + 40).alias("x1"), top.alias("top"), (top + 10).alias("bottom"), text.alias("text"))


_LINES_SQL = f"""WITH {_WORDS_SQL}, l AS (SELECT page_id, page, ln, base AS top, any_value(wide) AS wide, CASE WHEN any_value(wide) THEN count(*) ELSE 1 END AS n, base + CASE WHEN count(*) > 1 THEN 11 ELSE 10 END AS bottom,
      string_agg(word, ' ' ORDER BY col) AS text, 50.0::DOUBLE + (count(*) - 1) * CASE WHEN any_value(wide) THEN 100 ELSE 45 END + 40 AS x1, list(word ORDER BY col) AS ws FROM w2 GROUP BY page_id, page, ln, base)"""
_TABLES_SQL = f"""{_LINES_SQL}, r AS (SELECT *, sum(CASE WHEN b IS NULL OR b <> n THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, page ORDER BY ln) AS run FROM (SELECT *, lag(n) OVER (PARTITION BY page_id, page ORDER BY ln) AS b FROM l)),
    t AS (SELECT *, row_number() OVER (PARTITION BY page_id, page ORDER BY run) AS idx FROM (SELECT page_id, page, run, min(top) AS top, max(bottom) AS bottom, max(x1) AS x1, count(*) AS n_rows, max(n) AS n_cells, md5(string_agg(array_to_string(ws, '|'), chr(10) ORDER BY ln)) AS body FROM r WHERE n >= 2 GROUP BY 1, 2, 3 HAVING count(*) >= 2))"""


@query("page_lines", f"{_LINES_SQL} SELECT page_id AS doc, page, row_number() OVER (PARTITION BY page_id, page ORDER BY ln) AS line, top, bottom, x1, n AS n_cells, text FROM l")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Words in their lines and cells."""
    return G.lines(_words(spark, d)).select("doc", "page", F.col("line").cast("long").alias("line"), "top", "bottom", "x1", F.size("cells").cast("long").alias("n_cells"), "text")


_FOOT = FOOTNOTE.replace("'", "''")


@query("page_tables", f"""{_TABLES_SQL}, c AS (SELECT t.page_id, t.page, t.idx, arg_max(l.text, l.top) AS text FROM t JOIN l ON l.page_id = t.page_id AND l.page = t.page AND l.top < t.top AND l.top >= t.top - 60 AND regexp_matches(l.text, '{G.CAPTION_LINE}') GROUP BY 1, 2, 3),
    nx AS (SELECT *, lead(top) OVER (PARTITION BY page_id, page ORDER BY idx) AS next FROM t),
    f AS (SELECT nx.page_id, nx.page, nx.idx, l.ln, l.text, regexp_matches(l.text, '{_FOOT}') AS begins FROM nx JOIN l ON l.page_id = nx.page_id AND l.page = nx.page AND l.top >= nx.bottom AND l.top < nx.bottom + 80 AND (next IS NULL OR l.top < next)),
    g AS (SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, page, idx ORDER BY ln) AS k FROM f),
    n AS (SELECT page_id, page, idx, string_agg(note, chr(10) ORDER BY k) AS notes, count(*) AS n_notes FROM (SELECT page_id, page, idx, k, string_agg(trim(text), ' ' ORDER BY ln) AS note FROM g WHERE k > 0 GROUP BY ALL) GROUP BY 1, 2, 3)
    SELECT t.page_id AS doc, t.page, CAST(t.idx AS INTEGER) AS idx, t.top, t.bottom, t.x1, t.n_rows, t.n_cells, body, CASE WHEN c.text IS NULL THEN 'p' || t.page || '_t' || t.idx ELSE regexp_extract(c.text, '{G.CAPTION_LINE}', 1) END AS table_id, coalesce(trim(regexp_extract(c.text, '{G.CAPTION_LINE}', 2)), '') AS title,
      coalesce(notes, '') AS notes, coalesce(n_notes, 0) AS n_notes FROM t LEFT JOIN c USING (page_id, page, idx) LEFT JOIN n USING (page_id, page, idx)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Tables with their captions (nearest line within 60 points) and footnotes (within 80)."""
    found = G.lines(_words(spark, d))
    out = G.with_footnotes(G.with_captions(G.find_tables(found), found), found)
    body = F.md5(F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "\n").cast("binary"))
    return out.select("doc", "page", "idx", "top", "bottom", "x1", "n_rows", "n_cells", body.alias("body"), "table_id", "title", F.array_join("notes", "\n").alias("notes"), F.size("notes").cast("long").alias("n_notes"))
