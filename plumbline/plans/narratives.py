"""Entities and mentions: narratives made of line items, and names of benchmark passages in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import entities as E
from ..registry import query, table
from .schedule import _ACT_SQL, activities

# Every line item is a section of its order's narrative.
_SAID_SQL = """said AS (SELECT project_id, seq, project_id || '/' || seq AS section_id, 'Stage ' || seq || ' has A' || (100 + l_partkey) || ' and B' || (10 + seq) || '.'
    || CASE l_suppkey % 5 WHEN 0 THEN ' The permit of ' || start || ' covers AB' || (1000 + l_suppkey) || '!' WHEN 1 THEN ' Work ends on ' || start || ' or ' || (start + 7) || '.' WHEN 2 THEN ' Gas is cut by 2024-02-31. Traffic keeps moving.' WHEN 3 THEN ' No noise at night? Crews will rest.' ELSE ' Nothing more' END AS text FROM act)"""
_KIND = "CASE WHEN regexp_matches(s, '(?i)\\b(permit|approval)\\b') THEN 'Permit' WHEN regexp_matches(s, '(?i)\\b(gas|water|electric)\\b') THEN 'UtilityWork' WHEN regexp_matches(s, '(?i)\\b(no|not|only)\\b') THEN 'Restriction' WHEN regexp_matches(s, '(?i)\\b(stage|phase)\\b') THEN 'PhaseMention' WHEN regexp_matches(s, '(?i)\\b(shall|will)\\b') THEN 'Commitment' WHEN regexp_matches(s, '\\d{4}-\\d\\d-\\d\\d') THEN 'Deadline' END"
_FOUND_SQL = f"""{_ACT_SQL}, {_SAID_SQL}, s AS (SELECT project_id, seq, section_id, unnest(list_filter([trim(x) FOR x IN regexp_split_to_array(text, '[.!?](\\s+|$)')], lambda x: x <> '')) AS s, unnest(range(1, 99)) AS k FROM said),
    ent AS (SELECT project_id, seq, section_id, k, s, {_KIND} AS kind FROM s WHERE s IS NOT NULL), ids AS (SELECT *, 'nar:' || (row_number() OVER (PARTITION BY project_id ORDER BY seq, k) - 1) AS entity, FROM ent WHERE kind IS NOT NULL)"""


def _said(spark: SparkSession, d: str) -> DataFrame:
    act = activities(spark, d)
    day, k = F.col("start").cast("string"), F.col("l_suppkey") % 5
    more = F.when(k == 0, F.concat(F.lit(" The permit of "), day, F.lit(" covers AB"), 1000 + F.col("l_suppkey"), F.lit("!"))).when(k == 1, F.concat(F.lit(" Work ends on "), day, F.lit(" or "), F.date_add("start", 7).cast("string"), F.lit(".")))
    more = more.when(k == 2, " Gas is cut by 2024-02-31. Traffic keeps moving.").when(k == 3, " No noise at night? Crews will rest.").otherwise(" Nothing more")
    text = F.concat(F.lit("Stage "), "seq", F.lit(" has A"), 100 + F.col("l_partkey"), F.lit(" and B"), 10 + F.col("seq"), F.lit("."), more)
    return act.select("project_id", "seq", F.concat_ws("/", F.col("project_id").cast("string"), F.col("seq").cast("string")).alias("section_id"), F.lit("Narrative").alias("heading"), F.lit(1).alias("page"), text.alias("text"))


@query("narrative_entities", f"""WITH {_FOUND_SQL} SELECT project_id, entity, kind AS entity_type, s AS text, section_id, list_filter(regexp_extract_all(s, '\\d{{4}}-\\d\\d-\\d\\d'), lambda x: TRY_CAST(x AS DATE) IS NOT NULL) AS dates, regexp_extract_all(s, '\\b[A-Z]{{1,3}}\\d{{2,6}}\\b') AS activity_ids FROM ids""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return E.entities(E.extracted(_said(spark, d))).select("project_id", "entity", "entity_type", "text", "section_id", "dates", "activity_ids")


@query("narrative_relations", f"""WITH {_FOUND_SQL} SELECT * FROM (SELECT project_id, entity AS source, lead(entity) OVER (PARTITION BY project_id, seq ORDER BY k) AS target, 'then' AS label FROM ids) WHERE target IS NOT NULL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return E.relations(E.extracted(_said(spark, d)))


# Names: the first, the middle and the last words of all benchmark passages, as many as the item's number asks for.
_NAMES_SQL = """b AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark), nm AS (SELECT item_id * 3 + p AS name_id, array_to_string(CASE p WHEN 0 THEN w[1:CAST(2 + item_id % 3 AS INTEGER)] WHEN 1 THEN w[CAST(5 + item_id % 4 AS INTEGER):CAST(7 + item_id % 4 AS INTEGER)] ELSE w[-2:] END, ' ') AS name FROM b, range(3) t(p)),
    t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents), c AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS line FROM t)"""


def _names(spark: SparkSession, d: str) -> DataFrame:
    w, k = E.name_words(F.col("text")), F.col("item_id")
    own = table(spark, d, "benchmark").select("item_id", w.alias("w"))
    middle = F.slice("w", (5 + k % 4).cast("int"), 3)
    parts = F.array(F.slice("w", 1, (2 + k % 3).cast("int")), middle, F.slice("w", -2, 2))
    rows = own.select("item_id", F.posexplode(parts).alias("p", "part"))
    return rows.select((k * 3 + F.col("p")).alias("name_id"), F.array_join("part", ", ").alias("name"))


_MENTION_SQL = f"""WITH {_NAMES_SQL}, h AS (SELECT doc_id, name_id, w, string_split(name, ' ') AS parts FROM c JOIN nm ON name <> '' AND contains(line, ' ' || name || ' ')),
    p AS (SELECT doc_id, name_id, list_filter(range(len(w)), lambda i: w[i + 1:i + len(parts)] = parts) AS hits FROM h) SELECT doc_id, name_id, len(hits) AS n, CAST(hits[1] AS INTEGER) AS first FROM p"""


@query("entity_mentions", _MENTION_SQL)
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return E.mentions(docs, _names(spark, d)).withColumnRenamed("id", "doc_id")


@query("entity_mentions_rarest", _MENTION_SQL)
def _(spark: SparkSession, d: str) -> DataFrame:
    """The same beyond the bound: no broadcast of names."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return E.mentions(docs, _names(spark, d), most_bytes=0).withColumnRenamed("id", "doc_id")
