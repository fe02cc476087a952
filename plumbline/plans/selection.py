"""Queries of filters, lookups, caps and set operations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import retrieval as R
from ..operators import selection as W
from ..registry import query, table


@query("optional_equal", "SELECT 'label' AS asked, vec_id FROM embeddings WHERE label = 3 UNION ALL SELECT 'none', vec_id FROM embeddings")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    some = [W.optional_equal(e, "label", v).select(F.lit(k).alias("asked"), "vec_id") for k, v in (("label", 3), ("none", None))]
    return some[0].unionAll(some[1])


@query("in_list", "SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents WHERE n_chars > 5000) UNION ALL SELECT doc_id, source FROM documents WHERE lang IN (SELECT lang FROM documents WHERE n_chars < 0)")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    some = W.in_list(docs, "source", docs.where("n_chars > 5000")).select("doc_id", "source")
    return some.unionAll(W.in_list(docs, "lang", docs.where("n_chars < 0")).select("doc_id", "source"))


@query("has_section_metadata", "SELECT source, max(CASE WHEN regexp_matches(text, 'license') THEN true ELSE false END) AS has_field FROM documents GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return W.has_field(table(spark, d, "documents"), "source", F.when(F.col("text").contains("license"), F.lit("license")))


@query("label_contains", "SELECT p_partkey, contains(p_type, 'STEEL') AS exact, contains(lower(p_name), 're') AS folded FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", W.label_has(F.col("p_type"), "STEEL").alias("exact"), W.label_has(F.col("p_name"), "RE", fold=True).alias("folded"))


@query("owned_or_shared", "SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN user_id END AS owner FROM events) WHERE owner = 5 OR owner IS NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("owner"))
    return W.owned_or_shared(own, "owner", 5).select("event_id")


@query("messages_of_owner", "SELECT conv_id, turn FROM conversations m WHERE EXISTS (SELECT 1 FROM (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1) p WHERE p.conv_id = m.conv_id AND p.last = 3)")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    parents = c.groupBy("conv_id").agg(F.max("turn").alias("user_id"))
    return W.of_owned_parents(c, parents, "conv_id", "user_id", 3).select("conv_id", "turn")


@query("under_owner", """WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'docs/u1/' || page_id WHEN 1 THEN '/docs//u1/./x' WHEN 2 THEN 'docs/u1/../u2/x' WHEN 3 THEN 'docs/u2/x' ELSE 'docs/u1' END AS path FROM pages),
    s AS (SELECT page_id, list_filter(string_split(path, '/'), lambda x: x NOT IN ('', '.')) AS a FROM p) SELECT page_id, len(a) > 2 AND a[1] = 'docs' AND a[2] = 'u1' AND NOT list_contains(a, '..') AS ok FROM s""")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id") % 5
    path = F.when(k == 0, F.concat(F.lit("docs/u1/"), "page_id")).when(k == 1, "/docs//u1/./x").when(k == 2, "docs/u1/../u2/x").when(k == 3, "docs/u2/x").otherwise("docs/u1")
    return table(spark, d, "pages").select("page_id", W.under_owner(path, "docs", "u1").alias("ok"))


_PAGED_SQL = "pg AS (SELECT conv_id, turn + 1 AS page, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN text || chr(10) || '1212' WHEN 2 THEN '[NO TEXT]' ELSE text || chr(10) || ' 12 ' END AS text FROM conversations)"


@query("body_pages", rf"""WITH {_PAGED_SQL}, n AS (SELECT *, max(page) OVER (PARTITION BY conv_id) AS last, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[-1] AS fin FROM pg)
    SELECT conv_id, page FROM n WHERE page > 1 AND page <= last - 1 AND trim(text) <> '' AND trim(text) <> '[NO TEXT]' AND NOT (length(fin) >= 4 AND length(fin) % 2 = 0 AND regexp_full_match(fin, '\d+') AND fin[1:length(fin)//2] = fin[length(fin)//2+1:])""")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("turn") % 4
    text = F.when(k == 0, F.col("text")).when(k == 1, F.concat("text", F.lit("\n1212"))).when(k == 2, "[NO TEXT]").otherwise(F.concat("text", F.lit("\n 12 ")))
    pages = table(spark, d, "conversations").select("conv_id", (F.col("turn") + 1).alias("page"), text.alias("text"))
    return W.body_pages(pages, "conv_id", "page", "text", front=1, tail=1).select("conv_id", "page")


_CHECKS_SQL = "ck AS (SELECT 'c' || p_partkey AS check_key, p_brand AS category, p_name AS name, p_size AS sort_order, p_size % 3 <> 0 AS enabled, p_partkey FROM part)"


def _checks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.concat(F.lit("c"), "p_partkey").alias("check_key"), F.col("p_brand").alias("category"), F.col("p_name").alias("name"), F.col("p_size").alias("sort_order"), (F.col("p_size") % 3 != 0).alias("enabled"), "p_partkey")


@query("enabled_checks", f"WITH {_CHECKS_SQL} SELECT check_key, category, name FROM ck WHERE enabled")
def _(spark: SparkSession, d: str) -> DataFrame:
    return W.enabled(_checks(spark, d))


@query("status_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return W.with_status(table(spark, d, "orders"), "o_orderstatus", "F").select("o_orderkey")


@query("eval_set", """SELECT 'ids' AS how, item_id FROM benchmark WHERE item_id IN (3, 1, 7) UNION ALL SELECT 'category', item_id FROM benchmark WHERE item_id % 4 = 2
    UNION ALL SELECT 'first', item_id FROM (SELECT item_id FROM benchmark ORDER BY item_id LIMIT 5)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "benchmark").withColumn("kind", (F.col("item_id") % 4).cast("string"))
    sets = {"ids": W.eval_set(q, ids=[3, 1, 7], category="2", key="item_id", kind="kind"), "category": W.eval_set(q, category="2", key="item_id", kind="kind"), "first": W.eval_set(q, first=5, key="item_id", kind="kind")}
    a, b, c = (df.select(F.lit(k).alias("how"), "item_id") for k, df in sets.items())
    return a.unionAll(b).unionAll(c)


@query("plausible_ranges", """SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) * 100 BETWEEN 10000 AND 5000000000 AS cost_ok, (o_custkey % 80) BETWEEN 30 AND 50 AND (-(o_orderkey % 120)) BETWEEN -85 AND -60 AS point_ok FROM orders""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", W.plausible_cost(F.col("o_totalprice").cast("decimal(18,2)") * 100).alias("cost_ok"), W.plausible_point(F.col("o_custkey") % 80, -(F.col("o_orderkey") % 120)).alias("point_ok"))


@query("simple_counts", "SELECT count(*) AS n, count(*) FILTER (WHERE l_quantity > 45) AS large, EXISTS (SELECT 1 FROM lineitem WHERE l_quantity > 49) AS some, EXISTS (SELECT 1 FROM lineitem WHERE l_quantity > 1000) AS none FROM lineitem")
def _(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    found = lambda c: F.coalesce(F.max(c), F.lit(False))
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"), F.count_if(q > 45).alias("large"), found(q > 49).alias("some"), found(q > 1000).alias("none"))


@query("token_usage", "SELECT role, count(*) AS calls, CAST(sum(length(text)) AS BIGINT) AS prompt, CAST(sum(turn) AS BIGINT) AS answer, CAST(sum(length(text) + turn) AS BIGINT) AS total FROM conversations GROUP BY ROLLUP (role)")
def _(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.reports import usage_totals

    return usage_totals(table(spark, d, "conversations").select("role", F.char_length("text").alias("prompt"), F.col("turn").alias("answer")), "role", ["prompt", "answer"])


@query("stable_ids", "SELECT user_id, count(DISTINCT event_type) <= 1 AS stable, list_sort(list(DISTINCT event_type)) AS ids FROM events WHERE event_id % 20 = 0 GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.reports import stability

    return stability(table(spark, d, "events").where("event_id % 20 = 0"), "user_id", "event_type")


@query("narrative_text", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS narrative, count(*) AS n_lines FROM conversations GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "conversations").select("conv_id", F.concat(F.lit("nsec:"), "turn").alias("id"), F.col("turn").alias("chunk_index"), "text")
    return W.narrative_text(chunks, "conv_id")


@query("mention_links", "SELECT l_orderkey AS entity, l_partkey AS activity, round(l_discount * 10, 4) AS confidence FROM (SELECT DISTINCT l_orderkey, l_partkey, l_discount FROM lineitem) WHERE l_discount * 10 >= 0.7 ORDER BY l_discount * 10 DESC, l_orderkey, l_partkey LIMIT 12")
def _(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entity"), F.col("l_partkey").alias("activity"), (F.col("l_discount") * 10).alias("confidence")).distinct()
    return W.mention_links(links).withColumn("confidence", F.round("confidence", 4))


@query("capped_rows", """WITH f AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem WHERE l_quantity > 30), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS place, count(*) OVER (PARTITION BY l_suppkey) AS n_all FROM f)
    SELECT l_suppkey, l_orderkey, l_extendedprice, place, n_all FROM r WHERE place <= 40""")
def _(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "lineitem").where("l_quantity > 30")
    return W.capped(own, ["l_suppkey"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")], 40).select("l_suppkey", "l_orderkey", "l_extendedprice", "place", "n_all")


@query("overfetch", """SELECT 'before' AS how, o_orderkey FROM (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey LIMIT 8)
    UNION ALL SELECT 'after', o_orderkey FROM (SELECT * FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 32) WHERE o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey LIMIT 8)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    own, order, keep = table(spark, d, "orders"), [F.desc("o_totalprice"), F.asc("o_orderkey")], F.col("o_orderpriority") == "1-URGENT"
    a = W.first_matching(own, order, keep, 8).select(F.lit("before").alias("how"), "o_orderkey")
    return a.unionAll(W.first_matching(own, order, keep, 8, overfetch=4).select(F.lit("after").alias("how"), "o_orderkey"))


@query("chunk_families", "SELECT 'text' AS kind, doc_id AS id, lang, NULL AS url FROM documents UNION ALL SELECT 'table', page_id, NULL, url FROM pages UNION ALL SELECT 'row', item_id, NULL, NULL FROM benchmark")
def _(spark: SparkSession, d: str) -> DataFrame:
    parts = {"text": table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang"), "table": table(spark, d, "pages").select(F.col("page_id").alias("id"), "url"), "row": table(spark, d, "benchmark").select(F.col("item_id").alias("id"))}
    return W.families(parts)


@query("caption_overlap", "SELECT o_orderkey, list_has_any([o_orderstatus, o_orderpriority], ['F', '2-HIGH']) AS shared FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", W.shares_caption(F.array("o_orderstatus", "o_orderpriority"), F.array(F.lit("F"), F.lit("2-HIGH"))).alias("shared"))


_BUS_SQL = "cal AS (SELECT s_suppkey, s_nationkey AS project_id, CASE s_suppkey % 3 WHEN 0 THEN 'Business' WHEN 1 THEN 'BUS days' ELSE 'Other' END AS name, CASE WHEN s_suppkey % 4 = 0 THEN ['Mon', 'Tue'] ELSE ['Fri', 'Mon', 'Tue', 'Wed', 'Thu', 'Mon'] END AS wd, s_suppkey % 5 = 0 AS lost FROM supplier)"


@query("business_calendar", f"""WITH {_BUS_SQL} SELECT project_id, arg_min(CAST(s_suppkey AS VARCHAR), (name, CAST(s_suppkey AS VARCHAR))) AS calendar_id FROM cal WHERE contains(lower(name), 'bus') AND list_sort(list_distinct(wd)) = ['Fri', 'Mon', 'Thu', 'Tue', 'Wed'] AND NOT lost GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    words = lambda s: F.array(*map(F.lit, s.split()))
    name = F.when(k % 3 == 0, "Business").when(k % 3 == 1, "BUS days").otherwise("Other")
    days = F.when(k % 4 == 0, words("Mon Tue")).otherwise(words("Fri Mon Tue Wed Thu Mon"))
    cal = table(spark, d, "supplier").select(F.col("s_nationkey").alias("project_id"), k.cast("string").alias("calendar_id"), name.alias("name"), days.alias("work_days"), F.when(k % 5 != 0, F.array().cast("array<date>")).alias("exceptions"))
    return W.business_calendars(cal).select("project_id", "calendar_id")


@query("builtin_override", f"""WITH {_CHECKS_SQL}, b AS (SELECT check_key, 'rule' AS check_type, CASE WHEN p_partkey % 4 = 0 THEN -1 ELSE p_partkey % 9 END AS k FROM ck WHERE p_partkey % 2 = 0)
    SELECT ck.check_key, coalesce(b.check_type, 'llm') AS check_type, CASE WHEN coalesce(b.k, sort_order) > 0 THEN coalesce(b.k, sort_order) ELSE 8 END AS sp_top_k FROM ck LEFT JOIN b USING (check_key)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.reports import with_builtins

    asked = _checks(spark, d)
    catalog = asked.where("p_partkey % 2 = 0").select("check_key", F.lit("rule").alias("check_type"), F.when(F.col("p_partkey") % 4 == 0, -1).otherwise(F.col("p_partkey") % 9).alias("sp_top_k"))
    sent = asked.select("check_key", F.lit("llm").alias("check_type"), F.col("sort_order").alias("sp_top_k"))
    return with_builtins(sent, catalog).select("check_key", "check_type", F.col("sp_top_k").cast("long").alias("sp_top_k"))


@query("unwound_ids", """WITH c AS (SELECT o_custkey AS project_id, list(o_orderkey ORDER BY o_orderkey) AS ids FROM (SELECT o_custkey, o_orderkey FROM orders UNION ALL SELECT o_custkey, -o_orderkey FROM orders WHERE o_orderkey % 5 = 0) GROUP BY 1)
    SELECT project_id, pos - 1 AS pos, ids[pos] AS task_id, o_orderstatus AS status FROM (SELECT project_id, ids, unnest(range(1, len(ids) + 1)) AS pos FROM c) LEFT JOIN orders ON o_orderkey = ids[pos]""")
def _(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.network import chain_facts

    o = table(spark, d, "orders")
    ids = o.select("o_custkey", "o_orderkey").unionAll(o.where("o_orderkey % 5 = 0").select("o_custkey", -F.col("o_orderkey")))
    chains = ids.groupBy(F.col("o_custkey").alias("project_id")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids")).select("project_id", F.posexplode("ids").alias("pos", "task_id"))
    return chain_facts(chains, o.select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("task_id"), F.col("o_orderstatus").alias("status")))


@query("asof_division", """WITH st AS (SELECT user_id, event_id AS page, CAST(event_id % 9 AS VARCHAR) AS division FROM events WHERE event_type = 'purchase'), tb AS (SELECT user_id, event_id AS page FROM events WHERE event_type = 'click')
    SELECT tb.user_id, tb.page, coalesce((SELECT arg_max(division, st.page) FROM st WHERE st.user_id = tb.user_id AND st.page <= tb.page), '') AS division FROM tb""")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    starts = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("page"), (F.col("event_id") % 9).cast("string").alias("division"))
    return R.as_of(e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("page")), starts, "user_id", "page", "division")


@query("json_path_text", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none') IS NOT NULL AS has_none FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.text import json_text

    return table(spark, d, "events").select("event_id", json_text(F.col("props"), "k").alias("k"), json_text(F.col("props"), "none").isNotNull().alias("has_none"))


@query("lenient_json", """WITH r AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"answer": "a' || event_id || '", "confidence": 0.5}' WHEN 1 THEN 'text ' || event_id ELSE '```json' || chr(10) || '{"answer": "b"}' || chr(10) || '```' END AS raw FROM events)
    SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'a' || event_id WHEN 1 THEN raw ELSE 'b' END AS answer, event_id % 3 <> 1 AS parsed FROM r""")
def _(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.text import lenient_answer

    k = F.col("event_id") % 3
    raw = F.when(k == 0, F.format_string('{"answer": "a%d", "confidence": 0.5}', "event_id")).when(k == 1, F.format_string("text %d", "event_id")).otherwise('```json\n{"answer": "b"}\n```')
    return table(spark, d, "events").select("event_id", lenient_answer(raw).alias("r")).select("event_id", "r.answer", "r.parsed")


@query("overlay", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS extra FROM customer")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return W.overlay(c.select("c_custkey", F.col("c_mktsegment").alias("segment")), c.where("c_custkey % 3 = 0").select("c_custkey", F.lit("new").alias("segment"), F.col("c_nationkey").alias("extra")), "c_custkey")


@query("flat_activities", """WITH r AS (SELECT l_orderkey AS project_id, l_partkey AS task_id, l_linenumber AS pos, CAST(l_shipdate AS DATE) AS start, CASE WHEN l_suppkey % 2 = 0 THEN CAST(l_shipdate AS DATE) + 5 END AS computed, l_extendedprice FROM lineitem),
    u AS (SELECT project_id, task_id, coalesce(computed, start) AS start, row_number() OVER (PARTITION BY project_id, task_id ORDER BY pos, start, computed, l_extendedprice) AS r, pos FROM r)
    SELECT project_id, task_id, start FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY pos, task_id) AS p FROM u WHERE r = 1) WHERE p <= 25""")
def _(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("l_shipdate").cast("date")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("project_id"), F.col("l_partkey").alias("task_id"), F.col("l_linenumber").alias("pos"), day.alias("start"), F.when(F.col("l_suppkey") % 2 == 0, F.date_add(day, 5)).alias("computed_start"), "l_extendedprice")
    return G.flat_activities(rows, ["pos", "start", "computed_start", "l_extendedprice"]).select("project_id", "task_id", "start")


@query("paged_read", "SELECT doc_id, row_number() OVER (ORDER BY coalesce(CASE WHEN doc_id % 6 <> 0 THEN n_chars END, 0), doc_id) - 1 AS pos FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.chunks import ordered_chunks

    return ordered_chunks(table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 6 != 0, F.col("n_chars")).alias("chunk_index")), "chunk_index", "doc_id").select("doc_id", "pos")
