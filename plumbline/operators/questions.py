"""Many questions at once: variants, both legs, fusion, references, amendments, context and checked citations as keyed frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions.vectors import nearest
from ..session import written
from . import fulltext as T

# References in a text, how many are followed, and how many chunks each may add.
REFERENCE = r"\b(\d{3}\.\d{2}(?:\.\d{2})?)\b"
MOST_REFERENCES, PER_REFERENCE = 3, 2
CONSTANT = 60


def vector_legs(vectors: DataFrame, probes: DataFrame, k: int, *, floor: float = 0.0, few: int = 4096) -> DataFrame:
    """(query_id, variant_no, id, rank): the k rows of vectors (id, embedding) most alike each probe (query_id, variant_no, probe), above the floor.

    Blocks of vectors meet blocks of probes as products of matrices, see vectors.nearest(); few probes (counted) are broadcast.
    """
    rows = vectors.select("id", F.col("embedding").alias("_e"))
    scored = nearest(rows, probes.select("query_id", "variant_no", "probe"), k, floor=floor, most=few).withColumnRenamed("similarity", "s")
    rank = F.row_number().over(Window.partitionBy("query_id", "variant_no").orderBy(F.desc(F.round("s", 9)), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "variant_no", "id", "rank")


def best_of_sections(scored: DataFrame, sections: DataFrame, keys: list[str], first: list[str], k: int) -> DataFrame:
    """The k best rows (keys, id, score, first...) of each key, one for each section; rows without one stand for themselves. Adds section and rank."""
    own = scored.join(sections, "id", "left")
    order = [F.desc(F.round("score", 9)), *first, "id"]
    group = F.coalesce(F.nullif("section", F.lit("")), F.col("id").cast("string"))
    own = own.withColumn("_g", group).withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_g").orderBy(*order))).where("_r = 1")
    return own.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k).drop("_g", "_r")


def asked_terms(variants: DataFrame) -> DataFrame:
    """What the variants' keyword legs ask for, as search_terms() gives it, by the struct (query_id, variant_no)."""
    return T.search_terms(variants.select(F.struct("query_id", "variant_no").alias("query_id"), X.clean_query(F.col("variant")).alias("query")))


def retrieve(variants: DataFrame, index: DataFrame, vectors: DataFrame, probes: DataFrame, sections: DataFrame, k: int) -> DataFrame:
    """(query_id, id, section, rank, score, n_variants): the k best chunks of each question, one for each section.

    variants: (query_id, variant_no, variant); index: as fulltext.positions(), with the lexemes of asked_terms() at least; vectors and probes: as vector_legs();
    sections: (id, section). Each variant fuses its legs, max(5 k, 20) rows deep, with the weights that its kind asks for; the variants'
    lists are fused again with equal weights, so chunks that several of them find come first.
    """
    pool, keys = max(5 * k, 20), ["query_id", "variant_no"]
    kinds = variants.select(*keys, X.classify_query(F.col("variant")).alias("c"))
    near = vector_legs(vectors, probes, pool).join(kinds.select(*keys, F.col("c.vector_weight").alias("w")), keys).withColumn("leg", F.lit(0))
    found = T.search(index, asked_terms(variants), pool).select("query_id.*", "id", "rank")
    words = found.join(kinds.select(*keys, F.col("c.keyword_weight").alias("w")), keys).withColumn("leg", F.lit(1))
    both = near.unionByName(words).groupBy(*keys, "id").agg(F.sum(F.col("w") / (CONSTANT + F.col("rank"))).alias("score"), F.min(F.struct("leg", "rank")).alias("first"))
    lists = best_of_sections(both, sections, keys, ["first"], k)
    merged = lists.groupBy("query_id", "id").agg(F.sum(1.0 / (CONSTANT + F.col("rank"))).alias("score"), F.min(F.struct("variant_no", "rank")).alias("first"), F.count("*").alias("n_variants"))
    return best_of_sections(merged, sections, ["query_id"], ["first"], k).select("query_id", "id", "section", "rank", "score", "n_variants")


def follow_references(found: DataFrame, index: DataFrame | None, chunks: DataFrame, *, most: int = MOST_REFERENCES, each: int = PER_REFERENCE) -> DataFrame:
    """(query_id, ref, id, section, place): chunks of the sections that the found ones (query_id, id, section, rank) name most often.

    chunks: (id, section, text). References to sections that are there already aren't followed; of the others the most frequent,
    then the first named, are searched by keyword, and each section is added once. Without an index the chunks' texts are read for
    what is asked. What is found should be a table, as it is read several times.
    """
    texts = found.select("query_id", "id", "rank").join(chunks.select("id", "text"), "id")
    named = texts.select("query_id", "rank", F.posexplode(F.regexp_extract_all("text", F.lit(REFERENCE), F.lit(1))).alias("p", "ref"))
    there = found.select("query_id", F.col("section").alias("ref")).where("ref IS NOT NULL").distinct()
    counts = named.groupBy("query_id", "ref").agg(F.count("*").alias("n"), F.min(F.struct("rank", "p")).alias("first")).join(there, ["query_id", "ref"], "left_anti")
    top = written(counts.withColumn("ref_no", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "first"))).where(F.col("ref_no") <= most), "references")
    asked = top.select("ref").distinct().select(F.col("ref").alias("query_id"), F.col("ref").alias("query"))
    terms = T.search_terms(asked)
    hits = T.search(T.positions(chunks, id_col="id", asked=terms) if index is None else index, terms, each).select(F.col("query_id").alias("ref"), "id", F.col("rank").alias("hit"))
    added = top.select("query_id", "ref", "ref_no").join(hits, "ref").join(chunks.select("id", "section"), "id")
    key = F.coalesce(F.nullif("section", F.lit("")), F.col("id").cast("string"))
    added = added.withColumn("_g", key).join(there.withColumnRenamed("ref", "_g"), ["query_id", "_g"], "left_anti")
    once = added.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "_g").orderBy("ref_no", "hit"))).where("_r = 1")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("ref_no", "hit"))).select("query_id", "ref", "id", "section", "place")


def quote(context: Column, query: Column) -> Column:
    """The offline answer: the tags of all passages, as a model would cite them."""
    return F.array_join(F.transform(F.regexp_extract_all(context, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda n: F.concat(F.lit("["), n, F.lit("]"))), " ")


def answer(questions: DataFrame, found: DataFrame, added: DataFrame, chunks: DataFrame, amendments: DataFrame, *, say: Callable[[Column, Column], Column] = quote) -> DataFrame:
    """(query_id, kind, n_chunks, n_amendments, context, answer, citations): one row for each question (query_id, query).

    The context has the amendments (section, day, text) of the chunks' sections first, oldest first, then the chunks and those that
    references added, numbered. say makes an answer of context and query. citations (tag, id, section, verified) are the numbers in
    it: verified where the context has such a chunk. Questions without chunks get an empty context and no citation.
    """
    rows = found.select("query_id", F.struct(F.lit(0).alias("part"), F.col("rank").alias("place")).alias("at"), "id", "section").unionByName(added.select("query_id", F.struct(F.lit(1).alias("part"), F.col("place").alias("place")).alias("at"), "id", "section"))
    rows = rows.join(chunks.select("id", "text"), "id").withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("at")))
    line = F.format_string("[%d] %s\n%s", "n", F.coalesce("section", F.lit("")), F.coalesce("text", F.lit("")))
    parts = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", "id", "section", line.alias("line")))).alias("chunks"))
    changed = rows.select("query_id", "section").distinct().join(amendments, "section").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("day", "section", "text"))).alias("changes"))
    own = questions.join(parts, "query_id", "left").join(changed, "query_id", "left")
    texts = F.concat(F.transform(F.coalesce("changes", F.array()), lambda c: F.concat(F.lit("Amendment of "), c["section"], F.lit(": "), c["text"])), F.transform(F.coalesce("chunks", F.array()), lambda c: c["line"]))
    out = own.select("query_id", "query", X.classify_query(F.col("query"))["kind"].alias("kind"), F.coalesce("chunks", F.array()).alias("chunks"), F.size(F.coalesce("changes", F.array())).alias("n_amendments"), F.array_join(texts, "\n\n").alias("context"))
    out = out.withColumn("answer", say(F.col("context"), F.col("query")))
    tags = F.array_distinct(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), F.lit(1)))
    hit = lambda t: F.get(F.filter("chunks", lambda c: c["n"].cast("string") == t), F.lit(0))
    cites = F.transform(tags, lambda t: F.struct(t.alias("tag"), hit(t)["id"].alias("id"), hit(t)["section"].alias("section"), hit(t).isNotNull().alias("verified")))
    return out.select("query_id", "kind", F.size("chunks").alias("n_chunks"), "n_amendments", "context", "answer", cites.alias("citations"))
