"""Retrieval: vector and keyword rankings, their fusion, pinning, references and citations."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions.vectors import cosine, nearest, vector


def vector_topk(df: DataFrame, query: Sequence[float], k: int = 10, *, id_col: str = "vec_id", embedding: str = "embedding", floor: float | None = None, inclusive: bool = False, where: Column | None = None) -> DataFrame:
    """The k rows most alike the query vector: ties to the smaller id. Rows below the floor (strict unless inclusive) don't count.

    A scan with a bounded heap in each task (TakeOrderedAndProject); filters stand before it, so recall is exact.
    """
    if where is not None:
        df = df.where(where)
    scored = df.withColumn("similarity", cosine(F.col(embedding), vector(query))).where(F.col("similarity").isNotNull())
    if floor is not None:
        scored = scored.where(F.col("similarity") >= floor if inclusive else F.col("similarity") > floor)
    return scored.orderBy(F.desc("similarity"), F.asc(id_col)).limit(k)


def vector_topk_batch(df: DataFrame, probes: DataFrame, k: int = 5, *, id_col: str = "vec_id", embedding: str = "embedding", most: int = 4096) -> DataFrame:
    """The k rows most alike each probe (probe_id, probe), without the probe's own row; ranks are limited in each task.

    Blocks of rows meet blocks of probes as products of matrices, see vectors.nearest(); up to ``most`` probes (counted first) are
    broadcast.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(embedding).alias("_e"))
    scored = nearest(rows, probes.select("probe_id", "probe"), k, own="probe_id", most=most)
    rank = F.row_number().over(Window.partitionBy("probe_id").orderBy(F.desc("similarity"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def keyword_topk(df: DataFrame, terms: Sequence[str] = (), k: int | None = 10, *, phrase: Sequence[str] = (), without: Sequence[str] = (), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows that hold all terms and the phrase and none of the excluded words, by the sum of tf / (1 + tf), ties by id.

    A query has few terms, so the table is scanned once without a join or an index; see keyword_postings for many.
    """
    out = df.withColumn("_t", X.tokens(F.col(text)))
    for t in terms:
        out = out.where(F.array_contains("_t", t))
    for t in without:
        out = out.where(~F.array_contains("_t", t))
    if phrase:
        out = out.where(F.concat(F.lit(" "), F.array_join("_t", " "), F.lit(" ")).contains(" " + " ".join(phrase) + " "))

    def share(t: str) -> Column:
        n = F.size(F.filter("_t", lambda x: x == t)).cast("double")
        return n / (n + 1)

    ranked = out.withColumn("rank_score", reduce(lambda a, b: a + b, [share(t) for t in [*terms, *phrase]], F.lit(0.0))).drop("_t")
    return ranked.orderBy(F.desc("rank_score"), id_col).limit(k) if k else ranked


def keyword_postings(df: DataFrame, *, id_col: str = "doc_id", text: str = "text", asked: DataFrame | None = None) -> DataFrame:
    """An inverted index: (lexeme, id, tf), for many queries at once; partition it by lexeme when it is written.

    With asked, queries as keyword_batch takes them, only their lexemes are counted and shuffled.
    """
    words = df.select(F.col(id_col).alias("id"), F.explode(X.tokens(F.col(text))).alias("lexeme"))
    if asked is not None:
        words = words.join(asked.select(F.explode("terms").alias("lexeme")).distinct(), "lexeme", "left_semi")
    return words.groupBy("lexeme", "id").agg(F.count("*").alias("tf"))


def keyword_batch(postings: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """For queries (query_id, terms array) the k documents with all terms, from postings; one shuffle by (query, id)."""
    asked = queries.select("query_id", F.size(F.array_distinct("terms")).alias("n"), F.explode(F.array_distinct("terms")).alias("lexeme"))
    hits = postings.join(asked, "lexeme").groupBy("query_id", "id").agg(F.count("*").alias("found"), F.max("n").alias("n"), F.sum(F.col("tf") / (F.col("tf") + 1.0)).alias("rank_score")).where("found = n")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rank_score"), "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", "rank", "rank_score")


def ranked(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Ranks from 1 of a list that was limited before (bounded by its limit)."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def fuse(lists: Sequence[tuple[DataFrame, float]], *, id_col: str = "id", constant: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion of lists (id, rank): id, score, first_list, first_rank, query_count.

    Null ids are dropped but keep their rank; an id that occurs again in a list counts again. Scores sum w / (60 + rank).
    """
    tagged = [df.select(F.col(id_col).alias("id"), "rank", F.lit(i).alias("list"), F.lit(float(w)).alias("w")) for i, (df, w) in enumerate(lists)]
    both = reduce(DataFrame.unionAll, tagged).where("id is not null")
    first = F.min(F.struct("list", "rank"))
    out = both.groupBy("id").agg(F.sum(F.col("w") / (constant + F.col("rank"))).alias("score"), first.alias("f"), F.countDistinct("list").alias("query_count"))
    return out.select("id", "score", F.col("f.list").alias("first_list"), F.col("f.rank").alias("first_rank"), "query_count")


def dedup_sections(fused: DataFrame, sections: DataFrame, k: int) -> DataFrame:
    """The best row of each section (rows without one stand for themselves), then the k best. sections: (id, section)."""
    own = fused.join(sections, "id", "left")
    group = F.coalesce(F.nullif("section", F.lit("")), F.col("id").cast("string"))
    order = [F.desc("score"), F.asc("first_list"), F.asc("first_rank")]
    best = own.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("_r = 1").drop("_r")
    return best.orderBy(*order).limit(k)


def pin(df: DataFrame, sections: Sequence[str], tables: Sequence[str], limit: int, *, section: str = "section_id", captions: str | None = None, order: str = "chunk_index") -> DataFrame:
    """Chunks of the named sections (exact, or below them) or with the named tables, first by chunk order."""
    keep = F.lit(False)
    for s in sections:
        keep = keep | (F.col(section) == s) | F.col(section).startswith(s + ".")
    if captions:
        for t in tables:
            keep = keep | F.array_contains(captions, t)
    return df.where(keep).orderBy(F.coalesce(F.col(order), F.lit(0)), section).limit(limit)


def top_references(df: DataFrame, known: Sequence[str], k: int = 3, *, text: str = "text", order: str = "pos") -> DataFrame:
    """The most frequent section numbers in texts that aren't known yet; ties by first occurrence."""
    refs = df.select(F.col(order).alias("_d"), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(r"\b\d{3}\.\d{2}\b"), F.lit(0))).alias("_p", "ref"))
    counted = refs.where(~F.col("ref").isin(list(known)) if known else F.lit(True)).groupBy("ref").agg(F.count("*").alias("n"), F.min(F.struct("_d", "_p")).alias("first"))
    return counted.orderBy(F.desc("n"), "first").limit(k).select("ref", "n")


def amendments(chunks: DataFrame, amendment_map: DataFrame, *, key: str = "section_id", date: str = "bdc_date") -> DataFrame:
    """Amendments of the sections that the chunks have, oldest first."""
    return amendment_map.join(chunks.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi").orderBy(F.asc_nulls_last(date), key)


def valid_citations(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Citations (cite_id, chunk_id, section) checked against chunks (chunk_id, section, page, pos): by id, else by the first chunk of the section."""
    by_id = chunks.select("chunk_id", F.col("page").alias("_p1"))
    by_section = chunks.groupBy(F.lower("section").alias("_s")).agg(F.min_by("page", "pos").alias("_p2"))
    out = citations.join(by_id, "chunk_id", "left").join(by_section, F.lower(citations["section"]) == F.col("_s"), "left")
    return out.select("cite_id", "chunk_id", "section", F.coalesce("_p1", "_p2").alias("page"), (F.col("_p1").isNotNull() | F.col("_p2").isNotNull()).alias("verified"))


def best_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The k first rows of each group; limited in each task before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= k).withColumnRenamed("_r", "rank")


def assemble_context(df: DataFrame, *, k: int = 8, order: str = "rank") -> DataFrame:
    """One text of the k first chunks, numbered, with their sections."""
    line = F.format_string("[%d] %s\n%s", F.col(order), F.coalesce("section", F.lit("")), F.coalesce("text", F.lit("")))
    rows = df.where(F.col(order) <= k).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t")))).alias("a"))
    return rows.select(F.array_join(F.transform("a", lambda x: x["t"]), "\n\n").alias("context"), F.size("a").cast("long").alias("n_chunks"))


def as_of(rows: DataFrame, marks: DataFrame, group: str, at: str, value: str, default: str = "") -> DataFrame:
    """Rows with the value of the last mark of their group at or before them; of marks at one place the greatest counts.

    Rows and marks go through one ordered pass of each group, so no pair of them is ever built.
    """
    both = rows.select(group, at, F.lit(None).cast("string").alias("_v"), F.lit(1).alias("_k")).unionAll(marks.select(group, at, F.col(value).alias("_v"), F.lit(0)))
    carried = F.last("_v", ignorenulls=True).over(Window.partitionBy(group).orderBy(at, "_k", "_v"))
    return both.withColumn(value, F.coalesce(carried, F.lit(default))).where("_k = 1").select(group, at, value)


def parse_search(query: str) -> list[dict[str, list]]:
    """Alternatives of a search text: each with words, phrases (in quotes) and what a minus excludes; or stands between alternatives."""
    out: list[dict[str, list]] = [{"words": [], "phrases": [], "without": []}]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        tokens = re.findall(r"[a-z0-9]+", (phrase or word).lower())
        if word.lower() == "or" and not minus:
            out.append({"words": [], "phrases": [], "without": []})
        elif minus:
            out[-1]["without"].append(tokens)
        elif phrase:
            out[-1]["phrases"].append(tokens)
        else:
            out[-1]["words"] += tokens
    return [a for a in out if any(a.values())]


def web_search(df: DataFrame, query: str, k: int | None = 10, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows that some alternative of the search text fits, ranked by the sum of tf / (1 + tf) of all words asked for; ties by id.

    A substring test of the raw text stands before any tokenizing, so rows without the words are dropped cheaply.
    """
    wanted = parse_search(query)
    if not wanted:
        return df.withColumn("rank_score", F.lit(0.0)).limit(0)
    low = F.lower(F.col(text))
    maybe = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [low.contains(t) for t in a["words"] + [w for p in a["phrases"] for w in p]], F.lit(True)) for a in wanted])
    own = df.where(maybe).withColumn("_t", X.tokens(F.col(text))).withColumn("_j", F.concat(F.lit(" "), F.array_join("_t", " "), F.lit(" ")))
    has = lambda ts: F.col("_j").contains(" " + " ".join(ts) + " ")
    fits = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [has([w]) for w in a["words"]] + [has(p) for p in a["phrases"]] + [~has(p) for p in a["without"]], F.lit(True)) for a in wanted])
    words = list(dict.fromkeys(w for a in wanted for w in a["words"] + [x for p in a["phrases"] for x in p]))
    count = lambda w: F.size(F.filter("_t", lambda x: x == w)).cast("double")
    tf = [count(w) for w in words]
    ranked = own.where(fits).withColumn("rank_score", reduce(lambda a, b: a + b, [n / (n + 1) for n in tf], F.lit(0.0))).drop("_t", "_j")
    return ranked.orderBy(F.desc("rank_score"), id_col).limit(k) if k else ranked


def live_search(df: DataFrame, session: Column, as_of: str, search, *, expires: str = "expires_at") -> DataFrame:
    """A search (a function of a frame) over a session's rows that haven't expired; both filters stand before the ranks."""
    return search(df.where(session & (F.col(expires) > F.lit(as_of).cast("timestamp"))))


def tagged_passages(found: DataFrame, tag: str, order: Sequence[Column], text: str = "text") -> DataFrame:
    """One text of the rows found, each with its tag and place from 0, set apart by rules."""
    rows = found.withColumn("_p", F.row_number().over(Window.orderBy(*order)) - 1)
    line = F.concat(F.lit(f"[cite:{tag}-"), F.col("_p").cast("string"), F.lit("] "), F.col(text))
    out = rows.agg(F.array_sort(F.collect_list(F.struct("_p", line.alias("t")))).alias("a"))
    return out.select(F.array_join(F.transform("a", lambda x: x["t"]), "\n\n---\n\n").alias("passages"), F.size("a").cast("long").alias("n"))


def hybrid_search(docs: DataFrame, vectors: DataFrame, query: str, vector_: Sequence[float], k: int = 15, *, section: str = "section", id_col: str = "id", text: str = "text") -> DataFrame:
    """Both legs over a pool of max(5 k, 20) rows, fused with the weights that the query's kind asks for, the best row of each section, rounded to six places.

    docs (id, text, section) and vectors (id, embedding); the keyword leg takes the cleaned query.
    """
    spark = docs.sparkSession
    kind = spark.range(1).select(X.classify_query(F.lit(query)).alias("c"), X.clean_query(F.lit(query)).alias("q")).first()
    pool = max(5 * k, 20)
    near = vector_topk(vectors, vector_, pool, id_col=id_col, floor=0.0).select(F.col(id_col).alias("id"), "similarity")
    words = web_search(docs, kind["q"], pool, id_col=id_col, text=text).select(F.col(id_col).alias("id"), "rank_score")
    legs = [(ranked(near, [F.desc("similarity"), F.asc("id")]), kind["c"]["vector_weight"]), (ranked(words, [F.desc("rank_score"), F.asc("id")]), kind["c"]["keyword_weight"])]
    best = dedup_sections(fuse(legs), docs.select(F.col(id_col).alias("id"), F.col(section).alias("section")), k)
    return best.select("id", "section", F.round("score", 6).alias("score"))
