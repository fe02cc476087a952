"""Full-text search: a positional index of stems, search texts as frames, and cover-density ranks, for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stems import is_stop_word, stem, words_of
from ..functions.text import clean_query
from ..session import written

#: What a cover without other words in it adds to a rank.
COVER = 0.1


def positions(df: DataFrame, *, id_col: str = "doc_id", text: str = "text", asked: DataFrame | None = None, few: int = 100_000) -> DataFrame:
    """The index: (id, lexeme, positions) for each stem of each text, positions ascending from 1.

    Stop words are left out but keep their places. Whole texts are dealt by id once and their words meet there, so no place is
    shuffled; write the result partitioned or bucketed by lexeme, and queries read only the lexemes that they ask for.

    With asked, terms as search_terms() gives them, only their lexemes are in the index, which is then a table: the distinct words
    are stemmed once, those asked for (broadcast up to few, counted) are picked from the texts, and nothing else is placed.
    """
    texts = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    if asked is None:
        rows = texts.repartition("id").select("id", F.posexplode(words_of(F.col("text"))).alias("p", "word")).where(~is_stop_word(F.col("word")))
        own = rows.groupBy("id", "word").agg(F.collect_list(F.col("p") + 1).alias("at"))
        return own.groupBy("id", stem(F.col("word")).alias("lexeme")).agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("positions"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = texts.select(F.explode(words_of(F.col("text"))).alias("word")).where(~is_stop_word(F.col("word"))).distinct()
    # A table, as the join's filter on lexemes would be moved down to stem every place of every word.
    words = written(words.repartition(n, "word"), "vocabulary")
    held = written(words.select("word", stem(F.col("word")).alias("lexeme")).join(asked.select("lexeme").distinct(), "lexeme", "left_semi"), "words")
    held = F.broadcast(held) if held.limit(few + 1).count() <= few else held
    rows = texts.select("id", F.posexplode(words_of(F.col("text"))).alias("p", "word")).join(held, "word")
    return written(rows.groupBy("id", "lexeme").agg(F.array_sort(F.collect_list(F.col("p") + 1)).alias("positions")), "positions")


def search_terms(queries: DataFrame, *, key: str = "query_id", text: str = "query") -> DataFrame:
    """What search texts ask for: (query_id, alt, item, without, off, lexeme, n_off, last_off, n_items).

    ``or`` stands between alternatives; an item is a word or a phrase in quotes, and a minus before it excludes it. The
    words of an item stand off places after its first one; a word that falls into several is a phrase. Stop words are left
    out, but keep their places in a phrase. An alternative needs all of its n_items; one that only excludes asks for nothing.
    """
    items = F.regexp_extract_all(F.col(text), F.lit(r'-?"[^"]*"|\S+'), F.lit(0))
    is_or = lambda x: F.lower(x) == "or"
    marked = F.transform(items, lambda x, i: F.struct(F.size(F.filter(F.slice(items, 1, i), is_or)).alias("alt"), i.alias("item"), x.alias("raw")))
    rows = queries.select(F.col(key).alias("query_id"), F.explode(marked).alias("m")).select("query_id", "m.*").where(~is_or(F.col("raw")))
    rows = rows.select("query_id", "alt", "item", F.col("raw").startswith("-").alias("without"), F.posexplode(words_of(F.col("raw"))).alias("off", "word"))
    rows = rows.where(~is_stop_word(F.col("word"))).select("query_id", "alt", "item", "without", "off", stem(F.col("word")).alias("lexeme"))
    item = Window.partitionBy("query_id", "alt", "item")
    rows = rows.withColumn("off", F.col("off") - F.min("off").over(item)).withColumn("n_off", F.count("*").over(item)).withColumn("last_off", F.max("off").over(item))
    n_items = F.size(F.collect_set(F.when(~F.col("without"), F.col("item"))).over(Window.partitionBy("query_id", "alt")))
    return rows.withColumn("n_items", n_items).where("n_items > 0")


def _starts(parts: Column) -> Column:
    """Places where all words of an item stand at their offsets."""
    moved = lambda x: F.transform(x["positions"], lambda p: p - x["off"])
    return F.aggregate(F.slice(parts, 2, F.size(parts)), moved(F.get(parts, F.lit(0))), lambda held, x: F.array_intersect(held, moved(x)))


def _cover_density(found: Column, alternatives: Column, entries: Column) -> Column:
    """The sum over minimal windows that hold all items of some alternative of COVER / (1 + other words in the window).

    found: array of (end, j, start), the places where item j is complete; alternatives: arrays of such j; entries: all places
    of words asked for. One pass in order of places keeps the latest start of each item: the window that ends here begins
    at the earliest of them, and is minimal where that beginning moves on.
    """
    merged = F.array_sort(F.concat(F.transform(entries, lambda p: F.struct(p.alias("at"), F.lit(-1).alias("j"), p.alias("start"))), found))
    flagged = F.transform(merged, lambda x, i: F.struct(x["at"].alias("at"), x["j"].alias("j"), x["start"].alias("start"), F.coalesce(F.get(merged, i + 1)["at"] != x["at"], F.lit(True)).alias("last")))
    none = F.struct(F.lit(-1).alias("s"), F.lit(0).alias("i"))
    size = F.array_max(F.transform(found, lambda x: x["j"])) + 1
    begin = F.struct(F.transform(F.sequence(F.lit(1), size), lambda _: none).alias("latest"), F.lit(0).alias("i"), F.lit(0).alias("seen"), F.lit(0.0).alias("rank"))

    def step(held: Column, x: Column) -> Column:
        i = F.when(x["j"] < 0, held["i"] + 1).otherwise(held["i"])
        back = F.when(x["start"] == x["at"], F.lit(0)).otherwise(F.size(F.filter(entries, lambda p: (p >= x["start"]) & (p < x["at"]))))
        own = F.struct(x["start"].alias("s"), (i - back).alias("i"))
        latest = F.when(x["j"] < 0, held["latest"]).otherwise(F.transform(held["latest"], lambda y, k: F.when(k == x["j"], own).otherwise(y)))

        def counted(window: Column) -> Column:
            new = x["last"] & (window["s"] > held["seen"])
            noise = (x["at"] - window["s"]) - (i - window["i"])
            return F.struct(latest.alias("latest"), i.alias("i"), F.when(new, window["s"]).otherwise(held["seen"]).alias("seen"), (held["rank"] + F.when(new, F.lit(COVER) / (1 + noise)).otherwise(0.0)).alias("rank"))

        ends = F.transform(alternatives, lambda a: F.array_min(F.transform(a, lambda j: F.get(latest, j))))
        return F.get(F.transform(F.array(F.array_max(ends)), counted), F.lit(0))

    return F.aggregate(flagged, begin, step, lambda held: held["rank"])


def search(index: DataFrame, terms: DataFrame, k: int | None = 10, *, few: int = 100_000) -> DataFrame:
    """(query_id, id, rank, rank_score): texts that some alternative of a query fits, by cover density, ties to the smaller id.

    Only the index is read. An alternative needs all of its words, so a text is a candidate only where the rarest of them stands,
    and its places are read only if it has the others too. Up to ``few`` terms (counted) are broadcast, more are joined by lexeme;
    what meets is dealt once by (query, id), where the items of a query are compared in arrays, as long as a text's places of
    the words asked for.
    """
    small = terms.limit(few + 1).count() <= few
    held = lambda df: F.broadcast(df) if small else df
    needs = terms.where(~F.col("without")).groupBy("query_id", "alt").agg(F.collect_set("lexeme").alias("needs"))
    read = index.select("id", "lexeme").join(held(terms.select("lexeme").distinct()), "lexeme", "left_semi")
    seen = read.groupBy("lexeme").agg(F.count("*").alias("seen"))
    each = needs.select("query_id", "alt", "needs", F.explode("needs").alias("lexeme")).join(seen, "lexeme", "left")
    rare = each.groupBy("query_id", "alt", "needs").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "lexeme")).alias("r")).where("r.seen > 0").select("query_id", "needs", "r.lexeme")
    has = read.groupBy("id").agg(F.collect_set("lexeme").alias("has")).withColumnRenamed("id", "_id")
    met = read.join(held(rare), "lexeme").join(has, F.col("id").eqNullSafe(F.col("_id")))
    fit = met.where(F.size(F.array_except("needs", "has")) == 0).select(F.col("query_id").alias("_q"), F.col("id").alias("_id")).distinct()
    own = fit.join(held(terms), F.col("_q").eqNullSafe(F.col("query_id"))).drop("_q").withColumnRenamed("lexeme", "_l")
    hits = index.join(own, F.col("id").eqNullSafe(F.col("_id")) & (F.col("lexeme") == F.col("_l"))).drop("_id", "_l").repartition("query_id", "id")
    part = F.collect_list(F.struct("off", "positions"))
    items = hits.groupBy("query_id", "id", "alt", "item", "without", "n_off", "last_off", "n_items").agg(part.alias("parts"))
    items = items.withColumn("starts", F.when(F.size("parts") == F.col("n_off"), _starts(F.col("parts"))).otherwise(F.array().cast("array<int>")))
    places = F.flatten(F.transform("parts", lambda x: x["positions"]))
    items = items.select("query_id", "id", F.struct("alt", "item", "without", "last_off", "n_items", "starts", places.alias("places")).alias("x"))
    own = items.groupBy("query_id", "id").agg(F.array_sort(F.collect_list("x")).alias("items"))

    fits = lambda x: F.size(x["starts"]) > 0
    wanted = F.filter("items", lambda x: ~x["without"])
    barred = F.transform(F.filter("items", lambda x: x["without"] & fits(x)), lambda x: x["alt"])
    own = own.withColumn("wanted", wanted).withColumn("barred", barred)
    full = lambda a: F.exists("wanted", lambda x: (x["alt"] == a) & (x["n_items"] == F.size(F.filter("wanted", lambda y: (y["alt"] == a) & fits(y)))))
    alts = F.filter(F.array_distinct(F.transform("wanted", lambda x: x["alt"])), lambda a: ~F.array_contains("barred", a) & full(a))
    own = own.withColumn("alts", alts).where(F.size("alts") > 0)
    used = F.transform("wanted", lambda x, j: F.struct(x.alias("x"), j.alias("j")))
    found = F.flatten(F.transform(F.filter(used, lambda u: F.array_contains("alts", u["x"]["alt"])), lambda u: F.transform(u["x"]["starts"], lambda s: F.struct((s + u["x"]["last_off"]).alias("at"), u["j"].alias("j"), s.alias("start")))))
    groups = F.transform("alts", lambda a: F.transform(F.filter(used, lambda u: u["x"]["alt"] == a), lambda u: u["j"]))
    entries = F.array_distinct(F.flatten(F.transform("wanted", lambda x: x["places"])))
    ready = own.select("query_id", "id", found.alias("found"), groups.alias("groups"), entries.alias("entries"))
    scored = ready.select("query_id", "id", _cover_density(F.col("found"), F.col("groups"), F.col("entries")).alias("rank_score"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("rank_score", 9)), "id"))
    ranked = scored.withColumn("rank", order)
    return ranked.where(F.col("rank") <= k) if k else ranked


def question_terms(questions: DataFrame, *, key: str = "query_id", text: str = "query") -> DataFrame:
    """search_terms() of questions in plain language: question words and punctuation go first."""
    return search_terms(questions.select(F.col(key).alias("query_id"), clean_query(F.col(text)).alias("query")))


def keyword_search(index: DataFrame, questions: DataFrame, k: int = 10, *, key: str = "query_id", text: str = "query") -> DataFrame:
    """search() for questions in plain language."""
    return search(index, question_terms(questions, key=key, text=text), k)


def within(index: DataFrame, rows: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The index of some texts only, such as one session's live rows of one type: the filter stands before the ranks."""
    return index.join(rows.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
