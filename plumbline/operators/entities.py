"""Entities of narratives: an injectable extractor over batches of sections, and mentions of known names in whole texts."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..external import Extractor, SentenceExtractor
from ..session import written

# Kinds of entities, sections in a batch, and the most letters kept of a text, a quote and a label.
ENTITY_TYPES = ("Commitment", "Permit", "UtilityWork", "Deadline", "Stakeholder", "PhaseMention", "Restriction")
BATCH, TEXT, QUOTE, LABEL = 4, 300, 400, 60
_ENTITY = "struct<entity_type: string, text: string, quote: string, section_id: string, dates: array<string>, activity_ids: array<string>, activity_names: array<string>>"
_RELATION = "struct<source: int, target: int, label: string>"
_RAW = f"project_id long, batch int, entities array<{_ENTITY}>, relations array<{_RELATION}>, failure string"


def _is_day(value) -> bool:
    try:
        dt.date.fromisoformat(str(value)[:10])
    except ValueError:
        return False
    return True


def _answer(raw: str | dict) -> dict:
    """What an extractor answers, as text with or without a fence around it."""
    if isinstance(raw, dict):
        return raw
    body = raw.strip()
    if body.startswith("```"):
        body = body.partition("\n")[2].rsplit("```", 1)[0]
    return json.loads(body)


def _entity(e: dict, known: list[str]) -> dict | None:
    """An answered entity in its stored form; None for unknown kinds and blank texts."""
    if e.get("type") not in ENTITY_TYPES or not e.get("text"):
        return None
    names = {k: [str(x) for x in e.get(k) or []] for k in ("activity_ids", "activity_names")}
    at = e.get("section_id")
    return {"entity_type": e["type"], "text": str(e["text"])[:TEXT], "quote": str(e.get("quote", ""))[:QUOTE], "section_id": at if at in known else known[0], "dates": [str(d) for d in e.get("dates") or [] if _is_day(d)], **names}


def _relation(r: dict, n: int) -> dict | None:
    """An answered relation between two of n entities; None if it isn't one."""
    try:
        a, b = int(r["from"]), int(r["to"])
    except (KeyError, TypeError, ValueError):
        return None
    return {"source": a, "target": b, "label": str(r.get("label", "relates to"))[:LABEL]} if 0 <= a < n and 0 <= b < n and a != b else None


def extracted(sections: DataFrame, extractor: Extractor | None = None, batch: int = BATCH) -> DataFrame:
    """(project_id, batch, entities, relations, failure): what an extractor finds in each batch of a project's sections.

    sections: project_id, section_id, seq (their order), heading, page and text. Null texts and headings are empty. Batches are
    independent rows, dealt to tasks whatever their project, and the table is written, as an extractor may be dear and answer otherwise
    the next time. A batch whose extractor raises or answers no JSON object keeps nothing and says why in failure; one with a
    malformed entity keeps the entities before it. Unknown sections become the batch's first, unreadable dates are left out.
    """
    ask = extractor or SentenceExtractor()
    order = Window.partitionBy("project_id").orderBy("seq", "section_id")
    text = {c: F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("heading", "text")}
    placed = sections.select("project_id", "section_id", "seq", text["heading"], "page", text["text"], ((F.row_number().over(order) - 1) / batch).cast("int").alias("batch"))
    own = placed.groupBy("project_id", "batch").agg(F.array_sort(F.collect_list(F.struct("seq", "section_id", "heading", "page", "text"))).alias("sections"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for pid, n, some in zip(frame["project_id"], frame["batch"], frame["sections"], strict=True):
                known, found, related, failure = [s["section_id"] for s in some], [], [], None
                try:
                    answer = _answer(ask.extract(list(some)))
                    for e in answer.get("entities", []):
                        found += filter(None, [_entity(e, known)])
                    for r in answer.get("relations", []):
                        related += filter(None, [_relation(r, len(found))])
                except Exception as e:  # an extractor may fail in any way; its batch is then reported
                    failure = f"{type(e).__name__}: {e}"
                rows.append((pid, n, found, related, failure))
            yield pd.DataFrame(rows, columns=["project_id", "batch", "entities", "relations", "failure"])

    return written(own.mapInPandas(run, _RAW), "extracted")


def _numbered(raw: DataFrame) -> DataFrame:
    """Batches with the number of their project's entities before them."""
    before = Window.partitionBy("project_id").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    counts = raw.select("project_id", "batch", F.size("entities").alias("n"))
    return raw.join(counts.select("project_id", "batch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), ["project_id", "batch"])


def _id(n: Column) -> Column:
    return F.concat(F.lit("nar:"), n.cast("string"))


def entities(raw: DataFrame) -> DataFrame:
    """(project_id, entity, entity_type, text, quote, section_id, dates, activity_ids, activity_names) of extracted(), numbered by project."""
    rows = _numbered(raw).select("project_id", "base", F.posexplode("entities").alias("i", "e"))
    return rows.select("project_id", _id(F.col("base") + F.col("i")).alias("entity"), "e.*")


def relations(raw: DataFrame) -> DataFrame:
    """(project_id, source, target, label) between entities of the same batch."""
    rows = _numbered(raw).select("project_id", "base", F.explode("relations").alias("r"))
    return rows.select("project_id", _id(F.col("base") + F.col("r.source")).alias("source"), _id(F.col("base") + F.col("r.target")).alias("target"), "r.label")


def name_words(c: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _by_automaton(texts: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    held = texts.sparkSession.sparkContext.broadcast([r["name"] for r in names.select("name").distinct().collect()])
    own = texts.select(*keys, "id", F.array_join("words", " ").alias("line"))
    fields = [f for f in own.schema.fields if f.name != "line"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["name string", "n long", "first int"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for name in held.value:
            automaton.add_word(f" {name} ", name)
        automaton.make_automaton()
        for frame in frames:
            for row in frame.itertuples(index=False):
                line, ends = f" {row[-1]} ", {}
                for end, name in automaton.iter(line):
                    n, first = ends.get(name, (0, end - len(name) - 1))
                    ends[name] = n + 1, first
                # A place is told as the count of words before it.
                found, at, words = [], 0, 0
                for name, (n, first) in sorted(ends.items(), key=lambda x: x[1][1]):
                    words, at = words + line.count(" ", at, first), first
                    found.append((*row[:-1], name, n, words))
                if found:
                    yield pd.DataFrame(found, columns=[*(f.name for f in fields), "name", "n", "first"])

    return own.mapInPandas(run, schema) if held.value else own.select(*keys, "id", F.lit("").alias("name"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("first")).where("false")


def _by_rarest_word(texts: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    n = names.select("name").distinct().withColumn("parts", F.split("name", " "))
    part = n.select("name", "parts", F.posexplode("parts").alias("off", "word"))
    counts = texts.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("seen"))
    # A name with a word that no text has is nowhere.
    rare = part.join(counts, "word", "left").groupBy("name", "parts").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "off", "word")).alias("r")).where("r.seen > 0")
    asked = rare.select("name", "parts", F.col("r.word").alias("word"))
    # Only numbers of rows and words are shuffled, each word of a text once; a text goes once to the names that it may have.
    rows = written(texts.select(*keys, "id", "words").withColumn("_row", F.monotonically_increasing_id()), "texts")
    has = rows.select("_row", F.explode(F.array_distinct("words")).alias("word"))
    maybe = has.join(asked, "word").groupBy("_row").agg(F.collect_list(F.struct("name", "parts")).alias("names"))
    held = rows.join(maybe, "_row").withColumn("line", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    own = F.filter("names", lambda x: F.col("line").contains(F.concat(F.lit(" "), x["name"], F.lit(" "))))
    fit = held.select(*keys, "id", "words", F.explode(own).alias("x")).select(*keys, "id", "words", "x.*", F.get("x.parts", F.lit(0)).alias("head"), F.size("x.parts").alias("size"))
    starts = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: (F.get("words", i) == F.col("head")) & (F.slice("words", i + 1, F.col("size")) == F.col("parts")))
    at = fit.select(*keys, "id", "name", starts.alias("at")).where(F.size("at") > 0)
    return at.groupBy(*keys, "id", "name").agg(F.sum(F.size("at")).alias("n"), F.min(F.get("at", F.lit(0))).cast("int").alias("first"))


def mentions(texts: DataFrame, names: DataFrame, *, within: list[str] | None = None, most_bytes: int = 32 << 20) -> DataFrame:
    """(within, id, name_id, n, first): how often a text has a name's words in a row, and the first place, counted in words from 0.

    texts (id, text) and names (name_id, name), met within equal columns ``within``. Letter case and what stands between words
    don't matter; mentions may overlap, and equal names each count. Null and wordless texts and names have none.

    Up to most_bytes of names, counted first, each task reads its texts once with an automaton of all names. Beyond that
    nothing is broadcast: names meet the texts under their rarest word, each word of a text once, so a frequent word that many names
    share joins nothing; a text then goes once, with the names that it may have, and its own words decide.
    """
    keys = within or []
    t = texts.select(*keys, "id", name_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    n = names.select(*keys, "name_id", F.array_join(name_words(F.col("name")), " ").alias("name")).where("name <> ''")
    size = n.agg(F.sum(F.octet_length("name"))).first()[0] or 0
    found = (_by_automaton if size <= most_bytes else _by_rarest_word)(t, n, keys)
    return found.join(n, [*keys, "name"]).select(*keys, "id", "name_id", "n", "first")
