"""Text expressions: queries, headings, captions, anchors, amounts. All are column expressions in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of question phrasing that a keyword search leaves out.
QUESTION_WORDS = [
    "what", "whats", "which", "who", "whom", "whose", "when", "where", "why", "how", "is", "are", "was", "were", "be", "been", "being", "do", "does",
    "did", "have", "has", "had", "can", "could", "may", "might", "must", "shall", "should", "will", "would", "the", "a", "an", "allowed", "required",
    "specified", "defined", "described", "stated", "used", "given", "listed", "mentioned", "noted", "indicated", "provide", "gives", "describe",
    "explain", "state", "list", "tell", "show", "please", "per",
]

# Patterns that make a query keyword-heavy, and acronyms that make it mixed.
SECTION_NUMBER = r"(?i)\b\d{3}\.\d{2}\b|\bsection\s+\d+\b"
KEYWORD_TERMS = r"(?i)\bAASHTO\b|#\s*\d+|\b\d+\s*mm\b|\bTable\s+\d+|\bFigure\s+\d+|\bASTM\b|\bT\s*\d{2,3}\b|\bM\s*\d{2,3}\b|\bNJDOT\s+[A-Z]-\d|\bR\s*\d{2,3}\b"
DOMAIN_TERMS = r"(?i)\bHMA\b|\bIRI\b|\bJMF\b|\bRAP\b|\bRAS\b|\bQPL\b|\bPPA\b|\bMUTCD\b|\bCPM\b|\bDBE\b|\bPG\s+\d{2}|\bQC/QA\b|\bQC\b|\bQA\b"

# The heading, caption and anchor dialect.
HEADINGS = {
    "sub_subsection": r"^\d{3,4}\.\d{2}\.\d{2}\s+[A-Z].+$",
    "subsection": r"^\d{3,4}\.\d{2}\s+[A-Z][A-Z\s,/()-]+$",
    "decimal_section": r"^\d+\.\d+\s+[A-Z].+$",
    "division": r"^DIVISION\s+\d+\s+[–—-]\s+.+$",
    "section": r"^SECTION\s+\d+\s+[–—-]\s+.+$",
    "appendix": r"^NJDOT\s+[A-Z]-\d+\s+[–—-]\s+.+$",
}
CAPTION = r"(?i)\bTABLE\s+(?:\d[\dA-Z]*(?:\.[\dA-Z]+)*(?:-\d+)?|[A-Z]\b)"
SECTION_ANCHOR = r"(?i)\b\d{3,4}\.\d{2}(?:\.\d{2})?\b|\bSECTION\s+\d{3}\b"
AMBIGUOUS_TABLE = r"^TABLE\s+[A-Z]$"
NOT_HEADINGS = ["note", "notes", "figure", "table", "see", "ref"]
NO_TITLE = "UNKNOWN MATERIAL PROCEDURE"
FOOTNOTE = r"(?i)^\s*(?:\d+[.)]\s|[*†‡]\s*|Notes?[.:])"
FIRST_SECTION = "Introduction"

# Column names of printed schedules, and how their activity codes and dates look.
SCHEDULE_HEADERS = ["activity id", "activity name", "orig dur", "rem dur", "total float", "early start", "early finish", "late start", "late finish", "start", "finish", "duration"]
ACTIVITY_CODE = r"^[A-Z]\d{3,5}\b"
PRINTED_DATE = r"\b\d{1,2}/\d{1,2}/\d{2,4}\b"

# Items without a construction activity.
NON_PHYSICAL = [
    "mobilization", "performance and payment bond", "performance bond", "payment bond", "fuel price adjustment",
    "asphalt price adjustment", "steel price adjustment", "field office", "field office maintenance", "progress schedule",
    "progress schedule update", "traffic control coordinator", "training", "allowance",
]


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def model_tokens(text: Column) -> Column:
    """Words and single punctuation marks: the default token strategy of the chunkers."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0))


def clean_query(text: Column) -> Column:
    """A question without punctuation, question words and single characters; the question itself if nothing is left."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " ")), " ")
    kept = F.filter(words, lambda w: (F.length(w) > 1) & ~F.array_contains(F.array(*map(F.lit, QUESTION_WORDS)), w))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(text)


def classify_query(text: Column) -> Column:
    """struct(vector_weight, keyword_weight, kind) of a query."""

    def as_struct(v: float, k: float, kind: str) -> Column:
        return F.struct(F.lit(v).alias("vector_weight"), F.lit(k).alias("keyword_weight"), F.lit(kind).alias("kind"))

    heavy = text.rlike(SECTION_NUMBER) | text.rlike(KEYWORD_TERMS)
    return F.when(heavy, as_struct(0.3, 0.7, "keyword-heavy")).when(text.rlike(DOMAIN_TERMS), as_struct(0.45, 0.55, "mixed")).otherwise(as_struct(0.6, 0.4, "semantic"))


def heading(line: Column) -> Column:
    """The level of a heading line, the most specific first; null for other lines."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for level, pattern in HEADINGS.items():
        out = out.when(line.rlike(pattern), F.lit(level))
    return out


def heading_id(line: Column) -> Column:
    """The number of a heading line: what stands before the title."""
    return F.when(heading(line).isin("sub_subsection", "subsection", "decimal_section"), F.regexp_extract(line, r"^(\S+)", 1)).when(
        heading(line).isNotNull(), F.regexp_extract(line, r"^(\S+\s+\S+)", 1)
    )


def heading_parts(line: Column) -> Column:
    """struct(level, id, title) of a heading line; null for other lines."""
    level, own = heading(line), F.trim(line)
    ident = heading_id(own)
    dashed = level.isin("division", "section", "appendix")
    title = F.when(dashed, F.regexp_extract(own, r"\s+[\u2013\u2014-]\s+(.+)$", 1)).otherwise(F.regexp_extract(own, r"^\S+\s+(.+)$", 1))
    return F.when(level.isNotNull(), F.struct(level.alias("level"), ident.alias("id"), title.alias("title")))


def captions(text: Column) -> Column:
    """Distinct table captions in upper case with single spaces, sorted."""
    found = F.regexp_extract_all(text, F.lit(CAPTION), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.upper(F.regexp_replace(x, r"\s+", " ")))))


def anchors(text: Column) -> Column:
    """struct(sections, tables) named in the first paragraph, in order; a number inside a caption is no section."""
    first = F.split(text, "\n\n")[0]
    tables = F.array_distinct(F.transform(F.regexp_extract_all(first, F.lit(CAPTION), F.lit(0)), lambda x: F.upper(F.regexp_replace(x, r"\s+", " "))))
    rest = F.regexp_replace(first, CAPTION, " ; ")
    sections = F.transform(F.regexp_extract_all(rest, F.lit(SECTION_ANCHOR), F.lit(0)), lambda x: F.regexp_replace(F.upper(x), r"^SECTION\s+", ""))
    return F.struct(F.array_distinct(sections).alias("sections"), tables.alias("tables"))


def pinnable(tables: Column) -> Column:
    """Captions that name one document's table: not a lone letter."""
    return F.filter(tables, lambda t: ~t.rlike(AMBIGUOUS_TABLE))


def change_type(instruction: Column) -> Column:
    up = F.upper(instruction)
    return (
        F.when(up.contains("DELETE"), "deleted").when(up.contains("REPLACE"), "replaced")
        .when(up.contains("ADDED") | up.contains(" ADD "), "added").when(up.contains("CHANGE"), "changed").otherwise("amended")
    )


def printed_page(text: Column, pdf_page: Column, front: int) -> Column:
    """The number printed on the last line, else the page number without front matter."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    last = F.try_element_at(lines, F.lit(-1))
    return F.coalesce(F.when(last.rlike(r"^\d{1,9}$"), last.cast("int")), F.greatest(F.lit(1), pdf_page - front)).cast("int")


def money(text: Column) -> Column:
    """The first amount of a text; M, MM and million stand for millions. Null without digits."""
    number = F.regexp_replace(F.regexp_extract(text, r"(\d[\d,]*(?:\.\d+)?)", 1), ",", "")
    big = text.rlike(r"(?i)\d\s*(?:MM|M|million)\b")
    return (F.when(number != "", number.cast("decimal(20,4)")) * F.when(big, F.lit(1000000)).otherwise(F.lit(1))).cast("decimal(28,4)")


def required_gap(cost: Column) -> Column:
    return F.when(cost.isNotNull(), F.when(cost <= 50000000, 60).otherwise(90))


def is_schedule_page(text: Column) -> Column:
    """Whether a page is a printed schedule: header words, dates or activity codes in enough of its lines."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    head = F.lower(F.array_join(F.slice(lines, 1, 6), " "))
    words = sum((F.when(head.contains(h), 1).otherwise(0) for h in SCHEDULE_HEADERS), F.lit(0))
    n = F.size(lines)
    dates = F.size(F.filter(lines, lambda x: x.rlike(PRINTED_DATE)))
    codes = F.size(F.filter(lines, lambda x: x.rlike(ACTIVITY_CODE)))
    return (n > 0) & ((words >= 3) | (dates >= 0.30 * n) | (codes >= 0.35 * n))


def non_physical(description: Column) -> Column:
    low = F.lower(F.coalesce(description, F.lit("")))
    return F.array_contains(F.transform(F.array(*map(F.lit, NON_PHYSICAL)), lambda p: low.contains(p)), True)


def normal_name(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", ""))


def coordinate(text: Column) -> Column:
    """Degrees of a coordinate text of up to three numbers; S, W and a leading minus negate; 73 to 76 counts as west."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double"))
    value = F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit(None)) + F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(0.0)) / 60 + F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit(0.0)) / 3600
    letter = F.upper(F.regexp_extract(text, r"(?:^|[^A-Za-z])([NSEWnsew])(?:[^A-Za-z]|$)", 1))
    negative = letter.isin("S", "W") | text.rlike(r"^\s*-") | ((letter == "") & value.between(73, 76))
    return F.when(negative, -value).otherwise(value)


def section_of_table(table_id: Column) -> Column:
    """The section of a table number: without its -n suffix."""
    return F.regexp_replace(table_id, r"-\d+$", "")


def without_fence(text: Column) -> Column:
    """The body of a fenced block, else the trimmed text."""
    body = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.when(body != "", body).otherwise(F.trim(text))


def plain_key(key: Column) -> Column:
    """The last part of a dotted key, in lower case."""
    return F.lower(F.substring_index(key, ".", -1))


def short_list(items: Column, k: int = 4) -> Column:
    """The first k items with how many more there are; a dash for none."""
    more = F.when(F.size(items) > k, F.concat(F.lit(" +"), (F.size(items) - k).cast("string"))).otherwise("")
    return F.when(F.size(items) == 0, "—").otherwise(F.concat(F.array_join(F.slice(items, 1, k), ", "), more))


def numbered_lines(text: Column) -> Column:
    """The bodies of lines that begin with a number and a point."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^\d+\.\s+(.+)$"), F.lit(1))


def federal_number(text: Column) -> Column:
    """The first federal project number of a text; null without one."""
    return F.nullif(F.regexp_extract(text, r"\b([A-Z]{2,4}-\d{4}\(\d{3}\))", 1), F.lit(""))


def preview(text: Column, n: int = 300) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def text_layer(text: Column) -> Column:
    """The first 4000 characters of a page with at least 40; else null."""
    return F.when(F.char_length(F.trim(text)) >= 40, F.substring(text, 1, 4000))


def conflicting(a: Column, b: Column) -> Column:
    """Whether two sources are both there and differ."""
    return F.coalesce(a.isNotNull() & b.isNotNull() & (a != b), F.lit(False))


def json_text(document: Column, *path: str) -> Column:
    """The value at a path of a JSON text, as text; null where it isn't there."""
    return F.get_json_object(document, "$" + "".join(f".{p}" for p in path))


def lenient_answer(raw: Column) -> Column:
    """struct(answer, confidence, parsed) of a model's answer: of its JSON, fenced or not, or else the text as the answer."""
    body = F.from_json(without_fence(raw), "answer string, confidence double")
    ok = F.coalesce(body["answer"].isNotNull(), F.lit(False))
    return F.struct(F.when(ok, body["answer"]).otherwise(raw).alias("answer"), F.when(ok, body["confidence"]).alias("confidence"), ok.alias("parsed"))


def document_title(lines: Column) -> Column:
    """The first line in capitals with four words or more and neither colon nor digit; a fixed title if there is none."""
    own = F.transform(lines, lambda x: F.trim(x))
    fit = F.filter(own, lambda x: x.rlike(r"^[A-Z][A-Z\s,/()&.'-]+$") & (F.size(F.split(x, r"\s+")) >= 4))
    return F.coalesce(F.try_element_at(fit, F.lit(1)), F.lit(NO_TITLE))


def footnotes(lines: Column) -> Column:
    """Footnotes of the lines under a table: a line that doesn't begin one goes on with the one before; lines before the first are left out."""
    start = F.array().cast("array<string>")

    def step(done: Column, x: Column) -> Column:
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), F.lit(" "), F.trim(x))))
        return F.when(x.rlike(FOOTNOTE), F.concat(done, F.array(F.trim(x)))).when((F.size(done) > 0) & (F.trim(x) != ""), longer).otherwise(done)

    return F.aggregate(lines, start, step)


def item_pattern(item: Column) -> Column:
    """A pattern for an item as a whole token, whatever the case; parts of dotted numbers may have leading zeros."""
    dotted = F.concat_ws(r"\.", F.transform(F.split(item, r"\."), lambda p: F.concat(F.lit("0*"), F.regexp_replace(p, r"^0+(?=\d)", ""))))
    plain = F.regexp_replace(item, r"([^A-Za-z0-9\s])", r"\\$1")
    body = F.when(item.rlike(r"^\d+(?:\.\d+)+$"), dotted).otherwise(plain)
    return F.concat(F.lit(r"(?i)(?<![A-Za-z0-9])"), body, F.lit(r"(?![A-Za-z0-9])"))


def names_item(text: Column, item: Column) -> Column:
    return F.regexp_like(text, item_pattern(item))


def numbered_or_error(text: Column, expected: Column) -> Column:
    """struct(lines, error) of a numbered answer: an error if it has fewer lines than expected."""
    found = numbered_lines(text)
    short = F.size(found) < expected
    return F.struct(found.alias("lines"), F.when(short, F.format_string("expected %d lines, found %d", expected, F.size(found))).alias("error"))


def summary_line(kind: Column, doc: Column, section: Column, title: Column, division: Column) -> Column:
    """What stands for a chunk's summary where no model gives one."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    own = F.concat(doc, F.when(kind == "table", " table ").otherwise(" section "), blank(section), F.lit(" "), blank(title), F.lit(" ("), blank(division), F.lit(")"))
    return F.concat(own, F.when(kind == "table", " — tabular data.").otherwise("."))


def fact_lines(*pairs: tuple[str, Column]) -> Column:
    """Facts as lines of name and value; those without a value are left out."""
    return F.concat_ws("\n", *[F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v.cast("string"))) for k, v in pairs])
