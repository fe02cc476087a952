"""From pages to chunks: boilerplate lines, section blocks, token windows, stitching, tables and amendments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X


def lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, line), line numbers from 0."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def boilerplate(pages: DataFrame, doc: str, page: str, *, sample: int | None = 15, share: float = 0.5, least: int = 2, text: str = "text") -> DataFrame:
    """(doc, line) of trimmed lines on at least max(least, share * pages) of a document's first sample pages (None: of all)."""
    some = pages
    if sample is not None:
        some = pages.withColumn("_r", F.row_number().over(Window.partitionBy(doc).orderBy(page))).where(F.col("_r") <= sample)
    counts = some.groupBy(doc).agg(F.countDistinct(page).alias("_pages"))
    each = some.select(doc, page, F.explode(F.array_distinct(F.transform(F.split(text, "\n"), lambda x: F.trim(x)))).alias("line")).where("line <> ''")
    found = each.groupBy(doc, "line").agg(F.countDistinct(page).alias("n_pages"))
    return found.join(counts, doc).where(F.col("n_pages") >= F.greatest(F.lit(float(least)), F.lit(share) * F.col("_pages"))).select(doc, "line", "n_pages")


def without_boilerplate(pages: DataFrame, found: DataFrame, doc: str, page: str, text: str = "text") -> DataFrame:
    """Lines (doc, page, line_no, line) that aren't boilerplate of their document."""
    each = pages.select(doc, page, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return each.withColumn("_t", F.trim("line")).join(found.select(doc, F.col("line").alias("_t")), [doc, "_t"], "left_anti").select(doc, page, "line_no", "line")


def blocks(df: DataFrame, key: str, order: str, is_boundary: Column, line: str = "line") -> DataFrame:
    """Runs of lines, each from a boundary line to the next; lines before the first boundary are dropped.

    Returns key, block (from 1), heading, n_lines and first (order of the heading).
    """
    w = Window.partitionBy(key).orderBy(order)
    marked = df.withColumn("block", F.sum(F.when(is_boundary, 1).otherwise(0)).over(w)).where("block > 0")
    return marked.groupBy(key, "block").agg(F.min_by(line, order).alias("heading"), F.count("*").alias("n_lines"), F.min(order).alias("first"))


def token_windows(df: DataFrame, key: str, tokens: Column, size: int, overlap: int, header: int = 0) -> DataFrame:
    """Windows of at most size tokens that share overlap tokens; later windows leave room for header tokens.

    Returns key, chunk_index, start, n_tokens and the window's tokens. The last window is the one that reaches the end.
    """
    budget = size - header
    step = budget - overlap
    if step <= 0:
        raise ValueError("the overlap leaves no room to advance")
    own = df.select(key, tokens.alias("_t")).where(F.size("_t") > 0)
    n = F.size("_t")
    first = size - overlap
    more = F.when(n > size, F.ceil((n - size) / F.lit(float(step)))).otherwise(0).cast("int")
    out = own.select(key, "_t", F.explode(F.sequence(F.lit(0), more)).alias("chunk_index"))
    start = F.when(F.col("chunk_index") == 0, 0).otherwise(first + (F.col("chunk_index") - 1) * step)
    length = F.when(F.col("chunk_index") == 0, size).otherwise(budget)
    out = out.withColumn("start", start.cast("int")).withColumn("tokens", F.slice("_t", start + 1, length))
    return out.select(key, "chunk_index", "start", F.size("tokens").alias("n_tokens"), "tokens")


def stitch(chunks: DataFrame, key: str, *, most: int = 300) -> DataFrame:
    """Joins consecutive chunks of tokens without their overlap: known from start where chunks have it, else the longest suffix of one that begins the next."""
    w = Window.partitionBy(key).orderBy("chunk_index")
    pairs = chunks.withColumn("_before", F.lag("tokens").over(w))
    sizes = F.sequence(F.least(F.size("_before"), F.size("tokens"), F.lit(most)), F.lit(0), F.lit(-1))
    shared = F.filter(sizes, lambda n: F.slice("_before", F.size("_before") - n + 1, n) == F.slice("tokens", F.lit(1), n))
    known = F.greatest(F.lag("start").over(w) + F.size("_before") - F.col("start"), F.lit(0)) if "start" in chunks.columns else F.element_at(shared, 1)
    cut = pairs.withColumn("overlap", F.when(F.col("_before").isNull(), 0).otherwise(known))
    part = F.struct("chunk_index", F.slice("tokens", F.col("overlap") + 1, F.size("tokens")).alias("t"))
    joined = cut.groupBy(key).agg(F.sort_array(F.collect_list(part)).alias("p"), F.count_if(F.col("overlap") > 0).alias("n_overlaps"), F.count("*").alias("n_chunks"))
    return joined.select(key, F.flatten(F.transform("p", lambda x: x["t"])).alias("tokens"), "n_overlaps", "n_chunks")


def without_ends(pages: DataFrame, group: str, page: str, *, first: int, last: int) -> DataFrame:
    """Pages without the first and last ones of each group. page is unique over all groups.

    Only the ends are ranked, and ranks are limited in each task before a shuffle, so a group may hold any share of all pages.
    """
    keys = pages.select(group, page)
    ends = [keys.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_r") <= n) for order, n in ((F.asc(page), first), (F.desc(page), last))]
    return pages.join(ends[0].unionAll(ends[1]).select(page), page, "left_anti")


def table_kind(rows: Column) -> Column:
    """wide_sparse, multi_header, lookup or simple, of a grid of cells."""
    empty = F.aggregate(rows, F.lit(0), lambda s, r: s + F.size(F.filter(r, lambda c: F.trim(F.coalesce(c, F.lit(""))) == "")))
    cells = F.aggregate(rows, F.lit(0), lambda s, r: s + F.size(r))
    width = F.array_max(F.transform(rows, F.size))
    head = F.filter(rows[1], lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")
    texty = (F.size(rows) >= 3) & (F.size(head) > 0) & F.forall(head, lambda c: ~c.rlike(r"\d")) & F.exists(rows[0], lambda c: F.trim(F.coalesce(c, F.lit(""))) == "")
    return (
        F.when((width >= 10) & (empty >= 0.35 * cells), "wide_sparse").when(texty, "multi_header")
        .when((F.size(rows) >= 10) & width.between(2, 6), "lookup").otherwise("simple")
    )


def table_sentences(header: Column, row: Column) -> Column:
    """One sentence of header: value pairs; empty cells, dashes and N/A are left out, missing headers are Field{i}."""
    numbered = F.transform(row, lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    pairs = F.transform(
        F.filter(numbered, lambda x: ~F.upper(F.trim(F.coalesce(x["c"], F.lit("")))).isin("", "-", "–", "—", "N/A")),
        lambda x: F.concat(F.coalesce(F.nullif(F.trim(F.try_element_at(header, x["i"] + 1)), F.lit("")), F.concat(F.lit("Field"), (x["i"] + 1).cast("string"))), F.lit(": "), F.trim(x["c"])),
    )
    return F.array_join(pairs, ", ")


def table_markdown(rows: Column) -> Column:
    """A grid as Markdown: rows padded to the widest, the first one as header."""
    width = F.array_max(F.transform(rows, F.size))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(1), width), lambda i: F.coalesce(F.trim(F.try_element_at(r, i)), F.lit(""))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width))
    return F.array_join(F.concat(F.array(line(rows[0])), F.array(rule), F.transform(F.slice(rows, 2, F.size(rows)), line)), "\n")


def filled_header(cells: Column) -> Column:
    """Header cells with the last non-empty cell carried rightwards."""
    start = F.array().cast("array<string>")
    return F.aggregate(cells, start, lambda acc, c: F.concat(acc, F.array(F.coalesce(F.nullif(F.trim(c), F.lit("")), F.try_element_at(acc, F.lit(-1)), F.lit("")))))


def html_blocks(df: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Heading, item and paragraph runs of simple markup: (key, pos, tag, body)."""
    found = F.regexp_extract_all(html, F.lit(r"<(?:h1|li|p)>[^<]+"), F.lit(0))
    each = df.select(key, F.posexplode(found).alias("pos", "m"))
    return each.select(key, "pos", F.regexp_extract("m", r"^<(h1|li|p)>", 1).alias("tag"), F.regexp_replace("m", r"^<[a-z0-9]+>", "").alias("body"))


SECTION_LINE = r"^(\d{3}(?:\.\d{2}){1,2})\s+(\S.*)$"
INSTRUCTION = r"^[A-Z][A-Z0-9 ,.()/'-]*:\s*$"


def amendment_blocks(df: DataFrame, key: str, text: str = "text", least: int = 40) -> DataFrame:
    """(key, block, section_id, section_title, change_type, amendment_text): from one section header line to the next.

    The first line in capitals that ends in a colon is the instruction; what follows is the text. Page headers, what
    stands after the code or the signatures, blocks of signatures and texts under ``least`` characters are left out.
    """
    each = lines(df, key, text)
    each = each.where(~F.col("line").rlike(r"^BDC[\w-]+ Page \d+ of \d+"))
    w = Window.partitionBy(key).orderBy("line_no")
    head = F.col("line").rlike(SECTION_LINE)
    marked = each.withColumn("block", F.sum(F.when(head, 1).otherwise(0)).over(w)).where("block > 0")
    inner = Window.partitionBy(key, "block").orderBy("line_no")
    over = F.max(F.col("line").contains("Implementation Code") | F.col("line").contains("Recommended By:")).over(inner)
    first = F.min(F.when(F.col("line").rlike(INSTRUCTION), F.col("line_no"))).over(Window.partitionBy(key, "block"))
    own = marked.withColumn("_i", first).withColumn("_end", over).where(~F.col("_end"))
    body = F.when(F.col("line_no") > F.coalesce("_i", F.lit(-1)), F.struct("line_no", "line"))
    g = own.groupBy(key, "block").agg(F.min_by("line", "line_no").alias("_h"), F.max(F.when(F.col("line_no") == F.col("_i"), F.col("line"))).alias("_c"), F.array_sort(F.collect_list(F.when(~head, body))).alias("_b"))
    said = F.trim(F.array_join(F.transform("_b", lambda x: x["line"]), "\n"))
    out = g.select(
        key, "block", F.regexp_extract("_h", SECTION_LINE, 1).alias("section_id"), F.trim(F.regexp_extract("_h", SECTION_LINE, 2)).alias("section_title"),
        F.coalesce(X.change_type(F.col("_c")), F.lit("amended")).alias("change_type"), said.alias("amendment_text"),
    )
    return out.where((F.length("amendment_text") >= least) & ~F.lower("section_title").rlike("recommended|approved|signed"))


# Heading levels that open a block, by kind of document.
BOUNDARIES = {"specs": ("subsection", "sub_subsection"), "scheduling": ("section", "subsection", "appendix"), "material": ("decimal_section",)}


def section_blocks(each: DataFrame, doc: str, mode: str = "specs", *, order: str = "line_no", line: str = "line", page: str = "page") -> DataFrame:
    """(doc, block, section_id, section_title, division, page, text) of ordered lines (doc, line_no, page, line).

    A boundary heading opens a block with its number and title as first line. In specs, a division line only names what
    follows, and a section line closes the block: text is dropped until the next boundary. Other headings are text, and
    text before the first boundary is dropped.
    """
    w = Window.partitionBy(doc).orderBy(order)
    own = each.withColumn("_h", X.heading_parts(F.trim(line)))
    level = F.coalesce(F.col("_h.level"), F.lit(""))
    opens = level.isin(*BOUNDARIES[mode])
    shuts = (level == "section") if mode == "specs" else F.lit(False)
    names = (level == "division") if mode == "specs" else F.lit(False)
    own = own.withColumn("_o", opens).withColumn("_n", names)
    own = own.withColumn("block", F.sum(F.when(F.col("_o"), 1).otherwise(0)).over(w)).withColumn("_open", F.last(F.when(F.col("_o"), True).when(shuts, False), ignorenulls=True).over(w))
    own = own.withColumn("division", F.coalesce(F.last(F.when(F.col("_n"), F.col("_h.title")), ignorenulls=True).over(w), F.lit("")))
    kept = own.where("_open AND NOT _n")
    shown = F.when(F.col("_o"), F.concat_ws(" ", "_h.id", "_h.title")).otherwise(F.trim(line))
    at = F.when(F.col("_o"), F.struct(F.col("_h.id").alias("id"), F.col("_h.title").alias("title"), "division", F.col(page).alias("page")))
    g = kept.groupBy(doc, "block").agg(F.max(at).alias("_a"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), shown.alias("l")))).alias("_l"))
    return g.select(doc, "block", F.col("_a.id").alias("section_id"), F.col("_a.title").alias("section_title"), F.col("_a.division").alias("division"), F.col("_a.page").alias("page"), F.array_join(F.transform("_l", lambda x: x["l"]), "\n").alias("text"))


def whole_document(pages: DataFrame, doc: str, page: str, text: str = "text") -> DataFrame:
    """(doc, text): the pages of each document in order, a blank line between them."""
    g = pages.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col(text).alias("t")))).alias("_a"))
    return g.select(doc, F.array_join(F.transform("_a", lambda x: x["t"]), "\n\n").alias("text"))


def header_windows(df: DataFrame, keys: list[str], tokens: Column, header: Column, size: int, overlap: int) -> DataFrame:
    """(keys, chunk_index, start, tokens): windows of at most size tokens; later ones begin with the header's tokens and overlap the one before."""
    own = df.select(*keys, tokens.alias("_t"), header.alias("_h")).where(F.size("_t") > 0)
    step = F.greatest(F.lit(1), F.lit(size - overlap) - F.size("_h"))
    more = F.when(F.size("_t") > size, F.ceil((F.size("_t") - size) / step)).otherwise(0).cast("int")
    out = own.withColumn("_s", step).select("*", F.explode(F.sequence(F.lit(0), more)).alias("chunk_index"))
    start = F.when(F.col("chunk_index") == 0, 0).otherwise(size - overlap + (F.col("chunk_index") - 1) * F.col("_s")).cast("int")
    out = out.withColumn("start", start)
    later = F.concat("_h", F.slice("_t", F.col("start") + 1, F.greatest(F.lit(1), size - F.size("_h"))))
    return out.select(*keys, "chunk_index", "start", F.when(F.col("chunk_index") == 0, F.slice("_t", F.lit(1), size)).otherwise(later).alias("tokens"))


def token_offsets(each: DataFrame, doc: str, order: str, line: str = "line", *others: str) -> DataFrame:
    """Lines with the number of tokens that their document has before them."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = each.select(doc, order, *others, F.size(X.model_tokens(F.col(line))).alias("_n"))
    return own.withColumn("offset", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")


def heading_runs(each: DataFrame, doc: str, *, order: str = "line_no", line: str = "line", first: str = X.FIRST_SECTION) -> DataFrame:
    """(doc, run, heading, text) of ordered lines: each from a heading of running text to the next; before it, the first section."""
    w = Window.partitionBy(doc).orderBy(order)
    head = narrative_heading(F.col(line))
    own = each.withColumn("_h", head).withColumn("run", F.sum(F.when(head, 1).otherwise(0)).over(w))
    body = F.when(~F.col("_h"), F.struct(F.col(order).alias("o"), F.col(line).alias("l")))
    g = own.groupBy(doc, "run").agg(F.max(F.when(F.col("_h"), F.trim(line))).alias("_t"), F.array_sort(F.collect_list(body)).alias("_b"))
    text = F.trim(F.array_join(F.transform("_b", lambda x: x["l"]), "\n"))
    return g.select(doc, "run", F.coalesce("_t", F.lit(first)).alias("heading"), text.alias("text")).where("text <> ''")


def table_chunk(caption: Column, rows: Column, notes: Column) -> Column:
    """A table's chunk: caption, grid as Markdown, footnotes once."""
    return F.concat_ws("\n\n", F.nullif(caption, F.lit("")), table_markdown(rows), F.when(F.size(notes) > 0, F.array_join(notes, "\n")))


def row_chunks(df: DataFrame, key: str, rows: str, least: int = 50) -> DataFrame:
    """(key, row, content): each row of a table of more than ``least`` rows with its header."""
    own = df.where(F.size(rows) > least).select(key, F.col(rows)[0].alias("_h"), F.posexplode(F.slice(rows, 2, F.size(rows))).alias("row", "_r"))
    return own.select(key, "row", F.concat_ws("\n", F.array_join("_h", " | "), F.array_join("_r", " | ")).alias("content"))


def flat_header(rows: Column) -> Column:
    """Two header rows as one: the upper carried rightwards, joined to the lower by a dash; cells alike or empty stand once."""
    upper, lower = filled_header(rows[0]), F.transform(rows[1], lambda c: F.trim(F.coalesce(c, F.lit(""))))
    both = F.zip_with(upper, lower, lambda a, b: F.when((F.coalesce(b, F.lit("")) == "") | (a == b), a).when(F.coalesce(a, F.lit("")) == "", b).otherwise(F.concat(a, F.lit(" — "), b)))
    return both


def narrative_heading(line: Column) -> Column:
    """Whether a line is a heading of running text: short, not ended like a sentence, not numbered, in title or upper case."""
    t = F.trim(line)
    word = F.lower(F.regexp_extract(t, r"^(\S+)", 1))
    return ~word.isin(*X.NOT_HEADINGS) & (F.length(t) > 0) & (F.length(t) <= 80) & ~t.rlike(r"[.,;)0-9]$") & ~t.rlike(r"^\d+[.)]\s") & (t.rlike(r"^(?:[A-Z][A-Za-z'/&-]*\s*)+$") | t.rlike(r"^[A-Z][A-Z\s/&-]+$"))
