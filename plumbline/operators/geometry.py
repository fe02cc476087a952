"""Tables on pages by the places of their words: lines, tables, the caption above and the footnotes below."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import footnotes

# A caption's number and title, and how far above and below a table (in points) its lines are looked for.
CAPTION_LINE = r"(?i)Table\s+(\d+\.\d+(?:\.\d+)?(?:-\d+)?)\s*(.*)"
ABOVE, BELOW = 60.0, 80.0


def lines(words: DataFrame, *, page: tuple[str, ...] = ("doc", "page"), slack: float = 3.0, gap: float = 12.0) -> DataFrame:
    """(page, line, top, bottom, x0, x1, text, cells) of words (page, x0, x1, top, bottom, text).

    Words in order of height begin a new line where they lie more than slack lower than the word before; in a line they
    stand from left to right, and a gap wider than gap begins a new cell. Words without a place or a text are left out.
    """
    known = words.where("x0 IS NOT NULL AND x1 IS NOT NULL AND top IS NOT NULL AND bottom IS NOT NULL AND text IS NOT NULL")
    down = Window.partitionBy(*page).orderBy("top", "x0", "x1", "text")
    first = F.coalesce((F.col("top") - F.lag("top").over(down)) > slack, F.lit(True))
    numbered = known.withColumn("line", F.sum(first.cast("int")).over(down.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    right = Window.partitionBy(*page, "line").orderBy("x0", "x1", "top", "text")
    wide = F.coalesce((F.col("x0") - F.lag("x1").over(right)) > gap, F.lit(False))
    celled = numbered.withColumn("cell", F.sum(wide.cast("int")).over(right.rowsBetween(Window.unboundedPreceding, 0)))
    in_order = F.array_sort(F.collect_list(F.struct("x0", "x1", "top", "text")))
    cells = celled.groupBy(*page, "line", "cell").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.array_join(F.transform(in_order, lambda w: w["text"]), " ").alias("own"))
    row = F.transform(F.array_sort(F.collect_list(F.struct("cell", "own"))), lambda c: c["own"])
    out = cells.groupBy(*page, "line").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), row.alias("cells"))
    return out.withColumn("text", F.array_join("cells", " "))


def find_tables(page_lines: DataFrame, *, page: tuple[str, ...] = ("doc", "page"), least_rows: int = 2, least_cells: int = 2, apart: float = 30.0) -> DataFrame:
    """(page, idx, x0, top, x1, bottom, n_rows, n_cells, rows): runs of lines with the same number of cells, two or more.

    A run ends where the number of cells changes or the next line lies more than apart lower; shorter runs are no table.
    idx counts a page's tables from 1, downwards.
    """
    down = Window.partitionBy(*page).orderBy("line")
    n = F.size("cells")
    new = F.coalesce((F.lag(n).over(down) != n) | ((F.col("top") - F.lag("bottom").over(down)) > apart), F.lit(True))
    runs = page_lines.withColumn("run", F.sum(new.cast("int")).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    grid = F.transform(F.array_sort(F.collect_list(F.struct("line", "cells"))), lambda r: r["cells"])
    found = runs.where(n >= least_cells).groupBy(*page, "run").agg(
        F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"), F.count("*").alias("n_rows"), F.max(n).cast("long").alias("n_cells"), grid.alias("rows")
    )
    found = found.where(F.col("n_rows") >= least_rows)
    return found.withColumn("idx", F.row_number().over(Window.partitionBy(*page).orderBy("run"))).drop("run")


def caption_of(text: Column) -> Column:
    """struct(id, title) of a caption line; null for others."""
    own = F.trim(text)
    return F.when(own.rlike(CAPTION_LINE), F.struct(F.regexp_extract(own, CAPTION_LINE, 1).alias("id"), F.trim(F.regexp_extract(own, CAPTION_LINE, 2)).alias("title")))


def with_captions(tables: DataFrame, page_lines: DataFrame, *, page: tuple[str, ...] = ("doc", "page"), above: float = ABOVE) -> DataFrame:
    """Tables with table_id and title: those of the nearest caption line that begins at most above points over the table's
    top; without one, p<last page column>_t<idx> and an empty title.

    Lines and tables go through one downward pass of each page, so no pair of them is built; of lines at one height the
    rightmost counts.
    """
    marks = page_lines.select(*page, "top", F.col("x0").alias("_x"), F.lit(0).alias("_k"), F.lit(None).cast("int").alias("idx"), F.when(caption_of(F.col("text")).isNotNull(), F.struct("top", caption_of(F.col("text")).alias("c"))).alias("_m"))
    asks = tables.select(*page, "top", F.col("x0").alias("_x"), F.lit(-1).alias("_k"), "idx", F.lit(None).cast(marks.schema["_m"].dataType).alias("_m"))
    down = Window.partitionBy(*page).orderBy("top", "_k", "_x")
    seen = marks.unionByName(asks).withColumn("_s", F.last("_m", ignorenulls=True).over(down)).where("_k = -1")
    near = seen.where(F.col("_s.top") >= F.col("top") - above).select(*page, "idx", F.col("_s.c").alias("_c"))
    own = tables.join(near, [*page, "idx"], "left")
    return own.withColumn("table_id", F.coalesce("_c.id", F.format_string("p%s_t%s", F.col(page[-1]).cast("string"), F.col("idx").cast("string")))).withColumn("title", F.coalesce("_c.title", F.lit(""))).drop("_c")


def with_footnotes(tables: DataFrame, page_lines: DataFrame, *, page: tuple[str, ...] = ("doc", "page"), below: float = BELOW) -> DataFrame:
    """Tables with notes: the footnotes, with the lines that continue them, in the lines that begin at most below points
    under the table's end, up to the next table. A line belongs to the last table that ends over it.
    """
    ends = tables.select(*page, F.col("bottom").alias("top"), F.lit(0).alias("_k"), F.struct("idx", "bottom").alias("_m"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("text"))
    rows = page_lines.select(*page, "top", F.lit(2).alias("_k"), F.lit(None).cast(ends.schema["_m"].dataType).alias("_m"), "line", "text")
    starts = tables.select(*page, "top", F.lit(1).alias("_k"), F.struct(F.lit(None).cast("int").alias("idx"), F.lit(None).cast("double").alias("bottom")).alias("_m"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("text"))
    down = Window.partitionBy(*page).orderBy("top", "_k", "line")
    seen = ends.unionByName(rows).unionByName(starts).withColumn("_s", F.last("_m", ignorenulls=True).over(down)).where("_k = 2")
    mine = seen.where(F.col("_s.idx").isNotNull() & (F.col("top") < F.col("_s.bottom") + below)).select(*page, F.col("_s.idx").alias("idx"), "line", "text")
    texts = mine.groupBy(*page, "idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda r: r["text"]).alias("_t"))
    return tables.join(texts, [*page, "idx"], "left").withColumn("notes", footnotes(F.coalesce("_t", F.array().cast("array<string>")))).drop("_t")
