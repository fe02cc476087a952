"""Filters, lookups, caps and small projections that the review and question plans share."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def optional_equal(df: DataFrame, column: str, value) -> DataFrame:
    """Rows with the value; all rows where none is asked for."""
    return df if value is None else df.where(F.col(column) == value)


def in_list(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows whose column is among values (a frame with that column); none for an empty one."""
    return df.join(values.select(column).where(F.col(column).isNotNull()).distinct(), column, "left_semi")


def has_field(df: DataFrame, group: str, field: Column) -> DataFrame:
    """(group, has_field): whether any row of the group has a value."""
    return df.groupBy(group).agg(F.max(field.isNotNull()).alias("has_field"))


def label_has(column: Column, part: str, fold: bool = False) -> Column:
    """Whether a label contains a part, with fold whatever the case. Null labels don't."""
    own = F.lower(column) if fold else column
    return F.coalesce(own.contains(part.lower() if fold else part), F.lit(False))


def owned_or_shared(df: DataFrame, owner: str, user: str | int | None) -> DataFrame:
    """A user's own rows and those without an owner."""
    mine = F.lit(False) if user is None else F.coalesce(F.col(owner) == user, F.lit(False))
    return df.where(mine | F.col(owner).isNull())


def of_owned_parents(children: DataFrame, parents: DataFrame, key: str, owner: str, user) -> DataFrame:
    """Children whose parent is the user's own."""
    return children.join(parents.where(F.col(owner) == user).select(key), key, "left_semi")


def under_owner(path: Column, bucket: str, user: str) -> Column:
    """Whether a storage path, without empty and single-point parts, lies under bucket/user and never climbs."""
    parts = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda x: ~x.isin("", "."))
    return (F.size(parts) > 2) & (parts[0] == bucket) & (parts[1] == user) & ~F.array_contains(parts, "..")


def body_pages(df: DataFrame, doc: str, page: str, text: str, *, front: int = 0, tail: int = 0) -> DataFrame:
    """Pages after the front matter and before the tail, with text, whose last line isn't a number printed twice.

    The number of pages of each document is joined, so that no document has to be sorted in one place.
    """
    last = df.groupBy(doc).agg(F.max(page).alias("_last"))
    filled = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    final = F.coalesce(F.try_element_at(filled, F.lit(-1)), F.lit(""))
    doubled = (F.length(final) >= 4) & final.rlike(r"^(\d{2,})\1$")
    own = df.join(last, doc).where((F.col(page) > front) & (F.col(page) <= F.col("_last") - tail)).drop("_last")
    return own.where((F.coalesce(F.trim(text), F.lit("")) != "") & (F.trim(text) != "[NO TEXT]") & ~doubled)


def enabled(checks: DataFrame, columns: Sequence[str] = ("check_key", "category", "name", "instruction", "check_type", "source_files", "sp_top_k")) -> DataFrame:
    """The specifications of checks that are switched on, in order."""
    return checks.where("enabled").orderBy("sort_order", "check_key").select(*[c for c in columns if c in checks.columns])


def with_status(df: DataFrame, status: str, wanted: str) -> DataFrame:
    return df.where(F.col(status) == wanted)


def eval_set(df: DataFrame, *, ids: Sequence | None = None, category: str | None = None, first: int | None = None, key: str = "id", kind: str = "category") -> DataFrame:
    """Questions by id (which overrides all else), or of a category, or the first ones, in order of id."""
    if ids is not None:
        return df.where(F.col(key).isin(list(ids))).orderBy(key)
    out = optional_equal(df, kind, category).orderBy(key)
    return out.limit(first) if first is not None else out


def start_first(start: str = "start", finish: str = "finish") -> Column:
    """The date that date rules take."""
    return F.coalesce(start, finish)


def finish_first(start: str = "start", finish: str = "finish") -> Column:
    """The date that the cost rule takes."""
    return F.coalesce(finish, start)


def plausible_cost(cost: Column) -> Column:
    return cost.between(10000, 5000000000)


def plausible_point(lat: Column, lon: Column) -> Column:
    return lat.between(30, 50) & lon.between(-85, -60)


def along(left: DataFrame, edges: DataFrame, right: DataFrame, common: Sequence[str], near: str, far: str) -> DataFrame:
    """Rows of left with those of right that edges lead to, within the common keys (the project)."""
    return left.join(edges, [*common, near]).join(right, [*common, far])


def phase_groups(activities: DataFrame, project: str = "project_id") -> DataFrame:
    """(project, phase, n, start, finish) of activities that aren't milestones; a path's names joined, General without one."""
    phase = F.when(F.size(F.coalesce("wbs_path", F.array())) > 0, F.array_join("wbs_path", " > ")).otherwise("General")
    own = activities.where(~label_has(F.col("task_type"), "Milestone"))
    return own.groupBy(project, phase.alias("phase")).agg(F.count("*").alias("n"), F.min("start").alias("start"), F.max("finish").alias("finish"))


def roster(activities: DataFrame, project: str, path: str, start: str, ties: Sequence[str]) -> DataFrame:
    """Activities with their place in order of path, then start (unknown starts last)."""
    return activities.withColumn("place", F.row_number().over(Window.partitionBy(project).orderBy(F.asc_nulls_last(path), F.asc_nulls_last(start), *ties)))


def as_text(lines: DataFrame, order: Sequence[str], line: str, name: str, group: Sequence[str] = ()) -> DataFrame:
    """The lines of each group (all of them without one) as one text, in order, with their number."""
    row = F.struct(*order, F.col(line).alias("_l"))
    out = lines.groupBy(*group).agg(F.array_sort(F.collect_list(row)).alias("_a"))
    return out.select(*group, F.array_join(F.transform("_a", lambda x: x["_l"]), "\n").alias(name), F.size("_a").cast("long").alias("n_lines"))


def facts(lines: DataFrame, projects: DataFrame, project: str, sections: Sequence[int], none: str = "none") -> DataFrame:
    """(project, facts, n_lines): lines (project, sec, pos, line) as blocks in order; a section without lines says none."""
    wanted = projects.select(project, F.explode(F.array(*map(F.lit, sections))).alias("sec"))
    empty = wanted.join(lines.select(project, "sec").distinct(), [project, "sec"], "left_anti").select(project, "sec", F.lit(0).alias("pos"), F.lit(none).alias("line"))
    return as_text(lines.select(project, "sec", "pos", "line").unionAll(empty), ["sec", "pos"], "line", "facts", [project])


def narrative_text(chunks: DataFrame, project: str, *, lexical: bool = False) -> DataFrame:
    """(project, narrative, n_lines): chunks (project, id, chunk_index, text) in order of number, or of id as text."""
    return as_text(chunks, ["id"] if lexical else ["chunk_index", "id"], "text", "narrative", [project])


def mention_links(links: DataFrame, k: int = 12, least: float = 0.7) -> DataFrame:
    """The k surest links from the least confidence on; ties by entity and activity."""
    return links.where(F.col("confidence") >= least).orderBy(F.desc("confidence"), "entity", "activity").limit(k)


def capped(df: DataFrame, group: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    """For reports: the first rows of each group, after whatever decided which rows are in it, with how many there are in all."""
    total = df.groupBy(*group).agg(F.count("*").alias("n_all"))
    ranked = df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= most)
    return ranked.join(total, list(group))


def first_matching(df: DataFrame, order: Sequence[Column], keep: Column, k: int, overfetch: int | None = None) -> DataFrame:
    """The k first rows that keep holds for; with overfetch only those among the first overfetch * k rows of all count."""
    return df.where(keep).orderBy(*order).limit(k) if overfetch is None else df.orderBy(*order).limit(k * overfetch).where(keep).orderBy(*order).limit(k)


def families(parts: dict[str, DataFrame]) -> DataFrame:
    """All chunk families under one another, with their kind; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("kind", F.lit(k)) for k, df in parts.items()])


def shares_caption(tables: Column, wanted: Column) -> Column:
    return F.coalesce(F.arrays_overlap(tables, wanted), F.lit(False))


def same_weekdays(days: Column, wanted: Sequence[str] = ("Mon", "Tue", "Wed", "Thu", "Fri")) -> Column:
    """Whether these are just the wanted days, in any order; null for null."""
    return F.array_sort(F.array_distinct(days)) == F.array_sort(F.array(*map(F.lit, wanted)))


def business_calendars(calendars: DataFrame) -> DataFrame:
    """Of each project the first calendar by name that is called a business one, works Monday to Friday and has a list of exceptions (which may be empty)."""
    fit = calendars.where(label_has(F.col("name"), "bus", fold=True) & same_weekdays(F.col("work_days")) & F.col("exceptions").isNotNull())
    return fit.groupBy("project_id").agg(F.min_by(F.struct("calendar_id", "name", "exceptions"), F.struct("name", "calendar_id")).alias("c")).select("project_id", "c.*")


def overlay(df: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """Rows of df with the values of more where it has them; other columns of both stay."""
    shared = [c for c in more.columns if c != key and c in df.columns]
    new = more.select(key, *[F.col(c).alias(f"_n_{c}") if c in shared else F.col(c) for c in more.columns if c != key])
    out = df.join(new, key, "left")
    return out.select(*[F.coalesce(f"_n_{c}", c).alias(c) if c in shared else F.col(c) for c in df.columns], *[c for c in more.columns if c != key and c not in shared])
