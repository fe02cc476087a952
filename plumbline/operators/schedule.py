"""Schedule networks: links, open ends, lags, critical paths, reconciliation. All keys carry the project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .network import critical_path  # noqa: F401  (part of this module's interface)

# Constraint codes that pin an activity.
MANDATORY = ("CS_MANDSTART", "CS_MSO", "CS_MANDFIN", "CS_MEO")


def known_links(links: DataFrame, activities: DataFrame) -> DataFrame:
    """Links (project_id, pred, succ, ...) whose two activities exist."""
    ids = activities.select("project_id", "task_id")
    out = links.join(ids.withColumnRenamed("task_id", "pred"), ["project_id", "pred"], "left_semi")
    return out.join(ids.withColumnRenamed("task_id", "succ"), ["project_id", "succ"], "left_semi")


def open_ends(activities: DataFrame, links: DataFrame, exempt: tuple[str, ...] = ()) -> DataFrame:
    """(project_id, task_id, open_start, open_finish) of activities without a link in by FS or SS, or out by FS or FF."""
    into = links.where(F.col("rel_type").isin("FS", "SS")).select("project_id", F.col("succ").alias("task_id")).distinct().withColumn("_in", F.lit(True))
    away = links.where(F.col("rel_type").isin("FS", "FF")).select("project_id", F.col("pred").alias("task_id")).distinct().withColumn("_out", F.lit(True))
    own = activities.where(F.coalesce(F.col("status") != "Complete", F.lit(True)) & ~F.col("task_id").cast("string").isin(*exempt, ""))
    found = own.join(into, ["project_id", "task_id"], "left").join(away, ["project_id", "task_id"], "left")
    return found.select("project_id", "task_id", F.col("_in").isNull().alias("open_start"), F.col("_out").isNull().alias("open_finish")).where("open_start OR open_finish")


def prohibited_lags(links: DataFrame) -> DataFrame:
    """Finish-to-start links with a lag, and any link with a negative lag."""
    lag = F.coalesce(F.col("lag_days"), F.lit(0))
    return links.where(((F.col("rel_type") == "FS") & (lag != 0)) | (lag < 0))


def mandatory_constraints(activities: DataFrame) -> DataFrame:
    return activities.where(F.col("constraint_type").isin(*MANDATORY))


def chained_finishes(activities: DataFrame, links: Column | None = None, *, offsets: tuple[int, ...] = (1, 3)) -> DataFrame:
    """Early finishes of finish-to-start networks whose activities stand in order: each follows those offsets before it.

    One pass over each project's ordered array, inside the JVM: activities are (project_id, seq, duration), seq from 1.
    """
    grouped = activities.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("seq", "duration"))).alias("a"))
    start = F.array().cast("array<double>")

    def step(done: Column, x: Column) -> Column:
        before = [F.coalesce(F.when(F.size(done) >= k, F.try_element_at(done, F.lit(-k))), F.lit(0.0)) for k in offsets]
        return F.concat(done, F.array(F.greatest(*before, F.lit(0.0)) + x["duration"]))

    passed = grouped.select("project_id", "a", F.aggregate("a", start, step).alias("f"))
    return passed.select("project_id", F.explode(F.arrays_zip("a", "f")).alias("z")).select("project_id", F.col("z.a.seq").alias("seq"), F.col("z.f").alias("early_finish"))


def comparisons(stored: DataFrame, computed: DataFrame, fields: dict[str, str], numbers: dict[str, str] | None = None) -> DataFrame:
    """(project_id, task_id, field, delta) of all fields that both sides have: days for dates, differences for numbers."""
    both = stored.join(computed, ["project_id", "task_id"])
    parts = [F.struct(F.lit(k).alias("field"), F.datediff(F.col(v), F.col(k)).alias("delta")) for k, v in fields.items()]
    parts += [F.struct(F.lit(k).alias("field"), (F.col(v) - F.col(k)).cast("int").alias("delta")) for k, v in (numbers or {}).items()]
    return both.select("project_id", "task_id", F.explode(F.array(*parts)).alias("x")).select("project_id", "task_id", "x.*").where("delta IS NOT NULL")


def reconcile(stored: DataFrame, computed: DataFrame, fields: dict[str, str], tolerance: int = 1, numbers: dict[str, str] | None = None) -> DataFrame:
    """The comparisons that differ by more than the tolerance."""
    return comparisons(stored, computed, fields, numbers).where(F.abs("delta") > tolerance)


def reconciled(compared: DataFrame, flags: DataFrame, *, tolerance: int = 1, informational: tuple[str, ...] = ("free_float",)) -> DataFrame:
    """(project_id, task_id, state) of compared activities: mismatch, note, critical_flag or clean.

    A difference beyond the tolerance is a mismatch, in an informational field only a note. Where all else is clean, a
    critical flag that differs (flags: project_id, task_id, stored_critical, is_critical) is reported.
    """
    off = F.abs("delta") > tolerance
    soft = F.col("field").isin(*informational)
    g = compared.groupBy("project_id", "task_id").agg(F.max(F.when(off & ~soft, 2).when(off, 1).otherwise(0)).alias("_s")).join(flags, ["project_id", "task_id"], "left")
    differ = ~F.col("stored_critical").eqNullSafe(F.col("is_critical"))
    return g.select("project_id", "task_id", F.when(F.col("_s") == 2, "mismatch").when(F.col("_s") == 1, "note").when(differ, "critical_flag").otherwise("clean").alias("state"))


def reconciliation_counts(states: DataFrame) -> DataFrame:
    """(project_id, checked, mismatched, notes, clean)."""
    count = lambda s: F.count_if(F.col("state") == s)
    return states.groupBy("project_id").agg(F.count("*").alias("checked"), count("mismatch").alias("mismatched"), count("note").alias("notes"), (F.count("*") - count("mismatch")).alias("clean"))


def systematic_offset(compared: DataFrame, *, least: int = 10, share: float = 0.8) -> DataFrame:
    """(project_id, field, delta, share) where one non-zero delta makes up that share of at least ``least`` comparisons; give all of them."""
    counts = compared.groupBy("project_id", "field", "delta").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("project_id", "field"))
    out = counts.withColumn("total", total).withColumn("share", F.col("n") / F.col("total"))
    return out.where((F.col("total") >= least) & (F.col("delta") != 0) & (F.col("share") >= share)).select("project_id", "field", "delta", "share")


def dangling_links(links: DataFrame, activities: DataFrame) -> DataFrame:
    """(project_id, n): how many links name an activity that their project doesn't have."""
    ids = activities.select("project_id", "task_id").distinct()
    a = links.join(ids.withColumnRenamed("task_id", "pred").withColumn("_p", F.lit(1)), ["project_id", "pred"], "left")
    b = a.join(ids.withColumnRenamed("task_id", "succ").withColumn("_s", F.lit(1)), ["project_id", "succ"], "left")
    return b.groupBy("project_id").agg(F.count_if(F.col("_p").isNull() | F.col("_s").isNull()).alias("n"))


def constraints(activities: DataFrame) -> DataFrame:
    """A row for each constraint that an activity has (up to two)."""
    pairs = F.array(F.struct(F.col("constraint_type").alias("type"), F.col("constraint_date").alias("date")), F.struct(F.col("constraint_type2").alias("type"), F.col("constraint_date2").alias("date")))
    out = activities.select("project_id", "task_id", F.explode(pairs).alias("x")).select("project_id", "task_id", "x.type", "x.date")
    return out.where(F.col("type").isNotNull() & (F.col("type") != "None"))


def negative_float(cpm: DataFrame) -> DataFrame:
    """Activities with a total float below zero, the worst first."""
    return cpm.where("total_float < 0").orderBy("total_float", "project_id", "task_id")


def gated(verdicts: DataFrame, cpm: DataFrame) -> DataFrame:
    """(project_id, rule, satisfied): null where no activity of the project was computed."""
    done = cpm.where("early_start IS NOT NULL").select("project_id").distinct().withColumn("_c", F.lit(True))
    return verdicts.join(done, "project_id", "left").withColumn("satisfied", F.when(F.col("_c"), F.col("satisfied"))).drop("_c")


def paths_two_hops(links: DataFrame) -> DataFrame:
    """(project_id, succ, pred, hops) for one and two hops backwards; a pair occurs once for each route."""
    one = links.select("project_id", "succ", "pred", F.lit(1).alias("hops"))
    a, b = links.select("project_id", "succ", F.col("pred").alias("mid")), links.select("project_id", F.col("succ").alias("mid"), "pred")
    return one.unionAll(a.join(b, ["project_id", "mid"]).select("project_id", "succ", "pred", F.lit(2).alias("hops")))
