"""Rule evaluation: verdicts, item checks, regions. A null input gives a null verdict, which reports as Missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Vertices (latitude, longitude) of the line between the regions, from west to east; the state's bounds.
DIVIDING_LINE = [
    (40.192, -74.740), (40.190, -74.715), (40.183, -74.660), (40.197, -74.610), (40.208, -74.560), (40.196, -74.523), (40.186, -74.485),
    (40.176, -74.452), (40.160, -74.440), (40.155, -74.360), (40.155, -74.250), (40.170, -74.185), (40.167, -74.095), (40.172, -74.062),
]
BOUNDS = {"lat": (38.90, 41.40), "lon": (-75.60, -73.85)}
BORDERLINE = 0.015


def line_latitude(lon: Column) -> Column:
    """Latitude of the dividing line at a longitude; beyond its ends, that of the end."""
    out = F.when(lon <= DIVIDING_LINE[0][1], DIVIDING_LINE[0][0])
    for (y0, x0), (y1, x1) in zip(DIVIDING_LINE, DIVIDING_LINE[1:], strict=False):
        out = out.when(lon <= x1, F.lit(y0) + (lon - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(DIVIDING_LINE[-1][0])


def region(lat: Column, lon: Column) -> Column:
    """struct(region, borderline): NORTH or SOUTH of the line; null (suspect) outside the bounds."""
    inside = lat.between(*BOUNDS["lat"]) & lon.between(*BOUNDS["lon"])
    delta = lat - line_latitude(lon)
    name = F.when(inside, F.when(delta > 0, "NORTH").otherwise("SOUTH"))
    return F.struct(name.alias("region"), (inside & (F.abs(delta) < BORDERLINE)).alias("borderline"))


def status(satisfied: Column) -> Column:
    """Pass, Fail, or Missing for null."""
    return F.when(satisfied.isNull(), "Missing").when(satisfied, "Pass").otherwise("Fail")


def derive(breaching: Column, insufficient: Column) -> Column:
    """The verdict of an item list: breaches fail, else too little evidence is Missing, else Pass."""
    return F.when(F.size(breaching) > 0, "Fail").when(F.size(insufficient) > 0, "Missing").otherwise("Pass")


def ui_status(verdict: Column) -> Column:
    return F.when(verdict == "Pass", "pass").when(verdict == "Fail", "fail").otherwise("warning")


def validate_items(found: Column, expected: Column, evidence: Column) -> Column:
    """struct(orphaned, invented): expected items that aren't found, and found ones that the evidence doesn't hold as whole tokens."""
    low = F.lower(evidence)
    whole = lambda x: F.regexp_like(low, F.concat(F.lit(r"(^|[^a-z0-9.])"), F.regexp_replace(F.lower(x), r"([.\-+*?()\[\]])", r"\\$1"), F.lit(r"(\.?([^a-z0-9.]|$))")))
    return F.struct(F.filter(expected, lambda x: ~F.array_contains(found, x)).alias("orphaned"), F.filter(found, lambda x: ~whole(x)).alias("invented"))


def pick_milestone(rows: DataFrame, project: str, ids: tuple[str, ...], pattern: str, without: str | None = None) -> DataFrame:
    """(project, finish) of the one milestone with one of the ids, else of the one whose name matches; null if not exactly one."""
    named = F.col("name").rlike(pattern)
    if without:
        named = named & ~F.col("name").rlike(without)
    by_id = F.col("task_id").isin(*ids)
    g = rows.groupBy(project).agg(
        F.count_if(by_id).alias("_i"), F.max(F.when(by_id, F.coalesce("finish", "start"))).alias("_f"), F.count_if(named).alias("_n"), F.max(F.when(named, F.coalesce("finish", "start"))).alias("_g")
    )
    return g.select(project, F.when(F.col("_i") == 1, F.col("_f")).when((F.col("_i") == 0) & (F.col("_n") == 1), F.col("_g")).alias("finish"))


def resolved_point(lat_raw: Column, lon_raw: Column, lat: Column, lon: Column) -> Column:
    """struct(lat, lon, missing): coordinates as printed before those converted elsewhere; longitudes of 73 to 76 are west."""
    from ..functions.text import coordinate

    y = F.coalesce(coordinate(lat_raw), lat)
    x = F.coalesce(coordinate(lon_raw), F.when(lon.between(73, 76), -lon).otherwise(lon))
    lost = F.filter(F.array(F.when(y.isNull(), "latitude"), F.when(x.isNull(), "longitude")), lambda v: v.isNotNull())
    return F.struct(y.alias("lat"), x.alias("lon"), lost.alias("missing"))


def region_status(name: Column) -> Column:
    """Pass where a region was found, else Missing."""
    return F.when(name.isNotNull(), "Pass").otherwise("Missing")


# Words of resurfacing and of structure items, and the least work days from award to start by kind of project.
RESURFACING = ["mill", "resurfac", "overlay"]
STRUCTURE = ["bridge", "abutment", "pier", "structural steel", "beam", "deck", "culvert"]
AWARD_MINIMUM = {"Federal": 55, "State": 40, "Pavement Preservation": 25}


def project_types(projects: DataFrame, items: DataFrame) -> DataFrame:
    """(project_id, kind, minimum): Federal by either number (federal_no, narrative_no) that isn't blank, Pavement Preservation if half or more
    of the physical items resurface and none is a structure, else State.

    projects: project_id, federal_no, narrative_no; items: project_id, description.
    """
    from ..functions.text import non_physical

    has = lambda words: F.coalesce(F.lower("description").rlike("|".join(words)), F.lit(False))
    own = items.where(~non_physical(F.col("description"))).groupBy("project_id").agg(F.count("*").alias("_n"), F.count_if(has(RESURFACING)).alias("_m"), F.count_if(has(STRUCTURE)).alias("_s"))
    paving = F.coalesce((F.col("_s") == 0) & (2 * F.col("_m") >= F.col("_n")), F.lit(False))
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    kind = F.when(F.coalesce(given("federal_no"), given("narrative_no")).isNotNull(), "Federal").when(paving, "Pavement Preservation").otherwise("State")
    least = F.create_map(*[F.lit(x) for pair in AWARD_MINIMUM.items() for x in pair])
    return projects.join(own, "project_id", "left").select("project_id", kind.alias("kind")).withColumn("minimum", least[F.col("kind")])


def gap_rule(gap: Column, minimum: Column) -> Column:
    """Whether a gap in work days is long enough; null without it."""
    return gap >= minimum


def cost_gap(cost_text: Column, substantial: Column, final: Column) -> Column:
    """Whether final completion follows substantial completion late enough for the cost; null without dates or a plausible cost."""
    from ..functions.text import money, required_gap

    cost = money(cost_text)
    return F.when(cost.between(10000, 5000000000), F.datediff(final, substantial) >= required_gap(cost))


def item_coverage(items: DataFrame, least: float = 0.6) -> DataFrame:
    """(project_id, total, excluded, uncovered, low, covered, status) of items (project_id, item, description, confidence).

    Items without construction work don't count. Uncovered ones fail, low ones are Missing; a project whose items are all
    excluded passes.
    """
    from ..functions.text import non_physical

    out, c = non_physical(F.col("description")), F.col("confidence")
    n = lambda cond: F.count_if(cond)
    g = items.groupBy("project_id").agg(n(~out).alias("total"), n(out).alias("excluded"), n(~out & c.isNull()).alias("uncovered"), n(~out & (c < least)).alias("low"), n(~out & (c >= least)).alias("covered"))
    return g.withColumn("status", F.when(F.col("uncovered") > 0, "Fail").when(F.col("low") > 0, "Missing").otherwise("Pass"))
