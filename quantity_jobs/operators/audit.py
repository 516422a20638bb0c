"""Audits of extracted elements and of budgets: long tables of notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.exprs import polygon_perimeter, round_half_up as half_up
from .clean import infer_stage

P = "project_id"


def _notes(df: DataFrame, severity: str, code: str, element: Column | None, cond: Column) -> DataFrame:
    ident = F.lit(None).cast("string") if element is None else element.cast("string")
    return df.filter(cond).select(P, F.lit(severity).alias("severity"), F.lit(code).alias("code"), ident.alias("element_id"))


def _wall_checks(walls: DataFrame, ranges: DataFrame, projects: DataFrame) -> DataFrame:
    """Checks of single walls: one pass, several notes a row."""
    own = walls.join(ranges, P, "left").join(projects.select(P, "building_type"), P, "left")
    area, opens = F.col("length_m") * F.col("height_m"), F.coalesce("opening_area_m2", F.lit(0.0))
    commercial = F.coalesce(F.col("building_type").isin("comercial", "industrial", "institucional"), F.lit(False))
    known = F.col("ceiling_low").isNotNull()
    low = F.when(known, F.greatest(F.lit(1.8), F.col("ceiling_low") * 0.8)).otherwise(F.lit(2.0))
    high = F.when(known, F.col("ceiling_high") * 1.2).otherwise(F.when(commercial, 6.0).otherwise(4.5))
    thickest = F.when(known, F.col("thickness_high") * 1.3).otherwise(F.lit(0.40))
    note = lambda cond, severity, code: F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code")))
    checks = F.array(
        note((area > 0) & (opens > area), "error", "OPENING_OVER_WALL"),
        note((area > 0) & (opens <= area) & (opens > area * 0.85), "warning", "OPENING_NEAR_WALL_LIMIT"),
        note((F.col("height_m") != 0) & (F.col("height_m") < low), "warning", "CEILING_LOW"),
        note((F.col("height_m") != 0) & (F.col("height_m") >= low) & (F.col("height_m") > high), "warning", "CEILING_HIGH"),
        note((F.col("thickness_m") != 0) & (F.col("thickness_m") < 0.05), "warning", "WALL_THIN"),
        note((F.col("thickness_m") >= 0.05) & (F.col("thickness_m") > thickest), "info", "WALL_THICK"),
    )
    return own.select(P, F.col("wall_id").alias("element_id"), F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("x")).select(P, "x.severity", "x.code", "element_id")


def self_check(walls: DataFrame, slabs: DataFrame, envelopes: DataFrame, ranges: DataFrame, projects: DataFrame) -> DataFrame:
    """(project_id, severity, code, element_id) of all checks. ranges: one cleaned characterisation per project, or none. walls has primary_view and enabled
    where known."""
    view = F.col("primary_view") if "primary_view" in walls.columns else F.lit(None).cast("string")
    on = F.coalesce("enabled", F.lit(True)) if "enabled" in walls.columns else F.lit(True)
    cls = F.col("wall_class")
    counts = walls.groupBy(P).agg(
        F.count_if(cls == "external").alias("ext"),
        F.count_if(cls == "internal").alias("int"),
        F.count_if(on).alias("n"),
        (F.count_if(on & F.coalesce("has_door", F.lit(False))) + F.count_if(on & F.coalesce("has_window", F.lit(False)))).alias("opens"),
        F.count_if(view.isNotNull() & ~view.isin("plan", "roof_plan")).alias("orphans"),
        F.count_if(view.isNotNull()).alias("provenance"),
    )
    per_project = projects.select(P, "building_type").join(counts, P, "left").na.fill(0, ["ext", "int", "n", "opens", "orphans", "provenance"]).join(ranges, P, "left")
    ratio = F.when(F.col("ext") > 0, F.col("int") / F.col("ext"))
    least = F.when(F.col("building_type").eqNullSafe("comercial"), 0.2).otherwise(0.4)
    ranged = F.col("walls_low").isNotNull()
    group = [
        ("error", "ORPHAN_FROM_NON_PLAN", F.col("orphans") > 0),
        ("info", "PROVENANCE_SUMMARY", F.col("provenance") > 0),
        ("error", "NO_EXTERNAL", F.col("ext") == 0),
        ("warning", "NO_INTERNAL", (F.col("int") == 0) & (F.col("ext") > 4)),
        ("info", "EXT_INT_RATIO", (F.col("ext") >= 4) & ((ratio < least) | (ratio > 6.0))),
        ("warning", "WALL_COUNT_LOW", ranged & (F.col("n") < F.floor(F.col("walls_low") * 0.7))),
        ("warning", "WALL_COUNT_HIGH", ranged & (F.col("n") > F.ceil(F.col("walls_high") * 1.3))),
        ("info", "OPENING_COUNT_LOW", ranged & (F.col("opens") < F.floor(F.col("openings_low") * 0.5))),
    ]
    out = _wall_checks(walls, ranges.select(P, "ceiling_low", "ceiling_high", "thickness_high"), projects)
    flags = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(k).alias("code"))) for s, k, c in group))
    out = out.unionByName(
        per_project.select(P, F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("x")).select(P, "x.severity", "x.code", F.lit(None).cast("string").alias("element_id"))
    )
    sview = F.col("primary_view") if "primary_view" in slabs.columns else F.lit(None).cast("string")
    orphans = slabs.filter(sview.isNotNull() & ~sview.isin("plan", "roof_plan")).select(P).distinct()
    out = out.unionByName(_notes(orphans, "error", "ORPHAN_SLAB_FROM_NON_PLAN", None, F.lit(True)))
    out = out.unionByName(_notes(envelopes, "warning", "ENVELOPE_FEW_VERTICES", F.col("level"), F.size("polygon") < 4))
    out = out.unionByName(_notes(envelopes, "warning", "ENVELOPE_LOW_CONFIDENCE", F.col("level"), F.col("confidence") < 0.5))
    out = out.unionByName(_notes(few_externals(walls, envelopes), "warning", "FEW_EXTERNALS_FOR_PERIMETER", F.col("level"), F.lit(True)))
    key = F.lower(F.coalesce(F.nullif("level", F.lit("")), F.lit("Terreo")))
    area = F.coalesce("area_m2", F.lit(0.0))
    sums = slabs.groupBy(P, key.alias("level")).agg(
        half_up(F.sum(F.when(F.col("slab_class").isin("floor", "raft"), area).otherwise(0.0)), 6).alias("floor"), half_up(F.sum(F.when(F.col("slab_class") == "roof", area).otherwise(0.0)), 6).alias("roof")
    )
    share = F.col("roof") / F.col("floor")
    both = (F.col("floor") > 0) & (F.col("roof") > 0)
    return out.unionByName(_notes(sums.filter(both), "info", "FLOOR_ROOF_DIFFER", F.col("level"), (share < 0.6) | (share > 1.8)))


def few_externals(walls: DataFrame, envelopes: DataFrame) -> DataFrame:
    """Envelopes of some perimeter with fewer than three external walls on their level."""
    key = F.lower(F.coalesce(F.nullif("level", F.lit("")), F.lit("Terreo")))
    n = walls.filter("wall_class = 'external'").groupBy(P, key.alias("__lv")).agg(F.count(F.lit(1)).alias("n"))
    own = envelopes.filter(polygon_perimeter(F.col("polygon")) >= 1).withColumn("__lv", F.lower("level")).join(n, [P, "__lv"], "left")
    return own.filter(F.coalesce("n", F.lit(0)) < 3).select(*envelopes.columns)


def levels_with_envelope(walls: DataFrame, envelopes: DataFrame) -> DataFrame:
    """(project_id, level): lower-case levels that have both external walls and an envelope."""
    key = F.lower(F.coalesce(F.nullif("level", F.lit("")), F.lit("Terreo")))
    return walls.filter("wall_class = 'external'").select(P, key.alias("level")).intersect(envelopes.select(P, F.lower("level").alias("level")))


def self_check_summary(notes: DataFrame) -> DataFrame:
    """Notes per project by severity."""
    return notes.groupBy(P).pivot("severity", ["info", "warning", "error"]).count().na.fill(0).withColumn("total", F.col("info") + F.col("warning") + F.col("error"))


def provenance_summary(walls: DataFrame) -> DataFrame:
    """(project_id, role, view, n): walls by primary view, and enrichments by view (an array column `enrichments`)."""
    primary = walls.filter("primary_view IS NOT NULL").groupBy(P, F.col("primary_view").alias("view")).agg(F.count(F.lit(1)).alias("n")).withColumn("role", F.lit("primary"))
    extra = walls.select(P, F.explode("enrichments").alias("view")).groupBy(P, "view").agg(F.count(F.lit(1)).alias("n")).withColumn("role", F.lit("enrichment"))
    return primary.unionByName(extra).select(P, "role", "view", "n")


def inconsistencies(projects: DataFrame, walls: DataFrame, slabs: DataFrame, by_level: DataFrame) -> DataFrame:
    """(project_id, severity, alert, code, element_id): budget checks; severity critical, medium or low as alert critical, warning or info."""
    note = lambda cond, severity, code: F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code")))

    def listed(df: DataFrame, element: Column, *checks: Column) -> DataFrame:
        return df.select(P, element.cast("string").alias("element_id"), F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("x")).select(P, "x.severity", "x.code", "element_id")

    length, height, missing = F.coalesce("length_m", F.lit(0.0)), F.coalesce("height_m", F.lit(0.0)), F.coalesce("level", F.lit("")) == ""
    out = listed(
        walls,
        F.col("wall_id"),
        note(length <= 0, "critical", "LENGTH_INVALID"),
        note(height <= 0, "critical", "HEIGHT_INVALID"),
        note((length < 0.5) | (length > 50), "low", "LENGTH_UNUSUAL"),
        note((height < 1.5) | (height > 6), "low", "HEIGHT_UNUSUAL"),
        note(missing, "medium", "WALL_WITHOUT_LEVEL"),
    )
    out = out.unionByName(listed(slabs, F.col("slab_id"), note(F.coalesce("area_m2", F.lit(0.0)) <= 0, "critical", "AREA_INVALID"), note(missing, "medium", "SLAB_WITHOUT_LEVEL")))
    of = lambda *names: half_up(F.sum(F.when(F.col("category").isin(*names), F.col("gross_m2")).otherwise(0.0)), 6)
    levels = by_level.groupBy(P, "level").agg(of("external").alias("e"), of("floor", "roof").alias("s")).filter("e > 0 AND s > 0")
    out = out.unionByName(listed(levels, F.col("level"), note((F.col("s") / F.col("e") > 5) | (F.col("s") / F.col("e") < 0.05), "medium", "SLAB_WALL_RATIO")))
    none = F.lit(None)
    empty = projects.select(P).join(walls.select(P).distinct(), P, "left_anti")
    out = out.unionByName(listed(empty, none, note(F.lit(True), "critical", "NO_WALLS")))
    # boundary walls don't count here
    panels = by_level.filter(F.col("category").isin("external", "internal", "floor", "roof")).groupBy(P).agg(F.sum("panels").alias("n"))
    zero = projects.select(P).join(panels, P, "left").filter("coalesce(n, 0) = 0")
    out = out.unionByName(listed(zero, none, note(F.lit(True), "critical", "ZERO_PANELS")))
    return out.withColumn("alert", F.when(F.col("severity") == "critical", "critical").when(F.col("severity") == "medium", "warning").otherwise("info")).select(P, "severity", "alert", "code", "element_id")


def order_notes(notes: DataFrame) -> DataFrame:
    """notes with their place in the project's feed: errors first, then warnings, then infos; equal ones by code and element."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).when(F.col("severity") == "info", 2).otherwise(9)
    return notes.withColumn("place", F.row_number().over(Window.partitionBy(P).orderBy(rank, "code", F.coalesce("element_id", F.lit("")))).cast("long"))


#: The stages in the order of the pipeline.
STAGES = ("0.5", "1", "1.5", "3", "3.5", "3.7", "4", "4.5", "5", "6", "6.5", "7", "7.5", "8")


def order_events(events: DataFrame) -> DataFrame:
    """events with their stage_id and their place in the project's feed: by stage in the order of the pipeline, unknown stages behind in the order in which their first event (by id) comes, then
    by time and id."""
    own = infer_stage(events)
    rank = F.lit(999)
    for number, stage in enumerate(STAGES):
        rank = F.when(F.col("stage_id") == stage, number).otherwise(rank)
    firsts = own.groupBy(F.col(P).alias("p_"), F.col("stage_id").alias("s_")).agg(F.min("id").alias("first_id"))
    joined = own.join(firsts, F.col(P).eqNullSafe(F.col("p_")) & F.col("stage_id").eqNullSafe(F.col("s_"))).drop("p_", "s_")
    order = Window.partitionBy(P).orderBy(rank, F.when(rank == 999, F.col("first_id")), "created_at", "id")
    return joined.withColumn("place", F.row_number().over(order).cast("long")).drop("first_id")


def newest_first(rows: DataFrame) -> DataFrame:
    """rows with their place in the project's list, the newest first."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(P).orderBy(F.desc("created_at"), F.desc("id"))).cast("long"))
