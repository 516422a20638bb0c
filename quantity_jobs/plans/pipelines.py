"""Composed workloads in their order of execution. Everything is keyed by project_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import audit, budget, classify, clean, fuse
from ..sources.io import as_they_lie, dealt, staged


def measured_elements(walls: DataFrame, slabs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units, defaults and plausible measures."""
    return clean.validate_geometry(clean.wall_defaults(clean.fix_units(walls)), slabs)


def level_budget(walls: DataFrame, slabs: DataFrame, corners: DataFrame) -> DataFrame:
    own, plates = measured_elements(walls, slabs)
    return budget.budget_by_level(own, plates, corners)


def priced_proposal(walls: DataFrame, slabs: DataFrame, corners: DataFrame, projects: DataFrame, catalogue: DataFrame, choices: DataFrame | None = None) -> DataFrame:
    """From raw elements to proposal lines: the flagship workload."""
    return budget.proposal_lines(budget.budget_summary(level_budget(walls, slabs, corners)), projects, catalogue, choices)


def fuse_views(
    walls: DataFrame, slabs: DataFrame, sched_openings: DataFrame, sched_areas: DataFrame, projects: DataFrame, heuristics: DataFrame, feedback: DataFrame, hints: DataFrame, sched_walls: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Fusion in its order: schedules, areas, units, defaults, classes, duplicates, dominant pages, similar slabs, inferred slabs, perimeter, overlaps,
    feedback, markers. Walls are dealt by project once and lie in buckets from then on, which every step reads as they lie; between steps that look at them several
    times they are written again. What is returned has been computed."""
    with as_they_lie(walls.sparkSession):
        own = walls
        if sched_walls is not None:
            own = fuse.add_schedule_walls(own, sched_walls).withColumn("openings", F.coalesce("openings", F.array().cast(own.schema["openings"].dataType)))
        own = fuse.schedule_opening_dims(own, sched_openings)
        plates = dealt("slabs", fuse.cap_slab_area(fuse.reconcile_slab_area(slabs, sched_areas), sched_areas))
        own = clean.wall_defaults(clean.fix_units(own))
        own = own.drop("building_type").join(projects.select("project_id", "building_type"), "project_id", "left")
        own = classify.flag_class_vs_score(classify.reclassify_by_score(own, heuristics), heuristics)
        own = dealt("walls", fuse.dedup_walls(own))
        own = dealt("walls", fuse.dominant_page(own))
        few = fuse.suppress_similar_slabs(fuse.dedup_slabs(plates))
        few = dealt("slabs", fuse.infer_slabs(own, few, plates))
        own = dealt("walls", fuse.drop_overlapped_internal(fuse.perimeter_audit(own)))
        own = classify.feedback_override(own, feedback, projects)
        own = fuse.renumber(classify.nearest_hint_class(own, hints), "P", "wall_id")
        return staged(own, "walls"), staged(fuse.renumber(few, "L", "slab_id"), "slabs")


def takeoff_to_budget(walls, slabs, corners, sections, envelopes, sched_openings, sched_areas, projects, heuristics, feedback, hints) -> tuple[DataFrame, DataFrame]:
    """(level budget, audit notes): envelope classes, fusion, thickness cap, validation, opening links, sections, budget."""
    with as_they_lie(walls.sparkSession):
        placed = dealt("walls", classify.topology_class(walls, envelopes))
    own, plates = fuse_views(placed, slabs, sched_openings, sched_areas, projects, heuristics, feedback, hints)
    own, _ = clean.cap_thickness(own)
    own, plates = clean.validate_geometry(own, plates)
    own = fuse.apply_sections(fuse.link_openings(own, sched_openings), sections)
    by_level = budget.budget_by_level(own, plates, corners)
    return by_level, audit.inconsistencies(projects, own, plates, by_level)
