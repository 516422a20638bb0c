"""Inferred slabs against a plain loop; outcome rules worked out by hand."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quantity_jobs.operators import audit, budget, fuse, score, telemetry
from quantity_jobs.sources import io

WALLS = "project_id long, seq long, level string, wall_class string, length_m double"
SLABS = "project_id long, seq long, slab_id string, level string, slab_class string, area_m2 double, source string, confidence double"
RANK = {"Subsolo": 0, "Terreo": 1, "Mezanino": 1, "1 Pavimento": 2, "2 Pavimento": 3}


def plain_slabs(walls, slabs, detected):
    """One project, level by level, with a growing list of (level, class, area, source)."""
    levels = list(dict.fromkeys([w[2] for w in walls] + [s[3] for s in slabs]))
    groups = list(dict.fromkeys((s[3], s[4]) for s in detected))
    known = [(s[3], s[4], s[5], "given") for g in groups for s in sorted((x for x in slabs if (x[3], x[4]) == g), key=lambda x: (-x[7], -x[5], x[1]))]
    order = sorted(levels, key=RANK.__getitem__)

    def estimate(level):
        own = [w for w in walls if w[2] == level]
        ext = [w for w in own if w[3] == "external"]
        area = (sum(w[4] for w in ext or own) / 4) ** 2
        return 0.0 if area > 800 else round(area, 2)

    def area_at(level, *classes):
        return next((s[2] for s in known if s[0] == level and s[1] in classes), None)

    def best(level):
        for area in (area_at(level, "floor", "raft"), area_at(level, "roof"), next((s[2] for s in known if s[2] > 0), None)):
            if area and area > 0:
                return area
        return estimate(level)

    saw = any(s[4] == "roof" for s in detected)
    for level in order:
        if area_at(level, "floor") is None and (area := estimate(level) or best(level)) > 0:
            known.append((level, "floor", area, "inferred_from_perimeter"))
        if area_at(level, "raft") is not None and area_at(level, "floor") is None:
            known.append((level, "floor", area_at(level, "raft"), "inferred_from_radier"))
        if level == order[0] and area_at(level, "raft") is None and (area := best(level)) > 0:
            known.append((level, "raft", area, "inferred_radier"))
        if level == order[-1] and area_at(level, "roof") is None:
            top = area_at(level, "floor", "raft")
            if saw:
                if (area := best(level)) > 0:
                    known.append((level, "roof", area, "inferred_coberta"))
            elif top is not None and 0 < top <= 800:
                known.append((level, "roof", top, "inferred_coberta_from_piso"))
    if order and not any(s[1] == "raft" for s in known) and (area := best(order[0])) > 0:
        known.append((order[0], "raft", area, "inferred_guaranteed"))
    return sorted(s for s in known if s[3] != "given")


def test_inferred_slabs_against_a_loop(spark):
    rng = random.Random(1)
    walls, slabs = [], []
    for p in range(120):
        for k in range(rng.randrange(5)):
            walls.append((p, k, rng.choice(list(RANK)), rng.choice(["external", "internal"]), rng.choice([5.0, 20.0, 40.0, 200.0])))
        for k in range(rng.randrange(4)):
            slabs.append((p, k, f"s{k}", rng.choice(list(RANK)), rng.choice(["floor", "raft", "roof"]), rng.choice([0.0, 0.0, 50.0, 70.0, 900.0]), "ai", rng.choice([0.5, 0.9])))
    out = fuse.infer_slabs(spark.createDataFrame(walls, WALLS), spark.createDataFrame(slabs, SLABS)).filter("slab_id = 'L_auto'").collect()
    for p in range(120):
        own = [w for w in walls if w[0] == p], [s for s in slabs if s[0] == p]
        assert sorted((r.level, r.slab_class, r.area_m2, r.source) for r in out if r.project_id == p) == plain_slabs(*own, own[1]), own
    assert len({(r.project_id, r.seq) for r in out}) == len(out)
    assert {"inferred_guaranteed", "inferred_from_radier", "inferred_coberta", "inferred_coberta_from_piso"} <= {r.source for r in out}


def test_guaranteed_raft(spark):
    walls = [(1, 0, "Terreo", "external", 200.0), (1, 1, "Superior", "external", 40.0)]
    out = fuse.infer_slabs(spark.createDataFrame(walls, WALLS), spark.createDataFrame([], SLABS)).collect()
    assert {(r.level, r.slab_class, r.area_m2, r.source) for r in out} == {
        ("Superior", "floor", 100.0, "inferred_from_perimeter"), ("Superior", "roof", 100.0, "inferred_coberta_from_piso"), ("Terreo", "raft", 100.0, "inferred_guaranteed"),
    }


EVENT = "id long, project_id long, kind string, stage string, phase string, created_at timestamp"


def at(minute):
    return datetime(2024, 1, 1, 0, minute)


def test_stage_durations(spark):
    rows = [(1, 1, "stage", "a", "started", at(1)), (2, 1, "stage", "a", "completed", at(3)), (3, 1, "stage", "a", "failed", at(9)), (4, 1, "stage", "b", "completed", at(4)), (5, 1, "stage", "c", "started", at(5)), (6, 1, "stage", "c", "failed", at(6)), (7, 1, "stage", "d", "started", at(0)), (8, 1, "stage", None, "started", at(0)), (9, 1, "audit", "a", "started", at(8))]
    got = {r.stage: (r.status, r.duration_ms, r.place) for r in telemetry.stage_durations(spark.createDataFrame(rows, EVENT)).collect()}
    assert got == {"d": ("started", None, 1), "a": ("completed", 120_000, 2), "b": ("completed", None, 3), "c": ("failed", 60_000, 4)}


def test_feeds(spark):
    rows = [(1, 1, "stage", "zz", "started", at(1)), (2, 1, "stage", "7", "started", at(9)), (3, 1, "stage", "0.5", "started", at(8)), (4, 1, "stage", "aa", "started", at(0)), (5, 1, "stage", "7", "started", at(2)), (6, 1, "page_split", None, "started", at(1)), (7, 2, "audit", None, "started", at(1))]
    events = spark.createDataFrame(rows, EVENT).withColumn("prompt_version", F.lit(None).cast("string"))
    got = sorted((r.project_id, r.place, r.id) for r in audit.order_events(events).collect())
    assert got == [(1, 1, 6), (1, 2, 3), (1, 3, 5), (1, 4, 2), (1, 5, 1), (1, 6, 4), (2, 1, 7)]
    notes = spark.createDataFrame([(1, "info", "A", None), (1, "error", "Z", "w"), (1, "warning", "B", None), (1, "error", "Z", None)], "project_id long, severity string, code string, element_id string")
    assert [(r.place, r.code, r.element_id) for r in audit.order_notes(notes).orderBy("place").collect()] == [(1, "Z", None), (2, "Z", "w"), (3, "B", None), (4, "A", None)]
    assert [r.id for r in audit.newest_first(events.filter("project_id = 1")).orderBy("place").collect()] == [2, 3, 5, 6, 1, 4]


def test_feedback_patterns(spark):
    rows = [(1, 10, 20, "external", "internal", "correct", True, True), (2, 10, 20, "external", "internal", "exemplar", True, False), (3, 10, 20, "external", None, "not_wall", True, None), (4, 10, 20, "external", "internal", "confirm", True, None), (5, 10, 20, "external", "internal", "correct", False, None), (6, None, None, None, None, "not_wall", True, None), (7, None, None, None, None, "not_wall", True, None), (8, None, None, None, None, None, True, None)]
    got = score.feedback_patterns(spark.createDataFrame(rows, "id long, thickness_cm long, length_dm long, original_class string, corrected_class string, action string, active boolean, has_window boolean")).collect()
    assert [tuple(r) for r in got] == [(None, None, None, None, 3), (10, 20, "external", "internal", 2), (10, 20, "external", None, 1)]


def test_class_retention(spark):
    projects = spark.createDataFrame([(1, "test", "completed"), (2, "test", "completed"), (3, "production", "completed"), (4, "test", "error")], "project_id long, project_type string, status string")
    walls = spark.createDataFrame([(p, f"w{k}", "external") for p in range(1, 5) for k in range(3)], "project_id long, wall_id string, wall_class string")
    edits = spark.createDataFrame([(p, f"w{k}", "external" if k else "internal", None if k == 1 else True) for p in (1, 3, 4) for k in range(3)] + [(1, "new", "external", True)], "project_id long, wall_id string, wall_class string, enabled boolean")
    got = {r.project_id: (r.walls, r.kept, r.share) for r in score.class_retention(projects, walls, edits).collect()}
    assert got == {1: (3, 2, 66.7), None: (3, 2, 66.7)}
    assert [tuple(r) for r in score.class_retention(projects, walls, edits.filter("false")).collect()] == [(None, 0, 0, None)]


@pytest.mark.parametrize("answer, level, missing", [({"muros": None, "pavimento": 3}, "Pavimento", 4), ({"pavimento": "2"}, "2", 5), ({"pavimento": None, "laje_piso_m2": 0}, "Pavimento", 4), ("[1]", "Pavimento", 5), ("no", "Pavimento", 5), (None, "Pavimento", 5)])
def test_area_answers(spark, answer, level, missing):
    text = answer if answer is None or isinstance(answer, str) else json.dumps(answer)
    r = io.read_area_pages(spark.createDataFrame([(1, 0, text)], "project_id long, seq long, data string")).first()
    assert (r.level, len(r.missing)) == (level, missing)


def test_material_prices(spark):
    amounts = spark.createDataFrame([(1, 10, 100.0, 50.0)], "project_id long, total_panels long, wall_area double, slab_area double")
    products = spark.createDataFrame([(1, "CONN-001", 20.0), (2, "CONN-001", 30.0), (3, "X", 1.0)], "product_id long, sku string, unit_price double")
    cost = lambda p: {r.item: r.cost for r in budget.materials_labor(amounts, p).collect()}
    assert cost(products) == {"connectors": 800.0, "screws": 224.0, "tape": 0.0, "filler": 0.0, "labor": 7800.0}
    assert cost(products.filter("false"))["connectors"] == 500.0
