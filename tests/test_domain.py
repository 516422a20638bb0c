"""Hand-computed edges of the domain operators, and order-dependent ones against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantity_jobs import dims
from quantity_jobs.functions import exprs
from quantity_jobs.operators import areas, audit, budget, classify, clean, fuse, kernels, match, score, telemetry
from quantity_jobs.sources import io
from quantity_jobs.streaming import streams

WALL = "project_id long, seq long, wall_id string, level string, wall_class string, length_m double, height_m double, thickness_m double, source string, confidence double, has_door boolean, has_window boolean, opening_area_m2 double, page_index int, openings array<struct<kind:string,code:string,width_m:double,height_m:double,sill_m:double,source:string>>, bbox struct<ymin:double,xmin:double,ymax:double,xmax:double>"


def wall(seq=1, length=5.0, height=3.0, openings=(), area=0.0, cls="external", level="Terreo", project=1, thickness=0.1, box=None, source="ai", conf=0.8, page=0):
    return (project, seq, f"w{seq}", level, cls, length, height, thickness, source, conf, any(o[0] == "door" for o in openings), any(o[0] == "window" for o in openings), area, page, list(openings), box)


def walls_df(spark, rows):
    return spark.createDataFrame(rows, WALL)


def values(spark, expression, *cases):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_panels(spark):
    cases = [(10, 3, 0, 18), (10, 3, 6, 14), (10, 3, 6.01, 15), (5, 3, 1.68, 8), (4, 2.8, 4, 5), (2, 3, 10, 0), (0, 3, 0, 0)]
    got = budget.wall_panels(walls_df(spark, [wall(i, float(a), float(h), area=float(o)) for i, (a, h, o, _) in enumerate(cases)])).orderBy("seq").collect()
    assert [r.panels for r in got] == [c[3] for c in cases]
    assert [r.loss for r in got][:3] == [0.05, 0.05, 0.08]
    slabs = spark.createDataFrame([(1, "floor", 100.0), (2, "roof", 50.0), (3, "floor", 18.3), (4, "raft", 500.0)], "seq long, slab_class string, area_m2 double")
    assert [r.panels for r in budget.slab_panels(slabs).orderBy("seq").collect()] == [61, 31, 11, 0]


def test_proposal_golden(spark):
    summary = spark.createDataFrame([(1, "external", 100), (1, "internal", 50), (1, "floor", 61), (1, "roof", 61)], "project_id long, category string, panels long")
    projects = spark.createDataFrame([(1, None)], "project_id long, profile_id long")
    catalogue = spark.createDataFrame([(None, dims.SKU_2P, "a", "painel", 275.0), (None, dims.SKU_SP, "b", "painel", 180.0), (None, dims.SKU_PAGINATION, "c", "x", 11.0)], "profile_id long, sku string, name string, category string, unit_price double")
    got = {r.line: r for r in budget.proposal_lines(summary, projects, catalogue).collect()}
    assert (got["external"].area_m2, got["external"].cost) == (183.0, 50325.0)
    assert (got["internal"].area_m2, got["internal"].cost) == (91.5, 16470.0)
    assert got["floor"].cost == got["roof"].cost == 30698.25
    assert "boundary" not in got and got["pagination"].area_m2 == 497.76 and got["pagination"].cost == 5475.36


def test_texts(spark):
    assert values(spark, exprs.parse_dimension_text, "5,20", "120cm", "464", "L=1.20", "+1.20", "2024", "25", "7", "x") == [5.2, 1.2, 4.64, 1.2, 1.2, None, None, 7.0, None]
    assert values(spark, lambda c: exprs.parse_decimal(c, -1.0), "1,20", " 3.5x", "", None, "1,2,3", "abc") == [1.2, 3.5, -1.0, -1.0, 1.2, -1.0]
    assert values(spark, exprs.normalize_level, "Térreo", "SUBSOLO - x", "pav 4", "N/A", None, "Mezanino!", "2o andar") == ["Terreo", "Subsolo", "Pavimento4", "Terreo", "Terreo", "Mezanino", "Pavimento2"]
    assert values(spark, lambda c: exprs.round_half_up(c.cast("double")), "2.345", "-1.005", "0.125") == [2.35, -1.0, 0.13]


def test_validation_edges(spark):
    rows = [wall(i, thickness=t) for i, t in enumerate((0.059, 0.06, 0.40, 0.41))] + [wall(10 + i, length=x) for i, x in enumerate((0.29, 0.30, 50.0, 50.1, math.nan, math.inf, None))]
    rows += [wall(20 + i, height=h) for i, h in enumerate((1.4, 1.5, 6.0, 6.1, None))]
    slabs = spark.createDataFrame([(1, i, "s", "floor", a) for i, a in enumerate((0.9, 1.0, 5000.0, 5001.0, math.nan, None))], "project_id long, seq long, slab_id string, slab_class string, area_m2 double")
    kept, plates = clean.validate_geometry(walls_df(spark, rows), slabs)
    got = {r.seq: r.height_m for r in kept.collect()}
    assert sorted(got) == [1, 2, 11, 12, 20, 21, 22, 23, 24]
    assert [got[k] for k in range(20, 25)] == [3.0, 1.5, 6.0, 3.0, 3.0]
    assert sorted(r.seq for r in plates.collect()) == [1, 2]
    stats = clean.validation_stats(walls_df(spark, rows), slabs).first()
    assert (stats.walls_before, stats.walls_after, stats.wall_thin, stats.wall_thick, stats.wall_tiny, stats.wall_huge) == (16, 9, 1, 1, 1, 1)


def test_defaults(spark):
    rows = [wall(1, height=0.0, openings=[("door", "P1", 0.0, None, None, "ai"), ("window", "J1", None, 0.0, None, "ai")])]
    got = clean.wall_defaults(walls_df(spark, rows)).first()
    assert got.height_m == 3.0 and got.height_source == "default" and got.opening_area_m2 == pytest.approx(0.8 * 2.1 + 1.2)
    assert got.openings[1].sill_m == 1.1


def test_schedule_merge(spark):
    rows = [wall(1, 4.0), wall(2, 4.3), wall(3, 9.0, cls="internal")]
    sched = spark.createDataFrame([(1, 1, "Q1", "Terreo", "external", 4.49, 2.8, 0.1), (1, 2, "Q2", "Terreo", "external", 4.4, 2.8, 0.1), (1, 3, "Q3", "Terreo", "external", 6.0, 2.9, 0.1), (1, 4, "Q4", "1 Pavimento", "external", 6.2, 2.9, 0.1)], "project_id long, seq long, wall_id string, level string, wall_class string, length_m double, height_m double, thickness_m double")
    got = {r.wall_id: r for r in fuse.merge_schedule_walls(walls_df(spark, rows), sched).collect()}
    # both rows hit the first wall, as the first one's new length is what the second meets
    assert got["w1"].length_m == 4.4 and got["w1"].source == "table" and got["w2"].length_m == 4.3
    assert got["Q3"].length_m == 6.0 and got["Q4"].level == "1 Pavimento" and got["w3"].source == "ai" and len(got) == 5


def test_kernels():
    rng = np.random.default_rng(0)
    for _ in range(30):
        left, right = rng.integers(0, 8, 30), rng.integers(0, 8, 30)
        seen_l, seen_r, want = set(), set(), []
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            want.append(a not in seen_l and b not in seen_r)
            if want[-1]:
                seen_l.add(a)
                seen_r.add(b)
        assert kernels.greedy_pairs(left, right).tolist() == want
        v = rng.random(12) * 10
        kept = v[kernels.greedy_suppress(v, 0.3)]
        assert all(abs(a - b) / max(a, b) > 0.3 for i, a in enumerate(kept) for b in kept[i + 1 :])
    assert kernels.repair_json('```json\n{"a": [1, 2,]}\n```')[1] == "repaired"
    assert kernels.repair_json('{"walls": [{"wall_id": "x", "l": 1}, {"wall_id": "y", "l"')[1] == "recovered"
    assert kernels.repair_json("no") == (None, "quarantine") and kernels.repair_json(" ") == (None, "empty")


def test_suppress_similar(spark):
    rows = [(1, 1, "L", "Terreo", "floor", 100.0, 0.9), (1, 2, "L", "Terreo", "floor", 130.0, 0.5), (1, 3, "L", "Terreo", "floor", 300.0, 0.5), (1, 4, "L", "Terreo", "roof", 10.0, 0.5)]
    df = spark.createDataFrame(rows, "project_id long, seq long, slab_id string, level string, slab_class string, area_m2 double, confidence double")
    assert sorted(r.seq for r in fuse.suppress_similar_slabs(df).collect()) == [1, 3, 4]


def test_sections(spark):
    rows = [wall(1, height=2.8), wall(2, height=2.87), wall(3, level="1 Pavimento", height=2.5), wall(4, level="10 Pavimento", height=2.5)]
    df = clean.wall_defaults(walls_df(spark, rows))
    sections = spark.createDataFrame([(1, 1, "TERREO ", 2.8, 0.6, 0), (1, 2, "terreo", 9.0, 0.59, 0), (1, 3, "Pavimento 10", 3.3, 0.9, 1)], "project_id long, seq long, level string, ceiling_m double, confidence double, page_index int")
    got = {r.seq: (r.section_outcome, r.height_m) for r in fuse.apply_sections(df, sections).collect()}
    assert got[1] == ("confirmed", 2.8) and got[2] == ("applied", 2.8) and got[3] == ("none", 2.5)
    assert got[4] == ("applied", 3.3)


def test_topology(spark):
    point = lambda x, y: {"x": float(x), "y": float(y)}
    shape = [point(*p) for p in ((100, 100), (900, 100), (900, 500), (500, 500), (500, 900), (100, 900))]
    lot = [point(*p) for p in ((0, 0), (1000, 0), (1000, 1000), (0, 1000))]
    env = spark.createDataFrame([(1, "Terreo", 0, shape, lot, 0.9), (2, "TERREO", 0, shape, None, 0.9)], "project_id long, level string, page_index int, polygon array<struct<x:double,y:double>>, lot_polygon array<struct<x:double,y:double>>, confidence double")
    assert env.select(exprs.polygon_area(F.col("polygon"))).first()[0] == 480000.0
    box = lambda y0, x0, y1, x1: (float(y0), float(x0), float(y1), float(x1))
    rows = [wall(1, box=box(97, 200, 103, 400), cls="internal"), wall(2, box=box(297, 200, 303, 400)), wall(3, box=box(697, 600, 703, 800)), wall(4, box=box(697, 600, 703, 800), project=2), wall(5)]
    got = {r.seq: (r.wall_class, r.needs_review) for r in classify.topology_class(walls_df(spark, rows), env).collect()}
    assert got == {1: ("external", False), 2: ("internal", False), 3: ("boundary", False), 4: ("external", True), 5: ("external", False)}


def brute_pairs(lines, scale):
    lo, hi, near, far = 0.30 * scale, 30 * scale, 0.08 * scale, 0.30 * scale
    own = [x for x in lines if lo <= x[5] <= hi]
    used, out = set(), []
    for i, a in enumerate(own):
        if i in used:
            continue
        best = None
        for j in range(i + 1, len(own)):
            b = own[j]
            d = abs(a[6] - b[6]) % 180
            if j in used or min(d, 180 - d) > 3:
                continue
            ux, uy = (a[3] - a[1]) / a[5], (a[4] - a[2]) / a[5]
            t = [(b[k] - a[1]) * ux + (b[k + 1] - a[2]) * uy for k in (1, 3)]
            over = max(0, min(a[5], max(t)) - max(0, min(t)))
            gap = sum(abs(-(b[k] - a[1]) * uy + (b[k + 1] - a[2]) * ux) for k in (1, 3)) / 2
            if near <= gap <= far and over >= min(a[5], b[5]) * 0.6 and over >= lo and (best is None or (over, -gap) > best[0]):
                best = ((over, -gap), j)
        if best:
            used |= {i, best[1]}
            out.append((a[0], own[best[1]][0]))
    return out


def test_parallel_pairs(spark):
    rng = random.Random(1)
    rows = []
    for k in range(120):
        x, y, n = rng.randrange(0, 300), rng.randrange(0, 300), rng.randrange(10, 120)
        flat = rng.random() < 0.5
        rows.append((1, 0, k, float(x), float(y), float(x + (n if flat else rng.random())), float(y + (rng.random() if flat else n))))
    df = spark.createDataFrame(rows, "project_id long, page_index int, seq long, x1 double, y1 double, x2 double, y2 double")
    lines = [(s, a, b, c, d, math.hypot(c - a, d - b), round(math.degrees(math.atan2(d - b, c - a)) % 180, 9)) for _, _, s, a, b, c, d in rows]
    got = match.parallel_pairs(df).collect()
    assert sorted((r.a, r.b) for r in got) == sorted(brute_pairs(lines, 14.17)) and got
    assert match.parallel_pairs(df.repartition(7)).count() == len(got)


def test_whole_pages(spark):
    """raycast_class and merge_touching bear every segment of a page; a fused line may come to fit one that fitted none."""
    from quantity_jobs.plans import queries_match

    rows = [(1, 0, k, *line, pct) for k, (line, pct) in enumerate([((100.0, 100.0, 300.0, 100.0), 1), ((100.0, 50.0, 300.0, 50.0), 9), ((100.0, 150.0, 300.0, 150.0), 9), ((305.0, 100.0, 500.0, 100.0), 9)])]
    segments = spark.createDataFrame(rows, "project_id long, page_index int, seq long, x1 double, y1 double, x2 double, y2 double, thickness_pct long")
    own, queries_match._segments = queries_match._segments, lambda t: t("segments")
    try:
        rays = {r.seq: r.wall_class for r in queries_match.raycast_class(lambda name: segments).collect()}
        touched = queries_match.merge_touching(lambda name: segments).collect()
    finally:
        queries_match._segments = own
    assert rays == {0: "internal", 1: "external", 2: "external", 3: "external"}
    assert sorted(r.members for r in touched) == [1, 1, 2]
    # the third, at 14 degrees, touches only the first, at 0; it fits the line that the first makes with the second, at 7
    chain = [(1, 0, 0, 0.0, 0.0, 20.0, 0.0), (1, 0, 1, 20.0, 0.0, 320.0, 36.8), (1, 0, 2, 0.0, 0.0, -200.0, -49.9), (1, 0, 3, 900.0, 900.0, 950.0, 900.0)]
    fused = match.merge_touching(spark.createDataFrame(chain, "project_id long, page_index int, seq long, x1 double, y1 double, x2 double, y2 double")).collect()
    assert sorted(r.members for r in fused) == [1, 3]


def test_match_endpoints(spark):
    rows = [wall(k, box=(float(100 * k), 100.0, float(100 * k + 6), 300.0)) for k in range(1, 6)]
    segs = [(1, k, "Terreo", 0, 100.0, 100.0 * k + 3, 300.0, 100.0 * k + 3, 1.2) for k in (1, 2, 2, 4)]
    segs = [(p, i, *rest) for i, (p, _, *rest) in enumerate(segs)]
    df = spark.createDataFrame(segs, "project_id long, seq long, level string, page_index int, x1 double, y1 double, x2 double, y2 double, thickness_pct double")
    got = {r.seq: r.seg_seq for r in match.match_endpoints(walls_df(spark, rows), df).collect()}
    assert got == {1: 0, 2: 1, 4: 3}


def test_feedback(spark):
    projects = spark.createDataFrame([(1, "Acme"), (2, "Other")], "project_id long, client_name string")
    base = [(1, 10, 50, False, False, "external", "internal")]
    row = lambda i, user, action="correct", project=1, ex=False, cls="internal": (i, project, user, "w", "Terreo", 10, 50, False, False, "external", cls, action, ex, True)
    schema = "id long, project_id long, user_id long, wall_id string, level string, thickness_cm long, length_dm long, has_window boolean, has_door boolean, original_class string, corrected_class string, action string, is_exemplar boolean, active boolean"
    run = lambda rows: [(r.wall_class) for r in classify.feedback_override(walls_df(spark, [wall(1)]), spark.createDataFrame(rows, schema), projects).collect()]
    assert run([row(1, 5), row(2, 5)]) == ["external"]
    assert run([row(1, 5), row(2, 6)]) == ["internal"]
    assert run([row(1, 5), row(2, 6, project=2)]) == ["external"]
    assert run([row(1, 5, ex=True, project=2)]) == ["internal"]
    assert run([row(1, 5, "not_wall"), row(2, 6, "not_wall")]) == []
    assert run([row(1, 5), row(2, 6, "not_wall"), row(3, 7, "not_wall")]) == ["external"]  # the higher tier misses its quorum
    assert base


def test_gate_and_costs(spark):
    truth = [("A", c, t) for c, t in zip(score.REAL, (384.3, 128.1, 0.0, 201.3, 219.6), strict=True)] + [("B", c, None) for c in score.REAL]
    found = [("A", c, t) for c, t in zip(score.REAL, (400.0, 100.0, 0.0, 201.3, 250.0), strict=True)]
    got = {r.fixture: r for r in score.accuracy_gate(spark.createDataFrame(found, "fixture string, category string, actual_m2 double"), spark.createDataFrame(truth, "fixture string, category string, truth_m2 double")).collect()}
    assert (got["A"].status, got["A"].overall, got["A"].worst) == ("PASS", 92.0497, 78.064) and got["B"].status == "SKIP"
    runs = spark.createDataFrame([(1, "gemini-2.5-pro", 1000, 500, 2000), (2, "openai:gpt-4o-mini", 10000, 2000, 0), (3, "x", 1, 1, 1)], "id long, model string, in_tokens long, out_tokens long, think_tokens long")
    assert [r.cost_usd for r in telemetry.ai_cost(runs).orderBy("id").collect()] == [0.01375, 0.0027, None]


def test_infer_slabs(spark):
    w = [wall(k, 10.0) for k in range(4)] + [wall(10 + k, 200.0, level="1 Pavimento") for k in range(2)]
    none = spark.createDataFrame([], "project_id long, seq long, slab_id string, level string, slab_class string, area_m2 double, source string, confidence double")
    got = {(r.level, r.slab_class): r.area_m2 for r in fuse.infer_slabs(walls_df(spark, w), none).collect()}
    # the upper perimeter is too long to be true, so its floor borrows what the ground floor got
    assert got == {("Terreo", "floor"): 100.0, ("Terreo", "raft"): 100.0, ("1 Pavimento", "floor"): 100.0, ("1 Pavimento", "roof"): 100.0}


def test_page_edits(spark):
    columns = "project_id long, file_seq int, page_index int, level string, ext_gross double, ext_open double, ext_net double, int_gross double, int_open double, int_net double, boundary_gross double, floor_m2 double, roof_m2 double, section_height double"
    rows = [(1, f, p, "", 10.0, 0.0, 10.0, 0.0, 0.0, 0.0, 0.0, 5.0, 0.0, 2.7 if (f, p) == (1, 0) else None) for f in (0, 1) for p in (0, 1)]
    pages, totals = areas.consolidate_files(spark.createDataFrame(rows, columns))
    assert sorted(r.page for r in pages.collect()) == [0, 1, 2, 3] and totals.first().section_height == 2.7
    edits = spark.createDataFrame([(1, 2, -3.0), (1, 3, None)], "project_id long, page long, ext_gross double")
    assert areas.apply_page_edits(pages, edits)[1].first().ext_gross == 30.0


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "project_id long, name string")
    io.export_tables({"summary": df}, str(tmp_path / "t"))
    assert spark.read.option("header", True).csv(str(tmp_path / "t/summary")).count() == 2
    io.write_budget_json(df, str(tmp_path / "j"))
    assert {r.name for r in spark.read.json(str(tmp_path / "j")).collect()} == {"a", "b"}
    (tmp_path / "p.csv").write_text('d,h,p\n"Painel ""X""",SP,"1.234,5"\nY,SP,"10,5"\nZ,,3\nQ,SP,0\n', encoding="utf-8")
    got = io.read_price_sheet(spark, str(tmp_path / "p.csv")).collect()
    assert ("Y", "SP", 10.5) in [tuple(r) for r in got] and len(got) == 2


def test_audit_notes(spark):
    rows = [wall(1, 2.0, 2.0, area=5.0), wall(2, 2.0, 2.0, area=3.6), wall(3, 4.0, 9.0), wall(4, 4.0, 3.0, thickness=0.04)]
    projects = spark.createDataFrame([(1, None), (2, None)], "project_id long, building_type string")
    slabs = spark.createDataFrame([], "project_id long, seq long, slab_id string, level string, slab_class string, area_m2 double")
    env = spark.createDataFrame([], "project_id long, level string, polygon array<struct<x:double,y:double>>, confidence double")
    ranges = clean.clean_ranges(spark.createDataFrame([], "project_id long, typology string, standard string, ceiling_low double, ceiling_high double, thickness_low double, thickness_high double, walls_low double, walls_high double, openings_low double, openings_high double, notes string"))
    got = sorted((r.project_id, r.code) for r in audit.self_check(walls_df(spark, rows), slabs, env, ranges, projects).collect())
    assert got == sorted([(1, "OPENING_OVER_WALL"), (1, "OPENING_NEAR_WALL_LIMIT"), (1, "CEILING_HIGH"), (1, "WALL_THIN"), (1, "EXT_INT_RATIO"), (2, "NO_EXTERNAL")])


EVENT = "id long, project_id long, kind string, stage string, phase string, call_id long, in_tokens long, created_at timestamp"


def events(spark):
    rng = random.Random(2)
    rows = []
    for i in range(200):
        minute = i // 4
        rows.append((i, i % 5, rng.choice(["stage", "ai_call", "audit", "page_split"]), f"s{i % 3}", rng.choice(["started", "completed", "failed"]), i // 2, i, f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:{i % 60:02d}"))
    df = spark.createDataFrame(rows, "id long, project_id long, kind string, stage string, phase string, call_id long, in_tokens long, created_at string")
    return df.withColumn("created_at", F.to_timestamp("created_at"))


def test_stream_sink(spark, tmp_path):
    folder = str(tmp_path / "in")
    events(spark).write.parquet(folder)
    streams.events_sink(spark.readStream.schema(EVENT).parquet(folder), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == clean.persistable(events(spark)).count()


