"""Rules with values worked out by hand, and order-dependent operators against plain loops."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from quantity_jobs.operators import areas, budget, clean, fuse, kernels, match, score, telemetry
from quantity_jobs.sources import io

SEGMENT = "project_id long, page_index int, seq long, x1 double, y1 double, x2 double, y2 double"


def test_classify_text(spark):
    cases = {
        "4,64m": ("dimension", None, 4.64),
        "35": ("dimension", None, 0.35),
        "350": ("other", None, None),
        "0": ("other", None, None),
        "JV 3": ("door_window_code", None, None),
        "P12": ("door_window_code", None, None),
        "P1234": ("other", None, None),
        "Suíte 1": ("room_label", "internal", None),
        "ÁREA DE  SERVIÇO": ("room_label", "internal", None),
        "Varandão": ("room_label", "covered", None),
        "Espelho d'água": ("room_label", "uncovered", None),
        "Prancha 2": ("title_block", None, None),
        "banana": ("title_block", None, None),
        "xyz": ("other", None, None),
        " ": ("other", None, None),
        None: ("other", None, None),
    }
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, text string")
    got = [(r.text_class, r.room_type, r.dimension_m) for r in clean.classify_text(df).orderBy("i").collect()]
    assert got == list(cases.values())


def test_infer_stage(spark):
    rows = [("stage", "4", None), ("audit", None, None), ("audit", "7", None), ("cv_substep", None, None), (None, None, "extractGeometry-v4"), ("ai_call", None, "globalValidation"), ("ai_call", None, "new"), ("ai_call", None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, kind string, stage string, prompt_version string")
    assert [r.stage_id for r in clean.infer_stage(df).orderBy("i").collect()] == ["4", "6.5", "7", "3.4", "3", "4.6", "?", "?"]


def test_clean_ranges(spark):
    schema = "project_id long, typology string, standard string, envelope_shape string, confidence string, levels array<string>, programme array<struct<room:string,qty:double>>, ceiling_low double, ceiling_high double, walls_low double, walls_high double, notes string"
    rows = [
        (1, "sobrado", "alto", "U", "high", ["Terreo", " ", "Superior"], [("  Sala ", 1.5), ("quarto", -2.0), (None, 1.0), ("wc", math.nan)], 2.6, 2.8, 900.0, 10.0, "n" * 700),
        (2, "residencial", "luxo", "round", "sure", [" "], None, 1.0, 2.8, None, 4.0, None),
    ]
    a, b = clean.clean_ranges(spark.createDataFrame(rows, schema)).orderBy("project_id").collect()
    assert (a.typology, a.standard, a.envelope_shape, a.confidence, a.levels) == ("sobrado", "alto", "U", "high", ["Terreo", "Superior"])
    assert [tuple(x) for x in a.programme] == [("sala", 2), ("quarto", 0)]
    # exchanged limits are not tested again
    assert (a.ceiling_low, a.ceiling_high, a.walls_low, a.walls_high, len(a.notes)) == (2.6, 2.8, 10.0, 900.0, 600)
    assert (b.typology, b.standard, b.envelope_shape, b.confidence, b.levels, b.programme) == ("outro", "medio", "retangular_simples", "low", ["Terreo"], [])
    assert (b.ceiling_low, b.ceiling_high, b.walls_low, b.walls_high, b.openings_low, b.area_high, b.thickness_low, b.has_roof) == (2.5, 3.0, 8.0, 25.0, 4.0, 200.0, 0.1, False)


def test_feedback_validate(spark):
    schema = "i int, project_id long, user_id long, wall_id string, action string, thickness_m double, length_m double, original_class string, corrected_class string, is_exemplar boolean"
    good = (1, 7, "w1", "correct", 0.146, 12.34, "external", "not_wall", True)
    rows = [good, (None, *good[1:]), (None, 8, *good[2:]), (1, 8, "w", "confirm", None, None, None, None, False), (1, 8, "w", "exemplar", 0.0, 1000.5, None, None, None)]
    rows += [(1, 7, "x" * 65, *good[3:]), (1, 7, "w", "correct", 10.1, 1.0, None, None, None), (1, 7, "w", "drop", 1.0, 1.0, None, None, None), (1, 7, "w", "correct", 1.0, -1.0, None, "slab", None)]
    users = spark.createDataFrame([(7, False), (8, True)], "user_id long, is_admin boolean")
    out = clean.feedback_validate(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema), users).orderBy("i").collect()
    assert [r.valid for r in out] == [True, False, True, True, False, False, False, False, False]
    assert [r.is_exemplar for r in out] == [False, False, True, False, True, False, False, False, False]
    assert (out[0].thickness_cm, out[0].length_dm, out[4].thickness_cm) == (15, 123, None)


def test_reliability(spark):
    rows = [(1, "ok")] * 10 + [(2, "retried")] * 6 + [(2, "ok")] * 4 + [(3, "failed")] * 5 + [(3, "ok")] * 5 + [(4, "rate_limited")] * 9 + [(4, "json_retry")] * 2 + [(5, "failed")] * 2
    runs = spark.createDataFrame(rows, "project_id long, status string")
    pages = spark.createDataFrame([(1,), (3,), (3,), (3,)], "project_id long")
    got = {r.project_id: (r.score, r.level) for r in telemetry.reliability_score(runs, pages, spark.createDataFrame([(k,) for k in range(1, 7)], "project_id long")).collect()}
    assert got == {1: (90, "high"), 2: (75, "medium"), 3: (50, "medium"), 4: (70, "medium"), 5: (70, "medium"), 6: (100, "high")}


def test_corrections(spark):
    walls = spark.createDataFrame([(1, f"w{k}", 5.0, 3.0, "external") for k in range(6)], "project_id long, wall_id string, length_m double, height_m double, wall_class string")
    slabs = spark.createDataFrame([(1, f"s{k}", 20.0, "floor") for k in range(4)], "project_id long, slab_id string, area_m2 double, slab_class string")
    schema = "project_id long, element_id string, field string, number double, text string, confidence double, seq long"
    patch = lambda e, f, number=None, text=None, conf=0.7, seq=0: (1, e, f, number, text, conf, seq)
    on_walls = [
        patch("w0", "length", 80.0), patch("w1", "length", 50.0), patch("w1", "length", 7.0, seq=1), patch("w2", "height", 9.0), patch("w2", "height", 1.5), patch("w3", "class", text="floor"), patch("w3", "class", text="boundary"),
        patch("w4", "length", 6.0, seq=1), patch("w4", "remove", seq=2), patch("w4", "length", 8.0, seq=3), patch("w5", "length", 9.0, conf=0.69), patch("none", "remove"),
    ]
    on_slabs = [patch("s0", "area", 5000.0), patch("s1", "class", text="raft"), patch("s2", "remove"), patch("s3", "area", 5001.0), patch("s3", "class", text="external")]
    w, s, n = score.apply_corrections(walls, slabs, spark.createDataFrame(on_walls, schema), spark.createDataFrame(on_slabs, schema))
    assert {r.wall_id: (r.length_m, r.height_m, r.wall_class) for r in w.collect()} == {
        "w0": (5.0, 3.0, "external"), "w1": (7.0, 3.0, "external"), "w2": (5.0, 1.5, "external"), "w3": (5.0, 3.0, "boundary"), "w5": (5.0, 3.0, "external"),
    }
    assert {r.slab_id: (r.area_m2, r.slab_class) for r in s.collect()} == {"s0": (5000.0, "floor"), "s1": (20.0, "raft"), "s3": (20.0, "floor")}
    assert [tuple(r) for r in n.collect()] == [(1, 5, 2, 1, 1)]


def test_area_pages(spark):
    full = {
        "pavimento": "Superior", "paredes_externas": {"area_bruta_m2": "120.5", "area_aberturas_m2": 20, "area_liquida_m2": 99}, "paredes_internas": {"area_bruta_m2": "x"}, "muros": {"area_bruta_m2": 8, "altura_assumida_m": 0},
        "laje_piso_m2": 70, "laje_coberta_m2": None, "aberturas": [{"tipo": "porta", "parede": "interna", "largura_m": 0.8, "altura_m": 2}, {"tipo": "x", "area_m2": 3}, None], "confidence": "high", "observacoes": "o" * 600,
    }
    df = spark.createDataFrame([(1, 0, json.dumps(full)), (1, 1, "{}")], "project_id long, seq long, data string")
    a, b = io.read_area_pages(df).orderBy("seq").collect()
    assert (a.level, a.ext_gross, a.ext_open, a.ext_net, a.int_gross, a.boundary_gross, a.boundary_height, a.floor_m2, a.roof_m2, a.confidence, len(a.notes)) == ("Superior", 120.5, 20.0, 99.0, 0.0, 8.0, 2.0, 70.0, 0.0, "high", 500)
    assert [tuple(o) for o in a.openings] == [("door", "internal", 0.8, 2.0, 1.6), ("other", "external", 0.0, 0.0, 3.0)] and a.missing == []
    assert (b.level, b.boundary_height, b.confidence, b.openings, len(b.missing)) == ("Pavimento", 2.0, "low", [], 5)


PAGE = "project_id long, file_seq int, page_index int, level string, ext_gross double, ext_open double, ext_net double, int_gross double, int_open double, int_net double, boundary_gross double, boundary_height double, floor_m2 double, roof_m2 double, section_height double"


def test_synthetic_elements(spark):
    rows = [
        (1, 0, 0, "A", 54.0, 4.0, 50.0, 0.0, 0.0, 30.0, 10.0, 2.5, 40.0, 0.0, None), (1, 0, 1, "", 27.0, 0.0, 27.0, 0.0, 0.0, 0.0, 0.0, 2.0, 0.0, 9.0, 2.7), (1, 1, 0, "A", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 9.0, 0.0, 0.0, 9.0),
        (2, 0, 0, "B", 9.0, 0.0, 9.0, 0.0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, None),
    ]
    walls, slabs = clean.synthetic_elements(spark.createDataFrame(rows, PAGE))
    assert {(r.project_id, r.level, r.wall_class): (r.length_m, r.height_m, r.opening_area_m2) for r in walls.collect()} == {
        (1, "A", "external"): (20.0, 2.7, 4.0), (1, "A", "internal"): (11.11, 2.7, 0.0), (1, "A", "boundary"): (4.0, 2.5, 0.0), (1, "Pavimento 1", "external"): (10.0, 2.7, 0.0), (2, "B", "external"): (3.0, 3.0, 0.0),
    }
    assert sorted(tuple(r) for r in slabs.collect()) == [(1, "A", "floor", 40.0), (1, "Pavimento 1", "roof", 9.0)]


def test_page_numbers(spark):
    pages = spark.createDataFrame([(1, f, p, "A", *([0.0] * 10), None) for f, p in ((0, 0), (0, 1), (2, 0))], PAGE)
    files = spark.createDataFrame([(1, 0, 5), (1, 1, 3), (1, 2, 1)], "project_id long, file_seq int, page_count int")
    numbers = lambda df: sorted(r.page for r in df.collect())
    assert numbers(areas.consolidate_files(pages, files)[0]) == [0, 1, 8] and numbers(areas.consolidate_files(pages)[0]) == [0, 1, 2]


def test_levels_of_corners(spark):
    walls = spark.createDataFrame([(1, 1, "w", "A", "external", 5.0, 3.0, 0.0)], "project_id long, seq long, wall_id string, level string, wall_class string, length_m double, height_m double, opening_area_m2 double")
    slabs = spark.createDataFrame([(1, 1, "s", "B", "floor", 10.0)], "project_id long, seq long, slab_id string, level string, slab_class string, area_m2 double")
    corners = spark.createDataFrame([(1, level, 3) for level in "ABC"], "project_id long, level string, corner_count int")
    assert {(r.level, r.category) for r in budget.budget_by_level(walls, slabs, corners).collect()} == {("A", "external"), ("A", "corners"), ("B", "floor"), ("B", "corners")}


def test_null_codes(spark):
    opening = "array<struct<kind:string,code:string,width_m:double,height_m:double,sill_m:double,source:string>>"
    walls = spark.createDataFrame([(1, 1, [("door", "P1", 0.8, 2.1, None, "ai"), ("door", None, 0.8, 2.1, None, "ai")])], f"project_id long, seq long, openings {opening}")
    sched = spark.createDataFrame([(1, 1, None, 9.0, 9.0), (1, 2, "P1", 1.0, 2.2)], "project_id long, seq long, code string, width_m double, height_m double")
    assert [(o.width_m, o.source) for o in fuse.schedule_opening_dims(walls, sched).first().openings] == [(1.0, "table"), (0.8, "ai")]


def test_json_lists(spark):
    rows = ['[{"wall_id": "a"}, {"wall_id": "b"}]', '[{"wall_id": "a"}, {"wall_id": "b"}', '```json\n[{"wall_id": "a"},]\n```', '{"walls": [{"wall_id": "a"}]}', "[1"]
    out = io.recover_json(spark.createDataFrame([(1, i, t) for i, t in enumerate(rows)], "project_id long, seq long, data string"), "walls array<struct<wall_id: string>>").orderBy("seq").collect()
    assert [r.outcome for r in out[:4]] == ["strict", "repaired", "repaired", "strict"]
    assert [[w.wall_id for w in r.parsed.walls] for r in out[:4]] == [["a", "b"], ["a", "b"], ["a"], ["a"]]
    assert kernels.repair_json('[{"a": 1}, {"a": 2}]') == ('[{"a": 1}, {"a": 2}]', "repaired")


def random_lines(seed, n, size=300):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        x, y, reach = rng.randrange(0, size), rng.randrange(0, size), rng.randrange(0, 90)
        turn = rng.choice([0.0, math.pi / 2, rng.random() * math.pi])
        out.append((1, k % 2, k, float(x), float(y), x + reach * math.cos(turn), y + reach * math.sin(turn)))
    return out


def test_raycast(spark):
    rows = random_lines(3, 160)
    df = spark.createDataFrame(rows, SEGMENT).withColumns({"thickness": F.lit(4.0), "eps": F.lit(0.1)})
    want = {}
    for page in (0, 1):
        own = [r for r in rows if r[1] == page]
        xs, ys = [v for r in own for v in (r[3], r[5])], [v for r in own for v in (r[4], r[6])]
        reach = 1.5 * math.hypot(max(xs) - min(xs), max(ys) - min(ys))
        for _, _, seq, x1, y1, x2, y2 in own:
            n = math.hypot(x2 - x1, y2 - y1) or 1.0
            free = False
            for sign in (1, -1):
                nx, ny = sign * -(y2 - y1) / n, sign * (x2 - x1) / n
                sx, sy = (x1 + x2) / 2 + nx * 2.1, (y1 + y2) / 2 + ny * 2.1
                dx, dy = nx * (reach - 2.1), ny * (reach - 2.1)
                hit = False
                for _, _, o, a, b, c, d in own:
                    den = dx * (d - b) - dy * (c - a)
                    if o != seq and abs(den) >= 1e-9:
                        t, u = ((a - sx) * (d - b) - (b - sy) * (c - a)) / den, ((a - sx) * dy - (b - sy) * dx) / den
                        hit |= 0.001 < t < 0.999 and 0.001 < u < 0.999
                free |= not hit
            want[seq] = "external" if free else "internal"
    got = {r.seq: r.wall_class for r in match.raycast_class(df).collect()}
    assert got == want and set(want.values()) == {"external", "internal"}


def test_merge_collinear(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for k in range(400):
        x, y, n, slant = rng.randrange(0, 400), rng.choice([rng.uniform(-30, 60), rng.uniform(900, 940)]), rng.randrange(1, 40), rng.choice([0.0, rng.uniform(-1, 1)])
        rows.append((1, 0, k, float(x), y, float(x + n), y + slant))
    flat = sorted((r for r in rows if abs(r[5] - r[3]) >= abs(r[6] - r[4])), key=lambda r: (min(r[4], r[6]), r[3], r[2]))
    groups = []
    for _, _, _, x1, y1, x2, y2 in flat:
        g = groups[-1] if groups else None
        if g and abs(g[0] - (y1 + y2) / 2) <= 8 and x1 - g[2] <= 15:
            g[:] = [float(int(g[0])), min(g[1], x1), max(g[2], x2), g[3] + 1]
        else:
            groups.append([(y1 + y2) / 2, x1, x2, 1])
    want = sorted(map(tuple, groups))
    assert len(want) < 350
    for band in (64, 2, 0.5):  # runs within a band, over bands, and bands between the lines of one run
        monkeypatch.setattr(match, "BAND", band)
        got = match.merge_collinear(spark.createDataFrame(rows, SEGMENT).repartition(3)).filter("flat").collect()
        assert sorted((r.line, r.start, r.end, r.members) for r in got) == want
    alone = match.merge_collinear(spark.createDataFrame([(None, 0, *r[2:]) for r in rows], SEGMENT)).filter("flat").collect()
    assert sorted((r.line, r.start, r.end, r.members) for r in alone) == want
    # worked by hand: the smaller end decides the order, and the running line loses its fraction once it has grown
    rows = [(1, 0, 1, 0.0, 100.5, 10.0, 100.5), (1, 0, 2, 12.0, 108.4, 20.0, 108.4), (1, 0, 3, 22.0, 108.45, 30.0, 108.45)]
    assert [(r.line, r.members) for r in match.merge_collinear(spark.createDataFrame(rows, SEGMENT)).orderBy("line").collect()] == [(100.0, 2), (108.45, 1)]


def test_merge_touching(spark):
    rows = random_lines(8, 90, 120)
    direction = lambda z: math.degrees(math.atan2(z[3] - z[1], z[2] - z[0])) % 180
    ends = lambda z: ((z[0], z[1]), (z[2], z[3]))
    want = []
    for page in (0, 1):
        own, used = [list(r[3:]) for r in rows if r[1] == page], set()
        for i, s in enumerate(own):
            if i in used:
                continue
            used.add(i)
            now, n, changed = s, 1, True
            while changed:
                changed = False
                for j, t in enumerate(own):
                    if j in used:
                        continue
                    turn = abs(direction(now) - direction(t))
                    turn = 180 - turn if turn > 90 else turn
                    if turn <= 8 and min(math.dist(p, q) for p in ends(now) for q in ends(t)) < 12:
                        points = [*ends(now), *ends(t)]
                        far, best = 0.0, (0, 1)
                        for a in range(4):
                            for b in range(a + 1, 4):
                                if math.dist(points[a], points[b]) > far:
                                    far, best = math.dist(points[a], points[b]), (a, b)
                        now, n, changed = [*points[best[0]], *points[best[1]]], n + 1, True
                        used.add(j)
            want.append((page, *(round(v, 6) for v in now), n))
    got = match.merge_touching(spark.createDataFrame(rows, SEGMENT)).collect()
    assert sorted((r.page_index, *(round(v, 6) for v in (r.x1, r.y1, r.x2, r.y2)), r.members) for r in got) == sorted(want) and len(want) < 90


def test_dedup_wall_lines(spark):
    rng = random.Random(6)
    rows = []
    for k in range(150):
        x, y, n, flat = rng.randrange(0, 200), rng.randrange(0, 60) / 4, rng.randrange(5, 80), rng.random() < 0.7
        rows.append((1, 0, k, float(x), y, float(x + (n if flat else 0)), y + (0 if flat else n), float(rng.randrange(1, 9))))
    perp = 0.08 * 0.6 * 14.17
    kept = []
    for r in sorted(rows, key=lambda r: (-r[7], r[2])):
        _, _, _, x1, y1, x2, y2, _ = r
        gone = False
        for k in kept:
            a1, b1, a2, b2 = k[3:7]
            n = math.hypot(a2 - a1, b2 - b1)
            ux, uy = (a2 - a1) / n, (b2 - b1) / n
            turn = abs(math.degrees(math.atan2(y2 - y1, x2 - x1)) - math.degrees(math.atan2(b2 - b1, a2 - a1))) % 180
            off = [abs(-(x - a1) * uy + (y - b1) * ux) for x, y in ((x1, y1), (x2, y2))]
            t = [(x - a1) * ux + (y - b1) * uy for x, y in ((x1, y1), (x2, y2))]
            over = max(0.0, min(n, max(t)) - max(0.0, min(t)))
            gone |= min(turn, 180 - turn) <= 5 and max(off) <= perp and over / min(n, math.hypot(x2 - x1, y2 - y1)) >= 0.5
        if not gone:
            kept.append(r)
    got = match.dedup_wall_lines(spark.createDataFrame(rows, SEGMENT + ", length_m double")).collect()
    assert sorted(r.seq for r in got) == sorted(r[2] for r in kept) and len(kept) < 140


BOXED = "project_id long, seq long, level string, wall_class string, length_m double, confidence double, source string, bbox struct<ymin:double,xmin:double,ymax:double,xmax:double>"


def boxed(spark, seed, n):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        x, y, w = rng.randrange(0, 300), rng.randrange(0, 300), rng.randrange(20, 120)
        box = (float(y), float(x), float(y + 6), float(x + w)) if rng.random() < 0.5 else (float(y), float(x), float(y + w), float(x + 6))
        rows.append((1, k, rng.choice(["", "Terreo", "Superior"]), rng.choice(["external", "internal"]), rng.randrange(1, 60) / 10, 0.5, "ai", box))
    return rows, spark.createDataFrame(rows, BOXED)


def test_match_dimensions(spark):
    rows, walls = boxed(spark, 1, 60)
    rng = random.Random(2)
    dims = [(1, k, rng.choice(["terreo", "Superior"]), rng.randrange(2, 60) / 10, float(rng.randrange(0, 350)), float(rng.randrange(0, 350)), rng.choice(["horizontal", "vertical", "unknown"])) for k in range(80)]
    df = spark.createDataFrame(dims, "project_id long, seq long, level string, value_m double, x double, y double, orientation string")
    used, want = set(), []
    for _, seq, level, _, length, _, _, (y0, x0, y1, x1) in rows:
        w, h = x1 - x0, y1 - y0
        way = "horizontal" if w > h * 1.5 else "vertical" if h > w * 1.5 else None
        reach = min(180, max(60, 0.6 * max(w, h)))
        found = []
        for _, d, dl, value, x, y, o in dims:
            near = math.hypot(x - (x0 + x1) / 2, y - (y0 + y1) / 2)
            fits = 0.4 <= value / length <= 2.5 if length > 0.2 else 0.5 <= value <= 25
            if way and d not in used and dl.lower() == (level or "Terreo").lower() and near <= reach and fits and o in (way, "unknown"):
                found.append((round(near, 9), d, value))
        if found:
            _, d, value = min(found)
            used.add(d)
            want.append((seq, d, value))
    matched = match.match_dimensions(walls, df)
    assert sorted((r.seq, r.dim_seq, r.value_m) for r in matched.collect()) == sorted(want) and want
    applied = {r.seq: r for r in match.apply_dimensions(walls, matched).collect()}
    lengths = {s: v for s, _, v in want}
    assert all((applied[s].length_m, applied[s].source, applied[s].confidence) == ((lengths[s], "dimension_text", 0.92) if s in lengths else (length, "ai", 0.5)) for _, s, _, _, length, *_ in rows)


def test_reconcile_detectors(spark):
    (rows_a, a), (rows_b, b) = boxed(spark, 3, 50), boxed(spark, 4, 60)

    def iou(p, q):
        h, w = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
        common = max(0.0, h) * max(0.0, w)
        area = lambda z: (z[2] - z[0]) * (z[3] - z[1])
        return common / (area(p) + area(q) - common)

    level = lambda r: (r[2] or "Terreo").lower()
    pairs = []
    for x in rows_a:
        for y in rows_b:
            p, q = x[7], y[7]
            d = math.hypot((p[1] + p[3] - q[1] - q[3]) / 2, (p[0] + p[2] - q[0] - q[2]) / 2)
            if level(x) == level(y) and (iou(p, q) >= 0.4 or d < 50):
                pairs.append((-math.floor(iou(p, q) * 1e9 + 0.5) / 1e9, math.floor(d * 1e9 + 0.5) / 1e9, x[1], y[1]))
    left, right, want = set(), set(), set()
    classes = [{r[1]: r[3] for r in rows} for rows in (rows_a, rows_b)]
    for _, _, x, y in sorted(pairs):
        if x not in left and y not in right:
            left.add(x)
            right.add(y)
            want.add((x, y, "agree" if classes[0][x] == classes[1][y] else "disagree"))
    seen = {level(r) for r in rows_b}
    want |= {(r[1], None, "only_a") for r in rows_a if r[1] not in left and level(r) in seen} | {(None, r[1], "only_b") for r in rows_b if r[1] not in right}
    assert {tuple(r)[1:] for r in match.reconcile_detectors(a, b).collect()} == want


@pytest.mark.parametrize("n", [2, 3, 11, 40])
def test_detect_scale(spark, n):
    rng = random.Random(n)
    values = [float(rng.choice([10, 11, 12, 14, 20, 50, 90]) + rng.random()) for _ in range(n)]
    ordered = sorted(values)
    upper = lambda v: v[len(v) // 2]
    windows = [[r for r in ordered if 0 <= math.log(r) - math.log(low) <= math.log(1.15)] for low in ordered]
    best = max(windows, key=len)
    band = [r for r in ordered if 0.75 * upper(ordered) <= r <= 1.25 * upper(ordered)]
    want = (14.17, "default")
    if n >= 3 and len(best) >= 3 and len(best) / n >= 0.4:
        want = (upper(best), "cluster")
    elif n >= 3 and len(band) / n >= 0.55:
        want = (upper(band), "band")
    r = match.detect_scale(spark.createDataFrame([(1, 0, v) for v in values], "project_id long, page_index int, ratio double")).first()
    assert (r.scale, r.source, r.n) == (*want, n)


def test_merge_schedule_walls(spark):
    """Groups of several batches, groups without walls or without schedule rows, null levels."""
    rng = random.Random(7)
    level = lambda: rng.choice(["A", "B", None])
    cls = lambda: rng.choice(["external", "internal"])
    walls = [(p, level(), cls(), k, f"w{k}", rng.randrange(10, 60) / 10, 3.0, 0.1, "ai", 0.5) for k in range(150) for p in [rng.randrange(4)]]
    sched = [(p, level(), cls(), k, f"q{k}", rng.randrange(10, 90) / 10, 2.0 + k / 100, 0.2) for k in range(60) for p in [rng.randrange(1, 5)]]
    want = {}
    for w in walls:
        want.setdefault(w[:3], []).append(list(w))
    for s in sorted(sched, key=lambda r: r[3]):
        group = want.setdefault(s[:3], [])
        hit = next((w for w in group if abs(w[5] - s[5]) < 0.5), None)
        if hit is None:
            hit = [*s[:3], s[3] + (1 << 40), s[4], *s[5:], "table", 0.95]
            group.append(hit)
        hit[5:] = [*s[5:], "table", 0.95]
    columns = "project_id long, level string, wall_class string, seq long, wall_id string, length_m double, height_m double, thickness_m double"
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = fuse.merge_schedule_walls(spark.createDataFrame(walls, columns + ", source string, confidence double"), spark.createDataFrame(sched, columns)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(tuple, got), key=repr) == sorted((tuple(w) for g in want.values() for w in g), key=repr) and len(got) > 150
