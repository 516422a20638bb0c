"""Choices in rounds against plain scans; tail=0 keeps the rounds from handing the rest to one task."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quantity_jobs.operators import fuse, kernels, match, rounds

TAILS = [0, 40, rounds.TAIL]


def scan(edges, shared=False):
    """edges: (group, order, left, right)."""
    left, out = set(), []
    right = left if shared else set()
    for g, _, a, b in sorted(edges):
        if (g, a) not in left and (g, b) not in right:
            left.add((g, a))
            right.add((g, b))
            out.append((g, a, b))
    return sorted(out)


@pytest.mark.parametrize("tail", TAILS)
def test_dominant_pairs(spark, tail):
    rng = random.Random(tail)
    edges = [(rng.randrange(3), rng.randrange(6), rng.randrange(30), rng.randrange(30)) for _ in range(500)]
    df = spark.createDataFrame(edges + edges[:20], "g int, o int, a long, b long").withColumn("w", F.col("o") * 2)
    got = rounds.dominant_pairs(df, ["g"], "a", "b", [F.col("o")], ["w"], tail=tail)
    assert sorted(tuple(r)[:3] for r in got.collect()) == scan(edges)
    pairs = [e for e in edges if e[2] < e[3]]
    got = rounds.dominant_pairs(df.filter("a < b"), ["g"], "a", "b", [F.col("o")], shared=True, tail=tail)
    assert sorted(map(tuple, got.collect())) == scan(pairs, shared=True)
    assert rounds.dominant_pairs(df.filter("false"), ["g"], "a", "b", [F.col("o")], tail=tail).count() == 0


@pytest.mark.parametrize("tail", TAILS)
def test_deferred_choice(spark, tail):
    rng = random.Random(tail + 1)
    edges = [(rng.randrange(2), (a := rng.randrange(60), rng.randrange(6)), a, rng.randrange(40)) for _ in range(600)]
    rows = [(g, o[1], a, b) for g, o, a, b in edges]
    got = rounds.deferred_choice(spark.createDataFrame(rows + rows[:9], "g int, o int, a long, b long"), ["g"], "a", "b", [F.col("o")], ["o"], tail=tail)
    assert sorted(tuple(r)[:3] for r in got.collect()) == scan(edges)


def test_deferred_choice_of_one_large_project(spark):
    """10,000 walls of one project want the same few segments; no task gets the project."""
    rng = random.Random(5)
    rows = [(1, a, (b := int(rng.paretovariate(0.6)) % 3000), abs(b - a % 7)) for a in range(10_000) for _ in range(3)]
    got = rounds.deferred_choice(spark.createDataFrame(rows, "g int, a long, b long, o int"), ["g"], "a", "b", [F.col("o")], tail=2_000)
    assert sorted(map(tuple, got.collect())) == scan([(g, (a, o), a, b) for g, a, b, o in rows])


def test_small_groups_need_no_rounds(spark, monkeypatch):
    """Chains of a hundred groups, which are more than the tail only together: one cut for the candidates and one for the large groups, of which there are none."""
    cuts = []
    monkeypatch.setattr(rounds, "cut", lambda df: cuts.append(1) or df.localCheckpoint())
    rows = [(g, a, b, 0) for g in range(100) for a in range(20) for b in range(a + 1)]
    got = rounds.deferred_choice(spark.createDataFrame(rows, "g int, a long, b long, o int"), ["g"], "a", "b", [-F.col("b")], tail=1_000)
    assert sorted(map(tuple, got.collect())) == scan([(g, (a, -b), a, b) for g, a, b, _ in rows])
    assert len(cuts) == 2


@pytest.mark.parametrize("tail", TAILS)
def test_first_independent(spark, tail):
    rng = random.Random(tail + 2)
    edges = sorted({(rng.randrange(2), a, rng.randrange(a + 1, 90)) for a in (rng.randrange(80) for _ in range(400))})
    gone = set()
    for g, a, b in edges:
        if (g, a) not in gone:
            gone.add((g, b))
    got = rounds.first_independent(spark.createDataFrame(edges, "g int, a long, b long"), ["g"], [F.col("a")], tail=tail)
    assert {tuple(r) for r in got.collect()} == gone


@pytest.mark.parametrize("tail", TAILS)
def test_components(spark, tail):
    rng = random.Random(tail + 3)
    links = [(1, k, k + 1) for k in range(40)] + [(2, rng.randrange(100), rng.randrange(100)) for _ in range(70)] + [(3, 5, 5), (3, 9, 7), (3, 9, 8)]
    low = {}
    for _ in range(100):
        for g, a, b in links:
            if a != b:
                m = min(low.get((g, a), a), low.get((g, b), b))
                low[g, a] = low[g, b] = m
    got = rounds.components(spark.createDataFrame(links, "g int, a long, b long"), ["g"], tail=tail)
    assert {(r.g, r.id): r.component for r in got.collect()} == low


def test_suppress_in_one_hot_group(spark):
    """Thousands of slabs of one level and class, many with equal areas."""
    rng = random.Random(8)
    rows = [(1, "A", "floor", k, rng.choice([10.0, 20.0, round(rng.uniform(1, 400), 1)]), rng.choice([0.5, 0.9])) for k in range(3000)]
    rows += [(2, "A", "roof", k, a, 0.5) for k, a in enumerate([0.0, 0.0, -3.0, 5.0, 5.1])] + [(3, "A", "roof", 1, None, 0.5), (3, "A", "roof", 2, 7.0, None)]
    got = {(r.project_id, r.seq) for r in fuse.suppress_similar_slabs(spark.createDataFrame(rows, "project_id long, level string, slab_class string, seq long, area_m2 double, confidence double")).collect()}
    want = {(3, 1), (3, 2)}
    for project in (1, 2):
        kept = []
        for _, _, _, seq, area, _ in sorted((r for r in rows if r[0] == project), key=lambda r: (-r[5], -r[4], r[3])):
            if not any(max(area, x) > 0 and abs(area - x) / max(area, x) <= 0.3 for x in kept):
                kept.append(area)
                want.add((project, seq))
    assert got == want


def test_merge_touching_page(spark):
    """A page of many lines; what one task fuses is a group of touching lines."""
    rng = random.Random(2)
    rows = []
    for k in range(3000):
        x, y = (k % 60) * 100 + rng.random() * 20, (k // 60) * 100 + rng.random() * 20
        turn = rng.choice([0.0, math.pi / 2])
        rows.append((1, 0, k, x, y, x + 90 * math.cos(turn), y + 90 * math.sin(turn)))
    got = match.merge_touching(spark.createDataFrame(rows, "project_id long, page_index int, seq long, x1 double, y1 double, x2 double, y2 double")).collect()
    want = kernels.fuse_touching([[*r[3:], 1] for r in rows], 8.0, 12.0)
    assert sum(r.members for r in got) == 3000
    assert sorted(tuple(round(v, 6) for v in (r.x1, r.y1, r.x2, r.y2, r.members)) for r in got) == sorted(tuple(round(v, 6) for v in w) for w in want)


def test_nearest(spark):
    """Near and far marks, ties, marks at one place, groups without marks."""
    rng = random.Random(9)
    marks = [(g, k, float(rng.choice([rng.randrange(40), rng.randrange(900, 940), 500])), float(rng.randrange(1000)), f"m{g}-{k}") for g in (1, 2) for k in range(60)] + [(3, 5, 1e5, -1e5, "far"), (1, 99, None, 1.0, "none")]
    marks += [(1, 200 + k, marks[0][2], marks[0][3], f"same {k}") for k in range(50)]
    points = [(g, k, float(rng.randrange(1000)), float(rng.randrange(-500, 1000))) for g in (1, 2, 3, 4) for k in range(80)] + [(1, 900, None, 1.0)]
    got = rounds.nearest(spark.createDataFrame(points, "g int, id long, px double, py double"), spark.createDataFrame(marks, "g int, seq long, x double, y double, what string"), ["g"], ["id"], "what", 7.0)
    want = {}
    for g, i, px, py in points:
        own = [((x - px) ** 2 + (y - py) ** 2, s, w) for h, s, x, y, w in marks if h == g and x is not None and px is not None]
        if own:
            want[g, i] = min(own)[2]
    assert {(r.g, r.id): r.what for r in got.collect()} == want and len(want) == 240
