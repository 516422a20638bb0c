"""Small groups are looked through whole; larger ones take the general way, with the same results."""

import random

from quantity_jobs.operators import clean, match, rounds


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_both_ways(spark, monkeypatch):
    rng = random.Random(4)
    marks = [(g, k, float(rng.randrange(30)), float(rng.randrange(900)), f"m{g}-{k}") for g in (1, 2) for k in range(20 * g)]
    points = [(g, k, float(rng.randrange(1000)), float(rng.randrange(1000))) for g in (1, 2, 3) for k in range(50)]
    args = spark.createDataFrame(points, "g int, id long, px double, py double"), spark.createDataFrame(marks, "g int, seq long, x double, y double, what string"), ["g"], ["id"], "what", 7.0
    by_rings, mixed = (sorted(map(tuple, rounds.nearest(*args, few=few).collect())) for few in (0, 30))
    cuts = []
    monkeypatch.setattr(rounds, "cut", lambda df: cuts.append(1) or df.localCheckpoint())
    whole = sorted(map(tuple, rounds.nearest(*args).collect()))
    assert whole == by_rings == mixed and len(whole) == 100
    assert len(cuts) == 1  # the marks; no ring


def test_raycast_both_ways(spark):
    rng = random.Random(6)
    rows = []
    for page, n in ((0, 8), (1, 60)):
        for k in range(n):
            x, y, w = rng.uniform(0, 1000), rng.uniform(0, 1000), rng.uniform(20, 300)
            rows.append((1, page, k, x, y, *((x + w, y) if k % 2 else (x, y + w)), 4.0, 0.1))
    lines = spark.createDataFrame(rows, "project_id long, page_index int, seq long, x1 double, y1 double, x2 double, y2 double, thickness double, eps double")
    whole = match.raycast_class(lines)
    assert plan(whole).count("Generate") == 1  # both sides of a line; no cells
    found = [sorted(map(tuple, df.collect())) for df in (whole, match.raycast_class(lines, few=20), match.raycast_class(lines, few=0))]
    assert found[0] == found[1] == found[2] and {r[3] for r in found[0]} == {"external", "internal"}


def test_classify_text_reads_a_text_once(spark):
    """What is read of a text is computed once, not again for each word that it is held against."""
    tokens = spark.createDataFrame([(1, "SALA  de Estar"), (2, " 3,50 m"), (3, None)], "seq int, text string").repartition(1)
    got = clean.classify_text(tokens)
    assert plan(got).count("regexp_replace") + plan(got).count("RegExpReplace") <= 4
    assert [tuple(r)[2:] for r in got.orderBy("seq").collect()] == [("room_label", "internal", None), ("dimension", None, 3.5), ("other", None, None)]
    assert got.columns == ["seq", "text", "text_class", "room_type", "dimension_m"]
