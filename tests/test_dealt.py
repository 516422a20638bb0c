"""Tables dealt by project once are read as they lie."""

import random

from pyspark.sql import functions as F

from quantity_jobs.operators import fuse
from quantity_jobs.plans import pipelines, queries_fuse, testdata
from quantity_jobs.plans.testdata import Tables
from quantity_jobs.sources.io import as_they_lie, dealt

SMALL = "/root/testdata/sf0.001"


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_walls_are_dealt_once(spark):
    """By supplier, which is by project: what comes after needs no second shuffle."""
    assert shuffles(Tables(spark, SMALL)("walls").groupBy("project_id").count()) == 1


def test_joins_of_dealt_tables(spark):
    rows = [(p, k, f"w{p}-{k}") for p in range(20) for k in range(30)]
    first, more = (spark.createDataFrame(part, "project_id long, seq long, wall_id string") for part in (rows[:500], rows[500:]))
    with as_they_lie(spark):
        own = dealt("walls", first, more.drop("wall_id"))
        other = dealt("walls", first.selectExpr("project_id", "seq", "upper(wall_id) AS name"))
        joined = own.hint("merge").join(other, ["project_id", "seq"], "left")
        assert shuffles(joined) == 0
        got = sorted((r.project_id, r.seq, r.wall_id, r.name) for r in joined.collect())
    assert got == [(p, k, w if i < 500 else None, w.upper() if i < 500 else None) for i, (p, k, w) in enumerate(rows)]
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_fusion_reads_line_items_once(spark, monkeypatch):
    """They are the largest table, and each reading of them is a shuffle of them."""
    read = []
    raw = Tables.raw
    monkeypatch.setattr(Tables, "raw", lambda self, name: read.append(name) or raw(self, name))
    given = []

    def fuse_views(*tables):
        given.extend(tables)
        return tables[0].withColumn("needs_review", tables[0].has_door), tables[1]

    monkeypatch.setattr(pipelines, "fuse_views", fuse_views)
    queries_fuse.fusion(Tables(spark, SMALL))
    assert read.count("lineitem") == 1
    fresh = Tables(spark, SMALL)
    for kept, own in ((given[0], fresh.walls()), (given[6], fresh("feedback"))):
        assert kept.exceptAll(own).count() == own.exceptAll(kept).count() == 0 and own.count()


def test_add_schedule_walls(spark):
    """All columns, with what merge_schedule_walls gives in its own."""
    rng = random.Random(5)
    wall = lambda k, name: (rng.randrange(4), rng.choice(["A", "B", None]), rng.choice(["external", "internal"]), k, f"{name}{k}", rng.randrange(60) / 10, 2.5, rng.choice([0.1, None]))
    kind = "project_id long, level string, wall_class string, seq long, wall_id string, length_m double, height_m double, thickness_m double"
    walls = spark.createDataFrame([(*wall(k, "W"), "bim", 0.5, k % 3) for k in range(200)], kind + ", source string, confidence double, page_index int")
    sched = spark.createDataFrame([wall(k, "Q") for k in range(150)], kind)
    whole = fuse.merge_schedule_walls(walls, sched)
    with as_they_lie(spark):
        got = fuse.add_schedule_walls(walls, sched)
        assert sorted(got.columns) == sorted(walls.columns)
        assert sorted(map(str, got.select(whole.columns).collect())) == sorted(map(str, whole.collect()))
        rows = got.collect()
    assert {r.seq: r.page_index for r in rows if r.seq < 200} == {k: k % 3 for k in range(200)}
    added = [r for r in rows if r.seq >= 200]
    assert added and all(r.page_index is None and r.source == "table" for r in added)


def test_tasks_follow_the_rows(spark, monkeypatch):
    """More rows make more tasks, and adaptive execution doesn't put them together again."""
    monkeypatch.setattr(testdata, "TASK_ROWS", 6000, raising=False)
    setting = "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    try:
        rows = Tables(spark, "/root/testdata/sf0.01")("walls").select("project_id", "seq", F.spark_partition_id().alias("task"))
        sizes = [r["count"] for r in rows.groupBy("task").count().collect()]
    finally:
        spark.conf.set(setting, before)
    assert sum(sizes) == 60_000 and len(sizes) > int(before) and max(sizes) <= 15_000
