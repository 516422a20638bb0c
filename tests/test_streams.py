"""Streams over files that arrive one after another: outcomes, bounded state, replays, restarts, late rows; tables kept in place."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quantity_jobs.operators import telemetry
from quantity_jobs.sources import buckets
from quantity_jobs.streaming import streams

EVENT = "id long, project_id long, kind string, stage string, phase string, call_id long, in_tokens long, created_at timestamp"
START = datetime(2024, 1, 1)


def at(minutes):
    return START + timedelta(minutes=minutes)


def files(spark, folder, *batches):
    for rows in batches:
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(str(folder))


def stream(spark, folder):
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(folder))


def many(seed=2, n=300, step=2):
    rng = random.Random(seed)
    return [(i, i % 5, rng.choice(["stage", "ai_call", "audit"]), f"s{i % 3}", rng.choice(["started", "completed", "failed"]), i // 2, i, at(i * step + rng.random())) for i in range(n)]


def test_folds_over_many_batches(spark, tmp_path):
    """Batches in order, some of them repeated at once, with runs that stop and go on."""
    rows = many()
    df = spark.createDataFrame(rows, EVENT)
    want = {
        "calls": telemetry.fold_calls(df).drop("events"),
        "stages": streams.fold_stages(streams.stages(df)),
        "totals": df.groupBy("project_id").agg(F.count(F.lit(1)).alias("events"), F.sum("in_tokens").alias("tokens"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at")),
    }
    for name in ("calls", "stages", "totals"):
        source = tmp_path / f"in-{name}"
        repeated = rows[90:100] if name != "totals" else []
        files(spark, source, rows[:100] + repeated)
        streams.run_fold(spark, name, stream(spark, source), str(tmp_path / name))
        files(spark, source, rows[100:200])
        streams.run_fold(spark, name, stream(spark, source), str(tmp_path / name))
        files(spark, source, rows[200:])
        got = streams.run_fold(spark, name, stream(spark, source), str(tmp_path / name)).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want[name].collect()), key=repr), name


def test_state_shrinks(spark, tmp_path):
    """Calls of hours that the watermark has passed leave the state."""
    early = [(i, 1, "ai_call", None, "started", i, 1, at(i % 50)) for i in range(200)]
    source = tmp_path / "in"
    files(spark, source, early)
    files(spark, source, [(1000, 1, "ai_call", None, "started", 1000, 1, at(600))])
    query = streams.upserted(streams.calls(stream(spark, source)), str(tmp_path / "table"), streams.CALL_KEYS, str(tmp_path / "state"))
    query.awaitTermination()
    held = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    assert max(held) >= 200 and held[-1] == 1
    assert streams.fold_calls(buckets.read_buckets(spark, str(tmp_path / "table"), streams.calls(stream(spark, source)).schema)).count() == 201


def test_late_rows_are_counted(spark, tmp_path):
    source = tmp_path / "in"
    files(spark, source, [(1, 1, "audit", None, None, 1, 1, at(0)), (2, 1, "audit", None, None, 1, 1, at(100))])
    files(spark, source, [(3, 1, "audit", None, None, 1, 7, at(101))])
    # a batch is held against the watermark that the batch before began with
    files(spark, source, [(4, 1, "audit", None, None, 1, 1, at(3)), (5, 1, "audit", None, None, 1, 1, at(95))])
    query = streams.to_folder(streams.event_rates(stream(spark, source), "5 minutes"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    # the late event would have been in two windows
    assert streams.late_rows(query) == 2
    out = {(r.start, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out == {(at(-5), 1), (at(0), 1)}


def test_stale_projects_restart(spark, tmp_path):
    """A timer set in one run fires in the next one, which starts from the checkpoint."""
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        streams.to_folder(streams.stale_by_timeout(stream(spark, source)), out, state).awaitTermination()
        return sorted((r.project_id, r.last_at) for r in spark.read.schema("project_id long, last_at timestamp").parquet(out).collect())

    # 1 is silent after a start, 2 has completed, 3 goes on
    files(spark, source, [(1, 1, "stage", "a", "started", 1, 0, at(0)), (2, 2, "stage", "a", "completed", 1, 0, at(0)), (3, 3, "stage", "a", "started", 1, 0, at(1)), (9, None, "stage", "a", "started", 1, 0, at(1))])
    assert run() == []
    files(spark, source, [(4, 3, "stage", "a", "started", 1, 0, at(9)), (5, 4, "stage", "a", "completed", 1, 0, at(21))])
    assert run() == []
    files(spark, source, [(6, 4, "stage", "a", "completed", 1, 0, at(25))])
    assert run() == [(1, at(0))]
    files(spark, source, [(7, 4, "stage", "a", "completed", 1, 0, at(60)), (8, 1, "stage", "b", "started", 1, 0, at(60))])
    assert run() == [(1, at(0)), (3, at(9))]
    files(spark, source, [(10, 4, "stage", "a", "completed", 1, 0, at(90))])
    assert run() == [(1, at(0)), (1, at(60)), (3, at(9))]


def names(folder):
    return {p.parent.name: {q.name for q in p.parent.glob("*.parquet")} for p in (folder / "data").rglob("*.parquet")}


def test_tables_in_place(spark, tmp_path):
    schema = "project_id long, seq long, x string"
    table = lambda rows: spark.createDataFrame(rows, schema)
    read = lambda: sorted(map(tuple, buckets.read_buckets(spark, str(tmp_path / "t"), table([]).schema).collect()), key=repr)
    path = str(tmp_path / "t")
    first = [(p, k, "old") for p in range(40) for k in range(3)] + [(None, 0, "old")]
    assert read() == [] and buckets.replace_in_place(table(first), path, "one") and read() == sorted(first, key=repr)
    before = names(tmp_path / "t")
    assert buckets.replace_in_place(table([(7, 9, "new"), (99, 1, "new"), (None, 5, "new")]), path, "two")
    want = [r for r in first if r[0] not in (7, None)] + [(7, 9, "new"), (99, 1, "new"), (None, 5, "new")]
    after = names(tmp_path / "t")
    assert read() == sorted(want, key=repr)
    # only the buckets of the three projects have other files
    changed = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(changed) <= 3 and set(before) <= set(after)
    # the same load again does nothing, whatever it holds
    assert not buckets.replace_in_place(table([(1, 1, "again")]), path, "two") and names(tmp_path / "t") == after and read() == sorted(want, key=repr)
    # by key: other rows of the project stay
    assert buckets.upsert_in_place(table([(8, 1, "up"), (8, 77, "up")]), path, ["project_id", "seq"], "three", ["project_id"])
    assert {(r[1], r[2]) for r in read() if r[0] == 8} == {(0, "old"), (1, "up"), (2, "old"), (77, "up")} and len(read()) == len(want) + 1
    assert buckets.upsert_in_place(table([]), path, ["project_id", "seq"], "four", ["project_id"]) and len(read()) == len(want) + 1
