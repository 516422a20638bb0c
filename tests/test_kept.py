"""Whole answers as variants, sketches of votes, decisions joined in parts."""

import json
import random

from pyspark.sql import functions as F

from quantity_jobs.operators import classify
from quantity_jobs.sources import io


def test_documents_come_back_whole(spark):
    answer = {"walls": [{"wall_id": "a", "length_m": "long", "new": {"deep": [1, None, "x"]}}], "unknown": [1.5, True], "n": 3}
    rows = [json.dumps(answer), json.dumps([{"wall_id": "b", "length_m": 2.0, "more": 1}]), '{"walls": [{"wall_id": "c", "length_m": 1.0}], "x": 1} trailing', '{"walls": [{"wall_id": "d", "z": 9},], "y": [2', "none", None]
    out = io.recover_json(spark.createDataFrame(list(enumerate(rows)), "seq long, data string").withColumn("project_id", F.lit(1)), "walls array<struct<wall_id: string, length_m: double>>")
    got = {r.seq: r for r in out.select("seq", "outcome", "parsed", F.to_json("document").alias("document")).collect()}
    assert [got[k].outcome for k in range(6)] == ["strict", "strict", "repaired", "repaired", "quarantine", "empty"]
    assert json.loads(got[0].document) == answer and json.loads(got[1].document) == {"walls": [{"wall_id": "b", "length_m": 2.0, "more": 1}]}
    assert json.loads(got[2].document)["x"] == 1 and json.loads(got[3].document) == {"walls": [{"wall_id": "d", "z": 9}], "y": [2]}
    assert got[4].document is None and got[5].document is None and got[1].parsed.walls[0].length_m == 2.0


FEEDBACK = "id long, project_id long, user_id long, thickness_cm long, length_dm long, has_window boolean, has_door boolean, original_class string, corrected_class string, action string, is_exemplar boolean, active boolean"


def test_vote_sketches(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(4), rng.randrange(3000), 10, rng.choice([20, 30]), False, False, "external", rng.choice(["internal", "internal", "boundary"]), "correct", False, True) for k in range(20_000)]
    feedback = spark.createDataFrame(rows, FEEDBACK)
    projects = spark.createDataFrame([(p, f"Client {p % 2}") for p in range(4)], "project_id long, client_name string")
    exact = {(r.client, r.signature): r for r in classify.feedback_vote(feedback, projects).collect()}
    day = F.col("id") % 30
    sketches = classify.vote_sketches(feedback.filter(day < 20), projects, day).unionByName(classify.vote_sketches(feedback.filter(day >= 20), projects, day))
    close = {(r.client, r.signature): r for r in classify.vote_by_sketches(sketches).collect()}
    assert exact.keys() == close.keys() and len(exact) == 4
    for key, r in exact.items():
        # three standard errors
        assert close[key].decision == r.decision and close[key].quorum and abs(close[key].voters - r.voters) <= 3 * 1.04 / 64 * r.voters


def test_override_in_parts(spark):
    """Decisions sent to all tasks and joined in parts give the same walls."""
    rng = random.Random(4)
    walls = [(k % 3, k, "client", rng.choice(["external", "internal"]), 0.1, rng.choice([2.0, 2.0, 2.0, 3.0]), False, False, "ai", 0.5) for k in range(400)]
    df = spark.createDataFrame(walls, "project_id long, seq long, name string, wall_class string, thickness_m double, length_m double, has_window boolean, has_door boolean, source string, confidence double")
    feedback = [(k, 0, k, 10, 20, False, False, "external", "internal", "correct", False, True) for k in range(3)] + [(10 + k, 0, k, 10, 30, False, False, "internal", None, "not_wall", False, True) for k in range(2)] + [(20, 1, 1, 10, 20, False, False, "internal", "boundary", "exemplar", True, True)]
    projects = spark.createDataFrame([(0, "A"), (1, "B"), (2, "a ")], "project_id long, client_name string")
    one, two = (sorted(map(tuple, classify.feedback_override(df, spark.createDataFrame(feedback, FEEDBACK), projects, few).collect()), key=repr) for few in (1000, 0))
    assert one == two and 0 < len(one) < 400
    assert {r[3] for r in one if r[5] == 2.0 and r[0] != 1} == {"internal", "boundary"}
