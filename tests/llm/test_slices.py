"""Helpers that read Arrow's buffers, fed with slices of longer arrays."""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quantity_jobs.llm import line_dedup, shared

TEXTS = ["one  two", "", "Three\nfour", "five", "Six seven eight", " nine ", "ten\n\nten"]


def test_helpers_on_slices():
    whole = pa.array(TEXTS)
    for first in range(len(TEXTS)):
        for last in range(first, len(TEXTS) + 1):
            part, own = whole.slice(first, last - first), TEXTS[first:last]
            assert shared.slices(part) == [t.encode() for t in own]
            offsets, raw = shared.own_bytes(part)
            assert raw == "".join(own).encode() and offsets[0] == 0
            flat, counts = shared.split_words(part, shared.LOWER_AZ)
            assert flat.to_pylist() == [w for t in own for w in t.lower().split()] and counts.tolist() == [len(t.split()) for t in own]
            assert shared.hashed_words(part, shared.LOWER_AZ)[1].tolist() == counts.tolist()
            keys, _, codes, lines = line_dedup.keyed_lines(part, 1)
            assert [keys[c].as_py() for c in codes] == [x.strip().lower() for t in own for x in t.split("\n")]
            assert lines.tolist() == [t.count("\n") + 1 for t in own]


def test_text_runs_on_slices():
    batch = pa.record_batch({"x": range(7), "text": [*TEXTS[:3], None, *TEXTS[4:]]})
    for first in range(7):
        part = batch.slice(first, 7 - first)
        for most in (1, 9, 1 << 20):
            out = [(at, t) for at, run in shared.text_runs(part, "text", most) for t in run.to_pylist()]
            assert [t for _, t in out] == [t or "" for t in part.column(1).to_pylist()]
            assert all(run.offset == 0 for _, run in shared.text_runs(part, "text", most))


def test_equal_lengths_on_slices():
    column = pa.array([[1.0, 2.0], None, [], [3.0, None], [4.0], [5.0, 6.0]], pa.list_(pa.float32()))
    found = {n: (rows.tolist(), m.tolist()) for n, rows, m in shared.equal_lengths(column.slice(1, 5))}
    assert found[1] == ([3], [[4.0]]) and found[2][0] == [2, 4] and found[2][1][1] == [5.0, 6.0] and np.isnan(found[2][1][0][1])


def test_both_paths_on_several_batches(spark):
    """The keys sent to all tasks and the join of suspected lines give the same texts, with many Arrow batches in a task."""
    rows = [(i, "\n".join(["Shared line", *[f"own {i} {k}" for k in range(i % 4)], f"few {i % 7}", "Shared line" if i % 3 else "keep me"])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("other", F.lit("x")).coalesce(2)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
        for keep in ("none", "first"):
            one, two = (Counter(map(tuple, line_dedup.dedup_lines(docs, keep=keep, broadcast_bytes=b).collect())) for b in (1 << 20, -1))
            assert one == two and sum(one.values()) == 300
            if keep == "none":
                for doc_id, text, _, n_lines, n_dropped in one:
                    lines = rows[doc_id][1].split("\n")
                    left = [x for x in lines if not x.startswith(("Shared", "few", "keep"))]
                    assert (text, n_lines, n_dropped) == ("\n".join(left), len(lines), len(lines) - len(left))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
