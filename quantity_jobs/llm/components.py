"""Connected components by alternating star contraction; every step is a join or an aggregation. Tasks first join what lies in their own
edges, and a forest of a few edges is ended by one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import cut, shuffle_width

#: Up to so many edges of the forests that tasks have left are joined in one task, which spares the rounds: each is some ten jobs, whose plans,
#: threads and task records the driver holds.
TAIL = 50_000
#: A task joins so many edges at a time, which bounds what it holds.
RUN_EDGES = 250_000


def components(edges: DataFrame, rounds: int = 60, tail: int = TAIL, run: int = RUN_EDGES) -> DataFrame:
    """edges (a, b) of long ids, any order, loops and repeats allowed -> (id, component): for every id in an
    edge between two ids, the smallest id it reaches. Above `tail` edges, large-star and small-star steps alternate until the
    edges no longer change; the number of rounds grows with the logarithm of the longest path."""
    # a task sends an id once a run, however many edges it has there, so that no id is many rows of the shuffle
    now = _joined(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), run)
    now = cut(_joined(now.repartition(shuffle_width(now.sparkSession), "a"), run))
    if now.count() <= tail:
        return _joined(now.coalesce(1), max(1, tail), roots=True).withColumnsRenamed({"a": "id", "b": "component"})
    before = None
    for _ in range(rounds):
        now = cut(_small_star(_large_star(now)))
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )


def _joined(edges: DataFrame, run: int, roots: bool = False) -> DataFrame:
    """(a, b): the edges of each task in runs of about so many, in each of which every id but the smallest links to the smallest that it reaches
    there, and with `roots` that one to itself; no more edges than before, and the same components."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}
        held = 0

        def top(x: int) -> int:
            while (y := root.setdefault(x, x)) != x:
                root[x] = x = root[y]
            return x

        def out() -> pa.RecordBatch:
            ids = list(root)
            tops = [top(x) for x in ids]
            a, b = pa.array(ids, pa.int64()), pa.array(tops, pa.int64())
            both = pa.RecordBatch.from_arrays([a, b], ["a", "b"])
            return both if roots else both.filter(pa.array([x != y for x, y in zip(ids, tops, strict=True)], pa.bool_()))

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = top(a), top(b)
                if x != y:
                    root[max(x, y)] = min(x, y)
            held += batch.num_rows
            if held >= run:
                yield out()
                root.clear()
                held = 0
        if root:
            yield out()

    return edges.select("a", "b").mapInArrow(join, "a long, b long")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node links to the node's smallest neighbour or itself."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (
        both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, link to its smallest neighbour."""
    own = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = own.groupBy("a").agg(F.min("b").alias("m"))
    return (
        own.join(least, "a")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .union(least.select("a", F.col("m").alias("b")))
        .filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
