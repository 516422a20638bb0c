"""Choices whose result depends on an order, made in rounds of joins and aggregations instead of one scan per group.

Each function gives exactly what the scan would give. Groups of at most `tail` candidates (a count that is checked) are scanned whole, many groups side by side and a task's groups one
after the other, so that neither their number nor their chains cost rounds. Larger groups go in rounds: what is worked on shrinks with every round, every round settles at least the first
candidate of each group, and what is left is scanned as soon as it is small enough. No large group ever has to fit into a task: nodes are aggregated before rows move, and the joins are on
single nodes. Rounds are checkpointed into the shared folder.

Groups are lists of columns; ids and groups are compared as they are, null equal to null. Repeated candidates count once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: A group of so many candidates is scanned in one task; it is a bound for each group, as one for all together would be reached after ever more rounds the more groups there are.
TAIL = 50_000


def cut(df: DataFrame) -> DataFrame:
    """df computed once into the shared checkpoint folder, without its lineage."""
    from ..sources.io import run_folder

    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(run_folder(df.sparkSession, "rounds"))
    return df.checkpoint()


def _candidates(edges: DataFrame, group: list[str], left: str, right: str, order: list[Column], payload: list[str]) -> DataFrame:
    """(g, l, r, o, p): group, ends, order and what is carried along; o ends with the ends, which makes the order total."""
    carried = F.struct(*[F.col(c) for c in payload]) if payload else F.struct(F.lit(1).alias("none"))
    return edges.select(F.struct(*group).alias("g"), F.col(left).alias("l"), F.col(right).alias("r"), F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], F.col(left).alias("l"), F.col(right).alias("r")).alias("o"), carried.alias("p"))


def _named(taken: DataFrame, group: list[str], left: str, right: str, payload: list[str]) -> DataFrame:
    return taken.select(*[F.col(f"g.{c}") for c in group], F.col("l").alias(left), F.col("r").alias(right), *[F.col(f"p.{c}") for c in payload])


def by_size(edges: DataFrame, tail: int) -> tuple[DataFrame, DataFrame | None]:
    """The candidates of groups of at most `tail` and those of larger ones, None if there are none. Larger groups are fewer than a tail-th of the candidates."""
    large = cut(edges.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > tail).select(F.col("g").alias("g_")))
    if not large.limit(1).count():
        return edges, None
    same = F.col("g") == F.col("g_")
    return edges.join(F.broadcast(large), same, "left_anti"), edges.join(F.broadcast(large), same, "left_semi")


def groups_of(batch: pa.RecordBatch) -> list[tuple]:
    """Each row's group, which is the first column, as a tuple."""
    return list(zip(*(c.to_pylist() for c in batch.column(0).flatten()), strict=True))


def _scanned(edges: DataFrame, shared: bool) -> DataFrame:
    """The candidates that a scan in order takes, group after group."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used_left, used_right = None, set(), set()
        for batch in batches:
            keep = []
            for k, (group, a, b) in enumerate(zip(groups_of(batch), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if group != now:
                    now, used_left = group, set()
                    used_right = used_left if shared else set()
                if a not in used_left and b not in used_right:
                    used_left.add(a)
                    used_right.add(b)
                    keep.append(k)
            yield batch.take(pa.array(keep, pa.int64()))

    return edges.repartition("g").sortWithinPartitions("g", "o").mapInArrow(scan, edges.schema)


def _without(edges: DataFrame, nodes: DataFrame, end: str) -> DataFrame:
    """The candidates whose end isn't among the nodes (g, n)."""
    own = nodes.select(F.col("g").alias("g_"), F.col("n").alias("n_"))
    return edges.join(own, (F.col("g") == F.col("g_")) & (F.col(end) == F.col("n_")), "left_anti")


def dominant_pairs(edges: DataFrame, group: list[str], left: str, right: str, order: list[Column], payload: list[str] = [], shared: bool = False, tail: int = TAIL) -> DataFrame:  # noqa: B006
    """(group, left, right, payload): the candidates that a scan of each group in ascending order takes, where a candidate is taken if neither of its ends has been; with
    `shared`, left and right are ids of one kind.

    In each round the locally dominant candidates are taken, those that come first among all candidates of both their ends: no candidate before them
    can take an end away, so the scan takes them as well. Candidates of taken ends go."""
    now = cut(_candidates(edges, group, left, right, order, payload))
    taken = now.limit(0)
    while True:
        small, now = by_size(now, tail)
        taken = taken.unionByName(_scanned(small, shared))
        if now is None:
            return _named(taken, group, left, right, payload)
        ends = now.select("g", "o", "p", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("l").alias("n")), F.struct(F.lit(0 if shared else 1).alias("side"), F.col("r").alias("n")))).alias("e"))
        first = ends.groupBy("g", "e").agg(F.min(F.struct("o", "p")).alias("b"))
        both = first.groupBy("g", F.col("b.o").alias("o")).agg(F.count(F.lit(1)).alias("ends"), F.first("b.p").alias("p"))
        new = cut(both.filter((F.col("ends") == 2) | ((F.col("o.l") == F.col("o.r")) & F.lit(shared))).select("g", F.col("o.l").alias("l"), F.col("o.r").alias("r"), "o", "p"))
        taken = taken.unionByName(new)
        lefts, rights = (new.select("g", F.col(c).alias("n")) for c in ("l", "r"))
        if shared:
            lefts = rights = lefts.union(rights).distinct()
        now = cut(_without(_without(now, lefts, "l"), rights, "r"))


def deferred_choice(edges: DataFrame, group: list[str], left: str, right: str, preference: list[Column], payload: list[str] = [], tail: int = TAIL) -> DataFrame:  # noqa: B006
    """(group, left, right, payload): each left id in ascending order takes, of its candidates, the first by preference whose right id is unused.

    Deferred acceptance: in each round every left id proposes to the first of its candidates, and a right id holds the smallest that proposes. All larger ones
    give up that right id for good: the one held would rather have it than anything it has left. A right id that holds the smallest of all its candidates is settled."""
    now = cut(_candidates(edges, group, left, right, [F.col(left), *preference], payload))
    taken = now.limit(0)
    while True:
        small, now = by_size(now, tail)
        taken = taken.unionByName(_scanned(small, False))
        if now is None:
            return _named(taken, group, left, right, payload)
        proposed = now.groupBy("g", "l").agg(F.min(F.struct("o", "p")).alias("b"))
        held = proposed.groupBy("g", F.col("b.o.r").alias("n")).agg(F.min(F.struct("l", "b")).alias("h"))
        lowest = now.groupBy("g", F.col("r").alias("n")).agg(F.min("l").alias("least"))
        state = cut(held.join(lowest, ["g", "n"]).select("g", "n", F.col("h.l").alias("held"), (F.col("h.l") == F.col("least")).alias("settled"), "h.b"))
        new = state.filter("settled").select("g", F.col("held").alias("l"), F.col("n").alias("r"), F.col("b.o").alias("o"), F.col("b.p").alias("p"))
        taken = taken.unionByName(new)
        known = state.select(F.col("g").alias("g_"), F.col("n").alias("n_"), "held", "settled")
        left_over = now.join(known, (F.col("g") == F.col("g_")) & (F.col("r") == F.col("n_")), "left").filter("held IS NULL OR (NOT settled AND l <= held)").select(*now.columns)
        now = cut(_without(left_over, new.select("g", F.col("l").alias("n")), "l"))


def first_independent(covers: DataFrame, group: list[str], order: list[Column], tail: int = TAIL) -> DataFrame:
    """(group, id): the ids that a scan in order drops. covers: (group, a, b, and what order reads): a comes before b and, if it is kept, drops it; order is that of a.

    The lexicographically first independent set by rounds: an id is kept once all earlier ones that cover it are out, and dropped once one of them is kept."""
    own = covers.select(F.struct(*group).alias("g"), "a", "b", F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], F.col("a").alias("a")).alias("o"))
    now = cut(own)
    gone = now.select("g", F.col("b").alias("n")).limit(0)
    kind = gone.schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out = None, set()
        for batch in batches:
            rows = []
            for k, (group_, a, b) in enumerate(zip(groups_of(batch), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if group_ != last:
                    last, out = group_, set()
                if a not in out and b not in out:
                    out.add(b)
                    rows.append(k)
            found = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([found.column(0), found.column(2)], ["g", "n"])

    while True:
        small, now = by_size(now, tail)
        gone = gone.unionByName(small.repartition("g").sortWithinPartitions("g", "o").mapInArrow(scan, kind))
        if now is None:
            return gone.select(*[F.col(f"g.{c}") for c in group], F.col("n").alias("id"))
        sources = now.select("g", F.col("a").alias("n")).distinct()
        free = _without(sources.withColumnRenamed("n", "x"), now.select("g", F.col("b").alias("n")).distinct(), "x")
        hit = now.join(free.select(F.col("g").alias("g_"), F.col("x").alias("n_")), (F.col("g") == F.col("g_")) & (F.col("a") == F.col("n_")), "left_semi")
        new = cut(hit.select("g", F.col("b").alias("n")).distinct())
        gone = gone.unionByName(new)
        now = cut(_without(_without(now, new, "a"), new, "b"))


#: So many marks of a group travel as one array, and each of its points looks at all of them.
FEW_MARKS = 64


def nearest(points: DataFrame, marks: DataFrame, group: list[str], ident: list[str], payload: str, size: float, few: int = FEW_MARKS) -> DataFrame:
    """(group, ident, payload): for each point (group, ident, px, py) the mark (group, seq, x, y, payload) of its group that is nearest, the smallest seq on ties; points of groups
    without marks are left out.

    Groups of at most `few` marks are looked through whole. For larger ones, rings of cells: with cells as wide as the reach, all marks within reach of a point lie in its cell or the eight around it, so the nearest found there is the nearest of all
    once it lies within reach. Points that have found none so near go on with three times the reach; marks are put into nine cells each, points into one. Of marks at one place only the
    first counts."""
    own = [F.col(c).alias(f"g{k}") for k, c in enumerate(group)]
    g = [f"g{k}" for k in range(len(group))]
    first = marks.filter("x IS NOT NULL AND y IS NOT NULL").groupBy(*own, "x", "y").agg(F.min_by(F.struct("seq", F.col(payload).alias("what")), "seq").alias("m"))
    first = cut(first)
    every = points.select(*own, F.struct(*ident).alias("id"), "px", "py").filter("px IS NOT NULL AND py IS NOT NULL")
    sizes = first.groupBy(*g).agg(F.count(F.lit(1)).alias("n"))
    listed = first.join(sizes.filter(F.col("n") <= few), g, "left_semi").groupBy(*g).agg(F.collect_list(F.struct("x", "y", "m")).alias("marks"))
    far = lambda k: (k["x"] - F.col("px")) * (k["x"] - F.col("px")) + (k["y"] - F.col("py")) * (k["y"] - F.col("py"))
    best_of = F.array_min(F.transform("marks", lambda k: F.struct(far(k).alias("d"), k["m"]["seq"].alias("seq"), k["m"]["what"].alias("what"))))
    out = every.join(listed, g).select(*g, "id", best_of["what"].alias("what"))
    named = [*[F.col(f"g{k}").alias(c) for k, c in enumerate(group)], *[F.col(f"id.{c}") for c in ident], F.col("what").alias(payload)]
    large = sizes.filter(F.col("n") > few).select(*g)
    if not large.limit(1).count():
        return out.select(*named)
    # groups without marks would go on for ever, and none needs to look farther than across all marks and points
    first = first.join(large, g, "left_semi")
    now, reach = cut(every.join(large, g, "left_semi")), float(size)
    while True:
        at = lambda c: F.floor(F.col(c) / reach)  # noqa: E731, B023
        around = first.withColumns({"cx": F.explode(F.array(*(at("x") + d for d in (-1, 0, 1)))), "top": at("y")}).withColumn("cy", F.explode(F.array(*(F.col("top") + d for d in (-1, 0, 1))))).drop("top")
        d = (F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py"))
        found = now.withColumns({"cx": at("px"), "cy": at("py")}).join(around, [*g, "cx", "cy"]).withColumn("d", d).filter(F.col("d") <= reach * reach)
        best = cut(found.groupBy(*g, "id").agg(F.min_by("m.what", F.struct("d", "m.seq")).alias("what")))
        out = out.unionByName(best)
        done = best.select(*[F.col(c).alias(f"{c}_") for c in g], F.col("id").alias("id_"))
        same = (F.col("id") == F.col("id_")) & F.lit(True)
        for c in g:
            same = same & (F.col(c) == F.col(f"{c}_"))
        now = cut(now.join(done, same, "left_anti"))
        if not now.limit(1).count():
            break
        reach *= 3
    return out.select(*named)


def components(links: DataFrame, group: list[str], tail: int = TAIL) -> DataFrame:
    """(group, id, component): for each id in a link (group, a, b) the smallest id that it reaches in its group.

    Every id points at the smallest id it knows; rounds of hooking (a link's larger root to its smaller one) and of pointing at the pointee's root end when
    no link joins two roots. Links within a root go, so that few are left soon."""
    now = cut(links.select(F.struct(*group).alias("g"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    roots = cut(now.select("g", F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("root", F.col("id")))
    while now.limit(1).count():
        small, large = by_size(now, tail)
        hooks = cut(_small_components(small))
        if large is not None:
            # the larger end of each link points at its smallest neighbour; pointers lead down, so following them ends
            down = cut(large.groupBy("g", F.col("b").alias("n")).agg(F.min("a").alias("to")))
            while True:
                next_ = down.select(F.col("g").alias("g_"), F.col("n").alias("n_"), F.col("to").alias("to_"))
                moved = cut(down.join(next_, (F.col("g") == F.col("g_")) & (F.col("to") == F.col("n_")), "left").select("g", "n", F.coalesce("to_", "to").alias("to"), F.col("to_").isNotNull().alias("moved")))
                down = moved.select("g", "n", "to")
                if not moved.filter("moved").limit(1).count():
                    break
            hooks = hooks.unionByName(down)
        own = hooks.select(F.col("g").alias("g_"), F.col("n").alias("n_"), "to")
        follow = lambda df, c: df.join(own, (F.col("g") == F.col("g_")) & (F.col(c) == F.col("n_")), "left").withColumn(c, F.coalesce("to", c)).drop("g_", "n_", "to")  # noqa: E731, B023
        roots = cut(follow(roots, "root"))
        ends = follow(follow(now, "a"), "b")
        now = cut(ends.select("g", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    return roots.select(*[F.col(f"g.{c}") for c in group], "id", F.col("root").alias("component"))


def _small_components(links: DataFrame) -> DataFrame:
    """(g, n, to): the smallest id that each larger one reaches, by union-find group after group."""
    kind = links.select("g", F.col("b").alias("n"), F.col("a").alias("to")).schema
    schema = to_arrow_schema(kind)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}
        now, fields = None, None

        def top(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        def rows() -> list[dict]:
            return [{"g": fields, "n": x, "to": top(x)} for x in list(root) if top(x) != x]

        for batch in batches:
            done = []
            for group, a, b in zip(groups_of(batch), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if group != now:
                    done += rows()
                    root.clear()
                    now, fields = group, dict(zip(names, group, strict=True))
                x, y = top(a), top(b)
                if x != y:
                    root[max(x, y)] = min(x, y)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        yield pa.RecordBatch.from_pylist(rows(), schema=schema)

    names = kind["g"].dataType.names
    return links.repartition("g").sortWithinPartitions("g").mapInArrow(join, kind)
