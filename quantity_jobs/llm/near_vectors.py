"""Near-duplicate embeddings by NN-descent within equal labels.

Equal vectors of a label are one node. A neighbour graph starts from runs of vectors that several random sign codes sort side
by side, and improves by joining neighbours with neighbours' neighbours until few lists change. Nodes whose whole list lies above the
threshold are saturated: their lists are enlarged, and the component of what stays saturated is dense. A dense component is compared
in tiles with every node of its label that the triangle inequality on angles leaves within reach of it, so that no list length cuts
links off, neither within the component nor between it and others. What is left are links between sparse nodes: a brute-force audit
measures their recall; below the target the descent goes on with longer lists, and after the last round the sparse
nodes of a label are compared with each other in full. Links are measured in double precision.

Defined results: vectors or labels that are null, and vectors that are empty, zero or hold null or non-finite components,
link with nothing and are their own component; vectors of different lengths never link; of the rows of a repeated vec_id
that with the smallest hash of its vector counts; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .components import components
from .shared import cut, shuffle_width


@dataclass(frozen=True)
class Descent:
    threshold: float = 0.93
    list_length: int = 10
    longest_list: int = 40
    codes: int = 6
    code_bits: int = 12
    run: int = 256
    #: A descent ends when this share of the list entries is new, or after so many steps.
    settled: float = 0.001
    iterations: int = 12
    #: Bounded samples for the audit, which grow until they have so many true links, and the recall they must show.
    audit_nodes: int = 512
    audit_most: int = 8192
    audit_links: int = 200
    target: float = 0.97
    rounds: int = 3
    tile: int = 512
    #: What half-precision search may be off by.
    margin: float = 0.01


def _get(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _rows(column: pa.Array, kind) -> np.ndarray:
    """A matrix from a column of equally long binaries."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def unit_vectors(table: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, dim, name, unit, half): the linkable vectors, of length 1; name is a hash of the raw vector."""

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, out = [], []
            for k, raw in enumerate(_get(batch, "vec").to_pylist()):
                if not raw or any(x is None for x in raw):
                    continue
                x = np.array(raw, np.float64)
                top = np.abs(x).max()
                if not np.isfinite(top) or not top:
                    continue
                scaled = x / top
                unit = scaled / np.sqrt(scaled @ scaled)
                ok.append(k)
                out.append((len(x), xxhash.xxh3_128_digest(x.tobytes()), unit.tobytes(), unit.astype(np.float16).tobytes()))
            at = pa.array(ok, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [_get(batch, "id").take(at), _get(batch, "label").take(at), pa.array([o[0] for o in out], pa.int32()), *(pa.array([o[k] for o in out], pa.binary()) for k in (1, 2, 3))],
                ["id", "label", "dim", "name", "unit", "half"],
            )

    own = table.filter(F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & F.col(id_col).isNotNull())
    own = own.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("vec"))
    return own.mapInArrow(units, "id long, label string, dim int, name binary, unit binary, half binary")


def first_lists(nodes: DataFrame, conf: Descent) -> DataFrame:
    """(a, b, sim): the best partners within runs of vectors with like sign codes, for each of several codes."""
    parts = shuffle_width(nodes.sparkSession)
    # a code tells apart as many cells as there are nodes, so that a run holds like vectors however large a label is
    bits = min(60, max(conf.code_bits, nodes.count().bit_length()))

    def coded(number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = _get(batch, "dim").to_numpy()
                code = np.zeros(batch.num_rows, np.int64)
                for dim in np.unique(dims):
                    at = np.flatnonzero(dims == dim)
                    planes = np.random.default_rng([number, int(dim)]).standard_normal((int(dim), bits))
                    signs = _rows(_get(batch, "half").take(pa.array(at)), np.float16).astype(np.float32) @ planes > 0
                    code[at] = signs @ (1 << np.arange(bits)[::-1])
                yield pa.RecordBatch.from_arrays([*(_get(batch, c) for c in ("node", "label", "dim", "half")), pa.array(code)], ["node", "label", "dim", "half", "code"])

        return run

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, conf.run):
                part = batch.slice(start, conf.run)
                labels, dims = np.array(_get(part, "label").to_pylist(), object), _get(part, "dim").to_numpy()
                for label, dim in dict.fromkeys(zip(labels, dims.tolist(), strict=True)):
                    at = np.flatnonzero((labels == label) & (dims == dim))
                    if len(at) > 1:
                        ids = _get(part, "node").to_numpy()[at]
                        x = _rows(_get(part, "half").take(pa.array(at)), np.float16).astype(np.float32)
                        sims = x @ x.T
                        np.fill_diagonal(sims, -2)
                        k = min(conf.list_length, len(at) - 1)
                        best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                        a = np.repeat(np.arange(len(at)), k)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[best.ravel()]), pa.array(sims[a, best.ravel()])], ["a", "b", "sim"])

    found = None
    for number in range(conf.codes):
        own = nodes.select("node", "label", "dim", "half").mapInArrow(coded(number), "node long, label string, dim int, half binary, code long")
        own = own.repartitionByRange(parts, "label", "dim", "code", "node").sortWithinPartitions("label", "dim", "code", "node")
        own = own.mapInArrow(compare, "a long, b long, sim float")
        found = own if found is None else found.union(own)
    return found


def best_lists(candidates: DataFrame, limits: DataFrame) -> DataFrame:
    """(a, b, sim, fresh): each node's best candidates, as many as its limit."""
    one = candidates.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    lists = one.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("sim", "b", "fresh")), asc=False).alias("l"))
    lists = lists.join(limits, F.col("a") == F.col("node")).select("a", F.explode(F.slice("l", 1, F.col("k"))).alias("x"))
    return lists.select("a", "x.b", "x.sim", "x.fresh")


def neighbour_join(lists: DataFrame, nodes: DataFrame, limits: DataFrame) -> DataFrame:
    """(a, b, sim): better partners found among the neighbours of common neighbours. At each node its own list
    meets that list and the lists' owners that name the node; owners come in blocks."""
    worst = lists.groupBy("a").agg(F.min("sim").alias("low"), F.count(F.lit(1)).alias("n")).join(limits, F.col("a") == F.col("node"))
    worst = worst.select(F.col("a").alias("w_node"), F.when(F.col("n") >= F.col("k"), F.col("low")).otherwise(F.lit(-1.0)).cast("float").alias("low"))
    full = nodes.select("node", "half").join(worst, F.col("node") == F.col("w_node"), "left").select("node", "half", F.coalesce("low", F.lit(-1.0)).cast("float").alias("low"))
    ends = lists.select(F.col("a").alias("at"), F.col("b").alias("member"), F.lit(0).alias("role"), "fresh").union(
        lists.select(F.col("b").alias("at"), F.col("a").alias("member"), F.lit(1).alias("role"), "fresh")
    )
    sent = ends.join(full, F.col("member") == F.col("node")).select("at", "role", "member", "half", "low", "fresh")
    sent = sent.repartition(shuffle_width(nodes.sparkSession), "at").sortWithinPartitions("at", "role")

    def meet(own, others) -> Iterator[pa.RecordBatch]:
        ids, x, low, fresh = own
        ids2, y, low2, fresh2 = others
        sims = x @ y.T
        new = (fresh[:, None] | fresh2[None, :]) & (ids[:, None] != ids2[None, :])
        for better, flip in ((new & (sims > low[:, None]), False), (new & (sims > low2[None, :]), True)):
            i, j = np.nonzero(better)
            a, b = (ids2[j], ids[i]) if flip else (ids[i], ids2[j])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sims[i, j])], ["a", "b", "sim"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, dim = None, None, None
        for batch in batches:
            keys, roles = _get(batch, "at").to_numpy(), _get(batch, "role").to_numpy()
            edges = np.flatnonzero((keys[1:] != keys[:-1]) | (roles[1:] != roles[:-1])) + 1
            for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)], strict=True):
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                fields = (_get(part, "member").to_numpy(), _rows(_get(part, "half"), np.float16).astype(np.float32), _get(part, "low").to_numpy(), _get(part, "fresh").to_numpy(zero_copy_only=False))
                if roles[start] == 0:
                    if at == keys[start] and own is not None:  # the list goes on in a new batch
                        yield from meet(own, fields)
                        own = tuple(np.concatenate(z) for z in zip(own, fields, strict=True))
                    else:
                        at, own = keys[start], fields
                    yield from meet(fields, fields)
                elif at == keys[start] and own is not None:
                    for k in range(0, end - start, 1024):
                        yield from meet(own, tuple(z[k : k + 1024] for z in fields))

    return sent.mapInArrow(join, "a long, b long, sim float")


def measured(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b, each once: the pairs whose cosine in double precision reaches the threshold."""
    own = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    own = own.join(nodes.select(F.col("node").alias("a"), F.col("unit").alias("x")), "a").join(nodes.select(F.col("node").alias("b"), F.col("unit").alias("y")), "b")

    def dot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [float(np.frombuffer(x, float) @ np.frombuffer(y, float)) >= threshold for x, y in zip(_get(batch, "x").to_pylist(), _get(batch, "y").to_pylist(), strict=True)]
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([_get(batch, "a").filter(keep), _get(batch, "b").filter(keep)], ["a", "b"])

    return own.select("a", "b", "x", "y").mapInArrow(dot, "a long, b long")


def _stack(units) -> np.ndarray:
    return np.frombuffer(b"".join(units), float).reshape(len(units), -1)


def _blocked(df: DataFrame, keys: list[str], size: int, block: str) -> DataFrame:
    """df with a block number that splits each group into blocks of about `size` rows."""
    sizes = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).alias("__n"))
    return df.join(sizes, keys).withColumn(block, F.pmod(F.xxhash64("node"), F.col("__n"))).drop("__n")


def _sided(left: DataFrame, right: DataFrame, keys: list[str], size: int, schema: list[str]) -> DataFrame:
    """Every block of left beside every block of right with the same keys: rows (keys, i, j, side, schema)."""
    left, right = _blocked(left, keys, size, "i"), _blocked(right, keys, size, "j")
    of = lambda df, c: df.select(*keys, c).distinct()
    first = left.join(of(right, "j"), keys).select(*keys, "i", "j", F.lit(0).alias("side"), *schema)
    return first.union(right.join(of(left, "i"), keys).select(*keys, "i", "j", F.lit(1).alias("side"), *schema))


def _dense_counts(nodes: DataFrame, dense: DataFrame, conf: Descent) -> DataFrame:
    """(node, n, other): what tiles of every dense component (component, node) and every node within its reach add to the number of vectors that
    a node links with, itself included for nodes of the component; other is a linked member for nodes outside it. A pair
    of dense components is met once."""
    import pandas as pd

    theta = float(np.arccos(conf.threshold))
    members = dense.join(nodes.select("node", "label", "dim", "m", "unit"), "node")
    heads = members.filter("node = component").select("component", F.col("unit").alias("centre"))

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dots = [float(np.frombuffer(x, float) @ np.frombuffer(y, float)) for x, y in zip(_get(batch, "unit").to_pylist(), _get(batch, "centre").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([_get(batch, "component"), pa.array(np.arccos(np.clip(dots, -1, 1)), pa.float64())], ["component", "angle"])

    radius = members.join(heads, "component").select("component", "unit", "centre").mapInArrow(angles, "component long, angle double").groupBy("component").agg(F.max("angle").alias("radius"))
    centres = members.filter("node = component").join(radius, "component").select("label", "dim", "node", "unit", "radius")

    def reach(key, pdf):
        left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
        i, j = np.nonzero(np.arccos(np.clip(_stack(left.unit) @ _stack(right.unit).T, -1, 1)) <= right.radius.to_numpy()[None, :] + theta + 1e-6)
        return pd.DataFrame({"component": right.node.to_numpy()[j], "node": left.node.to_numpy()[i]})

    around = _sided(nodes.select("label", "dim", "node", "unit", F.lit(0.0).alias("radius")), centres, ["label", "dim"], 1024, ["node", "unit", "radius"])
    around = around.groupBy("label", "dim", "i", "j").applyInPandas(reach, "component long, node long")
    around = around.join(dense.select("node", F.col("component").alias("own")), "node", "left").filter("own IS NULL OR own <= component")
    left = around.join(nodes.select("node", "m", "unit"), "node").select("component", "node", "m", "unit", F.coalesce(F.col("own") == F.col("component"), F.lit(False)).alias("inside"))

    def count(key, pdf):
        left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
        near = _stack(left.unit) @ _stack(right.unit).T >= conf.threshold
        outside, ids = ~left.inside.to_numpy(bool), right.node.to_numpy()
        one = pd.DataFrame({"node": left.node.to_numpy(), "n": near @ right.m.to_numpy(), "other": pd.array(np.where(outside, ids[near.argmax(axis=1)], 0), "Int64")})
        one.loc[~outside, "other"] = pd.NA
        two = pd.DataFrame({"node": ids, "n": (near & outside[:, None]).T @ left.m.to_numpy(), "other": pd.array([pd.NA] * len(ids), "Int64")})
        both = pd.concat([one, two])
        return both[both.n > 0]

    tiles = _sided(left, members.select("component", "node", "m", "unit", F.lit(True).alias("inside")), ["component"], conf.tile, ["node", "m", "unit", "inside"])
    return tiles.groupBy("component", "i", "j").applyInPandas(count, "node long, n long, other long")


def _all_pairs(nodes: DataFrame, conf: Descent) -> DataFrame:
    """(a, b), a < b: every link between the nodes, from tiles of blocks of each label."""
    import pandas as pd

    def links(key, pdf):
        left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
        i, j = np.nonzero(_stack(left.unit) @ _stack(right.unit).T >= conf.threshold)
        a, b = left.node.to_numpy()[i], right.node.to_numpy()[j]
        return pd.DataFrame({"a": a[a < b], "b": b[a < b]})

    own = nodes.select("label", "dim", "node", "unit")
    return _sided(own, own, ["label", "dim"], conf.tile, ["node", "unit"]).groupBy("label", "dim", "i", "j").applyInPandas(links, "a long, b long")


def audit(nodes: DataFrame, counted: DataFrame, conf: Descent) -> float:
    """The least recall among sparse nodes, sparse nodes with like neighbours, and dense nodes. counted: (node, n, top, dense), n the vectors
    of other nodes that it links with. Samples grow until they hold enough true links, or all nodes; sparse samples with too few count as one."""
    spark = nodes.sparkSession
    ordered = counted.join(nodes.select("node", "label", "dim", "unit"), "node").orderBy(F.xxhash64("node"), "node")
    kinds = {"sparse": "NOT dense", "like": f"NOT dense AND top >= {conf.threshold - 0.1}", "dense": "dense"}
    seen: dict[str, list[int]] = {}
    size = conf.audit_nodes
    while kinds:
        chosen = {k: ordered.filter(where).limit(size if k != "dense" else conf.audit_nodes // 4).collect() for k, where in kinds.items()}
        sample = spark.sparkContext.broadcast([(r.node, r.label, r.dim, r.unit) for r in {r.node: r for rows in chosen.values() for r in rows}.values()])

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own: dict = {}
            for q in sample.value:  # noqa: B023
                own.setdefault(q[1:3], []).append(q)
            own = {k: (np.array([q[0] for q in v]), _stack([q[3] for q in v])) for k, v in own.items()}
            total = {k: np.zeros(len(v[0]), np.int64) for k, v in own.items()}
            for whole in batches:
                for start in range(0, whole.num_rows, 1024):
                    batch = whole.slice(start, 1024)
                    labels, dims, ids, m = np.array(_get(batch, "label").to_pylist(), object), _get(batch, "dim").to_numpy(), _get(batch, "node").to_numpy(), _get(batch, "m").to_numpy()
                    for key, (names, q) in own.items():
                        at = np.flatnonzero((labels == key[0]) & (dims == key[1]))
                        if len(at):
                            near = q @ _rows(_get(batch, "unit").take(pa.array(at)), float).T >= conf.threshold
                            near &= names[:, None] != ids[at][None, :]
                            total[key] += near @ m[at]
            for key, (names, _) in own.items():
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total[key])], ["node", "n"])

        true = {r[0]: r[1] for r in nodes.select("node", "label", "dim", "m", "unit").mapInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n")).collect()}
        for k, rows in chosen.items():
            seen[k] = [sum(min(r.n, true[r.node]) for r in rows), sum(true[r.node] for r in rows)]
        most = size >= conf.audit_most
        kinds = {k: where for k, where in kinds.items() if k != "dense" and not most and seen[k][1] < conf.audit_links and len(chosen[k]) == size}
        size *= 4
    if seen["sparse"][1] < conf.audit_links:
        seen["sparse"] = [x + y for x, y in zip(seen["sparse"], seen["like"], strict=True)]
    return min(found / true if true else 1.0 for found, true in seen.values())


def near_vectors(table: DataFrame, conf: Descent = Descent(), id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept): one row per distinct id."""
    columns = ["name", "label", "dim", "unit", "half"]
    one = unit_vectors(table, id_col, vec_col, label_col).groupBy("id").agg(F.min(F.struct(*columns)).alias("v"))
    vectors = cut(one.select("id", *(f"v.{c}" for c in columns)))
    nodes = cut(vectors.groupBy("label", "dim", "name").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("m"), F.first("unit").alias("unit"), F.first("half").alias("half")))
    members = vectors.select("id", "label", "dim", "name").join(nodes.select("label", "dim", "name", "node", "m"), ["label", "dim", "name"]).select("id", "node", "m")

    limits = nodes.select("node", F.lit(conf.list_length).alias("k"))
    lists = cut(best_lists(first_lists(nodes, conf).withColumn("fresh", F.lit(True)), limits))
    both_ways = lambda pairs: pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    weights = nodes.select(F.col("node").alias("b"), "m")
    for turn in range(conf.rounds + 1):
        built = limits  # what the lists were cut to
        if turn < conf.rounds:
            for _ in range(conf.iterations):
                # full lists that end above the threshold are saturated and grow
                low = lists.groupBy("a").agg(F.min("sim").alias("low"), F.count(F.lit(1)).alias("n"))
                limits = cut(
                    limits.join(low, F.col("node") == F.col("a"), "left").select(
                        "node", F.when((F.col("n") >= F.col("k")) & (F.col("low") >= conf.threshold), F.least(F.col("k") * 2, F.lit(conf.longest_list))).otherwise(F.col("k")).alias("k")
                    )
                )
                better = neighbour_join(lists, nodes, limits).withColumn("fresh", F.lit(True))
                lists, built = cut(best_lists(lists.withColumn("fresh", F.lit(False)).unionByName(better), limits)), limits
                fresh, entries = lists.agg(F.count_if("fresh"), F.count(F.lit(1))).first()
                if fresh <= conf.settled * entries:
                    break
            links = cut(measured(lists.filter(F.col("sim") >= conf.threshold - conf.margin), nodes, conf.threshold))
            groups = cut(components(links))
            full = lists.groupBy("a").agg(F.min("sim").alias("low"), F.max("sim").alias("top"), F.count(F.lit(1)).alias("n")).join(built, F.col("a") == F.col("node"))
            full = cut(full.select("node", "top", ((F.col("n") >= F.col("k")) & (F.col("low") >= conf.threshold - conf.margin)).alias("full")))
            # a saturated node may lack a measured link (all its list in the margin): then it is a component of its own
            owned = nodes.select("node").join(groups, F.col("node") == F.col("id"), "left").select("node", F.coalesce("component", "node").alias("component"))
            dense = owned.join(full.filter("full"), "node", "left_semi").select("component").distinct()
            dense = cut(owned.join(dense, "component", "left_semi").select("component", "node"))
            tiled = cut(_dense_counts(nodes, dense, conf))
            links = links.join(dense, F.col("a") == F.col("node"), "left_anti")
        else:  # the descent has missed the target: sparse nodes are compared in full
            links = cut(_all_pairs(nodes.join(dense, "node", "left_anti"), conf))
        direct = both_ways(links).join(weights, "b").groupBy("a").agg(F.sum("m").alias("direct"))
        exact = tiled.groupBy("node").agg(F.sum("n").alias("exact"))
        counted = (
            nodes.select("node", "m")
            .join(direct, F.col("node") == F.col("a"), "left")
            .join(exact, "node", "left")
            .join(dense.select("node", F.lit(True).alias("dense")), "node", "left")
            .join(full.select("node", "top"), "node", "left")
            .select(
                "node", "m", F.coalesce("top", F.lit(-1.0)).alias("top"), F.coalesce("dense", F.lit(False)).alias("dense"),
                (F.coalesce("direct", F.lit(0)) + F.coalesce("exact", F.lit(0)) - F.when(F.col("dense"), F.col("m")).otherwise(0)).cast("long").alias("n"),
            )
        )
        counted = cut(counted)
        if turn == conf.rounds or audit(nodes, counted, conf) >= conf.target:
            break
        limits = cut(built.select("node", F.least(F.col("k") * 2, F.lit(conf.longest_list)).alias("k")))
        lists = lists.withColumn("fresh", F.lit(True))

    crossing = tiled.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))
    # members of a dense component are one component already; the others come by their links
    inside = dense.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    groups = cut(components(cut(links.select("a", "b").union(crossing).union(inside))))
    per_node = (
        counted.join(groups, F.col("node") == F.col("id"), "left")
        .select("node", (F.col("n") + F.col("m") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    )
    linked = members.join(per_node, "node").select(F.col("id").alias("__id"), "n_links", "component_id")
    every = table.select(F.col(id_col)).distinct()
    out = every.join(linked, F.col(id_col) == F.col("__id"), "left").select(
        id_col, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", F.col(id_col)).cast("long").alias("component_id")
    )
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


ORACLE = """
WITH RECURSIVE v AS (SELECT DISTINCT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v WHERE label IS NOT NULL AND e IS NOT NULL
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
r AS (SELECT vec_id AS id, vec_id AS c FROM v UNION SELECT p.b, r.c FROM r JOIN p ON r.id = p.a),
m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id),
l AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT m.id AS vec_id, coalesce(l.n, 0) AS n_links, component_id, m.id = component_id AS kept FROM m LEFT JOIN l ON m.id = l.a
"""
