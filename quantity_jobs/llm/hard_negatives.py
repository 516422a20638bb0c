"""Hard negatives by shared lists of anchor clusters.

Anchors are clustered by angle, with centres from a bounded sample. They are searched in groups of bounded size, which go to all tasks, while
the rows stay where they lie. In each chunk of rows a cluster sorts its list once, by the upper bound that the angles allow: no member can
score above |row| * cos(angle of row and centre - widest angle of member and centre) * |anchor|. Every member walks the list until
the bound of what is left falls below what it still needs: then its results from this chunk are certain. What the tasks found is merged per anchor.
Positives are found in a first walk, negatives within the windows that the positives open in a second one.

Scores are inner products of the integers floor(scale * x) and exact at any size (in a column they end at the limits of 64 bits).
Defined results: rows with a null id, label or vector, or null or non-finite components take no part; vectors meet only those of their length (an empty
vector has none); of the rows of a repeated id that with the smallest label, then vector counts; an anchor without positives, or a positive whose window
holds no row, gives no rows; zero vectors score 0; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .shared import cut, equal_lengths, shared_path, shuffle_width

INT64 = np.iinfo(np.int64)
#: Where the double-precision bound may be off by rounding.
SLACK = 1e-9


@dataclass(frozen=True)
class Mining:
    positives: int = 5
    negatives: int = 10
    #: Of 100 parts of the positive's score, a negative has at least and at most so many.
    least: int = 30
    most: int = 90
    scale: int = 256
    #: Anchors (of the smallest hashes) that centres are fitted on, per length of vectors, and the most centres.
    sample: int = 4096
    clusters: int = 256
    members: int = 64
    #: Anchors that are searched at once, and the bytes of their vectors: the bound of what is broadcast.
    group: int = 8192
    group_bytes: int = 64 << 20
    #: Rows of a chunk, bytes of it, and rows that are scored at once.
    chunk: int = 16_384
    chunk_bytes: int = 64 << 20
    block: int = 512


class Scores:
    """Integers floor(scale * x) of vectors of one length, with exact inner products."""

    def __init__(self, vectors: np.ndarray, scale: int):
        with np.errstate(over="ignore"):
            scaled = np.floor(vectors * float(scale))
        if vectors.size and not (np.abs(scaled) < 2.0**53).all():
            self.exact = np.array([[int(x) * scale if abs(x) >= 2.0**53 else int(np.floor(x * scale)) for x in v] for v in vectors.tolist()], object)
            scaled = np.clip(vectors, -1e150, 1e150) * float(scale)
        else:
            self.exact = None
        self.q = scaled
        self.top = float(np.abs(self.q).max(initial=0))
        self.norms = np.sqrt((self.q * self.q).sum(axis=1))

    def units(self) -> np.ndarray:
        return self.q / np.where(self.norms > 0, self.norms, 1)[:, None]

    def pick(self, at: np.ndarray) -> Scores:
        out = object.__new__(Scores)
        out.q, out.norms, out.top = self.q[at], self.norms[at], self.top
        out.exact = None if self.exact is None else self.exact[at]
        return out

    def dot(self, other: Scores) -> np.ndarray:
        """Exact products: by doubles, by longs, or by Python's integers as the size requires."""
        bound = self.top * other.top * self.q.shape[1]
        if self.exact is None and other.exact is None:
            if bound < 2.0**53:
                return (self.q @ other.q.T).astype(np.int64)
            if bound < 2.0**62:
                return self.q.astype(np.int64) @ other.q.astype(np.int64).T
        return self.integers() @ other.integers().T

    def integers(self) -> np.ndarray:
        return self.exact if self.exact is not None else np.array([[int(x) for x in v] for v in self.q.tolist()], object).reshape(self.q.shape)


def usable(table: DataFrame, id_col: str, vec_col: str, label: Column) -> DataFrame:
    """(id, label, vec, length) of the rows that take part, one per id."""
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    own = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("string").alias("label"), vec.alias("vec"))
    own = own.filter("id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0")
    own = own.filter(~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return own.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("s")).select("id", "s.label", "s.vec", F.size("s.vec").alias("length"))


def fit_centres(anchors: DataFrame, conf: Mining) -> dict[int, np.ndarray]:
    """length -> unit centres, by a few rounds of spherical k-means over a bounded sample of the anchors of each of at most 64 lengths."""
    lengths = anchors.groupBy("length").count().orderBy(F.desc("count"), "length").limit(64).collect()
    out = {}
    for length, n in ((r[0], r[1]) for r in lengths):
        most = max(1, min(conf.sample, (32 << 20) // (8 * length)))
        rows = anchors.filter(F.col("length") == length).orderBy(F.xxhash64("id"), "id").limit(most).select("vec").toArrow()["vec"].combine_chunks()
        _, _, vectors = next(equal_lengths(rows))
        x = Scores(vectors, conf.scale).units()
        k = max(1, min(conf.clusters, n // conf.members, len(x)))
        centres = x[np.random.default_rng(length).choice(len(x), k, replace=False)]
        for _ in range(8):
            nearest = (x @ centres.T).argmax(axis=1)
            total = np.zeros((k, length))
            np.add.at(total, nearest, x)
            norms = np.sqrt((total * total).sum(axis=1))
            centres = np.where(norms[:, None] > 0, total / np.where(norms > 0, norms, 1)[:, None], centres)
        out[length] = centres
    return out


def with_clusters(anchors: DataFrame, centres: dict[int, np.ndarray], conf: Mining) -> DataFrame:
    """anchors and the number of the nearest centre of their length."""
    sent = anchors.sparkSession.sparkContext.broadcast(centres)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows, np.int32)
            for length, rows, vectors in equal_lengths(batch.column(batch.schema.get_field_index("vec"))):
                if length in sent.value:
                    found[rows] = (Scores(vectors, conf.scale).units() @ sent.value[length].T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, "cluster"])

    return anchors.mapInArrow(nearest, StructType([*anchors.schema.fields, StructField("cluster", IntegerType())]))


def with_groups(anchors: DataFrame, conf: Mining) -> tuple[DataFrame, int]:
    """anchors and the number of their group, and how many groups there are; clusters stay together, and are cut by a hash where they are too large."""
    counted = anchors.groupBy("length", "cluster").count().orderBy("length", "cluster").collect()
    starts, filled = [], 0.0
    for row in counted:
        share = row[2] / max(1, min(conf.group, conf.group_bytes // (8 * row.length)))
        starts.append((row.length, row.cluster, filled, share))
        filled += share
    if not starts:
        return anchors.withColumn("grp", F.lit(0)), 0
    places = anchors.sparkSession.createDataFrame(starts, "length int, cluster int, start double, share double")
    fraction = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    joined = anchors.join(F.broadcast(places), ["length", "cluster"])
    return joined.withColumn("grp", F.floor(F.col("start") + F.col("share") * fraction).cast("int")).drop("start", "share"), int(filled) + 1


@dataclass
class Cluster:
    """Anchors of one length that are nearest to one centre; windows: per member its distinct (least, most) scores in the second walk."""

    numbers: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    scores: Scores
    centre: np.ndarray
    widest: float
    windows: list | None = None


def clusters_of(found: pa.Table, conf: Mining) -> list[Cluster]:
    """The clusters of a group. Their centres are the members' mean directions, so that the widest angle is as small as the group allows."""
    out, column = [], found["vec"].combine_chunks()
    ids, labels, cluster = found["id"].to_numpy(), np.array(found["label"].to_pylist(), object), found["cluster"].to_numpy()
    for _, rows, vectors in equal_lengths(column):
        for c in np.unique(cluster[rows]):
            at = np.flatnonzero(cluster[rows] == c)
            own = Scores(vectors[at], conf.scale)
            units = own.units()
            mean = units.sum(axis=0)
            norm = np.sqrt(mean @ mean)
            centre = mean / norm if norm > 0 else np.eye(1, len(mean))[0]
            widest = float(np.arccos(np.clip(units[own.norms > 0] @ centre, -1, 1)).max(initial=0))
            out.append(Cluster(rows[at], ids[rows[at]], labels[rows[at]], own, centre, widest))
    return out


def best(scores, ids, more_scores, more_ids, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k first of two lists, by falling score, then by id."""
    scores, ids = np.concatenate([scores, more_scores]), np.concatenate([ids, more_ids])
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


EMPTY = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def walk(clusters: list[Cluster], held: dict, ids: np.ndarray, labels: np.ndarray, rows: Scores, conf: Mining) -> None:
    """One chunk of rows against all clusters of its length. held: (anchor's number, window's number) -> (scores, ids), the best so far; in the first
    walk, without windows, those of the anchor's label, else those of other labels within the window."""
    for cluster in clusters:
        if len(cluster.centre) != rows.q.shape[1]:
            continue
        angles = np.arccos(np.clip(rows.units() @ cluster.centre, -1, 1))
        bounds = rows.norms * np.cos(np.maximum(0, angles - cluster.widest)) + SLACK * rows.norms
        order = np.argsort(-bounds, kind="stable")
        k = conf.positives if cluster.windows is None else conf.negatives
        needs = np.full(len(cluster.numbers), -np.inf)

        def need(m: int, cluster=cluster, k=k) -> float:
            """The least score that member m can still use."""
            if cluster.windows is None:
                top = held.get((cluster.numbers[m], 0), EMPTY)[0]
                return float(top[-1]) if len(top) == k else -np.inf
            least = np.inf
            for w, (low, _) in enumerate(cluster.windows[m]):
                top = held.get((cluster.numbers[m], w), EMPTY)[0]
                least = min(least, float(top[-1]) if len(top) == k else float(low))
            return least

        for m in range(len(needs)):
            needs[m] = need(m)
        for first in range(0, len(order), conf.block):
            at = order[first : first + conf.block]
            # the walk of a member ends where the bound of the rest falls below what it needs
            going = np.flatnonzero(bounds[at[0]] * cluster.scores.norms * (1 + SLACK) >= needs - SLACK * np.abs(np.where(np.isfinite(needs), needs, 0)))
            if not len(going):
                break
            found = cluster.scores.pick(going).dot(rows.pick(at))
            own_labels, own_ids = labels[at], ids[at]
            same = own_labels[None, :] == cluster.labels[going][:, None]
            hits = (same if cluster.windows is None else ~same) & (found >= needs[going][:, None])
            for g in np.flatnonzero(hits.any(axis=1)).tolist():
                m = int(going[g])
                take = np.flatnonzero(hits[g])
                if cluster.windows is None:
                    take = take[own_ids[take] != cluster.ids[m]]
                    if len(take):
                        key = (cluster.numbers[m], 0)
                        held[key] = best(*held.get(key, EMPTY), found[g, take], own_ids[take], k)
                else:
                    for w, (low, high) in enumerate(cluster.windows[m]):
                        inside = take[(found[g, take] >= low) & (found[g, take] <= high)]
                        if len(inside):
                            key = (cluster.numbers[m], w)
                            held[key] = best(*held.get(key, EMPTY), found[g, inside], own_ids[inside], k)
                needs[m] = need(m)


PARTS = "anchor int, win int, found binary"


def search(rows: DataFrame, sent, conf: Mining) -> DataFrame:
    """(anchor, win, found): the best of each task's rows for each anchor and window of the broadcast clusters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        pending: dict[int, list] = {}

        def flush(length: int) -> None:
            parts = pending.pop(length)
            walk(sent.value, held, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), Scores(np.concatenate([p[2] for p in parts]), conf.scale), conf)

        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("id")).to_numpy()
            labels = np.array(batch.column(batch.schema.get_field_index("label")).to_pylist(), object)
            for length, at, vectors in equal_lengths(batch.column(batch.schema.get_field_index("vec"))):
                pending.setdefault(length, []).append((ids[at], labels[at], vectors))
                if sum(len(p[0]) for p in pending[length]) >= min(conf.chunk, conf.chunk_bytes // (8 * length)):
                    flush(length)
        for length in list(pending):
            flush(length)
        if held:
            keys = list(held)
            found = pa.array([pickle.dumps(held[key]) for key in keys], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([int(a) for a, _ in keys], pa.int32()), pa.array([w for _, w in keys], pa.int32()), found], ["anchor", "win", "found"])

    return rows.select("id", "label", "vec").mapInArrow(run, PARTS)


def merged(parts: DataFrame, k: int, emit, schema: StructType | str) -> DataFrame:
    """emit(held) of the k best over all tasks; a task holds a share of one group's anchors."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for anchor, win, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held[anchor, win] = best(*held.get((anchor, win), EMPTY), *pickle.loads(found), k)
        yield from emit(held)

    return parts.repartition(shuffle_width(parts.sparkSession), "anchor").mapInArrow(fold, schema)


def windows_of(scores: list[int], conf: Mining) -> list[tuple[int, int]]:
    """The distinct (least, most) scores of negatives that the scores of positives allow; empty ones are left out."""
    found = dict.fromkeys((-(-conf.least * p // 100), conf.most * p // 100) for p in scores)
    return [w for w in found if w[0] <= w[1]]


def as_long(values) -> pa.Array:
    return pa.array([min(max(int(v), INT64.min), INT64.max) for v in values], pa.int64())


RESULT = StructType([StructField(n, t()) for n, t in (("anchor_id", LongType), ("positive_id", LongType), ("rank", IntegerType), ("negative_id", LongType), ("positive_score", LongType), ("negative_score", LongType))])


def mine(table: DataFrame, anchors: Column, label: Column, id_col: str = "vec_id", vec_col: str = "embedding", conf: Mining = Mining()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for every row for which `anchors`, a condition on `id`, holds, and each of its
    positives (the first rows of its label), the first rows of other labels whose score lies in the window below the positive's."""
    spark = table.sparkSession
    rows = cut(usable(table, id_col, vec_col, label))
    wanted = rows.filter(anchors)
    grouped, groups = with_groups(cut(with_clusters(wanted, fit_centres(wanted, conf), conf)), conf)
    grouped, path = cut(grouped), shared_path(spark, "hard-negatives")

    def pairs(held: dict) -> Iterator[pa.RecordBatch]:
        keys = list(held)
        found = pa.array([pickle.dumps(held[key]) for key in keys], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in keys], pa.int32()), pa.array([w for _, w in keys], pa.int32()), found], ["anchor", "win", "found"])

    for number in range(groups):
        members = grouped.filter(F.col("grp") == number).select("id", "label", "vec", "cluster").toArrow().combine_chunks()
        if not members.num_rows:
            continue
        clusters = clusters_of(members, conf)
        first = merged(search(rows, spark.sparkContext.broadcast(clusters), conf), conf.positives, pairs, PARTS).toArrow()
        positives = {a: [(int(s), int(i)) for s, i in zip(*pickle.loads(f), strict=True)] for a, f in zip(first["anchor"].to_pylist(), first["found"].to_pylist(), strict=True)}
        for cluster in clusters:
            cluster.windows = [windows_of([s for s, _ in positives.get(int(n), [])], conf) for n in cluster.numbers]
        known = spark.sparkContext.broadcast((members["id"].to_pylist(), positives))

        def ranked(held: dict, known=known) -> Iterator[pa.RecordBatch]:
            ids, positives = known.value
            by_anchor: dict = {}
            for (anchor, win), (scores, found) in held.items():
                by_anchor.setdefault(anchor, {})[win] = (scores, found)
            out: list[list] = [[] for _ in RESULT.fields]
            for anchor, wins in by_anchor.items():
                windows = windows_of([s for s, _ in positives[anchor]], conf)
                for score, positive in positives[anchor]:
                    own = windows_of([score], conf)
                    scores, found = wins.get(windows.index(own[0]), EMPTY) if own else EMPTY
                    for rank, (s, i) in enumerate(zip(scores, found, strict=True), 1):
                        for column, value in zip(out, (ids[anchor], positive, rank, int(i), score, s), strict=True):
                            column.append(value)
            columns = [pa.array(c, pa.int32()) if f.name == "rank" else as_long(c) for c, f in zip(out, RESULT.fields, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, RESULT.names)

        merged(search(rows, spark.sparkContext.broadcast(clusters), conf), conf.negatives, ranked, RESULT).write.mode("append").parquet(path)
    return spark.read.schema(RESULT).parquet(path) if groups else spark.createDataFrame([], RESULT)


def negatives_digest(table: DataFrame) -> DataFrame:
    """The contract's rows of mine over embeddings: anchors are the ids divisible by 100; where 7 divides an id the label is first replaced."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table, F.col("id") % 100 == 0, label)


ORACLE = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
  CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same WHERE 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT * FROM n WHERE rank <= 10
"""
