"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, word pairs and pairs one word apart of a whole text, hashed into 2**bits places. Shards of
a bounded labelled sample train side by side with per-coordinate rates and an L1 term; after each round their states are
averaged. Most weights are exactly 0; what is broadcast has 2**bits places at most.

Defined results: null and empty texts have no features and get the bias's score; labels that are null, of null ids or of
unknown documents are not learnt; of repeated labels the largest counts; without labelled rows every score is 0.5;
repeated documents are scored alike, and of an id's differing texts the largest is learnt from; other columns pass through."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .shared import WORD_BYTES, cut, hash_all, hashed_words, mix, text_runs


#: Features take about twenty times the bytes of their text.
RUN_BYTES = 4 << 20


@dataclass(frozen=True)
class Ftrl:
    bits: int = 20
    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 1.0
    epochs: int = 4
    rounds: int = 3
    #: Most shards; a shard has shard_rows rows or more.
    shards: int = 4
    shard_rows: int = 5_000
    #: Most labelled documents that are learnt from (expected number; they are chosen by a hash of their id, and an id's repeated rows count once).
    sample_rows: int = 20_000

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) <= self.l1, 0.0, shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))


def features(texts: pa.StringArray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, place) of the words, neighbouring pairs and pairs one word apart of a run of texts; may repeat."""
    h, counts = hashed_words(texts, WORD_BYTES)
    row = np.repeat(np.arange(len(counts)), counts)
    rows, parts = [row], [mix(h)]
    for gap, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        same = np.flatnonzero(row[:-gap] == row[gap:])
        rows.append(row[same])
        parts.append(mix(h[same] * np.uint64(factor) + h[same + gap]))
    return np.concatenate(rows), (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def train_shard(rows: list[tuple[np.ndarray, int]], z: np.ndarray, n: np.ndarray, conf: Ftrl) -> None:
    """One FTRL pass per epoch; place 2**bits is the bias."""
    bias = np.array([1 << conf.bits])
    for _ in range(conf.epochs):
        for places, label in rows:
            at = np.concatenate([places, bias])
            zi, ni = z[at], n[at]
            w = conf.weights(zi, ni)
            g = float(_sigmoid(w.sum())) - label
            root = np.sqrt(ni)
            z[at] = zi + g - (np.sqrt(ni + g * g) - root) / conf.alpha * w
            n[at] = ni + g * g


def labelled_sample(docs: DataFrame, labels: DataFrame, conf: Ftrl, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, int]:
    """(id, text, label) of at most about sample_rows labelled documents, each id once, and about how many. Only their ids are broadcast."""
    own = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("label_id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("label"))
    )
    known = own.count()
    share = min(1.0, conf.sample_rows / max(1, known))
    chosen = own.filter(F.pmod(F.xxhash64("label_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = texts.join(F.broadcast(chosen), F.col("id") == F.col("label_id"))
    return found.groupBy("id").agg(F.max("text").alias("text"), F.first("label").alias("label")), int(share * known)


def fit(docs: DataFrame, labels: DataFrame, conf: Ftrl = Ftrl(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict[int, float]:
    """The weights other than 0, by place; at 2**bits the bias."""
    size = (1 << conf.bits) + 1
    sample, expected = labelled_sample(docs, labels, conf, id_col, text_col, label_col)
    count = max(1, min(conf.shards, expected // conf.shard_rows))

    def to_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns, labels_ = (hash_all([str(i).encode() for i in batch.column(0).to_pylist()]) >> np.uint64(1)).astype(np.int64), batch.column(2).cast(pa.int32())
            for first, run in text_runs(batch, "text", RUN_BYTES):
                row, place = features(run, conf.bits)
                code = np.unique(row << conf.bits | place)
                ends = np.searchsorted(code, np.arange(len(run) + 1) << conf.bits)
                places = (code & ((1 << conf.bits) - 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(turns[first : first + len(run)]), labels_[first : first + len(run)], pa.array([places[i:j].tobytes() for i, j in pairwise(ends.tolist())], pa.binary())],
                    ["turn", "label", "places"],
                )

    rows = cut(
        sample.mapInArrow(to_features, "turn long, label int, places binary")
        .withColumn("shard", F.pmod("turn", F.lit(count)))
        .repartition(count, "shard")
    )
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(conf.rounds):
        start = docs.sparkSession.sparkContext.broadcast((z, n))

        def learn(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            shards: dict[int, list] = {}
            for batch in batches:
                for row in batch.to_pylist():
                    shards.setdefault(row["shard"], []).append((row["turn"], row["label"], np.frombuffer(row["places"], np.int32).astype(np.int64)))
            for shard, own in shards.items():
                own.sort(key=lambda r: r[0])
                zs, ns = (x.copy() for x in start.value)
                train_shard([(p, label) for _, label, p in own], zs, ns, conf)
                moved = np.flatnonzero((zs != start.value[0]) | (ns != start.value[1]))
                arrays = [moved.astype(np.int32), *((x - y)[moved].astype(np.float32) for x, y in zip((zs, ns), start.value, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in arrays)], ["shard", "place", "z", "n"])

        # each shard sends what it moved, 12 bytes a place at most; a place's state moves by the mean over all shards
        got = rows.mapInArrow(learn, "shard int, place binary, z binary, n binary").toArrow()
        for k in np.argsort(got["shard"].to_numpy()).tolist():
            at, dz, dn = (np.frombuffer(got[c][k].as_buffer(), kind) for c, kind in (("place", np.int32), ("z", np.float32), ("n", np.float32)))
            z[at] += dz.astype(float) / count
            n[at] += dn.astype(float) / count
    w = conf.weights(z, n)
    return {int(i): float(w[i]) for i in np.flatnonzero(w)}


def score(docs: DataFrame, weights: dict[int, float], conf: Ftrl = Ftrl(), text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """docs, or just the named columns of it, with the column score in place of any column of that name."""
    table = docs.sparkSession.sparkContext.broadcast((np.fromiter(weights, np.int64), np.fromiter(weights.values(), float)))
    names = [c for c in (docs.columns if columns is None else columns) if c != "score"]
    carried = names.index(text_col) if text_col in names else None
    size = (1 << conf.bits) + 1

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(size)
        dense[table.value[0]] = table.value[1]
        bias = dense[-1]
        for batch in batches:
            own = batch.column(0)
            texts = batch.column(1) if carried is None else own.field(carried)
            sums = []
            for _, run in text_runs(pa.RecordBatch.from_arrays([texts], ["text"]), "text", RUN_BYTES):
                row, place = features(run, conf.bits)
                heavy = np.flatnonzero(dense[place])
                code = np.unique(row[heavy] << conf.bits | place[heavy])
                sums.append(bias + np.bincount(code >> conf.bits, dense[code & (size - 2)], len(run)))
            scores = _sigmoid(np.concatenate(sums)) if sums else np.zeros(0)
            yield pa.RecordBatch.from_arrays([own, pa.array(scores, pa.float64())], ["own", "score"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("own"), *([F.col(text_col).alias("text")] if carried is None else []))
    schema = StructType([rows.schema["own"], StructField("score", DoubleType())])
    return rows.mapInArrow(apply, schema).select("own.*", "score")


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows whose labels are never learnt; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity_scores(docs: DataFrame, labels: DataFrame, conf: Ftrl = Ftrl()) -> DataFrame:
    """The contract's columns: doc_id, held_out, score, predicted."""
    weights = fit(docs, labels.filter(~held_out()), conf)
    out = score(docs, weights, conf, columns=["doc_id"])  # the texts don't come back
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
