"""Bloom filters of a bounded size, built by tasks and merged segment by segment.

A filter's size follows the expected number of hashes, up to 2**LOG2_BITS bits (16 MB), so what is collected and
broadcast is bounded. A full filter passes too much, never too little."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import merged_segments, mix

SEGMENT = 2048  # bytes
LOG2_BITS = 27
PROBES = 2
#: A filter of up to 2**FEW_LOG2_BITS bits, room for 131,072 hashes, is made on the driver of the hashes, which spares a shuffle: the driver holds a record of every task.
FEW_LOG2_BITS = 21


def bits_for(expected: int, most: int = LOG2_BITS) -> int:
    """log2 of a size with 16 bits or more for each hash, within the bounds."""
    return int(min(most, max(15, (16 * max(1, expected) - 1).bit_length())))


def bit_places(hashes: np.ndarray, log2_bits: int) -> np.ndarray:
    """PROBES rows of bit numbers."""
    step = mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    shift = np.uint64(64 - log2_bits)
    return np.stack([(hashes + np.uint64(k) * step) >> shift for k in range(PROBES)])


class Bloom:
    def __init__(self, log2_bits: int, data: np.ndarray | None = None):
        self.log2_bits = log2_bits
        self.data = np.zeros(1 << (log2_bits - 3), np.uint8) if data is None else data

    def has(self, hashes: np.ndarray) -> np.ndarray:
        places = bit_places(hashes, self.log2_bits)
        hit = (self.data[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1
        return hit.all(axis=0)

    def add(self, hashes: np.ndarray) -> None:
        places = bit_places(hashes, self.log2_bits).ravel()
        np.bitwise_or.at(self.data, places >> np.uint64(3), np.uint8(1) << (places & np.uint64(7)).astype(np.uint8))


def _segments(filters: dict[str, Bloom]) -> Iterator[pa.RecordBatch]:
    """The segments in which any bit is set."""
    grids = {k: b.data.reshape(-1, min(SEGMENT, b.data.size)) for k, b in filters.items()}
    used = np.flatnonzero(np.any([g.any(axis=1) for g in grids.values()], axis=0))
    for start in range(0, len(used), 1024):
        own = used[start : start + 1024]
        yield pa.RecordBatch.from_arrays(
            [pa.array(own.astype(np.int64)), *(pa.array([g[i].tobytes() for i in own], pa.binary()) for g in grids.values())],
            ["segment", *grids],
        )


def _joined(a: bytes, b: bytes) -> bytes:
    return (np.frombuffer(a, np.uint8) | np.frombuffer(b, np.uint8)).tobytes()


def _collect(df: DataFrame, column: str, log2_bits: int) -> Bloom:
    """At most 2**log2_bits bits come to the driver."""
    out = Bloom(log2_bits)
    width = min(SEGMENT, out.data.size)
    for batch in df.select("segment", column).toArrow().to_batches():
        for segment, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            out.data[segment * width : segment * width + width] = np.frombuffer(raw, np.uint8)
    return out


def seen_once(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], log2_bits: int = LOG2_BITS) -> Bloom:
    """A filter of all hashes; a small one is for as few of them as bits_for gives it for."""
    if log2_bits <= FEW_LOG2_BITS:

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x in hashes(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(x).view(np.int64))], ["hash"])

        out = Bloom(log2_bits)
        for batch in df.mapInArrow(gather, "hash long").toArrow().to_batches():
            out.add(batch.column(0).to_numpy().view(np.uint64))
        return out

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bloom(log2_bits)
        for batch in batches:
            for x in hashes(batch):
                own.add(x)
        yield from _segments({"bits": own})

    def merge(old, row):
        return row if old is None else row | {"bits": _joined(old["bits"], row["bits"])}

    schema = "segment long, bits binary"
    return _collect(merged_segments(df.mapInArrow(build, schema), merge, schema), "bits", log2_bits)


def holds(hashes: DataFrame) -> Callable[[Column], Column]:
    """Of a column of 64-bit hashes: whether a filter of those of the frame, its only column, holds them. Only hashes go to Python."""

    def own(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield batch.column(0).to_numpy().astype(np.uint64)

    held = hashes.sparkSession.sparkContext.broadcast(seen_once(hashes, own, bits_for(hashes.count())))
    return F.arrow_udf(lambda x: pa.array(held.value.has(x.to_numpy().astype(np.uint64))), "boolean")


def seen_twice(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], log2_bits: int = LOG2_BITS) -> Bloom:
    """A filter of the hashes that occur twice or oftener: every task keeps a filter of the hashes seen once
    and one of those seen again; a bit that two tasks have set once counts as seen again."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = Bloom(log2_bits), Bloom(log2_bits)
        for batch in batches:
            for x in hashes(batch):
                distinct, n = np.unique(x, return_counts=True)
                twice.add(distinct[(n > 1) | once.has(distinct)])
                once.add(distinct)
        yield from _segments({"once": once, "twice": twice})

    def merge(old, row):
        if old is None:
            return row
        again = (np.frombuffer(old["once"], np.uint8) & np.frombuffer(row["once"], np.uint8)).tobytes()
        return row | {"once": _joined(old["once"], row["once"]), "twice": _joined(_joined(old["twice"], row["twice"]), again)}

    schema = "segment long, once binary, twice binary"
    return _collect(merged_segments(df.mapInArrow(build, schema), merge, schema), "twice", log2_bits)
