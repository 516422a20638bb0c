"""Balanced shards by vector bin packing.

Groups of equal texts are items with three sizes: bytes, tokens and rows. Tasks pack their items, largest first, each into
the local bin where the item's dot product with the residual capacity is highest; then whole local bins are placed in
shards by the same rule, so that only three sums per task and bin are gathered. A group above a fixed share of a
shard, or of more rows than a task packs, is first split by a hash of its row numbers, because no shard could hold it and stay level,
and no task should hold it. What is longer than a block passes through its task in blocks, each of which joins the bin of the first.

The law is `bytes`: the shards' sums of sizes are nearly equal. Defined results: null text has no bytes and no tokens, and
null texts are one group; repeated rows are rows of their own; an empty table gives an empty result; other columns are
ignored."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .shared import cut

OVERHEAD = 16
#: Most tasks that pack: the driver places so many times the number of shards of local bins, however large the input.
MOST_PARTS = 4096


#: Bytes, tokens and rows in the dot product: the law is about bytes, the others follow as far as they can.
WEIGHTS = np.array([16.0, 1.0, 1.0])


class Bins:
    """Bins with equal capacities in several sizes."""

    def __init__(self, count: int, totals: np.ndarray):
        self.scale = 1.0 / np.maximum(totals, 1.0)
        self.load = np.zeros((count, len(totals)))
        self.share = 1.0 / count

    def place(self, item: np.ndarray, allowed: np.ndarray | None = None) -> int:
        """The bin with the highest dot product of the item and the residual capacity, both in shares of the total."""
        fit = (self.share - self.load * self.scale) @ (item * self.scale * WEIGHTS)
        if allowed is not None:
            fit = np.where(allowed, fit, -np.inf)
        best = int(np.argmax(fit))
        self.load[best] += item
        return best


def sized_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, grp, size, tokens, text_crc32) of every row, without the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.sha2(F.col(text_col), 256), F.lit("null")).alias("grp"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + F.when(text == "", 0).otherwise(1)).cast("long").alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )


def pack_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", per_task: int = 25_000, whole: float = 0.05, block: int = 8192) -> DataFrame:
    """(id, size, text_crc32, tokens, shard, slot). whole: the share of a shard up to which a group stays together."""
    # rows are numbered once and for all, so that a hot group of one id can be split too
    rows = cut(sized_rows(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    total = rows.agg(F.count(F.lit(1)), F.sum("size"), F.sum("tokens")).first()
    n, size = total[0], total[1] or 0
    limit = max(1.0, whole * size / shards)
    most = max(per_task, n / MOST_PARTS)  # rows of a task
    large = rows.groupBy("grp").agg(F.sum("size").alias("grp_size"), F.count(F.lit(1)).alias("grp_rows")).filter((F.col("grp_size") > limit) | (F.col("grp_rows") > most))
    # at most shards / whole groups are above the limit, and at most MOST_PARTS fill a task
    cuts = large.select(F.col("grp").alias("big"), F.ceil(F.greatest(F.col("grp_size") / F.lit(limit), F.col("grp_rows") / F.lit(most))).alias("chunks"))
    own = rows.join(F.broadcast(cuts), F.col("grp") == F.col("big"), "left").withColumn(
        "chunk", F.when(F.col("chunks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("row"), F.col("chunks"))).cast("long")
    )
    own = own.select("id", "grp", "chunk", "size", "tokens", "text_crc32")
    parts = max(1, math.ceil(n / most))
    dealt = own.repartition(parts, "grp", "chunk").sortWithinPartitions("grp", "chunk", "id")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        bins, counts = None, np.zeros(shards, np.int64)
        going: tuple[tuple, int] | None = None  # a group longer than a block that is being passed on, and its bin

        def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal bins, going
            grp, chunk = table["grp"].combine_chunks(), table["chunk"].to_numpy()
            codes = grp.dictionary_encode().indices.to_numpy()
            starts = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (chunk[1:] != chunk[:-1])))
            sizes = np.stack([table["size"].to_numpy(), table["tokens"].to_numpy(), np.ones(len(codes))], axis=1)
            items = np.add.reduceat(sizes, starts, axis=0)
            if bins is None:
                bins = Bins(shards, items.sum(axis=0))
            else:
                bins.scale = 1.0 / np.maximum(bins.load.sum(axis=0) + items.sum(axis=0), 1.0)
            target = np.full(len(starts), -1)
            if going and going[0] == (grp[0].as_py(), int(chunk[0])):
                target[0] = going[1]
                bins.load[going[1]] += items[0]
            for k in np.argsort(-(items * bins.scale).max(axis=1), kind="stable"):
                if target[k] < 0:
                    target[k] = bins.place(items[k])
            going = (grp[len(grp) - 1].as_py(), int(chunk[-1])), int(target[-1])
            at = np.repeat(target, np.diff([*starts, len(codes)]))
            order = np.argsort(at, kind="stable")
            first = np.searchsorted(at[order], np.arange(shards))
            slot = np.empty(len(at), np.int64)
            slot[order] = np.arange(len(at)) - first[at[order]]
            slot += counts[at]
            np.add.at(counts, at, 1)
            out = table.select(["id", "size", "tokens", "text_crc32"])
            for name, column in (("part", np.full(len(at), part)), ("bin", at), ("place", slot)):
                out = out.append_column(name, pa.array(column, pa.int64()))
            yield from out.combine_chunks().to_batches(max_chunksize=10_000)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= block:
                table = pa.Table.from_batches(held).combine_chunks()
                last = table.num_rows - 1
                same = pc.and_(pc.equal(table["grp"], table["grp"][last]), pc.equal(table["chunk"], table["chunk"][last]))
                k = table.num_rows - pc.sum(same).as_py()  # the last group may go on
                if not k:
                    k = table.num_rows  # it is longer than a block
                yield from flush(table.slice(0, k))
                held = table.slice(k).combine_chunks().to_batches()
        if sum(b.num_rows for b in held):
            yield from flush(pa.Table.from_batches(held).combine_chunks())

    kind = docs.schema[id_col].dataType.simpleString()
    packed = cut(dealt.mapInArrow(local, f"id {kind}, size long, tokens long, text_crc32 long, part long, bin long, place long"))
    sums = packed.groupBy("part", "bin").agg(F.sum("size"), F.sum("tokens"), F.count(F.lit(1))).orderBy("part", "bin").collect()  # at most parts * shards rows
    where = spread_bins(sums, shards)
    offsets = docs.sparkSession.createDataFrame(where, "part long, bin long, shard int, base long")
    return packed.join(F.broadcast(offsets), ["part", "bin"]).select(
        F.col("id").alias(id_col), "size", "tokens", "text_crc32", "shard", (F.col("base") + F.col("place")).alias("slot")
    )


def spread_bins(sums: list, shards: int) -> list[tuple[int, int, int, int]]:
    """(part, bin, shard, rows before) of the local bins; each shard gets one bin of each task."""
    totals = np.array([r[2:] for r in sums], float).sum(axis=0) if sums else np.ones(3)
    bins, base, out = Bins(shards, totals), np.zeros(shards, np.int64), []
    by_part: dict[int, list] = {}
    for r in sums:
        by_part.setdefault(r[0], []).append(r)
    for part in sorted(by_part, key=lambda p: -max(r[2] for r in by_part[p])):
        free = np.ones(shards, bool)
        for r in sorted(by_part[part], key=lambda r: (-r[2], r[1])):
            shard = bins.place(np.array(r[2:], float), free)
            free[shard] = False
            out.append((part, r[1], shard, int(base[shard])))
            base[shard] += r[4]
    return out


def sharding_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: law `bytes`, 40 shards."""
    return pack_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
