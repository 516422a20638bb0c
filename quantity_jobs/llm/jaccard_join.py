"""Exact Jaccard self-join of documents as sets of word shingles, by pivots and regions.

Whole documents make poor pivots here: all but a document's own copies lie at distance 1 from it. The first pivots
are therefore single shingles. A document lies at distance 1 - 1/size from a shingle it holds and at 1 from others, so the
regions nearest to it are those of its own shingles, rarest first; and it is replicated to as many of these as two sets
within the radius can differ in, so that any two such sets share a region. In a region, the empty set is the second
pivot: by the triangle inequality only sizes within a window can meet. Each window then joins recursively, on what is not yet
linked: first around a few pivot documents for all regions, then small regions pair by pair and large ones in tiles of
blocks, which makes the result exact and ships a document once per tile rather than once per pair. Pairs are measured on
whole sets, after a bound from sketches: a set's sketch has the parity of its shingles in each of as many cells as the set is large or more, and
two sets differ in at least as many shingles as their sketches do in cells.

Equal sets are one class throughout. Classes are named by a 64-bit hash of the set.

Defined results: null and empty texts, and texts without words, have the empty set and link with nothing; a document
with fewer words than a shingle has one shingle, its whole sequence; repeated rows are copies of each other; a row of a null
id keeps a null component when alone; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from .bloom import bits_for, seen_once, seen_twice
from .components import components
from .shared import LOWER_AZ, cut, hashed_words, id_hashes, merged_segments, mix, run_shingles, shuffle_width, text_runs

#: Word counts are kept in 2**21 cells (8 MB in a task, 2 MB as ranks), whatever the corpus.
CELLS_LOG2 = 21
CELLS_IN_SEGMENT = 128
#: Pivots differ between regions in so many ways.
PIVOT_ORDERS = 4
#: Regions of more classes than this, not yet of one component, are joined in tiles of blocks: of about so many sketches or bytes of sketches
#: first, then, among classes whose sketches leave room for a link, of about TILE sets. Up to FEW_CLASSES classes in all go to sets at once.
LARGE_REGION = 48
SKETCHES = 2048
SKETCH_BYTES = 8 << 20
TILE = 256
FEW_CLASSES = 1024
#: A task tells repeated classes by the last so many that it met.
SEEN_CLASSES = 100_000
ID_SEED = 5
_TEXT = "text"


def _ceil_div(a, b):
    return -(-a // b)


def run_sets(texts: pa.StringArray, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a run."""
    flat, sizes = run_shingles(*hashed_words(texts, LOWER_AZ), n)
    ends = np.cumsum(sizes).tolist()
    return [np.unique(flat[i:j]) for i, j in pairwise([0, *ends])]


def class_of(own: np.ndarray) -> int:
    """Name of a set, as a signed 64-bit number."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes(), len(own))).astype(np.int64))


def sketch_of(own: np.ndarray) -> bytes:
    """The parity of how many shingles fall into each cell, by their low bits; as many cells as shingles or up to twice as many, 64 at least."""
    cells = max(64, 1 << (len(own) - 1).bit_length())
    n = np.bincount((own & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits((n & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: bytes, width: int) -> np.ndarray:
    """A sketch as it would be in so many bytes, at most its own."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint64).reshape(-1, width // 8), axis=0)


def may_link(x: np.ndarray, y: np.ndarray, n, m, percent: int) -> np.ndarray:
    """Whether sets of n and m shingles can be similar enough, by their sketches x and y, of one width."""
    apart = np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)
    most = np.minimum((n + m - apart) // 2, np.minimum(n, m))
    return 100 * most >= percent * (n + m - most)


def word_ranks(docs: DataFrame) -> np.ndarray:
    """By hash cell: the binary logarithm of how many words of the corpus fall there."""
    cells, shift = 1 << CELLS_LOG2, np.uint64(64 - CELLS_LOG2)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(cells, np.int64)
        for batch in batches:
            for _, texts in text_runs(batch, _TEXT):
                own += np.bincount((hashed_words(texts, LOWER_AZ)[0] >> shift).astype(np.int64), minlength=cells)
        grid = own.reshape(-1, CELLS_IN_SEGMENT)
        used = np.flatnonzero(grid.any(axis=1))
        for k in range(0, len(used), 2048):
            part = used[k : k + 2048]
            packed = [grid[i].astype(np.int32).tobytes() if grid[i].max() < 2**31 else grid[i].tobytes() for i in part]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(packed, pa.binary())], ["segment", "n"])

    def widen(x: bytes) -> np.ndarray:
        return np.frombuffer(x, np.int32 if len(x) == 4 * CELLS_IN_SEGMENT else np.int64)

    def merge(old, row):
        return row if old is None else row | {"n": (widen(old["n"]).astype(np.int64) + widen(row["n"])).tobytes()}

    schema = "segment long, n binary"
    ranks = np.zeros(cells, np.uint8)
    for batch in merged_segments(docs.select(_TEXT).mapInArrow(count, schema), merge, schema).toArrow().to_batches():  # 16 MB at most
        for segment, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ranks[segment * CELLS_IN_SEGMENT :][:CELLS_IN_SEGMENT] = np.ceil(np.log2(widen(n) + 1.0))
    return ranks


def regions(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(id, cls, n_shingles) of every row, and (id, cls, size, inner, sketch, regions): each class, once per task that met it, with its
    sketch and its regions, nearest first. The first `inner` ones are within reach of partners of at least the class's own size."""
    ranks = docs.sparkSession.sparkContext.broadcast(word_ranks(docs))
    shift = np.uint64(64 - CELLS_LOG2)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for start, texts in text_runs(batch, _TEXT):
                h, counts = hashed_words(texts, LOWER_AZ)
                flat, sizes = run_shingles(h, counts, n)
                rank = ranks.value[(h >> shift).astype(np.int64)]
                classes, lengths, inners, sketches, lists = [], [], [], [], []
                word, shingle = 0, 0
                for words_, size in zip(counts.tolist(), sizes.tolist(), strict=True):
                    own, first = np.unique(flat[shingle : shingle + size], return_index=True)
                    own_rank = rank[word : word + words_]
                    word, shingle = word + words_, shingle + size
                    cls = class_of(own) if size else None
                    classes.append(cls)
                    lengths.append(len(own))
                    if cls is None or cls in seen:
                        for x in (inners, sketches, lists):
                            x.append(None)
                        continue
                    if len(seen) >= SEEN_CLASSES:
                        seen.clear()
                    seen.add(cls)
                    # a shingle is as rare as its rarest word
                    least = own_rank[:size]
                    for k in range(1, min(n, words_)):
                        least = np.minimum(least, own_rank[k : k + size])
                    least = least[first]
                    reach = len(own) - _ceil_div(percent * len(own), 100) + 1
                    chosen = np.lexsort((own, least))[:reach]
                    inners.append(len(own) - _ceil_div(2 * percent * len(own), 100 + percent) + 1)
                    sketches.append(sketch_of(own))
                    lists.append(own[chosen].astype(np.int64))
                offsets = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in lists])]).astype(np.int32)
                values = np.concatenate([np.zeros(0, np.int64), *(x for x in lists if x is not None)])
                packed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array([x is None for x in lists], pa.bool_()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), pa.array(classes, pa.int64()), *(pa.array(x, pa.int32()) for x in (lengths, inners)), pa.array(sketches, pa.binary()), packed],
                    ["id", "cls", "size", "inner", "sketch", "regions"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    both = cut(docs.select("id", _TEXT).mapInArrow(name, f"id {kind}, cls long, size int, inner int, sketch binary, regions array<long>"))
    return both.select("id", "cls", F.col("size").cast("long").alias("n_shingles")), both.filter("regions IS NOT NULL")


def placed_rows(prefixes: DataFrame) -> DataFrame:
    """(region, cls, code): the classes in regions that a filter of fixed size suspects to hold two or more; code is twice the size, plus 1
    where the region is an inner one."""

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield batch.column(0).flatten().to_numpy().astype(np.uint64)

    expected = prefixes.agg(F.sum(F.size("regions"))).first()[0] or 0
    twice = prefixes.sparkSession.sparkContext.broadcast(seen_twice(prefixes.select("regions"), hashes, bits_for(expected)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, size, inner, lists = (batch.column(k) for k in range(4))
            lengths = pc.list_value_length(lists).to_numpy()
            values = lists.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), lengths)
            at = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            keep = np.flatnonzero(twice.value.has(values.astype(np.uint64)))
            row, at = row[keep], at[keep]
            code = 2 * size.to_numpy()[row] + (at < inner.to_numpy()[row])
            yield pa.RecordBatch.from_arrays([pa.array(values[keep]), pa.array(cls.to_numpy()[row]), pa.array(code.astype(np.int32))], ["region", "cls", "code"])

    return prefixes.select("cls", "size", "inner", "regions").mapInArrow(place, "region long, cls long, code int")


def _by_region(batches: Iterator[pa.RecordBatch], names: list[str], empty: bool = False) -> Iterator[list[np.ndarray]]:
    """The columns of one region after another, from batches sorted by region; regions of one row are left out."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names]
        key = columns[0]
        edges = np.flatnonzero(key[1:] != key[:-1]) + 1
        starts, ends = [0, *edges.tolist()], [*edges.tolist(), len(key)]
        if held and held[-1][0][0] == key[0]:
            held.append([c[: ends[0]] for c in columns])
            starts, ends = starts[1:], ends[1:]
            if not starts:
                continue
        if held:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
        for s, e in zip(starts[:-1], ends[:-1], strict=True):
            if e - s > 1:
                yield [c[s:e] for c in columns]
        held = [[c[starts[-1] :].copy() for c in columns]]
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _sorted_regions(rows: DataFrame) -> DataFrame:
    return rows.repartition(shuffle_width(rows.sparkSession), "region").sortWithinPartitions("region", "code", "cls")


def _pair_batches(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Distinct (a, b) among about a million at a time."""
    left, right, held = [], [], 0

    def out():
        both = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1)
        for k in range(0, both.shape[1], 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(both[0, k : k + 50_000]), pa.array(both[1, k : k + 50_000])], ["a", "b"])

    for a, b in pairs:
        if len(a):
            left.append(np.minimum(a, b))
            right.append(np.maximum(a, b))
            held += len(a)
        if held > 1_000_000:
            yield from out()
            left, right, held = [], [], 0
    if held:
        yield from out()


def _windows(order: int, cls: np.ndarray, size: np.ndarray, inner: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """In each size window of a region, its pivot document with the others, and the ends and pivots of neighbouring windows. The order
    decides which document is the pivot."""
    turn = mix(cls.astype(np.uint64) ^ mix(np.array([order], np.int64).astype(np.uint64)))
    start, last = 0, None
    while start < len(cls):
        end = int(np.searchsorted(size, int(size[start]) * 100 // percent, side="right"))
        candidates = np.flatnonzero(inner[start:end])
        if len(candidates):
            p = start + int(candidates[np.argmin(turn[start:end][candidates])])
            others = np.arange(start, end)
            others = others[(others != p) & ((others > p) | inner[start:end])]
            yield np.full(len(others), cls[p]), cls[others]
            if last is not None and int(size[p]) * percent <= int(size[last]) * 100:
                yield cls[last : last + 1], cls[p : p + 1]
            last = p
        if end < len(cls) and inner[end - 1] and int(size[end]) * percent <= int(size[end - 1]) * 100:
            yield cls[end - 1 : end], cls[end : end + 1]
        start = end


def shared_and_pivots(placed: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(region, cls, code) of the regions that hold three classes or more, each class once, and (a, b): the pairs around pivot documents, which
    leave out nothing in regions of two."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = []
        pairs: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            if out:
                rows = [np.concatenate(c) for c in zip(*out, strict=True)]
                none = pa.nulls(len(rows[0]), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2]), none, none], ["region", "cls", "code", "a", "b"])
            for batch in _pair_batches(iter(pairs)):
                none = pa.nulls(batch.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.nulls(batch.num_rows, pa.int32()), *batch.columns], ["region", "cls", "code", "a", "b"])

        held = 0
        for region, cls, code in _by_region(batches, ["region", "cls", "code"]):
            first = np.append(True, cls[1:] != cls[:-1])
            if first.sum() > 1:
                cls, code = cls[first], code[first]
                if len(cls) > 2:
                    out.append([region[first], cls, code])
                pairs += _windows(int(region[0]) & (PIVOT_ORDERS - 1), cls, code >> 1, code % 2 == 1, percent)
                held += len(cls)
            if held > 200_000:
                yield from flush()
                out, pairs, held = [], [], 0
        if held:
            yield from flush()

    found = cut(_sorted_regions(placed).mapInArrow(both, "region long, cls long, code int, a long, b long"))
    return found.filter("a IS NULL").select("region", "cls", "code"), found.filter("a IS NOT NULL").select("a", "b").distinct()


def rest_pairs(linked: DataFrame, percent: int, large: int = LARGE_REGION) -> tuple[DataFrame, DataFrame]:
    """Of regions that hold several components: (a, b), all pairs of size windows across components, of the regions up to `large` classes; and
    (a, b) that join the classes of larger ones to clusters."""

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stars: list[tuple[np.ndarray, np.ndarray]] = []

        def pairs():
            for _, cls, code, group in _by_region(batches, ["region", "cls", "code", "grp"]):
                if (group == group[0]).all():
                    continue
                if len(cls) > large:
                    stars.append((np.full(len(cls) - 1, cls[0]), cls[1:]))
                    continue
                size = code >> 1
                upto = np.searchsorted(size, size.astype(np.int64) * 100 // percent, side="right")
                for k in np.flatnonzero(code % 2 == 1):
                    other = np.arange(k + 1, upto[k])
                    other = other[group[other] != group[k]]
                    yield np.full(len(other), cls[k]), cls[other]

        for batch in _pair_batches(pairs()):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([False] * batch.num_rows)], ["a", "b", "star"])
        for batch in _pair_batches(iter(stars)):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([True] * batch.num_rows)], ["a", "b", "star"])

    found = cut(_sorted_regions(linked).mapInArrow(across, "a long, b long, star boolean").distinct())
    return found.filter("NOT star").select("a", "b"), found.filter("star").select("a", "b")


def _tree_links(x: list[np.ndarray], y: list[np.ndarray], names: list[int], other: list[int], same: bool, groups: list[int], others: list[int], percent: int) -> list[tuple[int, int]]:
    """Links between two blocks of sets, enough of them to join what belongs together; what already is in one group isn't measured."""
    top: dict[int, int] = {}

    def find(g: int) -> int:
        while top.setdefault(g, g) != g:
            top[g] = top[top[g]]
            g = top[g]
        return g

    out = []
    for i, own in enumerate(x):
        for j in range(i + 1 if same else 0, len(y)):
            n, m = len(own), len(y[j])
            if min(n, m) * 100 < percent * max(n, m) or find(groups[i]) == find(others[j]):
                continue
            common = len(np.intersect1d(own, y[j], assume_unique=True))
            if 100 * common >= percent * (n + m - common):
                out.append((names[i], other[j]))
                top[find(groups[i])] = find(others[j])
    return out


def likely_links(clusters: DataFrame, n_classes: int, groups: DataFrame, prefixes: DataFrame, percent: int, tile: int = SKETCHES) -> DataFrame:
    """(a, b): enough pairs of a cluster's classes, across groups, to join all that their sketches leave room to link. Sizes of linked sets differ by a
    bounded factor: of bands that wide, each and the next one make a cell, whose classes fall into blocks, and every two blocks are one task."""
    held = clusters.sparkSession.sparkContext.broadcast(seen_once(clusters.select("id"), _class_hashes, bits_for(n_classes)))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(held.value.has(batch.column(0).to_numpy().astype(np.uint64))))

    picked = prefixes.select("cls", "size", "sketch").mapInArrow(pick, "cls long, size int, sketch binary").dropDuplicates(["cls"])
    placed = _grouped(clusters, groups).join(picked, "cls")
    band = F.floor(F.log("size") / float(np.log(100 / percent) * 1.001))  # so that rounding puts no two linked sizes two bands apart
    placed = cut(placed.withColumn("cell", F.explode(F.array(band, band + 1))))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / tile, F.sum(F.length("sketch")) / SKETCH_BYTES))
    dealt = _dealt(placed, placed.groupBy("component", "cell").agg(blocks.alias("blocks")), ["component", "cell"])

    def join(key, table):
        block, cls, grp, size = (table[c].to_numpy() for c in ("block", "cls", "grp", "size"))
        raw = table["sketch"].to_pylist()
        width = min(map(len, raw))
        own = np.stack([folded(x, width) for x in raw])
        i, j = key[2].as_py(), key[3].as_py()
        right, top, found = np.flatnonzero(block == j), list(range(len(cls))), []

        def find(k: int) -> int:
            while top[k] != k:
                top[k] = k = top[top[k]]
            return k

        for k in np.flatnonzero(block == i).tolist():
            others = right[right > k] if i == j else right
            others = others[grp[others] != grp[k]]
            for x in others[may_link(own[others], own[k], size[others].astype(np.int64), int(size[k]), percent)].tolist():
                if (p := find(k)) != (q := find(x)):
                    top[q] = p
                    found.append((cls[k], cls[x]))
        return pa.table({"a": pa.array([min(p) for p in found], pa.int64()), "b": pa.array([max(p) for p in found], pa.int64())})

    return dealt.select("component", "cell", "i", "j", "block", "cls", "grp", "size", "sketch").groupBy("component", "cell", "i", "j").applyInArrow(join, "a long, b long")


def _grouped(clusters: DataFrame, groups: DataFrame) -> DataFrame:
    """(component, cls, grp): the classes of clusters with the groups that they are linked in."""
    own = groups.select(F.col("id").alias("g_id"), F.col("component").alias("grp"))
    return clusters.join(own, F.col("id") == F.col("g_id"), "left").select("component", F.col("id").alias("cls"), F.coalesce("grp", "id").alias("grp"))


def _dealt(placed: DataFrame, sizes: DataFrame, key: list[str]) -> DataFrame:
    """Each class in a block of its key's, once for every block that it meets: i and j are the two."""
    own = placed.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    own = own.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return own.withColumns({"i": F.least("block", "with"), "j": F.greatest("block", "with")})


def tiled_links(stars: DataFrame, groups: DataFrame, docs: DataFrame, prefixes: DataFrame, n: int, percent: int, tile: int = TILE, sketches: int = SKETCHES) -> DataFrame:
    """(a, b): links within the clusters of large regions. What sketches leave of a cluster falls into blocks, and every two blocks are one task."""
    clusters = cut(components(stars))
    if not (n_classes := clusters.count()):
        return stars
    if n_classes > FEW_CLASSES:
        clusters = cut(components(likely_links(clusters, n_classes, groups, prefixes, percent, sketches)))
        n_classes = clusters.count()
    if not n_classes:
        return clusters.select(F.col("id").alias("a"), F.col("component").alias("b"))
    held = stars.sparkSession.sparkContext.broadcast(seen_once(clusters.select("id"), _class_hashes, bits_for(n_classes)))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(held.value.has(batch.column(1).to_numpy().astype(np.uint64)))).select(["cls", "id"])

    kind = prefixes.schema["id"].dataType.simpleString()
    ids = cut(prefixes.select("id", "cls").mapInArrow(pick, f"cls long, id {kind}"))
    own = sets_of(docs, ids.select("id"), n)
    sizes = clusters.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / tile).alias("blocks"))
    rows = _dealt(_grouped(clusters, groups).join(own, "cls"), sizes, ["component"]).select("component", "i", "j", "block", "cls", "grp", "own")

    def join(key, table):
        block, cls, grp = (table[c].to_pylist() for c in ("block", "cls", "grp"))
        raw = [np.frombuffer(b, np.uint64) for b in table["own"].to_pylist()]
        i, j = key[1].as_py(), key[2].as_py()
        left = [k for k, b in enumerate(block) if b == i]
        right = left if i == j else [k for k, b in enumerate(block) if b == j]
        at = lambda values, rows: [values[k] for k in rows]
        found = _tree_links(at(raw, left), at(raw, right), at(cls, left), at(cls, right), i == j, at(grp, left), at(grp, right), percent)
        return pa.table({"a": pa.array([min(p) for p in found], pa.int64()), "b": pa.array([max(p) for p in found], pa.int64())})

    return rows.groupBy("component", "i", "j").applyInArrow(join, "a long, b long")


def sets_of(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(cls, own): the sets of the documents that a filter of the ids holds, each class once."""

    def wanted_ids(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield id_hashes(batch.column(0), ID_SEED)

    held = docs.sparkSession.sparkContext.broadcast(seen_once(ids, wanted_ids, bits_for(ids.count())))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            few = batch.filter(pa.array(held.value.has(id_hashes(batch.column(0), ID_SEED))))
            for _, texts in text_runs(few, _TEXT):
                own = [x for x in run_sets(texts, n) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([class_of(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], ["cls", "own"])

    return docs.select("id", _TEXT).mapInArrow(sets, "cls long, own binary").dropDuplicates(["cls"])


def _class_hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    yield batch.column(0).to_numpy().astype(np.uint64)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("cls"))


def _sides(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """pairs with the columns of both ends, as x and y."""
    x = table.select(F.col("cls").alias("a"), F.struct(*columns).alias("x"))
    y = table.select(F.col("cls").alias("b"), F.struct(*columns).alias("y"))
    return pairs.join(x, "a").join(y, "b")


def plausible(pairs: DataFrame, n_pairs: int, prefixes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The pairs whose sketches leave enough room for a link, and (cls, id) of one document for each class of pairs."""
    held = pairs.sparkSession.sparkContext.broadcast(seen_once(_ends(pairs), _class_hashes, bits_for(2 * n_pairs)))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(held.value.has(batch.column(0).to_numpy().astype(np.uint64))))

    own = prefixes.select("cls", "id", "size", "sketch")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema)
    picked = own.mapInArrow(pick, schema).dropDuplicates(["cls"])
    picked = cut(picked.join(_ends(pairs).distinct(), "cls", "left_semi"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                width = min(len(x["sketch"]), len(y["sketch"]))
                ok.append(may_link(folded(x["sketch"], width), folded(y["sketch"], width), x["size"], y["size"], percent))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    both = _sides(pairs, picked, ["size", "sketch"]).select("a", "b", "x", "y")
    return cut(both.mapInArrow(bound, "a long, b long")), picked.select("cls", "id")


def within(pairs: DataFrame, docs: DataFrame, prefixes: DataFrame, n: int, percent: int) -> DataFrame:
    """Of the pairs of classes (a, b), those whose sets are similar enough; measured on whole sets."""
    if not (n_pairs := pairs.count()):
        return pairs
    near, where = plausible(pairs, n_pairs, prefixes, percent)
    made = sets_of(docs, cut(where.join(_ends(near).distinct(), "cls", "left_semi").select("id")), n)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x["own"], np.uint64), np.frombuffer(y["own"], np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return _sides(near, made, ["own"]).select("a", "b", "x", "y").mapInArrow(measure, "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, large: int = LARGE_REGION) -> DataFrame:
    """(id, n_shingles, component_id) of every row; component_id is the smallest id reachable by links, itself included."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias(_TEXT))
    members, prefixes = regions(own, n, percent)
    shared, pivots = shared_and_pivots(placed_rows(prefixes), percent)
    tested = cut(pivots)
    links = cut(within(tested, own, prefixes, n, percent))
    groups = cut(components(links))
    grouped = shared.join(groups, F.col("cls") == F.col("id"), "left").select("region", "cls", "code", F.coalesce("component", "cls").alias("grp"))
    more, stars = rest_pairs(grouped, percent, large)
    more = cut(more.join(tested, ["a", "b"], "left_anti"))
    links = cut(links.union(within(more, own, prefixes, n, percent)).union(tiled_links(stars, groups, own, prefixes, n, percent)))
    linked = components(links)
    classed = members.join(linked.withColumnRenamed("id", "__cls"), F.col("cls") == F.col("__cls"), "left").select("id", "n_shingles", F.coalesce("component", "cls").alias("grp"))
    least = classed.filter("grp IS NOT NULL").groupBy("grp").agg(F.min("id").alias("least"))
    return (
        classed.join(least, "grp", "left").select(F.col("id").alias(id_col), "n_shingles", F.coalesce("least", "id").alias("component_id"))
    )


def jaccard_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: four-word shingles, similarity 0.85."""
    return jaccard_components(docs.select("doc_id", "text"), n=4, percent=85)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 3, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
p AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT p.b, r.c FROM r JOIN p ON r.id = p.a)
SELECT r.id AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n ON r.id = n.doc_id GROUP BY r.id
"""
