"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
#: A-Z to a-z, every other byte as it is.
LOWER_AZ = bytes.maketrans(UPPER, LOWER)
#: Lower-cases A-Z and blanks whatever of ASCII is neither a letter nor a digit.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words(text: bytes) -> list[bytes]:
    """Lower-cased runs of letters and digits; bytes beyond ASCII count as letters."""
    return text.translate(WORD_BYTES).split()


def spaced_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs between ASCII white space."""
    return text.translate(LOWER_AZ).split()


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a text column; null gives an empty text."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


#: Texts are worked on in runs of about so many bytes, which bounds what a worker holds beside its Arrow batch.
RUN_BYTES = 8 << 20


def text_runs(batch: pa.RecordBatch, name: str, most: int = RUN_BYTES) -> Iterator[tuple[int, pa.StringArray]]:
    """(first row, texts) of slices of about `most` bytes; null gives an empty text."""
    texts = pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
    first = 0
    while first < len(texts):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
        own = texts.slice(first, last - first)
        whole = len(own) == len(texts) and own.offset == 0
        yield first, own if whole else pa.concat_arrays([own])  # a copy of its own, without an offset
        first = last
    # a worker serves one stage after another, and its pool would keep the most that any of them has needed
    pa.default_memory_pool().release_unused()


def own_bytes(texts: pa.StringArray) -> tuple[np.ndarray, bytes]:
    """The offsets, from 0, and the bytes of the texts, which may be a slice of a longer array; without nulls."""
    if not len(texts):
        return np.zeros(1, np.int32), b""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return offsets - offsets[0], bytes(memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]])


def split_words(texts: pa.StringArray, letters: bytes) -> tuple[pa.StringArray, np.ndarray]:
    """The words of a run of texts one after another, and how many each text has. `letters` maps bytes; words lie between ASCII white space."""
    offsets, raw = own_bytes(texts)
    mapped = pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(raw.translate(letters)))
    lists = pc.ascii_split_whitespace(mapped)
    flat, counts = lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64)
    # white space at either end of a text leaves an empty piece
    empty = np.flatnonzero(pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False))
    if len(empty):
        counts = counts - np.bincount(np.repeat(np.arange(len(counts)), counts)[empty], minlength=len(counts))
        flat = flat.filter(pc.greater(pc.binary_length(flat), 0))
    return flat, counts


def slices(values: pa.StringArray) -> list[bytes]:
    """The values as bytes, many times faster than to_pylist; without nulls."""
    offsets, raw = own_bytes(values)
    offsets = offsets.tolist()
    return [raw[i:j] for i, j in zip(offsets, offsets[1:])]  # noqa: B905, RUF007


def hash_all(items: list[bytes], seed: int = 0) -> np.ndarray:
    """64-bit hashes."""
    return np.fromiter((xxhash.xxh3_64_intdigest(x, seed) for x in items), np.uint64, len(items))


def hashed_words(texts: pa.StringArray, letters: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of a run's words, one after another, and how many each text has; every distinct word is hashed once."""
    flat, counts = split_words(texts, letters)
    coded = flat.dictionary_encode()
    own = hash_all(slices(coded.dictionary))
    return own[coded.indices.to_numpy()] if len(own) else np.zeros(0, np.uint64), counts


def equal_lengths(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) of a batch's vectors by their length; null and empty vectors are left out, null components become NaN."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    flat = pc.fill_null(column.flatten().cast(pa.float64()), float("nan")).to_numpy()  # holds nothing of null vectors
    starts = np.cumsum(lengths) - lengths
    for length in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == length)
        yield length, rows, flat[starts[rows, None] + np.arange(length)]


def id_hashes(ids: pa.Array, seed: int) -> np.ndarray:
    return hash_all([str(x).encode() for x in ids.to_pylist()], seed)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def run_shingles(word_hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words of each of several texts, in order, and how many each text has; a text of fewer words, but
    some, has its whole sequence as one."""
    ends = np.cumsum(counts)
    starts = ends - counts
    most = max(0, len(word_hashes) - n + 1)
    rolled = np.full(most, n, np.uint64)
    for k in range(n):
        rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + word_hashes[k : most + k])
    sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    last = np.cumsum(sizes)
    out = np.zeros(int(last[-1]) if len(last) else 0, np.uint64)
    long = counts >= n
    at = np.repeat(starts[long] - (last - sizes)[long], sizes[long])
    places = np.repeat(long, sizes)
    out[places] = rolled[np.flatnonzero(places) + at]
    for k in np.flatnonzero((counts > 0) & ~long):
        width = int(counts[k])
        one = np.full(1, width, np.uint64)
        for j in range(width):
            one = mix(one * np.uint64(0x9E3779B97F4A7C15) + word_hashes[starts[k] + j : starts[k] + j + 1])
        out[last[k] - 1] = one[0]
    return out, sizes


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The folder is the cluster's spark.checkpoint.dir; only local sessions without one get a temporary folder."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(folder)


def private(df: DataFrame, **columns: Column) -> DataFrame:
    """(own, the named columns): the whole row as one struct, so that no name of its columns can clash, and expressions of them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("own"), *[c.alias(name) for name, c in columns.items()])


def cut(df: DataFrame) -> DataFrame:
    """Computes df once, into the shared checkpoint folder, and cuts its lineage there. Spark's context cleaner removes the files of
    frames that are no longer referenced where spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A join's hot keys are those of more than a HOT_KEYS-th of its rows, from HOT_ROWS rows on.
HOT_KEYS = 4096
HOT_ROWS = 100_000


def split_join(left: DataFrame, right: DataFrame, key: str, by: str, least: int = HOT_ROWS) -> DataFrame:
    """left joined to right by key, where no key of left is work for one task alone. A key of more rows of left than a HOT_KEYS-th of them all, and
    than `least`, falls into parts of about that many rows by a hash of left's column `by`; right's rows of the key go to each part. Fewer than
    HOT_KEYS keys are split, into fewer than twice as many parts in all, so their list is broadcast. left is read twice."""
    most = max(least, left.count() // HOT_KEYS)
    hot = left.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > most)
    hot = F.broadcast(cut(hot.select(key, F.ceil(F.col("__n") / most).cast("int").alias("__parts"))))
    parts = F.coalesce("__parts", F.lit(1))
    own = left.join(hot, key, "left").withColumn("__part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("__parts")
    others = right.join(hot, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return own.join(others, [key, "__part"]).drop("__part")


def merged_segments(parts: DataFrame, merge, schema: str) -> DataFrame:
    """Merges the rows (segment, ...) of many tasks segment by segment, as a stream: a task holds one
    row per segment, however many tasks sent one. `merge(state or None, row)` gives the new state."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        names = None
        for batch in batches:
            names = batch.schema
            for row in batch.to_pylist():
                state[row["segment"]] = merge(state.get(row["segment"]), row)
        if names is not None:
            yield pa.RecordBatch.from_pylist(list(state.values()), schema=names)

    return parts.repartition(shuffle_width(parts.sparkSession), "segment").mapInArrow(fold, schema)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared checkpoint folder."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
