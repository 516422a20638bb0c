"""Removal of lines that many documents share.

Two Bloom filters of bounded size find the line keys that occur in two documents or more; only the lines that
the second filter suspects are shuffled, counted exactly and, for keep="first", given a first occurrence. The keys found go to
all tasks while they are few enough, so that texts are rewritten where they lie; beyond that size they are joined, hot keys in
parts, to the suspected lines of each document, and only the texts of documents that lose lines travel.

Texts are split at newlines. A key is the line without ASCII white space at its ends, A-Z lower-cased. Defined
results: null or empty text is one empty line; empty keys are never dropped; each row counts as one document, also
when rows repeat; for keep="first" the rows of the smallest id keep a line, once each, and a null id is the largest;
an empty table gives an empty result; other columns pass through, whatever their names, but for n_lines and n_dropped,
which are replaced."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType

from .bloom import LOG2_BITS, Bloom, bits_for, seen_once, seen_twice
from .shared import LOWER_AZ, cut, hash_all, id_hashes, own_bytes, private, slices, text_runs

BLANK = " \t\n\x0b\x0c\r"
#: Repeated keys of more bytes than this are joined instead of sent to all tasks.
BROADCAST_BYTES = 32 << 20
#: A key in more documents than this is joined in SALTS parts.
HOT_DOCS = 2_000
SALTS = 32
ID_SEED = 11


def keyed_lines(texts: pa.StringArray, min_chars: int) -> tuple[pa.StringArray, np.ndarray, np.ndarray, np.ndarray]:
    """A run's distinct keys, which of them count, the lines as numbers of keys, and how many lines each text has."""
    raw = pa.StringArray.from_buffers(len(texts), *_lowered(texts))
    lists = pc.split_pattern(raw, "\n")
    coded = pc.ascii_trim(lists.flatten(), characters=BLANK).dictionary_encode()
    valid = pc.greater_equal(pc.utf8_length(coded.dictionary), max(1, min_chars)).to_numpy(zero_copy_only=False)
    return coded.dictionary, valid, coded.indices.to_numpy(), pc.list_value_length(lists).to_numpy().astype(np.int64)


def _lowered(texts: pa.StringArray) -> tuple[pa.Buffer, pa.Buffer]:
    offsets, raw = own_bytes(texts)
    return pa.py_buffer(offsets), pa.py_buffer(raw.translate(LOWER_AZ))


def _once_per_text(codes: np.ndarray, counts: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, key's number) of the kept keys of each text, each once."""
    at = np.flatnonzero(keep[codes])
    row = np.repeat(np.arange(len(counts)), counts)[at]
    both = np.unique(row * max(1, len(keep)) + codes[at])
    return both // max(1, len(keep)), both % max(1, len(keep))


def repeat_filter(texts: DataFrame, min_chars: int, log2_bits: int) -> Bloom:
    """A filter of the keys in two of the texts or more; its size follows the number of lines."""
    lines = texts.agg(F.sum(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, run in text_runs(batch, "text"):
            keys, valid, codes, counts = keyed_lines(run, min_chars)
            yield hash_all(slices(keys))[_once_per_text(codes, counts, valid)[1]]

    return seen_twice(texts, hashes, bits_for(lines, log2_bits))


def suspected_lines(texts: DataFrame, min_chars: int, log2_bits: int) -> DataFrame:
    """(id, key) of (id, text): each text's distinct keys that the filter of twice-seen hashes holds."""
    twice = texts.sparkSession.sparkContext.broadcast(repeat_filter(texts.select("text"), min_chars, log2_bits))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, run in text_runs(batch, "text"):
                keys, valid, codes, counts = keyed_lines(run, min_chars)
                row, code = _once_per_text(codes, counts, valid & twice.value.has(hash_all(slices(keys))))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + row)), keys.take(pa.array(code)).cast(pa.binary())], ["id", "key"])

    return texts.mapInArrow(emit, StructType([texts.schema["id"], StructField("key", BinaryType())]))


def _rewritten(own: pa.StructArray, names: list[str], text_col: str, min_chars: int, gone, all_ids: list | None) -> Iterator[pa.RecordBatch]:
    """own, the text without the lines whose keys go, how many lines there were and how many went. gone(first, keys) gives for each of a
    run's keys its number among the keys that go, or -1, and the ids that keep a line; all_ids are given where ids matter."""
    batch = pa.RecordBatch.from_arrays([own.field(names.index(text_col))], ["text"])
    for first, run in text_runs(batch, "text"):
        keys, valid, codes, counts = keyed_lines(run, min_chars)
        number, keepers = gone(keys)
        hit = (valid & (number >= 0))[codes]
        ends = np.cumsum(counts)
        dropped = np.diff(np.concatenate([[0], np.cumsum(hit)])[ends], prepend=0)
        texts = {}
        for row in np.flatnonzero(dropped).tolist():
            start, end = int(ends[row] - counts[row]), int(ends[row])
            keep = ~hit[start:end]
            if keepers is not None:
                seen = set()
                for k in np.flatnonzero(~keep).tolist():
                    n = number[codes[start + k]]
                    if n not in seen and keepers[n] == all_ids[first + row]:
                        keep[k] = True
                        dropped[row] -= 1
                    seen.add(n)
            texts[row] = "\n".join(compress(run[row].as_py().split("\n"), keep.tolist()))
        if texts:
            rows = list(texts)
            mask = np.zeros(len(run), bool)
            mask[rows] = True
            run = pc.replace_with_mask(run, pa.array(mask), pa.array([texts[r] for r in rows], pa.string()))
        yield pa.RecordBatch.from_arrays([own.slice(first, len(run)), run, pa.array(counts), pa.array(dropped.astype(np.int64))], ["own", "kept", "n_lines", "n_dropped"])


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    keep: str = "none",
    log2_bits: int = LOG2_BITS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """docs with the text rewritten, and the columns n_lines (before) and n_dropped.

    Keys of at least min_chars code points in at least min_docs documents lose their lines: all of them
    (keep="none"), or all but the first line of the document with the smallest id (keep="first")."""
    if keep not in ("none", "first"):
        raise ValueError(f"keep is 'none' or 'first', not {keep!r}")
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    suspects = suspected_lines(texts, min_chars, log2_bits)
    repeated = suspects.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *([F.min("id").alias("first_id")] if keep == "first" else []))
    repeated = cut(repeated.filter(F.col("n") >= min_docs))
    size = repeated.agg(F.sum(F.octet_length("key") + 32)).first()[0] or 0
    rows = private(docs, id=F.col(id_col))
    schema = StructType([rows.schema["own"], StructField("kept", StringType()), StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    if size <= broadcast_bytes:
        out = rows.mapInArrow(_by_broadcast(repeated, names, text_col, min_chars), schema)
    else:
        out = _by_join(rows, suspects, repeated, names, text_col, min_chars, schema)
    return out.select(*[F.col("kept").alias(c) if c == text_col else F.col(f"own.`{c}`") for c in names], "n_lines", "n_dropped")


def _by_broadcast(repeated: DataFrame, names: list[str], text_col: str, min_chars: int):
    """Rewrites with the keys at hand; their size has been checked."""
    found = repeated.toArrow()
    keys = found["key"].cast(pa.string()).combine_chunks()
    first_ids = found["first_id"].to_pylist() if "first_id" in found.column_names else None
    sent = repeated.sparkSession.sparkContext.broadcast((pa.array(keys, pa.string()), first_ids))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_keys, keepers = sent.value
        gone = lambda own: (pc.fill_null(pc.index_in(own, value_set=all_keys), -1).to_numpy(), keepers)
        for batch in batches:
            yield from _rewritten(batch.column(0), names, text_col, min_chars, gone, batch.column(1).to_pylist() if keepers is not None else None)

    return rewrite


def _by_join(rows: DataFrame, suspects: DataFrame, repeated: DataFrame, names: list[str], text_col: str, min_chars: int, schema: StructType) -> DataFrame:
    """Rewrites after a join of suspected lines with the repeated keys by (key, part), then by id with the documents that lose lines."""
    context = rows.sparkSession.sparkContext
    first = "first_id" in repeated.columns

    def key_hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield hash_all(batch.column(0).to_pylist())

    hot = repeated.filter(F.col("n") > HOT_DOCS).select("key")
    hot = context.broadcast(seen_once(hot, key_hashes, bits_for(hot.count())))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = pa.array(hot.value.has(hash_all(batch.column(batch.schema.get_field_index("key")).to_pylist())))
            yield pa.RecordBatch.from_arrays([*batch.columns, held], [*batch.schema.names, "hot"])

    marked = lambda df: df.mapInArrow(mark, StructType([*df.schema.fields, StructField("hot", BooleanType())]))
    parts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = marked(repeated).select("key", F.explode(parts).alias("part"), *(["first_id"] if first else []))
    left = marked(suspects).select("id", "key", F.when(F.col("hot"), F.pmod(F.xxhash64("id", "key"), F.lit(SALTS)).cast("int")).otherwise(0).alias("part"))
    keeper = F.col("id").eqNullSafe(F.col("first_id")) if first else F.lit(False)
    drops = cut(left.join(right, ["key", "part"]).groupBy("id").agg(F.collect_set(F.struct("key", keeper.alias("keeper"))).alias("hits")))

    def ids(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield id_hashes(batch.column(0), ID_SEED)

    losing = context.broadcast(seen_once(drops.select("id"), ids, bits_for(drops.count())))

    def pick(wanted: bool):
        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(losing.value.has(id_hashes(batch.column(1), ID_SEED)) == wanted))

        return rows.mapInArrow(own, rows.schema)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, hits in enumerate(batch.column(1).to_pylist()):
                # where the document keeps a line, its id is the keeper's
                kept = [h["keeper"] for h in hits or []]
                own_keys = pa.array([h["key"] for h in hits or []], pa.binary()).cast(pa.string())
                gone = lambda keys, own_keys=own_keys, kept=kept: (pc.fill_null(pc.index_in(keys, value_set=own_keys), -1).to_numpy(), kept)
                yield from _rewritten(batch.column(0).slice(k, 1), names, text_col, min_chars, gone, [True])

    moved = pick(True).join(drops.withColumnRenamed("id", "drop_id"), F.col("id").eqNullSafe(F.col("drop_id")), "left").select("own", "hits")
    still = pick(False).select("own", F.lit(None).cast(drops.schema["hits"].dataType).alias("hits"))
    return moved.union(still).mapInArrow(rewrite, schema)


def line_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of dedup_lines."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT r, doc_id, pos, line, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
bad AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(bad.key) AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY pos) FILTER (bad.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN bad ON k.key = bad.key GROUP BY k.r, k.doc_id
"""
