"""Stupid-backoff scores of documents under the n-gram counts of the whole corpus.

Documents lie in blocks. Each block sends its distinct n-grams with their numbers to the partitions of the count tables,
dealt by hash; a partition adds the blocks' numbers up and answers each block with the counts of just the n-grams it sent, in the order
sent. The block then joins them to its exploded n-grams and sums the scores per document. N-grams travel as hashes, as wide as
the corpus needs, in packed, sorted arrays, so a row of either shuffle is a block's share of a partition.

A word's score is the relative frequency of the longest n-gram ending at it that the table holds, times alpha for each order
given up. N-grams of two words or more are in the table when the corpus has them at least min_count times; an n-gram's
history is counted in full. Words as in decontamination. Defined results: null and empty texts have no words and the score 0;
repeated rows are documents of their own and count as often; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import WORD_BYTES, hashed_words, mix, split_words, text_runs

#: Text in a block, in bytes.
BLOCK_BYTES = 8 << 20


#: N-grams are named by so many bits more than it takes to number all of them, 64 at most: one in 16 million shares its name with another.
SPARE_BITS = 24


def gram_hashes(h: np.ndarray, counts: np.ndarray, order: int, bits: int) -> list[np.ndarray]:
    """For each order the n-grams' names by their last word, of a run of texts; 0 where a text has too few words before it."""
    place = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
    shift = np.uint64(64 - bits)
    out, rolled = [mix(h + np.uint64(1)) >> shift | np.uint64(1)], h
    for n in range(2, order + 1):
        rolled = np.concatenate([np.zeros(min(1, len(h)), np.uint64), mix(rolled[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] + np.uint64(n))])
        out.append(np.where(place >= n - 1, rolled >> shift | np.uint64(1), np.uint64(0)))
    return out


def _block_grams(table: pa.Table, order: int, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """How many words each text of a block has, and its n-grams."""
    batch = table.select(["text"]).combine_chunks().to_batches()
    runs = [hashed_words(texts, WORD_BYTES) for b in batch for _, texts in text_runs(b, "text")]
    sizes = np.concatenate([c for _, c in runs]) if runs else np.zeros(0, np.int64)
    return sizes, gram_hashes(np.concatenate([h for h, _ in runs]) if runs else np.zeros(0, np.uint64), sizes, order, bits)


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, compressed, after the number of values."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unplanes(packed: bytes, kind) -> np.ndarray:
    raw = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _split(hashes: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """Ends of the equal ranges of the name space in sorted names."""
    return np.searchsorted(hashes, np.array([*((k << bits) // parts for k in range(1, parts)), (1 << bits) - 1], np.uint64), side="right")


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, alpha: float = 0.4, min_count: int = 2) -> DataFrame:
    """(id, n_words, log10_score): the sum of the decimal logarithms of the words' scores."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    parts = max(1, math.ceil(blocks / 2))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = _word_total(own)
    bits = min(64, max(1, order * total).bit_length() + SPARE_BITS)
    # whole rows are dealt, so a null or repeated id makes no large block
    dealt = own.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")).repartition(blocks, "block")

    def send(key, table):
        _, grams = _block_grams(table, order, bits)
        rows = []
        for n, g in enumerate(grams, 1):
            distinct, times = np.unique(g[g != 0], return_counts=True)
            start = 0
            for part, end in enumerate(_split(distinct, parts, bits).tolist()):
                if end > start:
                    deltas = np.diff(distinct[start:end], prepend=np.uint64(0))
                    rows.append({"part": part, "block": key[0].as_py(), "n": n, "grams": _planes(deltas), "times": _planes(times[start:end].astype(np.uint32))})
                start = end
        return pa.Table.from_pylist(rows, schema=pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), ("grams", pa.binary()), ("times", pa.binary())]))

    sent = dealt.groupBy("block").applyInArrow(send, "part int, block int, n int, grams binary, times binary")

    def count(key, table):
        lists = [np.cumsum(_unplanes(x, np.uint64)) for x in table["grams"].to_pylist()]
        times = [_unplanes(x, np.uint32).astype(np.int64) for x in table["times"].to_pylist()]
        distinct, at = np.unique(np.concatenate(lists), return_inverse=True)
        totals = np.bincount(at, weights=np.concatenate(times), minlength=len(distinct)).astype(np.int64)
        ends = np.cumsum([len(x) for x in lists])
        answers = [_planes(totals[at[e - len(x) : e]]) for x, e in zip(lists, ends, strict=True)]
        return pa.table({"part": table["part"], "block": table["block"], "n": table["n"], "totals": pa.array(answers, pa.binary())})

    counted = sent.groupBy("part", "n").applyInArrow(count, "part int, block int, n int, totals binary")

    def score(key, left, right):
        if not left.num_rows:
            return left.select(["id"]).append_column("n_words", pa.array([], pa.int64())).append_column("log10_score", pa.array([], pa.float64()))
        sizes, grams = _block_grams(left, order, bits)
        answers = pd.DataFrame({"n": right["n"].to_numpy(), "part": right["part"].to_numpy(), "totals": right["totals"].to_pylist()}).sort_values(["n", "part"])
        counts = []
        for n, g in enumerate(grams, 1):
            totals = [_unplanes(x, np.int64) for x in answers.totals[answers.n == n]]
            c = np.zeros(len(g), np.int64)
            if totals:
                _, at = np.unique(g[g != 0], return_inverse=True)
                c[g != 0] = np.concatenate(totals)[at]
            counts.append(c)
        logs = np.log10(np.maximum(counts[0], 1)) - math.log10(max(1, total)) + (order - 1) * math.log10(alpha)
        # a word near the start gives up only the orders that it has
        place = np.arange(len(logs)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        logs -= np.maximum(0, order - 1 - place) * math.log10(alpha)
        for n in range(2, order + 1):
            known = counts[n - 1] >= min_count
            history = np.concatenate([[1], counts[n - 2][:-1]]) if len(place) else counts[n - 2]
            given_up = np.minimum(order, place + 1) - n
            logs = np.where(known, np.log10(np.maximum(counts[n - 1], 1)) - np.log10(np.maximum(history, 1)) + given_up * math.log10(alpha), logs)
        edges = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
        sums = np.concatenate([[0.0], np.cumsum(logs)])
        return pa.table({"id": left["id"], "n_words": pa.array(sizes, pa.int64()), "log10_score": pa.array(sums[edges[1:]] - sums[edges[:-1]])})

    kind = docs.schema[id_col].dataType.simpleString()
    out = dealt.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(score, f"id {kind}, n_words long, log10_score double")
    return out.withColumnRenamed("id", id_col)


def _word_total(own: DataFrame) -> int:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = sum(int(split_words(texts, WORD_BYTES)[1].sum()) for _, texts in text_runs(batch, "text"))
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return own.select("text").mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0


def lm_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, log10_score and the score per word, rounded."""
    out = lm_scores(docs.select("doc_id", "text"))
    per_word = F.when(F.col("n_words") > 0, F.round(F.col("log10_score") / F.col("n_words"), 6))
    return out.select("doc_id", "n_words", F.round("log10_score", 4).alias("log10_score"), per_word.alias("log10_per_word"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
u AS (SELECT r, unnest(w) AS c, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) > 0),
g AS (SELECT r, p, c, lag(c) OVER x AS b, lag(c, 2) OVER x AS a FROM u WINDOW x AS (PARTITION BY r ORDER BY p)),
one AS (SELECT c, count(*) AS n FROM g GROUP BY c),
two AS (SELECT b, c, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY b, c),
three AS (SELECT a, b, c, count(*) AS n FROM g WHERE a IS NOT NULL GROUP BY a, b, c),
s AS (SELECT g.r, CASE WHEN t.n >= 2 THEN log10(t.n) - log10(h2.n) WHEN w2.n >= 2 THEN log10(w2.n) - log10(h1.n) + (least(3, p) - 2) * log10(0.4)
    ELSE log10(w1.n) - log10((SELECT count(*) FROM g)) + (least(3, p) - 1) * log10(0.4) END AS l
  FROM g JOIN one w1 ON g.c = w1.c LEFT JOIN two w2 ON g.b = w2.b AND g.c = w2.c LEFT JOIN one h1 ON g.b = h1.c
  LEFT JOIN three t ON g.a = t.a AND g.b = t.b AND g.c = t.c LEFT JOIN two h2 ON g.a = h2.b AND g.b = h2.c),
total AS (SELECT r, sum(l) AS l FROM s GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(l, 0), 4) AS log10_score, round(l / nullif(len(w), 0), 6) AS log10_per_word
FROM d LEFT JOIN total USING (r)
"""
