"""Benchmark decontamination by a distributed positional inverted index.

The index holds, for the terms that a query needs, one posting per term and document with the sorted word
positions. Each benchmark window is looked up by its rarest terms: their position lists, each shifted by the term's
offset in the item, are intersected per document. Aligned lists give candidate phrases, which are then checked
word by word; lists that come within a slop give proximity matches.

Words are runs of letters and digits, A-Z lower-cased; bytes beyond ASCII count as letters. Defined results: null and
empty texts have no words and match nothing; items without words have no windows; an item of fewer words than a window is
one window; repeated item ids share one count; repeated rows are answered alike; extra columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .bloom import Bloom, bits_for, seen_once
from .shared import WORD_BYTES, as_bytes, cut, hash_all, id_hashes, slices, split_join, split_words, text_runs, words

WINDOW = 13
ANCHORS = 2
ID_SEED = 7


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, words, key): the word lists of items that have any; key names the item and its words, as ids may repeat."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [words(t) for t in as_bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.binary()))], ["item", "words"])

    kind = items.schema[id_col].dataType.simpleString()
    own = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    return own.mapInArrow(split, f"item {kind}, words array<binary>").filter("size(words) > 0").distinct().withColumn("key", F.xxhash64("item", "words"))


def term_filter(terms: DataFrame) -> Bloom:
    """A filter of bounded size of the distinct terms."""

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield hash_all(batch.column(0).to_pylist())

    return seen_once(terms.select("term"), hashes, bits_for(terms.count()))


def _coded(texts: pa.StringArray, terms: Bloom) -> tuple[pa.StringArray, np.ndarray, np.ndarray, np.ndarray]:
    """A run's distinct words, which of them the filter holds, the words as numbers of distinct words, and how many each text has."""
    flat, counts = split_words(texts, WORD_BYTES)
    coded = flat.dictionary_encode()
    held = terms.has(hash_all(slices(coded.dictionary))) if len(flat) else np.zeros(0, bool)
    return coded.dictionary, held, coded.indices.to_numpy(), counts


def term_counts(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n), to be summed: how often the terms, and what their filter takes for them, occur in the whole corpus. Tasks count their own first."""
    test = docs.sparkSession.sparkContext.broadcast(term_filter(terms))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_runs(batch, "text"):
                distinct, held, codes, _ = _coded(texts, test.value)
                n = np.bincount(codes, minlength=len(distinct))
                yield pa.RecordBatch.from_arrays([distinct.filter(pa.array(held)).cast(pa.binary()), pa.array(n[held].astype(np.int64))], ["term", "n"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(count, "term binary, n long")


def postings(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index: (term, doc, positions) of the given terms, and what their filter takes for them, in all documents."""
    test = docs.sparkSession.sparkContext.broadcast(term_filter(terms))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_runs(batch, "text"):
                distinct, held, codes, counts = _coded(texts, test.value)
                at = np.flatnonzero(held[codes]) if len(codes) else np.zeros(0, np.int64)
                ends = np.cumsum(counts)
                row = np.searchsorted(ends, at, side="right")
                order = np.lexsort((at, codes[at], row))
                row, code, place = row[order], codes[at][order], (at - (ends - counts)[row])[order]
                starts = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (code[1:] != code[:-1]))) if len(row) else np.zeros(0, np.int64)
                places = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)).astype(np.int32)), pa.array(place.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(first + row[starts])), distinct.take(pa.array(code[starts])).cast(pa.binary()), places], ["doc", "term", "positions"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    return own.mapInArrow(index, f"doc {kind}, term binary, positions array<int>")


def anchors(items: DataFrame, counts: DataFrame, window: int = WINDOW, k: int = ANCHORS) -> DataFrame:
    """(key, term, place, pair, role, n_roles): each window's k rarest places; windows with the same places share a pair."""
    placed = items.select("key", F.posexplode("words").alias("place", "term"), F.size("words").alias("size"))
    rarity = placed.join(counts.join(placed.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n")), "term", "left")
    starts = F.sequence(F.greatest(F.lit(0), F.col("place") - (window - 1)), F.least(F.col("place"), F.greatest(F.lit(0), F.col("size") - window)))
    best = (
        rarity.select("key", "term", "place", F.coalesce("n", F.lit(0)).alias("n"), F.explode(starts).alias("start"))
        .withColumn("rank", F.row_number().over(Window.partitionBy("key", "start").orderBy("n", "place")))
        .filter(F.col("rank") <= k)
        .groupBy("key", "start")
        .agg(F.array_sort(F.collect_list(F.struct("place", "term"))).alias("places"))
        .select("key", "places", F.xxhash64("key", "places.place").alias("pair"))
        .distinct()
    )
    return best.select("key", "pair", F.size("places").alias("n_roles"), F.posexplode("places").alias("role", "x")).select(
        "key", "pair", "n_roles", "role", F.col("x.place").alias("place"), F.col("x.term").alias("term")
    )


def aligned(index: DataFrame, marks: DataFrame, slop: int = 0) -> DataFrame:
    """(doc, key, shift): where all of a pair's shifted position lists meet, or come within slop words.
    shift is the document position of the item's first word (may be negative); with a slop, the least of those that come together."""
    hits = split_join(index, marks, "term", "doc").select("doc", "key", "pair", "n_roles", "role", F.explode("positions").alias("p"), "place")
    hits = hits.select("doc", "key", "pair", "n_roles", "role", (F.col("p") - F.col("place")).alias("shift"))
    if not slop:
        met = hits.groupBy("doc", "key", "pair", "n_roles", "shift").agg(F.count_distinct("role").alias("n"))
        return met.filter("n = n_roles").select("doc", "key", "shift").distinct()
    # where lists of all roles have a shift among those from this one on to slop further
    reach = Window.partitionBy("doc", "key", "pair").orderBy("shift").rangeBetween(0, slop)
    span = hits.withColumn("roles", F.size(F.collect_set("role").over(reach)))
    return span.filter("roles = n_roles").select("doc", "key", "shift").distinct()


def phrase_runs(text_words: list[bytes], item: list[bytes], shift: int, window: int) -> list[tuple[int, int]]:
    """Document spans (start, end) in which the item, laid at shift, agrees for a whole window or more."""
    width = min(window, len(item))
    first, last = max(0, -shift), min(len(item), len(text_words) - shift)
    spans, start = [], None
    for k in range(first, last + 1):
        same = k < last and item[k] == text_words[k + shift]
        if same and start is None:
            start = k
        elif not same and start is not None:
            if k - start >= width:
                spans.append((start + shift, k + shift))
            start = None
    return spans


def matches(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, slop: int = 0, item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """docs' id and n_words, with `phrases`: array of (item, start, end) document word spans, and, for slop > 0,
    `near`: (item, shift) of proximity matches that are no exact phrase. One row per row of docs."""
    listed = cut(item_words(items, item_col, item_text_col))
    terms = listed.select(F.explode("words").alias("term")).distinct()
    marks = cut(anchors(listed, term_counts(docs, terms, text_col), window))
    index = cut(postings(docs, marks.select("term").distinct(), id_col, text_col))
    found = aligned(index, marks, 0).withColumn("exact", F.lit(True))
    if slop:
        found = found.unionByName(aligned(index, marks, slop).withColumn("exact", F.lit(False)))
    met = cut(found.groupBy("doc", "key").agg(F.collect_list(F.struct("shift", "exact")).alias("shifts")))
    cands = cut(
        split_join(met, listed, "key", "doc")
        .groupBy("doc")
        .agg(F.collect_list(F.struct("item", "words", "shifts")).alias("cands"))
    )
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = items.schema[item_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    wanted = docs.sparkSession.sparkContext.broadcast(_doc_filter(cands))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts the words; the text goes on only where the filter of candidate documents holds the id."""
        for batch in batches:
            may = wanted.value.has(id_hashes(batch.column(0), ID_SEED))
            for first, texts in text_runs(batch, "text"):
                n_words = pa.array(split_words(texts, WORD_BYTES)[1])
                kept = texts.cast(pa.binary()).take(pa.array(np.arange(len(texts)), mask=~may[first : first + len(texts)]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), n_words, kept], ["doc", "n_words", "text"])

    counted = base.mapInArrow(scan, f"doc {kind}, n_words long, text binary")
    joined = counted.join(cands.withColumnRenamed("doc", "cand_doc"), F.col("doc").eqNullSafe(F.col("cand_doc")), "left").drop("cand_doc")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda n: batch.column(batch.schema.get_field_index(n))
            phrases, near = [], []
            for text, own in zip(get("text").to_pylist(), get("cands").to_pylist(), strict=True):
                spans, close = {}, {}
                if own and text:
                    listed_words = words(text)
                    for c in own:
                        for s in c["shifts"]:
                            runs = phrase_runs(listed_words, c["words"], s["shift"], window)
                            if runs:
                                spans.update(((c["item"], *r), None) for r in runs)
                            elif not s["exact"]:
                                close[c["item"], s["shift"]] = None
                phrases.append([dict(zip(("item", "start", "end"), s, strict=True)) for s in spans])
                near.append([dict(zip(("item", "shift"), s, strict=True)) for s in close])
            item_type = get("cands").type.value_type.field("item").type
            yield pa.RecordBatch.from_arrays(
                [
                    get("doc"),
                    get("n_words"),
                    pa.array(phrases, pa.list_(pa.struct([("item", item_type), ("start", pa.int32()), ("end", pa.int32())]))),
                    pa.array(near, pa.list_(pa.struct([("item", item_type), ("shift", pa.int32())]))),
                ],
                ["doc", "n_words", "phrases", "near"],
            )

    schema = f"doc {kind}, n_words long, phrases array<struct<item:{item_kind},start:int,end:int>>, near array<struct<item:{item_kind},shift:int>>"
    return joined.select("doc", "n_words", "text", "cands").mapInArrow(confirm, schema).withColumnRenamed("doc", id_col)


def _doc_filter(cands: DataFrame) -> Bloom:
    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield id_hashes(batch.column(0), ID_SEED)

    return seen_once(cands.select("doc"), hashes, bits_for(cands.count()))


def _hit_words(spans) -> F.Column:
    """Number of distinct words inside the spans."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    return F.aggregate(
        ordered,
        zero,
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["upto"]))).cast("long").alias("n"),
            F.greatest(acc["upto"], s["end"]).alias("upto"),
        ),
        lambda acc: acc["n"],
    )


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, slop: int = 0) -> DataFrame:
    """Per row of docs: id, n_words, n_hit, items (sorted as strings), contaminated, phrases, near.
    Contaminated: at least one hit word, and one of every twenty words or more is hit."""
    out = matches(docs, items, id_col, text_col, window, slop)
    return (
        out.withColumn("n_hit", _hit_words(F.col("phrases")))
        .withColumn("items", F.array_sort(F.array_distinct(F.transform("phrases", lambda s: s["item"].cast("string")))))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))
    )


def decontamination_digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's columns of decontaminate."""
    out = decontaminate(docs, items)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT item_id, least(13, len(w)) AS k, unnest(range(greatest(len(w) - 12, 1))) AS s, w FROM iw WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, k, w[s + 1:s + k] AS g FROM win),
ks AS (SELECT DISTINCT k FROM g),
dg AS (SELECT r, k, s, w[s + 1:s + k] AS g FROM (SELECT r, ks.k, unnest(range(len(w) - ks.k + 1)) AS s, w FROM dw, ks WHERE len(w) >= ks.k)),
hit AS (SELECT dg.r, g.item_id, dg.s, dg.k FROM dg JOIN g ON dg.k = g.k AND dg.g = g.g),
pos AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(s, s + k)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(its.l, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AND 20 * coalesce(pos.n, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos ON dw.r = pos.r LEFT JOIN its ON dw.r = its.r
"""
