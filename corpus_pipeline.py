"""Five stages from raw documents to packed training sequences; each reads what the one before has kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quantity_jobs.llm import decontam, jaccard_join, line_dedup, packing, toxicity
from quantity_jobs.llm.bloom import holds
from quantity_jobs.llm.queries import TOKENIZER, table
from quantity_jobs.llm.shared import cut, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def row_key() -> Column:
    """A row by what it says: rows that agree in it are copies of each other, and rows of one id may differ."""
    return F.struct("doc_id", F.xxhash64("text").alias("text_hash"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches 0.5 go; the model learns from the labelled documents of this input."""
    labels = table(spark, sf_dir, "labels").filter(~toxicity.held_out())
    own = docs.select(*COLUMNS)
    return toxicity.score(own, toxicity.fit(own, labels)).filter(F.col("score") < 0.5).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; every document stays, with n_chars of its new text."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document with the smallest id
    stays (null comes first), once where its row repeats. Texts without words link with nothing. Documents that share an id but not
    their text are documents of their own. Only rows that a filter of the keys to drop or to thin out holds are shuffled with their texts."""
    own = docs.select(*COLUMNS).withColumn("key", row_key())
    judged = jaccard_join.jaccard_components(own.select("key", "text"), id_col="key").select("key", F.expr("key <=> component_id").alias("first"))
    judged = judged.groupBy("key").agg(F.max("first").alias("first"), F.count(F.lit(1)).alias("n"))
    unsure = cut(judged.filter("NOT first OR n > 1").select(F.col("key").alias("unsure"), "first"))
    suspect = holds(unsure.select(F.xxhash64("unsure")))
    rest = own.filter(suspect(F.xxhash64("key"))).join(unsure, F.col("key").eqNullSafe(F.col("unsure")), "left").filter("first IS NULL OR first").dropDuplicates(["key"])
    return own.filter(~suspect(F.xxhash64("key"))).select(*COLUMNS).unionByName(rest.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a benchmark passage makes a twentieth or more go; the rest stays, row by row."""
    own = docs.select(*COLUMNS).withColumn("key", row_key())
    judged = decontam.decontaminate(own.select("key", "text"), table(spark, sf_dir, "benchmark"), id_col="key")
    bad = judged.filter("contaminated").select(F.col("key").alias("bad")).distinct()
    return own.join(bad, F.col("key").eqNullSafe(F.col("bad")), "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; see the packing operator."""
    return packing.packing_digest(docs, TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: A trained model and token ids are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
