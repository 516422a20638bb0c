"""The queries opN_<name> over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontam, hard_negatives, jaccard_join, licenses, line_dedup, lm_scores, near_vectors, packing, secret_forest, sharding, toxicity, warc, whitening

#: Where the public tokenizers' files are.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark, sf_dir):
    return decontam.decontamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_near_vectors(spark, sf_dir):
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark, sf_dir):
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_line_dedup(spark, sf_dir):
    return line_dedup.line_digest(table(spark, sf_dir, "documents"))


def op5_lm_scores(spark, sf_dir):
    return lm_scores.lm_digest(table(spark, sf_dir, "documents"))


def op6_revisits(spark, sf_dir):
    return warc.revisit_digest(table(spark, sf_dir, "pages"))


def op7_sharding(spark, sf_dir):
    return sharding.sharding_digest(table(spark, sf_dir, "documents"))


def op8_packing(spark, sf_dir):
    return packing.packing_digest(table(spark, sf_dir, "documents"), TOKENIZER)


def op9_secret_scan(spark, sf_dir):
    return secret_forest.secret_digest(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_digest(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark, sf_dir):
    return hard_negatives.negatives_digest(table(spark, sf_dir, "embeddings"))


def op12_whitening(spark, sf_dir):
    return whitening.whitening_digest(table(spark, sf_dir, "embeddings"))


def op13_license_scan(spark, sf_dir):
    return licenses.license_digest(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_near_vectors,
        op3_toxicity,
        op4_line_dedup,
        op5_lm_scores,
        op6_revisits,
        op7_sharding,
        op8_packing,
        op9_secret_scan,
        op10_jaccard_join,
        op11_hard_negatives,
        op12_whitening,
        op13_license_scan,
    )
}
ORACLES = {
    "op1_decontamination": decontam.ORACLE,
    "op2_near_vectors": near_vectors.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op5_lm_scores": lm_scores.ORACLE,
    "op6_revisits": warc.ORACLE,
    "op10_jaccard_join": jaccard_join.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op13_license_scan": licenses.ORACLE,
}
