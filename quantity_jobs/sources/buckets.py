"""Tables kept in place: Parquet by hash bucket, of which a load rewrites only those that it touches.

A load has an id, and the ids of finished loads are kept beside the table, so that a repeated load changes nothing. A load that was cut off before its id was
noted is simply done again: rewriting a bucket with the same rows gives the same bucket. One writer at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .io import staged

BUCKETS = 64


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _bucket(keys: list[str], n: int):
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int").alias("bucket")


def read_buckets(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table's rows; none before the first load."""
    if not _exists(spark, f"{path}/data"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(StructType([*schema.fields])).option("basePath", f"{path}/data").parquet(f"{path}/data").select(*schema.names)


def loaded(spark: SparkSession, path: str, load_id: str) -> bool:
    return _exists(spark, f"{path}/loads/{load_id}")


def _rewrite(new: DataFrame, path: str, by: list[str], gone: list[str], load_id: str, n: int) -> bool:
    """Of the buckets (by `by`) that new touches, rows whose `gone` columns occur in new go, and new comes."""
    spark = new.sparkSession
    if loaded(spark, path, load_id):
        return False
    incoming = staged(new.select("*", _bucket(by, n)), "load")
    touched = [r.bucket for r in incoming.select("bucket").distinct().collect()]  # n at most
    if touched:
        kept = None
        if _exists(spark, f"{path}/data"):
            old = spark.read.schema(incoming.schema).option("basePath", f"{path}/data").parquet(f"{path}/data").filter(F.col("bucket").isin(touched))
            same = [F.col(f"o.{c}").eqNullSafe(F.col(f"i.{c}")) for c in ("bucket", *gone)]
            kept = old.alias("o").join(incoming.select("bucket", *gone).distinct().alias("i"), same, "left_anti").select(*incoming.columns)
        # what is read lies in the files that are replaced, so it is written aside first
        content = incoming if kept is None else staged(kept.unionByName(incoming), "buckets")
        content.repartition(len(touched), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/data")
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/loads/{load_id}")
    target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True).close()
    return True


def upsert_in_place(new: DataFrame, path: str, keys: list[str], load_id: str, by: list[str] | None = None, buckets: int = BUCKETS) -> bool:
    """Rows of new (one per key) replace those of their keys; whether the load was new. by: the columns of the bucket, of the keys."""
    return _rewrite(new, path, by or keys, keys, load_id, buckets)


def replace_in_place(new: DataFrame, path: str, load_id: str, key: str = "project_id", buckets: int = BUCKETS) -> bool:
    """All rows of the projects in new replace their current ones; whether the load was new."""
    return _rewrite(new, path, [key], [key], load_id, buckets)
