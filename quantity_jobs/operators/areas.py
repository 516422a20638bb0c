"""Area pages: consolidation of files, level budgets, reports and edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.exprs import round_half_up as half_up
from .clean import AREA_CATEGORIES

P = "project_id"
COLUMNS = [c for names in AREA_CATEGORIES.values() for c in names]


def consolidate_files(area_pages: DataFrame, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages, totals): pages of all files of a project numbered through, by a running offset over the page counts of the files before; per project the sums
    and the first section height by file and page. files: (project_id, file_seq, page_count), also of files whose pages gave nothing; without it, and for files that it
    lacks, the last page seen ends a file."""
    seen = area_pages.groupBy(P, "file_seq").agg((F.max("page_index") + 1).alias("n"))
    if files is not None:
        counts = files.groupBy(P, "file_seq").agg(F.max("page_count").alias("page_count"))
        seen = seen.join(counts, [P, "file_seq"], "full").select(P, "file_seq", F.coalesce("page_count", "n").alias("n"))
    before = Window.partitionBy(P).orderBy("file_seq").rowsBetween(Window.unboundedPreceding, -1)
    offsets = seen.select(P, "file_seq", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    pages = area_pages.join(offsets, [P, "file_seq"]).withColumn("page", (F.col("page_index") + F.col("offset")).cast("long")).drop("offset")
    has = F.col("section_height") > 0
    totals = area_pages.groupBy(P).agg(
        *(half_up(F.sum(c)).alias(c) for c in COLUMNS),
        F.min_by(F.when(has, F.col("section_height")), F.when(has, F.struct("file_seq", "page_index"))).alias("section_height"),
        F.count_distinct("file_seq").alias("files"),
    )
    return pages, totals


def first_page_per_level(pages: DataFrame) -> DataFrame:
    """The first page of each level."""
    rank = F.row_number().over(Window.partitionBy(P, "level").orderBy("page"))
    return pages.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def apply_page_edits(pages: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages with edited areas (null: not edited; below 0: 0), and the totals anew."""
    renamed = edits.select(P, "page", *(F.col(c).alias(f"e_{c}") for c in COLUMNS if c in edits.columns))
    joined = pages.join(renamed, [P, "page"], "left")
    new = joined.withColumns({c: F.when(F.col(f"e_{c}").isNotNull(), F.greatest(F.lit(0.0), F.col(f"e_{c}"))).otherwise(F.col(c)) for c in COLUMNS if c in edits.columns}).select(*pages.columns)
    return new, new.groupBy(P).agg(*(half_up(F.sum(c)).alias(c) for c in COLUMNS))


#: Area that is priced, by category, and the fallback price.
PRICED = {"external": ("ext_net", "2P"), "internal": ("int_net", "SP"), "boundary": ("boundary_gross", "SP"), "floor": ("floor_m2", "2P"), "roof": ("roof_m2", "2P")}


def area_budget(pages: DataFrame, price_2p: float, price_sp: float) -> DataFrame:
    """(project_id, level, category, area_m2, cost), levels and per project (level null)."""
    price = {"2P": price_2p, "SP": price_sp}
    rows = F.array(*(F.struct(F.lit(k).alias("category"), F.col(c).alias("area"), F.lit(price[t]).alias("price")) for k, (c, t) in PRICED.items()))
    own = pages.select(P, F.coalesce(F.nullif("level", F.lit("")), F.lit("Terreo")).alias("level"), F.explode(rows).alias("x")).select(P, "level", "x.*").filter("area > 0")
    sums = own.groupingSets([[P, "level", "category"], [P, "category"]], P, "level", "category").agg(F.sum("area").alias("a"), F.first("price").alias("price"))
    return sums.select(P, "level", "category", half_up("a").alias("area_m2"), half_up(half_up("a") * F.col("price")).alias("cost"))


def area_report(pages: DataFrame) -> DataFrame:
    """(project_id, level, part, area_m2): net areas per level by part (walls, slabs), with subtotals where level or part is null."""
    walls = F.col("ext_net") + F.col("int_net") + F.col("boundary_gross")
    slabs = F.col("floor_m2") + F.col("roof_m2")
    own = pages.select(P, "level", F.explode(F.create_map(F.lit("walls"), walls, F.lit("slabs"), slabs)).alias("part", "a"))
    return own.groupingSets([[P, "level", "part"], [P, "level"], [P, "part"], [P]], P, "level", "part").agg(half_up(F.sum("a")).alias("area_m2"))
