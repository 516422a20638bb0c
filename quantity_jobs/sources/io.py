"""Typed reading of JSON payloads and price sheets; writing of budgets and exports; upserts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StructType

from .. import dims
from ..functions.exprs import hub_code, normalize_product_name, parse_decimal, round_half_up as half_up
from ..operators.kernels import repair_json

P = "project_id"

WALL_JSON = "id string, level string, wall_class string, length_m double, height_m double, thickness_m double, source string, confidence double, has_door boolean, has_window boolean, page_index int"
SLAB_JSON = "id string, level string, slab_class string, area_m2 double, source string, confidence double"
CORNER_JSON = "id string, level string, corner_count int"
TAKEOFF_JSON = """sheets array<struct<page_index: int, level: string,
 segments: array<struct<id: string, category: string, length_m_ai: double, length_m_calculated: double, height_m: double, confidence: double>>,
 slabs: array<struct<id: string, category: string, area_m2_declared: double, area_m2_ai: double, area_m2_calculated: double, confidence: double>>>>"""
#: The form of an area answer. Numbers are read as text, since some answers quote them.
AREA_JSON = """pavimento string, paredes_externas struct<area_bruta_m2: string, area_aberturas_m2: string, area_liquida_m2: string>,
 paredes_internas struct<area_bruta_m2: string, area_aberturas_m2: string, area_liquida_m2: string>, muros struct<area_bruta_m2: string, altura_assumida_m: string>,
 laje_piso_m2 string, laje_coberta_m2 string, aberturas array<struct<tipo: string, parede: string, largura_m: string, altura_m: string, area_m2: string>>,
 confidence string, observacoes string"""
AREA_REQUIRED = ("paredes_externas", "paredes_internas", "muros", "laje_piso_m2", "laje_coberta_m2")
OPENING_KINDS = {"janela": "window", "porta": "door", "cobogo": "cobogo"}
ANSWER_CONFIDENCES = ("high", "medium", "low")
WALL_GROUPS = {"ext": "paredes_externas", "int": "paredes_internas"}
GROUP_AREAS = {"gross": "area_bruta_m2", "open": "area_aberturas_m2", "net": "area_liquida_m2"}
DEFAULT_BOUNDARY_HEIGHT, LONGEST_NOTE = 2.0, 500


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder; only local sessions without one get a temporary folder."""
    context = spark.sparkContext
    chosen = context._jsc.sc().getCheckpointDir()
    base = chosen.get() if chosen.isDefined() else spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df computed once into the shared folder and read back, where several later steps would each compute it again."""
    folder = run_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def dealt(name: str, *parts: DataFrame, by: str = P) -> DataFrame:
    """The rows of all parts (columns that a later one lacks are null), computed once into the shared folder, in buckets by `by`: windows, groups and, within `as_they_lie`, joins
    whose keys hold that column read them without a shuffle. Parts are written one after the other, since a union of dealt tables would be dealt anew."""
    spark = parts[0].sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = run_folder(spark, name)
    table = folder.rsplit("/", 1)[-1].replace("-", "_")
    for part in parts:
        own = part if part is parts[0] else parts[0].limit(0).unionByName(part, allowMissingColumns=True)
        own.repartition(n, by).write.bucketBy(n, by).sortBy(by).option("path", folder).mode("append").saveAsTable(table)
    return spark.table(table)


#: Joins take tables on the project and more keys where the project's rows already lie together, instead of dealing both sides anew by all keys; and what lies in buckets is read by
#: bucket in every place.
LYING = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}


@contextmanager
def as_they_lie(spark: SparkSession) -> Iterator[None]:
    """What runs within joins dealt tables as they lie. What is returned from it must have been computed within."""
    before = {key: spark.conf.get(key) for key in LYING}
    try:
        for key, value in LYING.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def read_elements(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (project_id, seq, element_type, data) as typed walls, slabs and corners. The filter on element_type reaches the scan."""

    def typed(kind: str, schema: str, key: str) -> DataFrame:
        own = raw.filter(F.col("element_type") == kind).select(P, "seq", F.from_json("data", schema).alias("d"))
        return own.filter("d IS NOT NULL").select(P, "seq", "d.*").withColumnRenamed("id", key)

    return typed("wall", WALL_JSON, "wall_id"), typed("slab", SLAB_JSON, "slab_id"), typed("corner", CORNER_JSON, "corner_id")


def read_takeoff_docs(docs: DataFrame, default_height: float = dims.WALL_HEIGHT) -> tuple[DataFrame, DataFrame]:
    """Take-off documents (project_id, doc_id, data): segments with a positive length as walls, slabs with a positive area."""
    sheets = docs.select(P, "doc_id", F.explode(F.from_json("data", TAKEOFF_JSON)["sheets"]).alias("s"))
    ident = F.concat_ws("-", F.col("doc_id").cast("string"), F.col("s.page_index").cast("string"), F.col("x.id"))
    seg = sheets.select(P, "doc_id", "s", F.explode("s.segments").alias("x"))
    length = F.coalesce("x.length_m_ai", "x.length_m_calculated", F.lit(0.0))
    category = F.col("x.category")
    walls = seg.filter(length > 0).select(
        P, ident.alias("wall_id"), F.col("s.level").alias("level"), F.when(category == "parede_externa", "external").when(category == "parede_interna", "internal").otherwise("boundary").alias("wall_class"),
        length.alias("length_m"), F.coalesce("x.height_m", F.lit(default_height)).alias("height_m"), F.lit(dims.WALL_THICKNESS).alias("thickness_m"), F.coalesce("x.confidence", F.lit(0.75)).alias("confidence"), F.col("s.page_index").alias("page_index"),
    )
    own = sheets.select(P, "doc_id", "s", F.explode("s.slabs").alias("x"))
    area = F.coalesce("x.area_m2_declared", "x.area_m2_ai", "x.area_m2_calculated", F.lit(0.0))
    slabs = own.filter(area > 0).select(
        P, ident.alias("slab_id"), F.col("s.level").alias("level"), F.when(category == "laje_piso", "floor").otherwise("roof").alias("slab_class"), area.alias("area_m2"), F.coalesce("x.confidence", F.lit(0.75)).alias("confidence")
    )
    return walls, slabs


def read_area_pages(raw: DataFrame) -> DataFrame:
    """Area pages from JSON answers (project_id, seq, data): absent or unreadable areas are 0, boundary heights 2 m, levels `Pavimento`, confidences `low`; net areas are those
    stated. openings are typed, their area the stated one or width by height; `missing` lists the required fields that the answer doesn't have at all (a null is one it has).
    Levels and notes count only where they are texts."""
    parsed = F.try_parse_json("data")
    text = lambda field: F.schema_of_variant(F.try_variant_get(parsed, f"$.{field}", "variant")) == "STRING"
    own = raw.select(P, "seq", F.from_json("data", AREA_JSON).alias("d"), F.json_object_keys("data").alias("has"), text("pavimento").alias("named"), text("observacoes").alias("noted"))
    number = lambda c, default=0.0: F.coalesce(F.nullif(F.nullif(c.try_cast("double"), F.lit(float("nan"))), F.lit(0.0)), F.lit(default))

    def opening(o):
        kind = F.lit("other")
        for theirs, ours in OPENING_KINDS.items():
            kind = F.when(o["tipo"] == theirs, ours).otherwise(kind)
        width, height = number(o["largura_m"]), number(o["altura_m"])
        area = number(o["area_m2"])
        return F.struct(
            kind.alias("kind"), F.when(o["parede"] == "interna", "internal").otherwise("external").alias("wall_class"), width.alias("width_m"), height.alias("height_m"), F.when(area != 0, area).otherwise(width * height).alias("area_m2")
        )

    openings = F.transform(F.filter(F.coalesce("d.aberturas", F.array().cast(own.schema["d"].dataType["aberturas"].dataType)), lambda o: o.isNotNull()), opening)
    missing = F.filter(F.array(*map(F.lit, AREA_REQUIRED)), lambda c: ~F.coalesce(F.array_contains("has", c), F.lit(False)))
    return own.select(
        P,
        "seq",
        F.coalesce(F.when(F.col("named"), F.col("d.pavimento")), F.lit("Pavimento")).alias("level"),
        *(number(F.col(f"d.{group}.{field}")).alias(f"{g}_{f}") for g, group in WALL_GROUPS.items() for f, field in GROUP_AREAS.items()),
        number(F.col("d.muros.area_bruta_m2")).alias("boundary_gross"),
        number(F.col("d.muros.altura_assumida_m"), DEFAULT_BOUNDARY_HEIGHT).alias("boundary_height"),
        number(F.col("d.laje_piso_m2")).alias("floor_m2"),
        number(F.col("d.laje_coberta_m2")).alias("roof_m2"),
        openings.alias("openings"),
        F.when(F.col("d.confidence").isin(*ANSWER_CONFIDENCES), F.col("d.confidence")).otherwise("low").alias("confidence"),
        F.substring(F.coalesce(F.when(F.col("noted"), F.col("d.observacoes")), F.lit("")), 1, LONGEST_NOTE).alias("notes"),
        missing.alias("missing"),
    )


def read_price_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Price rows of a sheet saved as CSV: description, hub and price are the first three columns."""
    return clean_price_sheet(spark.read.schema("description string, hub string, price string").option("header", True).option("enforceSchema", True).csv(path))


def clean_price_sheet(sheet: DataFrame) -> DataFrame:
    """(description, hub, price): rows with a name, a hub and a price above 0; decimal commas allowed."""
    own = sheet.select(F.trim("description").alias("description"), F.trim("hub").alias("hub"), parse_decimal("price", 0.0).alias("price"))
    return own.filter((F.col("description") != "") & (F.col("hub") != "") & (F.col("price") > 0))


def match_price_sheet(sheet: DataFrame, products: DataFrame, gate: float = 0.9) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prices by hub and sku, names without a product, match rate with its gate)."""
    own = sheet.withColumn("match_key", normalize_product_name("description")).withColumn("hub_code", hub_code("hub"))
    known = products.groupBy(normalize_product_name("name").alias("match_key")).agg(F.min("sku").alias("sku"))
    prices = own.join(known, "match_key").groupBy("hub_code", "sku").agg(F.max("price").alias("price"))
    unmatched = own.join(known, "match_key", "left_anti").select("description").distinct()
    hit = own.join(known, "match_key", "left").agg(F.count("sku").alias("matched"), F.count(F.lit(1)).alias("rows"))
    rate = F.col("matched") / F.col("rows")
    return prices, unmatched, hit.withColumns({"rate": half_up(rate, 4), "accepted": F.coalesce(rate >= gate, F.lit(False))})


def upsert_profile_prices(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """(profile_id, sku, unit_price): incoming prices over current ones. Applying the same load twice changes nothing."""
    both = current.select("profile_id", "sku", "unit_price", F.lit(0).alias("turn")).unionByName(incoming.select("profile_id", "sku", "unit_price", F.lit(1).alias("turn")))
    return both.groupBy("profile_id", "sku").agg(F.max_by("unit_price", "turn").alias("unit_price"))


def replace_by_project(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """All rows of the incoming projects replace their current ones."""
    return current.join(incoming.select(P).distinct(), P, "left_anti").unionByName(incoming)


def recover_json(responses: DataFrame, schema: str) -> DataFrame:
    """responses (project_id, seq, data) with `parsed`, `document` and `outcome`: strict where the text is JSON, else repaired, recovered (single walls picked out),
    empty or quarantine. `document` is the whole answer as a variant, with the fields that the schema doesn't name or names with other types; parsed has those of the
    schema. A list is what the schema's first array holds. Only rows that fail to parse leave the JVM."""
    fields = StructType.fromDDL(schema).fields
    listed = next((f.name for f in fields if isinstance(f.dataType, ArrayType)), None)

    def whole(text: Column) -> Column:
        return F.when(F.ltrim(text).startswith("["), F.concat(F.lit(f'{{"{listed}":'), text, F.lit("}"))).otherwise(text) if listed else text

    # the parser stops at the end of the first value, so what follows it has to be looked at
    closed = r"^\s*(\{[\s\S]*\}|\[[\s\S]*\])\s*$" if listed else r"^\s*\{[\s\S]*\}\s*$"
    own = responses.withColumn("document", F.when(F.col("data").rlike(closed), F.try_parse_json(whole(F.col("data")))))

    def repair(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [repair_json(t) for t in frame["data"]]
            yield frame.assign(fixed=[f for f, _ in found], outcome=[o for _, o in found])

    names = responses.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in responses.schema)
    good = own.filter("document IS NOT NULL").select(*names, F.from_json(whole(F.col("data")), schema).alias("parsed"), "document", F.lit("strict").alias("outcome"))
    rest = own.filter("document IS NULL").select(*names).mapInPandas(repair, f"{kinds}, fixed string, outcome string")
    return good.unionByName(rest.select(*names, F.from_json(whole(F.col("fixed")), schema).alias("parsed"), F.try_parse_json(whole(F.col("fixed"))).alias("document"), "outcome"))


def json_outcomes(recovered: DataFrame) -> DataFrame:
    return recovered.groupBy(P).pivot("outcome", ["strict", "repaired", "recovered", "quarantine", "empty"]).count().na.fill(0)


def bim_walls(elements: DataFrame, rels: DataFrame, props: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Walls and slabs from relation tables: elements (project_id, element_id, kind, ext_x, ext_y, ext_z), rels (project_id, rel, parent_id, child_id: `storey` contains,
    `voids` host to opening, `fills` opening to filling), props (project_id, element_id, ordinal, name, value). The first value of a property counts; sizes fall back to the
    extents in falling order; class follows the external flag."""
    wanted = ["length", "height", "thickness", "area", "is_external", "storey_name"]
    flat = props.groupBy(P, "element_id").pivot("name", wanted).agg(F.min_by("value", F.struct("ordinal")))
    storey = rels.filter("rel = 'storey'").select(P, F.col("child_id").alias("element_id"), F.col("parent_id").alias("storey_id"))
    names = flat.select(P, F.col("element_id").alias("storey_id"), F.col("storey_name").alias("level")).filter("level IS NOT NULL")
    sizes = F.sort_array(F.array(*(F.abs(F.col(c)) for c in ("ext_x", "ext_y"))), asc=False)
    number = lambda c: F.nullif(F.col(c).try_cast("double"), F.lit(0.0))
    # levels are put beside the narrow relation, and what openings need has no levels
    placed = storey.join(names, [P, "storey_id"], "left").select(P, "element_id", "level")
    measured = elements.join(flat.drop("storey_name"), [P, "element_id"], "left").withColumn("sizes", sizes)
    own = measured.join(placed, [P, "element_id"], "left").withColumn("level", F.coalesce("level", F.lit("Terreo")))
    area = F.coalesce(number("length"), F.col("sizes")[0]) * F.coalesce(number("height"), F.abs("ext_z"))
    opened = (
        rels.filter("rel = 'voids'").alias("v").join(rels.filter("rel = 'fills'").select(P, F.col("parent_id").alias("child_id"), F.col("child_id").alias("filling")), [P, "child_id"], "left")
        .select(P, F.col("parent_id").alias("host"), F.coalesce("filling", "child_id").alias("element_id"))
        .join(measured.select(P, "element_id", "kind", area.alias("area_m2")), [P, "element_id"])
    )
    opens = opened.groupBy(P, F.col("host").alias("element_id")).agg(half_up(F.sum("area_m2"), 4).alias("opening_area_m2"), F.bool_or(F.col("kind") == "door").alias("has_door"), F.bool_or(F.col("kind") == "window").alias("has_window"))
    external = F.coalesce(F.lower("is_external").isin("true", ".t.", "1"), F.lit(False))
    walls = own.filter("kind = 'wall'").join(opens, [P, "element_id"], "left").select(
        P, F.col("element_id").alias("wall_id"), "level", F.when(external, "external").otherwise("internal").alias("wall_class"), F.coalesce(number("length"), F.col("sizes")[0]).alias("length_m"),
        F.coalesce(number("height"), F.abs("ext_z"), F.lit(dims.WALL_HEIGHT)).alias("height_m"), F.coalesce(number("thickness"), F.col("sizes")[1], F.lit(dims.WALL_THICKNESS)).alias("thickness_m"),
        F.coalesce("opening_area_m2", F.lit(0.0)).alias("opening_area_m2"), F.coalesce("has_door", F.lit(False)).alias("has_door"), F.coalesce("has_window", F.lit(False)).alias("has_window"),
    )
    roof = F.lower("level").rlike("cobertura|roof")
    slabs = own.filter("kind = 'slab'").select(P, F.col("element_id").alias("slab_id"), "level", F.when(roof, "roof").otherwise("floor").alias("slab_class"), F.coalesce(number("area"), F.col("sizes")[0] * F.col("sizes")[1]).alias("area_m2"))
    return walls, slabs


def budget_documents(projects: DataFrame, by_level: DataFrame, lines: DataFrame, alerts: DataFrame) -> DataFrame:
    """One nested document per project: levels, proposal lines and alerts."""
    levels = by_level.groupBy(P).agg(F.sort_array(F.collect_list(F.struct("level", "category", "length_m", "gross_m2", "net_m2", "panels"))).alias("quantities"))
    items = lines.groupBy(P).agg(F.sort_array(F.collect_list(F.struct("place", "line", "sku", "panels", "area_m2", "price_m2", "cost"))).alias("materials"))
    notes = alerts.groupBy(P).agg(F.sort_array(F.collect_list(F.struct("severity", "code", "element_id"))).alias("alerts"))
    return projects.select(P, "name", "client_name").join(levels, P, "left").join(items, P, "left").join(notes, P, "left")


def write_budget_json(documents: DataFrame, path: str, files: int = 16) -> None:
    """A JSON line per project, dealt over so many folders by project."""
    documents.withColumn("part", F.pmod(P, F.lit(files))).write.mode("overwrite").partitionBy("part").json(path)


def export_tables(tables: dict[str, DataFrame], path: str, fmt: str = "csv") -> None:
    """Flat tables (summary, walls, slabs, materials, alerts, assumptions), each in its folder."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite").option("header", True)
        (writer.csv if fmt == "csv" else writer.parquet)(f"{path}/{name}")


def read_tables(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> dict[str, DataFrame]:
    """The tables as export_tables wrote them in CSV, with the types of `tables`."""
    return {name: spark.read.schema(df.schema).option("header", True).option("enforceSchema", True).csv(f"{path}/{name}") for name, df in tables.items()}


def area_csv_rows(area_pages: DataFrame) -> DataFrame:
    """(project_id, row_kind, page, category, area_m2): a row per page and category, and the totals by category."""
    names = ["ext_net", "int_net", "boundary_gross", "floor_m2", "roof_m2"]
    long = area_pages.select(P, "page", *names).unpivot([P, "page"], names, "category", "area_m2")
    out = long.groupingSets([[P, "page", "category"], [P, "category"]], P, "page", "category").agg(half_up(F.sum("area_m2")).alias("area_m2"))
    return out.select(P, F.when(F.col("page").isNull(), "total").otherwise("page").alias("row_kind"), "page", "category", "area_m2")


def export_area_csv(area_pages: DataFrame, path: str) -> None:
    area_csv_rows(area_pages).write.mode("overwrite").option("header", True).csv(path)
