"""Cleaning and parsing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs
from ..functions.exprs import round_half_up as half_up
from ..operators import clean, fuse
from ..sources import buckets, io
from .catalogue import DEFAULTED, FIXED, VALID, query


@query("WITH " + FIXED + " SELECT project_id, seq, l1 AS length_m, h1 AS height_m, s1 AS source FROM f")
def fix_units(t):
    return clean.fix_units(t.walls()).select("project_id", "seq", "length_m", "height_m", "source")


@query("WITH " + DEFAULTED + " SELECT project_id, seq, length_m, height_m, thickness_m, height_source, floor(opening_area_m2 * 1e4 + 5e-1) / 1e4 AS opening_area_m2 FROM w")
def wall_defaults(t):
    out = clean.wall_defaults(clean.fix_units(t.walls()))
    return out.select("project_id", "seq", "length_m", "height_m", "thickness_m", "height_source", half_up("opening_area_m2", 4).alias("opening_area_m2"))


@query("WITH " + VALID + " SELECT project_id, seq, 'wall' AS kind, height_m AS measure FROM v UNION ALL SELECT project_id, seq, 'slab', area_m2 FROM vs")
def validate_geometry(t):
    walls, slabs = clean.validate_geometry(clean.wall_defaults(clean.fix_units(t.walls())), t("slabs"))
    return walls.select("project_id", "seq", F.lit("wall").alias("kind"), F.col("height_m").alias("measure")).unionByName(slabs.select("project_id", "seq", F.lit("slab").alias("kind"), F.col("area_m2").alias("measure")))


@query(
    """WITH a AS (SELECT project_id, count(*) AS walls_before, count(*) FILTER (length_m <= 0) AS wall_not_finite, count(*) FILTER (length_m > 0 AND thickness_m < 6e-2) AS wall_thin,
  count(*) FILTER (length_m > 0 AND thickness_m > 4e-1) AS wall_thick, count(*) FILTER (length_m > 0 AND thickness_m BETWEEN 6e-2 AND 4e-1 AND length_m > 50) AS wall_huge FROM {walls} GROUP BY 1),
b AS (SELECT project_id, count(*) AS slabs_before, count(*) FILTER (area_m2 BETWEEN 1 AND 5000) AS slabs_after FROM {slabs} GROUP BY 1)
SELECT a.*, b.slabs_before, b.slabs_after FROM a JOIN b ON a.project_id = b.project_id"""
)
def validation_stats(t):
    out = clean.validation_stats(t("walls"), t("slabs"))
    return out.select("project_id", "walls_before", "wall_not_finite", "wall_thin", "wall_thick", "wall_huge", "slabs_before", "slabs_after")


@query("SELECT project_id, count(*) AS removed, arg_min(wall_id, seq) AS first_id FROM {walls} WHERE thickness_m > 12e-2 GROUP BY 1")
def cap_thickness(t):
    return clean.cap_thickness(t("walls"))[1]


ASSUMED = """SELECT project_id, 'wall' AS element, wall_id AS element_id, 'height' AS field, '3.0' AS value FROM {walls} WHERE wall_class <> 'boundary' AND NOT height_m > 0
UNION ALL SELECT project_id, 'opening', wall_id || '.0', 'width', '0.8' FROM {walls} WHERE door_code IS NOT NULL AND NOT door_w > 0 UNION ALL SELECT project_id, 'opening', wall_id || '.0', 'height', '2.1' FROM {walls} WHERE door_code IS NOT NULL AND NOT door_h > 0
UNION ALL SELECT project_id, 'opening', wall_id || CASE WHEN door_code IS NULL THEN '.0' ELSE '.1' END, 'width', '1.2' FROM {walls} WHERE win_code IS NOT NULL AND NOT win_w > 0
UNION ALL SELECT project_id, 'opening', wall_id || CASE WHEN door_code IS NULL THEN '.0' ELSE '.1' END, 'height', CASE WHEN win_sill > 13e-1 THEN '0.6' ELSE '1.0' END FROM {walls} WHERE win_code IS NOT NULL AND NOT win_h > 0
UNION ALL SELECT project_id, 'opening', wall_id || CASE WHEN door_code IS NULL THEN '.0' ELSE '.1' END, 'sill', '1.1' FROM {walls} WHERE win_code IS NOT NULL AND NOT win_sill > 0
UNION ALL SELECT project_id, 'slab', slab_id, 'foundation', 'raft' FROM {slabs} WHERE slab_class = 'floor' AND lower(level) LIKE '%terreo%'"""


@query(ASSUMED)
def assumption_log(t):
    return clean.assumption_log(t.walls(), t("slabs")).drop("unit")


@query(
    """SELECT project_id, seq, ceiling_m, least(1e0, greatest(0e0, confidence)) AS confidence FROM {sections} WHERE ceiling_m > 15e-1 AND ceiling_m <= 8"""
)
def clean_sections(t):
    return clean.clean_sections(t("sections")).select("project_id", "seq", "ceiling_m", "confidence")


@query(
    """SELECT project_id, level, CAST(4 AS BIGINT) + 2 - CASE WHEN x1 > 870 THEN 2 ELSE 0 END AS vertices FROM {envelopes}"""
)
def clean_polygons(t):
    # the page ends at 870 here, so that some corners go
    env = t.envelopes().withColumn("polygon", F.transform("polygon", lambda p: F.struct(F.when(p["x"] <= 870, p["x"]).otherwise(p["x"] + 1000).alias("x"), p["y"].alias("y"))))
    return clean.clean_polygons(env).select("project_id", "level", F.size("polygon").cast("long").alias("vertices"))


@query(
    """SELECT project_id, seq, least(5e0, greatest(3e-1, CASE WHEN thickness_pct = 0 THEN 12e-1 ELSE thickness_pct END)) AS thickness_pct, least(1e0, greatest(0e0, CASE WHEN confidence = 0 THEN 7e-1 ELSE confidence END)) AS confidence
FROM {segments} WHERE x1 BETWEEN 0 AND 1000 AND x2 BETWEEN 0 AND 1000 AND y1 BETWEEN 0 AND 1000 AND y2 BETWEEN 0 AND 1000 AND sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) >= 5"""
)
def clean_segments(t):
    return clean.clean_segments(t("segments")).select("project_id", "seq", "thickness_pct", "confidence")


@query(
    """SELECT project_id, seq, value_m, CASE WHEN orientation IN ('horizontal', 'vertical') THEN orientation ELSE 'unknown' END AS orientation FROM {dimensions}
WHERE value_m > 0 AND value_m <= 50 AND x BETWEEN 0 AND 1000 AND y BETWEEN 0 AND 1000"""
)
def clean_dimensions(t):
    return clean.clean_dimensions(t("dimensions")).select("project_id", "seq", "value_m", "orientation")


TYPOLOGY = """CASE project_id % 10 WHEN 0 THEN 'casa_terrea' WHEN 1 THEN 'casa_2_pavimentos' WHEN 2 THEN 'sobrado' WHEN 3 THEN 'edificio' WHEN 4 THEN 'comercial_loja'
  WHEN 5 THEN 'comercial_sala' WHEN 6 THEN 'industrial_galpao' WHEN 7 THEN 'residencial' END"""


def _characterizations(t):
    p = F.col("project_id")
    return t("projects").select(
        "project_id",
        F.expr(TYPOLOGY).alias("typology"),
        F.when(p % 3 == 0, "alto").when(p % 3 == 1, "luxo").alias("standard"),
        F.when(p % 5 == 0, "L").when(p % 5 == 1, "round").alias("envelope_shape"),
        F.when(p % 4 == 0, "high").when(p % 4 == 1, "sure").alias("confidence"),
        F.when(p % 3 != 0, F.array(F.lit("Terreo"), F.lit(" "), F.concat(F.lit("L"), p.cast("string")))).alias("levels"),
        F.array(F.struct(F.lit(" Sala ").alias("room"), ((p % 7) - 1.5).alias("qty")), F.struct(F.lit(None).cast("string").alias("room"), F.lit(1.0).alias("qty"))).alias("programme"),
        ((p % 20) / 4.0).alias("ceiling_low"),
        ((p % 9) / 3.0).alias("ceiling_high"),
        ((p % 30) / 100.0).alias("thickness_low"),
        ((p % 60) / 100.0).alias("thickness_high"),
        ((p % 600) * 1.0).alias("walls_low"),
        ((p % 70) * 10.0).alias("walls_high"),
        ((p % 50) * 1.0).alias("openings_low"),
        ((p % 90) * 5.0).alias("openings_high"),
        F.when(p % 2 == 0, (p % 40) * 3.0).alias("area_low"),
        ((p % 90) * 1000.0).alias("area_high"),
        (p % 2 == 0).alias("has_garage"),
        F.repeat(F.lit("ab"), (p % 400).cast("int")).alias("notes"),
    )


def ranged(name: str, a: str, b: str, least: str, most: str, low: str, high: str) -> str:
    """SQL of a range: exchanged where low exceeds high, kept within the limits, else the default."""
    ok = f"{a} >= {least} AND {b} <= {most}"
    return f"CASE WHEN {a} > {b} THEN {b} WHEN {ok} THEN {a} ELSE {low} END AS {name}_low, CASE WHEN {a} > {b} THEN {a} WHEN {ok} THEN {b} ELSE {high} END AS {name}_high"


RANGED = ", ".join(
    (
        ranged("ceiling", "project_id % 20 / 4e0", "project_id % 9 / 3e0", "18e-1", "8e0", "25e-1", "3e0"),
        ranged("thickness", "project_id % 30 / 1e2", "project_id % 60 / 1e2", "4e-2", "5e-1", "1e-1", "15e-2"),
        ranged("walls", "project_id % 600 * 1e0", "project_id % 70 * 1e1", "1e0", "5e2", "8e0", "25e0"),
        ranged("openings", "project_id % 50 * 1e0", "project_id % 90 * 5e0", "0e0", "2e2", "4e0", "16e0"),
        ranged("area", "CASE WHEN project_id % 2 = 0 THEN project_id % 40 * 3e0 END", "project_id % 90 * 1e3", "1e1", "5e4", "6e1", "2e2"),
    )
)


@query(
    "SELECT project_id, CASE WHEN project_id % 10 < 7 THEN "
    + TYPOLOGY
    + " ELSE 'outro' END AS typology, CASE WHEN project_id % 3 = 0 THEN 'alto' ELSE 'medio' END AS standard, CASE WHEN project_id % 5 = 0 THEN 'L' ELSE 'retangular_simples' END AS envelope_shape, "
    + "CASE WHEN project_id % 4 = 0 THEN 'high' ELSE 'low' END AS confidence, CASE WHEN project_id % 3 <> 0 THEN 'Terreo;L' || CAST(project_id AS VARCHAR) ELSE 'Terreo' END AS levels, "
    + "'sala' AS room, CAST(greatest(0, floor(project_id % 7 - 15e-1 + 5e-1)) AS BIGINT) AS qty, "
    + RANGED
    + ", project_id % 2 = 0 AS has_garage, false AS has_roof, least(600, project_id % 400 * 2) AS n_notes FROM {projects}"
)
def clean_ranges(t):
    out = clean.clean_ranges(_characterizations(t))
    pairs = [f"{k}_{end}" for k in clean.RANGES for end in ("low", "high")]
    return out.select(
        "project_id", "typology", "standard", "envelope_shape", "confidence", F.array_join("levels", ";").alias("levels"), F.col("programme")[0]["room"].alias("room"), F.col("programme")[0]["qty"].alias("qty"),
        *pairs, "has_garage", "has_roof", F.length("notes").cast("long").alias("n_notes"),
    )


@query(
    """WITH n AS (SELECT project_id, seq, lower(text) AS x, CASE WHEN text LIKE 'SALA%' THEN NULL ELSE CAST(regexp_extract(replace(text, ',', '.'), '([0-9]+(\\.[0-9]+)?)', 1) AS DOUBLE) END AS v FROM {dimensions}),
m AS (SELECT *, CASE WHEN x LIKE '%cm' THEN v / 1e2 WHEN x LIKE '%,%' OR x LIKE '%.%' THEN v WHEN v BETWEEN 3 AND 15 THEN v WHEN v BETWEEN 30 AND 1500 THEN v / 1e2 END AS metres FROM n)
SELECT project_id, seq, CASE WHEN metres BETWEEN 2e-1 AND 50 THEN metres WHEN x LIKE 'sala%' THEN s.v2 END AS metres FROM m
LEFT JOIN (SELECT project_id AS p, seq AS q, CASE WHEN CAST(regexp_extract(text, '([0-9]+)', 1) AS DOUBLE) BETWEEN 3 AND 15 THEN CAST(regexp_extract(text, '([0-9]+)', 1) AS DOUBLE)
  WHEN CAST(regexp_extract(text, '([0-9]+)', 1) AS DOUBLE) BETWEEN 30 AND 1500 THEN CAST(regexp_extract(text, '([0-9]+)', 1) AS DOUBLE) / 1e2 END AS v2 FROM {dimensions} WHERE text LIKE 'SALA%') s ON s.p = m.project_id AND s.q = m.seq"""
)
def parse_dimension_text(t):
    return t("dimensions").select("project_id", "seq", exprs.parse_dimension_text("text").alias("metres"))


@query(
    """SELECT CAST(price_text AS VARCHAR) AS price_text, value FROM (SELECT price AS price_text, CASE WHEN price = 'n/a' THEN -1e0 ELSE CAST(replace(price, ',', '.') AS DOUBLE) END AS value FROM {price_sheet})"""
)
def parse_decimal(t):
    return t("price_sheet").select(F.col("price").alias("price_text"), exprs.parse_decimal("price", -1.0).alias("value"))


@query(
    """WITH n AS (SELECT project_id, seq, CASE seq % 8 WHEN 0 THEN 'Térreo' WHEN 1 THEN 'SUBSOLO - Garagem' WHEN 2 THEN '2º pavimento' WHEN 3 THEN 'Outro' WHEN 4 THEN 'telhado, casa' WHEN 5 THEN 'mezanino!' WHEN 6 THEN 'Pav 12' ELSE ' ' END AS raw FROM {corners})
SELECT project_id, seq, CASE seq % 8 WHEN 0 THEN 'Terreo' WHEN 1 THEN 'Subsolo' WHEN 2 THEN '2 pavimento' WHEN 3 THEN 'Terreo' WHEN 4 THEN 'Cobertura' WHEN 5 THEN 'Mezanino' WHEN 6 THEN 'Pavimento12' ELSE 'Terreo' END AS level FROM n"""
)
def normalize_level(t):
    raw = F.element_at(F.array(*(F.lit(x) for x in ("Térreo", "SUBSOLO - Garagem", "2º pavimento", "Outro", "telhado, casa", "mezanino!", "Pav 12", " "))), (F.col("seq") % 8 + 1).cast("int"))
    return t("corners").select("project_id", "seq", exprs.normalize_level(raw).alias("level"))


@query("SELECT project_id, seq, CASE level WHEN 'Terreo' THEN 1 WHEN '1 Pavimento' THEN 2 WHEN '2 Pavimento' THEN 3 ELSE 5 END AS rank FROM {corners}")
def floor_rank(t):
    return t("corners").select("project_id", "seq", exprs.floor_rank("level").alias("rank"))


@query(
    """WITH x AS (SELECT project_id, seq, wall_id, wall_class, level, CASE WHEN seq % 5 = 0 THEN '' ELSE replace(CAST(length_m AS VARCHAR), '.', ',') END AS l, length_m FROM {walls})
SELECT project_id, seq, CASE WHEN seq % 7 = 0 THEN 'P' || CAST(seq AS VARCHAR) ELSE wall_id END AS wall_id, CASE WHEN seq % 11 = 0 THEN 'external' ELSE wall_class END AS wall_class,
  CASE WHEN seq % 5 = 0 THEN 25e-1 ELSE CASE WHEN length_m = 0 THEN 25e-1 ELSE length_m END END AS length_m, 3e0 AS height_m FROM x"""
)
def normalize_geometry(t):
    s = F.col("seq")
    raw = t("walls").select(
        "project_id", "seq", F.when(s % 7 == 0, "").otherwise(F.col("wall_id")).alias("wall_id"), "level", F.when(s % 11 == 0, "strange").otherwise(F.col("wall_class")).alias("wall_class"),
        F.when(s % 5 == 0, "").otherwise(F.regexp_replace(F.col("length_m").cast("string"), "[.]", ",")).alias("length_m"), F.lit("2.5").alias("length"), F.lit(None).cast("string").alias("height_m"), F.lit("0").alias("height"),
        F.lit("x").alias("thickness_m"), "source", F.lit("0.8").alias("confidence"), F.array("ymax", "xmin", "ymin", "xmax").alias("raw_box"),
    )
    return clean.normalize_geometry(raw).select("project_id", "seq", "wall_id", "wall_class", "length_m", "height_m")


@query("SELECT project_id, seq, least(1e3, greatest(0e0, x1 / 8e2 * 1e3)) AS nx, least(1e3, greatest(0e0, y1)) / 1e3 * 6e2 AS py FROM {segments}")
def px_to_norm(t):
    return t("segments").select("project_id", "seq", exprs.px_to_norm("x1", F.lit(800.0)).alias("nx"), exprs.norm_to_px("y1", F.lit(600.0)).alias("py"))


@query(
    """SELECT project_id, seq, greatest(0e0, least(y1, y2) - thickness_pct / 1e2 * 1e3 / 2) AS ymin, least(1e3, greatest(x1, x2) + thickness_pct / 1e2 * 1e3 / 2) AS xmax FROM {segments}"""
)
def segment_bbox(t):
    return clean.segment_bbox(t("segments")).select("project_id", "seq", F.col("bbox.ymin").alias("ymin"), F.col("bbox.xmax").alias("xmax"))


@query("SELECT project_id, level, (x1 - x0) * (52e1 - y0) + (5e2 - x0) * (y1 - 52e1) AS area, 2 * (x1 - x0) + 2 * (y1 - y0) AS perimeter FROM {envelopes}")
def polygon_measures(t):
    return t.envelopes().select("project_id", "level", half_up(exprs.polygon_area(F.col("polygon")), 3).alias("area"), half_up(exprs.polygon_perimeter(F.col("polygon")), 3).alias("perimeter"))


@query(
    r"""WITH x AS (SELECT project_id, seq, text FROM {dimensions} UNION ALL SELECT project_id, -1, name FROM {projects} UNION ALL SELECT -1, product_id, name FROM {products}),
n AS (SELECT *, regexp_replace(strip_accents(lower(trim(text))), '\s+', ' ', 'g') AS t FROM x), c AS (SELECT *, replace(replace(replace(t, ',', '.'), ' ', ''), 'm', '') AS d FROM n),
v AS (SELECT *, CASE WHEN regexp_full_match(d, '\d+(\.\d+)?') THEN CAST(d AS DOUBLE) END AS v FROM c),
k AS (SELECT *, CASE WHEN v IS NOT NULL THEN CASE WHEN v > 0 AND v <= 50 THEN 'dimension' ELSE 'other' END WHEN regexp_full_match(replace(t, ' ', ''), '[pj][a-z]?\d{1,3}') THEN 'door_window_code'
  WHEN regexp_matches(t, 'sala|estar|jantar|tv|quarto|dormitorio|suite|ste|cozinha|copa|banho|banheiro|bwc|wc|lavabo|sanitario|lavanderia|area de servico|as|dispensa|despensa|hall|corredor|circulacao|passagem|escritorio|office|closet|vestiario|biblioteca|estudio|deposito|storage|escada|elevador|shaft') THEN 'internal'
  WHEN regexp_matches(t, 'varanda|sacada|balcao|terraco coberto|garagem|abrigo|carport|santuario|alpendre|pergolado coberto|passarela coberta') THEN 'covered'
  WHEN regexp_matches(t, 'jardim|quintal|patio|piscina|espelho d.?agua|churrasqueira|deck|estacionamento|horta|canteiro|rua|calcada|acesso') THEN 'uncovered'
  WHEN regexp_matches(t, 'escala|data|prancha|projeto|obra|responsavel|arquiteto|engenheiro|cliente|endereco|n') THEN 'title_block' ELSE 'other' END AS k FROM v)
SELECT project_id, seq, CASE WHEN k IN ('internal', 'covered', 'uncovered') THEN 'room_label' ELSE k END AS text_class, CASE WHEN k IN ('internal', 'covered', 'uncovered') THEN k END AS room_type,
  CASE WHEN k = 'dimension' THEN CASE WHEN v > 30 THEN v / 1e2 ELSE v END END AS dimension_m FROM k"""
)
def classify_text(t):
    names = t("projects").select("project_id", F.lit(-1).cast("long").alias("seq"), F.col("name").alias("text"))
    products = t("products").select(F.lit(-1).cast("long").alias("project_id"), F.col("product_id").cast("long").alias("seq"), F.col("name").alias("text"))
    every = t("dimensions").select("project_id", "seq", "text").unionByName(names).unionByName(products)
    return clean.classify_text(every).select("project_id", "seq", "text_class", "room_type", "dimension_m")


@query(
    """SELECT sku, trim(upper(regexp_replace(replace(replace(replace(name, '"', ''), 'É', 'E'), 'é', 'e'), '\\s+', ' ', 'g'))) AS plain FROM {products}"""
)
def normalize_product_name(t):
    return t("products").select("sku", exprs.normalize_product_name("name").alias("plain"))


@query("SELECT id, project_id, kind, phase FROM {pipeline_events} WHERE kind NOT IN ('page_split', 'cv_substep') AND NOT (kind = 'ai_call' AND phase = 'started')")
def persistable_events(t):
    return clean.persistable(t("pipeline_events")).select("id", "project_id", "kind", "phase")


@query("SELECT id, project_id FROM {pipeline_events} WHERE phase = 'failed' OR kind = 'audit' AND severity IN ('warning', 'error')")
def error_feed(t):
    return clean.error_feed(t("pipeline_events")).select("id", "project_id")


PROMPTS = "['classifyAndExtract-v2', 'characterizeProject', 'extractGeometry-v7', 'verify1', 'wallInventory', 'cotaReader', 'envelope-2', 'selfCheck', 'globalCrossValidation', 'globalValidation-1', 'description', 'describe', 'sectionInfo', 'buildingType', 'strange', '']"


@query(
    """SELECT id, CASE WHEN kind = 'stage' THEN CASE WHEN id % 2 = 0 THEN stage END WHEN kind = 'page_split' THEN '0.5' WHEN kind = 'cv_substep' THEN '3.4' WHEN kind = 'audit' THEN CASE WHEN id % 2 = 0 THEN stage ELSE '6.5' END
  ELSE ['1', '1.5', '3', '3.5', '3.5', '3.6', '3.7', '6.5', '4.6', '4.6', '8', '8', '0.5', '1', '?', '?'][id // 5 % 16 + 1] END AS stage_id FROM {pipeline_events}"""
)
def infer_stage(t):
    prompts = F.array(*(F.lit(x) for x in PROMPTS.strip("[]").replace("'", "").split(", ")))
    own = t("pipeline_events").withColumns({"prompt_version": F.get(prompts, (F.floor(F.col("id") / 5) % 16).cast("int")), "stage": F.when(F.col("id") % 2 == 0, F.col("stage"))})
    return clean.infer_stage(own).select("id", "stage_id")


SIGNATURE = """CAST(thickness_cm AS VARCHAR) || '|' || CAST(length_dm AS VARCHAR) || '|' || CASE WHEN has_window THEN '1' WHEN NOT has_window THEN '0' ELSE 'x' END || '|' || CASE WHEN has_door THEN '1' WHEN NOT has_door THEN '0' ELSE 'x' END || '|' || original_class"""


@query("SELECT id, " + SIGNATURE + " AS signature FROM {feedback}")
def feedback_signature(t):
    return clean.feedback_signature(t("feedback")).select("id", "signature")


FEEDBACK_RAW = """SELECT id, user_id, CASE WHEN id % 31 <> 0 THEN project_id END AS project_id, CASE WHEN id % 29 = 0 THEN repeat('w', 65) WHEN id % 37 = 0 THEN '  ' ELSE wall_id END AS wall_id,
  CASE WHEN id % 17 = 0 THEN 12e0 WHEN id % 13 = 0 THEN 0e0 ELSE thickness_cm / 1e2 END AS thickness_m, CASE WHEN id % 19 = 0 THEN length_dm * 1e1 ELSE length_dm / 1e1 END AS length_m,
  CASE WHEN id % 23 = 0 THEN 'strange' WHEN id % 7 <> 0 THEN original_class END AS original_class, CASE WHEN id % 5 = 0 THEN 'not_wall' WHEN id % 41 = 0 THEN 'strange' ELSE corrected_class END AS corrected_class,
  CASE WHEN id % 43 <> 0 THEN action ELSE 'other' END AS action, is_exemplar, repeat('n', CAST(id % 520 AS INT)) AS notes FROM {feedback}"""


@query(
    "WITH r AS ("
    + FEEDBACK_RAW
    + """) SELECT id, id % 43 <> 0 AND id % 29 <> 0 AND id % 37 <> 0 AND id % 17 <> 0 AND length_m <= 1000 AND id % 23 <> 0 AND (id % 5 = 0 OR id % 41 <> 0) AND id % 520 <= 500 AND (id % 31 <> 0 OR coalesce(u.is_admin, false)) AS valid,
  coalesce(u.is_admin, false) AND (is_exemplar OR action = 'exemplar') AS is_exemplar, CAST(CASE WHEN thickness_m > 0 THEN floor(thickness_m * 1e2 + 5e-1) END AS BIGINT) AS thickness_cm,
  CAST(CASE WHEN length_m > 0 THEN floor(length_m * 1e1 + 5e-1) END AS BIGINT) AS length_dm FROM r LEFT JOIN {users} u ON r.user_id = u.user_id"""
)
def feedback_validate(t):
    raw = t.spark.sql(FEEDBACK_RAW, feedback=t("feedback"))
    return clean.feedback_validate(raw, t("users")).select("id", "valid", "is_exemplar", "thickness_cm", "length_dm")


def _element_rows(t):
    """Elements as JSON rows, as they are stored."""
    walls = t("walls").select("project_id", "seq", F.lit("wall").alias("element_type"), F.to_json(F.struct(F.col("wall_id").alias("id"), "level", "wall_class", "length_m", "height_m", "page_index")).alias("data"))
    slabs = t("slabs").select("project_id", "seq", F.lit("slab").alias("element_type"), F.to_json(F.struct(F.col("slab_id").alias("id"), "level", "slab_class", "area_m2")).alias("data"))
    corners = t("corners").select("project_id", "seq", F.lit("corner").alias("element_type"), F.to_json(F.struct(F.col("corner_id").alias("id"), "level", "corner_count")).alias("data"))
    return walls.unionByName(slabs).unionByName(corners)


@query(
    """SELECT project_id, seq, 'wall' AS kind, wall_id AS id, length_m AS measure FROM {walls} UNION ALL SELECT project_id, seq, 'slab', slab_id, area_m2 FROM {slabs}
UNION ALL SELECT project_id, seq, 'corner', corner_id, corner_count / 1e0 FROM {corners}"""
)
def read_elements(t):
    walls, slabs, corners = io.read_elements(_element_rows(t))
    row = lambda df, kind, key, m: df.select("project_id", "seq", F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(m).cast("double").alias("measure"))
    return row(walls, "wall", "wall_id", "length_m").unionByName(row(slabs, "slab", "slab_id", "area_m2")).unionByName(row(corners, "corner", "corner_id", "corner_count"))


@query(
    """SELECT project_id, CAST(seq AS VARCHAR) || '-' || CAST(page_index AS VARCHAR) || '-s' || CAST(seq AS VARCHAR) AS wall_id, level, length_m, CASE WHEN seq % 3 = 0 THEN 3e0 ELSE height_m END AS height_m,
  CASE seq % 3 WHEN 0 THEN 'external' WHEN 1 THEN 'internal' ELSE 'boundary' END AS wall_class FROM {walls} WHERE length_m > 0"""
)
def read_takeoff_docs(t):
    s = F.col("seq")
    segment = F.struct(
        F.concat(F.lit("s"), s.cast("string")).alias("id"), F.when(s % 3 == 0, "parede_externa").when(s % 3 == 1, "parede_interna").otherwise("muro").alias("category"),
        F.when(s % 2 == 0, F.col("length_m")).alias("length_m_ai"), F.col("length_m").alias("length_m_calculated"), F.when(s % 3 != 0, F.col("height_m")).alias("height_m"),
    )
    sheet = F.struct("page_index", "level", F.array(segment).alias("segments"))
    docs = t("walls").select("project_id", F.col("seq").alias("doc_id"), F.to_json(F.struct(F.array(sheet).alias("sheets"))).alias("data"))
    return io.read_takeoff_docs(docs)[0].select("project_id", "wall_id", "level", "length_m", "height_m", "wall_class")


@query(
    """SELECT project_id, page_index, file_seq, CASE WHEN file_seq = 1 THEN 'Pavimento' ELSE level END AS level, ext_gross, ext_net, CASE WHEN page_index % 2 = 0 THEN 0e0 ELSE int_gross END AS int_gross, 0e0 AS int_net,
  CASE WHEN boundary_height = 0 OR page_index % 5 = 0 THEN 2e0 ELSE boundary_height END AS boundary_height, CASE WHEN file_seq = 2 THEN 0e0 ELSE floor_m2 END AS floor_m2,
  CASE WHEN file_seq = 0 THEN 0 ELSE CASE WHEN page_index % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN page_index % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN page_index % 3 = 1 THEN 1 ELSE 0 END END AS n_missing,
  CASE WHEN page_index % 3 = 0 THEN 'high' ELSE 'low' END AS confidence, CASE page_index % 4 WHEN 0 THEN 'window' WHEN 1 THEN 'door' ELSE 'other' END AS opening_kind,
  CASE WHEN page_index % 2 = 0 THEN 'internal' ELSE 'external' END AS opening_wall, CASE WHEN page_index % 3 = 0 THEN 7e0 ELSE 15e-1 * (page_index % 7) END AS opening_m2 FROM {area_pages}"""
)
def read_area_pages(t):
    page = F.col("page_index")
    opening = F.struct(
        F.when(page % 4 == 0, "janela").when(page % 4 == 1, "porta").otherwise("strange").alias("tipo"), F.when(page % 2 == 0, "interna").alias("parede"),
        F.lit("1.5").alias("largura_m"), (page % 7).alias("altura_m"), F.when(page % 3 == 0, 7).alias("area_m2"),
    )
    answer = F.struct(
        F.when(F.col("file_seq") != 1, F.col("level")).alias("pavimento"),
        F.struct(F.col("ext_gross").alias("area_bruta_m2"), F.col("ext_open").alias("area_aberturas_m2"), F.col("ext_net").cast("string").alias("area_liquida_m2")).alias("paredes_externas"),
        F.when(page % 2 != 0, F.struct(F.col("int_gross").cast("string").alias("area_bruta_m2"), F.lit("x").alias("area_liquida_m2"))).alias("paredes_internas"),
        F.when(page % 5 != 0, F.struct(F.col("boundary_gross").alias("area_bruta_m2"), F.col("boundary_height").alias("altura_assumida_m"))).alias("muros"),
        F.when(F.col("file_seq") == 2, "n/a").otherwise(F.col("floor_m2").cast("string")).alias("laje_piso_m2"),
        F.when(page % 3 != 1, F.col("roof_m2")).alias("laje_coberta_m2"),
        F.array(opening).alias("aberturas"),
        F.when(page % 3 == 0, "high").otherwise("certain").alias("confidence"),
    )
    # the first file's answers state what they don't know as null; the second's have no level or a number for one
    data = F.when(F.col("file_seq") == 0, F.to_json(answer, {"ignoreNullFields": "false"})).when((F.col("file_seq") == 1) & (page % 2 == 0), F.concat(F.lit('{"pavimento":3,'), F.substring(F.to_json(answer), 2, 1 << 30))).otherwise(F.to_json(answer))
    out = io.read_area_pages(t("area_pages").select("project_id", F.struct("page_index", "file_seq").alias("seq"), data.alias("data")))
    o = F.col("openings")[0]
    return out.select(
        "project_id", "seq.page_index", "seq.file_seq", "level", "ext_gross", "ext_net", "int_gross", "int_net", "boundary_height", "floor_m2", F.size("missing").cast("long").alias("n_missing"), "confidence",
        o["kind"].alias("opening_kind"), o["wall_class"].alias("opening_wall"), o["area_m2"].alias("opening_m2"),
    )


@query(
    """SELECT trim(description) AS description, trim(hub) AS hub, CAST(replace(price, ',', '.') AS DOUBLE) AS price FROM {price_sheet} WHERE hub <> '' AND price <> 'n/a' AND CAST(replace(CASE WHEN price = 'n/a' THEN '0' ELSE price END, ',', '.') AS DOUBLE) > 0"""
)
def read_price_sheet(t):
    folder = io.run_folder(t.spark, "prices")
    t("price_sheet").select("description", "hub", "price").write.option("header", True).csv(folder)
    return io.read_price_sheet(t.spark, folder)


SHEET = """sh AS (SELECT trim(upper(regexp_replace(replace(description, 'É', 'E'), '\\s+', ' ', 'g'))) AS k, description, lower(replace(hub, ' ', '_')) AS hub_code, CAST(replace(price, ',', '.') AS DOUBLE) AS price FROM {price_sheet}
  WHERE hub <> '' AND price NOT IN ('n/a', '0')),
kn AS (SELECT trim(upper(regexp_replace(replace(replace(replace(name, '"', ''), 'É', 'E'), 'é', 'e'), '\\s+', ' ', 'g'))) AS k, min(sku) AS sku FROM {products} GROUP BY 1)"""


@query("WITH " + SHEET + " SELECT hub_code, sku, max(price) AS price FROM sh JOIN kn ON sh.k = kn.k GROUP BY 1, 2")
def match_price_sheet(t):
    return io.match_price_sheet(io.clean_price_sheet(t("price_sheet")), t("products"))[0]


@query("WITH " + SHEET + " SELECT DISTINCT trim(description) AS description FROM sh WHERE k NOT IN (SELECT k FROM kn)")
def unmatched_products(t):
    return io.match_price_sheet(io.clean_price_sheet(t("price_sheet")), t("products"))[1]


@query("WITH " + SHEET + " SELECT count(sku) AS matched, count(*) AS rows, floor(count(sku) / count(*) * 1e4 + 5e-1) / 1e4 AS rate, count(sku) / count(*) >= 9e-1 AS accepted FROM sh LEFT JOIN kn ON sh.k = kn.k")
def price_match_rate(t):
    return io.match_price_sheet(io.clean_price_sheet(t("price_sheet")), t("products"))[2]


@query(
    """WITH i AS (SELECT CAST(profile_id AS BIGINT) AS profile_id, sku, CAST(unit_price + 1 AS DOUBLE) AS unit_price FROM {profile_prices} WHERE profile_id <> 1 UNION ALL SELECT 99, sku, CAST(unit_price AS DOUBLE) FROM {products})
SELECT coalesce(i.profile_id, c.profile_id) AS profile_id, coalesce(i.sku, c.sku) AS sku, CAST(coalesce(i.unit_price, c.unit_price) AS DOUBLE) AS unit_price FROM {profile_prices} c FULL JOIN i ON c.profile_id = i.profile_id AND c.sku = i.sku"""
)
def upsert_profile_prices(t):
    current = t("profile_prices")
    new = current.filter("profile_id <> 1").withColumn("unit_price", F.col("unit_price") + 1).unionByName(t("products").select(F.lit(99).cast("long").alias("profile_id"), "sku", "unit_price"))
    # kept in place by profile and sku; the same load a second time changes nothing
    path, keys = io.run_folder(t.spark, "prices"), ["profile_id", "sku"]
    buckets.upsert_in_place(current.select(*keys, "unit_price"), path, keys, "first")
    changes = io.upsert_profile_prices(buckets.read_buckets(t.spark, path, current.select(*keys, "unit_price").schema), new).join(new.select(*keys), keys, "left_semi")
    for _ in range(2):
        buckets.upsert_in_place(changes, path, keys, "second")
    return buckets.read_buckets(t.spark, path, changes.schema)


@query(
    """SELECT project_id, seq, x FROM {side_hints} WHERE project_id % 3 <> 0 OR project_id NOT IN (SELECT project_id FROM {corners}) UNION ALL SELECT project_id, seq, corner_count / 1e0 FROM {corners} WHERE project_id % 3 = 0"""
)
def replace_by_project(t):
    new = t("corners").filter("project_id % 3 = 0").select("project_id", "seq", F.col("corner_count").cast("double").alias("x"))
    old, path = t("side_hints").select("project_id", "seq", "x"), io.run_folder(t.spark, "hints")
    buckets.replace_in_place(old, path, "first")
    for _ in range(2):
        buckets.replace_in_place(new, path, "second")
    return buckets.read_buckets(t.spark, path, old.schema)


WALLS_JSON = "walls array<struct<wall_id: string, length_m: double>>"


def _responses(t):
    """Three walls a response; some cut off, fenced, spoilt or empty."""
    s = F.col("seq")
    text = F.to_json(F.struct(F.array(*(F.struct(F.concat(F.lit(f"w{k}-"), s.cast("string")).alias("wall_id"), (F.col("corner_count") + k).cast("double").alias("length_m")) for k in range(3))).alias("walls"), (s * 2).alias("extra")))
    data = (
        F.when(s % 6 == 0, F.substring(text, 1, 75)).when(s % 6 == 1, F.concat(F.lit("```json\n"), text, F.lit("\n```"))).when(s % 6 == 2, F.regexp_replace(text, "\\],", ",],")).when(s % 6 == 3, "no answer").when(s % 6 == 4, "").otherwise(text)
    )
    return t("corners").select("project_id", "seq", data.alias("data"))


@query(
    """SELECT project_id, seq, CASE seq % 6 WHEN 0 THEN 'recovered' WHEN 3 THEN 'quarantine' WHEN 4 THEN 'empty' WHEN 5 THEN 'strict' ELSE 'repaired' END AS outcome,
  CASE seq % 6 WHEN 0 THEN 1 WHEN 3 THEN -1 WHEN 4 THEN -1 ELSE 3 END AS n_walls, CASE seq % 6 WHEN 5 THEN seq * 2 WHEN 1 THEN seq * 2 WHEN 2 THEN seq * 2 END AS extra FROM {corners}"""
)
def recover_json(t):
    return io.recover_json(_responses(t), WALLS_JSON).select("project_id", "seq", "outcome", F.coalesce(F.size("parsed.walls"), F.lit(-1)).cast("long").alias("n_walls"), F.try_variant_get("document", "$.extra", "long").alias("extra"))


@query(
    """SELECT project_id, row_kind, page, category, area_m2 FROM (WITH fl AS (SELECT project_id, file_seq, max(page_index) + 1 AS n FROM {area_pages} GROUP BY 1, 2),
of AS (SELECT project_id, file_seq, coalesce(sum(n) OVER (PARTITION BY project_id ORDER BY file_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM fl),
pg AS (SELECT a.*, CAST(a.page_index + of.o AS BIGINT) AS page FROM {area_pages} a JOIN of ON a.project_id = of.project_id AND a.file_seq = of.file_seq),
x AS (SELECT project_id, page, 'ext_net' AS category, ext_net AS a FROM pg UNION ALL SELECT project_id, page, 'int_net', int_net FROM pg UNION ALL SELECT project_id, page, 'boundary_gross', boundary_gross FROM pg
  UNION ALL SELECT project_id, page, 'floor_m2', floor_m2 FROM pg UNION ALL SELECT project_id, page, 'roof_m2', roof_m2 FROM pg)
SELECT project_id, CASE WHEN page IS NULL THEN 'total' ELSE 'page' END AS row_kind, page, category, floor(sum(a) * 1e2 + 5e-1) / 1e2 AS area_m2 FROM x GROUP BY GROUPING SETS ((project_id, page, category), (project_id, category)))"""
)
def export_area_csv(t):
    from ..operators import areas

    return io.area_csv_rows(areas.consolidate_files(t("area_pages"))[0])


@query(
    """SELECT project_id, seq, wall_id, 'plan' AS primary_view FROM {walls} WHERE file_id = 0 UNION ALL SELECT project_id, seq, wall_id, 'roof_plan' FROM {walls} WHERE file_id = 1"""
)
def union_views(t):
    walls = t("walls")
    return fuse.union_views(walls.filter("file_id = 0"), walls.filter("file_id = 1").withColumn("primary_view", F.lit("roof_plan"))).select("project_id", "seq", "wall_id", "primary_view")


@query("SELECT DISTINCT project_id, level FROM {walls} UNION SELECT DISTINCT project_id, level FROM {slabs}")
def distinct_levels(t):
    return t("walls").select("project_id", "level").union(t("slabs").select("project_id", "level")).distinct()


