"""Adapters from the given star-schema tables to the domain tables.

Each is one SELECT that Spark and DuckDB both run, in whole numbers and plain arithmetic, so that a query and its SQL read the same
rows. `{name}` stands for a table or another adapter."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.io import dealt

LEVEL = "CASE {0} % 4 WHEN 0 THEN 'Terreo' WHEN 1 THEN '1 Pavimento' WHEN 2 THEN '2 Pavimento' ELSE 'Cobertura' END"

ADAPTERS = {
    "wall_base": """
SELECT l_suppkey AS project_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity,
    l_extendedprice, l_shipdate) AS BIGINT) AS seq, l_orderkey AS ok, l_partkey AS pk, CAST(l_linenumber AS BIGINT) AS ln, l_returnflag AS rf,
  CAST(l_quantity AS BIGINT) AS q, CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(round(l_tax * 100) AS BIGINT) AS t FROM {lineitem}""",
    "walls": f"""
SELECT project_id, seq, ok % 2 AS file_id, CAST(ok % 3 AS INT) AS page_index, 'W' || CAST(seq AS STRING) AS wall_id, {LEVEL.format("ln")} AS level,
  CASE rf WHEN 'A' THEN 'external' WHEN 'N' THEN 'internal' ELSE 'boundary' END AS wall_class,
  CASE WHEN pk % 23 = 0 THEN 0e0 WHEN pk % 29 = 0 THEN q * 25e0 ELSE q * 25 / 1e2 END AS length_m,
  CASE WHEN t = 0 THEN 0e0 WHEN pk % 31 = 0 THEN 280e0 ELSE (220 + 20 * t) / 1e2 END AS height_m,
  CASE WHEN pk % 37 = 0 THEN 45 / 1e2 ELSE (5 + d) / 1e2 END AS thickness_m,
  CASE pk % 5 WHEN 0 THEN 'pdf_vector' WHEN 1 THEN 'table' WHEN 2 THEN 'ai_vision_takeoff' WHEN 3 THEN 'inferred_from_symbol' ELSE 'bim' END AS source,
  (50 + 4 * d) / 1e2 AS confidence, ok % 3 = 0 AS has_door, ok % 4 = 1 AS has_window, 0e0 AS opening_area_m2,
  CASE WHEN pk % 17 <> 0 THEN CAST(ok * 13 % 1000 AS DOUBLE) END AS ymin, CASE WHEN pk % 17 <> 0 THEN CAST(pk * 7 % 1000 AS DOUBLE) END AS xmin,
  CASE WHEN pk % 17 <> 0 THEN CAST(ok * 13 % 1000 AS DOUBLE) + CASE WHEN ln % 2 = 0 THEN 6 ELSE q * 4 END END AS ymax,
  CASE WHEN pk % 17 <> 0 THEN CAST(pk * 7 % 1000 AS DOUBLE) + CASE WHEN ln % 2 = 0 THEN q * 4 ELSE 6 END END AS xmax,
  CASE WHEN ok % 3 = 0 AND pk % 7 <> 0 THEN 'P' || CAST(pk % 12 AS STRING) END AS door_code, CASE WHEN pk % 4 = 0 THEN 0e0 ELSE (60 + 10 * (pk % 6)) / 1e2 END AS door_w,
  CASE WHEN pk % 6 = 0 THEN 0e0 ELSE 21 / 1e1 END AS door_h,
  CASE WHEN ok % 4 = 1 AND pk % 7 <> 0 THEN 'J' || CAST(pk % 12 AS STRING) END AS win_code, CASE WHEN pk % 4 = 1 THEN 0e0 ELSE (80 + 20 * (pk % 5)) / 1e2 END AS win_w,
  CASE WHEN pk % 6 = 1 THEN 0e0 ELSE (60 + 10 * (pk % 7)) / 1e2 END AS win_h, CASE WHEN pk % 3 = 0 THEN 0e0 ELSE (90 + 10 * (pk % 8)) / 1e2 END AS win_sill
FROM {{wall_base}}""",
    "slab_base": """
SELECT o_custkey % (SELECT count(*) FROM {supplier}) AS project_id, o_orderkey AS seq, o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
  o_orderstatus AS st, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS pr FROM {orders}""",
    "slabs": f"""
SELECT project_id, seq, CAST(k % 3 AS INT) AS page_index, 'S' || CAST(k AS STRING) AS slab_id, {LEVEL.format("k")} AS level,
  CASE st WHEN 'F' THEN 'floor' WHEN 'O' THEN 'roof' ELSE 'raft' END AS slab_class,
  CASE WHEN k % 41 = 0 THEN 0e0 WHEN k % 43 = 0 THEN 6000e0 ELSE cents % 20000 / 1e2 END AS area_m2,
  CASE k % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'pdf_vector' ELSE 'inferred_from_symbol' END AS source, (50 + 10 * (k % 5)) / 1e2 AS confidence
FROM {{slab_base}} WHERE pr <= 3""",
    "sched_areas": f"""
SELECT project_id, seq, {LEVEL.format("k")} AS level, cents % 30000 / 1e2 AS area_m2,
  CASE k % 5 WHEN 0 THEN 'total' WHEN 1 THEN 'roofed' ELSE 'room' END AS area_kind FROM {{slab_base}} WHERE pr = 4 AND k % 6 < 4""",
    "sched_walls": f"""
SELECT project_id, seq, 'Q' || CAST(k AS STRING) AS wall_id, {LEVEL.format("k")} AS level, CASE st WHEN 'F' THEN 'external' WHEN 'O' THEN 'internal' ELSE 'boundary' END AS wall_class,
  cents % 1200 / 1e2 AS length_m, (250 + k % 60) / 1e2 AS height_m, (8 + k % 8) / 1e2 AS thickness_m FROM {{slab_base}} WHERE pr = 5""",
    "sched_openings": """
SELECT project_id, seq, CASE WHEN k % 9 = 0 THEN ' ' ELSE '' END || CASE WHEN k % 2 = 0 THEN 'P' ELSE 'j' END || CAST(k % 15 AS STRING) AS code,
  CASE WHEN k % 2 = 0 THEN 'door' ELSE 'window' END AS kind, (60 + 10 * (k % 9)) / 1e2 AS width_m, (60 + 10 * (k % 16)) / 1e2 AS height_m, 1 + k % 4 AS quantity
FROM {slab_base} WHERE pr = 4 AND k % 6 >= 4""",
    "corners": f"""
SELECT project_id, seq, 'C' || CAST(k AS STRING) AS corner_id, {LEVEL.format("k")} AS level, CAST(k % 9 AS INT) AS corner_count FROM {{slab_base}} WHERE pr = 1""",
    "sections": """
SELECT project_id, seq, CASE k % 6 WHEN 0 THEN ' TERREO ' WHEN 1 THEN '1 Pavimento' WHEN 2 THEN 'Pavimento 2' WHEN 3 THEN 'Pav. Terreo' WHEN 4 THEN 'Mezanino' ELSE '10 Pavimento' END AS level,
  (100 + cents % 800) / 1e2 AS ceiling_m, (40 + 10 * (k % 7)) / 1e2 AS confidence, CAST(k % 4 AS INT) AS page_index FROM {slab_base} WHERE k % 8 = 0""",
    "projects": """
SELECT s_suppkey AS project_id, CASE s_suppkey % 4 WHEN 0 THEN 'Casa ' WHEN 1 THEN 'Loja ' WHEN 2 THEN 'Galpao ' ELSE 'Predio ' END || s_name AS name,
  'Client ' || CAST(s_nationkey % 7 AS STRING) AS client_name, CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE 'c' || CAST(s_nationkey % 7 AS STRING) || '@example.com' END AS client_email,
  CASE WHEN s_suppkey % 3 = 0 THEN 'test' ELSE 'production' END AS project_type, CASE s_suppkey % 5 WHEN 0 THEN 'processing' WHEN 1 THEN 'error' ELSE 'completed' END AS status,
  CASE s_suppkey % 5 WHEN 0 THEN 'residencial' WHEN 1 THEN 'comercial' WHEN 2 THEN 'institucional' WHEN 3 THEN 'industrial' ELSE NULL END AS building_type,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' DAY * CAST(s_suppkey % 300 AS INT) AS created_at,
  CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(round(s_acctbal * 100) AS BIGINT) / 1e2 END AS real_ext, (CAST(round(s_acctbal * 100) AS BIGINT) % 70000) / 1e2 AS real_int,
  CASE WHEN s_suppkey % 7 = 0 THEN 120e0 ELSE 0e0 END AS real_boundary, 200 + s_suppkey % 40 / 1e0 AS real_floor, CASE WHEN s_suppkey % 3 = 1 THEN NULL ELSE 180 + s_suppkey % 30 / 1e0 END AS real_roof,
  (s_suppkey % 34 - 3) / 1e0 AS discount_pct, s_suppkey % 11 * 100 / 1e0 AS freight, CASE WHEN s_suppkey % 9 = 0 THEN -5e0 ELSE s_suppkey % 6 * 10 / 1e0 END AS biomass,
  CASE WHEN s_suppkey % 5 = 4 THEN NULL ELSE CAST(s_suppkey % 5 AS BIGINT) END AS profile_id, s_suppkey % 17 AS user_id,
  CASE WHEN s_suppkey % 8 = 0 THEN '' WHEN s_suppkey % 8 = 1 THEN NULL ELSE 'f' || CAST(s_suppkey % 25 AS STRING) END AS fingerprint FROM {supplier}""",
    "users": """
SELECT DISTINCT user_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id % 5 END AS default_profile_id, user_id % 4 = 0 AS is_admin FROM {projects}""",
    "price_profiles": """
SELECT CAST(r_regionkey AS BIGINT) AS profile_id, lower(r_name) AS code, r_name AS label, r_regionkey = 2 AS is_default, r_regionkey <> 3 AS active FROM {region}""",
    "products": """
SELECT p_partkey AS product_id, CASE p_partkey WHEN 10 THEN 'LW-2P-090' WHEN 11 THEN 'LW-SP-090' WHEN 12 THEN 'PROJ-PAG' ELSE 'SKU-' || CAST(p_partkey AS STRING) END AS sku,
  CASE WHEN p_partkey % 5 = 0 THEN 'Painel "' || p_name || '" ' || CAST(p_partkey AS STRING) ELSE p_name || ' Éco  ' || CAST(p_partkey AS STRING) END AS name,
  CASE WHEN p_partkey % 4 = 3 AND p_partkey <> 11 THEN 'acessorio' ELSE 'painel' END AS category, CASE p_partkey % 3 WHEN 0 THEN '2P' WHEN 1 THEN 'SP' ELSE NULL END AS panel_type,
  CAST(round(p_retailprice * 100) AS BIGINT) / 1e3 AS unit_price FROM {part}""",
    "profile_prices": """
SELECT CAST(r_regionkey AS BIGINT) AS profile_id, sku, CAST(round(unit_price * 100) AS BIGINT) * (100 + r_regionkey) / 1e4 AS unit_price
FROM {products} CROSS JOIN {region} WHERE (product_id + r_regionkey) % 3 = 0""",
    "price_sheet": """
SELECT CAST(row_number() OVER (ORDER BY product_id, r_regionkey) AS BIGINT) AS seq, CASE WHEN product_id % 13 = 0 THEN 'Unknown ' || CAST(product_id AS STRING) ELSE upper(replace(name, '"', '')) END AS description,
  CASE WHEN product_id % 19 = 0 THEN '' ELSE r_name END AS hub, CASE WHEN product_id % 17 = 0 THEN '0' WHEN product_id % 23 = 0 THEN 'n/a'
    ELSE CAST(product_id % 900 AS STRING) || ',' || CAST(10 + product_id % 90 AS STRING) END AS price
FROM {products} CROSS JOIN {region} WHERE r_regionkey < 3""",
    "feedback": """
SELECT seq * 1000000 + project_id AS id, project_id, CASE WHEN pk % 11 = 0 THEN NULL ELSE ok % 7 END AS user_id, 'W' || CAST(seq AS STRING) AS wall_id,
  CAST(5 + d AS BIGINT) AS thickness_cm, CAST(floor(q * 25 / 1e1 + 5e-1) AS BIGINT) AS length_dm, CASE WHEN pk % 13 = 0 THEN NULL ELSE ok % 4 = 1 END AS has_window,
  CASE WHEN pk % 14 = 0 THEN NULL ELSE ok % 3 = 0 END AS has_door, CASE rf WHEN 'A' THEN 'external' WHEN 'N' THEN 'internal' ELSE 'boundary' END AS original_class,
  CASE pk % 4 WHEN 0 THEN 'external' WHEN 1 THEN 'internal' WHEN 2 THEN 'boundary' ELSE NULL END AS corrected_class,
  CASE WHEN pk % 9 = 0 THEN 'confirm' WHEN pk % 9 = 1 THEN 'not_wall' WHEN pk % 9 = 2 THEN 'exemplar' ELSE 'correct' END AS action,
  pk % 50 = 3 AS is_exemplar, pk % 10 <> 0 AS active FROM {wall_base} WHERE pk % 3 = 0""",
    "side_hints": f"""
SELECT project_id, seq, CASE WHEN k % 5 = 0 THEN 'all' ELSE {LEVEL.format("k")} END AS level, CAST(k * 31 % 1000 AS DOUBLE) AS x, CAST(cents % 1000 AS DOUBLE) AS y,
  CASE WHEN cents % 2 = 0 THEN 'exterior' ELSE 'interior' END AS side FROM {{slab_base}} WHERE k % 11 = 0""",
    "envelopes": """
SELECT project_id, level, CAST(project_id % 3 AS INT) AS page_index, CAST(100 + project_id % 50 AS DOUBLE) AS x0, CAST(100 + project_id % 30 AS DOUBLE) AS y0,
  CAST(900 - project_id % 40 AS DOUBLE) AS x1, CAST(880 - project_id % 60 AS DOUBLE) AS y1, project_id % 2 = 0 AS has_lot, (40 + project_id % 60) / 1e2 AS confidence
FROM (SELECT s_suppkey AS project_id FROM {supplier}) p CROSS JOIN (SELECT 'Terreo' AS level UNION ALL SELECT '1 PAVIMENTO' UNION ALL SELECT '2 Pavimento') l WHERE project_id % 10 <> 9""",
    "segments": f"""
SELECT project_id, seq, {LEVEL.format("ln")} AS level, CAST(ok % 3 AS INT) AS page_index, CAST(pk * 7 % 1000 AS DOUBLE) AS x1, CAST(ok * 13 % 1000 + d AS DOUBLE) AS y1,
  CAST(pk * 7 % 1000 + CASE WHEN ln % 2 = 0 THEN q * 4 ELSE 0 END AS DOUBLE) AS x2, CAST(ok * 13 % 1000 + d + CASE WHEN ln % 2 = 0 THEN 0 ELSE q * 4 END AS DOUBLE) AS y2,
  d / 1e0 AS thickness_pct, ok % 3 = 0 AS has_door, ok % 4 = 1 AS has_window, CASE WHEN d = 0 THEN 0e0 ELSE d * 12 / 1e2 END AS confidence
FROM {{wall_base}} WHERE pk % 3 = 0""",
    "dimensions": f"""
SELECT project_id, seq, {LEVEL.format("ln")} AS level, CASE pk % 6 WHEN 0 THEN CAST(q * 25 AS STRING) || 'cm' WHEN 1 THEN CAST(q AS STRING) || ',' || CAST(10 + d AS STRING)
    WHEN 2 THEN 'L=' || CAST(q AS STRING) || '.50' WHEN 3 THEN '+' || CAST(q AS STRING) || '.20' WHEN 4 THEN CAST(q * 11 AS STRING) ELSE 'SALA ' || CAST(q AS STRING) END AS text,
  q * 26 / 1e2 AS value_m, CAST(pk * 7 % 1000 + d AS DOUBLE) AS x, CAST(ok * 13 % 1000 + q AS DOUBLE) AS y,
  CASE WHEN pk % 5 = 0 THEN 'unknown' WHEN pk % 41 = 0 THEN 'diagonal' WHEN ln % 2 = 0 THEN 'horizontal' ELSE 'vertical' END AS orientation, (50 + 5 * d) / 1e2 AS confidence
FROM {{wall_base}} WHERE pk % 4 = 0""",
    "area_pages": f"""
SELECT project_id, k % 3 AS file_seq, CAST(row_number() OVER (PARTITION BY project_id, k % 3 ORDER BY seq) - 1 AS INT) AS page_index, {LEVEL.format("k")} AS level,
  cents % 40000 / 1e2 AS ext_gross, cents % 4000 / 1e2 AS ext_open, cents % 40000 / 1e2 - cents % 4000 / 1e2 AS ext_net, cents % 30000 / 1e2 AS int_gross, cents % 3000 / 1e2 AS int_open,
  cents % 30000 / 1e2 - cents % 3000 / 1e2 AS int_net, CASE WHEN k % 4 = 0 THEN cents % 9000 / 1e2 ELSE 0e0 END AS boundary_gross, CASE WHEN k % 3 = 0 THEN 0e0 ELSE 2e0 END AS boundary_height,
  cents % 15000 / 1e2 AS floor_m2, CASE WHEN k % 2 = 0 THEN cents % 14000 / 1e2 ELSE 0e0 END AS roof_m2, (50 + k % 50) / 1e2 AS confidence, CASE WHEN k % 6 = 0 THEN (200 + k % 200) / 1e2 END AS section_height
FROM {{slab_base}} WHERE pr = 2""",
    "pipeline_events": """
SELECT event_id AS id, user_id AS project_id, CASE event_type WHEN 'signup' THEN 'stage' WHEN 'error' THEN 'ai_call' WHEN 'view' THEN 'audit' WHEN 'click' THEN 'page_split' ELSE 'cv_substep' END AS kind,
  'stage' || CAST(event_id % 6 AS STRING) AS stage, CASE event_id % 3 WHEN 0 THEN 'started' WHEN 1 THEN 'completed' ELSE 'failed' END AS phase, CAST(floor(event_id / 2e0) AS BIGINT) AS call_id,
  CASE event_id % 4 WHEN 0 THEN 'info' WHEN 1 THEN 'warning' WHEN 2 THEN 'error' ELSE 'info' END AS severity, CASE event_id % 5 WHEN 0 THEN 'openai:gpt-4o-mini' WHEN 1 THEN 'gemini-2.5-pro'
    WHEN 2 THEN 'gpt-4o-2024-08-06' WHEN 3 THEN 'unknown-x' ELSE 'gemini-2.5-flash-lite' END AS model,
  CAST(round(value * 100) AS BIGINT) AS in_tokens, CAST(round(value * 100) AS BIGINT) % 700 AS out_tokens, CASE WHEN event_id % 2 = 0 THEN CAST(round(value * 100) AS BIGINT) % 900 END AS think_tokens,
  CAST(round(value * 1000) AS BIGINT) % 5000 AS duration_ms, CAST(ts AS TIMESTAMP) AS created_at FROM {events}""",
    "ai_runs": """
SELECT id, project_id, call_id, 'p' || CAST(id % 3 AS STRING) AS prompt_version, model, in_tokens, out_tokens, think_tokens, duration_ms,
  CASE id % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'rate_limited' WHEN 2 THEN 'retried' WHEN 3 THEN 'json_retry' ELSE 'ok' END AS status, created_at FROM {pipeline_events} WHERE kind = 'ai_call'""",
}

#: Rows that a task should get when a table is dealt; more partitions are used for larger tables (a project is not split).
TASK_ROWS = 250_000


@cache
def adapters_of(sql: str) -> tuple[str, ...]:
    """Adapters that the SQL names, with those that they need, in order of definition."""
    found: set[str] = set()

    def visit(text: str) -> None:
        for name in re.findall(r"\{(\w+)\}", text):
            if name in ADAPTERS and name not in found:
                found.add(name)
                visit(ADAPTERS[name])

    visit(sql)
    return tuple(n for n in ADAPTERS if n in found)


def oracle(sql: str) -> str:
    """SQL with {adapter} names as a statement that DuckDB runs over the given tables."""
    parts = [f"{n} AS MATERIALIZED ({re.sub(r'[{](\w+)[}]', r'\1', ADAPTERS[n]).replace('AS STRING)', 'AS VARCHAR)')})" for n in adapters_of(sql)]
    body = re.sub(r"\{(\w+)\}", r"\1", sql).strip()  # braces of SQL structs hold more than a name
    if not parts:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + body[len("WITH RECURSIVE") :]
    return "WITH " + ", ".join(parts) + (", " + body[4:] if body.upper().startswith("WITH ") else " " + body)


class Tables:
    """Domain tables over one folder of the given tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.kept: dict[str, DataFrame] = {}

    def dealt_by(self, rows: DataFrame, key: str) -> DataFrame:
        """rows dealt by key. The session's shuffle partitions are raised with the input, so that what a task sorts and holds doesn't grow with it. Above the rows of one task the
        number is fixed: adaptive execution goes by compressed bytes and would put millions of narrow rows into one task again."""
        setting = "spark.sql.shuffle.partitions"
        n = rows.count()  # from the files' footers
        if n <= TASK_ROWS:
            return rows.repartition(key)
        parts = max(int(self.spark.conf.get(setting)), -(-n // TASK_ROWS))
        self.spark.conf.set(setting, str(parts))
        return rows.repartition(parts, key)

    def keep(self, name: str) -> None:
        """Computes a table once for all that read it; it lies in buckets by project from then on."""
        self.kept[name] = dealt(name, self(name))

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __call__(self, name: str) -> DataFrame:
        if name in self.kept:
            return self.kept[name]
        if name not in ADAPTERS:
            return self.raw(name)
        sql = ADAPTERS[name]
        sources = {n: self(n) for n in dict.fromkeys(re.findall(r"\{(\w+)\}", sql))}
        if name == "wall_base":
            # dealt before the SQL names the project, so that its rows count as dealt by project as well as by supplier
            sources["lineitem"] = self.dealt_by(sources["lineitem"], "l_suppkey")
        return self.spark.sql(sql, **sources)

    def stream(self, name: str) -> DataFrame:
        """An adapter of one given table, over a stream of that table's files."""
        (source,) = re.findall(r"\{(\w+)\}", ADAPTERS[name])
        raw = self.raw(source)
        # a pattern, since a stream takes a plain path for a folder and the table may be one file
        return self.spark.sql(ADAPTERS[name], **{source: self.spark.readStream.schema(raw.schema).parquet(f"{self.sf_dir}/{source}.parque[t]")})

    def walls(self) -> DataFrame:
        """walls with bbox and openings as nested columns."""
        opening = lambda kind, code, w, h, sill: F.when(
            F.col(code).isNotNull(),
            F.struct(F.lit(kind).alias("kind"), F.col(code).alias("code"), F.col(w).alias("width_m"), F.col(h).alias("height_m"), sill.alias("sill_m"), F.col("source").alias("source")),
        )
        both = F.array(opening("door", "door_code", "door_w", "door_h", F.lit(None).cast("double")), opening("window", "win_code", "win_w", "win_h", F.col("win_sill")))
        box = F.when(F.col("xmin").isNotNull(), F.struct("ymin", "xmin", "ymax", "xmax"))
        drop = ["ymin", "xmin", "ymax", "xmax", "door_code", "door_w", "door_h", "win_code", "win_w", "win_h", "win_sill"]
        return self("walls").withColumns({"openings": F.filter(both, lambda o: o.isNotNull()), "bbox": box}).drop(*drop)

    def envelopes(self) -> DataFrame:
        """Envelopes as L-shaped polygons, lots as rectangles over the page."""
        point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
        x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
        mid_x, mid_y = F.lit(500.0), F.lit(520.0)
        shape = F.array(point(x0, y0), point(x1, y0), point(x1, mid_y), point(mid_x, mid_y), point(mid_x, y1), point(x0, y1))
        lot = F.array(*(point(F.lit(x), F.lit(y)) for x, y in ((0, 0), (1000, 0), (1000, 700), (0, 700))))
        return self("envelopes").select("project_id", "level", "page_index", shape.alias("polygon"), F.when(F.col("has_lot"), lot).alias("lot_polygon"), "confidence")
