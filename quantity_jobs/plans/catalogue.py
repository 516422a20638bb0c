"""Registered queries over the given tables, each with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .testdata import Tables, oracle

#: Generated methods above so many bytes are never compiled by the JVM; Spark then runs a stage operator by operator instead of interpreting it.
JIT_LIMIT = "8000"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of Tables under its name, with SQL in which {name} is a table or an adapter."""

    def register(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.codegen.hugeMethodLimit", JIT_LIMIT)
            return f(Tables(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return register


def greedy_sql(choices: str, shared: bool = False) -> str:
    """SQL of a greedy choice: of `choices` (g, l, cs), each l of a group in order takes the first of its candidates cs that is unused; with `shared`, a candidate that
    was taken takes none itself. Gives greedy (g, l, pick)."""
    mine = "CASE WHEN NOT list_contains(r.used, o.l) THEN list_filter(o.cs, lambda x: NOT list_contains(r.used, x))[1] END" if shared else "list_filter(o.cs, lambda x: NOT list_contains(r.used, x))[1]"
    taken = "[o.l, o.cs[1]]" if shared else "[o.cs[1]]"
    added = "list_concat(used, [l, pick])" if shared else "list_append(used, pick)"
    return f"""o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY l) AS rn FROM ({choices})),
r AS (SELECT g, rn, l, o.cs[1] AS pick, {taken} AS used FROM o WHERE rn = 1
  UNION ALL SELECT g, rn, l, pick, CASE WHEN pick IS NULL THEN used ELSE {added} END FROM (SELECT o.g, o.rn, o.l, {mine} AS pick, r.used FROM r JOIN o ON o.g = r.g AND o.rn = r.rn + 1)),
greedy AS (SELECT g, l, pick FROM r WHERE pick IS NOT NULL)"""


# SQL that several queries share.
FIXED = """f AS (SELECT *, CASE WHEN length_m > 50 THEN length_m / 1e2 ELSE length_m END AS l1, CASE WHEN height_m > 10 THEN height_m / 1e2 ELSE height_m END AS h1,
  source || CASE WHEN length_m > 50 THEN '_cm_corrected' ELSE '' END AS s1 FROM {walls})"""
DEFAULTED = (
    FIXED
    + """, z AS (SELECT *, CASE WHEN door_w > 0 THEN door_w ELSE 8e-1 END AS dw, CASE WHEN door_h > 0 THEN door_h ELSE 21e-1 END AS dh, CASE WHEN win_w > 0 THEN win_w ELSE 12e-1 END AS ww,
  CASE WHEN win_h > 0 THEN win_h ELSE 1e0 END AS wh, CASE WHEN h1 > 0 THEN h1 ELSE 3e0 END AS h2, CASE WHEN l1 > 0 THEN l1 ELSE 0e0 END AS l2 FROM f),
w AS (SELECT project_id, seq, page_index, wall_id, level, wall_class, l2 AS length_m, h2 AS height_m, thickness_m, s1 AS source, confidence, has_door, has_window, door_code, win_code, dw, dh, ww, wh, ymin, xmin, ymax, xmax,
  CASE WHEN h1 > 0 THEN CASE WHEN s1 = 'table' THEN 'table' ELSE 'ai' END ELSE 'default' END AS height_source,
  (CASE WHEN door_code IS NOT NULL THEN dw * dh ELSE 0e0 END) + (CASE WHEN win_code IS NOT NULL THEN ww * wh ELSE 0e0 END) AS opening_area_m2 FROM z)"""
)
VALID = (
    DEFAULTED
    + """, v AS (SELECT * REPLACE (CASE WHEN height_m < 1.5 OR height_m > 6 THEN 3e0 ELSE height_m END AS height_m) FROM w
  WHERE length_m > 0 AND thickness_m >= 6e-2 AND thickness_m <= 4e-1 AND length_m >= 3e-1 AND length_m <= 50),
vs AS (SELECT * FROM {slabs} WHERE area_m2 > 0 AND area_m2 >= 1 AND area_m2 <= 5000)"""
)
PANELS = (
    VALID
    + """, wp AS (SELECT *, length_m * height_m AS g, greatest(0e0, length_m * height_m - opening_area_m2) AS nt,
  CASE WHEN length_m * height_m > 0 AND opening_area_m2 / (length_m * height_m) > 2e-1 THEN 8e-2 ELSE 5e-2 END AS loss FROM v),
pn AS (SELECT *, floor(g * 1e2 + 5e-1) / 1e2 AS gross_m2, floor(nt * 1e2 + 5e-1) / 1e2 AS net_m2, CAST(ceil(nt / 183e-2 * (1e0 + loss)) AS BIGINT) AS panels FROM wp),
sp AS (SELECT *, CASE WHEN slab_class = 'raft' THEN 0 ELSE CAST(ceil(area_m2 / 183e-2 * (1e0 + 1e-1)) AS BIGINT) END AS panels FROM vs)"""
)
LEVELS = (
    PANELS
    + """, un AS (SELECT project_id, level, wall_class AS category, length_m, gross_m2, net_m2, panels FROM pn
  UNION ALL SELECT project_id, level, slab_class, 0e0, area_m2, area_m2, panels FROM sp
  UNION ALL SELECT project_id, level, 'corners', 0e0, 0e0, 0e0, corner_count FROM {corners}),
bl AS (SELECT project_id, level, category, floor(sum(length_m) * 1e2 + 5e-1) / 1e2 AS length_m, floor(sum(gross_m2) * 1e2 + 5e-1) / 1e2 AS gross_m2,
  floor(sum(net_m2) * 1e2 + 5e-1) / 1e2 AS net_m2, CAST(sum(panels) AS BIGINT) AS panels, count(*) AS n FROM un
  WHERE (project_id, level) IN (SELECT project_id, level FROM v UNION SELECT project_id, level FROM vs) GROUP BY 1, 2, 3)"""
)
SUMMARY = (
    LEVELS
    + """, sm AS (SELECT project_id, coalesce(category, 'total') AS category, CAST(sum(panels) AS BIGINT) AS panels, floor(sum(length_m) * 1e2 + 5e-1) / 1e2 AS length_m
  FROM bl WHERE category IN ('external', 'internal', 'boundary', 'floor', 'roof') GROUP BY GROUPING SETS ((project_id, category), (project_id)))"""
)


def load() -> None:
    """Imports the modules that register queries."""
    from . import queries_budget, queries_clean, queries_fuse, queries_match, queries_score  # noqa: F401
