"""Budget queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions.exprs import round_half_up as half_up
from ..operators import areas, budget, clean, fuse
from . import pipelines
from .catalogue import LEVELS, PANELS, SUMMARY, VALID, query


def _elements(t):
    return pipelines.measured_elements(t.walls(), t("slabs"))


def _levels(t):
    return pipelines.level_budget(t.walls(), t("slabs"), t("corners"))


def _catalogue(t):
    return budget.apply_profile_prices(t("products"), t("profile_prices"), t("price_profiles"))


@query("WITH " + PANELS + " SELECT project_id, seq, wall_class, gross_m2, net_m2, loss, panels FROM pn")
def wall_panels(t):
    return budget.wall_panels(_elements(t)[0]).select("project_id", "seq", "wall_class", "gross_m2", "net_m2", "loss", "panels")


@query("WITH " + PANELS + " SELECT project_id, seq, slab_class, panels FROM sp")
def slab_panels(t):
    return budget.slab_panels(_elements(t)[1]).select("project_id", "seq", "slab_class", "panels")


@query("WITH " + LEVELS + " SELECT project_id, level, category, length_m, gross_m2, net_m2, panels, n FROM bl")
def budget_by_level(t):
    return _levels(t).drop("reviews")


@query("WITH " + SUMMARY + " SELECT project_id, category, panels, length_m FROM sm")
def budget_summary(t):
    return budget.budget_summary(_levels(t))


@query(
    "WITH "
    + VALID
    + """, b AS (SELECT project_id, level, wall_class, source, floor(sum(length_m) * 1e6 + 5e-1) / 1e6 AS w, min(seq) AS fs FROM v GROUP BY 1, 2, 3, 4),
r AS (SELECT *, row_number() OVER (PARTITION BY project_id, level, wall_class ORDER BY w DESC, fs) AS rn FROM b)
SELECT project_id, level, wall_class, source AS dominant_source FROM r WHERE rn = 1"""
)
def dominant_source(t):
    return budget.dominant_source(_elements(t)[0], ["project_id", "level", "wall_class"], "length_m")


@query(
    "WITH "
    + LEVELS
    + """, q AS (SELECT project_id, floor(sum(CASE WHEN category = 'external' THEN gross_m2 ELSE 0e0 END) * 1e2 + 5e-1) / 1e2 AS ext_gross,
  floor(sum(CASE WHEN category = 'external' THEN net_m2 ELSE 0e0 END) * 1e2 + 5e-1) / 1e2 AS ext_net, floor(sum(CASE WHEN category = 'floor' THEN net_m2 ELSE 0e0 END) * 1e2 + 5e-1) / 1e2 AS floor_area,
  CAST(sum(CASE WHEN category IN ('raft', 'corners') THEN 0 ELSE panels END) AS BIGINT) AS total_panels FROM bl GROUP BY project_id),
k AS (SELECT *, CASE WHEN ext_gross > 0 THEN floor((ext_gross - ext_net) / ext_gross * 1e6 + 5e-1) / 1e6 ELSE 0e0 END AS ext_ratio FROM q)
SELECT project_id, ext_gross, ext_net, ext_ratio, floor_area, total_panels, CASE WHEN ext_ratio > 2e-1 THEN 8e-2 ELSE 5e-2 END AS ext_loss,
  floor(ext_net * (1e0 + CASE WHEN ext_ratio > 2e-1 THEN 8e-2 ELSE 5e-2 END) * 1e4 + 5e-1) / 1e4 AS ext_with_loss FROM k"""
)
def quantities(t):
    return budget.quantities(_levels(t)).select("project_id", "ext_gross", "ext_net", "ext_ratio", "floor_area", "total_panels", "ext_loss", "ext_with_loss")


@query(
    """SELECT p.profile_id, pr.sku, CAST(coalesce(pp.unit_price, pr.unit_price) AS DOUBLE) AS unit_price FROM {products} pr CROSS JOIN (SELECT profile_id FROM {price_profiles} UNION ALL SELECT NULL) p
LEFT JOIN {profile_prices} pp ON pp.profile_id = p.profile_id AND pp.sku = pr.sku"""
)
def apply_profile_prices(t):
    return _catalogue(t).select("profile_id", "sku", "unit_price")


@query(
    """SELECT p.project_id, coalesce(a.profile_id, b.profile_id, (SELECT min(profile_id) FROM {price_profiles} WHERE active AND is_default)) AS resolved_profile FROM {projects} p
LEFT JOIN {users} u ON p.user_id = u.user_id LEFT JOIN {price_profiles} a ON a.active AND a.profile_id = p.profile_id LEFT JOIN {price_profiles} b ON b.active AND b.profile_id = u.default_profile_id"""
)
def resolve_profile(t):
    return budget.resolve_profile(t("projects"), t("users"), t("price_profiles"))


PROPOSAL = (
    SUMMARY
    + """, cat AS (SELECT p.profile_id, pr.sku, pr.name, coalesce(pp.unit_price, pr.unit_price) AS price FROM {products} pr CROSS JOIN (SELECT profile_id FROM {price_profiles} UNION ALL SELECT NULL) p
  LEFT JOIN {profile_prices} pp ON pp.profile_id = p.profile_id AND pp.sku = pr.sku WHERE pr.sku IN ('LW-2P-090', 'LW-SP-090', 'PROJ-PAG')),
ln AS (SELECT * FROM (VALUES ('external', 1, 'LW-2P-090', 275e0), ('internal', 2, 'LW-SP-090', 180e0), ('boundary', 3, 'LW-SP-090', 180e0), ('floor', 4, 'LW-2P-090', 275e0), ('roof', 5, 'LW-2P-090', 275e0)) x(line, place, dsku, dprice)),
pl AS (SELECT s.project_id, line, place, coalesce(c.sku, dsku) AS sku, c.name, coalesce(sm.panels, 0) AS panels, coalesce(c.price, dprice) AS price_m2, coalesce(pg.price, 11e0) AS pag FROM
  (SELECT DISTINCT project_id FROM sm) s CROSS JOIN ln LEFT JOIN sm ON sm.project_id = s.project_id AND sm.category = line LEFT JOIN {projects} p ON p.project_id = s.project_id
  LEFT JOIN cat c ON c.profile_id IS NOT DISTINCT FROM p.profile_id AND c.sku = dsku LEFT JOIN cat pg ON pg.profile_id IS NOT DISTINCT FROM p.profile_id AND pg.sku = 'PROJ-PAG'),
pa AS (SELECT *, floor(panels * 183e-2 * 1e3 + 5e-1) / 1e3 AS area_m2 FROM pl),
pc AS (SELECT *, floor(area_m2 * price_m2 * 1e2 + 5e-1) / 1e2 AS cost FROM pa),
pt AS (SELECT project_id, CAST(sum(panels) AS BIGINT) AS panels, floor(sum(area_m2) * 1e3 + 5e-1) / 1e3 AS area_m2, floor(sum(cost) * 1e2 + 5e-1) / 1e2 AS pc, any_value(pag) AS pag FROM pc GROUP BY 1),
pz AS (SELECT *, floor(area_m2 * pag * 1e2 + 5e-1) / 1e2 AS pagc FROM pt),
pr AS (SELECT project_id, line, place, sku, name, panels, area_m2, price_m2, cost FROM pc WHERE line <> 'boundary' OR panels > 0
  UNION ALL SELECT project_id, 'pagination', 6, 'PROJ-PAG', NULL, panels, area_m2, pag, pagc FROM pz
  UNION ALL SELECT project_id, 'total', 7, NULL, NULL, panels, area_m2, NULL, floor((pc + pagc) * 1e2 + 5e-1) / 1e2 FROM pz)"""
)


def _proposal(t):
    return pipelines.priced_proposal(t.walls(), t("slabs"), t("corners"), t("projects"), _catalogue(t))


@query("WITH " + PROPOSAL + " SELECT project_id, line, place, sku, panels, area_m2, price_m2, cost FROM pr")
def proposal_lines(t):
    return _proposal(t).drop("name")


@query(
    "WITH "
    + PROPOSAL
    + """ SELECT project_id, coalesce(name, sku) AS product, floor(sum(area_m2) * 1e3 + 5e-1) / 1e3 AS area_m2, CAST(floor(floor(sum(area_m2) * 1e3 + 5e-1) / 1e3 / 183e-2 + 5e-1) AS BIGINT) AS units,
  floor(sum(cost) * 1e2 + 5e-1) / 1e2 AS cost FROM pr WHERE line NOT IN ('pagination', 'total') GROUP BY 1, 2"""
)
def totals_by_sku(t):
    return budget.totals_by_sku(_proposal(t))


@query(
    "WITH "
    + LEVELS
    + """, q AS (SELECT project_id, CAST(sum(CASE WHEN category IN ('raft', 'corners') THEN 0 ELSE panels END) AS DOUBLE) AS n,
  floor(sum(CASE WHEN category IN ('external', 'internal') THEN net_m2 ELSE 0e0 END) * 1e2 + 5e-1) / 1e2 + floor(sum(CASE WHEN category IN ('floor', 'roof') THEN net_m2 ELSE 0e0 END) * 1e2 + 5e-1) / 1e2 AS area FROM bl GROUP BY 1),
pc AS (SELECT coalesce(max(unit_price) FILTER (product_id = 13), 125e-1) AS c, coalesce(max(unit_price) FILTER (sku = 'PARA-001'), 28e-1) AS s FROM {products})
SELECT project_id, 'connectors' AS item, n * 4 AS quantity, 'un' AS unit, floor(n * 4 * c * 1e2 + 5e-1) / 1e2 AS cost FROM q, pc UNION ALL
SELECT project_id, 'screws', n * 8, 'un', floor(n * 8 * s * 1e2 + 5e-1) / 1e2 FROM q, pc UNION ALL SELECT project_id, 'tape', n * 2, 'm', 0e0 FROM q UNION ALL
SELECT project_id, 'filler', n * 5e-1, 'kg', 0e0 FROM q UNION ALL SELECT project_id, 'labor', floor(area * 8e-1 * 1e2 + 5e-1) / 1e2, 'h', floor(area * 8e-1 * 65e0 * 1e2 + 5e-1) / 1e2 FROM q"""
)
def materials_labor(t):
    # one of the two skus is in the catalogue
    products = t("products").withColumn("sku", F.when(F.col("product_id") == 13, dims.SKU_CONNECTOR).otherwise(F.col("sku")))
    return budget.materials_labor(budget.quantities(_levels(t)), products)


COSTS = PROPOSAL + """, fc AS (SELECT z.project_id, z.pc AS panel_cost, z.pagc, p.discount_pct AS d, p.freight AS f, p.biomass AS b FROM pz z JOIN {projects} p ON p.project_id = z.project_id)"""


@query(
    "WITH "
    + COSTS
    + """ SELECT project_id, floor((panel_cost * (1e0 - least(25e0, greatest(0e0, d)) / 1e2) + pagc + greatest(0e0, f) + greatest(0e0, b)) * 1e2 + 5e-1) / 1e2 AS server_cost,
  CASE WHEN panel_cost > 0 THEN floor(greatest(0e0, panel_cost * (1e0 - d / 1e2) + f + b) * 1e2 + 5e-1) / 1e2 END AS client_cost FROM fc"""
)
def final_cost(t):
    lines = _proposal(t)
    costs = lines.groupBy("project_id").agg(
        half_up(F.sum(F.when(~F.col("line").isin("pagination", "total"), F.col("cost")).otherwise(0.0))).alias("panel_cost"), F.sum(F.when(F.col("line") == "pagination", F.col("cost"))).alias("pagination_cost")
    )
    return budget.final_cost(costs, t("projects"))


OFFSETS = """fl AS (SELECT project_id, file_seq, max(page_index) + 1 + (project_id + file_seq) % 3 AS n FROM {area_pages} GROUP BY 1, 2),
of AS (SELECT project_id, file_seq, coalesce(sum(n) OVER (PARTITION BY project_id ORDER BY file_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM fl),
pg AS (SELECT a.*, CAST(a.page_index + of.o AS BIGINT) AS page FROM {area_pages} a JOIN of ON a.project_id = of.project_id AND a.file_seq = of.file_seq)"""


def _pages(t):
    """Pages numbered through; some files end with pages that gave nothing."""
    files = t("area_pages").groupBy("project_id", "file_seq").agg((F.max("page_index") + 1 + F.max((F.col("project_id") + F.col("file_seq")) % 3)).alias("page_count"))
    return areas.consolidate_files(t("area_pages"), files)[0]


@query("WITH " + OFFSETS + " SELECT project_id, file_seq, page_index, page FROM pg")
def consolidate_files(t):
    return _pages(t).select("project_id", "file_seq", "page_index", "page")


@query(
    """SELECT project_id, floor(sum(ext_gross) * 1e2 + 5e-1) / 1e2 AS ext_gross, floor(sum(roof_m2) * 1e2 + 5e-1) / 1e2 AS roof_m2, count(DISTINCT file_seq) AS files,
  arg_min(section_height, file_seq * 1000000 + page_index) FILTER (section_height > 0) AS section_height FROM {area_pages} GROUP BY 1"""
)
def consolidated_totals(t):
    return areas.consolidate_files(t("area_pages"))[1].select("project_id", "ext_gross", "roof_m2", "files", "section_height")


@query("WITH " + OFFSETS + " SELECT project_id, level, page FROM (SELECT *, row_number() OVER (PARTITION BY project_id, level ORDER BY page) AS rn FROM pg) WHERE rn = 1")
def first_page_per_level(t):
    return areas.first_page_per_level(_pages(t)).select("project_id", "level", "page")


@query(
    "WITH "
    + OFFSETS
    + """, x AS (SELECT project_id, level, 'external' AS category, ext_net AS a, 275e0 AS p FROM pg UNION ALL SELECT project_id, level, 'internal', int_net, 180e0 FROM pg UNION ALL
  SELECT project_id, level, 'boundary', boundary_gross, 180e0 FROM pg UNION ALL SELECT project_id, level, 'floor', floor_m2, 275e0 FROM pg UNION ALL SELECT project_id, level, 'roof', roof_m2, 275e0 FROM pg)
SELECT project_id, level, category, floor(sum(a) * 1e2 + 5e-1) / 1e2 AS area_m2, floor(floor(sum(a) * 1e2 + 5e-1) / 1e2 * any_value(p) * 1e2 + 5e-1) / 1e2 AS cost FROM x WHERE a > 0
GROUP BY GROUPING SETS ((project_id, level, category), (project_id, category))"""
)
def area_budget(t):
    return areas.area_budget(_pages(t), dims.PRICE_2P, dims.PRICE_SP)


@query(
    """WITH x AS (SELECT project_id, level, 'walls' AS part, ext_net + int_net + boundary_gross AS a FROM {area_pages} UNION ALL SELECT project_id, level, 'slabs', floor_m2 + roof_m2 FROM {area_pages})
SELECT project_id, level, part, floor(sum(a) * 1e2 + 5e-1) / 1e2 AS area_m2 FROM x GROUP BY GROUPING SETS ((project_id, level, part), (project_id, level), (project_id, part), (project_id))"""
)
def area_report(t):
    return areas.area_report(t("area_pages"))


def _scope(t):
    p = F.col("project_id")
    return t("projects").filter(p % 5 != 4).select("project_id", (p % 2 == 0).alias("ext"), (p % 3 != 0).alias("int"), F.lit(True).alias("boundary"), (p % 4 != 1).alias("floor"), (p % 5 != 2).alias("roof"), (p % 2 == 1).alias("corners"))


SCOPE = "sc AS (SELECT project_id, project_id % 2 = 0 AS ext, project_id % 3 <> 0 AS int_, true AS boundary, project_id % 4 <> 1 AS fl, project_id % 5 <> 2 AS roof, project_id % 2 = 1 AS corners FROM {projects} WHERE project_id % 5 <> 4)"


@query(
    "WITH "
    + SCOPE
    + """ SELECT a.project_id, seq, coalesce(CASE wall_class WHEN 'external' THEN ext WHEN 'internal' THEN int_ ELSE boundary END, true) AS enabled FROM {walls} a LEFT JOIN sc ON a.project_id = sc.project_id"""
)
def apply_scope(t):
    category = F.when(F.col("wall_class") == "external", "ext").when(F.col("wall_class") == "internal", "int").otherwise("boundary")
    return clean.apply_scope(t("walls"), _scope(t), category).select("project_id", "seq", "enabled")


@query(
    "WITH "
    + SCOPE
    + """ SELECT a.project_id, file_seq, page_index, CASE WHEN coalesce(ext, true) THEN ext_gross ELSE 0e0 END AS ext_gross, CASE WHEN coalesce(int_, true) THEN int_net ELSE 0e0 END AS int_net,
  CASE WHEN coalesce(roof, true) THEN roof_m2 ELSE 0e0 END AS roof_m2 FROM {area_pages} a LEFT JOIN sc ON a.project_id = sc.project_id"""
)
def scope_zero(t):
    return clean.scope_zero(t("area_pages"), _scope(t).drop("corners")).select("project_id", "file_seq", "page_index", "ext_gross", "int_net", "roof_m2")


@query(
    "WITH "
    + OFFSETS
    + """, e AS (SELECT project_id, page, CASE WHEN page % 3 = 0 THEN NULL ELSE (page * 10 - 15) / 1e0 END AS ext_gross FROM pg WHERE page % 4 < 2),
n AS (SELECT pg.project_id, CASE WHEN e.ext_gross IS NOT NULL THEN greatest(0e0, e.ext_gross) ELSE pg.ext_gross END AS x, roof_m2 FROM pg LEFT JOIN e ON pg.project_id = e.project_id AND pg.page = e.page)
SELECT project_id, floor(sum(x) * 1e2 + 5e-1) / 1e2 AS ext_gross, floor(sum(roof_m2) * 1e2 + 5e-1) / 1e2 AS roof_m2 FROM n GROUP BY 1"""
)
def apply_page_edits(t):
    pages = _pages(t)
    edits = pages.filter("page % 4 < 2").select("project_id", "page", F.when(F.col("page") % 3 != 0, (F.col("page") * 10 - 15) / F.lit(1.0)).alias("ext_gross"))
    return areas.apply_page_edits(pages, edits)[1].select("project_id", "ext_gross", "roof_m2")


@query(
    """WITH pg AS (SELECT * REPLACE (CASE WHEN page_index % 4 = 1 THEN '' ELSE level END AS level, CASE WHEN seq_ % 5 = 0 THEN 0e0 ELSE ext_gross END AS ext_gross, CASE WHEN seq_ % 5 = 0 THEN 0e0 ELSE int_gross END AS int_gross) FROM (SELECT *, project_id AS seq_ FROM {area_pages})),
o AS (SELECT *, CASE WHEN level = '' THEN 'Pavimento ' || CAST(page_index AS VARCHAR) ELSE level END AS lv, file_seq * 100000 + page_index AS k FROM pg),
h AS (SELECT project_id, coalesce(arg_min(section_height, k) FILTER (section_height > 0), 3e0) AS h FROM o GROUP BY 1),
s AS (SELECT project_id, lv AS level, floor(sum(ext_gross) * 1e6 + 5e-1) / 1e6 AS eg, floor(sum(ext_net) * 1e6 + 5e-1) / 1e6 AS en, floor(sum(ext_open) * 1e6 + 5e-1) / 1e6 AS eo, floor(sum(int_gross) * 1e6 + 5e-1) / 1e6 AS ig, floor(sum(int_net) * 1e6 + 5e-1) / 1e6 AS i_n, floor(sum(int_open) * 1e6 + 5e-1) / 1e6 AS io, floor(sum(boundary_gross) * 1e6 + 5e-1) / 1e6 AS bg, arg_min(boundary_height, k) AS bh FROM o GROUP BY 1, 2),
x AS (SELECT s.project_id, level, 'external' AS wall_class, CASE WHEN eg > 0 THEN eg ELSE en END AS g, eo AS op, h FROM s JOIN h ON s.project_id = h.project_id UNION ALL SELECT s.project_id, level, 'internal', CASE WHEN ig > 0 THEN ig ELSE i_n END, io, h FROM s JOIN h ON s.project_id = h.project_id
  UNION ALL SELECT project_id, level, 'boundary', bg, 0e0, bh FROM s)
SELECT project_id, level, wall_class, floor(g * 1e2 + 5e-1) / 1e2 AS gross_m2, CASE WHEN h > 0 THEN floor(g / h * 1e2 + 5e-1) / 1e2 ELSE 0e0 END AS length_m, floor(h * 1e2 + 5e-1) / 1e2 AS height_m, floor(op * 1e2 + 5e-1) / 1e2 AS opening_area_m2 FROM x WHERE g > 0"""
)
def synthetic_elements(t):
    bare = F.col("project_id") % 5 == 0
    pages = t("area_pages").withColumn("level", F.when(F.col("page_index") % 4 == 1, "").otherwise(F.col("level"))).withColumns({c: F.when(bare, 0.0).otherwise(F.col(c)) for c in ("ext_gross", "int_gross")})
    walls, _ = clean.synthetic_elements(pages)
    return walls.select("project_id", "level", "wall_class", half_up("gross_m2").alias("gross_m2"), "length_m", "height_m", "opening_area_m2")


@query("SELECT project_id, level, 'C' || CAST(row_number() OVER (PARTITION BY project_id ORDER BY seq) AS VARCHAR) AS corner_id FROM {corners}")
def renumber(t):
    return fuse.renumber(t("corners"), "C", "corner_id").select("project_id", "level", "corner_id")
