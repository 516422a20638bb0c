"""Audit, scoring, telemetry and listing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import round_half_up as half_up
from ..operators import audit, budget, clean, score, telemetry
from ..sources import io
from ..streaming import streams
from . import pipelines
from .catalogue import DEFAULTED, LEVELS, query
from .queries_budget import PROPOSAL, _levels, _proposal
from .queries_clean import ASSUMED, RANGED, _characterizations

EVENTS = "pipeline_events"


def _audited(t):
    walls = clean.wall_defaults(clean.fix_units(t.walls())).withColumn("primary_view", F.when(F.col("seq") % 97 == 0, "section").otherwise("plan"))
    return audit.self_check(walls, t("slabs"), t.envelopes(), clean.clean_ranges(_characterizations(t)), t("projects"))


CHECKED = (
    DEFAULTED
    + ", rg AS (SELECT project_id, building_type AS bt, "
    + RANGED
    + """ FROM {projects}),
j AS (SELECT w.*, rg.*, length_m * height_m AS ar, opening_area_m2 AS op FROM w JOIN rg ON rg.project_id = w.project_id),
g AS (SELECT rg.project_id, bt, walls_low, walls_high, openings_low, count(*) FILTER (wall_class = 'external') AS ext, count(*) FILTER (wall_class = 'internal') AS int_, count(*) AS n, count(*) FILTER (has_door) + count(*) FILTER (has_window) AS opens,
  count(*) FILTER (seq % 97 = 0) AS orphans FROM rg JOIN w ON w.project_id = rg.project_id GROUP BY ALL),
fs AS (SELECT project_id, lower(level) AS level, floor(sum(CASE WHEN slab_class <> 'roof' THEN area_m2 ELSE 0e0 END) * 1e6 + 5e-1) / 1e6 AS fl, floor(sum(CASE WHEN slab_class = 'roof' THEN area_m2 ELSE 0e0 END) * 1e6 + 5e-1) / 1e6 AS rf FROM {slabs} GROUP BY 1, 2),
nt AS (SELECT project_id, 'error' AS severity, 'OPENING_OVER_WALL' AS code, wall_id AS element_id FROM j WHERE ar > 0 AND op > ar UNION ALL SELECT project_id, 'warning', 'OPENING_NEAR_WALL_LIMIT', wall_id FROM j WHERE ar > 0 AND op <= ar AND op > ar * 85e-2
  UNION ALL SELECT project_id, 'warning', 'CEILING_LOW', wall_id FROM j WHERE height_m <> 0 AND height_m < greatest(18e-1, ceiling_low * 8e-1)
  UNION ALL SELECT project_id, 'warning', 'CEILING_HIGH', wall_id FROM j WHERE height_m >= greatest(18e-1, ceiling_low * 8e-1) AND height_m > ceiling_high * 12e-1 UNION ALL SELECT project_id, 'warning', 'WALL_THIN', wall_id FROM j WHERE thickness_m < 5e-2
  UNION ALL SELECT project_id, 'info', 'WALL_THICK', wall_id FROM j WHERE thickness_m >= 5e-2 AND thickness_m > thickness_high * 13e-1
  UNION ALL SELECT project_id, 'error', 'ORPHAN_FROM_NON_PLAN', NULL FROM g WHERE orphans > 0 UNION ALL SELECT project_id, 'info', 'PROVENANCE_SUMMARY', NULL FROM g UNION ALL SELECT project_id, 'error', 'NO_EXTERNAL', NULL FROM g WHERE ext = 0
  UNION ALL SELECT project_id, 'warning', 'NO_INTERNAL', NULL FROM g WHERE int_ = 0 AND ext > 4
  UNION ALL SELECT project_id, 'info', 'EXT_INT_RATIO', NULL FROM g WHERE ext >= 4 AND (int_ / ext < CASE WHEN bt = 'comercial' THEN 2e-1 ELSE 4e-1 END OR int_ / ext > 6)
  UNION ALL SELECT project_id, 'warning', 'WALL_COUNT_LOW', NULL FROM g WHERE n < floor(walls_low * 7e-1) UNION ALL SELECT project_id, 'warning', 'WALL_COUNT_HIGH', NULL FROM g WHERE n > ceil(walls_high * 13e-1)
  UNION ALL SELECT project_id, 'info', 'OPENING_COUNT_LOW', NULL FROM g WHERE opens < floor(openings_low * 5e-1) UNION ALL SELECT project_id, 'warning', 'ENVELOPE_LOW_CONFIDENCE', level FROM {envelopes} WHERE confidence < 5e-1
  UNION ALL SELECT e.project_id, 'warning', 'FEW_EXTERNALS_FOR_PERIMETER', e.level FROM {envelopes} e WHERE (SELECT count(*) FROM w WHERE w.project_id = e.project_id AND lower(w.level) = lower(e.level) AND wall_class = 'external') < 3
  UNION ALL SELECT project_id, 'info', 'FLOOR_ROOF_DIFFER', level FROM fs WHERE fl > 0 AND rf > 0 AND (rf / fl < 6e-1 OR rf / fl > 18e-1))"""
)


@query("WITH " + CHECKED + " SELECT project_id, severity, code, element_id FROM nt")
def self_check(t):
    return _audited(t)


@query(
    "WITH "
    + CHECKED
    + " SELECT project_id, count(*) FILTER (severity = 'info') AS info, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'error') AS error, count(*) AS total FROM nt GROUP BY 1"
)
def self_check_summary(t):
    return audit.self_check_summary(_audited(t))


@query(
    "WITH "
    + CHECKED
    + """, ev AS (SELECT *, CASE WHEN kind = 'stage' THEN stage WHEN kind = 'page_split' THEN '0.5' WHEN kind = 'cv_substep' THEN '3.4' WHEN kind = 'audit' THEN coalesce(stage, '6.5') ELSE '?' END AS stage_id FROM (SELECT * REPLACE (['1', '4', '7.5', stage][id % 4 + 1] AS stage) FROM {pipeline_events})),
er AS (SELECT *, coalesce(list_position(['0.5', '1', '1.5', '3', '3.5', '3.7', '4', '4.5', '5', '6', '6.5', '7', '7.5', '8'], stage_id), 999) AS rk, min(id) OVER (PARTITION BY project_id, stage_id) AS f FROM ev),
rn AS (SELECT * FROM {ai_runs})
SELECT project_id, 'notes' AS feed, row_number() OVER (PARTITION BY project_id ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, code, coalesce(element_id, '')) AS place, severity || ':' || code || ':' || coalesce(element_id, '') AS entry FROM nt
UNION ALL SELECT project_id, 'events', row_number() OVER (PARTITION BY project_id ORDER BY rk, CASE WHEN rk = 999 THEN f END, created_at, id), stage_id || ':' || CAST(id AS VARCHAR) FROM er
UNION ALL SELECT project_id, 'runs', row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC), CAST(id AS VARCHAR) FROM rn"""
)
def order_feeds(t):
    own = lambda df, feed, *parts: df.select("project_id", F.lit(feed).alias("feed"), "place", F.concat_ws(":", *parts).alias("entry"))
    events = t(EVENTS).withColumn("stage", F.get(F.array(F.lit("1"), F.lit("4"), F.lit("7.5"), F.col("stage")), (F.col("id") % 4).cast("int"))).withColumn("prompt_version", F.lit(None).cast("string"))
    notes = own(audit.order_notes(_audited(t)), "notes", "severity", "code", F.coalesce("element_id", F.lit("")))
    return notes.unionByName(own(audit.order_events(events), "events", "stage_id", "id")).unionByName(own(audit.newest_first(t("ai_runs")), "runs", "id"))


INCONSISTENT = (
    LEVELS
    + """, wn AS (SELECT project_id, 'critical' AS severity, 'HEIGHT_INVALID' AS code, wall_id AS element_id FROM v WHERE height_m <= 0 UNION ALL SELECT project_id, 'low', 'LENGTH_UNUSUAL', wall_id FROM v WHERE length_m < 5e-1 OR length_m > 50
  UNION ALL SELECT project_id, 'low', 'HEIGHT_UNUSUAL', wall_id FROM v WHERE height_m < 15e-1 OR height_m > 6 UNION ALL SELECT project_id, 'critical', 'AREA_INVALID', slab_id FROM vs WHERE area_m2 <= 0),
lv AS (SELECT project_id, level, floor(sum(CASE WHEN category = 'external' THEN gross_m2 ELSE 0e0 END) * 1e6 + 5e-1) / 1e6 AS e, floor(sum(CASE WHEN category IN ('floor', 'roof') THEN gross_m2 ELSE 0e0 END) * 1e6 + 5e-1) / 1e6 AS s FROM bl GROUP BY 1, 2),
al AS (SELECT * FROM wn UNION ALL SELECT project_id, 'medium', 'SLAB_WALL_RATIO', level FROM lv WHERE e > 0 AND s > 0 AND (s / e > 5 OR s / e < 5e-2))"""
)


def _inconsistent(t):
    walls, slabs = pipelines.measured_elements(t.walls(), t("slabs"))
    return audit.inconsistencies(t("projects"), walls, slabs, _levels(t))


@query("WITH " + INCONSISTENT + " SELECT project_id, severity, CASE severity WHEN 'critical' THEN 'critical' WHEN 'medium' THEN 'warning' ELSE 'info' END AS alert, code, element_id FROM al")
def inconsistencies(t):
    return _inconsistent(t)


@query(
    """SELECT project_id, CASE WHEN rn = 0 THEN 'primary' ELSE 'enrichment' END AS role, view, count(*) AS n FROM (SELECT project_id, 0 AS rn, CASE WHEN seq % 97 = 0 THEN 'section' ELSE 'plan' END AS view FROM {walls} UNION ALL SELECT project_id, 1, 'section' FROM {walls} WHERE seq % 3 = 0
UNION ALL SELECT project_id, 1, 'facade' FROM {walls} WHERE seq % 4 = 0) GROUP BY 1, 2, 3"""
)
def provenance_summary(t):
    s = F.col("seq")
    extra = F.filter(F.array(F.when(s % 3 == 0, "section"), F.when(s % 4 == 0, "facade")), lambda x: x.isNotNull())
    return audit.provenance_summary(t("walls").withColumns({"primary_view": F.when(s % 97 == 0, "section").otherwise("plan"), "enrichments": extra}))


@query("SELECT DISTINCT w.project_id, lower(w.level) AS level FROM {walls} w JOIN {envelopes} e ON e.project_id = w.project_id AND lower(e.level) = lower(w.level) WHERE w.wall_class = 'external'")
def levels_with_envelope(t):
    return audit.levels_with_envelope(t("walls"), t.envelopes())


TOTALS = LEVELS + """, tt AS (SELECT project_id, category, floor(sum(CASE WHEN category IN ('external', 'internal') THEN net_m2 ELSE gross_m2 END) * 1e2 + 5e-1) / 1e2 AS found_m2 FROM bl GROUP BY 1, 2)"""
ACCURACY = (
    TOTALS
    + """, rl AS (SELECT project_id, 'external' AS category, real_ext AS real_m2 FROM {projects} UNION ALL SELECT project_id, 'internal', real_int FROM {projects} UNION ALL SELECT project_id, 'boundary', real_boundary FROM {projects}
  UNION ALL SELECT project_id, 'floor', real_floor FROM {projects} UNION ALL SELECT project_id, 'roof', real_roof FROM {projects}),
ac AS (SELECT rl.project_id, rl.category, rl.real_m2, coalesce(tt.found_m2, 0e0) AS found_m2, CASE WHEN rl.real_m2 > 0 THEN floor((coalesce(tt.found_m2, 0e0) - rl.real_m2) / rl.real_m2 * 1e6 + 5e-1) / 1e6 END AS deviation,
  CASE WHEN rl.real_m2 > 0 THEN floor(greatest(0e0, 1e0 - abs((coalesce(tt.found_m2, 0e0) - rl.real_m2) / rl.real_m2)) * 1e6 + 5e-1) / 1e6 END AS accuracy FROM rl LEFT JOIN tt ON tt.project_id = rl.project_id AND tt.category = rl.category)"""
)


def _found(t):
    # walls count with their net areas, boundaries and slabs as they are
    area = F.when(F.col("category").isin("external", "internal"), F.col("net_m2")).otherwise(F.col("gross_m2"))
    return _levels(t).groupBy("project_id", "category").agg(half_up(F.sum(area)).alias("found_m2"))


def _accuracy(t):
    return score.area_accuracy(t("projects"), _found(t))


@query("WITH " + ACCURACY + " SELECT project_id, category, real_m2, found_m2, deviation, accuracy FROM ac")
def area_accuracy(t):
    return _accuracy(t)


@query(
    "WITH "
    + ACCURACY
    + """ SELECT CASE WHEN grouping(project_id) = 0 THEN 'project' WHEN grouping(category) = 0 THEN 'category' ELSE 'global' END AS scope, project_id, category, floor(sum(accuracy * real_m2) / sum(real_m2) * 1e4 + 5e-1) / 1e4 AS accuracy,
  floor((sum(found_m2) - sum(real_m2)) / sum(real_m2) * 1e4 + 5e-1) / 1e4 AS deviation, count(DISTINCT project_id) AS projects FROM ac WHERE accuracy IS NOT NULL GROUP BY GROUPING SETS ((project_id), (category), ())"""
)
def calibration(t):
    return score.calibration(_accuracy(t))


@query(
    "WITH "
    + TOTALS
    + """, tr AS (SELECT CAST(project_id AS VARCHAR) AS fixture, category, CASE WHEN project_id % 5 = 0 THEN NULL WHEN category = 'boundary' THEN 0e0 ELSE floor(found_m2 * (80 + project_id % 40) / 1e2) END AS truth_m2, found_m2 FROM tt WHERE category IN ('external', 'internal', 'boundary', 'floor', 'roof')),
sc AS (SELECT *, CASE WHEN truth_m2 <= 0 THEN CASE WHEN found_m2 <= 0 THEN 100e0 ELSE 0e0 END ELSE greatest(0e0, 100e0 - abs(found_m2 - truth_m2) / truth_m2 * 100e0) END AS s FROM tr),
g AS (SELECT fixture, sum(s * truth_m2) FILTER (truth_m2 > 0) / sum(truth_m2) FILTER (truth_m2 > 0) AS m, min(s) FILTER (truth_m2 > 0) AS w FROM sc GROUP BY 1)
SELECT fixture, CASE WHEN m IS NULL THEN 'SKIP' WHEN m >= 85 AND w >= 70 THEN 'PASS' ELSE 'FAIL' END AS status, floor(m * 1e4 + 5e-1) / 1e4 AS overall, floor(w * 1e4 + 5e-1) / 1e4 AS worst FROM g"""
)
def accuracy_gate(t):
    found = _found(t).filter(F.col("category").isin(*score.REAL)).withColumnRenamed("found_m2", "actual_m2")
    p = F.col("project_id")
    truth = found.select(p.cast("string").alias("fixture"), "category", F.when(p % 5 == 0, F.lit(None)).when(F.col("category") == "boundary", 0.0).otherwise(F.floor(F.col("actual_m2") * (80 + p % 40) / 100.0).cast("double")).alias("truth_m2"))
    return score.accuracy_gate(found.select(p.cast("string").alias("fixture"), "category", "actual_m2"), truth)


@query(
    """WITH e AS (SELECT project_id, wall_id, wall_class, CASE WHEN seq % 10 = 0 THEN 'external' ELSE wall_class END AS nc, seq % 13 <> 0 AS en FROM {walls} WHERE seq % 17 <> 0 AND project_id % 4 <> 3),
p AS (SELECT project_id FROM {projects} WHERE project_type = 'test' AND status = 'completed' AND project_id IN (SELECT project_id FROM e)),
k AS (SELECT w.project_id, count(*) AS walls, count(*) FILTER (e.nc = w.wall_class AND e.en) AS kept FROM {walls} w JOIN p ON p.project_id = w.project_id LEFT JOIN e ON e.project_id = w.project_id AND e.wall_id = w.wall_id GROUP BY 1),
a AS (SELECT * FROM k UNION ALL SELECT NULL, coalesce(sum(walls), 0), coalesce(sum(kept), 0) FROM k)
SELECT project_id, CAST(walls AS BIGINT) AS walls, CAST(kept AS BIGINT) AS kept, CASE WHEN walls > 0 THEN floor(kept / walls * 100 * 1e1 + 5e-1) / 1e1 END AS share FROM a"""
)
def class_retention(t):
    w, s = t("walls"), F.col("seq")
    edited = w.filter("seq % 17 <> 0 AND project_id % 4 <> 3").select("project_id", "wall_id", F.when(s % 10 == 0, "external").otherwise(F.col("wall_class")).alias("wall_class"), (s % 13 != 0).alias("enabled"))
    return score.class_retention(t("projects"), w, edited)


@query(
    """SELECT count(*) AS total, count(*) FILTER (active) AS active, count(*) FILTER (action = 'confirm') AS confirm, count(*) FILTER (action = 'correct') AS correct, count(*) FILTER (action = 'not_wall') AS not_wall, count(*) FILTER (is_exemplar) AS exemplar FROM {feedback}"""
)
def feedback_counts(t):
    return score.feedback_counts(t("feedback"))


@query("SELECT thickness_cm, length_dm, original_class, corrected_class, count(*) AS n FROM {feedback} WHERE active AND action <> 'confirm' GROUP BY 1, 2, 3, 4 ORDER BY n DESC, min(id) LIMIT 20")
def feedback_patterns(t):
    return score.feedback_patterns(t("feedback"))


def _budgets(t):
    return t("corners").select("project_id", F.col("seq").alias("budget_id"), (F.col("corner_count") * 1000.0).alias("total_cost"))


@query(
    """WITH n AS (SELECT project_id, created_at FROM {projects} WHERE lower(name) LIKE '%casa%' ORDER BY created_at DESC, project_id DESC LIMIT 5) SELECT n.project_id, c.seq AS budget_id, c.corner_count * 1e3 AS total_cost FROM n JOIN {corners} c ON c.project_id = n.project_id ORDER BY n.created_at DESC, n.project_id DESC, c.seq DESC LIMIT 1"""
)
def latest_budget(t):
    return score.latest_budget(t("projects"), _budgets(t), "Casa").select("project_id", "budget_id", "total_cost")


@query(
    """SELECT project_id, seq FROM (SELECT project_id, seq, row_number() OVER (PARTITION BY project_id ORDER BY CASE WHEN greatest(roof_m2, boundary_gross) > 0 THEN 0 ELSE 1 END, seq) AS rn FROM (SELECT *, file_seq * 100000 + page_index AS seq FROM {area_pages})) WHERE rn = 1"""
)
def best_summary_row(t):
    rows = t("area_pages").withColumn("seq", F.col("file_seq") * 100000 + F.col("page_index"))
    return score.best_summary_row(rows, ["roof_m2", "boundary_gross"]).select("project_id", "seq")


@query(
    """SELECT 'completed' AS kpi, count(*) FILTER (status = 'completed') AS n, NULL::DOUBLE AS low, NULL::DOUBLE AS high FROM {projects} UNION ALL SELECT 'test', count(*) FILTER (project_type = 'test'), NULL, NULL FROM {projects}
UNION ALL SELECT 'panel_' || panel_type, count(*), min(unit_price), max(unit_price) FROM {products} WHERE category = 'painel' AND panel_type IS NOT NULL GROUP BY panel_type"""
)
def project_kpis(t):
    return score.project_kpis(t("projects"), t("products"))


@query("SELECT p.project_id, p.name, p.status, max(c.corner_count * 1e3) AS total_cost FROM {projects} p LEFT JOIN {corners} c ON c.project_id = p.project_id GROUP BY 1, 2, 3")
def project_listing(t):
    return score.project_listing(t("projects"), _budgets(t), is_admin=False).select("project_id", "name", "status", "total_cost")


@query("SELECT p.project_id, p.name, c.seq AS budget_id FROM {projects} p JOIN {corners} c ON c.project_id = p.project_id")
def budgets_with_projects(t):
    return _budgets(t).join(t("projects"), "project_id").select("project_id", "name", "budget_id")


@query(
    """SELECT a.project_id, min(b.project_id) AS duplicate_of FROM {projects} a JOIN {projects} b ON a.fingerprint = b.fingerprint AND a.project_id <> b.project_id AND b.status = 'completed' AND a.fingerprint <> ''
AND (a.client_email IS NULL OR b.client_email IS NULL OR a.client_email = b.client_email) GROUP BY 1"""
)
def find_duplicates(t):
    return score.find_duplicates(t("projects"))


@query(
    """WITH f AS (SELECT project_id, 'f' || CAST(seq AS VARCHAR) AS name, sha256('c' || CAST(corner_count AS VARCHAR)) AS d FROM {corners}) SELECT project_id, sha256(string_agg(d, '' ORDER BY name, d)) AS fingerprint FROM f GROUP BY 1"""
)
def fingerprint(t):
    return score.fingerprint(t("corners").select("project_id", F.concat(F.lit("f"), F.col("seq").cast("string")).alias("name"), F.concat(F.lit("c"), F.col("corner_count").cast("string")).cast("binary").alias("content")))


CORRECTED = """w AS (SELECT *, seq % 11 >= 7 AS sure, seq % 5 AS f, (seq % 600) / 1e1 AS num, seq % 4 <> 0 AS known, seq % 2 = 0 AS again FROM {walls}),
ww AS (SELECT *, sure AND f = 3 AS gone, sure AND (f = 0 AND num > 0 AND num <= 50 OR f = 1 AND num BETWEEN 15e-1 AND 6 OR f = 2 AND known) AS hit FROM w),
s AS (SELECT *, seq % 2 = 0 AS sure, seq % 3 AS f, seq % 6000 + 5e-1 AS num FROM {slabs})"""


def _corrections(t):
    s = F.col("seq")
    field = F.when(s % 5 == 0, "length").when(s % 5 == 1, "height").when(s % 5 == 2, "class").when(s % 5 == 3, "remove").otherwise("strange")
    first = t("walls").select("project_id", F.col("wall_id").alias("element_id"), field.alias("field"), ((s % 600) / 10.0).alias("number"), F.when(s % 4 == 0, "strange").otherwise("boundary").alias("text"), ((s % 11) / 10.0).alias("confidence"), (s * 2).alias("seq"))
    again = t("walls").filter(s % 2 == 0).select("project_id", F.col("wall_id").alias("element_id"), F.lit("length").alias("field"), F.lit(7.5).alias("number"), F.lit(None).cast("string").alias("text"), F.lit(0.9).alias("confidence"), (s * 2 + 1).alias("seq"))
    slab_field = F.when(s % 3 == 0, "area").when(s % 3 == 1, "class").otherwise("remove")
    plates = t("slabs").select("project_id", F.col("slab_id").alias("element_id"), slab_field.alias("field"), (s % 6000 + F.lit(0.5)).alias("number"), F.lit("raft").alias("text"), F.when(s % 2 == 0, 0.9).otherwise(0.5).alias("confidence"), "seq")
    return score.apply_corrections(t("walls"), t("slabs"), first.unionByName(again), plates)


@query(
    "WITH "
    + CORRECTED
    + """ SELECT project_id, wall_id AS element_id, CASE WHEN again THEN 75e-1 WHEN hit AND f = 0 THEN num ELSE length_m END AS measure, CASE WHEN hit AND f = 1 THEN num ELSE height_m END AS height_m,
  CASE WHEN hit AND f = 2 THEN 'boundary' ELSE wall_class END AS class FROM ww WHERE NOT gone UNION ALL
SELECT project_id, slab_id, CASE WHEN sure AND f = 0 AND num <= 5000 THEN num ELSE area_m2 END, NULL, CASE WHEN sure AND f = 1 THEN 'raft' ELSE slab_class END FROM s WHERE NOT (sure AND f = 2)"""
)
def apply_corrections(t):
    walls, slabs, _ = _corrections(t)
    own = walls.select("project_id", F.col("wall_id").alias("element_id"), F.col("length_m").alias("measure"), "height_m", F.col("wall_class").alias("class"))
    return own.unionByName(slabs.select("project_id", F.col("slab_id").alias("element_id"), F.col("area_m2").alias("measure"), F.lit(None).cast("double").alias("height_m"), F.col("slab_class").alias("class")))


@query(
    "WITH "
    + CORRECTED
    + """, a AS (SELECT project_id, count(*) FILTER (hit) + count(*) FILTER (again AND NOT gone) AS n, count(*) FILTER (gone) AS g FROM ww GROUP BY 1 HAVING bool_or(hit OR again OR gone)),
b AS (SELECT project_id, count(*) FILTER (f = 0 AND num <= 5000 OR f = 1) AS n, count(*) FILTER (f = 2) AS g FROM s WHERE sure AND (f <> 0 OR num <= 5000) GROUP BY 1)
SELECT coalesce(a.project_id, b.project_id) AS project_id, coalesce(a.n, 0) AS walls, coalesce(b.n, 0) AS slabs, coalesce(a.g, 0) AS removed_walls, coalesce(b.g, 0) AS removed_slabs FROM a FULL JOIN b ON a.project_id = b.project_id"""
)
def correction_counts(t):
    return _corrections(t)[2]


@query("SELECT project_id, seq FROM {corners} WHERE project_id % 2 = 0 AND seq % 2 = 0 UNION ALL SELECT project_id, seq FROM {corners} WHERE project_id NOT IN (SELECT project_id FROM {corners} WHERE project_id % 2 = 0 AND seq % 2 = 0)")
def snapshot_once(t):
    rows = t("corners").select("project_id", "seq")
    return score.snapshot_once(rows, rows.filter("project_id % 2 = 0 AND seq % 2 = 0"))


COST = """pc AS (SELECT *, CASE model WHEN 'openai:gpt-4o-mini' THEN 15e-2 WHEN 'gemini-2.5-pro' THEN 125e-2 WHEN 'gpt-4o-2024-08-06' THEN 25e-1 WHEN 'gemini-2.5-flash-lite' THEN 75e-3 END AS pi, CASE model WHEN 'openai:gpt-4o-mini' THEN 6e-1 WHEN 'gemini-2.5-pro' THEN 5e0 WHEN 'gpt-4o-2024-08-06' THEN 10e0 WHEN 'gemini-2.5-flash-lite' THEN 3e-1 END AS po FROM {ai_runs}),
ct AS (SELECT *, floor((in_tokens * pi / 1e6 + out_tokens * po / 1e6 + coalesce(think_tokens, 0) * po / 1e6) * 1e9 + 5e-1) / 1e9 AS cost_usd FROM pc)"""


@query("WITH " + COST + " SELECT id, cost_usd FROM ct")
def ai_cost(t):
    return telemetry.ai_cost(t("ai_runs")).select("id", "cost_usd")


@query(
    "WITH "
    + COST
    + """ SELECT CASE WHEN grouping(project_id) = 0 THEN 'project' WHEN grouping(model) = 0 THEN 'model' ELSE 'prompt' END AS scope, coalesce(CAST(project_id AS VARCHAR), model, prompt_version) AS key, count(*) AS calls, floor(sum(cost_usd) * 1e6 + 5e-1) / 1e6 AS cost_usd,
  CAST(sum(in_tokens + out_tokens + coalesce(think_tokens, 0)) AS BIGINT) AS tokens, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, count(*) FILTER (status = 'failed') AS failures FROM ct GROUP BY GROUPING SETS ((project_id), (model), (prompt_version))"""
)
def ai_cost_rollup(t):
    return telemetry.ai_cost_rollup(t("ai_runs"))


@query(
    """WITH c AS (SELECT project_id, count(*) AS n, count(*) FILTER (status = 'retried') AS r, count(*) FILTER (status = 'rate_limited') AS l, count(*) FILTER (status = 'failed') AS f, count(*) FILTER (status = 'json_retry') AS j FROM {ai_runs} GROUP BY 1),
g AS (SELECT project_id, count(*) AS n FROM {pipeline_events} WHERE kind = 'page_split' AND phase = 'failed' GROUP BY 1),
p AS (SELECT DISTINCT project_id FROM {pipeline_events}),
k AS (SELECT p.project_id, CASE WHEN c.n IS NULL THEN 100 ELSE greatest(0, 100 - CASE WHEN r / c.n > 5e-1 THEN 25 WHEN r / c.n > 2e-1 THEN 10 ELSE 0 END - least(20, 5 * l) - least(30, CAST(floor(f / c.n * 6e1 + 5e-1) AS BIGINT)) - least(15, 5 * j)
  - least(20, 10 * coalesce(g.n, 0))) END AS score FROM p LEFT JOIN c ON p.project_id = c.project_id LEFT JOIN g ON p.project_id = g.project_id)
SELECT project_id, score, CASE WHEN score >= 80 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END AS level FROM k"""
)
def reliability_score(t):
    failed = t(EVENTS).filter("kind = 'page_split' AND phase = 'failed'").select("project_id")
    return telemetry.reliability_score(t("ai_runs"), failed, t(EVENTS).select("project_id"))


@query(
    """WITH s AS (SELECT project_id, stage, max(created_at) FILTER (phase = 'started') AS a, max(created_at) FILTER (phase = 'completed') AS c, max(created_at) FILTER (phase = 'failed') AS f FROM {pipeline_events} WHERE kind = 'stage' GROUP BY 1, 2)
SELECT project_id, stage, CASE WHEN c IS NOT NULL THEN 'completed' WHEN f IS NOT NULL THEN 'failed' ELSE 'started' END AS status, epoch_us(a) AS started_us, epoch_us(c) AS completed_us, epoch_us(f) AS failed_us, epoch_ms(coalesce(c, f)) - epoch_ms(a) AS duration_ms,
  row_number() OVER (PARTITION BY project_id ORDER BY coalesce(a, c, f), stage) AS place FROM s"""
)
def stage_durations(t):
    return _us(telemetry.stage_durations(t(EVENTS)), "started_at", "completed_at", "failed_at")


CALLS = """SELECT project_id, call_id, coalesce(arg_min(phase, created_at) FILTER (phase IN ('completed', 'failed')), 'started') AS status, epoch_us(min(created_at) FILTER (phase = 'started')) AS started_us, epoch_us(min(created_at) FILTER (phase IN ('completed', 'failed'))) AS ended_us FROM {pipeline_events} WHERE kind = 'ai_call' GROUP BY 1, 2"""


def _us(df, *columns):
    return df.select(*[c for c in df.columns if c not in columns], *(F.unix_micros(c).alias(c.replace("_at", "_us")) for c in columns))


@query(CALLS.replace(" FROM {pipeline_events}", ", count(DISTINCT id) AS events FROM {pipeline_events}"))
def fold_calls(t):
    return _us(telemetry.fold_calls(t(EVENTS)), "started_at", "ended_at")


def _folded(t, name):
    """The outcome of a streaming job over the events table's files."""
    return streams.run_fold(t.spark, name, t.stream(EVENTS), io.run_folder(t.spark, name))


def _appended(t, result, name):
    """What a streaming job has appended by the time that it has seen the events table's files, and the late rows that it left out."""
    folder = io.run_folder(t.spark, name)
    run = streams.to_folder(result, f"{folder}/out", f"{folder}/state")
    run.awaitTermination()
    return t.spark.read.schema(result.schema).parquet(f"{folder}/out"), streams.late_rows(run)


@query(CALLS)
def stream_ai_calls(t):
    return _us(_folded(t, "calls"), "started_at", "ended_at")


@query(
    """SELECT project_id, stage, epoch_us(min(created_at) FILTER (phase = 'started')) AS started_us, epoch_us(max(created_at) FILTER (phase = 'completed')) AS completed_us, arg_max(phase, created_at) AS last_phase FROM {pipeline_events} WHERE kind = 'stage' GROUP BY 1, 2"""
)
def stream_stages(t):
    return _us(_folded(t, "stages"), "started_at", "completed_at")


@query("SELECT project_id, count(*) AS events, CAST(sum(in_tokens) AS BIGINT) AS tokens, epoch_us(min(created_at)) AS first_us, epoch_us(max(created_at)) AS last_us FROM {pipeline_events} GROUP BY 1")
def stream_totals(t):
    return _us(_folded(t, "totals"), "first_at", "last_at")


# the table's files come as one batch, after which the watermark is ten minutes before the last event
@query(
    """WITH l AS (SELECT project_id, arg_max(phase, (created_at, id)) AS p, max(created_at) AS m FROM {pipeline_events} GROUP BY 1)
SELECT project_id, epoch_us(m) AS last_us FROM l WHERE p = 'started' AND epoch_ms(m) + 12 * 60000 <= (SELECT epoch_ms(max(created_at)) FROM {pipeline_events}) - 10 * 60000"""
)
def stream_stale(t):
    return _us(_appended(t, streams.stale_by_timeout(t.stream(EVENTS)), "stale")[0], "last_at")


@query(
    """WITH e AS (SELECT 'tumbling' AS form, time_bucket(INTERVAL 10 MINUTE, created_at) AS s, kind, in_tokens FROM {pipeline_events} UNION ALL
  SELECT 'sliding', time_bucket(INTERVAL 5 MINUTE, created_at) - k * INTERVAL 5 MINUTE, kind, in_tokens FROM {pipeline_events}, (SELECT unnest([0, 1]) AS k)),
m AS (SELECT epoch_ms(max(created_at)) - 10 * 60000 AS w FROM {pipeline_events})
SELECT form, epoch_us(s) AS start_us, kind, count(*) AS n, CAST(sum(in_tokens) AS BIGINT) AS tokens, 0 AS late FROM e, m WHERE epoch_ms(s) + 10 * 60000 <= w GROUP BY 1, 2, 3"""
)
def stream_event_rates(t):
    out = None
    for form, slide in (("tumbling", None), ("sliding", "5 minutes")):
        rates, late = _appended(t, streams.event_rates(t.stream(EVENTS), slide), "rates")
        own = rates.select(F.lit(form).alias("form"), F.unix_micros("start").alias("start_us"), "kind", "n", "tokens", F.lit(late).alias("late"))
        out = own if out is None else out.unionByName(own)
    return out


@query("SELECT id, project_id FROM {pipeline_events} WHERE kind NOT IN ('page_split', 'cv_substep') AND NOT (kind = 'ai_call' AND phase = 'started')")
def stream_events_sink(t):
    folder = io.run_folder(t.spark, "events")
    streams.events_sink(t.stream(EVENTS), f"{folder}/out", f"{folder}/state").awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").select("id", "project_id")


# levels, proposal lines and alerts of one budget
BUDGETED = PROPOSAL + INCONSISTENT[len(LEVELS) :]


@query(
    "WITH "
    + BUDGETED
    + """, q AS (SELECT project_id, count(*) AS n, CAST(sum(panels) AS BIGINT) AS panels FROM bl GROUP BY 1), m AS (SELECT project_id, count(*) AS n, max(CASE WHEN line = 'total' THEN cost END) AS cost FROM pr GROUP BY 1),
a AS (SELECT project_id, count(*) AS n, count(*) FILTER (severity = 'low') AS low FROM al GROUP BY 1)
SELECT p.project_id, p.name, p.client_name, q.n AS n_quantities, q.panels, m.n AS n_materials, m.cost, a.n AS n_alerts, a.low AS n_low FROM {projects} p LEFT JOIN q ON q.project_id = p.project_id LEFT JOIN m ON m.project_id = p.project_id LEFT JOIN a ON a.project_id = p.project_id"""
)
def write_budget_json(t):
    docs = io.budget_documents(t("projects"), _levels(t), _proposal(t), _inconsistent(t))
    folder = io.run_folder(t.spark, "budgets")
    io.write_budget_json(docs, folder)
    back = t.spark.read.schema(docs.schema).json(folder)
    total = F.filter("materials", lambda m: m["line"] == "total")
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).cast("long")
    return back.select(
        "project_id", "name", "client_name", size("quantities").alias("n_quantities"), F.aggregate("quantities", F.lit(0).cast("long"), lambda a, q: a + q["panels"]).alias("panels"),
        size("materials").alias("n_materials"), F.get(total, F.lit(0))["cost"].alias("cost"), size("alerts").alias("n_alerts"),
        F.when(F.col("alerts").isNotNull(), F.size(F.filter("alerts", lambda a: a["severity"] == "low"))).cast("long").alias("n_low"),
    )


@query(
    "WITH "
    + BUDGETED
    + ", ax AS ("
    + ASSUMED
    + """) SELECT 'summary' AS name, project_id, count(*) AS n, CAST(sum(panels) AS DOUBLE) AS total FROM sm GROUP BY 2 UNION ALL SELECT 'walls', project_id, count(*), CAST(sum(panels) AS DOUBLE) FROM pn GROUP BY 2
UNION ALL SELECT 'slabs', project_id, count(*), CAST(sum(panels) AS DOUBLE) FROM sp GROUP BY 2 UNION ALL SELECT 'materials', project_id, count(*), floor(sum(cost) * 1e2 + 5e-1) / 1e2 FROM pr GROUP BY 2
UNION ALL SELECT 'alerts', project_id, count(*), CAST(count(element_id) AS DOUBLE) FROM al GROUP BY 2 UNION ALL SELECT 'assumptions', project_id, count(*), CAST(count(*) FILTER (field = 'height') AS DOUBLE) FROM ax GROUP BY 2"""
)
def export_tables(t):
    walls, slabs = pipelines.measured_elements(t.walls(), t("slabs"))
    tables = {
        "summary": budget.budget_summary(_levels(t)),
        "walls": budget.wall_panels(walls).select("project_id", "wall_id", "level", "wall_class", "gross_m2", "net_m2", "panels"),
        "slabs": budget.slab_panels(slabs).select("project_id", "slab_id", "level", "slab_class", "area_m2", "panels"),
        "materials": _proposal(t),
        "alerts": _inconsistent(t),
        "assumptions": clean.assumption_log(t.walls(), t("slabs")),
    }
    folder = io.run_folder(t.spark, "tables")
    io.export_tables(tables, folder)
    totals = {"materials": half_up(F.sum("cost")), "alerts": F.count("element_id"), "assumptions": F.count_if(F.col("field") == "height")}
    out = None
    for name, df in io.read_tables(t.spark, tables, folder).items():
        row = df.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), totals.get(name, F.sum("panels")).cast("double").alias("total")).select(F.lit(name).alias("name"), "project_id", "n", "total")
        out = row if out is None else out.unionByName(row)
    return out
