"""Fusion and classification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions.exprs import round_half_up as half_up
from ..operators import classify, clean, fuse
from ..sources.io import staged
from . import pipelines
from .catalogue import DEFAULTED, query
from .queries_clean import SIGNATURE


def _walls(t):
    return clean.wall_defaults(clean.fix_units(t.walls()))


@query(
    """WITH RECURSIVE w AS MATERIALIZED (SELECT {'p': project_id, 'v': level, 'c': wall_class} AS g, row_number() OVER (PARTITION BY project_id, level, wall_class ORDER BY seq) AS pos, seq, wall_id, length_m, height_m, thickness_m, source, confidence FROM {walls}),
q AS MATERIALIZED (SELECT {'p': project_id, 'v': level, 'c': wall_class} AS g, row_number() OVER (PARTITION BY project_id, level, wall_class ORDER BY seq) AS rn, seq, wall_id, length_m, height_m, thickness_m FROM {sched_walls}),
n AS (SELECT g, list(length_m ORDER BY pos) AS ls FROM w GROUP BY 1), z AS (SELECT DISTINCT q.g, coalesce(ls, CAST([] AS DOUBLE[])) AS ls FROM q LEFT JOIN n ON n.g = q.g),
r AS (SELECT g, CAST(0 AS BIGINT) AS rn, ls, CAST(0 AS BIGINT) AS pos FROM z UNION ALL SELECT g, rn, CASE WHEN pos > len(ls) THEN list_append(ls, v) ELSE list_transform(ls, lambda x, i: CASE WHEN i = pos THEN v ELSE x END) END, pos FROM
  (SELECT q.g, q.rn, r.ls, q.length_m AS v, coalesce(nullif(list_position(list_transform(r.ls, lambda x: abs(x - q.length_m) < 5e-1), true), 0), len(r.ls) + 1) AS pos FROM r JOIN q ON q.g = r.g AND q.rn = r.rn + 1)),
k AS MATERIALIZED (SELECT g, pos, max(rn) AS last, min(rn) AS first FROM r WHERE rn > 0 GROUP BY 1, 2)
SELECT w.g.p AS project_id, w.g.v AS level, w.g.c AS wall_class, w.seq, w.wall_id, coalesce(q.length_m, w.length_m) AS length_m, coalesce(q.height_m, w.height_m) AS height_m, coalesce(q.thickness_m, w.thickness_m) AS thickness_m,
  CASE WHEN k.last IS NOT NULL THEN 'table' ELSE source END AS source, CASE WHEN k.last IS NOT NULL THEN 95e-2 ELSE confidence END AS confidence FROM w LEFT JOIN k ON k.g = w.g AND k.pos = w.pos LEFT JOIN q ON q.g = w.g AND q.rn = k.last
UNION ALL SELECT k.g.p, k.g.v, k.g.c, f.seq + 1099511627776, f.wall_id, l.length_m, l.height_m, l.thickness_m, 'table', 95e-2 FROM k LEFT JOIN w ON w.g = k.g AND w.pos = k.pos JOIN q f ON f.g = k.g AND f.rn = k.first JOIN q l ON l.g = k.g AND l.rn = k.last WHERE w.pos IS NULL"""
)
def merge_schedule_walls(t):
    return fuse.merge_schedule_walls(t("walls"), t("sched_walls"))


@query(
    """WITH c AS (SELECT project_id, code, arg_max(width_m, seq) AS w FROM {sched_openings} GROUP BY 1, 2)
SELECT a.project_id, a.seq, coalesce(c.w, a.door_w) AS door_w, c.w IS NOT NULL AS matched FROM {walls} a LEFT JOIN c ON c.project_id = a.project_id AND c.code = a.door_code WHERE a.door_code IS NOT NULL"""
)
def schedule_opening_dims(t):
    out = fuse.schedule_opening_dims(t.walls(), t("sched_openings")).select("project_id", "seq", F.explode("openings").alias("o")).filter("o.kind = 'door'")
    # a source of `table` may also be the wall's own
    own = t("sched_openings").select("project_id", "code", F.lit(True).alias("m")).distinct()
    out = out.join(own, (out.project_id == own.project_id) & (F.col("o.code") == own.code), "left").select(out.project_id, "seq", F.col("o.width_m").alias("door_w"), F.coalesce("m", F.lit(False)).alias("matched"))
    return out


LINKED = """k AS (SELECT project_id, upper(trim(code)) AS code, arg_max(width_m, seq) AS w, arg_max(height_m, seq) AS h FROM {sched_openings} WHERE trim(code) <> '' GROUP BY 1, 2),
j AS (SELECT a.project_id, a.seq, a.length_m, a.height_m, a.has_door, a.has_window, a.door_code, a.win_code, coalesce(d.w, a.door_w) AS dw, coalesce(d.h, a.door_h) AS dh, coalesce(n.w, a.win_w) AS ww, coalesce(n.h, a.win_h) AS wh,
  d.code IS NOT NULL OR n.code IS NOT NULL AS hit FROM {walls} a LEFT JOIN k d ON d.project_id = a.project_id AND d.code = upper(trim(a.door_code)) LEFT JOIN k n ON n.project_id = a.project_id AND n.code = upper(trim(a.win_code))),
lk AS (SELECT project_id, seq, hit AS link_updated, (has_door OR has_window) AND door_code IS NULL AND win_code IS NULL AS link_unresolved,
  (CASE WHEN door_code IS NOT NULL THEN dw * dh ELSE 0e0 END) + (CASE WHEN win_code IS NOT NULL THEN ww * wh ELSE 0e0 END) AS area, length_m * height_m AS wall_area, door_code IS NOT NULL OR win_code IS NOT NULL AS has FROM j)"""


@query("WITH " + LINKED + " SELECT project_id, seq, link_updated, link_unresolved, has AND wall_area > 0 AND area > wall_area AS link_conflict, floor(area * 1e4 + 5e-1) / 1e4 AS area FROM lk")
def link_openings(t):
    out = fuse.link_openings(t.walls(), t("sched_openings"))
    return out.select("project_id", "seq", "link_updated", "link_unresolved", "link_conflict", half_up("opening_area_m2", 4).alias("area"))


@query(
    "WITH "
    + LINKED
    + " SELECT project_id, count(*) FILTER (link_updated) AS updated, count(*) FILTER (link_unresolved) AS unresolved, count(*) FILTER (has AND wall_area > 0 AND area > wall_area) AS conflicts FROM lk GROUP BY 1"
)
def link_stats(t):
    return fuse.link_stats(fuse.link_openings(t.walls(), t("sched_openings")))


REFS = """rf AS (SELECT project_id, level, max(area_m2) FILTER (area_kind IN ('total', 'roofed')) AS total, max(area_m2) FILTER (area_kind = 'roofed') AS roofed,
  floor(sum(area_m2) FILTER (area_kind NOT IN ('total', 'roofed')) * 1e6 + 5e-1) / 1e6 AS rooms FROM {sched_areas} WHERE area_m2 > 0 GROUP BY 1, 2)"""
RECONCILED = (
    REFS
    + """, rk AS (SELECT *, CASE WHEN slab_class = 'roof' THEN 'roof' ELSE 'floor' END AS g, row_number() OVER (PARTITION BY project_id, level, CASE WHEN slab_class = 'roof' THEN 'roof' ELSE 'floor' END ORDER BY seq) AS rn FROM {slabs}),
rj AS (SELECT rk.*, rf.total, rf.roofed, rf.rooms FROM rk LEFT JOIN rf ON rk.project_id = rf.project_id AND rk.level = rf.level),
ra AS (SELECT *, rn = 1 AND g = 'roof' AND roofed IS NOT NULL AS ro, rn = 1 AND g = 'floor' AND coalesce(total, rooms) IS NOT NULL AND source <> 'table' AND (total IS NOT NULL OR area_m2 <= 0 OR abs(area_m2 - coalesce(total, rooms)) / coalesce(total, rooms) > 15e-2) AS fo FROM rj),
rc AS (SELECT project_id, level, slab_class, slab_id, CASE WHEN ro THEN roofed WHEN fo THEN coalesce(total, rooms) ELSE area_m2 END AS area_m2, CASE WHEN ro THEN 'table_area_total' WHEN fo THEN CASE WHEN total IS NOT NULL THEN 'table_area_total' ELSE 'table_sum_rooms' END ELSE source END AS source FROM ra
  UNION ALL SELECT project_id, level, 'roof', 'LCT_' || level, roofed, 'table_area_total' FROM rf WHERE roofed IS NOT NULL AND NOT EXISTS (SELECT 1 FROM rk WHERE rk.project_id = rf.project_id AND rk.level = rf.level AND g = 'roof')
  UNION ALL SELECT project_id, level, 'floor', 'LT_' || level, total, 'table_area_total' FROM rf WHERE total IS NOT NULL AND NOT EXISTS (SELECT 1 FROM rk WHERE rk.project_id = rf.project_id AND rk.level = rf.level AND g = 'floor'))"""
)


@query("WITH " + RECONCILED + " SELECT project_id, level, slab_class, slab_id, area_m2, source FROM rc")
def reconcile_slab_area(t):
    return fuse.reconcile_slab_area(t("slabs"), t("sched_areas")).select("project_id", "level", "slab_class", "slab_id", "area_m2", "source")


@query(
    "WITH "
    + REFS
    + """, x AS (SELECT s.*, rf.total, coalesce(area_m2 > rf.total * 105e-2, false) AS o FROM {slabs} s LEFT JOIN rf ON rf.project_id = s.project_id AND rf.level = s.level)
SELECT project_id, seq, CASE WHEN o THEN total ELSE area_m2 END AS area_m2, source || CASE WHEN o THEN '_capped_by_table' ELSE '' END AS source, CASE WHEN o THEN greatest(confidence, 9e-1) ELSE confidence END AS confidence FROM x"""
)
def cap_slab_area(t):
    return fuse.cap_slab_area(t("slabs"), t("sched_areas")).select("project_id", "seq", "area_m2", "source", "confidence")


BEST = """bs AS (SELECT project_id, lower(trim(level)) AS k, arg_max(ceiling_m, confidence * 1e12 - seq) AS c, arg_max(seq, confidence * 1e12 - seq) AS sq FROM {sections} WHERE confidence >= 6e-1 GROUP BY 1, 2),
tk AS (SELECT *, CASE WHEN k = 'terreo' OR k = 'pav. terreo' THEN 'kw:terreo' WHEN k = '1 pavimento' THEN 'ord:1' WHEN k = 'pavimento 2' THEN 'ord:2' WHEN k = '10 pavimento' THEN 'ord:10' ELSE 'kw:mezanino' END AS tok FROM bs),
bt AS (SELECT project_id, tok, arg_min(c, sq) AS c FROM tk GROUP BY 1, 2)"""


@query("WITH " + BEST + " SELECT project_id, k AS level_key, c AS ceiling_m FROM bs")
def best_section(t):
    return fuse.best_section(t("sections")).select("project_id", "level_key", "ceiling_m")


SECTIONED = (
    DEFAULTED
    + ", "
    + BEST
    + """, sl AS (SELECT w.*, CASE level WHEN 'Terreo' THEN 'kw:terreo' WHEN '1 Pavimento' THEN 'ord:1' WHEN '2 Pavimento' THEN 'ord:2' ELSE 'kw:cobertura' END AS tok FROM w),
sj AS (SELECT sl.*, coalesce(n.c, x.c) AS c FROM sl LEFT JOIN bs n ON n.project_id = sl.project_id AND n.k = lower(sl.level) LEFT JOIN bt x ON x.project_id = sl.project_id AND x.tok = sl.tok),
so AS (SELECT *, CASE WHEN c IS NULL THEN CASE WHEN height_source = 'default' THEN 'pending' ELSE 'none' END WHEN height_m > 0 AND abs(height_m - c) <= 5e-2 AND height_source <> 'default' THEN 'confirmed' ELSE 'applied' END AS section_outcome FROM sj)"""
)


@query("WITH " + SECTIONED + " SELECT project_id, seq, section_outcome, CASE WHEN section_outcome = 'applied' THEN c ELSE height_m END AS height_m FROM so")
def apply_sections(t):
    return fuse.apply_sections(_walls(t), t("sections")).select("project_id", "seq", "section_outcome", "height_m")


@query(
    "WITH "
    + SECTIONED
    + " SELECT project_id, count(*) FILTER (section_outcome = 'applied') AS heights_applied, count(DISTINCT level) FILTER (c IS NOT NULL) AS levels_confirmed, CASE WHEN count(DISTINCT level) > 1 THEN count(DISTINCT level) - count(DISTINCT level) FILTER (c IS NOT NULL) ELSE 0 END AS levels_pending FROM so GROUP BY 1"
)
def section_stats(t):
    return fuse.section_stats(fuse.apply_sections(_walls(t), t("sections")))


@query(
    """SELECT DISTINCT project_id, lower(level) AS level FROM (SELECT project_id, level FROM {walls} UNION SELECT project_id, level FROM {slabs}) EXCEPT SELECT project_id, lower(trim(level)) FROM {sections} WHERE confidence >= 6e-1"""
)
def levels_missing_section(t):
    every = t("walls").select("project_id", F.lower("level").alias("level")).union(t("slabs").select("project_id", F.lower("level").alias("level")))
    return every.subtract(fuse.best_section(t("sections")).select("project_id", F.col("level_key").alias("level")))


DEDUPED = (
    DEFAULTED
    + """, sg AS (SELECT *, level || '|' || wall_class || '|' || CAST(floor(length_m * 20 + 5e-1) AS BIGINT) || '|' || CAST(floor(height_m * 20 + 5e-1) AS BIGINT) || '|' || CASE WHEN door_code IS NULL AND win_code IS NULL THEN '0' WHEN win_code IS NULL THEN 'd' || CAST(floor(dw * 10 + 5e-1) AS BIGINT)
  WHEN door_code IS NULL THEN 'w' || CAST(floor(ww * 10 + 5e-1) AS BIGINT) ELSE 'd' || CAST(floor(dw * 10 + 5e-1) AS BIGINT) || ',w' || CAST(floor(ww * 10 + 5e-1) AS BIGINT) END AS sig FROM w),
dw_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, sig ORDER BY seq) AS rn FROM sg) WHERE rn = 1)"""
)


@query("WITH " + DEDUPED + " SELECT project_id, seq FROM dw_")
def dedup_walls(t):
    return fuse.dedup_walls(_walls(t)).select("project_id", "seq")


@query("SELECT project_id, min(seq) AS seq FROM {slabs} GROUP BY project_id, level, slab_class, floor(area_m2 * 20 + 5e-1)")
def dedup_slabs(t):
    return fuse.dedup_slabs(t("slabs")).select("project_id", "seq")


DOMINANT = """pg AS (SELECT project_id, level, wall_class, page_index, count(*) AS n, floor(sum(length_m) * 1e6 + 5e-1) / 1e6 AS len, min(seq) AS fs FROM {walls} GROUP BY 1, 2, 3, 4),
bp AS (SELECT *, row_number() OVER (PARTITION BY project_id, level, wall_class ORDER BY n DESC, len DESC, fs) AS rn, sum(n) OVER (PARTITION BY project_id, level, wall_class) AS tn, count(*) OVER (PARTITION BY project_id, level, wall_class) AS np FROM pg)"""


@query(
    "WITH "
    + DOMINANT
    + " SELECT a.project_id, a.seq FROM {walls} a JOIN bp ON bp.rn = 1 AND bp.project_id = a.project_id AND bp.level = a.level AND bp.wall_class = a.wall_class WHERE np <= 1 OR tn <= 30 OR a.page_index = bp.page_index"
)
def dominant_page(t):
    return fuse.dominant_page(t("walls")).select("project_id", "seq")


@query(
    """WITH RECURSIVE d AS (SELECT project_id, min(seq) AS seq FROM {slabs} GROUP BY project_id, level, slab_class, floor(area_m2 * 20 + 5e-1)),
o AS MATERIALIZED (SELECT {'p': s.project_id, 'v': level, 'c': slab_class} AS g, s.seq, area_m2 AS a, row_number() OVER (PARTITION BY s.project_id, level, slab_class ORDER BY confidence DESC, area_m2 DESC, s.seq) AS rn FROM {slabs} s JOIN d ON d.project_id = s.project_id AND d.seq = s.seq),
r AS (SELECT g, rn, seq, true AS ok, [a] AS kept FROM o WHERE rn = 1 UNION ALL SELECT g, rn, seq, ok, CASE WHEN ok THEN list_append(kept, a) ELSE kept END FROM
  (SELECT o.g, o.rn, o.seq, o.a, r.kept, len(list_filter(r.kept, lambda x: greatest(o.a, x) > 0 AND abs(o.a - x) / greatest(o.a, x) <= 3e-1)) = 0 AS ok FROM r JOIN o ON o.g = r.g AND o.rn = r.rn + 1))
SELECT s.* FROM {slabs} s JOIN r ON r.g.p = s.project_id AND r.seq = s.seq WHERE r.ok"""
)
def suppress_similar_slabs(t):
    return fuse.suppress_similar_slabs(fuse.dedup_slabs(t("slabs")))


@query(
    """WITH s AS (SELECT project_id, level, 0 AS kind, seq FROM {walls} UNION ALL SELECT project_id, level, 1, seq FROM {slabs}),
l AS (SELECT project_id, level, min(kind * 1000000000 + seq) AS f, CASE level WHEN 'Terreo' THEN 1 WHEN '1 Pavimento' THEN 2 WHEN '2 Pavimento' THEN 3 ELSE 5 END AS r FROM s GROUP BY 1, 2)
SELECT project_id, arg_min(level, r * 10000000000 + f) AS bottom, arg_max(level, r * 10000000000 + f) AS top FROM l GROUP BY 1"""
)
def floor_bounds(t):
    return fuse.floor_bounds(t("walls"), t("slabs"))


@query()
def infer_slabs(t):
    return fuse.infer_slabs(_walls(t), fuse.dedup_slabs(t("slabs")), t("slabs")).select("project_id", "level", "slab_class", "area_m2", "source", "confidence", "seq")


FAMILY = "CASE WHEN source LIKE 'pdf\\_vector%' ESCAPE '\\' THEN 'vector' WHEN source LIKE 'table%' THEN 'table' WHEN source = 'ai_vision_takeoff' THEN 'takeoff' ELSE 'ai' END"


@query(
    f"""WITH a AS (SELECT *, {FAMILY} AS fam FROM {{walls}}), s AS (SELECT project_id, level, fam, floor(sum(length_m) * 1e6 + 5e-1) / 1e6 AS len FROM a WHERE wall_class = 'external' GROUP BY 1, 2, 3 HAVING sum(length_m) > 0),
r AS (SELECT project_id, level, max(len) FILTER (fam = 'vector') AS v, max(len) FILTER (fam = 'table') AS t, list_sort(list(len)) AS l FROM s GROUP BY 1, 2 HAVING count(*) >= 2),
q AS (SELECT *, coalesce(v, t, l[len(l) // 2 + 1]) AS ref, CASE WHEN v IS NOT NULL THEN 'vector' WHEN t IS NOT NULL THEN 'table' END AS truth FROM r),
b AS (SELECT s.* FROM s JOIN q ON q.project_id = s.project_id AND q.level = s.level WHERE s.fam IS DISTINCT FROM q.truth AND abs(s.len - q.ref) / q.ref > 5e-1)
SELECT a.project_id, a.seq, b.fam IS NOT NULL AND a.wall_class = 'external' AS needs_review, CASE WHEN b.fam IS NOT NULL AND a.wall_class = 'external' THEN least(a.confidence, 55e-2) ELSE a.confidence END AS confidence
FROM a LEFT JOIN b ON b.project_id = a.project_id AND b.level = a.level AND b.fam = a.fam"""
)
def perimeter_audit(t):
    return fuse.perimeter_audit(t("walls")).select("project_id", "seq", "needs_review", "confidence")


@query(
    """WITH b AS (SELECT project_id, level, seq, wall_class, confidence, xmax - xmin >= ymax - ymin AS h, CASE WHEN xmax - xmin >= ymax - ymin THEN (ymin + ymax) / 2 ELSE (xmin + xmax) / 2 END AS ax,
  CASE WHEN xmax - xmin >= ymax - ymin THEN xmin ELSE ymin END AS s, CASE WHEN xmax - xmin >= ymax - ymin THEN xmax ELSE ymax END AS e FROM {walls} WHERE xmin IS NOT NULL),
p AS (SELECT i.project_id, i.seq, min(o.seq) AS o FROM b i JOIN b o ON i.project_id = o.project_id AND i.level = o.level AND i.h = o.h AND i.wall_class = 'internal' AND o.wall_class = 'external'
  WHERE abs(i.ax - o.ax) <= 30 AND i.e > i.s AND o.e > o.s AND greatest(0, least(i.e, o.e) - greatest(i.s, o.s)) / least(i.e - i.s, o.e - o.s) >= 3e-1 GROUP BY 1, 2),
n AS (SELECT DISTINCT project_id, o FROM p)
SELECT w.project_id, w.seq, n.o IS NOT NULL AS needs_review, CASE WHEN n.o IS NOT NULL THEN least(w.confidence, 7e-1) ELSE w.confidence END AS confidence FROM {walls} w
LEFT JOIN n ON n.project_id = w.project_id AND n.o = w.seq WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.project_id = w.project_id AND p.seq = w.seq)"""
)
def drop_overlapped_internal(t):
    return fuse.drop_overlapped_internal(t.walls()).select("project_id", "seq", "needs_review", "confidence")


RANK = "CASE level WHEN 'Terreo' THEN 0 WHEN '1 Pavimento' THEN 1 WHEN '2 Pavimento' THEN 100 ELSE 3 END"


@query(
    f"""WITH w AS (SELECT project_id, seq, wall_class, row_number() OVER (PARTITION BY project_id, wall_class = 'boundary' ORDER BY {RANK}, level, wall_class <> 'external', length_m DESC, seq) AS n FROM {{walls}}),
s AS (SELECT project_id, seq, row_number() OVER (PARTITION BY project_id ORDER BY {RANK}, level, CASE slab_class WHEN 'roof' THEN 0 WHEN 'floor' THEN 1 ELSE 2 END, area_m2 DESC, seq) AS n FROM {{slabs}})
SELECT project_id, seq, 'wall' AS kind, CASE WHEN wall_class = 'boundary' THEN 'M' ELSE 'W' END || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS label FROM w
UNION ALL SELECT project_id, seq, 'slab', 'L' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END FROM s"""
)
def display_labels(t):
    walls, slabs = fuse.display_labels(t("walls"), t("slabs"))
    return walls.select("project_id", "seq", F.lit("wall").alias("kind"), "label").union(slabs.select("project_id", "seq", F.lit("slab").alias("kind"), "label"))


SCORED = (
    DEFAULTED
    + """, x AS (SELECT w.*, coalesce(p.building_type, 'generico') AS bt, length_m + CASE WHEN has_window THEN 2e0 ELSE 0e0 END + CASE WHEN has_door AND (door_code IS NOT NULL AND dw >= 1 OR win_code IS NOT NULL AND ww >= 1) THEN 15e-1 ELSE 0e0 END
  + CASE WHEN ymin < 100 OR xmin < 100 OR ymax > 900 OR xmax > 900 THEN 3e0 ELSE 0e0 END AS score FROM w JOIN {projects} p ON p.project_id = w.project_id),
y AS (SELECT *, wall_class <> 'boundary' AS inn, CASE bt WHEN 'residencial' THEN 35e-2 WHEN 'comercial' THEN 4e-1 WHEN 'institucional' THEN 3e-1 WHEN 'industrial' THEN 6e-1 ELSE 35e-2 END AS fr, CASE bt WHEN 'residencial' THEN 8 WHEN 'comercial' THEN 10 WHEN 'institucional' THEN 12 WHEN 'industrial' THEN 6 ELSE 8 END AS mx FROM x),
sc AS (SELECT *, row_number() OVER (PARTITION BY project_id, inn ORDER BY score DESC, seq) AS rk, count(*) FILTER (inn) OVER (PARTITION BY project_id) AS n, greatest(max(score) FILTER (inn) OVER (PARTITION BY project_id), 1e0) AS hi, least(min(score) FILTER (inn) OVER (PARTITION BY project_id), 0e0) AS lo FROM y)"""
)


def _typed(t):
    return _walls(t).join(t("projects").select("project_id", "building_type"), "project_id")


@query("WITH " + SCORED + " SELECT project_id, seq, floor(score * 1e4 + 5e-1) / 1e4 AS score FROM sc")
def external_score(t):
    return _walls(t).select("project_id", "seq", half_up(classify.external_score(), 4).alias("score"))


@query("WITH " + SCORED + ", ex AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, seq) AS r2, count(*) OVER (PARTITION BY project_id) AS n2 FROM sc WHERE wall_class = 'external') SELECT project_id, seq, CASE WHEN n2 >= 6 AND bt <> 'industrial' AND r2 > least(ceil(n2 * fr), mx) THEN 'internal' ELSE 'external' END AS wall_class FROM ex")
def reclassify_by_score(t):
    # projects in which every wall came out external
    own = _typed(t).filter("wall_class = 'external'")
    return classify.reclassify_by_score(own, dims.heuristics(t.spark)).select("project_id", "seq", "wall_class")


@query(
    "WITH "
    + SCORED
    + """ SELECT project_id, seq, n >= 4 AND inn AND (wall_class = 'external' AND (score - lo) / greatest(hi - lo, 1e-3) < 35e-2 AND rk > least(ceil(n * fr), mx)
  OR wall_class = 'internal' AND (score - lo) / greatest(hi - lo, 1e-3) > 7e-1 AND rk <= least(ceil(n * fr), mx)) AS needs_review FROM sc"""
)
def flag_class_vs_score(t):
    return classify.flag_class_vs_score(_typed(t), dims.heuristics(t.spark)).select("project_id", "seq", "needs_review")


VOTES = (
    """fb AS (SELECT f.*, """
    + SIGNATURE
    + """ AS signature, lower(trim(p.client_name)) AS client, p.client_name AS cn, CASE WHEN is_exemplar THEN 3 WHEN action IN ('correct', 'exemplar') THEN 2 WHEN action = 'not_wall' THEN 1 ELSE 0 END AS tier FROM {feedback} f JOIN {projects} p ON p.project_id = f.project_id WHERE active AND action <> 'confirm'),
vt AS (SELECT CASE WHEN tier < 3 THEN client END AS client, signature, tier, CASE WHEN action = 'not_wall' THEN 'not_wall' ELSE coalesce(corrected_class, 'none') END AS decision, count(DISTINCT CASE WHEN user_id IS NOT NULL THEN 'u' || CAST(user_id AS VARCHAR) ELSE 'c:' || cn END) AS voters, min(id) AS fid FROM fb GROUP BY 1, 2, 3, 4),
bv AS (SELECT *, row_number() OVER (PARTITION BY client, signature, tier ORDER BY voters DESC, fid) AS rn FROM vt),
vv AS (SELECT client, signature, tier, decision, voters, voters >= CASE WHEN tier >= 3 THEN 1 ELSE 2 END AS quorum FROM bv WHERE rn = 1)"""
)


@query("WITH " + VOTES + " SELECT client, signature, tier, decision, voters, quorum FROM vv")
def feedback_vote(t):
    return classify.feedback_vote(t("feedback"), t("projects"))


@query("WITH " + VOTES + " SELECT client, signature, tier, decision, voters, quorum FROM vv")
def feedback_vote_sketches(t):
    """Sketches of seven days, written and united on read; so few voters are counted exactly."""
    daily = staged(classify.vote_sketches(t("feedback"), t("projects"), F.col("id") % 7), "sketches")
    return classify.vote_by_sketches(daily)


@query(
    "WITH "
    + VOTES
    + """, w AS (SELECT a.*, lower(trim(p.client_name)) AS client, CAST(floor(thickness_m * 100 + 5e-1) AS BIGINT) || '|' || CAST(floor(length_m * 10 + 5e-1) AS BIGINT) || '|' || CASE WHEN has_window THEN '1' ELSE '0' END || '|' || CASE WHEN has_door THEN '1' ELSE '0' END || '|' || wall_class AS signature FROM {walls} a JOIN {projects} p ON p.project_id = a.project_id),
o AS (SELECT client, signature, arg_max(decision, tier) AS decision, arg_max(quorum, tier) AS quorum FROM vv WHERE tier < 3 GROUP BY 1, 2),
j AS (SELECT w.*, CASE WHEN c.signature IS NOT NULL THEN c.decision ELSE o.decision END AS dec, coalesce(CASE WHEN c.signature IS NOT NULL THEN c.quorum ELSE o.quorum END, false) AS q FROM w LEFT JOIN vv c ON c.tier = 3 AND c.signature = w.signature LEFT JOIN o ON o.client = w.client AND o.signature = w.signature)
SELECT project_id, seq, CASE WHEN q AND dec IN ('external', 'internal', 'boundary') THEN dec ELSE wall_class END AS wall_class, source || CASE WHEN q AND dec IN ('external', 'internal', 'boundary') AND dec <> wall_class THEN '_feedback_override' ELSE '' END AS source FROM j WHERE NOT (q AND dec = 'not_wall')"""
)
def feedback_override(t):
    return classify.feedback_override(t("walls"), t("feedback"), t("projects")).select("project_id", "seq", "wall_class", "source")


@query(
    """WITH h AS (SELECT * FROM {side_hints}), b AS (SELECT project_id, seq, level, wall_class, xmax - xmin >= ymax - ymin AS f, (xmin + xmax) / 2 AS cx, (ymin + ymax) / 2 AS cy FROM {walls} WHERE xmin IS NOT NULL AND wall_class <> 'boundary'),
k AS (SELECT b.*, CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.project_id = b.project_id AND h.level = b.level) THEN b.level ELSE 'all' END AS hl FROM b),
p AS (SELECT *, CASE WHEN f THEN cx ELSE cx - 50 END AS ax, CASE WHEN f THEN cy - 50 ELSE cy END AS ay, CASE WHEN f THEN cx ELSE cx + 50 END AS bx, CASE WHEN f THEN cy + 50 ELSE cy END AS by_ FROM k),
n AS (SELECT p.project_id, p.seq, p.wall_class, arg_min(h.side, struct_pack(d := (h.x - ax) * (h.x - ax) + (h.y - ay) * (h.y - ay), s := h.seq)) AS s1, arg_min(h.side, struct_pack(d := (h.x - bx) * (h.x - bx) + (h.y - by_) * (h.y - by_), s := h.seq)) AS s2 FROM p JOIN h ON h.project_id = p.project_id AND h.level = p.hl GROUP BY 1, 2, 3),
t AS (SELECT *, CASE WHEN s1 <> s2 THEN 'external' WHEN s1 = 'interior' THEN 'internal' END AS target FROM n)
SELECT w.project_id, w.seq, coalesce(t.target, w.wall_class) AS wall_class, coalesce(t.target <> w.wall_class, false) AS hinted FROM {walls} w LEFT JOIN t ON t.project_id = w.project_id AND t.seq = w.seq"""
)
def nearest_hint_class(t):
    return classify.nearest_hint_class(t.walls(), t("side_hints")).select("project_id", "seq", "wall_class", "hinted")


def inside(x: str, y: str) -> str:
    """SQL of the L-shaped envelope of the adapter, with the ray cast's rule for edges."""
    return f"({y} >= y0 AND {y} < 52e1 AND {x} >= x0 AND {x} < x1 OR {y} >= 52e1 AND {y} < y1 AND {x} >= x0 AND {x} < 5e2)"


def lot(x: str, y: str) -> str:
    return f"(has_lot AND {y} >= 0 AND {y} < 700 AND {x} >= 0 AND {x} < 1000)"


@query(
    f"""WITH b AS (SELECT w.project_id, w.seq, w.wall_class, (xmin + xmax) / 2 AS cx, (ymin + ymax) / 2 AS cy, xmax - xmin >= ymax - ymin AS f, greatest(CASE WHEN xmax - xmin >= ymax - ymin THEN ymax - ymin ELSE xmax - xmin END / 2 + 2e1, 25e0) AS o,
  e.x0, e.y0, e.x1, e.y1, e.has_lot, e.project_id IS NOT NULL AND xmin IS NOT NULL AS known FROM {{walls}} w LEFT JOIN {{envelopes}} e ON e.project_id = w.project_id AND lower(e.level) = lower(w.level)),
p AS (SELECT *, CASE WHEN f THEN cx ELSE cx - o END AS ax, CASE WHEN f THEN cy - o ELSE cy END AS ay, CASE WHEN f THEN cx ELSE cx + o END AS bx, CASE WHEN f THEN cy + o ELSE cy END AS by_ FROM b),
i AS (SELECT *, {inside("ax", "ay")} AS ia, {inside("bx", "by_")} AS ib, {lot("ax", "ay")} AND {lot("bx", "by_")} AS lt FROM p)
SELECT project_id, seq, CASE WHEN NOT known THEN wall_class WHEN ia AND ib THEN 'internal' WHEN NOT ia AND NOT ib AND lt THEN 'boundary' ELSE 'external' END AS wall_class, known AND NOT ia AND NOT ib AND NOT lt AS needs_review FROM i"""
)
def topology_class(t):
    return classify.topology_class(t.walls(), t.envelopes()).select("project_id", "seq", "wall_class", "needs_review")


@query(
    f"""WITH b AS (SELECT s.project_id, s.seq, (s.x1 + s.x2) / 2 AS cx, (s.y1 + s.y2) / 2 AS cy, CASE WHEN s.x2 > s.x1 THEN 1 ELSE 0 END AS hz, greatest(greatest(thickness_pct * 10, 2e1) / 2 + 2e1, 25e0) AS o, e.x0, e.y0, e.x1, e.y1, e.has_lot, e.project_id IS NOT NULL AS known
  FROM {{segments}} s LEFT JOIN {{envelopes}} e ON e.project_id = s.project_id AND lower(e.level) = lower(s.level)),
p AS (SELECT *, CASE WHEN hz = 1 THEN cx ELSE cx - o END AS ax, CASE WHEN hz = 1 THEN cy + o ELSE cy END AS ay, CASE WHEN hz = 1 THEN cx ELSE cx + o END AS bx, CASE WHEN hz = 1 THEN cy - o ELSE cy END AS by_ FROM b),
i AS (SELECT *, coalesce({inside("ax", "ay")}, false) AS ia, coalesce({inside("bx", "by_")}, false) AS ib, coalesce({lot("ax", "ay")} AND {lot("bx", "by_")}, false) AS lt FROM p)
SELECT project_id, seq, CASE WHEN ia AND ib THEN 'internal' WHEN NOT ia AND NOT ib AND lt THEN 'boundary' ELSE 'external' END AS wall_class FROM i"""
)
def segment_class(t):
    return classify.segment_class(t("segments"), t.envelopes()).select("project_id", "seq", "wall_class")


@query(
    """WITH v AS (SELECT project_id, CASE seq % 4 WHEN 0 THEN 'comercial' WHEN 1 THEN 'industrial' WHEN 2 THEN 'residencial' END AS dt, seq FROM {corners}), n AS (SELECT project_id, dt, count(*) AS n, min(seq) AS f FROM v WHERE dt IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY n DESC, f) AS rn FROM n) SELECT p.project_id, coalesce(p.building_type, r.dt) AS building_type FROM {projects} p LEFT JOIN r ON r.rn = 1 AND r.project_id = p.project_id"""
)
def building_type_vote(t):
    s = F.col("seq")
    pages = t("corners").select("project_id", "seq", F.when(s % 4 == 0, "comercial").when(s % 4 == 1, "industrial").when(s % 4 == 2, "residencial").alias("detected_type"))
    return classify.building_type_vote(pages, t("projects"))


@query()
def fusion(t):
    t.keep("wall_base")
    walls, slabs = pipelines.fuse_views(t.walls(), t("slabs"), t("sched_openings"), t("sched_areas"), t("projects"), dims.heuristics(t.spark), t("feedback"), t("side_hints"), t("sched_walls"))
    w = walls.select("project_id", F.col("wall_id").alias("element_id"), "level", F.col("wall_class").alias("element_class"), F.col("length_m").alias("measure"), "source", "needs_review")
    return w.unionByName(slabs.select("project_id", F.col("slab_id").alias("element_id"), "level", F.col("slab_class").alias("element_class"), F.col("area_m2").alias("measure"), "source", F.lit(False).alias("needs_review")))


@query()
def takeoff_budget(t):
    t.keep("wall_base")
    return pipelines.takeoff_to_budget(
        t.walls(), t("slabs"), t("corners"), t("sections"), t.envelopes(), t("sched_openings"), t("sched_areas"), t("projects"), dims.heuristics(t.spark), t("feedback"), t("side_hints")
    )[0]
