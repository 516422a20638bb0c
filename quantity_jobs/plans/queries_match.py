"""Spatial matching queries. What depends on order is recursive SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, match
from ..sources import io
from .catalogue import greedy_sql, query


def _segments(t):
    return clean.clean_segments(t("segments"))


def _texts(t):
    return clean.clean_dimensions(t("dimensions")).withColumn("page_index", (F.col("seq") % 3).cast("int"))


LEVEL_KEY = "lower(coalesce(nullif(level, ''), 'Terreo'))"
SEGS = """sg AS MATERIALIZED (SELECT project_id, seq, """ + LEVEL_KEY + """ AS lv, page_index, x1, y1, x2, y2, least(5e0, greatest(3e-1, CASE WHEN thickness_pct = 0 THEN 12e-1 ELSE thickness_pct END)) / 1e2 * 1e3 / 2 AS half,
  sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len, floor(((degrees(atan2(y2 - y1, x2 - x1)) % 180 + 180) % 180) * 1e9 + 5e-1) / 1e9 AS ang FROM {segments}
  WHERE x1 BETWEEN 0 AND 1000 AND x2 BETWEEN 0 AND 1000 AND y1 BETWEEN 0 AND 1000 AND y2 BETWEEN 0 AND 1000 AND sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) >= 5)"""
BOXES = "wb AS MATERIALIZED (SELECT project_id, seq, " + LEVEL_KEY + " AS lv, wall_class, length_m, ymin, xmin, ymax, xmax, (xmin + xmax) / 2 AS cx, (ymin + ymax) / 2 AS cy FROM {walls} WHERE xmin IS NOT NULL)"


def _overlap(a0: str, a1: str, b0: str, b1: str) -> str:
    return f"greatest(0e0, least({a1}, {b1}) - greatest({a0}, {b0}))"


def _iou(a: str, b: str) -> str:
    inter = f"({_overlap(f'{a}.xmin', f'{a}.xmax', f'{b}.xmin', f'{b}.xmax')} * {_overlap(f'{a}.ymin', f'{a}.ymax', f'{b}.ymin', f'{b}.ymax')})"
    area = lambda z: f"({z}.ymax - {z}.ymin) * ({z}.xmax - {z}.xmin)"
    return f"CASE WHEN {inter} > 0 THEN {inter} / ({area(a)} + {area(b)} - {inter}) ELSE 0e0 END"


@query(
    "WITH RECURSIVE "
    + SEGS
    + ", "
    + BOXES
    + """, sb AS MATERIALIZED (SELECT project_id, seq, lv, (x1 + x2) / 2 AS sx, (y1 + y2) / 2 AS sy, greatest(0e0, least(y1, y2) - half) AS ymin, greatest(0e0, least(x1, x2) - half) AS xmin, least(1e3, greatest(y1, y2) + half) AS ymax,
  least(1e3, greatest(x1, x2) + half) AS xmax FROM sg), lv AS (SELECT DISTINCT project_id, lv FROM sb),
p AS (SELECT w.project_id, w.seq AS l, s.seq AS x, """
    + _iou("w", "s")
    + """ AS iou, sqrt((cx - sx) * (cx - sx) + (cy - sy) * (cy - sy)) AS d, sqrt((w.xmax - w.xmin) * (w.xmax - w.xmin) + (w.ymax - w.ymin) * (w.ymax - w.ymin)) AS dg
  FROM wb w LEFT JOIN lv ON lv.project_id = w.project_id AND lv.lv = w.lv JOIN sb s ON s.project_id = w.project_id AND (lv.lv IS NULL OR w.lv IN ('outro', 'n/a', '', 'todos') OR s.lv = w.lv)),
q AS (SELECT *, floor((iou * 6e-1 + greatest(0e0, 1e0 - d / CASE WHEN dg = 0 THEN 1e0 ELSE dg END) * 4e-1) * 1e9 + 5e-1) / 1e9 AS score FROM p WHERE iou >= 1e-1 OR d < 60), """
    + greedy_sql("SELECT project_id AS g, l, list(x ORDER BY score DESC, x) AS cs FROM q WHERE score > 0 GROUP BY 1, 2")
    + " SELECT g AS project_id, l AS seq, pick AS seg_seq FROM greedy"
)
def match_endpoints(t):
    return match.match_endpoints(t.walls(), _segments(t))


MATCHED = (
    BOXES
    + """, dm AS MATERIALIZED (SELECT project_id, seq, """
    + LEVEL_KEY
    + """ AS lv, value_m, x, y, CASE WHEN orientation IN ('horizontal', 'vertical') THEN orientation ELSE 'unknown' END AS o FROM {dimensions} WHERE value_m > 0 AND value_m <= 50 AND x BETWEEN 0 AND 1000 AND y BETWEEN 0 AND 1000),
wd AS (SELECT *, CASE WHEN xmax - xmin > (ymax - ymin) * 15e-1 THEN 'horizontal' WHEN ymax - ymin > (xmax - xmin) * 15e-1 THEN 'vertical' END AS dir, least(18e1, greatest(6e1, greatest(xmax - xmin, ymax - ymin) * 6e-1)) AS r FROM wb),
mp AS (SELECT w.project_id, w.lv, w.seq AS l, d.seq AS x, sqrt((d.x - cx) * (d.x - cx) + (d.y - cy) * (d.y - cy)) AS d, r FROM wd w JOIN dm d ON d.project_id = w.project_id AND d.lv = w.lv AND (d.o = 'unknown' OR d.o = w.dir)
  WHERE dir IS NOT NULL AND CASE WHEN length_m > 2e-1 THEN value_m / length_m BETWEEN 4e-1 AND 25e-1 ELSE value_m BETWEEN 5e-1 AND 25 END), """
    + greedy_sql("SELECT {'p': project_id, 'v': lv} AS g, l, list(x ORDER BY floor(d * 1e9 + 5e-1), x) AS cs FROM mp WHERE d <= r GROUP BY 1, 2")
    + ", mt AS (SELECT g.p AS project_id, l AS seq, pick AS dim_seq, value_m FROM greedy JOIN dm ON dm.project_id = g.p AND dm.seq = pick)"
)


@query("WITH RECURSIVE " + MATCHED + " SELECT project_id, seq, dim_seq, value_m FROM mt")
def match_dimensions(t):
    return match.match_dimensions(t.walls(), clean.clean_dimensions(t("dimensions")))


@query(
    "WITH RECURSIVE "
    + MATCHED
    + """ SELECT w.project_id, w.seq, coalesce(value_m, length_m) AS length_m, CASE WHEN value_m IS NOT NULL THEN 'dimension_text' ELSE source END AS source, CASE WHEN value_m IS NOT NULL THEN greatest(confidence, 92e-2) ELSE confidence END AS confidence
FROM {walls} w LEFT JOIN mt ON mt.project_id = w.project_id AND mt.seq = w.seq"""
)
def apply_dimensions(t):
    walls = t.walls()
    out = match.apply_dimensions(walls, match.match_dimensions(walls, clean.clean_dimensions(t("dimensions"))))
    return out.select("project_id", "seq", "length_m", "source", "confidence")


@query(
    "WITH RECURSIVE "
    + BOXES
    + """, dp AS (SELECT a.project_id, a.lv, a.seq AS l, b.seq AS x, a.wall_class = b.wall_class AS same, floor(("""
    + _iou("a", "b")
    + """) * 1e9 + 5e-1) / 1e9 AS iou, floor(sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) * 1e9 + 5e-1) / 1e9 AS d FROM wb a JOIN wb b ON a.project_id = b.project_id AND a.lv = b.lv WHERE a.seq % 2 = 0 AND b.seq % 2 = 1),
o AS MATERIALIZED (SELECT *, {'p': project_id, 'v': lv} AS g, row_number() OVER (PARTITION BY project_id, lv ORDER BY iou DESC, d, l, x) AS rn FROM dp WHERE iou >= 4e-1 OR d < 50),
r AS (SELECT g, rn, l, x, same, true AS ok, [l] AS ul, [x] AS ux FROM o WHERE rn = 1 UNION ALL SELECT g, rn, l, x, same, ok, CASE WHEN ok THEN list_append(ul, l) ELSE ul END, CASE WHEN ok THEN list_append(ux, x) ELSE ux END FROM
  (SELECT o.g, o.rn, o.l, o.x, o.same, NOT list_contains(r.ul, o.l) AND NOT list_contains(r.ux, o.x) AS ok, r.ul, r.ux FROM r JOIN o ON o.g = r.g AND o.rn = r.rn + 1)),
k AS MATERIALIZED (SELECT g.p AS project_id, l, x, same FROM r WHERE ok), al AS (SELECT project_id, seq, """
    + LEVEL_KEY
    + """ AS lv FROM {walls})
SELECT project_id, l AS seq, x AS other_seq, CASE WHEN same THEN 'agree' ELSE 'disagree' END AS outcome FROM k
UNION ALL SELECT project_id, seq, NULL, 'only_a' FROM al WHERE seq % 2 = 0 AND (project_id, lv) IN (SELECT project_id, lv FROM al WHERE seq % 2 = 1) AND (project_id, seq) NOT IN (SELECT project_id, l FROM k)
UNION ALL SELECT project_id, NULL, seq, 'only_b' FROM al WHERE seq % 2 = 1 AND (project_id, seq) NOT IN (SELECT project_id, x FROM k)"""
)
def reconcile_detectors(t):
    walls = t.walls()
    return match.reconcile_detectors(walls.filter("seq % 2 = 0"), walls.filter("seq % 2 = 1"))


POLYGONS = """pl AS (SELECT project_id, level, 'floor' AS slab_class, page_index, floor(((x1 - x0) * (52e1 - y0) + (5e2 - x0) * (y1 - 52e1)) * 1e6 + 5e-1) / 1e6 AS a FROM {envelopes} UNION ALL
  SELECT project_id, level, 'floor', page_index + 1, 7e5 FROM {envelopes} WHERE has_lot)"""


def _polygons(t):
    env = t.envelopes()
    own = env.select("project_id", "level", F.lit("floor").alias("slab_class"), "page_index", "polygon")
    return own.unionByName(env.filter("lot_polygon IS NOT NULL").select("project_id", "level", F.lit("floor").alias("slab_class"), (F.col("page_index") + 1).alias("page_index"), F.col("lot_polygon").alias("polygon")))


@query(
    "WITH "
    + POLYGONS
    + """, rk AS (SELECT *, row_number() OVER (PARTITION BY project_id, lower(level), slab_class ORDER BY a DESC, page_index) AS n FROM pl), s AS (SELECT *, row_number() OVER (PARTITION BY project_id, lower(level), slab_class ORDER BY seq) AS n FROM {slabs})
SELECT s.project_id, s.seq, CASE WHEN rk.n IS NOT NULL AND s.source <> 'table' THEN 'polygon_focused' ELSE s.source END AS source, CASE WHEN rk.n IS NOT NULL THEN greatest(s.confidence, 85e-2) ELSE s.confidence END AS confidence
FROM s LEFT JOIN rk ON rk.project_id = s.project_id AND lower(rk.level) = lower(s.level) AND rk.slab_class = s.slab_class AND rk.n = s.n"""
)
def refine_slabs(t):
    return match.refine_slabs(t("slabs"), _polygons(t)).select("project_id", "seq", "source", "confidence")


def _pairs(t):
    return match.parallel_pairs(_segments(t))


# line b against line a: overlap along a, distances of both ends across it
ACROSS = """, ab AS (SELECT *, greatest(0e0, least(al, greatest(t1, t2)) - greatest(0e0, least(t1, t2))) AS over FROM (SELECT *, (bx1 - ax1) * ux + (by1 - ay1) * uy AS t1, (bx2 - ax1) * ux + (by2 - ay1) * uy AS t2,
  abs(-(bx1 - ax1) * uy + (by1 - ay1) * ux) AS o1, abs(-(bx2 - ax1) * uy + (by2 - ay1) * ux) AS o2 FROM (SELECT a.project_id, a.page_index, a.seq AS a, b.seq AS b, a.len AS al, b.len AS bl, abs(a.ang - b.ang) % 180 AS turn, a.lm AS am, b.lm AS bm,
  a.x1 AS ax1, a.y1 AS ay1, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2, (a.x2 - a.x1) / a.len AS ux, (a.y2 - a.y1) / a.len AS uy FROM ln a JOIN ln b ON a.project_id = b.project_id AND a.page_index = b.page_index AND a.seq <> b.seq)))"""


@query(
    "WITH RECURSIVE "
    + SEGS
    + ", ln AS MATERIALIZED (SELECT *, 0 AS lm FROM sg WHERE len >= 3e-1 * 1417e-2 AND len <= 30 * 1417e-2)"
    + ACROSS
    + """, pp AS MATERIALIZED (SELECT project_id, page_index, a, b, floor(over * 1e6 + 5e-1) / 1e6 AS over, floor((o1 + o2) / 2 * 1e6 + 5e-1) / 1e6 AS gap, al, bl FROM ab WHERE a < b AND least(turn, 180 - turn) <= 3),
pf AS MATERIALIZED (SELECT * FROM pp WHERE gap >= 8e-2 * 1417e-2 AND gap <= 3e-1 * 1417e-2 AND over >= least(al, bl) * 6e-1 AND over >= 3e-1 * 1417e-2), """
    + greedy_sql("SELECT {'p': project_id, 'i': page_index} AS g, a AS l, list(b ORDER BY over DESC, gap, b) AS cs FROM pf GROUP BY 1, 2", shared=True)
    + """ SELECT project_id, page_index, a, b, floor(gap / 1417e-2 * 1e6 + 5e-1) / 1e6 AS thickness_m, floor(over / 1417e-2 * 1e6 + 5e-1) / 1e6 AS length_m FROM greedy JOIN pf ON project_id = g.p AND page_index = g.i AND a = l AND b = pick"""
)
def parallel_pairs(t):
    return _pairs(t)


@query(
    "WITH RECURSIVE "
    + SEGS
    + ", ln AS MATERIALIZED (SELECT *, (seq % 50) / 5e0 AS lm FROM sg)"
    + ACROSS
    + """, cv AS (SELECT project_id, page_index, b, list(a) AS cover FROM ab WHERE (am > bm OR am = bm AND a < b) AND least(turn, 180 - turn) <= 5 AND greatest(o1, o2) <= 8e-2 * 6e-1 * 1417e-2 AND over / least(al, bl) >= 5e-1 GROUP BY 1, 2, 3),
o AS MATERIALIZED (SELECT {'p': ln.project_id, 'i': ln.page_index} AS g, seq, cover, row_number() OVER (PARTITION BY ln.project_id, ln.page_index ORDER BY lm DESC, seq) AS rn FROM ln LEFT JOIN cv ON cv.project_id = ln.project_id AND cv.page_index = ln.page_index AND cv.b = ln.seq),
r AS (SELECT g, rn, [seq] AS kept FROM o WHERE rn = 1 UNION ALL SELECT o.g, o.rn, CASE WHEN coalesce(list_has_any(r.kept, o.cover), false) THEN r.kept ELSE list_append(r.kept, o.seq) END FROM r JOIN o ON o.g = r.g AND o.rn = r.rn + 1),
e AS (SELECT g, unnest(arg_max(kept, rn)) AS seq FROM r GROUP BY g)
SELECT ln.project_id, ln.page_index, ln.seq, x1, y1, x2, y2, lm AS length_m FROM ln JOIN e ON e.g.p = ln.project_id AND e.g.i = ln.page_index AND e.seq = ln.seq"""
)
def dedup_wall_lines(t):
    return match.dedup_wall_lines(_segments(t).select("project_id", "page_index", "seq", "x1", "y1", "x2", "y2", (F.col("seq") % 50 / 5.0).alias("length_m")))


@query(
    "WITH "
    + SEGS
    + """, pg AS (SELECT project_id, page_index, sqrt(pow(greatest(max(x1), max(x2)) - least(min(x1), min(x2)), 2) + pow(greatest(max(y1), max(y2)) - least(min(y1), min(y2)), 2)) * 15e-1 AS reach FROM sg GROUP BY 1, 2),
n AS (SELECT sg.project_id, sg.page_index, seq, sign, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, sign * -(y2 - y1) / len AS nx, sign * (x2 - x1) / len AS ny, reach FROM sg JOIN pg ON pg.project_id = sg.project_id AND pg.page_index = sg.page_index CROSS JOIN (VALUES (1e0), (-1e0)) v(sign)),
ry AS (SELECT *, cx + nx * 21e-1 AS sx, cy + ny * 21e-1 AS sy, nx * (reach - 21e-1) AS dx, ny * (reach - 21e-1) AS dy FROM n),
m AS (SELECT r.project_id, r.page_index, r.seq, r.sign, r.dx * (o.y2 - o.y1) - r.dy * (o.x2 - o.x1) AS den, (o.x1 - sx) * (o.y2 - o.y1) - (o.y1 - sy) * (o.x2 - o.x1) AS tn, (o.x1 - sx) * dy - (o.y1 - sy) * dx AS un
  FROM ry r JOIN sg o ON o.project_id = r.project_id AND o.page_index = r.page_index AND o.seq <> r.seq),
h AS (SELECT DISTINCT project_id, page_index, seq, sign FROM m WHERE abs(den) >= 1e-9 AND tn / den > 1e-3 AND tn / den < 999e-3 AND un / den > 1e-3 AND un / den < 999e-3),
c AS (SELECT project_id, page_index, seq, count(*) AS n FROM h GROUP BY 1, 2, 3)
SELECT sg.project_id, sg.page_index, sg.seq, CASE WHEN c.n = 2 THEN 'internal' ELSE 'external' END AS wall_class FROM sg LEFT JOIN c ON c.project_id = sg.project_id AND c.page_index = sg.page_index AND c.seq = sg.seq"""
)
def raycast_class(t):
    own = _segments(t).select("project_id", "page_index", "seq", "x1", "y1", "x2", "y2", F.lit(4.0).alias("thickness"), F.lit(0.1).alias("eps"))
    return match.raycast_class(own)


@query(
    """WITH s AS (SELECT project_id, page_index, seq, x1, y1, x2, y2, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len FROM {segments} WHERE x1 BETWEEN 0 AND 1000 AND x2 BETWEEN 0 AND 1000 AND y1 BETWEEN 0 AND 1000 AND y2 BETWEEN 0 AND 1000
  AND sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) >= 5), m AS (SELECT project_id, page_index, greatest(3e1, max(len) * 4e-2) AS reach FROM s GROUP BY 1, 2),
t AS (SELECT project_id, CAST(seq % 3 AS INT) AS page_index, seq, x, y, value_m FROM {dimensions} WHERE value_m > 0 AND value_m <= 50 AND x BETWEEN 0 AND 1000 AND y BETWEEN 0 AND 1000),
p AS (SELECT t.project_id, t.page_index, t.seq, t.value_m, s.seq AS seg_seq, s.len, m.reach, least(1e0, greatest(0e0, ((t.x - x1) * (x2 - x1) + (t.y - y1) * (y2 - y1)) / (len * len))) AS u, t.x, t.y, x1, y1, x2, y2 FROM t JOIN m ON m.project_id = t.project_id AND m.page_index = t.page_index JOIN s ON s.project_id = t.project_id AND s.page_index = t.page_index),
d AS (SELECT *, floor(sqrt(pow(x - (x1 + u * (x2 - x1)), 2) + pow(y - (y1 + u * (y2 - y1)), 2)) * 1e9 + 5e-1) / 1e9 AS d FROM p), b AS (SELECT *, row_number() OVER (PARTITION BY project_id, page_index, seq ORDER BY d, seg_seq) AS rn FROM d WHERE d < reach)
SELECT project_id, page_index, seq, seg_seq, floor(len / value_m * 1e6 + 5e-1) / 1e6 AS ratio FROM b WHERE rn = 1 AND len > 5"""
)
def text_to_segment(t):
    return match.text_to_segment(_texts(t), _segments(t))


@query(
    """WITH r AS (SELECT project_id, CAST(seq % 3 AS INT) AS page_index, floor(value_m * 10 + seq % 7 + 1) / 1e0 AS ratio FROM {dimensions}), s AS (SELECT project_id, page_index, list_sort(list(ratio)) AS l, count(*) AS n FROM r GROUP BY 1, 2),
w AS (SELECT a.project_id, a.page_index, a.ratio, count(*) AS size, list_sort(list(b.ratio)) AS m FROM (SELECT DISTINCT * FROM r) a JOIN r b ON b.project_id = a.project_id AND b.page_index = a.page_index AND ln(b.ratio) - ln(a.ratio) BETWEEN 0 AND 0.13976194237515868 GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY project_id, page_index ORDER BY size DESC, ratio) AS rn FROM w), j AS (SELECT s.*, k.size, k.m[len(k.m) // 2 + 1] AS center, l[len(l) // 2 + 1] AS mid FROM s JOIN k ON k.rn = 1 AND k.project_id = s.project_id AND k.page_index = s.page_index),
e AS (SELECT *, list_filter(l, lambda r: r >= mid * 75e-2 AND r <= mid * 125e-2) AS band FROM j)
SELECT project_id, page_index, CASE WHEN n >= 3 AND size >= 3 AND size / n >= 4e-1 THEN center WHEN n >= 3 AND len(band) / n >= 55e-2 THEN band[len(band) // 2 + 1] ELSE 1417e-2 END AS scale,
  CASE WHEN n >= 3 AND size >= 3 AND size / n >= 4e-1 THEN 'cluster' WHEN n >= 3 AND len(band) / n >= 55e-2 THEN 'band' ELSE 'default' END AS source, n FROM e"""
)
def detect_scale(t):
    own = t("dimensions").select("project_id", (F.col("seq") % 3).cast("int").alias("page_index"), F.floor(F.col("value_m") * 10 + F.col("seq") % 7 + 1).cast("double").alias("ratio"))
    return match.detect_scale(own)


@query(
    """WITH r AS (SELECT project_id, page_index, x0, y0, level FROM {envelopes}), t AS (SELECT project_id, CAST(seq % 3 AS INT) AS page_index, seq, x, y, text FROM {dimensions} WHERE text LIKE 'SALA%'),
d AS (SELECT r.project_id, r.page_index, r.level, t.text, row_number() OVER (PARTITION BY r.project_id, r.page_index, r.level ORDER BY floor(((t.x - x0) * (t.x - x0) + (t.y - y0) * (t.y - y0)) * 1e6 + 5e-1), t.seq) AS rn FROM r JOIN t ON t.project_id = r.project_id AND t.page_index = r.page_index)
SELECT r.project_id, r.page_index, r.level AS room_seq, d.text AS label FROM r LEFT JOIN d ON d.rn = 1 AND d.project_id = r.project_id AND d.page_index = r.page_index AND d.level = r.level"""
)
def room_labels(t):
    rooms = t("envelopes").select("project_id", "page_index", F.col("level").alias("room_seq"), F.col("x0").alias("cx"), F.col("y0").alias("cy"))
    texts = t("dimensions").filter("text LIKE 'SALA%'").withColumn("page_index", (F.col("seq") % 3).cast("int"))
    return match.room_labels(rooms, texts)


@query(
    "WITH RECURSIVE "
    + SEGS
    + """, f AS (SELECT *, abs(x2 - x1) >= abs(y2 - y1) AS flat FROM sg), s AS (SELECT project_id, page_index, flat, seq, CASE WHEN flat THEN (y1 + y2) / 2 ELSE (x1 + x2) / 2 END AS line, CASE WHEN flat THEN least(y1, y2) ELSE least(x1, x2) END AS low, CASE WHEN flat THEN least(x1, x2) ELSE least(y1, y2) END AS a,
  CASE WHEN flat THEN greatest(x1, x2) ELSE greatest(y1, y2) END AS b FROM f),
o AS MATERIALIZED (SELECT *, {'p': project_id, 'i': page_index, 'f': flat} AS g, row_number() OVER (PARTITION BY project_id, page_index, flat ORDER BY low, a, seq) AS rn FROM s),
r AS (SELECT g, rn, 0 AS n, line AS l0, b AS upto, line, a, b FROM o WHERE rn = 1 UNION ALL SELECT g, rn, CASE WHEN fits THEN n ELSE n + 1 END, CASE WHEN fits THEN trunc(l0) ELSE line END, CASE WHEN fits THEN greatest(upto, b) ELSE b END, line, a, b FROM
  (SELECT o.g, o.rn, r.n, r.l0, r.upto, o.line, o.a, o.b, abs(o.line - r.l0) <= 8 AND o.a - r.upto <= 15 AS fits FROM r JOIN o ON o.g = r.g AND o.rn = r.rn + 1))
SELECT g.p AS project_id, g.i AS page_index, g.f AS flat, arg_max(l0, rn) AS line, min(a) AS start, max(b) AS end, count(*) AS members FROM r GROUP BY g, n"""
)
def merge_collinear(t):
    return match.merge_collinear(_segments(t))


@query()
def merge_touching(t):
    return match.merge_touching(_segments(t))


def _bim(t):
    """Relation tables out of walls: a storey per level, properties of some walls, an opening per door."""
    # nine relations are cut out of them
    w, s = io.staged(t("walls").select("project_id", "seq", "level", "wall_class", "length_m", "height_m", "thickness_m", "door_code", "door_w", "door_h"), "walls"), F.col("seq")
    elements = w.select("project_id", F.concat(F.lit("e"), s.cast("string")).alias("element_id"), F.when(s % 5 == 4, "slab").otherwise("wall").alias("kind"), F.col("thickness_m").alias("ext_x"), (-F.col("length_m")).alias("ext_y"), F.col("height_m").alias("ext_z"))
    doors = w.filter("door_code IS NOT NULL").select("project_id", F.concat(F.lit("d"), s.cast("string")).alias("element_id"), F.lit("door").alias("kind"), F.lit(0.1).alias("ext_x"), F.col("door_w").alias("ext_y"), F.col("door_h").alias("ext_z"))
    rel = lambda df, kind, a, b: df.select("project_id", F.lit(kind).alias("rel"), a.alias("parent_id"), b.alias("child_id"))
    ident = lambda letter: F.concat(F.lit(letter), s.cast("string"))
    some = w.filter("door_code IS NOT NULL")
    rels = rel(w, "storey", F.concat(F.lit("L"), "level"), ident("e")).unionByName(rel(some, "voids", ident("e"), ident("o"))).unionByName(rel(some, "fills", ident("o"), ident("d")))
    prop = lambda df, key, n, name, value: df.select("project_id", key.alias("element_id"), F.lit(n).alias("ordinal"), F.lit(name).alias("name"), value.cast("string").alias("value"))
    levels = w.select("project_id", "level").distinct()
    props = (
        prop(levels, F.concat(F.lit("L"), "level"), 0, "storey_name", F.col("level"))
        .unionByName(prop(w.filter("seq % 3 = 0"), ident("e"), 0, "length", F.col("length_m") * 2))
        .unionByName(prop(w.filter("seq % 3 = 0"), ident("e"), 1, "length", F.lit(99)))
        .unionByName(prop(w.filter("wall_class = 'external'"), ident("e"), 0, "is_external", F.lit("TRUE")))
    )
    return elements.unionByName(doors), rels, props


@query(
    """SELECT project_id, 'e' || CAST(seq AS VARCHAR) AS wall_id, level, CASE WHEN wall_class = 'external' THEN 'external' ELSE 'internal' END AS wall_class, CASE WHEN seq % 3 = 0 AND length_m > 0 THEN length_m * 2 ELSE greatest(length_m, thickness_m) END AS length_m,
  floor(CASE WHEN door_code IS NOT NULL THEN greatest(door_w, 1e-1) * door_h ELSE 0e0 END * 1e4 + 5e-1) / 1e4 AS opening_area_m2, door_code IS NOT NULL AS has_door FROM {walls} WHERE seq % 5 <> 4"""
)
def bim_walls(t):
    return io.bim_walls(*_bim(t))[0].select("project_id", "wall_id", "level", "wall_class", "length_m", "opening_area_m2", "has_door")
