"""Spatial matching. Spark finds the candidates with grid keys; order-dependent choices run in rounds over the candidates alone."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.exprs import angle_180, angle_gap, box_iou, clamp, distance, point_segment_distance, polygon_area, round_half_up as half_up
from .clean import segment_bbox
from .kernels import fuse_touching
from .rounds import components, cut, deferred_choice, dominant_pairs, first_independent, nearest

P = "project_id"
#: Collinear segments are sorted within bands of so many times the alignment.
BAND = 64


def _center(b: Column) -> tuple[Column, Column]:
    return (b["xmin"] + b["xmax"]) / 2, (b["ymin"] + b["ymax"]) / 2


def _cells(b: Column, size: float, reach: float = 0.0) -> Column:
    """Grid cells that a box, grown by reach, touches."""
    span = lambda lo, hi: F.sequence(F.floor((lo - reach) / size), F.floor((hi + reach) / size))
    return F.flatten(F.transform(span(b["xmin"], b["xmax"]), lambda x: F.transform(span(b["ymin"], b["ymax"]), lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / size)


def _first_common(a: Column, b: Column, size: float, reach: float = 0.0) -> Column:
    """Whether `cell` is the first that both the grown box a and the box b touch, so that a pair is met once however many cells it shares."""
    x = F.greatest(_cell(a["xmin"] - reach, size), _cell(b["xmin"], size))
    y = F.greatest(_cell(a["ymin"] - reach, size), _cell(b["ymin"], size))
    return (F.col("cell.cx") == x) & (F.col("cell.cy") == y)


def match_endpoints(walls: DataFrame, segments: DataFrame) -> DataFrame:
    """(project_id, seq, seg_seq): each wall with a box, in seq order, takes the best unused segment of its level by 0.6 IoU + 0.4 closeness, of those with
    IoU >= 0.10 or centres within 60; walls of levels without segments, or of generic levels, look at the whole project."""
    key = lambda c: F.lower(F.coalesce(F.nullif(c, F.lit("")), F.lit("Terreo")))
    segs = segment_bbox(segments).select(P, key("level").alias("s_level"), F.col("seq").alias("seg_seq"), F.col("bbox").alias("s_box"), ((F.col("x1") + F.col("x2")) / 2).alias("sx"), ((F.col("y1") + F.col("y2")) / 2).alias("sy"))
    levels = segs.select(P, F.col("s_level").alias("w_level"), F.lit(True).alias("has")).distinct()
    own = walls.filter(F.col("bbox").isNotNull()).select(P, key("level").alias("w_level"), "seq", "bbox").join(levels, [P, "w_level"], "left")
    generic = F.col("w_level").isin("outro", "n/a", "", "todos") | F.col("has").isNull()
    own = own.withColumn("any_level", generic).drop("has")
    # both gates put the segment's box or centre within 60 of the wall's box, so they share a grid cell
    size = 120.0
    left = own.withColumn("cell", F.explode(_cells(F.col("bbox"), size, 60.0)))
    right = segs.withColumn("cell", F.explode(_cells(F.col("s_box"), size)))
    once = _first_common(F.col("bbox"), F.col("s_box"), size, 60.0)
    pairs = left.join(right, [P, "cell"]).filter((F.col("any_level") | (F.col("w_level") == F.col("s_level"))) & once).drop("cell")
    wx, wy = _center(F.col("bbox"))
    b = F.col("bbox")
    diagonal = F.sqrt(F.pow(b["xmax"] - b["xmin"], F.lit(2)) + F.pow(b["ymax"] - b["ymin"], F.lit(2)))
    diagonal = F.when(diagonal == 0, 1.0).otherwise(diagonal)
    d, iou = distance(wx, wy, "sx", "sy"), box_iou(b, F.col("s_box"))
    score = half_up(iou * 0.6 + F.greatest(F.lit(0.0), 1.0 - d / diagonal) * 0.4, 9)
    scored = pairs.withColumns({"d": d, "iou": iou, "score": score}).filter(((F.col("iou") >= 0.10) | (F.col("d") < 60)) & (F.col("score") > 0))
    return deferred_choice(scored.select(P, "seq", "seg_seq", "score"), [P], "seq", "seg_seq", [-F.col("score")])


def wall_direction(b: Column) -> Column:
    w, h = b["xmax"] - b["xmin"], b["ymax"] - b["ymin"]
    return F.when(w > h * 1.5, "horizontal").when(h > w * 1.5, "vertical").otherwise("unknown")


def match_dimensions(walls: DataFrame, dimensions: DataFrame) -> DataFrame:
    """(project_id, seq, dim_seq, value_m): each wall, in seq order, takes the nearest unused reading of its level and direction within 60-180 of its centre whose
    value is 0.4-2.5 times the length (0.5-25 m for walls up to 0.2 m)."""
    key = lambda c: F.lower(F.coalesce(F.nullif(c, F.lit("")), F.lit("Terreo")))
    b = F.col("bbox")
    cx, cy = _center(b)
    radius = clamp(F.greatest(b["xmax"] - b["xmin"], b["ymax"] - b["ymin"]) * 0.6, 60, 180)
    own = walls.filter(b.isNotNull()).select(P, key("level").alias("lv"), "seq", "length_m", wall_direction(b).alias("dir"), cx.alias("cx"), cy.alias("cy"), radius.alias("r")).filter("dir <> 'unknown'")
    size = 180.0
    near = own.withColumn("gx", F.explode(F.sequence(F.floor((F.col("cx") - F.col("r")) / size), F.floor((F.col("cx") + F.col("r")) / size))))
    near = near.withColumn("gy", F.explode(F.sequence(F.floor((F.col("cy") - F.col("r")) / size), F.floor((F.col("cy") + F.col("r")) / size))))
    dims = dimensions.select(P, key("level").alias("lv"), F.col("seq").alias("dim_seq"), "value_m", "x", "y", "orientation", F.floor(F.col("x") / size).alias("gx"), F.floor(F.col("y") / size).alias("gy"))
    d = distance("x", "y", "cx", "cy")
    ratio = F.col("value_m") / F.col("length_m")
    fits = F.when(F.col("length_m") > 0.2, ratio.between(0.4, 2.5)).otherwise(F.col("value_m").between(0.5, 25))
    pairs = near.join(dims, [P, "lv", "gx", "gy"]).withColumn("d", d).filter((F.col("d") <= F.col("r")) & fits & ((F.col("orientation") == "unknown") | (F.col("orientation") == F.col("dir"))))
    pairs = pairs.select(P, "lv", "seq", "dim_seq", "value_m", half_up("d", 9).alias("d"))
    return deferred_choice(pairs, [P, "lv"], "seq", "dim_seq", [F.col("d")], ["value_m"]).select(P, "seq", "dim_seq", "value_m")


def apply_dimensions(walls: DataFrame, matched: DataFrame) -> DataFrame:
    """Matched walls take the reading as their length."""
    out = walls.join(matched.select(P, "seq", F.col("value_m").alias("__v")), [P, "seq"], "left")
    hit = F.col("__v").isNotNull()
    return out.withColumns(
        {
            "length_m": F.coalesce("__v", "length_m"),
            "source": F.when(hit, "dimension_text").otherwise(F.col("source")),
            "confidence": F.when(hit, F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.92))).otherwise(F.col("confidence")),
        }
    ).drop("__v")


def reconcile_detectors(a: DataFrame, b: DataFrame) -> DataFrame:
    """(project_id, seq, other_seq, outcome): walls of two detectors matched best first, one to one, by IoU >= 0.4 or centres within 50, then `agree` or `disagree` on the class;
    `only_a` and `only_b` without a partner."""
    key = F.lower(F.coalesce(F.nullif("level", F.lit("")), F.lit("Terreo")))
    left = a.select(P, key.alias("lv"), "seq", "wall_class", F.col("bbox").alias("x"))
    right = b.select(P, key.alias("lv"), F.col("seq").alias("other_seq"), F.col("wall_class").alias("other_class"), F.col("bbox").alias("y"))
    size = 100.0
    grid_l = left.filter("x IS NOT NULL").withColumn("cell", F.explode(_cells(F.col("x"), size, 50.0)))
    grid_r = right.filter("y IS NOT NULL").withColumn("cell", F.explode(_cells(F.col("y"), size)))
    pairs = grid_l.join(grid_r, [P, "lv", "cell"]).filter(_first_common(F.col("x"), F.col("y"), size, 50.0)).drop("cell")
    (ax, ay), (bx, by) = _center(F.col("x")), _center(F.col("y"))
    pairs = pairs.withColumns({"iou": half_up(box_iou(F.col("x"), F.col("y")), 9), "d": half_up(distance(ax, ay, bx, by), 9)}).filter("iou >= 0.4 OR d < 50")
    taken = dominant_pairs(pairs, [P, "lv"], "seq", "other_seq", [-F.col("iou"), F.col("d")], ["wall_class", "other_class"])
    both = taken.select(P, "seq", "other_seq", F.when(F.col("wall_class") == F.col("other_class"), "agree").otherwise("disagree").alias("outcome"))
    seen = right.select(P, "lv").distinct()
    only_a = left.join(seen, [P, "lv"], "left_semi").join(both.select(P, "seq"), [P, "seq"], "left_anti").select(P, "seq", F.lit(None).cast("long").alias("other_seq"), F.lit("only_a").alias("outcome"))
    only_b = right.join(both.select(P, "other_seq"), [P, "other_seq"], "left_anti").select(P, F.lit(None).cast("long").alias("seq"), "other_seq", F.lit("only_b").alias("outcome"))
    return both.unionByName(only_a).unionByName(only_b)


def refine_slabs(slabs: DataFrame, polygons: DataFrame) -> DataFrame:
    """The n-th slab of a level and class takes the n-th largest polygon, each once: source and confidence rise. polygons: (project_id, level, slab_class,
    polygon, page_index). Adds polygon_rank where one was found."""
    key = F.lower(F.coalesce(F.nullif("level", F.lit("")), F.lit("Terreo")))
    area = polygons.withColumn("__area", half_up(polygon_area(F.col("polygon")), 6)).withColumn("__lv", F.lower("level"))
    ranked = area.withColumn("polygon_rank", F.row_number().over(Window.partitionBy(P, "__lv", "slab_class").orderBy(F.desc("__area"), "page_index")))
    own = slabs.withColumn("__lv", key).withColumn("__n", F.row_number().over(Window.partitionBy(P, "__lv", "slab_class").orderBy("seq")))
    hits = ranked.select(P, "__lv", "slab_class", F.col("polygon_rank").alias("__n"), "polygon_rank")
    out = own.join(hits, [P, "__lv", "slab_class", "__n"], "left")
    hit = F.col("polygon_rank").isNotNull()
    return out.withColumns(
        {
            "source": F.when(hit & (F.col("source") != "table"), "polygon_focused").otherwise(F.col("source")),
            "confidence": F.when(hit, F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.85))).otherwise(F.col("confidence")),
        }
    ).drop("__lv", "__n")


def measured_lines(segments: DataFrame) -> DataFrame:
    """segments with len and angle in degrees, [0, 180)."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return segments.withColumns({"len": F.sqrt(dx * dx + dy * dy), "angle": half_up(angle_180(dx, dy), 9)})


def _projection(a: str, b: str) -> tuple[Column, Column]:
    """Overlap of line b with line a along a, and their mean distance across it."""
    ax1, ay1, ax2, ay2 = (F.col(f"{a}.{c}") for c in ("x1", "y1", "x2", "y2"))
    bx1, by1, bx2, by2 = (F.col(f"{b}.{c}") for c in ("x1", "y1", "x2", "y2"))
    n = F.col(f"{a}.len")
    ux, uy = (ax2 - ax1) / n, (ay2 - ay1) / n
    t1, t2 = (bx1 - ax1) * ux + (by1 - ay1) * uy, (bx2 - ax1) * ux + (by2 - ay1) * uy
    over = F.greatest(F.lit(0.0), F.least(n, F.greatest(t1, t2)) - F.greatest(F.lit(0.0), F.least(t1, t2)))
    across = (F.abs(-(bx1 - ax1) * uy + (by1 - ay1) * ux) + F.abs(-(bx2 - ax1) * uy + (by2 - ay1) * ux)) / 2
    return over, across


LINE = ("seq", "x1", "y1", "x2", "y2", "len", "angle")


def _box(line: str) -> Column:
    ends = {c: (F.col(f"{line}.{c}1"), F.col(f"{line}.{c}2")) for c in ("x", "y")}
    return F.struct(F.least(*ends["y"]).alias("ymin"), F.least(*ends["x"]).alias("xmin"), F.greatest(*ends["y"]).alias("ymax"), F.greatest(*ends["x"]).alias("xmax"))


def parallel_pairs(segments: DataFrame, scale: float = 14.17) -> DataFrame:
    """(project_id, page_index, a, b, thickness_m, length_m): lines 0.30-30 m long, within 3 degrees, 0.08-0.30 m apart and overlapped for 60 % of the shorter and 0.30 m. Each
    line, in seq order, takes the unused later line with the longest overlap, then the thinnest gap. Lines meet by page and by the grid cells their grown
    boxes touch."""
    low, high, near, far = 0.30 * scale, 30.0 * scale, 0.08 * scale, 0.30 * scale
    lines = measured_lines(segments).filter((F.col("len") >= low) & (F.col("len") <= high)).select(P, "page_index", F.struct(*LINE).alias("l"))
    box = _box("l")
    cell = lambda reach, name: lines.select(P, "page_index", F.col("l").alias(name), F.explode(_cells(box, 60.0, reach)).alias("cell"))
    # overlapping parallel lines come no farther apart than the gap widened by the angle over the line
    wide = far + high * 0.06
    a, b = cell(wide, "a"), cell(0.0, "b")
    over, across = _projection("a", "b")
    once = _first_common(_box("a"), _box("b"), 60.0, wide)
    pairs = a.join(b, [P, "page_index", "cell"]).filter((F.col("a.seq") < F.col("b.seq")) & (angle_gap(F.col("a.angle"), F.col("b.angle")) <= 3) & once).drop("cell")
    pairs = pairs.withColumns({"over": half_up(over, 6), "gap": half_up(across, 6)}).filter(
        (F.col("gap") >= near) & (F.col("gap") <= far) & (F.col("over") >= F.least("a.len", "b.len") * 0.6) & (F.col("over") >= low)
    )
    own = pairs.select(P, "page_index", F.col("a.seq").alias("a"), F.col("b.seq").alias("b"), "over", "gap")
    taken = dominant_pairs(own, [P, "page_index"], "a", "b", [F.col("a"), -F.col("over"), F.col("gap")], ["over", "gap"], shared=True)
    return taken.select(P, "page_index", "a", "b", half_up(F.col("gap") / scale, 6).alias("thickness_m"), half_up(F.col("over") / scale, 6).alias("length_m"))


def dedup_wall_lines(lines: DataFrame, scale: float = 14.17) -> DataFrame:
    """Lines (project_id, page_index, seq, x1, y1, x2, y2, length_m), longest first: whatever lies within 5 degrees, on the line (within 0.048 m) and half overlapped with a
    kept one goes."""
    perp = 0.08 * 0.6 * scale
    own = measured_lines(lines).filter("len >= 0.001").select(P, "page_index", F.struct(*LINE, "length_m").alias("l"))
    box = _box("l")
    a = own.select(P, "page_index", F.col("l").alias("a"), F.explode(_cells(box, 60.0, perp)).alias("cell"))
    b = own.select(P, "page_index", F.col("l").alias("b"), F.explode(_cells(box, 60.0)).alias("cell"))
    over, _ = _projection("a", "b")
    ux, uy = (F.col("a.x2") - F.col("a.x1")) / F.col("a.len"), (F.col("a.y2") - F.col("a.y1")) / F.col("a.len")
    off = lambda x, y: F.abs(-(F.col(f"b.{x}") - F.col("a.x1")) * uy + (F.col(f"b.{y}") - F.col("a.y1")) * ux)
    earlier = (F.col("a.length_m") > F.col("b.length_m")) | ((F.col("a.length_m") == F.col("b.length_m")) & (F.col("a.seq") < F.col("b.seq")))
    covers = a.join(b, [P, "page_index", "cell"]).filter(
        earlier & (angle_gap(F.col("a.angle"), F.col("b.angle")) <= 5) & (off("x1", "y1") <= perp) & (off("x2", "y2") <= perp) & (over / F.least("a.len", "b.len") >= 0.5)
    )
    edges = covers.filter(_first_common(_box("a"), _box("b"), 60.0, perp)).select(P, "page_index", F.col("a.seq").alias("a"), F.col("b.seq").alias("b"), F.col("a.length_m").alias("la"))
    removed = first_independent(edges, [P, "page_index"], [-F.col("la")]).withColumnRenamed("id", "seq")
    kept = measured_lines(lines).filter("len >= 0.001").drop("len", "angle")
    return kept.join(removed, [P, "page_index", "seq"], "left_anti")


def _passed_cells(x1: Column, y1: Column, x2: Column, y2: Column, cell: Column) -> Column:
    """Numbers of the grid cells that a line passes, with some beside it: it is cut in pieces no longer than a cell, each of which lies in its box's cells."""
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(x2 - x1), F.abs(y2 - y1)) / cell)).cast("int")

    def piece(k: Column) -> Column:
        ax, ay, bx, by = (a + (b - a) * t / n for t in (k, k + 1) for a, b in ((x1, x2), (y1, y2)))
        across = lambda a, b: F.sequence(F.floor((F.least(a, b) - 1e-6) / cell), F.floor((F.greatest(a, b) + 1e-6) / cell))
        return F.flatten(F.transform(across(ax, bx), lambda cx: F.transform(across(ay, by), lambda cy: F.struct(cx.alias("x"), cy.alias("y")))))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), piece)))


#: A ray looks for lines up to these shares of its length, one after the other; few get past the first.
RAY_RINGS = (0.0, 0.1, 0.3, 1.0)
#: Most grid cells along a page's diagonal; a page has about as many cells as lines.
CELLS_ACROSS = 256
#: On pages of so many lines each ray looks at all of them until it has crossed one.
FEW_LINES = 512


def raycast_class(lines: DataFrame, few: int = FEW_LINES) -> DataFrame:
    """(project_id, page_index, seq, wall_class): rays both ways across each centre line (x1, y1, x2, y2, thickness, eps); a side on which no other line is crossed makes it external.
    On pages of more than `few` lines a ray meets the lines in the grid cells that it passes, near ones first: only rays that have crossed nothing so far go on to the next ring of cells."""
    keys = [P, "page_index"]
    own = measured_lines(lines)
    page = own.groupBy(*keys).agg(
        distance(F.greatest(F.max("x1"), F.max("x2")), F.greatest(F.max("y1"), F.max("y2")), F.least(F.min("x1"), F.min("x2")), F.least(F.min("y1"), F.min("y2"))).alias("diag"),
        F.least(F.lit(CELLS_ACROSS), F.ceil(F.sqrt(F.count(F.lit(1))))).alias("across"),
        (F.count(F.lit(1)) > few).alias("large"),
    )
    page = cut(page)
    sized = own.join(page, keys).withColumn("cell", F.greatest(F.col("diag") / F.col("across"), F.lit(1e-3)))
    n = F.when(F.col("len") == 0, 1.0).otherwise(F.col("len"))
    off, reach = F.col("thickness") / 2 + F.col("eps"), F.col("diag") * 1.5
    both = sized.withColumn("sign", F.explode(F.array(F.lit(1.0), F.lit(-1.0))))
    nx, ny = F.col("sign") * -(F.col("y2") - F.col("y1")) / n, F.col("sign") * (F.col("x2") - F.col("x1")) / n
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    rays = both.select(*keys, "seq", "sign", "cell", "large", (cx + nx * off).alias("sx"), (cy + ny * off).alias("sy"), (nx * (reach - off)).alias("dx"), (ny * (reach - off)).alias("dy"))
    ends = [F.col("seq").alias("o"), F.col("x1").alias("ox1"), F.col("y1").alias("oy1"), F.col("x2").alias("ox2"), F.col("y2").alias("oy2")]
    ex, ey = F.col("ox2") - F.col("ox1"), F.col("oy2") - F.col("oy1")
    den = F.col("dx") * ey - F.col("dy") * ex
    safe = F.when(F.abs(den) < 1e-9, F.lit(None)).otherwise(den)
    t = ((F.col("ox1") - F.col("sx")) * ey - (F.col("oy1") - F.col("sy")) * ex) / safe
    u = ((F.col("ox1") - F.col("sx")) * F.col("dy") - (F.col("oy1") - F.col("sy")) * F.col("dx")) / safe
    crossed = F.coalesce((t > 0.001) & (t < 0.999) & (u > 0.001) & (u < 0.999), F.lit(False))
    all_of = own.select(*(F.col(k).alias(f"{k}_") for k in keys), *ends)
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys))
    open_ = rays.filter(~F.col("large")).join(all_of, same & (F.col("seq") != F.col("o")) & crossed, "left_anti").select(*keys, "seq")
    if page.filter("large").limit(1).count():
        open_ = open_.unionByName(_open_by_rings(rays.filter("large"), sized.filter("large").select(*keys, *ends, F.explode(_passed_cells(*map(F.col, ("x1", "y1", "x2", "y2", "cell")))).alias("at")), keys, crossed))
    open_ = open_.distinct().withColumn("open", F.lit(True))
    return own.select(*keys, "seq").join(open_, [*keys, "seq"], "left").select(*keys, "seq", F.when(F.col("open"), "external").otherwise("internal").alias("wall_class"))


def _open_by_rings(free: DataFrame, other: DataFrame, keys: list[str], crossed: Column) -> DataFrame:
    for start, end in zip(RAY_RINGS, RAY_RINGS[1:], strict=False):
        span = [F.col(f"s{c}") + F.col(f"d{c}") * share for share in (start, end) for c in ("x", "y")]
        met = free.withColumn("at", F.explode(_passed_cells(*span, F.col("cell")))).join(other, [*keys, "at"]).filter((F.col("seq") != F.col("o")) & crossed)
        free = free.join(met.select(*keys, "seq", "sign").distinct(), [*keys, "seq", "sign"], "left_anti")
    return free.select(*keys, "seq")


def text_to_segment(texts: DataFrame, segments: DataFrame) -> DataFrame:
    """(project_id, page_index, seq, seg_seq, ratio): for each dimension text (x, y, value_m) the nearest line of its page, if it is within max(30, 4 % of the longest line) and
    longer than 5; ratio is drawing units per metre. Texts look in their grid cell's reach."""
    lines = measured_lines(segments)
    reach = lines.groupBy(P, "page_index").agg(F.greatest(F.lit(30.0), F.max("len") * 0.04).alias("reach"))
    size = 100.0
    box = F.struct(F.least("y1", "y2").alias("ymin"), F.least("x1", "x2").alias("xmin"), F.greatest("y1", "y2").alias("ymax"), F.greatest("x1", "x2").alias("xmax"))
    cells = lines.withColumn("cell", F.explode(_cells(box, size))).select(P, "page_index", "cell", F.col("seq").alias("seg_seq"), "x1", "y1", "x2", "y2", "len")
    dot = F.struct((F.col("y") - F.col("reach")).alias("ymin"), (F.col("x") - F.col("reach")).alias("xmin"), (F.col("y") + F.col("reach")).alias("ymax"), (F.col("x") + F.col("reach")).alias("xmax"))
    asked = texts.select(P, "page_index", "seq", "x", "y", "value_m").join(reach, [P, "page_index"]).withColumn("cell", F.explode(_cells(dot, size)))
    d = half_up(point_segment_distance(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")), 9)
    near = asked.join(cells, [P, "page_index", "cell"]).withColumn("d", d).filter(F.col("d") < F.col("reach"))
    best = near.groupBy(P, "page_index", "seq").agg(F.min_by(F.struct("seg_seq", "len", "value_m"), F.struct("d", "seg_seq")).alias("b"))
    return best.filter("b.len > 5").select(P, "page_index", "seq", "b.seg_seq", half_up(F.col("b.len") / F.col("b.value_m"), 6).alias("ratio"))


def detect_scale(ratios: DataFrame, default: float = 14.17) -> DataFrame:
    """(project_id, page_index, scale, source, n): of three ratios or more, the upper median of the densest window [r, 1.15 r] with three and 40 % of them; else of the band of 25 % around the
    upper median with 55 %; else the default. The window count is a range frame."""
    keys = [P, "page_index"]
    by = Window.partitionBy(*keys)
    # the frame's bound depends on the row, so it runs over the logarithm
    frame = "OVER (PARTITION BY project_id, page_index ORDER BY lg RANGE BETWEEN CURRENT ROW AND 0.13976194237515868D FOLLOWING)"
    own = ratios.withColumn("lg", F.log("ratio")).withColumns({"size": F.expr(f"count(1) {frame}"), "place": F.row_number().over(by.orderBy("ratio")), "n": F.count(F.lit(1)).over(by)})
    # the page in order: a window's members, and a band's, follow each other, so a median is the ratio at a place
    at = lambda place: F.max(F.when(F.col("place") == place, F.col("ratio")))
    own = own.withColumns({"best": F.max(F.struct("size", (-F.col("place")).alias("before"))).over(by), "mid": at(F.floor(F.col("n") / 2) + 1).over(by)})
    inside = (F.col("ratio") >= F.col("mid") * 0.75) & (F.col("ratio") <= F.col("mid") * 1.25)
    own = own.withColumns({"band": F.count_if(inside).over(by), "first": F.min(F.when(inside, F.col("place"))).over(by)})
    found = own.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("best.size").alias("size"), F.max("band").alias("band"), at(F.floor(F.col("best.size") / 2) - F.col("best.before")).alias("center"), at(F.col("first") + F.floor(F.col("band") / 2)).alias("middle")
    )
    cluster = (F.col("n") >= 3) & (F.col("size") >= 3) & (F.col("size") / F.col("n") >= 0.4)
    banded = (F.col("n") >= 3) & (F.col("band") / F.col("n") >= 0.55)
    return found.select(
        *keys, F.when(cluster, F.col("center")).when(banded, F.col("middle")).otherwise(F.lit(default)).alias("scale"), F.when(cluster, "cluster").when(banded, "band").otherwise("default").alias("source"), "n"
    )


def room_labels(rooms: DataFrame, texts: DataFrame) -> DataFrame:
    """(project_id, page_index, room_seq, label): for each room polygon's centre (cx, cy) the nearest room text of its page, null on pages without any."""
    points = rooms.select(P, "page_index", "room_seq", F.col("cx").alias("px"), F.col("cy").alias("py"))
    found = nearest(points, texts.withColumnRenamed("text", "label"), [P, "page_index"], ["room_seq"], "label", 100.0)
    return rooms.select(P, "page_index", "room_seq").join(found, [P, "page_index", "room_seq"], "left")


def _beside(rows: DataFrame, bands: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the other columns of bands; keys may be null."""
    named = bands.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in bands.columns if c not in keys))
    on = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    return rows.join(named, on).drop(*(f"__{k}" for k in keys))


def merge_collinear(segments: DataFrame, align: float = 8.0, gap: float = 15.0) -> DataFrame:
    """(project_id, page_index, flat, line, start, end, members): axis-parallel segments fused along their line where lines are within `align` and gaps within `gap`.

    In order of the smaller end across and along, a segment joins the running one if its mean line is close to that one's and it begins near or before its end. The
    running line is the first segment's mean, and from the second member on its whole part. A page's segments of a direction are cut into runs wherever
    nothing after a place can join what is before it: where its smaller end across lies more than `align` above all running lines that may be. The cuts are found band by band,
    so that no task sorts a whole page; a task then scans whole runs."""
    dx, dy = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    flat = dx >= dy
    across, along = ("y1", "y2"), ("x1", "x2")
    pick = lambda f, a, b: F.when(flat, f(*a)).otherwise(f(*b))
    mean = lambda a, b: (F.col(a) + F.col(b)) / 2
    own = segments.select(
        P, "page_index", "seq", flat.alias("flat"), pick(F.least, across, along).alias("low"), pick(mean, across, along).alias("line"), pick(F.least, along, across).alias("start"), pick(F.greatest, along, across).alias("end")
    )
    # no running line lies above the largest mean before, rounded up, and no mean below its own smaller end
    page = [P, "page_index", "flat"]
    own = own.withColumn("band", F.floor(F.col("low") / (BAND * align)))
    bands = [*page, "band"]
    order = Window.partitionBy(*bands).orderBy("low", "start", "seq")
    earlier = Window.partitionBy(*page).orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    # only sums of bands, as many as a page is high, meet in a window of the page
    tops = own.groupBy(*bands).agg(F.max(F.ceil("line")).alias("top")).select(*bands, F.max("top").over(earlier).alias("below"))
    before = F.greatest("below", F.max(F.ceil("line")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    own = _beside(own, tops, bands).withColumn("cut", F.coalesce(F.col("low") - before > align, F.lit(True)).cast("int"))
    cuts = own.groupBy(*bands).agg(F.sum("cut").alias("n")).select(*bands, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("cuts"))
    runs = _beside(own, cuts, bands).withColumn("run", F.col("cuts") + F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    keys = [*page, "run"]
    dealt = runs.select(*keys, "low", "start", "seq", "line", "end").repartition(*keys).sortWithinPartitions(*keys, "low", "start", "seq")
    schema = "project_id long, page_index int, flat boolean, line double, start double, end double, members long"

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, None
        for batch in batches:
            out = []
            for *own_key, _, start, _, line, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own_key == key and abs(now[0] - line) <= align and start - now[2] <= gap:
                    now = (float(math.trunc(now[0])), min(now[1], start), max(now[2], end), now[3] + 1)
                else:
                    out += [(*key[:3], *now)] if now else []
                    key, now = own_key, (line, start, end, 1)
            if out:
                yield _rows(out)
        if now:
            yield _rows([(*key[:3], *now)])

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [P, "page_index", "flat", "line", "start", "end", "members"])

    return dealt.mapInArrow(fuse, schema)


def merge_touching(segments: DataFrame, angle: float = 8.0, touch: float = 12.0) -> DataFrame:
    """(project_id, page_index, x1, y1, x2, y2, members): segments of any direction fused while two are within `angle` degrees and have ends closer than `touch`; the farthest pair of ends remains.
    Repeats to a fixed point among segments whose ends touch, directly or through others: a fused segment keeps ends of its members, so fusion never leaves such
    a group, while its angle may come to fit a segment that fitted none before. What is fused in one task is such a group, not a page."""
    lines = measured_lines(segments).select(P, "page_index", F.struct(*LINE).alias("l"))
    ends = lines.select(P, "page_index", "l", F.explode(F.array(F.struct(F.col("l.x1").alias("x"), F.col("l.y1").alias("y")), F.struct(F.col("l.x2").alias("x"), F.col("l.y2").alias("y")))).alias("e"))
    grid = ends.withColumn("gx", F.floor(F.col("e.x") / touch)).withColumn("gy", F.floor(F.col("e.y") / touch))
    wide = grid.withColumn("gx", F.explode(F.array(*(F.col("gx") + d for d in (-1, 0, 1))))).withColumn("gy", F.explode(F.array(*(F.col("gy") + d for d in (-1, 0, 1)))))
    pairs = wide.alias("p").join(grid.alias("q"), [P, "page_index", "gx", "gy"]).filter(
        (F.col("p.l.seq") != F.col("q.l.seq")) & (distance("p.e.x", "p.e.y", "q.e.x", "q.e.y") < touch)
    )
    links = pairs.select(P, "page_index", F.col("p.l.seq").alias("a"), F.col("q.l.seq").alias("b"))
    grouped = components(links, [P, "page_index"]).withColumnRenamed("id", "seq")

    own = segments.select(P, "page_index", "seq", "x1", "y1", "x2", "y2").join(grouped, [P, "page_index", "seq"], "left")
    alone = own.filter("component IS NULL").select(P, "page_index", "x1", "y1", "x2", "y2", F.lit(1).cast("long").alias("members"))
    keys = [P, "page_index", "component"]
    touching = own.filter("component IS NOT NULL").select(*keys, "seq", "x1", "y1", "x2", "y2").repartition(*keys).sortWithinPartitions(*keys, "seq")

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups come one after another; one of them is held at a time."""

        def fused(key: tuple, lines_: list) -> list[tuple]:
            return [(key[0], key[1], *line) for line in fuse_touching(lines_, angle, touch)]

        key, held, out = None, [], []
        for batch in batches:
            for project, page, component, _, *line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (project, page, component) != key:
                    out += fused(key, held) if held else []
                    key, held = (project, page, component), []
                held.append([*line, 1])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)
                out = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*fused(key, held), strict=True), fields, strict=True)], schema=fields)

    fields = to_arrow_schema(alone.schema)
    return alone.unionByName(touching.mapInArrow(fuse, alone.schema))
