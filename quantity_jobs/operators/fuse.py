"""Fusion of several views: schedules, areas, units, duplicates, dominant pages, inferred slabs, perimeter audit.

All keys start with project_id, so one repartition by it serves every window, group and join here."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.exprs import finite, floor_rank, overlap_1d, round_half_up as half_up
from ..sources.io import dealt, staged
from .kernels import first_match
from .rounds import TAIL, by_size, cut, groups_of

P = "project_id"


def union_views(*views: DataFrame, view: str = "plan") -> DataFrame:
    """Elements of all views, with the view they come from where none is named."""
    out = views[0]
    for v in views[1:]:
        out = out.unionByName(v, allowMissingColumns=True)
    named = F.col("primary_view") if "primary_view" in out.columns else F.lit(None).cast("string")
    return out.withColumn("primary_view", F.coalesce(named, F.lit(view)))


def merge_schedule_walls(walls: DataFrame, sched: DataFrame, changes: bool = False) -> DataFrame:
    """(project_id, level, wall_class, seq, wall_id, length_m, height_m, thickness_m, source, confidence): each schedule row, in order, overwrites the
    first wall of its level and class whose length is within 0.5 m, or is added; later rows see earlier changes. changes: only the walls overwritten (side 0) and
    added (side 1)."""
    keys = [P, "level", "wall_class"]
    columns = ["seq", "wall_id", "length_m", "height_m", "thickness_m", "source", "confidence"]
    base = 1 << 40  # places added walls behind those extracted
    ours = walls.select(*keys, *columns, F.lit(0).alias("side"))
    theirs = sched.select(*keys, "seq", "wall_id", "length_m", "height_m", "thickness_m", F.lit("table").alias("source"), F.lit(0.95).alias("confidence"), F.lit(1).alias("side"))
    rows = ours.unionByName(theirs).repartition(*keys).sortWithinPartitions(*keys, "side", "seq")

    def merged(table: pa.Table) -> pa.Table:
        """Whole groups, in order: those without schedule rows as they are."""
        codes = [table[c].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy() for c in keys]
        side, lengths = table["side"].to_numpy(), table["length_m"].cast(pa.float64()).to_numpy()
        starts = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in codes], axis=0)))
        stops = np.append(starts[1:], len(side))
        row, measure = [], []
        for start, stop, n_theirs in zip(starts.tolist(), stops.tolist(), np.add.reduceat(side, starts).tolist(), strict=True):
            own = np.arange(start, stop - n_theirs)
            if n_theirs:
                places, hit = first_match(lengths[start : stop - n_theirs], lengths[stop - n_theirs : stop], 0.5)
                added = np.array(sorted({p for p in places.tolist() if p >= len(own)}), int)
                first = np.array([int((places == p).argmax()) for p in added], int)
                own = np.concatenate([own, stop - n_theirs + first])
                measure.append(np.where(hit >= 0, stop - n_theirs + hit, own))
            else:
                measure.append(own)
            row.append(own)
        row, measure = np.concatenate(row), np.concatenate(measure)
        if changes:
            touched = (row != measure) | (side[row] == 1)
            row, measure = row[touched], measure[touched]
        new = side[row] == 1
        out = table.take(pa.array(row))
        measured = table.select(["length_m", "height_m", "thickness_m", "source", "confidence"]).take(pa.array(measure))
        for c in measured.column_names:
            out = out.set_column(out.column_names.index(c), c, measured[c])
        out = out.set_column(out.column_names.index("seq"), "seq", pa.array(out["seq"].to_numpy() + np.where(new, base, 0)))
        return out.select([*keys, *columns, "side"] if changes else [*keys, *columns])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each batch only its own rows are looked at, so that a group of many batches costs no more than its rows."""
        held: list[pa.RecordBatch] = []  # of the last group, which may go on
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keys]
            first, key = (tuple(c[k].as_py() for c in columns) for k in (0, batch.num_rows - 1))
            if first == key == last:
                held.append(batch)
                continue
            same = np.ones(batch.num_rows, bool)
            for c in columns:
                value = c[batch.num_rows - 1]
                same &= pc.fill_null(pc.equal(c, value), False).to_numpy(zero_copy_only=False) if value.is_valid else c.is_null().to_numpy(zero_copy_only=False)
            start = batch.num_rows - int(same.sum())
            done = [*held, batch.slice(0, start)] if start else held
            if done:
                yield from merged(pa.Table.from_batches(done)).to_batches()
            held, last = [batch.slice(start)], key
        if held:
            yield from merged(pa.Table.from_batches(held)).to_batches()

    kind = "project_id long, level string, wall_class string, seq long, wall_id string, length_m double, height_m double, thickness_m double, source string, confidence double"
    return rows.mapInArrow(merge, kind + ", side int" if changes else kind)


def add_schedule_walls(walls: DataFrame, sched: DataFrame) -> DataFrame:
    """walls with all their columns after merge_schedule_walls, in buckets by project; columns that it doesn't know are null in added walls. The scan gets what it reads of a
    wall, and only what it changed is joined and added, so that walls which lie by project don't move."""
    measures = ["length_m", "height_m", "thickness_m", "source", "confidence"]
    unread = (F.lit(None).cast(walls.schema[c].dataType).alias(c) for c in ("wall_id", *measures[1:]))
    touched = staged(merge_schedule_walls(walls.select(P, "level", "wall_class", "seq", "length_m", *unread), sched, changes=True), "scheduled")
    hit = touched.filter("side = 0").select(P, "seq", F.struct(*measures).alias("__hit"))
    own = walls.join(hit, [P, "seq"], "left")
    own = own.withColumns({c: F.when(F.col("__hit").isNotNull(), F.col(f"__hit.{c}")).otherwise(F.col(c)) for c in measures}).drop("__hit")
    return dealt("walls", own, touched.filter("side = 1").drop("side"))


def schedule_opening_dims(walls: DataFrame, sched_openings: DataFrame) -> DataFrame:
    """Openings whose code the schedule has, letter for letter, take its sizes; the last row of a code wins."""
    last = sched_openings.filter("code IS NOT NULL").groupBy(P, "code").agg(F.max_by(F.struct("width_m", "height_m"), "seq").alias("dims"))
    return _with_sizes(walls, last, lambda o: o["code"])


def _with_sizes(walls: DataFrame, sizes: DataFrame, key) -> DataFrame:
    """walls with openings resized from (project_id, code, dims). A project's schedule is a short list, so it travels as one map."""
    maps = sizes.groupBy(P).agg(F.map_from_entries(F.collect_list(F.struct("code", "dims"))).alias("sizes"))

    def resize(o: Column) -> Column:
        found = F.element_at(F.col("sizes"), key(o))
        return F.struct(
            o["kind"].alias("kind"),
            o["code"].alias("code"),
            F.when(found.isNotNull(), found["width_m"]).otherwise(o["width_m"]).alias("width_m"),
            F.when(found.isNotNull(), found["height_m"]).otherwise(o["height_m"]).alias("height_m"),
            o["sill_m"].alias("sill_m"),
            F.when(found.isNotNull(), F.lit("table")).otherwise(o["source"]).alias("source"),
        )

    joined = walls.join(maps, P, "left")
    return joined.withColumn("openings", F.when(F.col("sizes").isNull(), F.col("openings")).otherwise(F.transform("openings", resize))).drop("sizes")


def link_openings(walls: DataFrame, sched_openings: DataFrame) -> DataFrame:
    """Openings matched to the schedule by trimmed upper-case code; the opening area follows; walls seen with openings but without any, and openings
    above the wall's area, are for review. Adds link_updated, link_unresolved and link_conflict."""
    plain = lambda c: F.upper(F.trim(c))
    last = sched_openings.filter(F.trim("code") != "").groupBy(P, plain(F.col("code")).alias("code")).agg(F.max_by(F.struct("width_m", "height_m"), "seq").alias("dims"))
    out = _with_sizes(walls.withColumn("__before", F.col("openings")), last, lambda o: plain(F.coalesce(o["code"], F.lit(""))))
    hit = F.exists(F.col("openings"), lambda o: F.col("__known").isNotNull() & F.array_contains("__known", plain(F.coalesce(o["code"], F.lit("")))))
    known = last.groupBy(P).agg(F.collect_set("code").alias("__known"))
    area = F.aggregate("openings", F.lit(0.0), lambda s, o: s + F.coalesce(o["width_m"], F.lit(0.0)) * F.coalesce(o["height_m"], F.lit(0.0)))
    has = F.size("openings") > 0
    out = out.join(known, P, "left").withColumns(
        {
            "link_updated": F.coalesce(has & hit, F.lit(False)),
            "link_unresolved": (F.coalesce("has_door", F.lit(False)) | F.coalesce("has_window", F.lit(False))) & ~has,
            "opening_area_m2": F.when(has, F.greatest(F.lit(0.0), area)).otherwise(F.col("opening_area_m2")),
        }
    )
    wall_area = F.coalesce("length_m", F.lit(0.0)) * F.coalesce("height_m", F.lit(0.0))
    conflict = has & (wall_area > 0) & (F.col("opening_area_m2") > wall_area)
    review = F.col("needs_review") if "needs_review" in walls.columns else F.lit(False)
    return out.withColumn("link_conflict", conflict).withColumn("needs_review", F.coalesce(review, F.lit(False)) | F.col("link_unresolved") | F.col("link_conflict")).drop("__before", "__known")


def link_stats(linked: DataFrame) -> DataFrame:
    return linked.groupBy(P).agg(F.count_if("link_updated").alias("updated"), F.count_if("link_unresolved").alias("unresolved"), F.count_if("link_conflict").alias("conflicts"))


def area_references(sched_areas: DataFrame) -> DataFrame:
    """(project_id, level, total, roofed, rooms): total is the largest total or roofed area, roofed the largest roofed one, rooms the sum."""
    kind, area = F.col("area_kind"), F.col("area_m2")
    return (
        sched_areas.filter(finite("area_m2") & (area > 0))
        .groupBy(P, "level")
        .agg(
            F.max(F.when(kind.isin("total", "roofed"), area)).alias("total"),
            F.max(F.when(kind == "roofed", area)).alias("roofed"),
            half_up(F.sum(F.when(~kind.isin("total", "roofed"), area)), 6).alias("rooms"),
        )
    )


def reconcile_slab_area(slabs: DataFrame, sched_areas: DataFrame) -> DataFrame:
    """Slabs against the schedule of areas, per level: the first roof takes the roofed area; the first floor or raft takes the total, or the sum of rooms
    where it is more than 15 % off; missing ones are created from roofed and total areas. Only the first slab is touched."""
    group = F.when(F.col("slab_class") == "roof", "roof").otherwise("floor")
    ranked = slabs.withColumn("__group", group).withColumn("__first", F.row_number().over(Window.partitionBy(P, "level", "__group").orderBy("seq")) == 1)
    refs = area_references(sched_areas)
    joined = ranked.join(refs, [P, "level"], "left")
    locked = F.col("source") == "table_area_total"
    roof = F.col("__first") & (F.col("__group") == "roof") & F.col("roofed").isNotNull() & ~locked
    by_total = F.col("total").isNotNull()
    ref = F.coalesce("total", "rooms")
    far = (F.col("area_m2") <= 0) | (F.abs(F.col("area_m2") - ref) / ref > 0.15)
    floor = F.col("__first") & (F.col("__group") == "floor") & ref.isNotNull() & (by_total | far) & (F.col("source") != "table")
    out = joined.withColumns(
        {
            "area_m2": F.when(roof, F.col("roofed")).when(floor, ref).otherwise(F.col("area_m2")),
            "source": F.when(roof, "table_area_total").when(floor, F.when(by_total, "table_area_total").otherwise("table_sum_rooms")).otherwise(F.col("source")),
            "confidence": F.when(roof, F.lit(0.98)).when(floor, F.when(by_total, 0.98).otherwise(0.85)).otherwise(F.col("confidence")),
        }
    ).select(*slabs.columns)
    present = ranked.select(P, "level", F.col("__group").alias("slab_class")).distinct()
    wanted = refs.select(P, "level", F.explode(F.create_map(F.lit("roof"), F.col("roofed"), F.lit("floor"), F.col("total"))).alias("slab_class", "area_m2")).filter("area_m2 IS NOT NULL")
    new = wanted.join(present, [P, "level", "slab_class"], "left_anti").select(
        P,
        "level",
        "slab_class",
        "area_m2",
        F.concat(F.when(F.col("slab_class") == "roof", "LCT_").otherwise("LT_"), F.col("level")).alias("slab_id"),
        F.lit("table_area_total").alias("source"),
        F.lit(0.98).alias("confidence"),
        (F.lit(1 << 40) + F.when(F.col("slab_class") == "roof", 0).otherwise(1)).alias("seq"),
    )
    return out.unionByName(new, allowMissingColumns=True)


def cap_slab_area(slabs: DataFrame, sched_areas: DataFrame) -> DataFrame:
    """Slabs above 1.05 times the level's total are cut down to it, unless they come from that total."""
    refs = area_references(sched_areas).select(P, "level", "total")
    over = F.coalesce((F.col("area_m2") > F.col("total") * 1.05) & (F.col("source") != "table_area_total"), F.lit(False))
    return (
        slabs.join(refs, [P, "level"], "left")
        .withColumns(
            {
                "area_m2": F.when(over, F.col("total")).otherwise(F.col("area_m2")),
                "source": F.when(over, F.concat("source", F.lit("_capped_by_table"))).otherwise(F.col("source")),
                "confidence": F.when(over, F.greatest("confidence", F.lit(0.9))).otherwise(F.col("confidence")),
            }
        )
        .select(*slabs.columns)
    )


def best_section(sections: DataFrame, least: float = 0.6) -> DataFrame:
    """(project_id, level_key, ceiling_m, page_index): per level name, trimmed and lower-cased, the most confident section; the first wins ties."""
    own = sections.filter(F.col("confidence") >= least).withColumn("level_key", F.lower(F.trim(F.coalesce("level", F.lit("")))))
    rank = F.row_number().over(Window.partitionBy(P, "level_key").orderBy(F.desc("confidence"), "seq"))
    return own.withColumn("rank", rank).filter("rank = 1").select(P, "level_key", "ceiling_m", "page_index", F.col("seq").alias("section_seq"))


#: A level's number within its name, and words that make differing names the same level.
LEVEL_NUMBER = r"\b(\d+)(?:[ºo]|\s*pav|\s|$)"
LEVEL_WORDS = (
    (r"\bterreo|\btérreo", "ground"),
    (r"\bcobertura\b|\bcoberta\b", "roof"),
    (r"\bsubsolo\b|\bsub\b", "basement"),
    (r"\bmezanino\b", "mezzanine"),
)


def level_token(key: Column) -> Column:
    """What two lower-case names of one level have in common, in brackets: their number or else their first known word; a name without either is its own token."""
    number = F.regexp_extract(key, LEVEL_NUMBER, 1)
    known = F.coalesce(F.nullif(number, F.lit("")), *(F.when(key.rlike(pattern), name) for pattern, name in LEVEL_WORDS))
    return F.coalesce(F.concat(F.lit("<"), known, F.lit(">")), key)


def apply_sections(walls: DataFrame, sections: DataFrame) -> DataFrame:
    """Ceilings of sections onto the walls of their level, by name or else by its token: within 5 cm they confirm, else they replace the height. Confidence
    rises by 0.1 up to 0.99. In projects of several levels, walls of default height without a section need one. Adds section_outcome."""
    best = best_section(sections)
    by_token = best.withColumn("token", level_token(F.col("level_key"))).groupBy(P, "token").agg(F.min_by(F.struct("ceiling_m", "page_index"), F.struct("section_seq")).alias("by_token"))
    by_name = best.select(P, F.col("level_key").alias("__key"), F.struct("ceiling_m", "page_index").alias("by_name"))
    level = F.coalesce(F.nullif("level", F.lit("")), F.lit("Terreo"))
    source = F.col("height_source") if "height_source" in walls.columns else F.lit(None).cast("string")
    own = walls.withColumns({"__level": level, "__key": F.lower(F.trim(level)), "height_source": source})
    token = level_token(F.col("__key"))
    usable = F.when(token != F.lower(F.col("__level")), token)
    joined = own.withColumn("token", usable).join(by_name, [P, "__key"], "left").join(by_token, [P, "token"], "left")
    found = F.coalesce("by_name", "by_token")
    levels = walls.groupBy(P).agg(F.count_distinct(level).alias("__levels"))
    joined = joined.join(levels, P).withColumn("section", found)
    height = F.coalesce("height_m", F.lit(0.0))
    has = F.col("section").isNotNull()
    confirm = has & (height > 0) & (F.abs(height - F.col("section.ceiling_m")) <= 0.05) & ~F.coalesce(F.col("height_source") == "default", F.lit(False))
    pending = ~has & (F.col("__levels") > 1) & F.coalesce(F.col("height_source") == "default", F.lit(True))
    out = joined.withColumn("section_outcome", F.when(confirm, "confirmed").when(has, "applied").when(pending, "pending").otherwise("none"))
    applied = F.col("section_outcome") == "applied"
    out = out.withColumns(
        {
            "height_m": F.when(applied, F.col("section.ceiling_m")).otherwise(F.col("height_m")),
            "height_source": F.when(applied, "section").otherwise(F.col("height_source")),
            "confidence": F.when(has & (F.col("confidence") < 0.99), F.least(F.lit(0.99), F.col("confidence") + 0.1)).otherwise(F.col("confidence")),
            "confirmed_by_section": has,
            "needs_section": pending,
        }
    )
    return out.drop("__level", "__key", "token", "by_name", "by_token", "section", "__levels")


def section_stats(sectioned: DataFrame) -> DataFrame:
    """Per project: heights applied, levels confirmed, levels pending (0 in projects of one level)."""
    level = F.coalesce(F.nullif("level", F.lit("")), F.lit("Terreo"))
    sums = sectioned.groupBy(P).agg(
        F.count_if(F.col("section_outcome") == "applied").alias("heights_applied"),
        F.count_distinct(F.when(F.col("confirmed_by_section"), level)).alias("levels_confirmed"),
        F.count_distinct(level).alias("levels"),
    )
    pending = F.when(F.col("levels") > 1, F.col("levels") - F.col("levels_confirmed")).otherwise(0)
    return sums.select(P, "heights_applied", "levels_confirmed", pending.cast("long").alias("levels_pending"))


def wall_signature() -> Column:
    steps = lambda c: F.floor(F.col(c) * 20 + 0.5).cast("string")
    parts = F.array_sort(F.transform("openings", lambda o: F.concat(F.substring(o["kind"], 1, 1), F.floor(F.coalesce(o["width_m"], F.lit(0.0)) * 10 + 0.5).cast("string"))))
    opens = F.coalesce(F.nullif(F.array_join(parts, ","), F.lit("")), F.lit("0"))
    return F.concat_ws("|", "level", "wall_class", steps("length_m"), steps("height_m"), opens)


def _first_of(df: DataFrame, signature: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(P, "__sig").orderBy("seq"))
    return df.withColumn("__sig", signature).withColumn("__rank", rank).filter("__rank = 1").drop("__sig", "__rank")


def dedup_walls(walls: DataFrame) -> DataFrame:
    """The first wall of each signature: level, class, length and height in steps of 5 cm, openings by kind and width."""
    return _first_of(walls, wall_signature())


def dedup_slabs(slabs: DataFrame) -> DataFrame:
    """The first slab of each level, class and area in steps of 0.05."""
    return _first_of(slabs, F.concat_ws("|", "level", "slab_class", F.floor(F.col("area_m2") * 20 + 0.5).cast("string")))


def dominant_page(walls: DataFrame, plausible: int = 30) -> DataFrame:
    """Groups of level and class with more walls than plausible, on several pages, keep only the page with most walls, then most length, then seen first."""
    page = F.coalesce("page_index", F.lit(-1))
    pages = walls.groupBy(P, "level", "wall_class", page.alias("__page")).agg(F.count(F.lit(1)).alias("n"), half_up(F.sum("length_m"), 6).alias("len"), F.min("seq").alias("first"))
    best = pages.groupBy(P, "level", "wall_class").agg(
        F.sum("n").alias("__n"), F.count(F.lit(1)).alias("__pages"), F.max_by("__page", F.struct("n", "len", -F.col("first"))).alias("__best")
    )
    joined = walls.join(best, [P, "level", "wall_class"])
    return joined.filter((F.col("__pages") <= 1) | (F.col("__n") <= plausible) | (page == F.col("__best"))).drop("__n", "__pages", "__best")


def suppress_similar_slabs(slabs: DataFrame, share: float = 0.30, tail: int = TAIL) -> DataFrame:
    """Within level and class, by falling confidence and area: slabs within 30 % of a kept one go. Areas that are null, zero or negative are like none.

    Similar areas lie in the same or a near cell of a logarithmic scale. In each round the first slab of a cell is kept if it also comes before the first of every near
    cell, and takes the slabs like it out; so a group of any size is only aggregated by cell and joined with the few kept of near cells."""
    width = -math.log(1 - share) * 0.999
    near_cells = range(-2, 3)
    first = F.struct(F.col("confidence").isNull().alias("unsure"), (-F.col("confidence")).alias("c"), (-F.col("area_m2")).alias("a"), F.col("seq").alias("s"))
    own = slabs.filter("area_m2 > 0").select(F.struct(P, "level", "slab_class").alias("g"), "seq", "area_m2", F.floor(F.log("area_m2") / width).alias("cell"), first.alias("o"))
    now = cut(own)
    kept = now.select("g", "seq").limit(0)
    kind = kept.schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, []
        for batch in batches:
            rows = []
            for k, (g, v) in enumerate(zip(groups_of(batch), batch.column(2).to_pylist(), strict=True)):
                if g != last:
                    last, seen = g, []
                if not any(abs(v - x) / max(v, x) <= share for x in seen):
                    seen.append(v)
                    rows.append(k)
            yield batch.select(["g", "seq"]).take(pa.array(rows, pa.int64()))

    while True:
        small, now = by_size(now, tail)
        kept = kept.unionByName(small.repartition("g").sortWithinPartitions("g", "o").mapInArrow(scan, kind))
        if now is None:
            break
        cells = now.groupBy("g", "cell").agg(F.min("o").alias("o"))
        around = cells.withColumn("cell", F.explode(F.array(*[F.col("cell") + d for d in near_cells]))).groupBy("g", "cell").agg(F.min("o").alias("least"))
        new = cut(cells.join(around, ["g", "cell"]).filter("o = least").select("g", "cell", "o"))
        kept = kept.unionByName(new.select("g", F.col("o.s").alias("seq")))
        reach = new.select(F.col("g").alias("g_"), F.explode(F.array(*[F.col("cell") + d for d in near_cells])).alias("cell_"), F.col("o.s").alias("s"), (-F.col("o.a")).alias("a"))
        like = F.abs(F.col("area_m2") - F.col("a")) / F.greatest("area_m2", "a") <= share
        now = cut(now.join(reach, (F.col("g") == F.col("g_")) & (F.col("cell") == F.col("cell_")) & (like | (F.col("seq") == F.col("s"))), "left_anti"))
    chosen = kept.select(F.col("g").alias("g_"), F.col("seq").alias("s_"))
    same = (F.struct(P, "level", "slab_class") == F.col("g_")) & (F.col("seq") == F.col("s_"))
    alike = slabs.filter("area_m2 > 0").join(chosen, same, "left_semi")
    return alike.unionByName(slabs.filter("area_m2 IS NULL OR area_m2 <= 0"))


def renumber(df: DataFrame, prefix: str, column: str) -> DataFrame:
    """Ids prefix1, prefix2, ... per project in seq order."""
    return df.withColumn(column, F.concat(F.lit(prefix), F.row_number().over(Window.partitionBy(P).orderBy("seq")).cast("string")))


def floor_bounds(walls: DataFrame, slabs: DataFrame) -> DataFrame:
    """(project_id, bottom, top): the levels of lowest and highest rank; of equal rank the one seen first at the bottom, last at the top."""
    seen = walls.select(P, "level", "seq", F.lit(0).alias("kind")).unionByName(slabs.select(P, "level", "seq", F.lit(1).alias("kind")))
    levels = seen.groupBy(P, "level").agg(F.min(F.struct("kind", "seq")).alias("first"))
    key = F.struct(floor_rank("level").alias("rank"), "first")
    return levels.groupBy(P).agg(F.min_by("level", key).alias("bottom"), F.max_by("level", key).alias("top"))


def infer_slabs(walls: DataFrame, slabs: DataFrame, detected: DataFrame | None = None, sane: float = 800.0) -> DataFrame:
    """slabs with the missing ones inferred: floors from the perimeter ((length / 4) squared, up to 800), from the level's or the project's first known slab or from the level's raft,
    a raft below the bottom level, a roof over the top one. detected: the slabs before deduplication, whose classes say whether any roof was seen at all, and whose
    order of levels and classes is that of the slabs; within them slabs go by falling confidence and area.

    Levels are looked at bottom-up, of equal rank in the order seen, and a slab made for a lower level counts for higher ones. A project that ends without any raft gets
    one below its bottom level if any slab has an area by then; a roof finds such a slab at its own turn, which comes last."""
    detected = slabs if detected is None else detected
    lengths = walls.groupBy(P, "level").agg(
        F.sum(F.when(F.col("wall_class") == "external", F.col("length_m"))).alias("ext"), F.sum("length_m").alias("all")
    )
    perimeter = half_up(F.coalesce("ext", "all"), 6)
    square = F.pow(perimeter / 4.0, F.lit(2.0))
    estimate = F.when(square > sane, 0.0).otherwise(half_up(square))
    cls = F.col("slab_class")
    groups = detected.groupBy(F.col(P).alias("p_"), F.col("level").alias("l_"), cls.alias("c_")).agg(F.min("seq").alias("group_first"))
    own_group = (F.col(P) == F.col("p_")) & F.col("level").eqNullSafe(F.col("l_")) & cls.eqNullSafe(F.col("c_"))
    listed = slabs.join(groups, own_group, "left").select(P, "level", "slab_class", "area_m2", F.struct(F.coalesce("group_first", "seq"), -F.coalesce("confidence", F.lit(0.0)), -F.coalesce("area_m2", F.lit(0.0)), "seq").alias("o"))
    first = lambda cond: F.min_by(F.when(cond, F.col("area_m2")), F.when(cond, F.col("o")))
    known = listed.groupBy(P, "level").agg(
        F.max((cls == "floor").cast("int")).alias("has_floor"),
        F.max((cls == "raft").cast("int")).alias("has_raft"),
        F.max((cls == "roof").cast("int")).alias("has_roof"),
        first(cls.isin("floor", "raft")).alias("base_area"),
        first(cls == "roof").alias("roof_area"),
        first(cls == "raft").alias("raft_area"),
    )
    seen = walls.select(P, "level", "seq", F.lit(0).alias("kind")).unionByName(slabs.select(P, "level", "seq", F.lit(1).alias("kind")))
    levels = seen.groupBy(P, "level").agg(F.min(F.struct("kind", "seq")).alias("first_seen"))
    positive_area = F.col("area_m2") > 0
    project = listed.groupBy(P).agg(first(positive_area).alias("given"), F.max((cls == "raft").cast("int")).alias("any_raft"))
    any_roof = detected.groupBy(P).agg(F.max((cls == "roof").cast("int")).alias("saw_roof"))
    climb = Window.partitionBy(P).orderBy("rank", "first_seen")
    whole = Window.partitionBy(P)
    per_level = (
        levels.join(lengths.select(P, "level", estimate.alias("estimate")), [P, "level"], "left")
        .join(known, [P, "level"], "left")
        .join(project, P, "left")
        .join(any_roof, P, "left")
        .withColumn("rank", floor_rank("level"))
        .withColumn("step", F.row_number().over(climb))
        .withColumn("steps", F.count(F.lit(1)).over(whole))
    )
    zero = F.lit(0.0)
    positive = lambda c: F.when(F.coalesce(c, zero) > 0, c)
    # what a level would get by itself, before looking at other levels
    own_floor = F.coalesce(positive(F.col("estimate")), positive(F.col("base_area")), positive(F.col("roof_area")))
    needs_floor = F.coalesce("has_floor", F.lit(0)) == 0
    per_level = per_level.withColumn("made_below", F.first(F.when(needs_floor, own_floor), ignorenulls=True).over(climb.rowsBetween(Window.unboundedPreceding, -1)))
    got = per_level.withColumn("new_floor", F.when(needs_floor, F.coalesce(own_floor, F.col("given"), F.col("made_below"))))
    # the first floor or raft of the level counts, and given ones come before made ones
    base = positive(F.coalesce("base_area", "new_floor"))
    best = F.coalesce(base, positive(F.col("roof_area")), F.col("given"), F.col("made_below"), positive(F.col("estimate")))
    is_bottom, is_top = F.col("step") == 1, F.col("step") == F.col("steps")
    has_raft = F.coalesce("has_raft", F.lit(0)) == 1
    saw = F.coalesce("saw_roof", F.lit(0)) == 1
    needs_roof = is_top & (F.coalesce("has_roof", F.lit(0)) == 0)
    mirror = F.coalesce(F.col("base_area"), F.col("new_floor"))
    got = got.withColumns(
        {
            # where nothing has an area, a level with a raft alone still gets a floor of the raft's
            "raft_floor": F.when(needs_floor & F.col("new_floor").isNull() & has_raft, F.coalesce("raft_area", zero)),
            "new_raft": F.when(is_bottom & ~has_raft, best),
            "new_roof": F.when(needs_roof & saw, best).when(needs_roof & (mirror > 0) & (mirror <= sane), mirror),
        }
    )
    made = F.coalesce(positive(F.col("new_floor")), positive(F.col("new_raft")), positive(F.col("new_roof")))
    late = F.coalesce(F.col("given"), F.first(made, ignorenulls=True).over(climb.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    no_raft = (F.coalesce("any_raft", F.lit(0)) == 0) & F.col("new_raft").isNull()
    got = got.withColumn("late_raft", F.when(is_bottom & no_raft, late))
    slab = lambda kind, area, source, conf: F.when(
        area.isNotNull(), F.struct(F.lit(kind).alias("slab_class"), area.alias("area_m2"), source.alias("source"), conf.cast("double").alias("confidence"))
    )
    rows = F.array(
        slab("floor", F.col("new_floor"), F.lit("inferred_from_perimeter"), F.lit(0.5)),
        slab("floor", F.col("raft_floor"), F.lit("inferred_from_radier"), F.lit(0.5)),
        slab("raft", F.col("new_raft"), F.lit("inferred_radier"), F.lit(0.5)),
        slab("roof", F.col("new_roof"), F.when(saw, "inferred_coberta").otherwise("inferred_coberta_from_piso"), F.when(saw, 0.5).otherwise(0.4)),
    )
    end = F.array(slab("raft", F.col("late_raft"), F.lit("inferred_guaranteed"), F.lit(0.5)))
    # behind all given slabs, bottom-up, the guaranteed raft last
    numbered = lambda column, start: got.select(P, "level", "step", F.posexplode(column).alias("place", "s")).filter("s IS NOT NULL").select(P, "level", "s.*", (start + F.col("step") * 4 + F.col("place")).cast("long").alias("seq"), F.lit("L_auto").alias("slab_id"))
    new = numbered(rows, F.lit(1 << 41)).unionByName(numbered(end, F.lit(1 << 42)))
    return slabs.unionByName(new, allowMissingColumns=True)


def source_family() -> Column:
    s = F.coalesce("source", F.lit(""))
    return F.when(s.startswith("pdf_vector"), "vector").when(s.startswith("table"), "table").when(s == "ai_vision_takeoff", "takeoff").otherwise("ai")


def perimeter_audit(walls: DataFrame) -> DataFrame:
    """External length per level by family of sources. Against vector, else table, else the upper median, external walls of families more than 50 % off are
    for review, with confidence at most 0.55."""
    sums = walls.filter("wall_class = 'external'").groupBy(P, "level", source_family().alias("__family")).agg(half_up(F.sum(F.coalesce("length_m", F.lit(0.0))), 6).alias("len")).filter("len > 0")
    refs = sums.groupBy(P, "level").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col("__family") == "vector", F.col("len"))).alias("v"),
        F.max(F.when(F.col("__family") == "table", F.col("len"))).alias("t"),
        F.sort_array(F.collect_list("len")).alias("l"),
    )
    median = F.col("l")[F.floor(F.size("l") / 2).cast("int")]
    refs = refs.filter("n >= 2").select(
        P, "level", F.coalesce("v", "t", median).alias("ref"), F.when(F.col("v").isNotNull(), "vector").when(F.col("t").isNotNull(), "table").alias("truth")
    )
    bad = sums.join(refs, [P, "level"]).filter(~F.col("__family").eqNullSafe(F.col("truth")) & (F.abs(F.col("len") - F.col("ref")) / F.col("ref") > 0.5)).select(P, "level", "__family", F.lit(True).alias("__off"))
    review = F.coalesce("needs_review", F.lit(False)) if "needs_review" in walls.columns else F.lit(False)
    joined = walls.withColumn("__family", source_family()).join(bad, [P, "level", "__family"], "left")
    flag = F.coalesce("__off", F.lit(False)) & (F.col("wall_class") == "external") & ~review
    return joined.withColumns(
        {"needs_review": review | flag, "confidence": F.when(flag, F.least("confidence", F.lit(0.55))).otherwise(F.col("confidence"))}
    ).drop("__family", "__off")


def drop_overlapped_internal(walls: DataFrame, tolerance: float = 30.0, share: float = 0.30) -> DataFrame:
    """Internal walls that run along an external one (axes within 30, 30 % of the shorter overlapped) go; the first such external wall is for review
    with confidence at most 0.7. Candidates meet by level, direction and grid cell of the axis."""
    b = F.col("bbox")
    flat = (b["xmax"] - b["xmin"]) >= (b["ymax"] - b["ymin"])
    axis = F.when(flat, (b["ymin"] + b["ymax"]) / 2).otherwise((b["xmin"] + b["xmax"]) / 2)
    start, end = F.when(flat, b["xmin"]).otherwise(b["ymin"]), F.when(flat, b["xmax"]).otherwise(b["ymax"])
    lines = walls.filter(b.isNotNull() & F.col("wall_class").isin("internal", "external")).select(
        P, "level", "seq", "wall_class", flat.alias("flat"), axis.alias("axis"), start.alias("s"), end.alias("e"), F.floor(axis / tolerance).alias("cell")
    ).filter("e > s")
    inner = lines.filter("wall_class = 'internal'").withColumn("cell", F.explode(F.array(*(F.col("cell") + d for d in (-1, 0, 1)))))
    outer = lines.filter("wall_class = 'external'").select(P, "level", "flat", "cell", F.col("seq").alias("o_seq"), F.col("axis").alias("o_axis"), F.col("s").alias("o_s"), F.col("e").alias("o_e"))
    overlap = overlap_1d("s", "e", "o_s", "o_e")
    pairs = inner.join(outer, [P, "level", "flat", "cell"]).filter(
        (F.abs(F.col("axis") - F.col("o_axis")) <= tolerance) & (overlap / F.least(F.col("e") - F.col("s"), F.col("o_e") - F.col("o_s")) >= share)
    )
    hits = pairs.groupBy(P, "seq").agg(F.min("o_seq").alias("o_seq"))
    noted = hits.select(P, F.col("o_seq").alias("seq")).distinct().withColumn("__noted", F.lit(True))
    review = F.coalesce("needs_review", F.lit(False)) if "needs_review" in walls.columns else F.lit(False)
    kept = walls.join(hits.select(P, "seq"), [P, "seq"], "left_anti").join(noted, [P, "seq"], "left")
    mark = F.coalesce("__noted", F.lit(False))
    return kept.withColumns(
        {"needs_review": review | mark, "confidence": F.when(mark, F.least("confidence", F.lit(0.7))).otherwise(F.col("confidence"))}
    ).drop("__noted")


def display_labels(walls: DataFrame, slabs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels W001.. (external and internal), M001.. (boundary) and L001.. by level, class and falling size."""
    name = F.lower(F.coalesce(F.nullif("level", F.lit("")), F.lit("Terreo")))
    rank = (
        F.when(name.rlike("terreo|térreo"), 0).when(name.rlike("superior|1|primeiro"), 1).when(name.contains("subsolo"), 2).when(name.rlike("coberta|cobertura"), 3).otherwise(100)
    )
    order = [rank, F.col("level")]
    border = F.col("wall_class") == "boundary"
    w = Window.partitionBy(P, border).orderBy(*order, F.col("wall_class") != "external", F.desc(F.coalesce("length_m", F.lit(0.0))), "seq")
    s_rank = F.when(F.col("slab_class") == "roof", 0).when(F.col("slab_class") == "floor", 1).otherwise(2)
    s = Window.partitionBy(P).orderBy(*order, s_rank, F.desc(F.coalesce("area_m2", F.lit(0.0))), "seq")
    # more than 999 elements keep all their digits
    number = F.row_number().over(w).cast("string")
    padded = F.concat(F.when(border, "M").otherwise("W"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number))
    number_s = F.row_number().over(s).cast("string")
    padded_s = F.concat(F.lit("L"), F.when(F.length(number_s) < 3, F.lpad(number_s, 3, "0")).otherwise(number_s))
    return walls.withColumn("label", padded), slabs.withColumn("label", padded_s)
