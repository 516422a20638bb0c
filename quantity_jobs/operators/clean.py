"""Projections, cleaning and predicates. All narrow: no operator here shuffles, but for the counts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from .. import dims
from ..functions.exprs import clamp, finite, or_default, parse_decimal, positive_or, round_half_up as half_up


@dataclass(frozen=True)
class GeometryLimits:
    """Plausible measures in metres and square metres."""

    min_thickness: float = 0.06
    max_thickness: float = 0.40
    min_length: float = 0.30
    max_length: float = 50.0
    min_height: float = 1.5
    max_height: float = 6.0
    default_height: float = dims.WALL_HEIGHT
    min_area: float = 1.0
    max_area: float = 5000.0


def normalize_geometry(walls_raw: DataFrame, default_level: str = "Terreo") -> DataFrame:
    """Raw walls (text or number measures, aliases `length`, `height`) with defaults, classes and ordered boxes. raw_box is an
    array of four numbers in the order ymin, xmin, ymax, xmax; anything else gives no box."""

    def first_number(*names: str) -> Column:
        return F.coalesce(*(F.nullif(parse_decimal(n, None), F.lit(0.0)) for n in names), F.lit(0.0))

    box = F.col("raw_box")
    good = (F.size(box) == 4) & F.forall(box, lambda x: finite(x))
    ordered = F.struct(
        F.least(box[0], box[2]).alias("ymin"), F.least(box[1], box[3]).alias("xmin"), F.greatest(box[0], box[2]).alias("ymax"), F.greatest(box[1], box[3]).alias("xmax")
    )
    return walls_raw.select(
        "project_id",
        "seq",
        or_default("wall_id", "").alias("given_id"),
        or_default("level", default_level).alias("level"),
        F.when(F.col("wall_class").isin("boundary", "internal"), F.col("wall_class")).otherwise("external").alias("wall_class"),
        first_number("length_m", "length").alias("length_m"),
        positive_or(first_number("height_m", "height"), dims.WALL_HEIGHT).alias("height_m"),
        or_default(parse_decimal("thickness_m", dims.WALL_THICKNESS), dims.WALL_THICKNESS).alias("thickness_m"),
        or_default("source", "inferred_from_symbol").alias("source"),
        parse_decimal("confidence", 0.7).alias("confidence"),
        F.when(good, ordered).alias("bbox"),
    ).select("project_id", "seq", F.when(F.col("given_id") == "", F.concat(F.lit("P"), F.col("seq").cast("string"))).otherwise(F.col("given_id")).alias("wall_id"), "level", "wall_class", "length_m", "height_m", "thickness_m", "source", "confidence", "bbox")


def fix_units(walls: DataFrame) -> DataFrame:
    """Lengths above 50 and heights above 10 are centimetres."""
    long = F.col("length_m") > 50
    return walls.withColumns(
        {
            "length_m": F.when(long, F.col("length_m") / 100.0).otherwise(F.col("length_m")),
            "source": F.when(long, F.concat("source", F.lit("_cm_corrected"))).otherwise(F.col("source")),
            "height_m": F.when(F.col("height_m") > 10, F.col("height_m") / 100.0).otherwise(F.col("height_m")),
        }
    )


def opening_defaults(o: Column) -> Column:
    """Sizes of one opening where none is given."""
    door = o["kind"] == "door"
    return F.struct(
        o["kind"].alias("kind"),
        o["code"].alias("code"),
        F.when(door, positive_or(o["width_m"], dims.DOOR_WIDTH)).otherwise(positive_or(o["width_m"], dims.WINDOW_WIDTH)).alias("width_m"),
        F.when(door, positive_or(o["height_m"], dims.DOOR_HEIGHT)).otherwise(positive_or(o["height_m"], dims.WINDOW_HEIGHT)).alias("height_m"),
        F.when(door, o["sill_m"]).otherwise(positive_or(o["sill_m"], dims.WINDOW_SILL)).alias("sill_m"),
        o["source"].alias("source"),
    )


def openings_area(openings: Column, finish=lambda s: s) -> Column:
    return F.aggregate(openings, F.lit(0.0), lambda s, o: s + F.coalesce(o["width_m"] * o["height_m"], F.lit(0.0)), finish)


def wall_defaults(walls: DataFrame) -> DataFrame:
    """Measures that are missing get their defaults; height_source says where the height comes from."""
    filled = F.transform("openings", opening_defaults)
    given = F.col("height_source") if "height_source" in walls.columns else F.lit(None).cast("string")
    source = F.coalesce(
        F.nullif(given, F.lit("")), F.when(finite("height_m") & (F.col("height_m") > 0), F.when(F.col("source") == "table", "table").otherwise("ai")).otherwise("default")
    )
    out = walls.withColumns(
        {
            "height_source": source,
            "height_m": positive_or("height_m", dims.WALL_HEIGHT),
            "thickness_m": positive_or("thickness_m", dims.WALL_THICKNESS),
            "length_m": positive_or("length_m", 0.0),
            "openings": filled,
        }
    )
    return out.withColumn("opening_area_m2", F.coalesce(openings_area(F.col("openings"), lambda s: F.nullif(s, F.lit(0.0))), "opening_area_m2", F.lit(0.0)))


def assumption_log(walls: DataFrame, slabs: DataFrame) -> DataFrame:
    """(project_id, element, element_id, field, value, unit) of every default that applies to external and internal walls, openings and slabs."""

    def entry(missing: Column, field: str, value) -> Column:
        return F.when(missing, F.struct(F.lit(field).alias("field"), F.lit(value).cast("string").alias("value"), F.lit("m").alias("unit")))

    def listed(df: DataFrame, element: str, key: str, *entries: Column) -> DataFrame:
        found = F.filter(F.array(*entries), lambda x: x.isNotNull())
        return df.select("project_id", F.lit(element).alias("element"), F.col(key).alias("element_id"), F.explode(found).alias("x")).select(
            "project_id", "element", "element_id", "x.*"
        )

    absent = lambda c: F.coalesce(~(F.col(c) > 0), F.lit(True))
    own = walls.filter(F.col("wall_class") != "boundary")
    opens = walls.select("project_id", "wall_id", F.posexplode("openings").alias("pos", "o")).select(
        "project_id", F.concat("wall_id", F.lit("."), F.col("pos").cast("string")).alias("opening_id"), "o.*"
    )
    door, window, high = F.col("kind") == "door", F.col("kind") == "window", F.col("sill_m") > dims.HIGH_SILL
    ground = (F.col("slab_class") == "floor") & (F.coalesce("level", F.lit("")) == "") | (F.col("slab_class") == "floor") & F.lower("level").rlike("terreo|térreo")
    raft = slabs.filter(ground).select(
        "project_id", F.lit("slab").alias("element"), F.col("slab_id").alias("element_id"), F.lit("foundation").alias("field"), F.lit("raft").alias("value"), F.lit("").alias("unit")
    )
    return (
        listed(own, "wall", "wall_id", entry(absent("height_m"), "height", dims.WALL_HEIGHT))
        .unionByName(
            listed(
                opens,
                "opening",
                "opening_id",
                entry(door & absent("width_m"), "width", dims.DOOR_WIDTH),
                entry(door & absent("height_m"), "height", dims.DOOR_HEIGHT),
                entry(window & absent("width_m"), "width", dims.WINDOW_WIDTH),
                entry(window & absent("height_m") & F.coalesce(high, F.lit(False)), "height", dims.HIGH_WINDOW_HEIGHT),
                entry(window & absent("height_m") & ~F.coalesce(high, F.lit(False)), "height", dims.WINDOW_HEIGHT),
                entry(window & absent("sill_m"), "sill", dims.WINDOW_SILL),
            )
        )
        .unionByName(raft)
    )


def wall_fault(limits: GeometryLimits = GeometryLimits()) -> Column:
    """Why a wall is dropped: not_finite, thin, thick, tiny, huge; null if it is kept."""
    thick = positive_or("thickness_m", dims.WALL_THICKNESS)
    return (
        F.when(~finite("length_m") | (F.col("length_m") <= 0), "not_finite")
        .when(thick < limits.min_thickness, "thin")
        .when(thick > limits.max_thickness, "thick")
        .when(F.col("length_m") < limits.min_length, "tiny")
        .when(F.col("length_m") > limits.max_length, "huge")
    )


def slab_fault(limits: GeometryLimits = GeometryLimits()) -> Column:
    return (
        F.when(~finite("area_m2") | (F.col("area_m2") <= 0), "not_finite").when(F.col("area_m2") < limits.min_area, "tiny").when(F.col("area_m2") > limits.max_area, "huge")
    )


def wall_kept(limits: GeometryLimits = GeometryLimits()) -> Column:
    """wall_fault is null, in few terms: filters are pushed down through what computes the measures, so each mention counts."""
    t, default = F.col("thickness_m"), dims.WALL_THICKNESS
    thick = F.when((t > 0) & (t < float("inf")), t.between(limits.min_thickness, limits.max_thickness)).otherwise(limits.min_thickness <= default <= limits.max_thickness)
    return F.col("length_m").between(max(limits.min_length, 1e-300), limits.max_length) & thick


def _height_off(limits: GeometryLimits) -> Column:
    """Null and NaN are off too."""
    return ~F.coalesce(F.col("height_m").between(limits.min_height, limits.max_height), F.lit(False))


def validate_geometry(walls: DataFrame, slabs: DataFrame, limits: GeometryLimits = GeometryLimits()) -> tuple[DataFrame, DataFrame]:
    """Walls and slabs of plausible measures; implausible heights snap to the default."""
    kept = walls.filter(wall_kept(limits)).withColumns(
        {
            "thickness_m": positive_or("thickness_m", dims.WALL_THICKNESS),
            "height_m": F.when(_height_off(limits), F.lit(limits.default_height)).otherwise(F.col("height_m")),
        }
    )
    return kept, slabs.filter(F.col("area_m2").between(max(limits.min_area, 1e-300), limits.max_area))


def validation_stats(walls: DataFrame, slabs: DataFrame, limits: GeometryLimits = GeometryLimits()) -> DataFrame:
    """Per project: rows before and after, rows by fault, heights snapped."""
    own = walls.select("project_id", F.lit("wall").alias("kind"), wall_fault(limits).alias("fault"), _height_off(limits).alias("snap"))
    both = own.unionByName(slabs.select("project_id", F.lit("slab").alias("kind"), slab_fault(limits).alias("fault"), F.lit(False).alias("snap")))
    n = lambda c: F.count_if(c)
    kind, fault = F.col("kind"), F.col("fault")
    counts = {f"{k}s_before": n(kind == k) for k in ("wall", "slab")} | {f"{k}s_after": n((kind == k) & fault.isNull()) for k in ("wall", "slab")}
    counts |= {f"wall_{f}": n((kind == "wall") & (fault == f)) for f in ("not_finite", "thin", "thick", "tiny", "huge")}
    counts |= {f"slab_{f}": n((kind == "slab") & (fault == f)) for f in ("not_finite", "tiny", "huge")}
    counts["snapped"] = n((kind == "wall") & fault.isNull() & F.col("snap"))
    return both.groupBy("project_id").agg(*(c.alias(k) for k, c in counts.items()))


def cap_thickness(walls: DataFrame, max_thickness: float = 0.12, sample: int = 5) -> tuple[DataFrame, DataFrame]:
    """Walls up to the thickness, and per project how many went, with the first few ids."""
    thick = F.coalesce(F.col("thickness_m") > max_thickness, F.lit(False))
    gone = walls.filter(thick).groupBy("project_id").agg(F.count(F.lit(1)).alias("removed"), F.min_by("wall_id", "seq").alias("first_id"))
    return walls.filter(~thick), gone


def apply_scope(elements: DataFrame, scope: DataFrame, category: Column) -> DataFrame:
    """Elements with `enabled`: whether their category (ext, int, boundary, floor, roof, corners) is on for the
    project; projects without a row have everything on. scope has one boolean column per category."""
    names = [c for c in scope.columns if c != "project_id"]
    flag = F.element_at(F.create_map(*(x for c in names for x in (F.lit(c), F.col(f"scope.{c}")))), category)
    packed = scope.select("project_id", F.struct(*names).alias("scope"))
    return elements.join(packed, "project_id", "left").withColumn("enabled", F.coalesce(flag, F.lit(True))).drop("scope")


#: Columns of the area pages by category.
AREA_CATEGORIES = {
    "ext": ("ext_gross", "ext_open", "ext_net"),
    "int": ("int_gross", "int_open", "int_net"),
    "boundary": ("boundary_gross",),
    "floor": ("floor_m2",),
    "roof": ("roof_m2",),
}


def scope_zero(area_pages: DataFrame, scope: DataFrame) -> DataFrame:
    """Area pages with zeros in the categories that a project's scope leaves out."""
    flags = scope.select("project_id", *(F.col(c).alias(f"on_{c}") for c in AREA_CATEGORIES))
    zeroed = {c: F.when(F.coalesce(f"on_{k}", F.lit(True)), F.col(c)).otherwise(F.lit(0.0)) for k, names in AREA_CATEGORIES.items() for c in names}
    return area_pages.join(flags, "project_id", "left").withColumns(zeroed).drop(*(f"on_{c}" for c in AREA_CATEGORIES))


def clean_sections(sections: DataFrame) -> DataFrame:
    """Sections with a ceiling in (1.5, 8], confidence within 0 and 1, a level name."""
    return sections.filter(finite("ceiling_m") & (F.col("ceiling_m") > 1.5) & (F.col("ceiling_m") <= 8)).withColumns(
        {"confidence": clamp(F.coalesce("confidence", F.lit(0.5)), 0, 1), "level": or_default("level", "Terreo")}
    )


def clean_polygons(polygons: DataFrame, column: str = "polygon") -> DataFrame:
    """Vertices within the 0-1000 page; polygons of three vertices or more."""
    inside = F.filter(column, lambda p: finite(p["x"]) & finite(p["y"]) & p["x"].between(0, 1000) & p["y"].between(0, 1000))
    return polygons.withColumn(column, inside).filter(F.size(column) >= 3)


def clean_segments(segments: DataFrame) -> DataFrame:
    """Segments within the page and at least 5 units long; thickness 0.3-5 and confidence 0-1."""
    ends = ("x1", "y1", "x2", "y2")
    inside = F.lit(True)
    for c in ends:
        inside &= finite(c) & F.col(c).between(0, 1000)
    return segments.filter(inside & (F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) >= 5)).withColumns(
        {"thickness_pct": clamp(or_default("thickness_pct", 1.2), 0.3, 5), "confidence": clamp(or_default("confidence", 0.7), 0, 1)}
    )


def clean_dimensions(dimensions: DataFrame) -> DataFrame:
    """Readings in (0, 50] metres within the page; unknown orientations are `unknown`."""
    inside = finite("value_m") & (F.col("value_m") > 0) & (F.col("value_m") <= 50) & F.col("x").between(0, 1000) & F.col("y").between(0, 1000)
    return dimensions.filter(inside).withColumn("orientation", F.when(F.col("orientation").isin("horizontal", "vertical"), F.col("orientation")).otherwise("unknown"))


def clean_range(low: Column, high: Column, least: float, most: float, default: tuple[float, float]) -> Column:
    """(low, high) of two finite numbers: as they are within the limits, exchanged (and then not tested) where low exceeds high, else the default pair."""
    numbers = finite(low) & finite(high)
    pair = lambda a, b: F.struct(a.cast("double").alias("low"), b.cast("double").alias("high"))
    inside = (low >= least) & (high <= most)
    return F.when(numbers & (low > high), pair(high, low)).when(numbers & inside, pair(low, high)).otherwise(pair(*map(F.lit, default)))


#: Enums of a project characterisation, and its ranges (least, most, default low, default high).
TYPOLOGIES = ("casa_terrea", "casa_2_pavimentos", "sobrado", "edificio", "comercial_loja", "comercial_sala", "industrial_galpao", "outro")
STANDARDS = ("popular", "medio", "alto")
ENVELOPE_SHAPES = ("retangular_simples", "L", "U", "irregular")
CONFIDENCES = ("high", "medium", "low")
RANGES = {
    "walls": (1.0, 500.0, 8.0, 25.0),
    "openings": (0.0, 200.0, 4.0, 16.0),
    "thickness": (0.04, 0.5, 0.10, 0.15),
    "ceiling": (1.8, 8.0, 2.5, 3.0),
    "area": (10.0, 50000.0, 60.0, 200.0),
}
FEATURE_FLAGS = ("has_roof", "has_garage", "has_boundary", "has_pergola")
MOST_LEVELS, MOST_ROOMS, MOST_NOTES = 10, 30, 600


def clean_ranges(characterizations: DataFrame) -> DataFrame:
    """Characterisations (project_id and any of: typology, standard, envelope_shape, confidence, levels, programme, ranges as <name>_low and
    <name>_high, flags, notes) with known enums, plausible ranges, named levels, a programme of rooms and short notes. What is absent gets its default."""
    given = set(characterizations.columns)
    of = lambda name, kind: F.col(name) if name in given else F.lit(None).cast(kind)
    one_of = lambda name, known, default: F.when(of(name, "string").isin(*known), of(name, "string")).otherwise(default).alias(name)
    pairs = {k: clean_range(of(f"{k}_low", "double"), of(f"{k}_high", "double"), lo, hi, (a, b)) for k, (lo, hi, a, b) in RANGES.items()}
    levels = F.slice(F.filter(of("levels", "array<string>"), lambda x: F.trim(x) != ""), 1, MOST_LEVELS)
    rooms = F.filter(of("programme", "array<struct<room:string,qty:double>>"), lambda x: x["room"].isNotNull() & finite(x["qty"]))
    counted = F.transform(rooms, lambda x: F.struct(F.trim(F.lower(x["room"])).alias("room"), F.greatest(F.lit(0.0), F.floor(x["qty"] + 0.5)).cast("long").alias("qty")))
    return characterizations.select(
        "project_id",
        one_of("typology", TYPOLOGIES, "outro"),
        one_of("standard", STANDARDS, "medio"),
        one_of("envelope_shape", ENVELOPE_SHAPES, "retangular_simples"),
        one_of("confidence", CONFIDENCES, "low"),
        F.when(F.size(levels) > 0, levels).otherwise(F.array(F.lit("Terreo"))).alias("levels"),
        F.coalesce(F.slice(counted, 1, MOST_ROOMS), F.array().cast("array<struct<room:string,qty:bigint>>")).alias("programme"),
        *(pairs[k]["low"].alias(f"{k}_low") for k in RANGES),
        *(pairs[k]["high"].alias(f"{k}_high") for k in RANGES),
        *(F.coalesce(of(f, "boolean"), F.lit(False)).alias(f) for f in FEATURE_FLAGS),
        F.substring(F.coalesce(of("notes", "string"), F.lit("")), 1, MOST_NOTES).alias("notes"),
    )


#: Words that name a room, by the kind of room, and words of a title block. They are searched anywhere in the folded text, in this order.
ROOM_WORDS = {
    "internal": (
        "sala", "estar", "jantar", "tv", "quarto", "dormitorio", "suite", "ste", "cozinha", "copa", "banho", "banheiro", "bwc", "wc", "lavabo", "sanitario",
        "lavanderia", "area de servico", "as", "dispensa", "despensa", "hall", "corredor", "circulacao", "passagem", "escritorio", "office", "closet", "vestiario",
        "biblioteca", "estudio", "deposito", "storage", "escada", "elevador", "shaft",
    ),
    "covered": (
        "varanda", "sacada", "balcao", "terraco coberto", "garagem", "abrigo", "carport", "santuario", "alpendre", "varandao", "pergolado coberto", "passarela coberta",
    ),
    "uncovered": (
        "jardim", "quintal", "patio", "piscina", "espelho dagua", "espelho d'agua", "churrasqueira", "deck", "estacionamento", "horta", "canteiro", "rua", "calcada", "acesso",
    ),
}
TITLE_WORDS = ("escala", "data", "prancha", "projeto", "obra", "responsavel", "arquiteto", "engenheiro", "cliente", "endereco", "norte", "n")
#: Lengths above MOST_METRES are none, those above CENTIMETRES_FROM are centimetres.
MOST_METRES, CENTIMETRES_FROM = 50.0, 30.0


def classify_text(tokens: DataFrame, column: str = "text") -> DataFrame:
    """tokens with text_class (`dimension`, `door_window_code`, `room_label`, `title_block` or `other`, tested in that order), room_type of room labels (`internal`,
    `covered`, `uncovered`) and dimension_m. A number out of range is `other` at once."""
    from ..functions.exprs import fold_accents

    lower = F.translate(F.lower(fold_accents(F.trim(F.coalesce(column, F.lit(""))))), "¹²³ºª", "123oa")
    # columns of their own, since each is looked at many times
    tokens = tokens.withColumn("__text", F.regexp_replace(lower, r"\s+", " "))
    text = F.col("__text")
    tokens = tokens.withColumn("__digits", F.regexp_replace(F.translate(text, ",", "."), "[ m]", ""))
    number = F.col("__digits")
    value = F.when(number.rlike(r"^\d+(\.\d+)?$"), number.try_cast("double"))
    good = value.isNotNull() & (value > 0) & (value <= MOST_METRES)
    has = lambda names: reduce(or_, (text.contains(n) for n in names))
    code = F.regexp_replace(text, " ", "").rlike(r"^[pj][a-z]?\d{1,3}$")
    room = None
    for kind, names in ROOM_WORDS.items():
        room = F.when(has(names), kind) if room is None else room.when(has(names), kind)
    read = tokens.withColumns({"__metres": F.when(good, F.when(value > CENTIMETRES_FROM, value / 100.0).otherwise(value)), "__number": value.isNotNull(), "__code": code, "__room": room, "__title": has(TITLE_WORDS) & (text != "")})
    plain = ~F.col("__number") & ~F.col("__code")
    out = (
        F.when(F.col("__metres").isNotNull(), "dimension").when(F.col("__number"), "other").when(F.col("__code"), "door_window_code")
        .when(F.col("__room").isNotNull(), "room_label").when(F.col("__title"), "title_block").otherwise("other")
    )
    done = read.withColumns({"text_class": out, "room_type": F.when(plain, F.col("__room")), "dimension_m": F.col("__metres")})
    return done.drop("__text", "__digits", "__metres", "__number", "__code", "__room", "__title")


def segment_bbox(segments: DataFrame) -> DataFrame:
    """segments with the box around the line and its thickness, within the page."""
    half = F.col("thickness_pct") / 100.0 * 1000.0 / 2.0
    low = lambda a, b: F.greatest(F.lit(0.0), F.least(a, b) - half)
    high = lambda a, b: F.least(F.lit(1000.0), F.greatest(a, b) + half)
    return segments.withColumn("bbox", F.struct(low("y1", "y2").alias("ymin"), low("x1", "x2").alias("xmin"), high("y1", "y2").alias("ymax"), high("x1", "x2").alias("xmax")))


#: Event kinds that are not stored.
TRANSIENT_KINDS = ("page_split", "cv_substep")


def persistable(events: DataFrame) -> DataFrame:
    """Events worth storing; works on streams too."""
    return events.filter(~F.col("kind").isin(*TRANSIENT_KINDS) & ~((F.col("kind") == "ai_call") & (F.col("phase") == "started")))


def error_feed(events: DataFrame) -> DataFrame:
    """Failed phases, and audit findings of warning or error."""
    return events.filter((F.col("phase") == "failed") | (F.col("kind") == "audit") & F.col("severity").isin("warning", "error"))


#: Numbers of pipeline stages, by kind of event and by how a prompt's version begins, in order of search.
KIND_STAGES = {"cv_substep": "3.4", "image_render": "7.5", "page_split": "0.5"}
PROMPT_STAGES = (
    ("classifyAndExtract", "1"),
    ("characterizeProject", "1.5"),
    ("extractGeometry", "3"),
    ("verify", "3.5"),
    ("wallInventory", "3.5"),
    ("cotaReader", "3.6"),
    ("envelope", "3.7"),
    ("selfCheck", "6.5"),
    ("globalCrossValidation", "4.6"),
    ("globalValidation", "4.6"),
    ("description", "8"),
    ("describe", "8"),
    ("sectionInfo", "0.5"),
    ("buildingType", "1"),
)


def infer_stage(events: DataFrame) -> DataFrame:
    """events with stage_id: a stage event's own, the kind's, an audit's own or 6.5, else what the prompt says, `?` if nothing. No kind counts as a model call."""
    kind, prompt = F.coalesce("kind", F.lit("ai_call")), F.coalesce("prompt_version", F.lit(""))
    stage = F.when(kind == "stage", F.col("stage")).when(kind == "audit", F.coalesce("stage", F.lit("6.5")))
    for name, number in KIND_STAGES.items():
        stage = stage.when(kind == name, number)
    for start, number in PROMPT_STAGES:
        stage = stage.when(prompt.startswith(start), number)
    return events.withColumn("stage_id", stage.otherwise("?"))


def feedback_signature(df: DataFrame, thickness="thickness_cm", length="length_dm", window="has_window", door="has_door", wall_class="original_class") -> DataFrame:
    """df with signature: thickness (cm), length (dm), windows, doors and class; `x` for what is unknown."""
    flag = lambda c: F.when(F.col(c), "1").when(~F.col(c), "0").otherwise("x")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("x"))
    return df.withColumn("signature", F.concat_ws("|", text(thickness), text(length), flag(window), flag(door), text(wall_class)))


#: Enums and limits of a feedback row.
WALL_CLASSES = ("external", "internal", "boundary")
FEEDBACK_ACTIONS = ("confirm", "correct", "exemplar", "not_wall")
MOST_FEEDBACK = {"thickness_m": 10.0, "length_m": 1000.0}
LONGEST_FEEDBACK = {"level": 64, "reason_bucket": 64, "notes": 500}


def feedback_validate(raw: DataFrame, users: DataFrame) -> DataFrame:
    """raw (project_id, user_id, wall_id, action; maybe thickness_m, length_m, original_class, corrected_class, is_exemplar, level, reason_bucket, notes) with `valid`, the
    sizes as thickness_cm and length_dm (null where 0 or absent), and is_exemplar only where an admin asks for it. Feedback without a project is an admin's only."""
    given = set(raw.columns)
    of = lambda name, kind: F.col(name) if name in given else F.lit(None).cast(kind)
    absent_or = lambda c, test: c.isNull() | test
    cls, corrected = of("original_class", "string"), of("corrected_class", "string")
    ok = (
        F.col("action").isin(*FEEDBACK_ACTIONS)
        & absent_or(cls, cls.isin(*WALL_CLASSES))
        & absent_or(corrected, corrected.isin(*WALL_CLASSES, "not_wall"))
        & F.length(F.trim("wall_id")).between(1, 64)
    )
    for name, most in MOST_FEEDBACK.items():
        ok &= absent_or(of(name, "double"), of(name, "double").between(0, most))
    for name, most in LONGEST_FEEDBACK.items():
        ok &= absent_or(of(name, "string"), F.length(F.trim(of(name, "string"))) <= most)
    admins = users.select("user_id", "is_admin").groupBy("user_id").agg(F.bool_or("is_admin").alias("__admin"))
    joined = raw.join(admins, "user_id", "left")
    admin = F.coalesce("__admin", F.lit(False))
    size = lambda name, scale: F.when(of(name, "double") > 0, F.floor(of(name, "double") * scale + 0.5).cast("long"))
    return joined.withColumns(
        {
            "valid": F.coalesce(ok, F.lit(False)) & (F.col("project_id").isNotNull() | admin),
            "is_exemplar": admin & (F.coalesce(of("is_exemplar", "boolean"), F.lit(False)) | F.coalesce(F.col("action") == "exemplar", F.lit(False))),
            "thickness_cm": size("thickness_m", 100.0),
            "length_dm": size("length_m", 10.0),
        }
    ).drop("__admin")


def synthetic_elements(area_pages: DataFrame, heights: DataFrame | None = None, default_height: float = dims.WALL_HEIGHT) -> tuple[DataFrame, DataFrame]:
    """Area totals per level as one wall per class and one slab per class. Pages have file_seq and page_index, or page, for their order, and section_height. A wall's area is the gross one, or the net where
    there is none; its length is area / height. Heights are the project's: those of `heights` (project_id, height_m), else of its first section, else the default; boundaries take
    that of the level's first page. Pages without a level are levels of their own."""
    order = F.struct(*(["page"] if "page" in area_pages.columns else ["file_seq", "page_index"]))
    number = F.col("page") if "page" in area_pages.columns else F.col("page_index")
    level = F.coalesce(F.nullif("level", F.lit("")), F.concat(F.lit("Pavimento "), number.cast("string")))
    sums = area_pages.groupBy("project_id", level.alias("level")).agg(
        *(half_up(F.sum(c), 6).alias(c) for names in AREA_CATEGORIES.values() for c in names), F.coalesce(F.min_by("boundary_height", order), F.lit(2.0)).alias("boundary_height")
    )
    if heights is None:
        section = F.when(F.col("section_height") > 0, F.col("section_height"))
        heights = area_pages.groupBy("project_id").agg(F.min_by(section, F.when(section.isNotNull(), order)).alias("height_m"))
    own = sums.join(heights.select("project_id", F.coalesce("height_m", F.lit(default_height)).alias("tall")), "project_id", "left").withColumn("tall", F.coalesce("tall", F.lit(default_height)))
    line = lambda kind, gross, net, openings, height: F.struct(
        F.lit(kind).alias("wall_class"), F.when(F.col(gross) > 0, F.col(gross)).otherwise(F.col(net)).alias("gross_m2"), F.col(net).alias("net_m2"), openings.alias("opening_area_m2"), height.alias("height_m")
    )
    rows = F.array(
        line("external", "ext_gross", "ext_net", F.col("ext_open"), F.col("tall")),
        line("internal", "int_gross", "int_net", F.col("int_open"), F.col("tall")),
        line("boundary", "boundary_gross", "boundary_gross", F.lit(0.0), F.col("boundary_height")),
    )
    walls = own.select("project_id", "level", F.explode(rows).alias("x")).select("project_id", "level", "x.*").filter("gross_m2 > 0")
    length = F.when(F.col("height_m") > 0, F.col("gross_m2") / F.col("height_m")).otherwise(0.0)
    walls = walls.withColumns({"length_m": half_up(length), "opening_area_m2": half_up("opening_area_m2"), "height_m": half_up("height_m"), "thickness_m": F.lit(0.15), "confidence": F.lit(0.7)})
    slabs = (
        sums.select("project_id", "level", F.explode(F.create_map(F.lit("floor"), F.col("floor_m2"), F.lit("roof"), F.col("roof_m2"))).alias("slab_class", "area_m2"))
        .filter("area_m2 > 0")
    )
    return walls, slabs
