"""Wall classes: by score, by envelope, by markers and by people's feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.exprs import point_in_polygon
from .clean import feedback_signature
from .rounds import cut, nearest

P = "project_id"


def external_score() -> Column:
    """How likely a wall is external: its length, windows, wide doors, and a box near the page's edge."""
    b = F.col("bbox")
    wide = F.coalesce("has_door", F.lit(False)) & F.exists("openings", lambda o: F.coalesce(o["width_m"] >= 1.0, F.lit(False)))
    edge = (b["ymin"] < 100) | (b["xmin"] < 100) | (b["ymax"] > 900) | (b["xmax"] > 900)
    plus = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0.0))
    return F.col("length_m") + plus(F.coalesce("has_window", F.lit(False)), 2.0) + plus(wide, 1.5) + plus(F.coalesce(edge, F.lit(False)), 3.0)


def _ranked(walls: DataFrame, heuristics: DataFrame) -> DataFrame:
    """walls with the project's heuristics, counts without boundary walls, score and rank. walls has building_type (null: generic)."""
    config = heuristics.select(F.col("building_type").alias("__bt"), "min_internal", "perimeter_share", "max_perimeter")
    own = walls.withColumn("__bt", F.coalesce("building_type", F.lit("generico"))).join(F.broadcast(config), "__bt", "left")
    inside = F.col("wall_class") != "boundary"
    own = own.withColumn("score", external_score()).withColumn("__in", inside)
    w = Window.partitionBy(P)
    ranks = F.row_number().over(Window.partitionBy(P, "__in").orderBy(F.desc("score"), "seq"))
    own = own.withColumns(
        {
            "__n": F.count_if("__in").over(w),
            "__internal": F.count_if(F.col("wall_class") == "internal").over(w),
            "__rank": F.when(F.col("__in"), ranks),
            "__hi": F.greatest(F.max(F.when(F.col("__in"), F.col("score"))).over(w), F.lit(1.0)),
            "__lo": F.least(F.min(F.when(F.col("__in"), F.col("score"))).over(w), F.lit(0.0)),
        }
    )
    return own.withColumn("__top", F.least(F.ceil(F.col("__n") * F.col("perimeter_share")), F.col("max_perimeter")))


def reclassify_by_score(walls: DataFrame, heuristics: DataFrame) -> DataFrame:
    """Projects of six walls or more without any internal one, of types that expect them: only the best-scored perimeter stays external, the
    rest become internal, for review."""
    own = _ranked(walls, heuristics)
    flip = (F.col("__n") >= 6) & (F.col("__internal") == 0) & (F.col("min_internal") > 0.15) & F.col("__in") & (F.col("__rank") > F.col("__top"))
    flip = F.coalesce(flip, F.lit(False))
    review = F.coalesce("needs_review", F.lit(False)) if "needs_review" in walls.columns else F.lit(False)
    out = own.withColumns({"wall_class": F.when(flip, "internal").otherwise(F.col("wall_class")), "needs_review": review | flip})
    return out.select(*dict.fromkeys([*walls.columns, "needs_review"]))


def flag_class_vs_score(walls: DataFrame, heuristics: DataFrame) -> DataFrame:
    """Projects of four walls or more: external walls of low score outside the expected perimeter, and internal ones of high score inside it, are for review
    with confidence at most 0.6. Rows for review already stay as they are."""
    own = _ranked(walls, heuristics)
    norm = (F.col("score") - F.col("__lo")) / F.greatest(F.col("__hi") - F.col("__lo"), F.lit(0.001))
    expected = F.col("__rank") <= F.col("__top")
    review = F.coalesce("needs_review", F.lit(False)) if "needs_review" in walls.columns else F.lit(False)
    odd = ((F.col("wall_class") == "external") & (norm < 0.35) & ~expected) | ((F.col("wall_class") == "internal") & (norm > 0.7) & expected)
    flag = F.coalesce((F.col("__n") >= 4) & F.col("__in") & ~review & odd, F.lit(False))
    out = own.withColumns({"needs_review": review | flag, "confidence": F.when(flag, F.least("confidence", F.lit(0.6))).otherwise(F.col("confidence"))})
    return out.select(*dict.fromkeys([*walls.columns, "needs_review"]))


def nearest_hint_class(walls: DataFrame, hints: DataFrame, probe: float = 50.0) -> DataFrame:
    """Two probes across each wall take the side of the marker nearest to them (of the level, else those for all levels): outside and inside
    make an external wall, twice inside an internal one. Adds hinted."""
    b = F.col("bbox")
    flat = (b["xmax"] - b["xmin"]) >= (b["ymax"] - b["ymin"])
    cx, cy = (b["xmin"] + b["xmax"]) / 2, (b["ymin"] + b["ymax"]) / 2
    # a level without markers looks at those for all levels
    levels = hints.select(P, "level").distinct().withColumn("__own", F.lit(True))
    keyed = walls.filter(b.isNotNull()).join(levels, [P, "level"], "left").withColumn("h_level", F.when(F.col("__own"), F.col("level")).otherwise("all"))
    spots = F.array(*(F.struct(F.lit(k).alias("probe"), F.when(flat, cx).otherwise(cx + d).alias("px"), F.when(flat, cy + d).otherwise(cy).alias("py")) for k, d in ((1, -probe), (2, probe))))
    probes = keyed.select(P, "h_level", "seq", F.explode(spots).alias("s")).select(P, "h_level", "seq", "s.*")
    sides = nearest(probes, hints.withColumnRenamed("level", "h_level"), [P, "h_level"], ["seq", "probe"], "side", probe)
    both = sides.groupBy(P, "seq").agg(F.max(F.when(F.col("probe") == 1, F.col("side"))).alias("s1"), F.max(F.when(F.col("probe") == 2, F.col("side"))).alias("s2"))
    own = walls.join(both, [P, "seq"], "left")
    out, inn = "exterior", "interior"
    target = F.when(((F.col("s1") == out) & (F.col("s2") == inn)) | ((F.col("s1") == inn) & (F.col("s2") == out)), "external").when(
        (F.col("s1") == inn) & (F.col("s2") == inn), "internal"
    )
    changed = F.coalesce(b.isNotNull() & (F.col("wall_class") != "boundary") & (target != F.col("wall_class")), F.lit(False))
    return own.withColumns(
        {
            "hinted": changed,
            "confidence": F.when(changed, F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.95))).otherwise(F.col("confidence")),
            "wall_class": F.when(changed, target).otherwise(F.col("wall_class")),
        }
    ).drop("s1", "s2")


def _with_envelope(df: DataFrame, envelopes: DataFrame) -> DataFrame:
    """df with polygon and lot of its level: by name, else by the name in lower case."""
    level = F.coalesce(F.nullif("level", F.lit("")), F.lit("Terreo"))
    first = lambda key: envelopes.groupBy(P, key.alias("__key")).agg(F.min_by(F.struct("polygon", "lot_polygon"), F.struct("page_index", "level")).alias("e"))
    exact = first(F.col("level")).withColumnsRenamed({"__key": "__l", "e": "e1"})
    loose = first(F.lower("level")).withColumnsRenamed({"__key": "__ll", "e": "e2"})
    own = df.withColumn("__l", level).withColumn("__ll", F.lower(level))
    return own.join(exact, [P, "__l"], "left").join(loose, [P, "__ll"], "left").withColumn("env", F.coalesce("e1", "e2")).drop("__l", "__ll", "e1", "e2")


def _sides(df: DataFrame, ax: Column, ay: Column, bx: Column, by: Column) -> DataFrame:
    return df.withColumns({"__ax": ax, "__ay": ay, "__bx": bx, "__by": by}).withColumns(
        {
            f"__{n}{s}": point_in_polygon(F.col(f"__{s}x"), F.col(f"__{s}y"), F.col(f"env.{p}"))
            for n, p in (("in", "polygon"), ("lot", "lot_polygon"))
            for s in ("a", "b")
        }
    )


def topology_class(walls: DataFrame, envelopes: DataFrame) -> DataFrame:
    """Two points off a wall's axis against the level's envelope and lot: both inside is internal, one is external, none is boundary within the
    lot, else external for review. Walls without envelope or box keep their class. Adds topology_changed."""
    b = F.col("bbox")
    width, height = b["xmax"] - b["xmin"], b["ymax"] - b["ymin"]
    cx, cy = (b["xmin"] + b["xmax"]) / 2, (b["ymin"] + b["ymax"]) / 2
    flat = width >= height
    off = F.greatest(F.when(flat, height).otherwise(width) / 2 + 20.0, F.lit(25.0))
    own = _sides(
        _with_envelope(walls, envelopes),
        F.when(flat, cx).otherwise(cx - off),
        F.when(flat, cy - off).otherwise(cy),
        F.when(flat, cx).otherwise(cx + off),
        F.when(flat, cy + off).otherwise(cy),
    )
    known = F.col("env").isNotNull() & b.isNotNull()
    both, none = F.col("__ina") & F.col("__inb"), ~F.col("__ina") & ~F.col("__inb")
    lot = F.col("__lota") & F.col("__lotb")
    target = F.when(both, "internal").when(none & lot, "boundary").otherwise("external")
    review = F.coalesce("needs_review", F.lit(False)) if "needs_review" in walls.columns else F.lit(False)
    return own.withColumns(
        {
            "topology_changed": known & (target != F.col("wall_class")),
            "needs_review": review | (known & none & ~lot),
            "wall_class": F.when(known, target).otherwise(F.col("wall_class")),
        }
    ).drop("env", *(f"__{x}" for x in ("ax", "ay", "bx", "by", "ina", "inb", "lota", "lotb")))


def segment_class(segments: DataFrame, envelopes: DataFrame) -> DataFrame:
    """wall_class of raw segments: as topology_class, from their ends; external without an envelope."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    size = F.sqrt(dx * dx + dy * dy)
    size = F.when(size == 0, 1.0).otherwise(size)
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    off = F.greatest(F.greatest(F.col("thickness_pct") * 10, F.lit(20.0)) / 2 + 20.0, F.lit(25.0))
    nx, ny = -dy / size * off, dx / size * off
    own = _sides(_with_envelope(segments, envelopes), cx + nx, cy + ny, cx - nx, cy - ny)
    inside, none = F.col("__ina") & F.col("__inb"), ~F.col("__ina") & ~F.col("__inb")
    out = own.withColumn("wall_class", F.when(inside, "internal").when(none & F.col("__lota") & F.col("__lotb"), "boundary").otherwise("external"))
    return out.drop("env", *(f"__{x}" for x in ("ax", "ay", "bx", "by", "ina", "inb", "lota", "lotb")))


def feedback_tier() -> Column:
    """3: curated exemplar; 2: correction; 1: not a wall; 0: confirmation."""
    action = F.col("action")
    return F.when(F.col("is_exemplar"), 3).when(action.isin("correct", "exemplar"), 2).when(action == "not_wall", 1).otherwise(0)


def _votes(feedback: DataFrame, projects: DataFrame) -> DataFrame:
    """Rows of (client, signature, tier, decision, voter, id) with what else feedback has, one per vote."""
    client = F.lower(F.trim(F.coalesce("client_name", F.lit(""))))
    own = feedback.filter("active AND action <> 'confirm'").join(projects.select(P, client.alias("client"), "client_name"), P)
    own = feedback_signature(own).withColumn("tier", feedback_tier()).filter((F.col("tier") == 3) | (F.col("client") != ""))
    # a user votes once; feedback without a user counts as one voter for each client
    voter = F.struct("user_id", F.when(F.col("user_id").isNull(), F.coalesce("client_name", F.lit(""))).alias("client_name"))
    decision = F.when(F.col("action") == "not_wall", "not_wall").otherwise(F.coalesce("corrected_class", F.lit("none")))
    return own.withColumns({"client": F.when(F.col("tier") < 3, F.col("client")), "decision": decision, "voter": voter})


VOTE = ["client", "signature", "tier", "decision"]


def _elected(tally: DataFrame) -> DataFrame:
    best = tally.groupBy("client", "signature", "tier").agg(F.max_by(F.struct("decision", "voters"), F.struct("voters", -F.col("first_id"))).alias("b"))
    quorum = F.col("b.voters") >= F.when(F.col("tier") >= 3, 1).otherwise(2)
    return best.select("client", "signature", "tier", "b.decision", "b.voters", quorum.alias("quorum"))


def feedback_vote(feedback: DataFrame, projects: DataFrame) -> DataFrame:
    """(client, signature, tier, decision, voters, quorum): the decision of the first tier that has any vote, for each client's signatures; exemplars count for
    every client (client null). The decision with most distinct voters wins, the one seen first on ties. Hot signatures are counted in two steps, distinct
    voters first, so that tasks combine before rows move."""
    distinct = _votes(feedback, projects).groupBy(*VOTE, "voter").agg(F.min("id").alias("id"))
    return _elected(distinct.groupBy(*VOTE).agg(F.count(F.lit(1)).alias("voters"), F.min("id").alias("first_id")))


def vote_sketches(feedback: DataFrame, projects: DataFrame, day: Column, precision: int = 12) -> DataFrame:
    """(day, client, signature, tier, decision, voters, first_id): one sketch of distinct voters per day, to be kept and united on read, so that a new day is added without
    counting the days before again."""
    text = F.to_json("voter")
    return _votes(feedback, projects).groupBy(day.alias("day"), *VOTE).agg(F.hll_sketch_agg(text, precision).alias("voters"), F.min("id").alias("first_id"))


def vote_by_sketches(sketches: DataFrame) -> DataFrame:
    """As feedback_vote, with voters estimated from the united sketches: exact for few voters, else within about 1.04 / sqrt(2^precision), 1.6 % at 12, in one standard error."""
    united = sketches.groupBy(*VOTE).agg(F.hll_sketch_estimate(F.hll_union_agg("voters")).alias("voters"), F.min("first_id").alias("first_id"))
    return _elected(united)


#: Decisions up to so many rows go to all tasks; more are joined in SPREAD parts of each key.
FEW_DECISIONS = 200_000
SPREAD = 16


def _spread_join(rows: DataFrame, decisions: DataFrame, keys: list[str], few: int) -> DataFrame:
    """rows left-joined with one row per key, so that no task gets all rows of a frequent key."""
    found = cut(decisions)
    if found.count() <= few:
        return rows.join(F.broadcast(found), keys, "left")
    part = F.pmod(F.xxhash64(P, "seq"), F.lit(SPREAD)).cast("int")
    parts = found.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return rows.withColumn("__part", part).join(parts, [*keys, "__part"], "left").drop("__part")


def feedback_override(walls: DataFrame, feedback: DataFrame, projects: DataFrame, few: int = FEW_DECISIONS) -> DataFrame:
    """Walls reclassified or removed by the votes of their client and of curated exemplars. The highest tier with a vote decides, even if it misses
    its quorum. Decisions are one row per client and signature, far fewer than walls."""
    votes = cut(feedback_vote(feedback, projects))
    curated = votes.filter("tier = 3").select("signature", F.struct("decision", "quorum").alias("v3"))
    own = votes.filter("tier < 3").groupBy("client", "signature").agg(F.max_by(F.struct("decision", "quorum"), "tier").alias("v2"))
    client = F.lower(F.trim(F.coalesce("client_name", F.lit(""))))
    keyed = walls.withColumns(
        {
            "__t": F.floor(F.coalesce("thickness_m", F.lit(0.0)) * 100 + 0.5),
            "__l": F.floor(F.coalesce("length_m", F.lit(0.0)) * 10 + 0.5),
            "__w": F.coalesce("has_window", F.lit(False)),
            "__d": F.coalesce("has_door", F.lit(False)),
        }
    )
    keyed = feedback_signature(keyed, "__t", "__l", "__w", "__d", "wall_class").join(projects.select(P, client.alias("client")), P, "left")
    joined = _spread_join(_spread_join(keyed, curated, ["signature"], few), own, ["client", "signature"], few).withColumn("v", F.coalesce("v3", "v2"))
    decided = F.coalesce(F.col("v.quorum"), F.lit(False))
    decision = F.col("v.decision")
    kept = joined.filter(~(decided & decision.isin("not_wall")))
    change = decided & decision.isin("external", "internal", "boundary") & (decision != F.col("wall_class"))
    review = F.coalesce("needs_review", F.lit(False)) if "needs_review" in walls.columns else F.lit(False)
    out = kept.withColumns(
        {
            "source": F.when(change, F.concat("source", F.lit("_feedback_override"))).otherwise(F.col("source")),
            "confidence": F.when(change, F.greatest("confidence", F.lit(0.9))).otherwise(F.col("confidence")),
            "needs_review": review & ~change,
            "wall_class": F.when(change, decision).otherwise(F.col("wall_class")),
        }
    )
    return out.select(*dict.fromkeys([*walls.columns, "needs_review"]))


def building_type_vote(pages: DataFrame, projects: DataFrame) -> DataFrame:
    """(project_id, building_type): the user's value, else the type detected on most pages, the first on ties."""
    votes = pages.filter("detected_type IS NOT NULL").groupBy(P, "detected_type").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    best = votes.groupBy(P).agg(F.max_by("detected_type", F.struct("n", -F.col("first"))).alias("voted"))
    return projects.join(best, P, "left").select(P, F.coalesce("building_type", "voted").alias("building_type"))
