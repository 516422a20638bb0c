"""Accuracy against measured areas, calibration, retention and feedback counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.exprs import round_half_up as half_up

P = "project_id"
#: Category and the project's column of measured areas.
REAL = {"external": "real_ext", "internal": "real_int", "boundary": "real_boundary", "floor": "real_floor", "roof": "real_roof"}


def best_summary_row(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Per project the first row (by seq) with any positive total, else the first row."""
    some = F.greatest(*(F.coalesce(c, F.lit(0.0)) for c in columns)) > 0
    rank = F.row_number().over(Window.partitionBy(P).orderBy(F.desc(some), "seq"))
    return rows.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def area_accuracy(projects: DataFrame, totals: DataFrame) -> DataFrame:
    """(project_id, category, real_m2, found_m2, deviation, accuracy): accuracy = max(0, 1 - |found - real| / real); null without a positive real area. totals:
    (project_id, category, found_m2)."""
    real = projects.select(P, F.explode(F.create_map(*(x for k, c in REAL.items() for x in (F.lit(k), F.col(c).cast("double"))))).alias("category", "real_m2"))
    j = real.join(totals, [P, "category"], "left").withColumn("found_m2", F.coalesce("found_m2", F.lit(0.0)))
    ok = F.col("real_m2") > 0
    gap = (F.col("found_m2") - F.col("real_m2")) / F.col("real_m2")
    return j.select(P, "category", "real_m2", "found_m2", F.when(ok, half_up(gap, 6)).alias("deviation"), F.when(ok, half_up(F.greatest(F.lit(0.0), 1.0 - F.abs(gap)), 6)).alias("accuracy"))


def calibration(accuracy: DataFrame) -> DataFrame:
    """(scope, project_id, category, accuracy, deviation, projects): means weighted by real area per project, per category and overall; deviation of the sums."""
    own = accuracy.filter("accuracy IS NOT NULL")
    grouped = own.groupingSets([[P], ["category"], []], P, "category").agg(
        F.sum(F.col("accuracy") * F.col("real_m2")).alias("aw"), F.sum("real_m2").alias("w"), F.sum("found_m2").alias("f"), F.count_distinct(P).alias("projects"), F.grouping_id().alias("g")
    )
    scope = F.when(F.col("g") == 1, "project").when(F.col("g") == 2, "category").otherwise("global")
    return grouped.select(
        scope.alias("scope"), P, "category", half_up(F.col("aw") / F.col("w"), 4).alias("accuracy"), half_up((F.col("f") - F.col("w")) / F.col("w"), 4).alias("deviation"), "projects"
    )


def accuracy_gate(found: DataFrame, truth: DataFrame, overall: float = 85.0, each: float = 70.0) -> DataFrame:
    """(fixture, status, overall, worst): category accuracies max(0, 100 - |deviation %|), their mean weighted by truth, and the worst with truth > 0; SKIP without truth or
    findings. found: (fixture, category, actual_m2); truth: (fixture, category, truth_m2)."""
    j = truth.join(found, ["fixture", "category"], "left")
    t, a = F.col("truth_m2"), F.coalesce("actual_m2", F.lit(0.0))
    score = F.when(t <= 0, F.when(a <= 0, 100.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), 100.0 - F.abs(a - t) / t * 100.0))
    sums = j.withColumn("score", score).groupBy("fixture").agg(
        F.sum(F.when(t > 0, F.col("score") * t)).alias("sw"), F.sum(F.when(t > 0, t)).alias("w"), F.min(F.when(t > 0, F.col("score"))).alias("worst"), F.count("actual_m2").alias("seen"), F.count("truth_m2").alias("known")
    )
    mean = F.col("sw") / F.col("w")
    status = F.when((F.col("known") == 0) | (F.col("seen") == 0) | F.col("w").isNull(), "SKIP").when((mean >= overall) & (F.col("worst") >= each), "PASS").otherwise("FAIL")
    return sums.select("fixture", status.alias("status"), half_up(mean, 4).alias("overall"), half_up("worst", 4).alias("worst"))


def class_retention(projects: DataFrame, original: DataFrame, edited: DataFrame) -> DataFrame:
    """(project_id, walls, kept, share): of the completed test projects that have both states, walls whose class an edit has left as it was and that are still enabled;
    share in percent with one place; project_id null: over all (share null without walls)."""
    e = edited.select(P, "wall_id", F.col("wall_class").alias("new_class"), "enabled").dropDuplicates([P, "wall_id"])
    sampled = projects.filter("project_type = 'test' AND status = 'completed'").select(P).distinct()
    both = sampled.join(edited.select(P).distinct(), P, "left_semi")
    j = original.select(P, "wall_id", "wall_class").join(both, P, "left_semi").join(e, [P, "wall_id"], "left")
    kept = F.col("new_class").eqNullSafe(F.col("wall_class")) & F.coalesce("enabled", F.lit(True)) & F.col("new_class").isNotNull()
    out = j.groupBy(P).agg(F.count(F.lit(1)).alias("walls"), F.count_if(kept).alias("kept"))
    over_all = out.agg(F.lit(None).cast("long").alias(P), F.coalesce(F.sum("walls"), F.lit(0)).alias("walls"), F.coalesce(F.sum("kept"), F.lit(0)).alias("kept"))
    return out.unionByName(over_all).withColumn("share", F.when(F.col("walls") > 0, half_up(F.col("kept") / F.col("walls") * 100, 1)))


def feedback_counts(feedback: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(c)
    action = F.col("action")
    return feedback.agg(
        F.count(F.lit(1)).alias("total"), n(F.col("active")).alias("active"), n(action == "confirm").alias("confirm"), n(action == "correct").alias("correct"), n(action == "not_wall").alias("not_wall"), n(F.col("is_exemplar")).alias("exemplar")
    )


def feedback_patterns(feedback: DataFrame, top: int = 20) -> DataFrame:
    """The most frequent patterns of active feedback but confirmations, by thickness and length buckets and both classes, null as a value of its own: the top-k report. Of
    equally frequent ones the first seen (by id) comes first."""
    own = feedback.filter("active AND NOT (action <=> 'confirm')")
    keys = ["thickness_cm", "length_dm", "original_class", "corrected_class"]
    counted = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    return counted.orderBy(F.desc("n"), "first_id").limit(top).select(*keys, "n")


def latest_budget(projects: DataFrame, budgets: DataFrame, hint: str, newest: int = 5) -> DataFrame:
    """Of the newest so many projects whose name holds the hint, the first with a budget, and its newest budget."""
    named = projects.filter(F.lower("name").contains(hint.lower())).orderBy(F.desc("created_at"), F.desc(P)).limit(newest)
    rank = F.row_number().over(Window.partitionBy(P).orderBy(F.desc("budget_id")))
    last = budgets.join(F.broadcast(named.select(P, "created_at")), P).withColumn("__rank", rank).filter("__rank = 1").drop("__rank")
    return last.orderBy(F.desc("created_at"), F.desc(P)).limit(1)


def project_kpis(projects: DataFrame, products: DataFrame) -> DataFrame:
    """(kpi, n, low, high): completed and test projects; panel prices by type."""
    own = projects.agg(F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("project_type") == "test").alias("test"))
    none = F.lit(None).cast("double")
    counts = own.select(F.explode(F.create_map(F.lit("completed"), F.col("completed"), F.lit("test"), F.col("test"))).alias("kpi", "n")).select("kpi", "n", none.alias("low"), none.alias("high"))
    panels = products.filter("category = 'painel' AND panel_type IS NOT NULL").groupBy(F.concat(F.lit("panel_"), "panel_type").alias("kpi")).agg(F.count(F.lit(1)).alias("n"), F.min("unit_price").alias("low"), F.max("unit_price").alias("high"))
    return counts.unionByName(panels)


def project_listing(projects: DataFrame, budgets: DataFrame, is_admin: bool, private: tuple[str, ...] = ("client_email", "fingerprint", "real_ext", "real_int", "real_boundary", "real_floor", "real_roof")) -> DataFrame:
    """Projects with the total of their budget; private columns for admins only."""
    out = projects.join(budgets.groupBy(P).agg(F.max("total_cost").alias("total_cost")), P, "left")
    return out if is_admin else out.drop(*private)


def find_duplicates(projects: DataFrame) -> DataFrame:
    """(project_id, duplicate_of): the smallest completed project of the same fingerprint whose e-mail is the same or missing on either side. Projects without a
    fingerprint are left out before the join, as they would all meet in one task."""
    own = projects.filter(F.coalesce("fingerprint", F.lit("")) != "").select(P, "fingerprint", "client_email", "status")
    done = own.filter("status = 'completed'").select(F.col(P).alias("other"), "fingerprint", F.col("client_email").alias("other_email"))
    j = own.join(done, "fingerprint").filter((F.col(P) != F.col("other")) & (F.col("client_email").isNull() | F.col("other_email").isNull() | (F.col("client_email") == F.col("other_email"))))
    return j.groupBy(P).agg(F.min("other").alias("duplicate_of"))


def fingerprint(files: DataFrame) -> DataFrame:
    """(project_id, fingerprint): SHA-256 over the project's files in the order of their names. Each file's content enters as its own digest."""
    own = files.select(P, F.struct("name", F.sha2("content", 256).alias("digest")).alias("f"))
    return own.groupBy(P).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("f")), lambda f: f["digest"]), ""), 256).alias("fingerprint"))


#: What a correction may set, by field: the column, and the limits (0 itself is out) or the classes.
WALL_FIELDS = {"length": ("length_m", (0.0, 50.0)), "height": ("height_m", (1.5, 6.0)), "class": ("wall_class", ("external", "internal", "boundary"))}
SLAB_FIELDS = {"area": ("area_m2", (0.0, 5000.0)), "class": ("slab_class", ("floor", "raft", "roof"))}
LEAST_CONFIDENCE = 0.7


def apply_corrections(walls: DataFrame, slabs: DataFrame, wall_patches: DataFrame, slab_patches: DataFrame, least: float = LEAST_CONFIDENCE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(walls, slabs, counts): the patches of a validator's answer applied in the order of seq. Patches are (project_id, element_id, field, number, text, confidence, seq), with the answer's
    confidence on each; below `least`, or null or not a number, none of them counts. A field is `remove` or one of WALL_FIELDS or SLAB_FIELDS, whose last plausible value stays; patches after an
    element's removal do nothing. counts (project_id, walls, slabs, removed_walls, removed_slabs): values set and elements removed."""

    def patched(df: DataFrame, key: str, fields: dict, patches: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        number, text, field = F.col("number"), F.col("text"), F.col("field")
        ok = field == "remove"
        for f, (_, allowed) in fields.items():
            fits = text.isin(*allowed) if isinstance(allowed[0], str) else (number > 0) & number.between(*allowed)
            ok |= (field == f) & fits
        sure = F.coalesce((F.col("confidence") >= least) & ~F.isnan("confidence"), F.lit(False))
        known = df.select(P, F.col(key).alias("element_id")).distinct()
        good = patches.filter(sure & F.coalesce(ok, F.lit(False))).join(known, [P, "element_id"], "left_semi")
        removal = F.min(F.when(field == "remove", F.col("seq"))).over(Window.partitionBy(P, "element_id"))
        live = good.withColumn("gone_at", removal).filter("gone_at IS NULL OR seq <= gone_at").filter("field <> 'remove' OR seq = gone_at")
        last = live.groupBy(P, "element_id").agg(
            *(F.max_by(F.when(field == f, F.struct("number", "text")), F.when(field == f, F.col("seq"))).alias(f) for f in fields),
            F.count_if(field != "remove").alias("n"),
            F.bool_or(field == "remove").alias("gone"),
        )
        own = last.withColumnRenamed("element_id", key)
        part = {f: "text" if isinstance(allowed[0], str) else "number" for f, (_, allowed) in fields.items()}
        joined = df.join(own, [P, key], "left").filter(~F.coalesce("gone", F.lit(False)))
        out = joined.withColumns({column: F.coalesce(f"{f}.{part[f]}", column) for f, (column, _) in fields.items()}).select(*df.columns)
        return out, last.groupBy(P).agg(F.sum("n").alias(name), F.count_if("gone").alias(f"removed_{name}"))

    new_walls, wall_counts = patched(walls, "wall_id", WALL_FIELDS, wall_patches, "walls")
    new_slabs, slab_counts = patched(slabs, "slab_id", SLAB_FIELDS, slab_patches, "slabs")
    counts = wall_counts.join(slab_counts, P, "full").na.fill(0)
    return new_walls, new_slabs, counts.select(P, "walls", "slabs", "removed_walls", "removed_slabs")


def snapshot_once(current: DataFrame, originals: DataFrame) -> DataFrame:
    """originals plus the current rows of projects that have none yet."""
    return originals.unionByName(current.join(originals.select(P).distinct(), P, "left_anti"))
