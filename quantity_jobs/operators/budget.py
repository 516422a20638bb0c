"""Panels, level budgets, proposals and costs. Sums run over values rounded per element, so order cannot show in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import dims
from ..functions.exprs import round_half_up as half_up

#: Budget categories and the element class each comes from.
CATEGORIES = ("external", "internal", "boundary", "floor", "roof")


def wall_panels(walls: DataFrame) -> DataFrame:
    """walls with gross_m2, net_m2, loss and panels. Panels are counted up per wall."""
    gross = F.col("length_m") * F.col("height_m")
    opens = F.coalesce("opening_area_m2", F.lit(0.0))
    net = F.greatest(F.lit(0.0), gross - opens)
    loss = F.when((gross > 0) & (opens / gross > dims.OPEN_RATIO), dims.LOSS_OPEN).otherwise(dims.LOSS_PLAIN)
    return walls.withColumns(
        {"gross_m2": half_up(gross), "net_m2": half_up(net), "loss": loss, "panels": F.ceil(net / dims.PANEL_M2 * (1.0 + loss)).cast("long")}
    )


def slab_panels(slabs: DataFrame) -> DataFrame:
    """slabs with panels; rafts have none."""
    n = F.ceil(F.col("area_m2") / dims.PANEL_M2 * (1.0 + dims.SLAB_LOSS)).cast("long")
    return slabs.withColumn("panels", F.when(F.col("slab_class") == "raft", F.lit(0).cast("long")).otherwise(n))


def dominant_source(items: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """(keys, source): the source with the largest total weight (0 counts as 1); the one seen first wins ties."""
    w = F.when(F.coalesce(F.col(weight), F.lit(0.0)) == 0, 1.0).otherwise(F.col(weight))
    by_source = items.groupBy(*keys, "source").agg(half_up(F.sum(w), 6).alias("w"), F.min("seq").alias("first"))
    return by_source.groupBy(*keys).agg(F.max_by("source", F.struct("w", -F.col("first"))).alias("dominant_source"))


def budget_by_level(walls: DataFrame, slabs: DataFrame, corners: DataFrame) -> DataFrame:
    """(project_id, level, category, length_m, gross_m2, net_m2, panels, reviews, rows): long, with categories of CATEGORIES,
    `raft` and `corners`. One aggregation over the union, so rows are combined before they move."""
    review = F.coalesce("needs_review", F.lit(False)) if "needs_review" in walls.columns else F.lit(False)
    w = wall_panels(walls).select("project_id", "level", F.col("wall_class").alias("category"), "length_m", "gross_m2", "net_m2", "panels", review.cast("long").alias("reviews"))
    zero = F.lit(0.0)
    s = slab_panels(slabs).select(
        "project_id", "level", F.col("slab_class").alias("category"), zero.alias("length_m"), F.col("area_m2").alias("gross_m2"), F.col("area_m2").alias("net_m2"), "panels", F.lit(0).cast("long").alias("reviews")
    )
    c = corners.select(
        "project_id", "level", F.lit("corners").alias("category"), zero.alias("length_m"), zero.alias("gross_m2"), zero.alias("net_m2"), F.col("corner_count").cast("long").alias("panels"), F.lit(0).cast("long").alias("reviews")
    )
    both = w.unionByName(s).unionByName(c)
    sums = both.groupBy("project_id", "level", "category").agg(
        *(half_up(F.sum(x)).alias(x) for x in ("length_m", "gross_m2", "net_m2")), F.sum("panels").alias("panels"), F.sum("reviews").alias("reviews"), F.count(F.lit(1)).alias("n")
    )
    # only levels with walls or slabs count; corners elsewhere are left out
    built = F.bool_or(F.col("category") != "corners").over(Window.partitionBy("project_id", "level"))
    return sums.withColumn("__built", built).filter("__built").drop("__built")


def budget_summary(by_level: DataFrame) -> DataFrame:
    """Panels per project and category, and per project as category `total`; rafts and corners have none."""
    own = by_level.filter(F.col("category").isin(*CATEGORIES))
    return own.rollup("project_id", "category").agg(F.sum("panels").alias("panels"), half_up(F.sum("length_m")).alias("length_m")).filter("project_id IS NOT NULL").withColumn(
        "category", F.coalesce("category", F.lit("total"))
    )


def quantities(by_level: DataFrame) -> DataFrame:
    """Per project: gross, openings, ratio, loss and area with loss of walls; area with loss of slabs; totals."""
    cat = F.col("category")
    of = lambda name, c: half_up(F.sum(F.when(cat == name, F.col(c)).otherwise(0.0)))
    sums = by_level.groupBy("project_id").agg(
        *(of(k, f"{m}_m2").alias(f"{p}_{m}") for k, p in (("external", "ext"), ("internal", "int")) for m in ("gross", "net")),
        of("floor", "net_m2").alias("floor_area"),
        of("roof", "net_m2").alias("roof_area"),
        F.sum(F.when(cat.isin(*CATEGORIES), F.col("panels")).otherwise(0)).alias("total_panels"),
    )
    for p in ("ext", "int"):
        gross, net = F.col(f"{p}_gross"), F.col(f"{p}_net")
        sums = sums.withColumn(f"{p}_openings", half_up(gross - net)).withColumn(f"{p}_ratio", F.when(gross > 0, half_up((gross - net) / gross, 6)).otherwise(0.0))
        sums = sums.withColumn(f"{p}_loss", F.when(F.col(f"{p}_ratio") > dims.OPEN_RATIO, dims.LOSS_OPEN).otherwise(dims.LOSS_PLAIN))
        sums = sums.withColumn(f"{p}_with_loss", half_up(net * (1.0 + F.col(f"{p}_loss")), 4))
    return sums.withColumns(
        {
            "floor_with_loss": half_up(F.col("floor_area") * 1.1, 4),
            "roof_with_loss": half_up(F.col("roof_area") * 1.1, 4),
            "wall_area": half_up(F.col("ext_net") + F.col("int_net")),
            "slab_area": half_up(F.col("floor_area") + F.col("roof_area")),
        }
    )


#: Category -> (place in the proposal, product sku, fallback price).
LINES = {
    "external": (1, dims.SKU_2P, dims.PRICE_2P),
    "internal": (2, dims.SKU_SP, dims.PRICE_SP),
    "boundary": (3, dims.SKU_SP, dims.PRICE_SP),
    "floor": (4, dims.SKU_2P, dims.PRICE_2P),
    "roof": (5, dims.SKU_2P, dims.PRICE_2P),
}


def apply_profile_prices(products: DataFrame, profile_prices: DataFrame, profiles: DataFrame) -> DataFrame:
    """(profile_id, products' columns): the catalogue once per profile, unit_price replaced where the profile has one, and once
    with a null profile as it is. Profiles are sales hubs: their list is a dimension that meets every product."""
    hubs = profiles.filter("profile_id IS NOT NULL").select(F.col("profile_id").cast("long").alias("profile_id")).distinct()
    listed = hubs.agg(F.concat(F.array(F.lit(None).cast("long")), F.sort_array(F.collect_set("profile_id"))).alias("hubs"))
    every = products.join(F.broadcast(listed), F.lit(True)).withColumn("profile_id", F.explode("hubs")).drop("hubs")  # one row
    prices = profile_prices.select("profile_id", "sku", F.col("unit_price").alias("own_price"))
    return every.join(prices, ["profile_id", "sku"], "left").withColumn("unit_price", F.coalesce("own_price", "unit_price")).drop("own_price")


def resolve_profile(projects: DataFrame, users: DataFrame, profiles: DataFrame) -> DataFrame:
    """(project_id, resolved_profile): the project's own choice, else its user's, else the default; of active profiles."""
    active = profiles.filter("active")
    usable = active.select(F.col("profile_id").alias("usable"))
    default = active.filter("is_default").agg(F.min("profile_id").alias("default_id"))
    mine = projects.select("project_id", "user_id", "profile_id").join(users.select("user_id", "default_profile_id"), "user_id", "left")
    chosen = mine.join(usable, F.col("profile_id") == F.col("usable"), "left").withColumnRenamed("usable", "own")
    chosen = chosen.join(usable, F.col("default_profile_id") == F.col("usable"), "left").withColumnRenamed("usable", "users")
    return chosen.join(F.broadcast(default)).select("project_id", F.coalesce("own", "users", "default_id").alias("resolved_profile"))


def proposal_lines(summary: DataFrame, projects: DataFrame, catalogue: DataFrame, choices: DataFrame | None = None) -> DataFrame:
    """(project_id, line, place, sku, name, panels, area_m2, price_m2, cost): a line per category (boundary only with panels), a
    `pagination` line and a `total`. projects: (project_id, profile_id). catalogue: (profile_id, sku, name, category, unit_price), a row per
    profile and product (see apply_profile_prices). choices: (project_id, category, sku) of products chosen by hand."""
    spec = F.create_map(*(x for k, (p, sku, price) in LINES.items() for x in (F.lit(k), F.struct(F.lit(p).alias("place"), F.lit(sku).alias("sku"), F.lit(price).alias("price")))))
    every = summary.select("project_id").distinct()
    empty = every.select("project_id", F.explode(F.array(*map(F.lit, LINES))).alias("category"))
    lines = empty.join(summary.filter(F.col("category").isin(*LINES)).select("project_id", "category", "panels"), ["project_id", "category"], "left")
    lines = lines.withColumn("panels", F.coalesce("panels", F.lit(0).cast("long"))).withColumn("spec", F.element_at(spec, F.col("category")))
    skus = [dims.SKU_2P, dims.SKU_SP, dims.SKU_PAGINATION]
    needed = catalogue.filter(F.col("sku").isin(*skus)).groupBy(F.col("profile_id").alias("f_profile")).pivot("sku", skus)
    fixed = needed.agg(F.first(F.struct("sku", "name", F.col("unit_price").cast("double").alias("price"))))
    fixed = fixed.withColumnsRenamed({dims.SKU_2P: "p_2p", dims.SKU_SP: "p_sp", dims.SKU_PAGINATION: "p_pag"})
    own = projects.select("project_id", "profile_id")
    lines = lines.join(own, "project_id", "left").join(fixed, F.col("profile_id").eqNullSafe(F.col("f_profile")), "left").drop("f_profile")
    default = F.when(F.col("spec.sku") == dims.SKU_2P, F.col("p_2p")).otherwise(F.coalesce("p_sp", "p_2p"))
    if choices is not None:
        panels = catalogue.filter("category = 'painel'").select(
            F.col("profile_id").alias("c_profile"), F.col("sku").alias("c_sku"), F.struct("sku", "name", F.col("unit_price").cast("double").alias("price")).alias("chosen")
        )
        wanted = choices.select("project_id", "category", "sku").join(own, "project_id")
        wanted = wanted.join(panels, F.col("profile_id").eqNullSafe(F.col("c_profile")) & (F.col("sku") == F.col("c_sku"))).select("project_id", "category", "chosen")
        lines = lines.join(wanted, ["project_id", "category"], "left")
        default = F.coalesce("chosen", default)
    lines = lines.withColumn("product", default)
    area = half_up(F.col("panels") * dims.PANEL_M2, 3)
    price = F.coalesce("product.price", "spec.price")
    body = lines.select(
        "project_id", F.col("category").alias("line"), F.col("spec.place").alias("place"), F.coalesce("product.sku", "spec.sku").alias("sku"), F.col("product.name").alias("name"),
        "panels", area.alias("area_m2"), price.alias("price_m2"), half_up(area * price, 2).alias("cost"), F.coalesce("p_pag.price", F.lit(dims.PRICE_PAGINATION)).alias("pag_price"),
    )
    sums = body.groupBy("project_id").agg(F.sum("panels").alias("panels"), half_up(F.sum("area_m2"), 3).alias("area_m2"), half_up(F.sum("cost")).alias("panel_cost"), F.first("pag_price").alias("pag_price"))
    sums = sums.withColumn("pag_cost", half_up(F.col("area_m2") * F.col("pag_price")))
    none = F.lit(None).cast("string")
    pagination = sums.select(
        "project_id", F.lit("pagination").alias("line"), F.lit(6).alias("place"), F.lit(dims.SKU_PAGINATION).alias("sku"), none.alias("name"), "panels", "area_m2", F.col("pag_price").alias("price_m2"), F.col("pag_cost").alias("cost")
    )
    total = sums.select(
        "project_id", F.lit("total").alias("line"), F.lit(7).alias("place"), none.alias("sku"), none.alias("name"), "panels", "area_m2", F.lit(None).cast("double").alias("price_m2"), half_up(F.col("panel_cost") + F.col("pag_cost")).alias("cost")
    )
    shown = body.filter((F.col("line") != "boundary") | (F.col("panels") > 0)).drop("pag_price")
    return shown.unionByName(pagination).unionByName(total)


def totals_by_sku(lines: DataFrame) -> DataFrame:
    """Proposal lines per project and product name: area, cost, and units as whole panels of that area."""
    own = lines.filter(~F.col("line").isin("pagination", "total"))
    sums = own.groupBy("project_id", F.coalesce("name", "sku").alias("product")).agg(F.sum("area_m2").alias("a"), F.sum("cost").alias("c"))
    return sums.select("project_id", "product", half_up("a", 3).alias("area_m2"), F.floor(half_up("a", 3) / dims.PANEL_M2 + 0.5).alias("units"), half_up("c").alias("cost"))


def materials_labor(quantities_: DataFrame, products: DataFrame) -> DataFrame:
    """(project_id, item, quantity, unit, cost): connectors, screws, tape, filler and labour; connectors and screws at the catalogue's prices, by sku (of several products with
    the smallest id), or at fixed ones where it has none."""
    n, area = F.col("total_panels").cast("double"), F.col("wall_area") + F.col("slab_area")
    price = lambda sku: F.min_by(F.when(F.col("sku") == sku, F.col("unit_price")), F.when(F.col("sku") == sku, F.col("product_id")))
    # one row, also for an empty catalogue
    prices = products.filter(F.col("sku").isin(dims.SKU_CONNECTOR, dims.SKU_SCREW)).agg(F.coalesce(price(dims.SKU_CONNECTOR), F.lit(dims.PRICE_CONNECTOR)).alias("connector"), F.coalesce(price(dims.SKU_SCREW), F.lit(dims.PRICE_SCREW)).alias("screw"))
    item = lambda name, qty, unit, cost: F.struct(F.lit(name).alias("item"), half_up(qty, 2).alias("quantity"), F.lit(unit).alias("unit"), half_up(cost, 2).alias("cost"))
    hours = area * dims.LABOUR_HOURS_M2
    connectors, screws = F.ceil(n * 4.0).cast("double"), F.ceil(n * 8.0).cast("double")
    rows = F.array(
        item("connectors", connectors, "un", connectors * F.col("connector")),
        item("screws", screws, "un", screws * F.col("screw")),
        item("tape", n * 2.0, "m", F.lit(0.0)),
        item("filler", n * 0.5, "kg", F.lit(0.0)),
        item("labor", hours, "h", hours * dims.LABOUR_RATE),
    )
    return quantities_.crossJoin(F.broadcast(prices)).select("project_id", F.explode(rows).alias("x")).select("project_id", "x.*")


def final_cost(costs: DataFrame, projects: DataFrame) -> DataFrame:
    """(project_id, server_cost, client_cost). costs: (project_id, panel_cost, pagination_cost). The server's formula clamps the discount to
    0-25 and adds pagination; the client's takes it as given, never falls below 0, and is null without any panel cost."""
    j = costs.join(projects.select("project_id", "discount_pct", "freight", "biomass"), "project_id")
    zero = F.lit(0.0)
    disc = F.least(F.lit(25.0), F.greatest(zero, F.coalesce("discount_pct", zero)))
    server = F.col("panel_cost") * (1.0 - disc / 100.0) + F.col("pagination_cost") + F.greatest(zero, F.coalesce("freight", zero)) + F.greatest(zero, F.coalesce("biomass", zero))
    client = F.col("panel_cost") * (1.0 - F.coalesce("discount_pct", zero) / 100.0) + F.coalesce("freight", zero) + F.coalesce("biomass", zero)
    return j.select("project_id", half_up(server).alias("server_cost"), F.when(F.col("panel_cost") > 0, half_up(F.greatest(zero, client))).alias("client_cost"))
