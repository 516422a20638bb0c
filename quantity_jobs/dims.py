"""Small fixed dimension tables. All sizes are constants, so broadcasting them is safe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Default measures (metres) where a drawing gives none.
WALL_HEIGHT, WALL_THICKNESS = 3.0, 0.10
DOOR_WIDTH, DOOR_HEIGHT = 0.8, 2.1
WINDOW_WIDTH, WINDOW_HEIGHT, WINDOW_SILL = 1.2, 1.0, 1.1
HIGH_SILL, HIGH_WINDOW_HEIGHT = 1.3, 0.6

# Panel area and losses.
PANEL_M2, LOSS_PLAIN, LOSS_OPEN, OPEN_RATIO, SLAB_LOSS = 1.83, 0.05, 0.08, 0.20, 0.10

# Prices used where the catalogue has no product.
PRICE_2P, PRICE_SP, PRICE_PAGINATION, PRICE_CONNECTOR, PRICE_SCREW = 275.0, 180.0, 11.0, 12.5, 2.8
SKU_2P, SKU_SP, SKU_PAGINATION, SKU_CONNECTOR, SKU_SCREW = "LW-2P-090", "LW-SP-090", "PROJ-PAG", "CONN-001", "PARA-001"
LABOUR_HOURS_M2, LABOUR_RATE = 0.8, 65.0

# Building type, least share of internal walls, share of perimeter walls, most perimeter walls.
HEURISTICS = (
    ("residencial", 0.55, 0.35, 8),
    ("comercial", 0.30, 0.40, 10),
    ("institucional", 0.40, 0.30, 12),
    ("industrial", 0.10, 0.60, 6),
    ("generico", 0.35, 0.35, 8),
)

# Model, price of a million input, output and thinking tokens (USD), in order of search.
MODEL_PRICES = (
    ("gemini-2.5-pro", 1.25, 5.0, 5.0),
    ("gemini-2.5-flash", 0.075, 0.3, 3.5),
    ("gemini-2.5-flash-lite", 0.075, 0.3, 0.3),
    ("gemini-2.0-flash", 0.1, 0.4, 0.4),
    ("gemini-2.0-flash-exp", 0.1, 0.4, 0.4),
    ("gpt-4o", 2.5, 10.0, 10.0),
    ("gpt-4o-mini", 0.15, 0.6, 0.6),
    ("gpt-4.1", 2.0, 8.0, 8.0),
    ("gpt-4.1-mini", 0.4, 1.6, 1.6),
    ("gpt-4.1-nano", 0.1, 0.4, 0.4),
    ("o4-mini", 1.1, 4.4, 4.4),
)


def heuristics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HEURISTICS, "building_type string, min_internal double, perimeter_share double, max_perimeter int")


def model_prices(spark: SparkSession) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(MODEL_PRICES)]
    return spark.createDataFrame(rows, "price_order int, price_model string, in_price double, out_price double, think_price double")
