"""Canonical schemas and the fixed values the reference programs use."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for equal results)
# ---------------------------------------------------------------------------
# Canonical column names of a pond table, in positional order.
CANON = ["created_at", "entry_id", "temperature", "turbidity", "dissolved_oxygen",
         "ph", "ammonia", "nitrate", "population", "fish_length", "fish_weight"]
# Columns checked for drift by default.
MONITOR_COLUMNS = ["temperature", "turbidity", "dissolved_oxygen", "ph", "ammonia",
                   "nitrate", "population", "fish_length", "fish_weight"]
# Default number of newest rows that feed one drift report.
REPORT_RANGE = 10000
# Drift thresholds: per-column PSI test, drifted-column cut-off, share that means drift.
PSI_COLUMN_THRESHOLD = 0.25
PSI_DRIFT_CUTOFF = 0.3
DRIFT_SHARE = 0.5
# Dashboard sensor columns after header normalising.
DASHBOARD_SENSORS = ["temperaturec", "ph", "dissolvedoxygeng/ml", "turbidityntu",
                     "ammoniag/ml", "nitrateg/ml"]
# Dashboard window, horizon and trend dead band.
WINDOW_SIZE = 100
FORECAST_HORIZON = 10
TREND_EPSILON = 0.01
# Minimum series length for the dashboard.
MIN_SERIES_ROWS = WINDOW_SIZE + FORECAST_HORIZON
# Device value ranges: (column, average, delta).
SENSOR_RANGES = [
    ("temperature", 25.0, 5.0),
    ("turbidity", 50.0, 50.0),
    ("dissolved_oxygen", 50.0, 50.0),
    ("ph", 50.0, 50.0),
    ("ammonia", 50.0, 50.0),
    ("nitrate", 50.0, 50.0),
    ("population", 50.0, 50.0),
    ("fish_length", 50.0, 50.0),
    ("fish_weight", 50.0, 50.0),
]
# Literal repairs before parsing: (pond, text, replacement).
LITERAL_REPAIRS = [(4, "Jan-00", "12.45")]
# Files lacking `population`: (pond, anchor column, offset from the anchor).
NULL_COLUMN_RULES = [
    (7, "nitrate(g/ml)", 1),
    (8, "Total_length (cm)", -1),
    (9, "Nitrate(g/ml)", 1),
]
# Day-first time format of the raw files.
DAY_FIRST_FORMAT = "dd/MM/yyyy HH:mm:ss"
# Text that a CSV reader takes for a missing value.
MISSING_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                  "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
# Hyper-parameter search spaces, used where the caller gives none.
FOREST_SPACE = {
    "max_features": {"type": "Categorical", "categories": ["sqrt", "log2", None]},
    "min_samples_split": {"type": "Integer", "low": 2, "high": 25},
    "max_samples": {"type": "Real", "low": 0.5, "high": 1.0},
    "max_depth": {"type": "Integer", "low": 20, "high": 100},
    "n_estimators": {"type": "Integer", "low": 200, "high": 1000},
}
BOOSTED_SPACE = {
    "learning_rate": {"type": "Real", "low": 0.01, "high": 0.3, "prior": "log-uniform"},
    "max_depth": {"type": "Integer", "low": 3, "high": 100},
    "n_estimators": {"type": "Integer", "low": 500, "high": 1500},
    "subsample": {"type": "Real", "low": 0.2, "high": 1.0},
    "colsample_bytree": {"type": "Real", "low": 0.6, "high": 1.0},
    "reg_alpha": {"type": "Real", "low": 0.0, "high": 10.0},
    "reg_lambda": {"type": "Real", "low": 1.0, "high": 10.0},
    "gamma": {"type": "Real", "low": 0.0, "high": 5.0},
}
# Training options.
TEST_SIZE = 0.2
RANDOM_STATE = 42
CV_SPLITS = 5
SEARCH_TRIALS = 10
# ---------------------------------------------------------------------------

INTEGER_COLUMNS = ["entry_id", "population"]
FLOAT_COLUMNS = [c for c in CANON[2:] if c not in INTEGER_COLUMNS]

READINGS = T.StructType(
    [T.StructField("pond_id", T.IntegerType(), False),
     T.StructField("created_at", T.TimestampType(), True),
     T.StructField("entry_id", T.LongType(), False)]
    + [T.StructField(c, T.LongType() if c in INTEGER_COLUMNS else T.DoubleType(), True)
       for c in CANON[2:]]
)

RAW = T.StructType([T.StructField(c, T.StringType(), True) for c in CANON])

SERIES_KEYS = ["pond_id", "created_at", "entry_id"]
