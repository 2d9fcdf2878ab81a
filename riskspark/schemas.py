"""Table schemas, enumerations and the fixed values of the risk model.

Every table of the engine is a flat DataFrame; the StructTypes below are the
contracts between the stages (sources -> calibration -> scenarios -> results
-> sinks).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. These must equal the behaviour being reproduced, so they are
# stated plainly here and nowhere else.
# ---------------------------------------------------------------------------

# VaR methods.
METHODS = ("PARAMETRIC", "MONTE_CARLO", "HISTORICAL")

# Asset classes of a position.
ASSET_CLASSES = ("EQD", "CTY", "FX", "IRD")

# Time grids: name -> (steps, dt in years). One grid: 53 weekly steps.
TIME_GRIDS = {"GRID_53": (53, 1.0 / 52.0)}

# Trading periods per year used to annualise volatilities.
DEFAULT_PERIODS_PER_YEAR = 252

# Request defaults.
DEFAULT_METHOD = "MONTE_CARLO"
DEFAULT_CONFIDENCE = 0.99
DEFAULT_NUM_PATHS = 10_000
DEFAULT_TIME_GRID = "GRID_53"
DEFAULT_HISTORICAL_WINDOW = 500
DEFAULT_SEED = 42

# Request limits (inclusive).
MIN_CONFIDENCE = 0.5
MAX_CONFIDENCE = 0.9999
MIN_NUM_PATHS = 1
MIN_HISTORICAL_WINDOW = 1
MAX_NUM_PATHS = 1_000_000
# Our limit (40 years of trading days): a window is copied per factor, so it is rejected beyond, not trimmed.
MAX_HISTORICAL_WINDOW = 10_000
TIME_GRID_PATTERN = r"^GRID_\d+$"

# Position defaults (plain equity spot).
DEFAULT_DELTA = 1.0
DEFAULT_GAMMA = 0.0
DEFAULT_MATURITY = 0.0
DEFAULT_ASSET_CLASS = "EQD"

# Error codes of rejected requests.
ERR_INVALID = "SCENARIO_REQUEST_INVALID"
ERR_MALFORMED = "SCENARIO_REQUEST_MALFORMED"
ERR_BAD_PARAMETER = "SCENARIO_REQUEST_BAD_PARAMETER"
ERR_CALCULATION = "VAR_CALCULATION_FAILED"
ERR_PLATFORM = "RISK_PLATFORM_ERROR"

# Violation messages of request validation.
MSG_PORTFOLIO_PATH = "portfolioCsvPath must not be blank"
MSG_PRICES_PATH = "pricesCsvPath must not be blank"
MSG_AS_OF = "asOfDate must not be null (expected format: yyyy-MM-dd)"
MSG_CONF_MIN = "confidenceLevel must be ≥ 0.5"
MSG_CONF_MAX = "confidenceLevel must be ≤ 0.9999"
MSG_PATHS_MIN = "numPaths must be ≥ 1"
MSG_PATHS_MAX = "numPaths must be ≤ 1 000 000"
MSG_MIN_PRICES = "requires at least 2 price observations"
MSG_GRID_BLANK = "timeGrid must not be blank"
MSG_GRID_PATTERN = "timeGrid must match GRID_<N> (e.g. GRID_53)"

# Message-queue topic of scenario requests.
REQUEST_TOPIC = "scenario-notifications"

# ---------------------------------------------------------------------------
# Source sets: many file pairs in one run
# ---------------------------------------------------------------------------

_SCOPE = "\u001f"      # no text of a CSV cell holds it


def scoped(source_set: str, name: Column) -> Column:
    """A ticker or portfolio id together with the source set it belongs to."""
    return F.concat(F.col(source_set), F.lit(_SCOPE), name)


def unscoped(name: str) -> Column:
    """The ticker or portfolio id without its source set."""
    return F.substring_index(F.col(name), _SCOPE, -1)


def scope_of(name: str) -> Column:
    """The source set of a scoped name."""
    return F.substring_index(F.col(name), _SCOPE, 1)


# ---------------------------------------------------------------------------
# Table contracts
# ---------------------------------------------------------------------------

PRICES = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("close", T.DoubleType()),
])

POSITIONS = T.StructType([
    T.StructField("portfolio_id", T.StringType()),
    T.StructField("ticker", T.StringType()),
    T.StructField("quantity", T.DoubleType()),
    T.StructField("asset_class", T.StringType()),
    T.StructField("delta", T.DoubleType()),
    T.StructField("gamma", T.DoubleType()),
    T.StructField("maturity_in_years", T.DoubleType()),
])

# JSON body of a scenario request (REST body or queue message), with the
# notification extras. Field names are the wire names.
REQUEST_JSON = T.StructType([
    T.StructField("correlationId", T.StringType()),
    T.StructField("portfolioCsvPath", T.StringType()),
    T.StructField("pricesCsvPath", T.StringType()),
    T.StructField("asOfDate", T.StringType()),
    T.StructField("confidenceLevel", T.DoubleType()),
    T.StructField("numPaths", T.LongType()),
    T.StructField("timeGrid", T.StringType()),
    T.StructField("varMethod", T.StringType()),
    T.StructField("historicalWindow", T.LongType()),
    T.StructField("seed", T.LongType()),
])

# Normalised request table used by every VaR operator.
REQUESTS = T.StructType([
    T.StructField("correlation_id", T.StringType()),
    T.StructField("portfolio_csv_path", T.StringType()),
    T.StructField("prices_csv_path", T.StringType()),
    T.StructField("as_of_date", T.DateType()),
    T.StructField("method", T.StringType()),
    T.StructField("alpha", T.DoubleType()),
    T.StructField("num_paths", T.IntegerType()),
    T.StructField("historical_window", T.IntegerType()),
    T.StructField("time_grid", T.StringType()),
    T.StructField("seed", T.LongType()),
])

# Price rows that no calibration can use, with the reason.
PRICE_REJECTS = T.StructType([
    T.StructField("source_file", T.StringType()),
    T.StructField("ticker", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("value", T.StringType()),
    T.StructField("reason", T.StringType()),
])

RESULTS = T.StructType([
    T.StructField("correlation_id", T.StringType()),
    T.StructField("portfolio_id", T.StringType()),
    T.StructField("as_of_date", T.DateType()),
    T.StructField("method", T.StringType()),
    T.StructField("var_amount", T.DoubleType()),
    T.StructField("expected_shortfall", T.DoubleType()),
    T.StructField("alpha", T.DoubleType()),
    T.StructField("mean_pnl", T.DoubleType()),
    T.StructField("std_dev_pnl", T.DoubleType()),
    T.StructField("num_scenarios", T.IntegerType()),
])

RESULT_COLUMNS = [f.name for f in RESULTS.fields]
