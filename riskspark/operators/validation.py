"""Request validation: split requests into valid rows and a rejects table.

Each rule is a Column that is a ``struct(field, message)`` when violated and
NULL otherwise; the violations of a row are ``filter(array(rules), not null)``.
One pass, no UDF, no collect. The error code of a rejected row is

* ``SCENARIO_REQUEST_MALFORMED``     - the payload did not decode;
* ``SCENARIO_REQUEST_BAD_PARAMETER`` - an unknown method or time grid;
* ``SCENARIO_REQUEST_INVALID``       - a constraint is violated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from .scenarios import grid_columns


def _violation(cond: Column, field: str, message: str) -> Column:
    return F.when(cond, F.struct(F.lit(field).alias("field"), F.lit(message).alias("message")))


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def _raw_counts(df: DataFrame) -> DataFrame:
    if "num_paths_raw" not in df.columns:
        df = df.withColumn("num_paths_raw", F.col("num_paths").cast("long"))
    if "window_raw" not in df.columns:
        df = df.withColumn("window_raw", F.col("historical_window").cast("long"))
    for c, dtype in (("malformed", "boolean"), ("raw_payload", "string"), ("as_of_raw", "string")):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(dtype))
    return df


def validate_requests(requests: DataFrame, require_paths: bool = False) -> tuple[DataFrame, DataFrame]:
    """Returns ``(valid, rejects)``.

    ``valid`` has ``schemas.REQUESTS`` columns plus ``steps`` and ``dt`` of the
    time grid. ``rejects`` has correlation_id, error_code, violations
    (ARRAY<STRUCT<field, message>>), as_of_raw and raw_payload.
    ``require_paths`` enforces the CSV path fields (file-based requests).
    """
    df = _raw_counts(requests.drop("steps", "dt"))
    steps, dt = grid_columns("time_grid")
    df = df.select("*", steps, dt)
    method, alpha, paths, window, grid = (F.col("method"), F.col("alpha"), F.col("num_paths_raw"),
                                          F.col("window_raw"), F.col("time_grid"))
    invalid = [
        _violation(F.col("as_of_date").isNull(), "asOfDate", schemas.MSG_AS_OF),
        _violation(alpha.isNull() | (alpha < schemas.MIN_CONFIDENCE), "confidenceLevel", schemas.MSG_CONF_MIN),
        _violation(alpha > schemas.MAX_CONFIDENCE, "confidenceLevel", schemas.MSG_CONF_MAX),
        _violation(paths < schemas.MIN_NUM_PATHS, "numPaths", schemas.MSG_PATHS_MIN),
        _violation(paths > schemas.MAX_NUM_PATHS, "numPaths", schemas.MSG_PATHS_MAX),
        _violation(_blank(grid), "timeGrid", schemas.MSG_GRID_BLANK),
        _violation(~_blank(grid) & ~grid.rlike(schemas.TIME_GRID_PATTERN), "timeGrid", schemas.MSG_GRID_PATTERN),
        _violation(window < schemas.MIN_HISTORICAL_WINDOW, "historicalWindow", "historicalWindow must be ≥ 1"),
        _violation(window > schemas.MAX_HISTORICAL_WINDOW, "historicalWindow", "historicalWindow must be ≤ 10 000"),
    ]
    if require_paths:
        invalid = [_violation(_blank(F.col("portfolio_csv_path")), "portfolioCsvPath", schemas.MSG_PORTFOLIO_PATH),
                   _violation(_blank(F.col("prices_csv_path")), "pricesCsvPath", schemas.MSG_PRICES_PATH),
                   *invalid]
    bad_param = [
        _violation(~method.isin(*schemas.METHODS), "varMethod",
                   "varMethod must be one of " + ", ".join(schemas.METHODS)),
        _violation(grid.rlike(schemas.TIME_GRID_PATTERN) & F.col("steps").isNull(), "timeGrid",
                   "timeGrid must be one of " + ", ".join(schemas.TIME_GRIDS)),
    ]
    malformed = F.coalesce(F.col("malformed"), F.lit(False))
    inv = F.filter(F.array(*invalid), lambda v: v.isNotNull())
    bad = F.filter(F.array(*bad_param), lambda v: v.isNotNull())
    checked = df.select("*", inv.alias("_inv"), bad.alias("_bad"))
    code = (F.when(malformed, F.lit(schemas.ERR_MALFORMED))
            .when(F.size("_bad") > 0, F.lit(schemas.ERR_BAD_PARAMETER))
            .when(F.size("_inv") > 0, F.lit(schemas.ERR_INVALID)))
    checked = checked.withColumn("error_code", code)
    valid = (checked.filter(F.col("error_code").isNull())
             .select("correlation_id", "portfolio_csv_path", "prices_csv_path", "as_of_date", "method", "alpha",
                     F.col("num_paths_raw").try_cast("int").alias("num_paths"),
                     F.col("window_raw").try_cast("int").alias("historical_window"),
                     "time_grid", "seed", "steps", "dt"))
    violations = F.when(malformed, F.array(F.struct(F.lit("body").alias("field"),
                                                    F.lit("request body is not valid JSON").alias("message")))) \
        .otherwise(F.concat("_bad", "_inv"))
    rejects = (checked.filter(F.col("error_code").isNotNull())
               .select("correlation_id", "error_code", violations.alias("violations"), "as_of_raw", "raw_payload"))
    # One id for two different requests names neither: both are rejected (equal copies are one request).
    content = F.xxhash64(*[F.col(c) for c in valid.columns if c != "correlation_id"])
    twice = (valid.select("correlation_id", content.alias("h")).groupBy("correlation_id")
             .agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a <> b").select("correlation_id"))
    clash = F.array(F.struct(F.lit("correlationId").alias("field"),
                             F.lit("correlationId is used by two different requests").alias("message")))
    clashing = (checked.filter(F.col("error_code").isNull()).join(twice, "correlation_id", "left_semi")
                .select("correlation_id", F.lit(schemas.ERR_INVALID).alias("error_code"), clash.alias("violations"), "as_of_raw", "raw_payload"))
    return valid.join(twice, "correlation_id", "left_anti"), rejects.unionByName(clashing)
