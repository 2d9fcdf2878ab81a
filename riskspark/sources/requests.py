"""Scenario requests: decode, defaults, stable ids, and data-derived request grids.

A request asks for VaR of every portfolio of a book at one as-of date, by one
method, at one confidence level. Requests arrive as JSON (a REST body or a
queue message, wire names of ``schemas.REQUEST_JSON``) or as a DataFrame; both
are normalised to ``schemas.REQUESTS``.

Correlation ids: a given id is kept; otherwise the id is a SHA-256 of the
message's source position (e.g. topic/partition/offset or file path) and its
payload, so a replayed message gets the same id and can be de-duplicated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas


def _str_or_null(c: Column) -> Column:
    return F.when(F.trim(c) == "", F.lit(None)).otherwise(c)


def normalise_requests(df: DataFrame, source_id: Column | None = None,
                       payload: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """Wire-format rows (``schemas.REQUEST_JSON`` columns) -> ``schemas.REQUESTS``.

    Missing numbers take the request defaults; ``asOfDate`` must be yyyy-MM-dd
    (anything else becomes NULL and is rejected by validation). The raw
    ``asOfDate`` text and the ``keep`` columns are carried along for the reject
    table. Counts stay BIGINT here (``num_paths_raw``, ``window_raw``) so that
    out-of-range values reach validation instead of overflowing.
    """
    cols = set(df.columns)

    def get(name, dtype):
        return F.col(name).cast(dtype) if name in cols else F.lit(None).cast(dtype)

    wire = [c for c in df.columns if c in {f.name for f in schemas.REQUEST_JSON.fields}]
    if payload is None:
        payload = F.to_json(F.struct(*[F.col(c) for c in wire]))
    given_id = _str_or_null(get("correlationId", "string"))
    derived = F.sha2(F.concat_ws("|", source_id if source_id is not None else F.lit(""), payload), 256)
    as_of_raw = get("asOfDate", "string")
    return df.select(
        F.coalesce(given_id, derived).alias("correlation_id"),
        get("portfolioCsvPath", "string").alias("portfolio_csv_path"),
        get("pricesCsvPath", "string").alias("prices_csv_path"),
        F.to_date(F.try_to_timestamp(as_of_raw, F.lit("yyyy-MM-dd"))).alias("as_of_date"),
        F.upper(F.trim(F.coalesce(get("varMethod", "string"), F.lit(schemas.DEFAULT_METHOD)))).alias("method"),
        F.coalesce(get("confidenceLevel", "double"), F.lit(schemas.DEFAULT_CONFIDENCE)).alias("alpha"),
        F.coalesce(get("numPaths", "long"), F.lit(schemas.DEFAULT_NUM_PATHS)).alias("num_paths_raw"),
        F.coalesce(get("historicalWindow", "long"), F.lit(schemas.DEFAULT_HISTORICAL_WINDOW)).alias("window_raw"),
        F.coalesce(get("timeGrid", "string"), F.lit(schemas.DEFAULT_TIME_GRID)).alias("time_grid"),
        F.coalesce(get("seed", "long"), F.lit(schemas.DEFAULT_SEED)).alias("seed"),
        as_of_raw.alias("as_of_raw"),
        *[F.col(c) for c in (keep or [])],
    )


def parse_requests(raw: DataFrame, value_col: str = "value", source_cols: list[str] | None = None) -> DataFrame:
    """Decode JSON request text into normalised request rows.

    ``source_cols`` (e.g. topic, partition, offset, or the file path) identify
    the message for the derived correlation id. Text that is not a JSON object
    with at least one known field is flagged ``malformed``; it still yields a
    row so that validation can reject it with SCENARIO_REQUEST_MALFORMED.
    """
    src = (F.concat_ws("|", *[F.col(c).cast("string") for c in source_cols])
           if source_cols else F.lit(""))
    j = F.from_json(F.col(value_col), schemas.REQUEST_JSON, {"mode": "PERMISSIVE"})
    parsed = raw.select(F.col(value_col).alias("raw_payload"), src.alias("source_id"), j.alias("j"))
    any_field = F.lit(False)
    for f in schemas.REQUEST_JSON.fields:
        any_field = any_field | F.col(f"j.{f.name}").isNotNull()
    flat = parsed.select("raw_payload", "source_id", (~F.coalesce(any_field, F.lit(False))).alias("malformed"), "j.*")
    return normalise_requests(flat, source_id=F.col("source_id"), payload=F.col("raw_payload"),
                              keep=["malformed", "raw_payload"])


def request_grid(as_of_dates: DataFrame, methods=schemas.METHODS, alphas=(0.95, 0.99),
                 num_paths: int = 1000, historical_window: int = 60,
                 time_grid: str = schemas.DEFAULT_TIME_GRID, seed: int = schemas.DEFAULT_SEED) -> DataFrame:
    """Requests for every as-of date x method x confidence (``schemas.REQUESTS``).

    The id is readable and deterministic: ``METHOD|yyyy-MM-dd|alpha``.
    """
    g = (as_of_dates.select("as_of_date")
         .withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
         .withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas]))))
    return g.select(
        F.concat_ws("|", "method", F.col("as_of_date").cast("string"), F.col("alpha").cast("string"))
        .alias("correlation_id"),
        F.lit(None).cast("string").alias("portfolio_csv_path"),
        F.lit(None).cast("string").alias("prices_csv_path"),
        "as_of_date", "method", "alpha",
        F.lit(num_paths).cast("int").alias("num_paths"),
        F.lit(historical_window).cast("int").alias("historical_window"),
        F.lit(time_grid).alias("time_grid"),
        F.lit(seed).cast("long").alias("seed"))
