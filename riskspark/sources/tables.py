"""Price and position tables derived from the warehouse tables.

The engine's inputs are ``prices(ticker, date, close)`` and
``positions(portfolio_id, ticker, quantity, asset_class, delta, gamma,
maturity_in_years)``. On the TPC-H-like warehouse they are derived as follows:

* a monthly (or weekly) price panel per part brand or part type: close is the
  average unit price ``sum(l_extendedprice) / sum(l_quantity)`` of the period
  (the sum taken in exact cents, so the value does not depend on summation order);
* raw ticks from ``events`` (``clean_prices`` keeps the last tick of each day);
* books of positions per market segment (or nation) and panel ticker, with the
  quantity signed negative for returned lines;
* option-like positions: open lines are half-delta with some gamma.

All derivations are single aggregate jobs over joins; Catalyst prunes the scan
to the needed columns and AQE picks the join strategy from runtime sizes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.rounding import cents
from ..session import ensure_checkpoint_dir

PANEL_TICKERS = {"brand": "p_brand", "type": "p_type"}
PORTFOLIO_KEYS = {"segment": "c_mktsegment", "nation": "c_nationkey", "customer": "c_custkey"}
PERIODS_PER_YEAR = {"month": 12, "week": 52, "day": 252}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def price_panel(spark: SparkSession, sf_dir: str, ticker_by: str = "brand",
                period: str = "month") -> DataFrame:
    """prices(ticker, date, close): average unit price per ticker and period."""
    li = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity",
                                                       "l_extendedprice", "l_shipdate")
    part = read_table(spark, sf_dir, "part").select("p_partkey", F.col(PANEL_TICKERS[ticker_by]).alias("ticker"))
    return (li.join(part, li.l_partkey == part.p_partkey)
            .groupBy("ticker", F.date_trunc(period, "l_shipdate").cast("date").alias("date"))
            .agg((cents(F.sum("l_extendedprice")) / F.sum("l_quantity")).alias("close")))


def tick_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw ticks (ticker, ts, close) from events; one row per event."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(F.col("event_type").alias("ticker"), "ts", F.col("value").alias("close"))


def position_book(spark: SparkSession, sf_dir: str, portfolio_by: str = "segment",
                  ticker_by: str = "brand", options: bool = False) -> DataFrame:
    """positions: signed quantity per (portfolio, ticker[, line status]).

    ``options=True`` splits each book by line status: open lines ('O') become
    option-like positions (delta 0.5, gamma 0.01), the others plain spot.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust = read_table(spark, sf_dir, "customer").select(
        "c_custkey", F.col(PORTFOLIO_KEYS[portfolio_by]).cast("string").alias("portfolio_id"))
    part = read_table(spark, sf_dir, "part").select("p_partkey", F.col(PANEL_TICKERS[ticker_by]).alias("ticker"))
    signed_qty = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    lines = (li.join(orders, li.l_orderkey == orders.o_orderkey)
             .join(cust, F.col("o_custkey") == cust.c_custkey)
             .join(part, li.l_partkey == part.p_partkey))
    keys = ["portfolio_id", "ticker"] + (["l_linestatus"] if options else [])
    book = lines.groupBy(*keys).agg(F.sum(signed_qty).alias("quantity"))
    if options:
        is_open = F.col("l_linestatus") == "O"
        delta = F.when(is_open, F.lit(0.5)).otherwise(F.lit(1.0))
        gamma = F.when(is_open, F.lit(0.01)).otherwise(F.lit(0.0))
    else:
        delta, gamma = F.lit(schemas.DEFAULT_DELTA), F.lit(schemas.DEFAULT_GAMMA)
    return book.select("portfolio_id", "ticker", "quantity",
                       F.lit(schemas.DEFAULT_ASSET_CLASS).alias("asset_class"),
                       delta.alias("delta"), gamma.alias("gamma"),
                       F.lit(schemas.DEFAULT_MATURITY).alias("maturity_in_years"))


def year_end_dates(prices: DataFrame) -> DataFrame:
    """as_of_date per calendar year: the last panel date of each year (a backtest calendar)."""
    return (prices.groupBy(F.year("date").alias("y")).agg(F.max("date").alias("as_of_date"))
            .select("as_of_date"))


def last_date(prices: DataFrame) -> DataFrame:
    """as_of_date: the newest date of the panel (one row)."""
    return prices.agg(F.max("date").alias("as_of_date"))


def _price_fields(raw: DataFrame, ticker: str, date: str, close: str) -> tuple[Column, Column, Column, Column]:
    """(ticker, day, price, fault) of a raw price row; the fault is the first of its reasons, else NULL."""
    d = F.col(date)
    day = F.to_date(F.try_to_timestamp(d, F.lit("yyyy-MM-dd"))) if dict(raw.dtypes).get(date) == "string" else F.to_date(d)
    number = F.col(close).cast("string").try_cast("double")
    name = F.upper(F.trim(F.col(ticker)))
    fault = (F.when(name.isNull(), "ticker").when(day.isNull(), "date")
             .when(number.isNull() | F.isnan(number) | (number == float("inf")), "close").when(number <= 0, "sign"))
    return name, day, number, fault


#: What a reject row says for each fault.
PRICE_FAULTS = {"ticker": "ticker is missing", "date": "date is not a day", "close": "price is not a number",
                "sign": "price is not positive", "duplicate": "another price of the day is used"}


def label_prices(raw: DataFrame, ticker: str = "ticker", date: str = "date", close: str = "close",
                 ts: str | None = None, source: str | None = None) -> DataFrame:
    """(source_file, ticker, date, close, value, ts, fault) of every raw price row; usable rows have no fault."""
    name, day, number, fault = _price_fields(raw, ticker, date, close)
    return raw.select((F.col(source) if source else F.lit(None).cast("string")).alias("source_file"), name.alias("ticker"),
                      day.alias("date"), number.alias("close"), F.col(close).cast("string").alias("value"),
                      (F.col(ts) if ts else F.lit(None).cast("timestamp")).alias("ts"), fault.alias("fault"))


def split_labelled(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, faulty) rows of ``label_prices``, written once into the shared folder, apart."""
    spark = labelled.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/prices-{uuid.uuid4().hex}"
    marked = labelled.withColumn("usable", F.col("fault").isNull())
    marked.write.partitionBy("usable").parquet(path)
    rows = spark.read.schema(marked.schema).parquet(path)
    return rows.filter("usable").drop("usable", "fault"), rows.filter("not usable").drop("usable")


def price_rejects(usable: DataFrame, faulty: DataFrame) -> DataFrame:
    """Reject rows (schemas.PRICE_REJECTS): faulty rows, and of a (ticker, day) all usable rows but the one
    that ``clean_prices`` takes (the last by time, else the highest price)."""
    order = Window.partitionBy("ticker", "date").orderBy(F.col("ts").desc_nulls_last(), F.col("close").desc())
    spare = usable.withColumn("_n", F.row_number().over(order)).filter("_n > 1").withColumn("fault", F.lit("duplicate"))
    reason = F.element_at(F.create_map(*[F.lit(x) for kv in PRICE_FAULTS.items() for x in kv]), F.col("fault"))
    columns = ["source_file", "ticker", "date", "value", reason.alias("reason")]
    return faulty.select(*columns).unionByName(spare.select(*columns))


def clean_prices(raw: DataFrame, as_of=None, ticker: str = "ticker", date: str = "date",
                 close: str = "close", ts: str | None = None) -> DataFrame:
    """Normalise a raw price table to prices(ticker, date, close).

    Upper-cases tickers, parses the date (DATE, TIMESTAMP or yyyy-MM-dd text),
    casts close with ``try_cast`` (bad numbers become NULL instead of failing
    the job), keeps ``date <= as_of`` when given, drops NULL and non-positive
    closes (a log-return needs a positive price), and keeps one row per
    (ticker, date): the last tick by ``ts`` when given, else the highest close.
    """
    d = F.col(date)
    dtype = dict(raw.dtypes).get(date)
    is_text = dtype == "string"
    if as_of is not None and dtype in ("timestamp", "timestamp_ntz", "date"):
        # Same cut on the raw column, so the scan can skip files / row groups.
        raw = raw.filter(d < F.date_add(F.lit(as_of).cast("date"), 1).cast(dtype))
    parsed_date = F.to_date(F.try_to_timestamp(d, F.lit("yyyy-MM-dd"))) if is_text else F.to_date(d)
    px = raw.select(F.upper(F.trim(F.col(ticker))).alias("ticker"), parsed_date.alias("date"),
                    F.col(close).cast("string").try_cast("double").alias("close"),
                    *([F.col(ts).alias("_ts")] if ts else []))
    px = px.filter(F.col("close") < float("inf")).filter(F.col("close").isNotNull() & (F.col("close") > 0) & F.col("date").isNotNull()
                   & F.col("ticker").isNotNull())
    if as_of is not None:
        px = px.filter(F.col("date") <= F.lit(as_of).cast("date"))
    pick = F.max_by("close", "_ts") if ts else F.max("close")
    return px.groupBy("ticker", "date").agg(pick.alias("close"))


def all_dates(prices: DataFrame) -> DataFrame:
    """as_of_date: every date of a panel."""
    return prices.select(F.col("date").alias("as_of_date")).distinct()


def price_quality(raw: DataFrame, ticker: str = "ticker", date: str = "date", close: str = "close") -> DataFrame:
    """(ticker, n_rows, n_bad_ticker, n_bad_date, n_bad_close, n_not_positive, n_duplicate): what
    ``clean_prices`` leaves out, counted per ticker (upper-cased; NULL for rows without one).

    A row counts under the first fault it has; duplicates are further usable rows
    of one (ticker, day).
    """
    name, day, _, fault = _price_fields(raw, ticker, date, close)
    rows = raw.select(name.alias("ticker"), day.alias("day"), fault.alias("fault"))
    per_day = rows.groupBy("ticker", "day", "fault").agg(F.count(F.lit(1)).alias("n"))

    def total(kind: str):
        return F.sum(F.when(F.col("fault") == kind, F.col("n")).otherwise(0)).alias(
            {"ticker": "n_bad_ticker", "date": "n_bad_date", "close": "n_bad_close", "sign": "n_not_positive"}[kind])

    return per_day.groupBy("ticker").agg(
        F.sum("n").alias("n_rows"), *[total(k) for k in ("ticker", "date", "close", "sign")],
        F.sum(F.when(F.col("fault").isNull(), F.col("n") - 1).otherwise(0)).alias("n_duplicate"))
