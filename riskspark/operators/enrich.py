"""Spot prices and position enrichment.

* ``latest_spot``: per (as_of_date, ticker) the close of the newest date on or
  before the as-of date, from ``prices_as_of`` rows — a partial aggregate
  (``max_by``), so each task reduces its rows before the shuffle. The registered
  query reads ``calibration.asof_index`` instead, one row each.
* ``latest_spot_window``: the window form: prices and as-of dates of a ticker in one
  order, every as-of date takes the last price before it. Its rows are the history
  plus one per as-of date and ticker.
* ``enrich_positions``: inner join of positions with the spot — positions with
  no spot drop out, and ``unmatched_positions`` lists them.
* ``portfolio_value``, ``dollar_delta``, ``exposures``: per-portfolio and
  per-(portfolio, factor) aggregates used by the VaR methods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pricing import exposure_columns
from ..plans.joins import factor_join


def latest_spot(px_asof: DataFrame) -> DataFrame:
    """(as_of_date, ticker, spot_price, spot_date) from ``prices_as_of`` rows."""
    return (px_asof.filter(F.col("close").isNotNull())
            .groupBy("as_of_date", "ticker")
            .agg(F.max_by("close", "date").alias("spot_price"), F.max("date").alias("spot_date")))


def latest_spot_window(prices: DataFrame, asofs: Column) -> DataFrame:
    known = prices.filter(F.col("close").isNotNull()).select("ticker", "date", F.struct("date", "close").alias("p"))
    dates = prices.select("ticker").distinct().select("ticker", F.explode(asofs).alias("date"), F.lit(None).cast(known.schema["p"].dataType).alias("p"))
    w = Window.partitionBy("ticker").orderBy("date", F.col("p").isNull())      # a price of the day comes before the day
    return (known.unionByName(dates).withColumn("last", F.last("p", ignorenulls=True).over(w))
            .filter(F.col("p").isNull() & F.col("last").isNotNull())
            .select(F.col("date").alias("as_of_date"), "ticker", F.col("last.close").alias("spot_price"), F.col("last.date").alias("spot_date")))


def enrich_positions(positions: DataFrame, spot: DataFrame, spot_rows: int | None = None) -> DataFrame:
    """(as_of_date, portfolio_id, ticker, quantity, asset_class, delta, gamma,
    maturity_in_years, spot_price): one row per position and as-of date.

    ``spot_rows`` (exact size of the spot table) lets the join broadcast the
    spot prices instead of hash-partitioning the book by ticker (few keys,
    one of them possibly held by a third of all positions); past the limit
    it is salted by book (plans.joins)."""
    sp = spot.select("as_of_date", "ticker", "spot_price")
    if spot_rows is not None:
        return (factor_join(positions, sp, ["ticker"], F.hash("portfolio_id"), spot_rows)
                .select("as_of_date", "portfolio_id", "ticker", "quantity", "asset_class",
                        "delta", "gamma", "maturity_in_years", "spot_price"))
    return (positions.join(sp, "ticker")
            .select("as_of_date", "portfolio_id", "ticker", "quantity", "asset_class",
                    "delta", "gamma", "maturity_in_years", "spot_price"))


def unmatched_positions(positions: DataFrame, prices: DataFrame, as_of_dates: DataFrame) -> DataFrame:
    """(as_of_date, portfolio_id, ticker, quantity): positions without a spot
    at an as-of date, i.e. what the inner join of ``enrich_positions`` drops.

    A position has no spot at date ``a`` exactly when its ticker's first price
    is after ``a`` (or it has none). Each position is exploded to those dates of
    the as-of calendar; first dates (one row per ticker) are looked up through a
    join that is broadcast behind its exact size, else salted by book.
    """
    from .calibration import as_of_array

    asofs = as_of_array(as_of_dates)
    first = prices.filter(F.col("close").isNotNull()).groupBy("ticker").agg(F.min("date").alias("first_date"))
    known = positions.select("ticker").distinct().join(first, "ticker", "left")
    pos = factor_join(positions, known, ["ticker"], F.hash("portfolio_id"), known.count())
    without = F.filter(asofs, lambda a: F.col("first_date").isNull() | (F.col("first_date") > a))
    return pos.select(F.explode(without).alias("as_of_date"), "portfolio_id", "ticker", "quantity")


def portfolio_value(enriched: DataFrame) -> DataFrame:
    """(as_of_date, portfolio_id, total_value) = sum(quantity * spot)."""
    return (enriched.groupBy("as_of_date", "portfolio_id")
            .agg(F.sum(F.col("quantity") * F.col("spot_price")).alias("total_value")))


def dollar_delta(enriched: DataFrame) -> DataFrame:
    """(as_of_date, portfolio_id, ticker, dollar_delta) = sum(quantity * spot * delta)."""
    return (enriched.groupBy("as_of_date", "portfolio_id", "ticker")
            .agg(F.sum(F.col("quantity") * F.col("spot_price") * F.col("delta")).alias("dollar_delta")))


def exposures(enriched: DataFrame) -> DataFrame:
    """(as_of_date, portfolio_id, ticker, lin_exposure, quad_exposure).

    Positions on one factor collapse exactly (see functions.pricing), so a
    book with millions of lines prices scenarios at (portfolio, factor) grain.
    """
    return enriched.groupBy("as_of_date", "portfolio_id", "ticker").agg(*exposure_columns())
