"""Value-at-Risk and Expected Shortfall.

Scenario statistics (historical and Monte Carlo)
------------------------------------------------
For a portfolio with ``n`` scenario P&Ls sorted ascending and confidence
``alpha``::

    idx = clamp(floor((1 - alpha) * n), 0, n - 1)        (double arithmetic)
    VaR = -pnl[idx]                                       (0-based, no interpolation)
    ES  = -mean(pnl[0 .. idx])                            (inclusive)
    mean, std (n - 1), n

One window per (scenario set, portfolio) ranks the P&Ls and keeps a running
sum; requests that share the set then pick their own rank with an equi-join, so
two confidence levels never re-sort the scenarios. A group holds one set's
scenarios of one portfolio: at most ``num_paths`` (validated <= 1e6) or
``historical_window`` rows, whatever the data volume.

Sets of many scenarios are not ranked whole (``scenario_var_by_tail``): a
histogram of the P&Ls over order-keeping buckets, combined in the tasks, tells the
bucket that holds each portfolio's rank ``idx + 1``; only scenarios up to that
bucket are exchanged and ranked. Both give the same rows, ties included.

Parametric
----------
``VaR = z * sigma_P`` and ``ES = sigma_P * pdf(z) / (1 - alpha)`` with
``z = ppf(alpha)``; zero mean, no holding-period scaling. ``sigma_P^2`` is the
quadratic form of the dollar deltas with the annualised covariance. The
projected form ``periods * sum_d (sum_i delta_i * z[i, d])^2`` gives the same
number without ever building the n x n matrix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.normal import norm_pdf, norm_ppf
from ..plans.joins import factor_join, may_broadcast
from ..session import cut_lineage


def quantile_index(alpha, n) -> F.Column:
    a = F.col(alpha) if isinstance(alpha, str) else alpha
    m = F.col(n) if isinstance(n, str) else n
    raw = F.floor((F.lit(1.0) - a.cast("double")) * m.cast("double"))
    return F.greatest(F.lit(0), F.least(raw, m - F.lit(1))).cast("int")


def rank_scenarios(pnl: DataFrame, set_keys: list[str]) -> DataFrame:
    """Adds rn (1-based), cum_pnl (running sum in rank order) and the per-group
    n, mean_pnl, std_dev_pnl.

    P&Ls are ordered as they are, equal amounts by scenario id.
    """
    part = [*set_keys, "portfolio_id"]
    ordered = Window.partitionBy(*part).orderBy("pnl", "scenario_id")
    # Same partition and order for every column: one Window operator, one sort.
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return pnl.select(
        "*",
        F.row_number().over(ordered).alias("rn"),
        F.sum("pnl").over(ordered.rowsBetween(Window.unboundedPreceding, 0)).alias("cum_pnl"),
        F.count(F.lit(1)).over(whole).alias("n"),
        F.avg("pnl").over(whole).alias("mean_pnl"),
        F.stddev_samp("pnl").over(whole).alias("std_dev_pnl"))


def scenario_var(requests: DataFrame, pnl: DataFrame, set_keys: list[str], method: str,
                 request_rows: int | None = None) -> DataFrame:
    """Result rows (schemas.RESULTS) of the scenario methods.

    ``requests`` carries correlation_id, alpha and the set keys; ``pnl`` is
    (set keys..., portfolio_id, scenario_id, pnl). The ranked scenarios are
    read once: every request sharing the set is joined onto them and keeps
    the row at its own rank ``idx + 1`` (``request_rows`` — the exact request
    count — lets that join be a broadcast; see plans.joins).
    """
    return _read_ranks(requests, rank_scenarios(pnl, set_keys), set_keys, method, request_rows)


def _read_ranks(requests: DataFrame, ranked: DataFrame, set_keys: list[str], method: str, request_rows: int | None) -> DataFrame:
    req = requests.select("correlation_id", "alpha", *set_keys)
    hit = (factor_join(ranked, req, set_keys, F.hash("portfolio_id"), request_rows)
           .withColumn("idx", quantile_index("alpha", "n"))
           .filter(F.col("rn") == F.col("idx") + 1))
    return hit.select(
        "correlation_id", "portfolio_id", "as_of_date", F.lit(method).alias("method"),
        (-F.col("pnl")).alias("var_amount"),
        (-F.col("cum_pnl") / (F.col("idx") + 1)).alias("expected_shortfall"),
        "alpha", "mean_pnl", "std_dev_pnl", F.col("n").cast("int").alias("num_scenarios"))


def scenario_var_from_distribution(requests: DataFrame, dist: DataFrame, set_keys: list[str], method: str,
                                   request_rows: int | None = None) -> DataFrame:
    """Result rows from per-book sorted P&L arrays (scenarios.scenario_distribution_blocks):
    the same quantile rule, read with ``element_at`` instead of a window."""
    req = requests.select("correlation_id", "alpha", *set_keys)
    hit = (factor_join(dist, req, set_keys, F.hash("portfolio_id"), request_rows)
           .withColumn("idx", quantile_index("alpha", "n")))
    return hit.select(
        "correlation_id", "portfolio_id", "as_of_date", F.lit(method).alias("method"),
        (-F.element_at("sorted_pnl", F.col("idx") + 1)).alias("var_amount"),
        (-F.element_at("cum_pnl", F.col("idx") + 1) / (F.col("idx") + 1)).alias("expected_shortfall"),
        "alpha", "mean_pnl", "std_dev_pnl", F.col("n").cast("int").alias("num_scenarios"))


_ZERO_BUCKET = 1_000_000       # |1000 ln x| of any double stays below


def pnl_bucket(pnl) -> F.Column:
    """A whole number that never falls when the P&L rises: steps of 0.1 % of the amount; NULL is lowest, NaN highest."""
    p = F.col(pnl) if isinstance(pnl, str) else pnl
    size = F.floor(F.ln(F.abs(p)) * 1000.0)
    return (F.when(p.isNull(), -3 * _ZERO_BUCKET).when(F.isnan(p) | (p == float("inf")), 3 * _ZERO_BUCKET)
            .when(p == float("-inf"), -2 * _ZERO_BUCKET - 1).when(p == 0, 0)
            .when(p < 0, -_ZERO_BUCKET - size).otherwise(_ZERO_BUCKET + size)).cast("int")


def worst_scenarios(requests: DataFrame, pnl: DataFrame, set_keys: list[str], request_rows: int | None = None) -> DataFrame:
    """The scenarios that rank up to ``idx + 1`` for some request of their set, ranked: pnl's columns,
    rn, cum_pnl, n, mean_pnl, std_dev_pnl.

    ``pnl`` is read three times and should be materialised. Counts, means and the
    histogram are partial aggregates; the limits (one row per set and portfolio) are
    broadcast behind their exact size, so that no other scenario is exchanged.
    """
    part = [*set_keys, "portfolio_id"]
    req = requests.select("alpha", *set_keys).distinct()
    stats = cut_lineage(pnl.groupBy(*part).agg(F.count(F.lit(1)).alias("n"), F.avg("pnl").alias("mean_pnl"), F.stddev_samp("pnl").alias("std_dev_pnl")))
    wanted = (factor_join(stats, req, set_keys, F.hash("portfolio_id"), request_rows).groupBy(*part)
              .agg((F.max(quantile_index("alpha", "n")) + 1).alias("k")))
    counts = pnl.groupBy(*part, pnl_bucket("pnl").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    above = F.sum("c").over(Window.partitionBy(*part).orderBy("b")) - F.col("c")
    limits = (counts.withColumn("above", above).join(wanted, part).filter(F.col("above") < F.col("k"))
              .groupBy(*part).agg(F.max("b").alias("last_bucket")))
    limits = limits.join(stats, part)
    if may_broadcast(limits, stats.count()):
        limits = F.broadcast(limits)
    tail = pnl.join(limits, part).filter(pnl_bucket("pnl") <= F.col("last_bucket")).drop("last_bucket")
    ordered = Window.partitionBy(*part).orderBy("pnl", "scenario_id")
    return tail.select("*", F.row_number().over(ordered).alias("rn"),
                       F.sum("pnl").over(ordered.rowsBetween(Window.unboundedPreceding, 0)).alias("cum_pnl"))


def scenario_var_by_tail(requests: DataFrame, pnl: DataFrame, set_keys: list[str], method: str,
                         request_rows: int | None = None) -> DataFrame:
    """``scenario_var`` from the worst scenarios alone (see ``worst_scenarios``)."""
    return _read_ranks(requests, worst_scenarios(requests, pnl, set_keys, request_rows), set_keys, method, request_rows)


def tail_scenarios(requests: DataFrame, pnl: DataFrame, set_keys: list[str],
                   request_rows: int | None = None, by_tail: bool = False) -> DataFrame:
    """(correlation_id, portfolio_id, rank, scenario_id, pnl): the worst
    ``idx + 1`` scenarios behind each VaR/ES figure. ``by_tail`` finds them
    without ranking the others (``worst_scenarios``)."""
    ranked = worst_scenarios(requests, pnl, set_keys, request_rows) if by_tail else rank_scenarios(pnl, set_keys)
    req = requests.select("correlation_id", "alpha", *set_keys)
    return (factor_join(ranked, req, set_keys, F.hash("portfolio_id"), request_rows)
            .filter(F.col("rn") <= quantile_index("alpha", "n") + 1)
            .select("correlation_id", "portfolio_id", F.col("rn").alias("rank"), "scenario_id", "pnl"))


def zero_results(requests: DataFrame, exposures: DataFrame, factors: DataFrame, method: str,
                 n_scenarios: F.Column, request_rows: int | None = None, scope: list[str] = ()) -> DataFrame:
    """Books none of whose factors has a shock: every scenario P&L is 0.

    ``factors`` is (as_of_date, ticker) of the shocked factors. Such books get
    no row from the scenario join, so they are listed here instead.
    """
    req = requests.select("correlation_id", "as_of_date", "alpha", *scope, n_scenarios.alias("num_scenarios"))
    books = exposures.select("as_of_date", "portfolio_id", *scope).distinct()
    priced = exposures.join(factors, ["as_of_date", "ticker"], "left_semi").select("as_of_date", "portfolio_id")
    missing = books.join(priced, ["as_of_date", "portfolio_id"], "left_anti")
    zero = F.lit(0.0)
    return (factor_join(missing, req, ["as_of_date", *scope], F.hash("portfolio_id"), request_rows)
            .select("correlation_id", "portfolio_id", "as_of_date", F.lit(method).alias("method"),
                    zero.alias("var_amount"), zero.alias("expected_shortfall"), "alpha",
                    zero.alias("mean_pnl"), zero.alias("std_dev_pnl"),
                    F.col("num_scenarios").cast("int").alias("num_scenarios")))


# ---------------------------------------------------------------------------
# Parametric
# ---------------------------------------------------------------------------

def portfolio_variance(dd: DataFrame, cov: DataFrame, cov_rows: int | None = None, dd_rows: int | None = None) -> DataFrame:
    """(as_of_date, portfolio_id, variance) = sum_ij delta_i * Sigma_ij * delta_j.

    Sigma times delta is summed per portfolio and factor first (combined in the
    tasks), so what meets the deltas again has one row per portfolio and factor.
    The join on the factor is broadcast or split by portfolio by the exact sizes.
    """
    di = dd.select("as_of_date", "portfolio_id", F.col("ticker").alias("ti"), F.col("dollar_delta").alias("d_i"))
    dj = dd.select("as_of_date", "portfolio_id", F.col("ticker").alias("tj"), F.col("dollar_delta").alias("d_j"))
    moved = (factor_join(di, cov.select("as_of_date", "ti", "tj", "sigma"), ["as_of_date", "ti"], F.hash("portfolio_id"), cov_rows, dd_rows, F.hash("tj"))
             .groupBy("as_of_date", "portfolio_id", "tj").agg(F.sum(F.col("d_i") * F.col("sigma")).alias("y")))
    return (moved.join(dj, ["as_of_date", "portfolio_id", "tj"]).groupBy("as_of_date", "portfolio_id")
            .agg(F.sum(F.col("y") * F.col("d_j")).alias("variance")))


def portfolio_variance_projected(dd: DataFrame, scaled: DataFrame,
                                 periods_per_year: float = schemas.DEFAULT_PERIODS_PER_YEAR,
                                 returns_rows: int | None = None, dd_rows: int | None = None,
                                 return_keys: int | None = None, n_dates: int = 1) -> DataFrame:
    """(as_of_date, portfolio_id, variance) = periods * sum_d (sum_i delta_i z[i, d])^2.

    Equal to the quadratic form with the covariance of ``scaled_returns``; costs
    portfolios x factors x T instead of portfolios x factors^2. Portfolios with
    no calibrated factor get variance 0. With all three exact sizes given
    (``return_keys``: distinct (as_of_date, ticker) of the returns), products of
    more than ``riskspark.pricing.blockMinPairs`` rows run as blocks, the shuffle
    partitions spread over the ``n_dates`` as-of dates.
    """
    spark = dd.sparkSession
    kernel = spark.conf.get("riskspark.pricing.kernel", "auto")
    if None not in (returns_rows, dd_rows, return_keys) and kernel != "relational" and may_broadcast(scaled, returns_rows):
        pairs = dd_rows * returns_rows / max(1, return_keys)
        if kernel == "blocks" or pairs >= float(spark.conf.get("riskspark.pricing.blockMinPairs", "20000000")):
            rows = int(spark.conf.get("riskspark.pricing.blockRows", "200000"))
            parts = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // max(1, n_dates))
            buckets = max(parts, -(-dd_rows // rows))
            return portfolio_variance_blocks(dd, scaled, periods_per_year, buckets)
    ret = scaled.select("as_of_date", "ticker", "d", "z")
    proj = (factor_join(dd, ret, ["as_of_date", "ticker"], F.hash("portfolio_id"), returns_rows, dd_rows, F.col("d"))
            .groupBy("as_of_date", "portfolio_id", "d")
            .agg(F.sum(F.col("dollar_delta") * F.col("z")).alias("y")))
    var = proj.groupBy("as_of_date", "portfolio_id").agg(
        (F.sum(F.col("y") * F.col("y")) * F.lit(float(periods_per_year))).alias("variance"))
    books = dd.select("as_of_date", "portfolio_id").distinct()
    return (books.join(var, ["as_of_date", "portfolio_id"], "left")
            .select("as_of_date", "portfolio_id", F.coalesce("variance", F.lit(0.0)).alias("variance")))


def _variance_block(periods_per_year: float):
    import numpy as np
    import pandas as pd

    def kernel(books: pd.DataFrame, z: pd.DataFrame) -> pd.DataFrame:
        if books.empty:
            return pd.DataFrame({"as_of_date": pd.Series([], dtype=object), "portfolio_id": pd.Series([], dtype=object),
                                 "variance": pd.Series([], dtype=float)})
        as_of = books["as_of_date"].iloc[0]
        ids, at = np.unique(books["portfolio_id"].to_numpy(dtype=str), return_inverse=True)
        variance = np.zeros(len(ids))
        if len(z):
            tickers, col = np.unique(z["ticker"].to_numpy(dtype=str), return_inverse=True)
            days, row = np.unique(z["d"].to_numpy(), return_inverse=True)
            m = np.zeros((len(tickers), len(days)))
            m[col, row] = z["z"].to_numpy(dtype=float)
            names = books["ticker"].to_numpy(dtype=str)
            pos = np.minimum(np.searchsorted(tickers, names), len(tickers) - 1)
            held = tickers[pos] == names
            order = np.argsort(at[held], kind="stable")
            own, pos, delta = at[held][order], pos[held][order], books["dollar_delta"].to_numpy(dtype=float)[held][order]
            for first in range(0, len(ids), 1024):          # books at a time: bounds the dense blocks
                lo, hi = np.searchsorted(own, [first, first + 1024])
                d = np.zeros((min(1024, len(ids) - first), len(tickers)))
                np.add.at(d, (own[lo:hi] - first, pos[lo:hi]), delta[lo:hi])
                variance[first:first + 1024] = ((d @ m) ** 2).sum(1) * periods_per_year
        return pd.DataFrame({"as_of_date": [as_of] * len(ids), "portfolio_id": ids.astype(object), "variance": variance})

    return kernel


def portfolio_variance_blocks(dd: DataFrame, scaled: DataFrame, periods_per_year: float, book_buckets: int) -> DataFrame:
    """Same rows as ``portfolio_variance_projected``: books fall into buckets, the scaled
    returns of an as-of date are copied into each, and a group multiplies the two blocks."""
    z = scaled.select("as_of_date", "ticker", "d", "z").withColumn("bb", F.explode(F.sequence(F.lit(0), F.lit(book_buckets - 1))))
    books = (dd.select("as_of_date", "portfolio_id", "ticker", "dollar_delta")
             .withColumn("bb", F.pmod(F.hash("portfolio_id"), F.lit(book_buckets))))
    z, books = (t.select(*[F.col(c).alias(c) for c in t.columns]) for t in (z, books))
    return (books.groupBy("as_of_date", "bb").cogroup(z.groupBy("as_of_date", "bb"))
            .applyInPandas(_variance_block(float(periods_per_year)), "as_of_date date, portfolio_id string, variance double"))


def parametric_var(requests: DataFrame, variance: DataFrame, request_rows: int | None = None,
                   horizon_years: float = 1.0, scope: list[str] = ()) -> DataFrame:
    """Result rows (schemas.RESULTS) of the parametric method; the annual variance is
    scaled by ``horizon_years`` (1: not at all). The requests
    are joined onto the books (broadcast when ``request_rows`` is under the
    limit), so books of one date are never gathered by date."""
    z = norm_ppf(F.col("alpha"))
    sigma = F.sqrt(F.col("variance") * F.lit(float(horizon_years)))
    req = requests.select("correlation_id", "as_of_date", "alpha", *scope)
    return (factor_join(variance, req, ["as_of_date", *scope], F.hash("portfolio_id"), request_rows)
            .select("correlation_id", "portfolio_id", "as_of_date", F.lit("PARAMETRIC").alias("method"),
                    (z * sigma).alias("var_amount"),
                    (sigma * norm_pdf(z) / (F.lit(1.0) - F.col("alpha"))).alias("expected_shortfall"),
                    "alpha", F.lit(0.0).alias("mean_pnl"), sigma.alias("std_dev_pnl"),
                    F.lit(0).cast("int").alias("num_scenarios")))
