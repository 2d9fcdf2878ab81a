"""Market-data calibration: returns, volatilities, correlations, covariances.

Log-returns belong to a factor's own price history and do not depend on any
as-of date, so they are computed once per ticker (``price_returns``). An as-of
date sees the returns up to it, and everything it needs of them is a running sum:

* each return row carries the running count, sum and sum of squares of its ticker
  and serves the as-of dates up to the ticker's next return (``running_moments``),
  so a volatility is read from one row;
* the products of two buckets of factors are accumulated date by date in one group
  and read at every as-of date (``running_pairs``).

So the rows that move grow with history plus as-of dates, not with their product.
``returns_as_of`` (each return exploded to the as-of dates it is known at) remains
for what needs every return of every as-of date: the scaled returns of the
projected variance and the Monte Carlo paths. Matrices are long tables
``(as_of_date, ti, tj, value)``; nothing is collected but the distinct as-of dates,
which a calendar bounds.

Pairing of factors (``align``):

* ``date`` (default): returns are paired by date, and every factor is centred
  and scaled by its own history: with ``z[i, d] = x[i, d] / sqrt(n_i - 1)`` the
  covariance is ``periods * sum_d z[i, d] z[j, d]`` over the dates both have. For
  equal calendars this is the sample covariance; for ragged ones it stays
  positive semi-definite, its diagonal is each factor's own variance, and no
  factor's figures depend on any other factor.
* ``ordinal``: paired by return number; factors of one as-of date must have
  equally many returns, anything else raises an error that names the factor.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas

MAX_AS_OF_DATES = 40_000     # more than a century of days
PAIR_BUCKET = 256            # factors of one block of the pair products
PAIR_CELLS = 1_000_000       # factor pairs x as-of dates that one group of running products returns


def as_of_days(as_of_dates: DataFrame) -> list:
    """The distinct as-of dates (bounded by the calendar)."""
    return known_days(r[0] for r in as_of_dates.select("as_of_date").distinct().limit(MAX_AS_OF_DATES + 1).collect())


def known_days(dates) -> list:
    """Distinct dates in order; NULLs are left out."""
    known = sorted({d for d in dates if d is not None})
    if len(known) > MAX_AS_OF_DATES:
        raise ValueError(f"more than {MAX_AS_OF_DATES} distinct as-of dates")
    return known


def as_of_array(as_of_dates: DataFrame) -> Column:
    """The distinct as-of dates as one sorted array literal."""
    return date_array(as_of_days(as_of_dates))


def date_array(dates) -> Column:
    """Distinct dates as one sorted array literal; NULLs are left out."""
    text = ",".join(d.isoformat() for d in known_days(dates))
    return F.transform(F.filter(F.split(F.lit(text), ","), lambda d: d != ""), lambda d: d.cast("date"))


def prices_as_of(prices: DataFrame, as_of_dates: DataFrame | Column) -> DataFrame:
    """(as_of_date, ticker, date, close): every price known at each as-of date."""
    asofs = as_of_dates if isinstance(as_of_dates, Column) else as_of_array(as_of_dates)
    return prices.select(F.explode(F.filter(asofs, lambda a: a >= F.col("date"))).alias("as_of_date"), "ticker", "date", "close")


def asof_index(prices: DataFrame, asofs: Column) -> DataFrame:
    """(as_of_date, ticker, spot_price, spot_date, n_prices): the last price at or before each as-of date.

    Every price serves the as-of dates from its own date to the day before the
    ticker's next price, so each (as_of_date, ticker) comes from one row.
    """
    w = Window.partitionBy("ticker").orderBy("date")
    known = (prices.filter(F.col("close").isNotNull())
             .select("ticker", "date", "close", F.lead("date").over(w).alias("next"), F.row_number().over(w).alias("n_prices")))
    serves = F.filter(asofs, lambda a: (a >= F.col("date")) & (F.col("next").isNull() | (a < F.col("next"))))
    return known.select(F.explode(serves).alias("as_of_date"), "ticker", F.col("close").alias("spot_price"),
                        F.col("date").alias("spot_date"), F.col("n_prices").cast("int").alias("n_prices"))


def price_counts(px_asof: DataFrame) -> DataFrame:
    """(as_of_date, ticker, n_prices) per factor and as-of date."""
    if "n_prices" in px_asof.columns:
        return px_asof.select("as_of_date", "ticker", "n_prices")
    return px_asof.groupBy("as_of_date", "ticker").agg(F.count("*").cast("int").alias("n_prices"))


def short_history_factors(px_asof: DataFrame, min_prices: int = 2, strict: bool = False) -> DataFrame:
    """Factors with fewer than ``min_prices`` prices at an as-of date: they
    cannot be calibrated and contribute nothing. ``strict`` raises an error that
    names the ticker instead, when the rows are read."""
    short = (price_counts(px_asof).filter(F.col("n_prices") < min_prices)
             .withColumn("reason", F.lit(schemas.MSG_MIN_PRICES)))
    if strict:
        message = F.concat_ws(" ", F.lit("ticker"), "ticker", F.lit(schemas.MSG_MIN_PRICES))
        short = short.withColumn("reason", F.when(F.col("n_prices") >= 0, F.raise_error(message)).otherwise(F.col("reason")))
    return short


def price_returns(prices: DataFrame) -> DataFrame:
    """(ticker, t, date, r): log-returns of consecutive prices, ``t`` their 0-based number."""
    w = Window.partitionBy("ticker").orderBy("date")
    return (prices.filter(F.col("close").isNotNull())
            .select("ticker", "date", (F.log(F.col("close")) - F.log(F.lag("close").over(w))).alias("r"),
                    (F.row_number().over(w) - 2).cast("int").alias("t"))
            .filter(F.col("r").isNotNull()).select("ticker", "t", "date", "r"))


def running_moments(own: DataFrame, asofs: Column, window: int | None = None) -> DataFrame:
    """(as_of_date, ticker, n, mean, ss): count, mean and sum of squared deviations of the returns known at
    each as-of date (of the newest ``window`` ones when given).

    Sums run over the returns less the ticker's first one, which changes no
    variance and keeps them small: a constant series has exactly none.
    """
    w = Window.partitionBy("ticker").orderBy("date")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    sums = (own.select("ticker", "date", "t", F.first("r").over(run).alias("r0"), "r")
            .withColumn("x", F.col("r") - F.col("r0"))
            .select("ticker", "date", "t", "r0", F.lead("date").over(w).alias("next"),
                    F.sum("x").over(run).alias("s1"), F.sum(F.col("x") * F.col("x")).over(run).alias("s2")))
    n, s1, s2 = F.col("t") + 1, F.col("s1"), F.col("s2")
    if window is not None:
        before = [F.coalesce(F.lag(c, window).over(w), F.lit(0.0)) for c in ("s1", "s2")]
        n, s1, s2 = F.least(n, F.lit(window)), s1 - before[0], s2 - before[1]
    row = sums.select("ticker", "date", "next", n.cast("int").alias("n"), (F.col("r0") + s1 / n).alias("mean"),
                      F.greatest(s2 - s1 * s1 / n, F.lit(0.0)).alias("ss"))
    serves = F.filter(asofs, lambda a: (a >= F.col("date")) & (F.col("next").isNull() | (a < F.col("next"))))
    return row.select(F.explode(serves).alias("as_of_date"), "ticker", "n", "mean", "ss")


def vols_from_moments(moments: DataFrame, periods_per_year: float = schemas.DEFAULT_PERIODS_PER_YEAR) -> DataFrame:
    """(as_of_date, ticker, vol, n_obs): sample std of a factor's own returns x sqrt(periods); one return: NULL."""
    std = F.when(F.col("n") > 1, F.sqrt(F.col("ss") / (F.col("n") - 1)))
    return moments.select("as_of_date", "ticker", (std * F.lit(math.sqrt(periods_per_year))).alias("vol"), F.col("n").alias("n_obs"))


def returns_as_of(returns: DataFrame, asofs: Column) -> DataFrame:
    """(as_of_date, ticker, t, date, r): the returns known at each as-of date."""
    return returns.select(F.explode(F.filter(asofs, lambda a: a >= F.col("date"))).alias("as_of_date"), "ticker", "t", "date", "r")


def log_returns(px_asof: DataFrame) -> DataFrame:
    """(as_of_date, ticker, t, date, r) from ``prices_as_of`` rows."""
    w = Window.partitionBy("as_of_date", "ticker").orderBy("date")
    return (px_asof.select("as_of_date", "ticker", "date", (F.log(F.col("close")) - F.log(F.lag("close").over(w))).alias("r"),
                           (F.row_number().over(w) - 2).cast("int").alias("t"))
            .filter(F.col("r").isNotNull()).select("as_of_date", "ticker", "t", "date", "r"))


def centred_returns(returns: DataFrame) -> DataFrame:
    """Adds x = r - mean(r) and n = number of returns per (as_of_date, ticker)."""
    w = Window.partitionBy("as_of_date", "ticker")
    return returns.withColumn("x", F.col("r") - F.avg("r").over(w)).withColumn("n", F.count(F.lit(1)).over(w))


def newest_returns(returns: DataFrame, window: int | None) -> DataFrame:
    """The newest ``window`` returns of each (as_of_date, ticker); all of them without a window."""
    if window is None:
        return returns
    n = F.count(F.lit(1)).over(Window.partitionBy("as_of_date", "ticker"))
    return returns.withColumn("_n", n).filter(F.col("t") >= F.col("_n") - window).drop("_n")


def scaled_returns(returns: DataFrame, align: str = "date") -> DataFrame:
    """(as_of_date, ticker, d, z): z = x / sqrt(n - 1), paired on ``d``.

    Factors with fewer than two returns have no variance and are left out. ``d``
    is the date as a day number, or the return number under ``ordinal``.
    """
    c = centred_returns(returns)
    if align == "ordinal":
        longest = F.max("n").over(Window.partitionBy("as_of_date"))
        uneven = F.concat_ws(" ", F.lit("ordinal alignment: ticker"), "ticker", F.lit("has fewer returns than the others"))
        c = c.withColumn("d", F.when(F.col("n") < longest, F.raise_error(uneven).cast("int")).otherwise(F.col("t")))
    elif align == "date":
        c = c.withColumn("d", F.unix_date("date"))
    else:
        raise ValueError(f"unknown alignment {align!r}")
    return c.filter(F.col("n") >= 2).select("as_of_date", "ticker", "d", (F.col("x") / F.sqrt(F.col("n") - 1)).alias("z"))


def annualised_vol(returns: DataFrame, periods_per_year: float = schemas.DEFAULT_PERIODS_PER_YEAR) -> DataFrame:
    """(as_of_date, ticker, vol, n_obs): sample std of a factor's own returns x sqrt(periods)."""
    return (returns.groupBy("as_of_date", "ticker")
            .agg((F.stddev_samp("r") * F.lit(math.sqrt(periods_per_year))).alias("vol"),
                 F.count("*").cast("int").alias("n_obs")))


def _pair_block(rows):
    """rho and sum of z products of all factor pairs of one block of two buckets."""
    import numpy as np
    import pandas as pd

    as_of, i, j = rows["as_of_date"].iloc[0], rows["i"].iloc[0], rows["j"].iloc[0]
    days = np.unique(rows["d"].to_numpy())

    def side(bucket):
        own = rows[rows["bucket"] == bucket]
        names, at = np.unique(own["ticker"].to_numpy(dtype=str), return_inverse=True)
        m = np.zeros((len(days), len(names)))
        m[np.searchsorted(days, own["d"].to_numpy()), at] = own["z"].to_numpy(dtype=float)
        return names, m

    (left, a), (right, b) = side(i), side(j)
    s = a.T @ b
    scale = np.sqrt((a * a).sum(0))[:, None] * np.sqrt((b * b).sum(0))[None, :]
    rho = np.where(scale > 0, s / np.where(scale > 0, scale, 1.0), 0.0)
    ti, tj = np.repeat(left, len(right)), np.tile(right, len(left))
    keep = ti <= tj if i == j else np.ones(len(ti), bool)
    return pd.DataFrame({"as_of_date": as_of, "ti": ti[keep], "tj": tj[keep], "rho": rho.reshape(-1)[keep], "s": s.reshape(-1)[keep]})


def factor_pairs(scaled: DataFrame, n_factors: int | None = None) -> DataFrame:
    """(as_of_date, ti, tj, rho, s): every ordered factor pair, s = sum of z products.

    Factors fall into buckets of about ``PAIR_BUCKET``; one group multiplies the
    (dates x factors) blocks of two buckets, so a task's work is bounded and a
    return row moves once per bucket instead of once per other factor. A factor
    with zero variance gets correlation 0 with everything, itself included.
    """
    if n_factors is None:
        n_factors = scaled.select("ticker").distinct().count()
    buckets = max(1, -(-n_factors // PAIR_BUCKET))
    other = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))
    rows = (scaled.withColumn("bucket", F.pmod(F.hash("ticker"), F.lit(buckets)).cast("int")).withColumn("other", other)
            .select("as_of_date", F.least("bucket", "other").cast("int").alias("i"), F.greatest("bucket", "other").cast("int").alias("j"),
                    "bucket", "ticker", "d", "z"))
    return _both_halves(rows.groupBy("as_of_date", "i", "j").applyInPandas(_pair_block, "as_of_date date, ti string, tj string, rho double, s double"))


def _both_halves(upper: DataFrame) -> DataFrame:
    """Every ordered pair from those with ti <= tj or of different buckets."""
    both = F.when(F.col("ti") == F.col("tj"), F.array(F.struct("ti", "tj"))).otherwise(
        F.array(F.struct("ti", "tj"), F.struct(F.col("tj").alias("ti"), F.col("ti").alias("tj"))))
    return upper.select("as_of_date", F.explode(both).alias("p"), "rho", "s").select("as_of_date", "p.ti", "p.tj", "rho", "s")


def _running_block(days: list):
    """rho and sum of z products of all factor pairs of two buckets at every as-of date."""
    import numpy as np
    import pandas as pd

    days = np.array(days, "datetime64[D]")

    def kernel(rows):
        i, j = rows["i"].iloc[0], rows["j"].iloc[0]
        dates = np.unique(rows["date"].to_numpy("datetime64[D]"))

        def side(bucket):
            own = rows[rows["bucket"] == bucket].sort_values("date", kind="stable")
            names, at = np.unique(own["ticker"].to_numpy(dtype=str), return_inverse=True)
            r, day = own["r"].to_numpy(dtype=float), np.searchsorted(dates, own["date"].to_numpy("datetime64[D]"))
            first = np.zeros(len(names))
            first[at[::-1]] = r[::-1]                              # a factor's oldest return
            x, held = np.zeros((len(dates), len(names))), np.zeros((len(dates), len(names)))
            x[day, at], held[day, at] = r - first[at], 1.0
            n, s1, s2 = (m.cumsum(0) for m in (held, x, x * x))
            mean = s1 / np.maximum(n, 1)
            return names, x, held, n, mean, np.maximum(s2 - s1 * mean, 0.0)

        left = side(i)
        right = left if i == j else side(j)
        (li, xi, hi, ni, mi, vi), (lj, xj, hj, nj, mj, vj) = left, right
        xx, xh, hx, hh = (np.zeros((len(li), len(lj))) for _ in range(4))
        seen, out = 0, []
        for day, upto in zip(days, np.searchsorted(dates, days, "right")):
            if upto > seen:
                new = slice(seen, upto)
                xx += xi[new].T @ xj[new]
                xh += xi[new].T @ hj[new]
                hx += hi[new].T @ xj[new]
                hh += hi[new].T @ hj[new]
                seen = upto
            if not upto:
                continue
            k = upto - 1
            a, b = np.flatnonzero(ni[k] > 1), np.flatnonzero(nj[k] > 1)
            if not len(a) or not len(b):
                continue
            at = np.ix_(a, b)
            s = xx[at] - mj[k, b][None, :] * xh[at] - mi[k, a][:, None] * hx[at] + mi[k, a][:, None] * mj[k, b][None, :] * hh[at]
            s /= np.sqrt(ni[k, a] - 1)[:, None] * np.sqrt(nj[k, b] - 1)[None, :]
            if i == j:
                np.fill_diagonal(s, vi[k, a] / (ni[k, a] - 1))
            scale = np.sqrt(vi[k, a] / (ni[k, a] - 1))[:, None] * np.sqrt(vj[k, b] / (nj[k, b] - 1))[None, :]
            rho = np.where(scale > 0, s / np.where(scale > 0, scale, 1.0), 0.0)
            s = np.where(scale > 0, s, 0.0)
            ti, tj = np.repeat(li[a], len(b)), np.tile(lj[b], len(a))
            keep = ti <= tj if i == j else np.ones(len(ti), bool)
            out.append(pd.DataFrame({"as_of_date": np.repeat(day, keep.sum()), "ti": ti[keep], "tj": tj[keep],
                                     "rho": rho.reshape(-1)[keep], "s": s.reshape(-1)[keep]}))
        if not out:
            return pd.DataFrame({"as_of_date": pd.Series([], dtype="datetime64[s]"), "ti": pd.Series([], dtype=object),
                                 "tj": pd.Series([], dtype=object), "rho": pd.Series([], dtype=float), "s": pd.Series([], dtype=float)})
        out = pd.concat(out, ignore_index=True)
        out["as_of_date"] = out["as_of_date"].dt.date
        return out

    return kernel


def running_pairs(own: DataFrame, days: list, n_factors: int | None = None) -> DataFrame:
    """``factor_pairs`` of the returns known at each as-of date, from the returns alone.

    Factors fall into buckets; one group holds the histories of two buckets and
    accumulates their products date by date, so a return row moves once per bucket,
    whatever the number of as-of dates. Buckets are sized so that a group returns
    about ``PAIR_CELLS`` rows.
    """
    if n_factors is None:
        n_factors = own.select("ticker").distinct().count()
    size = max(1, min(PAIR_BUCKET, int(math.sqrt(PAIR_CELLS / max(1, len(days))))))
    buckets = max(1, -(-n_factors // size))
    other = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))
    rows = (own.withColumn("bucket", F.pmod(F.hash("ticker"), F.lit(buckets)).cast("int")).withColumn("other", other)
            .select(F.least("bucket", "other").cast("int").alias("i"), F.greatest("bucket", "other").cast("int").alias("j"),
                    "bucket", "ticker", "date", "r"))
    return _both_halves(rows.groupBy("i", "j").applyInPandas(_running_block(days), "as_of_date date, ti string, tj string, rho double, s double"))


def correlation_matrix(returns: DataFrame, align: str = "date") -> DataFrame:
    """(as_of_date, ti, tj, rho): Pearson correlation of every factor pair."""
    return factor_pairs(scaled_returns(returns, align)).select("as_of_date", "ti", "tj", "rho")


def covariance_from_corr(corr: DataFrame, vols: DataFrame) -> DataFrame:
    """(as_of_date, ti, tj, sigma) = rho_ij * vol_i * vol_j.

    A factor absent from ``vols`` counts as volatility 0; a vol that is present
    but undefined (NULL: a single return) keeps sigma undefined.
    """
    vi = vols.select("as_of_date", F.col("ticker").alias("ti"), F.col("vol").alias("vol_i"),
                     F.lit(True).alias("has_i"))
    vj = vols.select("as_of_date", F.col("ticker").alias("tj"), F.col("vol").alias("vol_j"),
                     F.lit(True).alias("has_j"))

    def vol(v, has):
        return F.when(F.col(has).isNull(), F.lit(0.0)).otherwise(F.col(v))

    return (corr.join(vi, ["as_of_date", "ti"], "left").join(vj, ["as_of_date", "tj"], "left")
            .select("as_of_date", "ti", "tj",
                    (F.col("rho") * vol("vol_i", "has_i") * vol("vol_j", "has_j")).alias("sigma")))


def covariance_matrix(returns: DataFrame, periods_per_year: float = schemas.DEFAULT_PERIODS_PER_YEAR,
                      align: str = "date") -> DataFrame:
    """(as_of_date, ti, tj, sigma): annualised covariance from prices."""
    pairs = factor_pairs(scaled_returns(returns, align))
    return pairs.select("as_of_date", "ti", "tj", (F.lit(float(periods_per_year)) * F.col("s")).alias("sigma"))


def history_quality(px_asof: DataFrame, windows: DataFrame) -> DataFrame:
    """(as_of_date, window, ticker, n_returns, status, reason) for historical replay.

    status: OK (history covers the window), SHORT (the oldest return is
    repeated to fill the window) or MISSING (no return: zero P&L for the factor,
    ``reason`` holds the error code). ``windows`` holds (as_of_date, historical_window) pairs.
    """
    n = price_counts(px_asof).withColumn("n_returns", F.greatest(F.col("n_prices") - 1, F.lit(0)))
    status = (F.when(F.col("n_returns") == 0, "MISSING")
              .when(F.col("n_returns") < F.col("historical_window"), "SHORT")
              .otherwise("OK"))
    return (n.join(windows.select("as_of_date", "historical_window").distinct(), "as_of_date")
            .select("as_of_date", "historical_window", "ticker", "n_returns", status.alias("status"),
                    F.when(F.col("n_returns") == 0, schemas.ERR_CALCULATION).alias("reason")))


@dataclass
class Calibration:
    """Calibrated market data for a set of as-of dates (all lazy DataFrames)."""
    prices: DataFrame
    asofs: Column
    periods_per_year: float
    align: str = "date"
    window: int | None = None      # newest returns that volatilities and covariances see; None: all
    days: list | None = None       # the as-of dates of ``asofs``
    _cache: dict = field(default_factory=dict, repr=False)

    def use(self, key: str, df: DataFrame) -> DataFrame:
        """Replace a derived table ("own", "scaled", "pairs", ...) by a materialised copy."""
        self._cache[key] = df
        return df

    def _get(self, key, build):
        if key not in self._cache:
            self._cache[key] = build()
        return self._cache[key]

    @property
    def prices_as_of(self) -> DataFrame:
        return self._get("px", lambda: prices_as_of(self.prices, self.asofs))

    @property
    def index(self) -> DataFrame:
        return self._get("index", lambda: asof_index(self.prices, self.asofs))

    @property
    def own(self) -> DataFrame:
        """Returns per ticker, without as-of dates."""
        return self._get("own", lambda: price_returns(self.prices))

    @property
    def returns(self) -> DataFrame:
        return self._get("returns", lambda: returns_as_of(self.own, self.asofs))

    @property
    def scaled(self) -> DataFrame:
        return self._get("scaled", lambda: scaled_returns(newest_returns(self.returns, self.window), self.align))

    @property
    def vols(self) -> DataFrame:
        return self._get("vols", lambda: vols_from_moments(self.moments, self.periods_per_year))

    @property
    def moments(self) -> DataFrame:
        return self._get("moments", lambda: running_moments(self.own, self.asofs, self.window))

    @property
    def pairs(self) -> DataFrame:
        """Running products; windows and ordinal pairing need the scaled returns of each as-of date."""
        if self.days is None or self.window is not None or self.align != "date":
            return self._get("pairs", lambda: factor_pairs(self.scaled))
        return self._get("pairs", lambda: running_pairs(self.own, self.days))

    @property
    def corr(self) -> DataFrame:
        return self.pairs.select("as_of_date", "ti", "tj", "rho")

    @property
    def cov(self) -> DataFrame:
        return self.pairs.select("as_of_date", "ti", "tj", (F.lit(float(self.periods_per_year)) * F.col("s")).alias("sigma"))

    @property
    def short_history(self) -> DataFrame:
        return self._get("short", lambda: short_history_factors(self.index))


def calibrate(prices: DataFrame, as_of_dates: DataFrame,
              periods_per_year: float = schemas.DEFAULT_PERIODS_PER_YEAR,
              align: str = "date", window: int | None = None) -> Calibration:
    days = as_of_days(as_of_dates)
    return Calibration(prices, date_array(days), periods_per_year, align, window, days)
