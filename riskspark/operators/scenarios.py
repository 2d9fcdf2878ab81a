"""Scenario generation and scenario P&L.

A *scenario set* is identified by its key columns:

* historical replay: ``(as_of_date, historical_window)``;
* Monte Carlo: ``(as_of_date, num_paths, seed, steps, dt)``.

Requests that share a key share the scenarios (e.g. the same book at 95 % and
99 %), so each set is generated and priced once.

Shock tables are long: ``(set keys..., scenario_id, ticker, r)`` with ``r`` a
log-return shock of the factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.normal import hashed_normal
from ..functions.pricing import exposure_pnl
from ..plans.joins import factor_join, may_broadcast

HIST_KEYS = ["as_of_date", "historical_window"]
MC_KEYS = ["as_of_date", "num_paths", "seed", "steps", "dt"]

def historical_shocks(own_returns: DataFrame, sets: DataFrame, set_rows: int | None = None) -> DataFrame:
    """(as_of_date, historical_window, scenario_id, ticker, r).

    Scenario ``s`` of a window ``W`` replays, for each factor with ``n`` returns,
    return number ``max(0, n - W + s)``: windows are aligned at the newest
    return of each factor, and a history shorter than the window repeats its
    oldest return. Every factor yields exactly ``W`` scenarios.

    Instead of pairing every scenario with every factor, each return row emits
    the scenarios it serves: return ``k`` serves ``s = k - n + W`` and the
    oldest return (k = 0) also serves all padded scenarios ``0 .. W - n``. So
    the output is generated row-locally with ``explode`` (``W`` rows per factor).
    ``set_rows`` (exact number of sets) lets their join be a broadcast.
    """
    w = Window.partitionBy("as_of_date", "ticker")
    ret = own_returns.withColumn("n", F.count("*").over(w))
    hi = F.col("t") - F.col("n") + F.col("historical_window")
    lo = F.when(F.col("t") == 0, F.lit(0)).otherwise(hi)
    return (factor_join(ret, sets.select(*HIST_KEYS).distinct(), ["as_of_date"], F.hash("ticker"), set_rows)
            .filter(hi >= 0)
            .select(*HIST_KEYS, F.explode(F.sequence(lo.cast("int"), hi.cast("int"))).alias("scenario_id"),
                    "ticker", "r"))


def historical_shocks_indexed(index: DataFrame, own: DataFrame, sets: DataFrame, own_rows: int | None = None,
                              set_rows: int | None = None) -> DataFrame:
    """Same rows as ``historical_shocks``, from the as-of index and the returns of each ticker.

    A factor's index row of an as-of date knows how many returns are known there, so
    it lists the numbers of the newest ``W`` itself and looks them up by (ticker,
    number): no return is copied to as-of dates that do not replay it. The returns
    are broadcast behind their exact size ``own_rows``, else joined on that key,
    which spreads a ticker over its history.
    """
    n, window = F.col("n_prices") - 1, F.col("historical_window")
    factors = index.filter("n_prices > 1").select("as_of_date", "ticker", "n_prices")
    wanted = (factor_join(factors, sets.select(*HIST_KEYS).distinct(), ["as_of_date"], F.hash("ticker"), set_rows)
              .select(*HIST_KEYS, "ticker", n.alias("n"), F.explode(F.sequence(F.lit(0), (window - 1).cast("int"))).alias("scenario_id"))
              .select(*HIST_KEYS, "ticker", "scenario_id", F.greatest(F.lit(0), F.col("n") - window + F.col("scenario_id")).cast("int").alias("t")))
    returns = own.select("ticker", "t", "r")
    if may_broadcast(returns, own_rows):
        returns = F.broadcast(returns)
    return wanted.join(returns, ["ticker", "t"]).select(*HIST_KEYS, "scenario_id", "ticker", "r")


def grid_columns(time_grid: str = "time_grid"):
    """steps and dt of a time-grid name (NULL when the grid is unknown)."""
    steps = F.lit(None).cast("int")
    dt = F.lit(None).cast("double")
    for name, (n, d) in schemas.TIME_GRIDS.items():
        steps = F.when(F.col(time_grid) == name, F.lit(n)).otherwise(steps)
        dt = F.when(F.col(time_grid) == name, F.lit(d)).otherwise(dt)
    return steps.alias("steps"), dt.alias("dt")


def path_normals(sets: DataFrame, scaled: DataFrame, num_partitions: int, returns_rows: int | None = None,
                 set_rows: int | None = None) -> DataFrame:
    """(set keys..., scenario_id, d, w): one standard normal per path and date.

    Path ids of each seed are hash-distributed on (seed, scenario_id) with an
    explicit partition count (so AQE does not fold the few, small rows back
    into one task); each task draws the normals of its paths once for all as-of
    dates, and the sets of the seed pick them up. The shock sum and the P&L sum
    keep this partitioning. Values depend only on (seed, path, date): neither on
    the layout nor on which factors or as-of dates take part. Days and sets are
    broadcast behind a bound of their rows (there are at most as many days as
    returns, per seed; counted where the sizes are not given), else the joins are split
    by path.
    """
    sets = sets.select(*MC_KEYS).distinct()
    set_rows = sets.count() if set_rows is None else set_rows
    longest = sets.groupBy("seed").agg(F.max("num_paths").alias("n_paths"))
    days = (sets.select("as_of_date", "seed").distinct().join(scaled.select("as_of_date", "d").distinct(), "as_of_date")
            .select("seed", "d").distinct())                      # calendar days x seeds
    paths = (longest.select("seed", F.explode(F.sequence(F.lit(0), F.col("n_paths") - 1)).alias("scenario_id"))
             .repartition(num_partitions, "seed", "scenario_id"))
    day_rows = None if returns_rows is None else returns_rows * set_rows
    if not may_broadcast(days, day_rows):
        day_rows = days.count()
    drawn = factor_join(paths, days, ["seed"], F.col("scenario_id"), day_rows).withColumn("w", hashed_normal("seed", "scenario_id", "d"))
    return (factor_join(drawn, sets, ["seed"], F.col("scenario_id"), set_rows).filter(F.col("scenario_id") < F.col("num_paths"))
            .select(*MC_KEYS, "scenario_id", "d", "w"))


def mc_shocks(scaled: DataFrame, sets: DataFrame,
              periods_per_year: float = schemas.DEFAULT_PERIODS_PER_YEAR,
              num_partitions: int | None = None, returns_rows: int | None = None, set_rows: int | None = None) -> DataFrame:
    """(as_of_date, num_paths, seed, steps, dt, scenario_id, ticker, r).

    Correlated Gaussian path totals without a matrix factorisation. With the
    scaled centred returns z[i, d] (calibration.scaled_returns) and independent
    normals w[path, d]::

        r[path, i] = sqrt(periods * steps * dt) * sum_d w[path, d] * z[i, d]

    has covariance ``steps * dt * Sigma`` with ``Sigma`` the annualised sample
    covariance - the distribution of a zero-drift path of ``steps`` correlated
    increments of variance ``Sigma * dt``. The sum over ``d`` is an equi-join
    of the normals with the return matrix on (as_of_date, d) followed by an
    aggregate: a relational matrix product. ``returns_rows`` (exact size of
    the return matrix) selects broadcast or salted join (plans.joins).
    """
    spark = scaled.sparkSession
    if num_partitions is None:
        num_partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    z = scaled.select("as_of_date", "d", "ticker", "z")
    normals = path_normals(sets, z, num_partitions, returns_rows, set_rows)
    scale = F.sqrt(F.lit(float(periods_per_year)) * F.col("steps") * F.col("dt"))
    joined = factor_join(normals, z, ["as_of_date", "d"], F.col("scenario_id"), returns_rows)
    return (joined.groupBy(*MC_KEYS, "scenario_id", "ticker")
            .agg(F.sum(F.col("w") * F.col("z")).alias("wz"))
            .select(*MC_KEYS, "scenario_id", "ticker", (scale * F.col("wz")).alias("r")))


def scenario_pnl(shocks: DataFrame, exposures: DataFrame, set_keys: list[str],
                 exposure_rows: int | None = None, shock_rows: int | None = None) -> DataFrame:
    """(set keys..., portfolio_id, scenario_id, pnl): full repricing of every
    portfolio under every scenario of its set.

    Shocks join the per-(portfolio, factor) exposures on (as_of_date, ticker);
    a factor without a shock contributes nothing (its P&L is 0), as does a
    position on a factor that is not in the set. ``exposure_rows`` and
    ``shock_rows`` (exact sizes) select broadcast or salted join (plans.joins).
    """
    exp = exposures.select("as_of_date", "ticker", "portfolio_id", "lin_exposure", "quad_exposure")
    # Small exposures: broadcast them and keep the shocks' partitioning. Small
    # shocks but many books: broadcast the shocks and cluster the exposures by
    # book, so the P&L sum and the ranking window need no further shuffle.
    joined = factor_join(shocks, exp, ["as_of_date", "ticker"], F.col("scenario_id"), exposure_rows,
                         shock_rows, F.hash("portfolio_id"), right_cluster=["as_of_date", "portfolio_id"])
    return (joined.groupBy(*set_keys, "portfolio_id", "scenario_id")
            .agg(F.sum(exposure_pnl(log_return="r")).alias("pnl")))


def position_scenario_pnl(shocks: DataFrame, enriched: DataFrame, set_keys: list[str],
                          pricer: str = "auto", position_rows: int | None = None) -> DataFrame:
    """(set keys..., portfolio_id, scenario_id, pnl) priced position by position
    with a named pricer (functions.pricing.PRICERS). ``position_rows`` (exact
    size of ``enriched``) selects broadcast or salted join (plans.joins)."""
    from ..functions.pricing import PRICERS
    fn = PRICERS[pricer]
    pos = enriched.select("as_of_date", "ticker", "portfolio_id", "quantity", "delta", "gamma", "spot_price")
    return (factor_join(shocks, pos, ["as_of_date", "ticker"], F.col("scenario_id"), position_rows)
            .groupBy(*set_keys, "portfolio_id", "scenario_id")
            .agg(F.sum(fn("quantity", "delta", "gamma", "spot_price", "r")).alias("pnl")))


# ---------------------------------------------------------------------------
# Scenario P&L as block matrix products
# ---------------------------------------------------------------------------
#
# Repricing is a matrix product: P&L[s, b] = sum_i M[s, i] * lin[i, b]
# + M[s, i]^2 * quad[i, b] with M = exp(r) - 1. Spark distributes the blocks:
# scenarios are bucketed by id and books by hash, each side is copied into the
# buckets of the other (as in a salted join), and every (as-of date, scenario
# bucket, book bucket) group is one cogroup call that multiplies its two small
# dense blocks with numpy. Rows are only the inputs and the outputs; the
# shuffle, the ranking and the statistics stay in Spark.

def _pnl_block(set_keys: list[str]):
    import numpy as np
    import pandas as pd

    out_cols = [*set_keys, "portfolio_id", "scenario_id", "pnl"]

    def empty(shocks: pd.DataFrame) -> pd.DataFrame:
        out = shocks[set_keys].iloc[0:0].copy()
        out["portfolio_id"] = pd.Series([], dtype=object)
        out["scenario_id"] = pd.Series([], dtype="int32")
        out["pnl"] = pd.Series([], dtype=float)
        return out[out_cols]

    def kernel(shocks: pd.DataFrame, books: pd.DataFrame) -> pd.DataFrame:
        if shocks.empty or books.empty:
            return empty(shocks)
        tickers = pd.Index(pd.unique(shocks["ticker"]))
        books = books[books["ticker"].isin(tickers)]
        if books.empty:
            return empty(shocks)
        scen = shocks[[*set_keys, "scenario_id"]].drop_duplicates().reset_index(drop=True)
        s_idx = pd.MultiIndex.from_frame(scen)
        rows = s_idx.get_indexer(pd.MultiIndex.from_frame(shocks[[*set_keys, "scenario_id"]]))
        cols = tickers.get_indexer(shocks["ticker"])
        m = np.zeros((len(scen), len(tickers)))
        r = shocks["r"].to_numpy(dtype=float)
        m[rows, cols] = np.exp(r) - 1.0
        m = np.nan_to_num(m, nan=0.0)           # a NULL shock is no shock, as in the relational sum
        ids = pd.Index(pd.unique(books["portfolio_id"]))
        bcols = ids.get_indexer(books["portfolio_id"])
        brows = tickers.get_indexer(books["ticker"])
        lin = np.zeros((len(tickers), len(ids)))
        quad = np.zeros((len(tickers), len(ids)))
        np.add.at(lin, (brows, bcols), books["lin_exposure"].to_numpy(dtype=float))
        np.add.at(quad, (brows, bcols), books["quad_exposure"].to_numpy(dtype=float))
        pnl = m @ lin + (m * m) @ quad
        out = scen.loc[np.repeat(np.arange(len(scen)), len(ids))].reset_index(drop=True)
        out["portfolio_id"] = np.tile(ids.to_numpy(), len(scen))
        out["pnl"] = pnl.reshape(-1)
        return out[out_cols]

    return kernel


def scenario_pnl_blocks(shocks: DataFrame, exposures: DataFrame, set_keys: list[str],
                        scenario_buckets: int, book_buckets: int) -> DataFrame:
    """Same rows as ``scenario_pnl`` (NaN P&L read back as NULL), computed as
    block matrix products over ``scenario_buckets`` x ``book_buckets`` groups
    per as-of date."""
    import pyspark.sql.types as T

    sh = (shocks.select(*set_keys, "scenario_id", "ticker", "r")
          .withColumn("sb", F.pmod(F.col("scenario_id"), F.lit(scenario_buckets)))
          .withColumn("bb", F.explode(F.sequence(F.lit(0), F.lit(book_buckets - 1)))))
    ex = (exposures.select("as_of_date", "portfolio_id", "ticker", "lin_exposure", "quad_exposure")
          .withColumn("bb", F.pmod(F.hash("portfolio_id"), F.lit(book_buckets)))
          .withColumn("sb", F.explode(F.sequence(F.lit(0), F.lit(scenario_buckets - 1)))))
    key_fields = [f for f in shocks.schema.fields if f.name in set_keys]
    schema = T.StructType([*sorted(key_fields, key=lambda f: set_keys.index(f.name)),
                           T.StructField("portfolio_id", T.StringType()),
                           T.StructField("scenario_id", T.IntegerType()),
                           T.StructField("pnl", T.DoubleType())])
    # Fresh attribute ids: both sides descend from the same as-of price table.
    sh = sh.select(*[F.col(c).alias(c) for c in sh.columns])
    ex = ex.select(*[F.col(c).alias(c) for c in ex.columns])
    out = (sh.groupBy("as_of_date", "sb", "bb")
           .cogroup(ex.groupBy("as_of_date", "sb", "bb"))
           .applyInPandas(_pnl_block(set_keys), schema))
    return out.withColumn("pnl", F.when(F.isnan("pnl"), F.lit(None).cast("double")).otherwise(F.col("pnl")))


def block_rows(spark) -> int:
    """Rows a block may take in (``riskspark.pricing.blockRows``)."""
    return int(spark.conf.get("riskspark.pricing.blockRows", "200000"))


def date_groups(spark, n_dates: int, rows: int) -> int:
    """Least groups of an as-of date: the shuffle partitions spread over the dates, more where the dates'
    ``rows`` come to more than ``block_rows`` a group."""
    parts, n_dates = int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, n_dates)
    return max(-(-parts // n_dates), -(-rows // (n_dates * block_rows(spark))))


def block_grid(scenarios: int, books: int, parts: int, cells: int) -> tuple[int, int]:
    """(scenario buckets, book buckets): at least ``parts`` groups of at most ``cells`` output cells.

    The side with more members is split first; a side is never split into more
    buckets than it has members.
    """
    groups = max(parts, -(-scenarios * books // cells))
    many, few = max(scenarios, books, 1), max(1, min(scenarios, books))
    a = min(groups, many)
    b = min(-(-groups // a), few)
    return (a, b) if scenarios >= books else (b, a)


def price_scenarios(shocks: DataFrame, exposures: DataFrame, set_keys: list[str],
                    exposure_rows: int | None, shock_rows: int | None, factor_keys: int | None = None,
                    n_scenarios: int | None = None, n_books: int | None = None, n_dates: int = 1) -> DataFrame:
    """Scenario P&L with the cheaper of the two kernels; both give the same rows.

    ``riskspark.pricing.kernel``: ``relational`` (join + aggregate, whole-stage
    codegen; best for small products), ``blocks`` (block matrix products) or
    ``auto`` (default): blocks once the join would emit more than
    ``riskspark.pricing.blockMinPairs`` (default 20 000 000) rows, estimated
    from the exact input sizes. Bucket counts keep each group within
    ``riskspark.pricing.blockCells`` (default 4 000 000) scenarios x books; the
    groups of all ``n_dates`` as-of dates together follow the shuffle partitions.
    """
    spark = shocks.sparkSession
    kernel = spark.conf.get("riskspark.pricing.kernel", "auto")
    known = None not in (exposure_rows, shock_rows, n_scenarios, n_books)
    if kernel == "relational" or not known:
        return scenario_pnl(shocks, exposures, set_keys, exposure_rows, shock_rows)
    pairs = shock_rows * exposure_rows / max(1, factor_keys or 1)
    if kernel == "auto" and pairs < float(spark.conf.get("riskspark.pricing.blockMinPairs", "20000000")):
        return scenario_pnl(shocks, exposures, set_keys, exposure_rows, shock_rows)
    cells = int(spark.conf.get("riskspark.pricing.blockCells", "4000000"))
    parts = date_groups(spark, n_dates, max(shock_rows, exposure_rows))
    return scenario_pnl_blocks(shocks, exposures, set_keys, *block_grid(n_scenarios, n_books, parts, cells))


def _shock_block(periods_per_year: float):
    import numpy as np
    import pandas as pd

    out_cols = [*MC_KEYS, "scenario_id", "ticker", "r"]

    def kernel(normals: pd.DataFrame, z: pd.DataFrame) -> pd.DataFrame:
        if normals.empty or z.empty:
            out = normals[MC_KEYS].iloc[0:0].copy()
            out["scenario_id"] = pd.Series([], dtype="int32")
            out["ticker"] = pd.Series([], dtype=object)
            out["r"] = pd.Series([], dtype=float)
            return out[out_cols]
        tickers, days = pd.Index(pd.unique(z["ticker"])), np.unique(z["d"].to_numpy())
        zm = np.zeros((len(days), len(tickers)))
        zm[np.searchsorted(days, z["d"].to_numpy()), tickers.get_indexer(z["ticker"])] = z["z"].to_numpy(dtype=float)
        normals = normals[normals["d"].isin(days)]
        paths = normals[[*MC_KEYS, "scenario_id"]].drop_duplicates().reset_index(drop=True)
        p_idx = pd.MultiIndex.from_frame(paths).get_indexer(
            pd.MultiIndex.from_frame(normals[[*MC_KEYS, "scenario_id"]]))
        w = np.zeros((len(paths), len(days)))
        w[p_idx, np.searchsorted(days, normals["d"].to_numpy())] = normals["w"].to_numpy(dtype=float)
        scale = np.sqrt(periods_per_year * paths["steps"].to_numpy(dtype=float) * paths["dt"].to_numpy(dtype=float))
        shocks = (w @ zm) * scale[:, None]
        out = paths.loc[np.repeat(np.arange(len(paths)), len(tickers))].reset_index(drop=True)
        out["ticker"] = np.tile(tickers.to_numpy(), len(paths))
        out["r"] = shocks.reshape(-1)
        return out[out_cols]

    return kernel


def _path_buckets(sets: DataFrame, z: DataFrame, parts: int) -> int:
    """Path buckets of every as-of date: about ``parts`` groups over all dates, more only where a group
    would hold more than ``block_rows`` normals or shocks.

    Every bucket takes a copy of its date's returns, so ``parts`` buckets a date would make
    groups and copies grow with dates times shuffle partitions.
    """
    width = z.groupBy("as_of_date").agg(F.greatest(F.countDistinct("d"), F.countDistinct("ticker")).alias("width"))
    paths = sets.select(*MC_KEYS).distinct().groupBy("as_of_date").agg(F.sum(F.col("num_paths").cast("long")).alias("paths"))
    dates, most, cells = (int(x or 0) for x in paths.join(width, "as_of_date").agg(
        F.count(F.lit(1)), F.max("paths"), F.max(F.col("paths") * F.col("width"))).first())
    return max(1, min(most, max(-(-parts // max(1, dates)), -(-cells // block_rows(z.sparkSession)))))


def mc_shocks_blocks(scaled: DataFrame, sets: DataFrame,
                     periods_per_year: float = schemas.DEFAULT_PERIODS_PER_YEAR,
                     num_partitions: int | None = None, path_buckets: int | None = None, returns_rows: int | None = None,
                     set_rows: int | None = None) -> DataFrame:
    """Same rows as ``mc_shocks``: the normals are drawn by Spark exactly as
    there, and the sum over dates is a block matrix product per (as-of date, path
    bucket) with the return matrix copied into each bucket. ``path_buckets`` (by
    default ``_path_buckets``) are those of one as-of date."""
    import pyspark.sql.types as T

    spark = scaled.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    z = scaled.select("as_of_date", "d", "ticker", "z")
    pb = path_buckets or _path_buckets(sets, z, n)
    normals = (path_normals(sets, z, n, returns_rows, set_rows)
               .withColumn("pb", F.pmod(F.col("scenario_id"), F.lit(pb))))
    zs = z.withColumn("pb", F.explode(F.sequence(F.lit(0), F.lit(pb - 1))))
    normals = normals.select(*[F.col(c).alias(c) for c in normals.columns])
    zs = zs.select(*[F.col(c).alias(c) for c in zs.columns])
    key_fields = {f.name: f for f in normals.schema.fields}
    schema = T.StructType([*[key_fields[k] for k in MC_KEYS],
                           T.StructField("scenario_id", T.IntegerType()),
                           T.StructField("ticker", T.StringType()),
                           T.StructField("r", T.DoubleType())])
    return (normals.groupBy("as_of_date", "pb").cogroup(zs.groupBy("as_of_date", "pb"))
            .applyInPandas(_shock_block(float(periods_per_year)), schema))


def _distribution_block(set_keys: list[str]):
    import numpy as np
    import pandas as pd

    inner = _pnl_block(set_keys)
    out_cols = [*set_keys, "portfolio_id", "n", "mean_pnl", "std_dev_pnl", "sorted_pnl", "cum_pnl"]

    def kernel(shocks: pd.DataFrame, books: pd.DataFrame) -> pd.DataFrame:
        pnl = inner(shocks, books)
        rows = []
        for key, g in pnl.groupby([*set_keys, "portfolio_id"], sort=False):
            v = g["pnl"].to_numpy(dtype=float)
            order = np.lexsort((g["scenario_id"].to_numpy(), v))
            srt = v[order]
            n = len(v)
            std = float(np.std(v, ddof=1)) if n > 1 else None
            rows.append((*key, n, float(np.mean(v)), std, srt.tolist(), np.cumsum(srt).tolist()))
        if not rows:
            out = pnl[[*set_keys, "portfolio_id"]].iloc[0:0].copy()
            for c, dt in (("n", "int64"), ("mean_pnl", float), ("std_dev_pnl", float),
                          ("sorted_pnl", object), ("cum_pnl", object)):
                out[c] = pd.Series([], dtype=dt)
            return out[out_cols]
        return pd.DataFrame(rows, columns=out_cols)

    return kernel


def scenario_distribution_blocks(shocks: DataFrame, exposures: DataFrame, set_keys: list[str],
                                 book_buckets: int) -> DataFrame:
    """(set keys..., portfolio_id, n, mean_pnl, std_dev_pnl, sorted_pnl ARRAY,
    cum_pnl ARRAY): the whole scenario distribution of every book, computed in
    the block kernel when one block holds all scenarios of its books (the
    shocks of an as-of date are copied into every book bucket). Sorted with ties
    by scenario id, exactly like ``risk.rank_scenarios``."""
    import pyspark.sql.types as T

    sh = (shocks.select(*set_keys, "scenario_id", "ticker", "r")
          .withColumn("bb", F.explode(F.sequence(F.lit(0), F.lit(book_buckets - 1)))))
    ex = (exposures.select("as_of_date", "portfolio_id", "ticker", "lin_exposure", "quad_exposure")
          .withColumn("bb", F.pmod(F.hash("portfolio_id"), F.lit(book_buckets))))
    sh = sh.select(*[F.col(c).alias(c) for c in sh.columns])
    ex = ex.select(*[F.col(c).alias(c) for c in ex.columns])
    key_fields = [f for f in shocks.schema.fields if f.name in set_keys]
    dbl = T.ArrayType(T.DoubleType())
    schema = T.StructType([*sorted(key_fields, key=lambda f: set_keys.index(f.name)),
                           T.StructField("portfolio_id", T.StringType()),
                           T.StructField("n", T.LongType()),
                           T.StructField("mean_pnl", T.DoubleType()),
                           T.StructField("std_dev_pnl", T.DoubleType()),
                           T.StructField("sorted_pnl", dbl),
                           T.StructField("cum_pnl", dbl)])
    return (sh.groupBy("as_of_date", "bb").cogroup(ex.groupBy("as_of_date", "bb"))
            .applyInPandas(_distribution_block(set_keys), schema))
