"""Named queries over the warehouse tables, one per operator of the engine.

Every query reads the given tables (``sf_dir``) and derives its inputs from
them (price panels, books, as-of calendars, request grids), so its work grows
with the data. Outputs are rounded (money 2 dp, rates 8 dp) so that an
independent SQL evaluation compares equal despite summation order.

Parameters of the workload (fixed for every query):
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.normal import norm_ppf
from ..functions.rounding import round_half_away
from ..operators import calibration as cal_ops
from ..operators import enrich as enrich_ops
from ..operators import risk, scenarios
from ..operators.factorisation import covariance_from_loadings as covariance_of
from ..operators.factorisation import factor_loadings
from ..operators.validation import validate_requests
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources import tables
from ..sources.requests import request_grid
from . import store
from .pipeline import run_scenarios

# Workload parameters.
PERIODS = 12                 # monthly panels
ALPHAS = (0.95, 0.99)
HIST_WINDOW = 60
HIST_WINDOWS = (60, 100)
MC_PATHS = 1000
SEED = 42
TICK_AS_OF = "2024-01-20"
RUN_TS = "2024-01-01 00:00:00"
RERUN_TS = "2024-01-02 00:00:00"
THIRD_TS = "2024-01-03 00:00:00"
KNOWN_AT = "2024-01-02 12:00:00"
LOOKUP_BOOK = "BUILDING"
LOOKUP_FROM, LOOKUP_TO, LOOKUP_METHOD = "1994-01-01", "1997-12-31", "historical"
DEFAULT_BOOK = "nation"

MONEY, RATE = 2, 8


def _r(c, d):
    return round_half_away(c, d).alias(c)


def _round_results(df: DataFrame) -> DataFrame:
    return df.select("correlation_id", "portfolio_id", "as_of_date", "method",
                     _r("var_amount", MONEY), _r("expected_shortfall", MONEY), "alpha",
                     _r("mean_pnl", MONEY), _r("std_dev_pnl", MONEY), "num_scenarios")


class Book:
    """Inputs of one query: a checkpointed price panel, a book and an as-of calendar."""

    def __init__(self, spark: SparkSession, sf: str, ticker_by: str = "brand", period: str = "month",
                 portfolio_by: str = "segment", options: bool = False, calendar: str = "all"):
        self.spark, self.sf = spark, sf
        self.prices = cut_lineage(tables.price_panel(spark, sf, ticker_by, period))
        self.periods = tables.PERIODS_PER_YEAR[period]
        self.positions = tables.position_book(spark, sf, portfolio_by, ticker_by, options)
        if calendar == "year_end":
            self.asof = tables.year_end_dates(self.prices)
        elif calendar == "last":
            self.asof = tables.last_date(self.prices)
        else:
            self.asof = tables.all_dates(self.prices)
        self._cal = None
        self._spot = None

    @property
    def cal(self) -> cal_ops.Calibration:
        if self._cal is None:
            self._cal = cal_ops.calibrate(self.prices, self.asof, self.periods)
        return self._cal

    def enriched(self) -> DataFrame:
        """Positions with their spot; the spot table is written and counted once
        so the join can broadcast it behind an exact size check."""
        if self._spot is None:
            spot = cut_lineage(self.cal.index)
            self._spot = (spot, spot.count())
        spot, rows = self._spot
        return enrich_ops.enrich_positions(self.positions, spot, rows)

    def exposures(self) -> DataFrame:
        return enrich_ops.exposures(self.enriched())

    def dollar_delta(self) -> DataFrame:
        return enrich_ops.dollar_delta(self.enriched())

    def requests(self, methods=schemas.METHODS) -> DataFrame:
        return request_grid(self.asof, methods=methods, alphas=ALPHAS, num_paths=MC_PATHS,
                            historical_window=HIST_WINDOW, seed=SEED)

    def results(self, methods=schemas.METHODS, requests: DataFrame | None = None) -> DataFrame:
        """Results of one run, written once; nothing stays cached."""
        run = run_scenarios(self.requests(methods) if requests is None else requests, self.positions, self.prices,
                            self.periods, methods=methods, durable_prices=False)
        try:
            return cut_lineage(run.results)
        finally:
            run.release()


def _sized(df: DataFrame) -> tuple[DataFrame, int]:
    """A written copy with its exact row count."""
    df = cut_lineage(df)
    return df, df.count()


def _store_path(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}"


# --------------------------------------------------------------------- sources

def prices_panel(spark, sf):
    p = tables.price_panel(spark, sf, "brand", "month")
    return p.select("ticker", "date", "close")


def positions_panel(spark, sf):
    p = tables.position_book(spark, sf, "segment", "brand", options=True)
    return p.select("portfolio_id", "ticker", _r("quantity", 6), "asset_class", "delta", "gamma", "maturity_in_years")


def positions_csv(spark, sf):
    """The option book as position files in three column orders (one without the optional columns),
    read back by their headers."""
    from ..sources.csv import read_position_csv
    pos = cut_lineage(tables.position_book(spark, sf, "segment", "brand", options=True).withColumn(
        "k", F.when((F.col("delta") == 1) & (F.col("gamma") == 0), 2).otherwise(F.pmod(F.hash("ticker"), F.lit(2)))))
    path = _store_path(spark)
    names = {"portfolio_id": "portfolioId", "ticker": "ticker", "quantity": "quantity", "asset_class": "assetClass", "delta": "delta",
             "gamma": "gamma", "maturity_in_years": "maturityInYears"}
    orders = (list(names), ["gamma", "ticker", "asset_class", "delta", "portfolio_id", "quantity"], ["quantity", "asset_class", "portfolio_id", "ticker"])
    for k, order in enumerate(orders):
        pos.filter(F.col("k") == k).select(*[F.col(c).alias(names[c]) for c in order]).write.option("header", True).csv(f"{path}/{k}")
    back = read_position_csv(spark, [f"{path}/{k}" for k in range(len(orders))])
    return back.select("portfolio_id", "ticker", _r("quantity", 6), "asset_class", "delta", "gamma", "maturity_in_years")


def price_rejects(spark, sf):
    usable, faulty = tables.split_labelled(tables.label_prices(tables.tick_prices(spark, sf), date="ts", ts="ts"))
    out = tables.price_rejects(usable, faulty)
    return out.select("ticker", "date", round_half_away(F.col("value").cast("double"), 6).alias("value"), "reason")


def price_quality(spark, sf):
    return tables.price_quality(tables.tick_prices(spark, sf), date="ts")


def prices_clean(spark, sf):
    px = tables.clean_prices(tables.tick_prices(spark, sf), as_of=TICK_AS_OF, date="ts", ts="ts")
    return px.select("ticker", "date", _r("close", 6))


def ticker_from_path(spark, sf):
    from ..sources.csv import ticker_from_path as tfp
    pages = tables.read_table(spark, sf, "pages")
    return pages.select("page_id", tfp("url").alias("ticker"))


def portfolio_lookup(spark, sf):
    pos = tables.position_book(spark, sf, "segment", "brand")
    return store.portfolio_lookup(pos, LOOKUP_BOOK).select("portfolio_id", "ticker", _r("quantity", 6))


# ----------------------------------------------------------------- calibration

def log_returns(spark, sf):
    b = Book(spark, sf)
    return b.cal.returns.select("as_of_date", "ticker", "t", "date", _r("r", RATE))


def annualised_vol(spark, sf):
    b = Book(spark, sf)
    return b.cal.vols.select("as_of_date", "ticker", _r("vol", RATE), "n_obs")


def correlation_matrix(spark, sf):
    b = Book(spark, sf)
    return b.cal.corr.select("as_of_date", "ti", "tj", _r("rho", RATE))


def covariance_matrix(spark, sf):
    b = Book(spark, sf)
    return b.cal.cov.select("as_of_date", "ti", "tj", _r("sigma", RATE))


def covariance_from_corr(spark, sf):
    """Stored-snapshot rebuild from the stored correlations and volatilities."""
    b = Book(spark, sf)
    corr, vols = store.read_snapshot(spark, store.write_snapshot(b.cal, _store_path(spark)))
    return cal_ops.covariance_from_corr(corr, vols).select("as_of_date", "ti", "tj", _r("sigma", RATE))


def covariance_from_loadings(spark, sf):
    """A stored covariance factored without its returns, and multiplied out again."""
    b = Book(spark, sf)
    path = f"{_store_path(spark)}/cov"
    b.cal.cov.write.parquet(path)
    loadings = factor_loadings(spark.read.parquet(path))
    return covariance_of(loadings).select("as_of_date", "ti", "tj", _r("sigma", 6))


def short_history_factors(spark, sf):
    b = Book(spark, sf, period="week", calendar="all")
    return b.cal.short_history.select("as_of_date", "ticker", "n_prices", "reason")


def history_quality(spark, sf):
    b = Book(spark, sf)
    windows = b.asof.withColumn("historical_window", F.explode(F.array(*[F.lit(w) for w in HIST_WINDOWS])))
    return cal_ops.history_quality(b.cal.index, windows)


def calibration_rows(spark, sf):
    b = Book(spark, sf)
    path = _store_path(spark)
    for _ in range(2):                    # the replay must add nothing
        store.append_calibration(b.cal.vols, path, RUN_TS, run_id="monthly")
    rows = store.read_calibrations(spark, path)
    return rows.select("as_of_date", "ticker", _r("volatility", RATE), "ts")


def _calibration_store(spark, sf) -> DataFrame:
    """Three runs: monthly, weekly, monthly again (its values come back), each sent twice."""
    monthly = Book(spark, sf)
    weekly_prices = cut_lineage(tables.price_panel(spark, sf, "brand", "week"))
    weekly = cal_ops.calibrate(weekly_prices, monthly.asof, tables.PERIODS_PER_YEAR["week"])
    path, vols = _store_path(spark), cut_lineage(monthly.cal.vols)
    for run, (rows, ts) in enumerate(((vols, RUN_TS), (weekly.vols, RERUN_TS), (vols, THIRD_TS))):
        for _ in range(2):
            store.append_calibration(rows, path, ts, run_id=f"run-{run}")
    return store.read_calibrations(spark, path)


def latest_calibration(spark, sf):
    return store.latest_calibration(_calibration_store(spark, sf)).select("as_of_date", "ticker", _r("volatility", RATE))


def calibration_known_at(spark, sf):
    """What a lookup between the second and the third run found."""
    return store.latest_calibration(_calibration_store(spark, sf), known_at=KNOWN_AT).select("as_of_date", "ticker", _r("volatility", RATE))


def calibration_versions(spark, sf):
    return store.calibration_versions(_calibration_store(spark, sf)).select(
        "as_of_date", "ticker", _r("volatility", RATE), "valid_from", "valid_to")


# ------------------------------------------------------------------ enrichment

def latest_spot(spark, sf):
    b = Book(spark, sf)
    return b.cal.index.select("as_of_date", "ticker", "spot_price", "spot_date")


def latest_spot_window(spark, sf):
    b = Book(spark, sf)
    return enrich_ops.latest_spot_window(b.prices, b.cal.asofs).select(
        "as_of_date", "ticker", "spot_price", "spot_date")


def enrich_positions(spark, sf):
    b = Book(spark, sf, portfolio_by="nation")
    return b.enriched().select(
        "as_of_date", "portfolio_id", "ticker", "quantity", "spot_price")


def unmatched_positions(spark, sf):
    b = Book(spark, sf, period="day", calendar="all")
    return enrich_ops.unmatched_positions(b.positions, b.prices, b.asof).select(
        "as_of_date", "portfolio_id", "ticker", _r("quantity", 6))


def portfolio_value(spark, sf):
    b = Book(spark, sf)
    return enrich_ops.portfolio_value(b.enriched()).select(
        "as_of_date", "portfolio_id", _r("total_value", MONEY))


def dollar_delta(spark, sf):
    b = Book(spark, sf)
    return b.dollar_delta().select("as_of_date", "portfolio_id", "ticker", _r("dollar_delta", MONEY))


# ------------------------------------------------------------------ parametric

def norm_ppf_query(spark, sf):
    li = tables.read_table(spark, sf, "lineitem").select("l_discount").distinct()
    p = F.lit(0.5) + F.col("l_discount") * F.lit(4.999)
    low = F.lit(1.0) - p
    return li.select("l_discount", round_half_away(norm_ppf(p), 10).alias("z"), round_half_away(norm_ppf(low), 10).alias("z_low"))


def _variance(b: Book, projected: bool) -> DataFrame:
    dd, rows = _sized(b.dollar_delta())
    if projected:
        scaled, n = _sized(b.cal.scaled)
        v = risk.portfolio_variance_projected(dd, scaled, b.periods, n, rows)
    else:
        v = risk.portfolio_variance(dd, *_sized(b.cal.cov), rows)
    return v.select("as_of_date", "portfolio_id", round_half_away(F.sqrt("variance"), MONEY).alias("sigma_p"))


def portfolio_variance(spark, sf):
    return _variance(Book(spark, sf), projected=False)


def portfolio_variance_projected(spark, sf):
    return _variance(Book(spark, sf), projected=True)


def parametric_var(spark, sf):
    return _round_results(Book(spark, sf).results(["PARAMETRIC"]))


# ------------------------------------------------------------------ historical

def _hist_sets(b: Book, windows=(HIST_WINDOW,)) -> DataFrame:
    return b.asof.withColumn("historical_window", F.explode(F.array(*[F.lit(w) for w in windows])))


def _replay(b: Book, sets: DataFrame) -> DataFrame:
    own, rows = _sized(b.cal.own)
    return scenarios.historical_shocks_indexed(b.cal.index, own, sets, rows)


def historical_shocks(spark, sf):
    b = Book(spark, sf)
    sh = _replay(b, _hist_sets(b, HIST_WINDOWS))
    return sh.select(*scenarios.HIST_KEYS, "scenario_id", "ticker", _r("r", RATE))


def _keyed(exposures: DataFrame) -> tuple:
    """Arguments of scenario_pnl: exposures, set keys and the exact size."""
    exp, rows = _sized(exposures)
    return exp, scenarios.HIST_KEYS, rows


def _hist_pnl(b: Book, pricer: str | None) -> DataFrame:
    sh = _replay(b, _hist_sets(b))
    if pricer is None:
        pnl = scenarios.scenario_pnl(sh, *_keyed(b.exposures()))
    else:
        enriched, rows = _sized(b.enriched())
        pnl = scenarios.position_scenario_pnl(sh, enriched, scenarios.HIST_KEYS, pricer, rows)
    return pnl.select("as_of_date", "portfolio_id", "scenario_id", _r("pnl", MONEY))


def scenario_pnl(spark, sf):
    return _hist_pnl(Book(spark, sf, options=True), None)


def pnl_linear(spark, sf):
    return _hist_pnl(Book(spark, sf), "linear")


def pnl_delta_gamma(spark, sf):
    return _hist_pnl(Book(spark, sf, options=True), "delta_gamma")


def historical_var(spark, sf):
    return _round_results(Book(spark, sf).results(["HISTORICAL"]))


def tail_scenarios(spark, sf):
    b = Book(spark, sf)
    req = b.requests(["HISTORICAL"])
    sh = _replay(b, req.select(*scenarios.HIST_KEYS).distinct())
    pnl = scenarios.scenario_pnl(sh, *_keyed(b.exposures()))
    # Replayed scenarios may tie; which of them holds a rank is not part of the result.
    return risk.tail_scenarios(req, pnl, scenarios.HIST_KEYS, req.count()).select(
        "correlation_id", "portfolio_id", F.col("rank").cast("int").alias("rank"), _r("pnl", MONEY))


# ----------------------------------------------------------------- Monte Carlo

def mc_shocks(spark, sf):
    b = Book(spark, sf)
    steps, dt = schemas.TIME_GRIDS[schemas.DEFAULT_TIME_GRID]
    sets = b.asof.select("as_of_date", F.lit(MC_PATHS).alias("num_paths"), F.lit(SEED).cast("long").alias("seed"),
                         F.lit(steps).alias("steps"), F.lit(dt).alias("dt"))
    sh = scenarios.mc_shocks(b.cal.scaled, cut_lineage(sets), b.periods)
    return sh.select("as_of_date", "scenario_id", "ticker", _r("r", RATE))


def worst_paths(spark, sf):
    """The Monte Carlo paths behind each VaR/ES figure, found without ranking the others."""
    b = Book(spark, sf)
    req, _ = validate_requests(b.requests(["MONTE_CARLO"]))
    req = cut_lineage(req)
    scaled, n = _sized(b.cal.scaled)
    exp, rows = _sized(b.exposures())
    shocks = scenarios.mc_shocks_blocks(scaled, req.select(*scenarios.MC_KEYS).distinct(), b.periods)
    pnl = cut_lineage(scenarios.scenario_pnl(shocks, exp, scenarios.MC_KEYS, rows))
    return risk.tail_scenarios(req, pnl, scenarios.MC_KEYS, req.count(), by_tail=True).select(
        "correlation_id", "portfolio_id", F.col("rank").cast("int").alias("rank"), _r("pnl", MONEY))


def monte_carlo_var(spark, sf):
    return _round_results(Book(spark, sf).results(["MONTE_CARLO"]))


def default_size_var(spark, sf):
    """Historical and Monte Carlo VaR at the request defaults (10 000 paths, window 500), newest date."""
    b = Book(spark, sf, portfolio_by=DEFAULT_BOOK, calendar="last")
    methods = ("HISTORICAL", "MONTE_CARLO")
    req = request_grid(b.asof, methods=methods, alphas=ALPHAS, num_paths=schemas.DEFAULT_NUM_PATHS,
                       historical_window=schemas.DEFAULT_HISTORICAL_WINDOW, seed=schemas.DEFAULT_SEED)
    return _round_results(b.results(methods, req))


def var_all_methods(spark, sf):
    return _round_results(Book(spark, sf).results())


# ---------------------------------------------------------- requests and store

def validate_requests_query(spark, sf):
    """Rejects of a request grid over all dates that mixes valid and
    invalid parameters (confidence, path count, time grid, method)."""
    b = Book(spark, sf)
    g = (b.asof.withColumn("varMethod", F.explode(F.array(*[F.lit(m) for m in (*schemas.METHODS, "DELTA")])))
         .withColumn("confidenceLevel", F.explode(F.array(*[F.lit(a) for a in (0.4, 0.95, 0.99, 1.0)])))
         .withColumn("numPaths", F.explode(F.array(F.lit(0), F.lit(1000))))
         .withColumn("timeGrid", F.explode(F.array(F.lit("GRID_53"), F.lit("GRID_X"), F.lit("GRID_7")))))
    g = g.select(F.concat_ws("|", "varMethod", F.col("as_of_date").cast("string"),
                             F.col("confidenceLevel").cast("string"), F.col("numPaths").cast("string"),
                             "timeGrid").alias("correlationId"),
                 F.date_format("as_of_date", "yyyy-MM-dd").alias("asOfDate"),
                 "varMethod", "confidenceLevel", F.col("numPaths").cast("long").alias("numPaths"), "timeGrid")
    from ..sources.requests import normalise_requests
    _, rejects = validate_requests(normalise_requests(g))
    return rejects.select("correlation_id", "error_code",
                          F.concat_ws(",", F.transform("violations", lambda v: v["field"])).alias("fields"))


def parse_requests_query(spark, sf):
    """JSON request bodies for every date x method x confidence
    (method in lower case, counts and grid left out), decoded back: upper-cased
    method, request defaults, given ids. For every date also a body that names
    only the date (derived id) and one that is not JSON (malformed)."""
    from ..sources.requests import parse_requests
    b = Book(spark, sf)
    g = (b.asof.withColumn("m", F.explode(F.array(*[F.lit(m.lower()) for m in schemas.METHODS])))
         .withColumn("a", F.explode(F.array(*[F.lit(a) for a in ALPHAS]))))
    body = F.to_json(F.struct(
        F.concat_ws("|", "m", F.col("as_of_date").cast("string"), F.col("a").cast("string")).alias("correlationId"),
        F.date_format("as_of_date", "yyyy-MM-dd").alias("asOfDate"),
        F.col("m").alias("varMethod"), F.col("a").alias("confidenceLevel")))
    day = F.date_format("as_of_date", "yyyy-MM-dd")
    bare = F.explode(F.array(F.to_json(F.struct(day.alias("asOfDate"))), F.concat(F.lit("not json "), day)))
    parsed = parse_requests(g.select(body.alias("value")).unionByName(b.asof.select(bare.alias("value"))), "value")
    return parsed.select("correlation_id", "as_of_date", "method", "alpha",
                         F.col("num_paths_raw").alias("num_paths"), F.col("window_raw").alias("historical_window"),
                         "time_grid", "seed", "malformed")


def _stored(spark, sf) -> DataFrame:
    """A store that two appends filled: 95 % requests first, 99 % requests later, each sent twice."""
    res, path = Book(spark, sf).results(), _store_path(spark)
    for alpha, ts in zip(ALPHAS, (RUN_TS, RERUN_TS)):
        for _ in range(2):
            store.append_results(res.filter(F.col("alpha") == alpha), path, ts)
    return store.read_results(spark, path)


def results_rows(spark, sf):
    r = _stored(spark, sf)
    return r.select("correlation_id", "portfolio_id", F.col("as_of_date").cast("string").alias("as_of_date"), "method",
                    _r("var_amount", MONEY), _r("expected_shortfall", MONEY), "alpha",
                    _r("mean_pnl", MONEY), _r("std_dev_pnl", MONEY), "num_scenarios", "ts", "result_date")


def query_results(spark, sf):
    q = store.query_results(_stored(spark, sf), LOOKUP_BOOK, LOOKUP_FROM, LOOKUP_TO, LOOKUP_METHOD)
    return q.select("correlation_id", "portfolio_id", "as_of_date", "method",
                    _r("var_amount", MONEY), _r("expected_shortfall", MONEY), "alpha",
                    _r("mean_pnl", MONEY), _r("std_dev_pnl", MONEY), "num_scenarios")


def results_json(spark, sf):
    """Published messages, decoded again and rounded (engines print doubles differently)."""
    fields = ("correlationId string, portfolioId string, asOfDate string, method string, varAmount double, "
              "expectedShortfall double, alpha double, meanPnL double, stdDevPnL double")
    m = store.results_json(Book(spark, sf).results()).select("key", F.from_json("value", fields).alias("v")).select("key", "v.*")
    return m.select("key", "correlationId", "portfolioId", "asOfDate", "method", _r("varAmount", MONEY),
                    _r("expectedShortfall", MONEY), "alpha", _r("meanPnL", MONEY), _r("stdDevPnL", MONEY))


QUERIES = {
    "prices_panel": prices_panel,
    "positions_panel": positions_panel,
    "positions_csv": positions_csv,
    "price_quality": price_quality,
    "price_rejects": price_rejects,
    "prices_clean": prices_clean,
    "ticker_from_path": ticker_from_path,
    "portfolio_lookup": portfolio_lookup,
    "log_returns": log_returns,
    "annualised_vol": annualised_vol,
    "correlation_matrix": correlation_matrix,
    "covariance_matrix": covariance_matrix,
    "covariance_from_corr": covariance_from_corr,
    "covariance_from_loadings": covariance_from_loadings,
    "short_history_factors": short_history_factors,
    "history_quality": history_quality,
    "calibration_rows": calibration_rows,
    "latest_calibration": latest_calibration,
    "calibration_known_at": calibration_known_at,
    "calibration_versions": calibration_versions,
    "latest_spot": latest_spot,
    "latest_spot_window": latest_spot_window,
    "enrich_positions": enrich_positions,
    "unmatched_positions": unmatched_positions,
    "portfolio_value": portfolio_value,
    "dollar_delta": dollar_delta,
    "norm_ppf": norm_ppf_query,
    "portfolio_variance": portfolio_variance,
    "portfolio_variance_projected": portfolio_variance_projected,
    "parametric_var": parametric_var,
    "historical_shocks": historical_shocks,
    "scenario_pnl": scenario_pnl,
    "pnl_linear": pnl_linear,
    "pnl_delta_gamma": pnl_delta_gamma,
    "historical_var": historical_var,
    "tail_scenarios": tail_scenarios,
    "mc_shocks": mc_shocks,
    "worst_paths": worst_paths,
    "monte_carlo_var": monte_carlo_var,
    "var_all_methods": var_all_methods,
    "default_size_var": default_size_var,
    "validate_requests": validate_requests_query,
    "parse_requests": parse_requests_query,
    "results_rows": results_rows,
    "query_results": query_results,
    "results_json": results_json,
}
