"""End-to-end scenario run: requests x books x prices -> VaR results.

``run_scenarios`` is the whole job as one lazy plan::

    requests --validate--> valid ----------------------------+--> rejects
                            | distinct as-of dates            |
    prices --+--> returns per ticker --exploded to as-of dates--> vols / corr / scaled returns
             +--> as-of index (spot, history length) --join positions--> exposures
    valid[PARAMETRIC] x projected variance          --+
    valid[HISTORICAL] x replayed shocks x exposures --+--> union --> results
    valid[MONTE_CARLO] x path shocks x exposures    --+

Any number of requests (as-of dates, methods, confidence levels, path counts)
run in the same job; calibration is shared per as-of date and scenario sets
per (as-of date, method parameters).
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import schemas
from ..operators import calibration as cal_ops
from ..operators import enrich as enrich_ops
from ..operators import risk, scenarios
from ..operators.factorisation import factor_loadings
from ..operators.validation import validate_requests
from ..session import cut_lineage
from .joins import max_broadcast_rows


log = logging.getLogger("riskspark")


@dataclass
class ScenarioRun:
    results: DataFrame
    rejects: DataFrame
    valid: DataFrame
    calibration: cal_ops.Calibration
    enriched: DataFrame
    exposures: DataFrame
    factor_rejects: DataFrame | None = None   # held factors that could not be calibrated, with reason and code
    cached: list = field(default_factory=list)
    # Exact sizes measured for the join decisions (the job's row counts; no extra job).
    sizes: dict = field(default_factory=dict)

    def release(self) -> None:
        """Drop the cached intermediate tables (after the results are written)."""
        for df in self.cached:
            df.unpersist()
        self.cached.clear()


@dataclass
class _Inputs:
    valid: DataFrame
    cal: cal_ops.Calibration
    exposures: DataFrame
    exposure_rows: int | None = None
    returns_rows: int | None = None
    request_rows: int | None = None
    factor_keys: int | None = None
    return_keys: int | None = None
    book_rows: int | None = None
    own_rows: int | None = None
    cached: list = field(default_factory=list)    # tables to release with the run
    scope: list = field(default_factory=list)     # ["source_set"] where requests name their own files
    loadings: bool = False                        # the scaled returns are loadings of an annual covariance

    @property
    def scaled_periods(self) -> float:
        return 1.0 if self.loadings else self.cal.periods_per_year
    dates: dict = field(default_factory=dict)     # method -> as-of dates of its requests
    book_pnl: object = None                       # see run_scenarios(pricer=...)
    horizon_years: float = 1.0


def _cache_counted(df: DataFrame, run_cache: list) -> tuple[DataFrame, int]:
    """Cache a table that several branches reuse; return it with its exact row count.

    Its lineage starts at a checkpoint, so a lost block is rebuilt from the
    checkpoint files, never from the fact-table scan.
    """
    df = cut_lineage(df, durable=False)
    run_cache.append(df)
    return df, df.count()


def _ranked_var(inp: "_Inputs", req: DataFrame, pnl: DataFrame, keys: list[str], method: str, n_scen) -> DataFrame:
    """VaR rows of a P&L table: sets of many scenarios by their tail, others by a ranking window.

    ``riskspark.ranking`` (``auto``, ``window``, ``tail``) chooses; ``auto`` takes the tail from
    ``riskspark.ranking.tailMinScenarios`` (default 100 000) scenarios a date on. Both give the same rows.
    """
    spark, pnl, keys = pnl.sparkSession, _scoped(inp, pnl), keys + inp.scope
    mode = spark.conf.get("riskspark.ranking", "auto")
    least = int(spark.conf.get("riskspark.ranking.tailMinScenarios", "100000"))
    if mode == "tail" or (mode == "auto" and (n_scen or 0) >= least):
        pnl = cut_lineage(pnl, durable=False)
        inp.cached.append(pnl)
        return risk.scenario_var_by_tail(req, pnl, keys, method, inp.request_rows)
    return risk.scenario_var(req, pnl, keys, method, inp.request_rows)


def _scoped(inp: "_Inputs", table: DataFrame) -> DataFrame:
    """``table`` with the source set of its portfolios, where the run has several."""
    return table.withColumn("source_set", schemas.scope_of("portfolio_id")) if inp.scope else table


def _for(df: DataFrame, inp: "_Inputs", method: str) -> DataFrame:
    """Rows of the as-of dates that the method's requests name (a calendar-bounded list)."""
    return df.filter(F.col("as_of_date").isin(inp.dates[method])) if method in inp.dates else df


def _n_dates(inp: "_Inputs", method: str) -> int:
    """As-of dates of the method's requests (1 where they were not listed)."""
    return max(1, len(inp.dates.get(method, ())))


def _scenario_sizes(sets: DataFrame, factors: DataFrame, per_set: F.Column) -> tuple[int, int]:
    """(shock rows, scenarios of the largest as-of date), from one small aggregate."""
    nf = factors.groupBy("as_of_date").agg(F.countDistinct("ticker").alias("nf"))
    per_date = sets.groupBy("as_of_date").agg(F.sum(per_set.cast("long")).alias("s")).join(nf, "as_of_date")
    row = per_date.agg(F.sum(F.col("s") * F.col("nf")), F.max("s")).first()
    return int(row[0] or 0), int(row[1] or 0)


def _use_blocks(spark, shock_rows, returns_rows, return_keys) -> bool:
    """Monte Carlo shocks as block products (scenarios.mc_shocks_blocks) when
    the relational product would emit many rows (paths x T x factors) and the
    return matrix is small enough to copy into every path bucket."""
    kernel = spark.conf.get("riskspark.pricing.kernel", "auto")
    if kernel == "relational" or None in (shock_rows, returns_rows, return_keys):
        return False
    if returns_rows > max_broadcast_rows(spark):
        return False
    if kernel == "blocks":
        return True
    pairs = shock_rows * returns_rows / max(1, return_keys)
    return pairs >= float(spark.conf.get("riskspark.pricing.blockMinPairs", "20000000"))


def _distribution_buckets(spark, shock_rows, exposure_rows, factor_keys, n_scenarios, n_books, n_dates=1) -> int:
    """Book buckets for whole-distribution blocks (0 = use the row path).

    Used when repricing goes to blocks (see scenarios.price_scenarios), the
    books outnumber the scenarios, and all shocks fit in one block copied to
    every bucket (shock rows <= ``riskspark.pricing.blockRows``). Buckets hold at
    most ``riskspark.pricing.blockCells`` scenarios x books; the shuffle partitions
    are spread over the as-of dates."""
    kernel = spark.conf.get("riskspark.pricing.kernel", "auto")
    if kernel == "relational" or None in (shock_rows, exposure_rows, factor_keys):
        return 0
    block = scenarios.block_rows(spark)
    pairs = shock_rows * exposure_rows / max(1, factor_keys)
    big = kernel == "blocks" or pairs >= float(spark.conf.get("riskspark.pricing.blockMinPairs", "20000000"))
    if not big or shock_rows > block or exposure_rows <= shock_rows:
        return 0
    parts = scenarios.date_groups(spark, n_dates, exposure_rows)
    cells = int(spark.conf.get("riskspark.pricing.blockCells", "4000000"))
    return max(parts, -(-(n_scenarios * n_books) // cells))


def parametric_results(inp: _Inputs) -> DataFrame:
    valid, cal = inp.valid, inp.cal
    req = valid.filter(F.col("method") == "PARAMETRIC")
    dd = _for(inp.exposures, inp, "PARAMETRIC").select(
        "as_of_date", "portfolio_id", "ticker", F.col("lin_exposure").alias("dollar_delta"))
    variance = risk.portfolio_variance_projected(dd, cal.scaled, inp.scaled_periods, inp.returns_rows,
                                                 inp.exposure_rows, inp.return_keys, _n_dates(inp, "PARAMETRIC"))
    return risk.parametric_var(req, _scoped(inp, variance), inp.request_rows, inp.horizon_years, inp.scope)


def historical_results(inp: _Inputs) -> DataFrame:
    valid, cal = inp.valid, inp.cal
    req = valid.filter(F.col("method") == "HISTORICAL")
    sets = req.select(*scenarios.HIST_KEYS).distinct()
    shocks = scenarios.historical_shocks_indexed(_for(cal.index, inp, "HISTORICAL"), cal.own, sets, inp.own_rows, inp.request_rows)
    exp = _for(inp.exposures, inp, "HISTORICAL")
    shock_rows = n_scen = None
    if inp.exposure_rows is not None:
        shock_rows, n_scen = _scenario_sizes(sets, cal.index.filter("n_prices > 1"), F.col("historical_window"))
    factors = cal.index.filter("n_prices > 1").select("as_of_date", "ticker")
    buckets = 0 if inp.book_pnl else _distribution_buckets(valid.sparkSession, shock_rows, inp.exposure_rows, inp.factor_keys,
                                                           n_scen, inp.book_rows, _n_dates(inp, "HISTORICAL"))
    if buckets:
        dist = scenarios.scenario_distribution_blocks(shocks, exp, scenarios.HIST_KEYS, buckets)
        var = risk.scenario_var_from_distribution(req, _scoped(inp, dist), scenarios.HIST_KEYS + inp.scope, "HISTORICAL", inp.request_rows)
    else:
        pnl = _pnl(inp, shocks, exp, scenarios.HIST_KEYS, shock_rows, n_scen, "HISTORICAL")
        var = _ranked_var(inp, req, pnl, scenarios.HIST_KEYS, "HISTORICAL", n_scen)
    return var.unionByName(
        risk.zero_results(req, _scoped(inp, exp), factors, "HISTORICAL", F.col("historical_window"), inp.request_rows, inp.scope))


def _pnl(inp: _Inputs, shocks: DataFrame, exp: DataFrame, keys: list[str], shock_rows, n_scen, method: str) -> DataFrame:
    if inp.book_pnl:
        return inp.book_pnl(shocks, keys)
    return scenarios.price_scenarios(shocks, exp, keys, inp.exposure_rows, shock_rows, inp.factor_keys, n_scen, inp.book_rows, _n_dates(inp, method))


def monte_carlo_results(inp: _Inputs) -> DataFrame:
    valid, cal = inp.valid, inp.cal
    req = valid.filter(F.col("method") == "MONTE_CARLO")
    sets = req.select(*scenarios.MC_KEYS).distinct()
    exp = _for(inp.exposures, inp, "MONTE_CARLO")
    scaled = _for(cal.scaled, inp, "MONTE_CARLO")
    shock_rows = n_scen = None
    if inp.exposure_rows is not None:
        shock_rows, n_scen = _scenario_sizes(sets, cal.index.filter("n_prices > 2"), F.col("num_paths"))
    spark = valid.sparkSession
    if _use_blocks(spark, shock_rows, inp.returns_rows, inp.return_keys):
        shocks = scenarios.mc_shocks_blocks(scaled, sets, inp.scaled_periods, returns_rows=inp.returns_rows, set_rows=inp.request_rows)
    else:
        shocks = scenarios.mc_shocks(scaled, sets, inp.scaled_periods, returns_rows=inp.returns_rows, set_rows=inp.request_rows)
    pnl = _pnl(inp, shocks, exp, scenarios.MC_KEYS, shock_rows, n_scen, "MONTE_CARLO")
    factors = (scaled.select("as_of_date", "ticker").distinct() if inp.loadings
               else cal.index.filter("n_prices > 2").select("as_of_date", "ticker"))
    return _ranked_var(inp, req, pnl, scenarios.MC_KEYS, "MONTE_CARLO", n_scen).unionByName(
        risk.zero_results(req, _scoped(inp, exp), factors, "MONTE_CARLO", F.col("num_paths"), inp.request_rows, inp.scope))


METHOD_BUILDERS = {
    "PARAMETRIC": parametric_results,
    "HISTORICAL": historical_results,
    "MONTE_CARLO": monte_carlo_results,
}


def run_scenarios(requests: DataFrame, positions: DataFrame, prices: DataFrame,
                  periods_per_year: float = schemas.DEFAULT_PERIODS_PER_YEAR,
                  align: str = "date", methods=schemas.METHODS,
                  require_paths: bool = False, materialize: bool = True, durable_prices: bool = True,
                  pricer: str | None = None, strict: bool = False, calibration_window: int | None = None,
                  horizon_years: float = 1.0, covariance: DataFrame | None = None) -> ScenarioRun:
    """Value-at-Risk of every book in ``positions`` for every valid request.

    ``methods`` limits the branches planned (a batch known to hold one method
    plans only that branch). ``pricer`` names a registered pricer
    (functions.pricing.register_pricer) that reprices position by position;
    without it positions collapse to linear and quadratic exposures first.
    ``strict`` raises for the first factor with fewer than two prices, naming it.
    ``calibration_window`` lets volatilities and covariances see only so many of
    the newest returns of a factor (historical replay has its own window);
    ``horizon_years`` scales the parametric variance. ``covariance`` (as_of_date, ti, tj,
    sigma), e.g. of a stored snapshot, takes the place of the returns in the
    parametric and Monte Carlo methods (operators.factorisation).

    ``materialize=True`` (default) caches the valid requests, checkpoints the
    prices (``durable_prices=False`` when the caller's table is already cut from
    its source) and the exposures into the session's checkpoint folder - a lost
    executor never recomputes a fact scan - and measures exact row counts; the
    scenario joins broadcast a side only when it is under the broadcast limits,
    else they are salted shuffle joins (plans.joins).

    Call ``ScenarioRun.release()`` once the results are written.
    """
    valid, rejects = validate_requests(requests, require_paths=require_paths)
    if "source_set" in requests.columns:      # scoped runs: see run_path_groups
        valid = valid.join(requests.select("correlation_id", "source_set").distinct(), "correlation_id")
    # The same request delivered twice (a replayed message) is one request.
    valid = valid.dropDuplicates(["correlation_id"])
    cached: list = []
    request_rows, dates = None, {}
    if materialize:
        valid = cut_lineage(valid, durable=False)
        cached.append(valid)
        by = valid.groupBy("method", "as_of_date").count().collect()      # calendar x methods
        request_rows = sum(r["count"] for r in by)
        dates = {m: [r["as_of_date"] for r in by if r["method"] == m] for m in schemas.METHODS}
        days = cal_ops.known_days(r["as_of_date"] for r in by)
        if durable_prices:
            prices = cut_lineage(prices, durable=True)
    else:
        days = cal_ops.as_of_days(valid)
    cal = cal_ops.Calibration(prices, cal_ops.date_array(days), periods_per_year, align, calibration_window, days)
    if covariance is not None:
        cal.use("scaled", factor_loadings(covariance))
    spot_rows = None
    if materialize:
        index = cut_lineage(cal.index, durable=False)
        cached.append(index)
        counts = index.agg(F.count(F.lit(1)), F.count_if(F.col("n_prices") > 2)).first()     # fills the cache
        spot_rows, return_keys = (int(x) for x in counts)
        cal.use("index", index)
    if strict:
        cal_ops.short_history_factors(cal.index, strict=True).limit(1).collect()
    enriched = enrich_ops.enrich_positions(positions, cal.index, spot_rows)
    exp = enrich_ops.exposures(enriched)
    scope = ["source_set"] if "source_set" in valid.columns else []
    inp = _Inputs(valid, cal, exp, dates=dates, horizon_years=horizon_years, cached=cached, scope=scope,
                  loadings=covariance is not None)
    if pricer:
        # Priced position by position: the join is broadcast or salted by the exact number of positions.
        priced, position_rows = _cache_counted(enriched, cached) if materialize else (enriched, None)
        inp.book_pnl = lambda shocks, keys: scenarios.position_scenario_pnl(shocks, priced, keys, pricer, position_rows)
    if materialize:
        inp.request_rows = request_rows
        # Observed while the table is written. The row count is exact (it decides broadcasts); the other two only size the blocks.
        seen = Observation()
        inp.exposures = cut_lineage(exp.observe(
            seen, F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(F.xxhash64("as_of_date", "ticker")).alias("factors"),
            F.approx_count_distinct(F.xxhash64("as_of_date", "portfolio_id")).alias("books")), durable=True)
        inp.exposure_rows, inp.factor_keys, inp.book_rows = (int(seen.get[k]) for k in ("rows", "factors", "books"))
        if "HISTORICAL" in methods:
            own, inp.own_rows = _cache_counted(cal.own, cached)
            cal.use("own", own)
        if {"PARAMETRIC", "MONTE_CARLO"} & set(methods):
            scaled, inp.returns_rows = _cache_counted(cal.scaled, cached)
            cal.use("scaled", scaled)
            inp.return_keys = return_keys
    short = cal_ops.short_history_factors(cal.index).withColumn("error_code", F.lit(schemas.ERR_CALCULATION))
    factor_rejects = short.join(inp.exposures.select("as_of_date", "ticker").distinct(), ["as_of_date", "ticker"], "left_semi")
    parts = [METHOD_BUILDERS[m](inp) for m in methods]
    results = parts[0]
    for p in parts[1:]:
        results = results.unionByName(p)
    if scope:
        results = results.withColumn("portfolio_id", schemas.unscoped("portfolio_id"))
    sizes = {"requests": request_rows, "spot": spot_rows, "exposures": inp.exposure_rows,
             "exposure_factors": inp.factor_keys, "returns": inp.returns_rows}
    return ScenarioRun(results.select(*schemas.RESULT_COLUMNS), rejects, valid, cal, enriched,
                       inp.exposures, factor_rejects, cached, sizes)


@dataclass
class Outcome:
    """What became of a batch of requests."""
    rejects: DataFrame                      # invalid, unreadable and failed requests
    price_rejects: DataFrame | None = None  # schemas.PRICE_REJECTS of the files read


def _failed(requests: DataFrame, code: str, field_name: str, message: Column) -> DataFrame:
    """Reject rows of requests that could not be run."""
    none = F.lit(None).cast("string")
    why = F.array(F.struct(F.lit(field_name).alias("field"), message.alias("message")))
    return requests.select("correlation_id", F.lit(code).alias("error_code"), why.alias("violations"),
                           F.date_format("as_of_date", "yyyy-MM-dd").alias("as_of_raw"), none.alias("raw_payload"))


def split_failed(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, reject rows): results whose figures are not numbers (overflow, undefined) are failures of
    their request, one row a portfolio. ``results`` is read twice and should be materialised."""
    sound = F.lit(True)
    for c in ("var_amount", "expected_shortfall"):
        sound = sound & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    bad = results.filter(~sound)
    message = F.concat(F.lit("VaR of portfolio "), F.coalesce("portfolio_id", F.lit("?")), F.lit(" is not a number"))
    return results.filter(sound), _failed(bad, schemas.ERR_CALCULATION, "portfolio", message)


def run_isolated(valid: DataFrame, attempt) -> DataFrame:
    """Run ``attempt(requests)`` for all requests; returns reject rows of those that fail.

    A failure is narrowed down: the requests are split by a hash of their ids and
    both parts tried again, so one failing request costs about log2(n) further
    runs and the others are computed. ``attempt`` must be repeatable (results are
    commits). If nothing at all succeeds, the fault is not a request's: the first
    error is raised.
    """
    spark, failed, done, first = valid.sparkSession, [], 0, []

    def go(part: DataFrame, bit: int) -> None:
        nonlocal done
        n = part.select("correlation_id").distinct().count()
        if not n:
            return
        try:
            attempt(part)
            done += 1
        except Exception as e:  # noqa: BLE001 - reported per request, like one bad message
            first.append(e)
            log.warning("%d requests failed", n, exc_info=e)
            if n == 1 or bit == 64:
                failed.append(_failed(part.select("correlation_id", "as_of_date").distinct(), schemas.ERR_PLATFORM, "run",
                                      F.lit((str(e).splitlines() or [type(e).__name__])[0][:500])))
                return
            half = F.shiftright(F.xxhash64("correlation_id"), bit).bitwiseAND(F.lit(1).cast("long"))
            for side in (0, 1):
                go(part.filter(half == side), bit + 1)

    go(valid, 0)
    if first and not done and valid.select("correlation_id").distinct().count() > 1:
        raise first[0]
    out = spark.createDataFrame([], validate_requests(spark.createDataFrame([], schemas.REQUESTS))[1].schema)
    for f in failed:
        out = out.unionByName(f)
    return out


def run_path_groups(spark, requests: DataFrame, handle, periods_per_year: float = schemas.DEFAULT_PERIODS_PER_YEAR) -> Outcome:
    """Run requests that name their own files, all (portfolio_csv_path, prices_csv_path) pairs in one job.

    Every pair is a source set; tickers and portfolio ids carry it through prices,
    positions and calibration, and requests meet the books of their own set only.
    ``handle(run)`` gets the ScenarioRun and writes what it needs. The distinct
    pairs are control metadata, bounded by the request batch. Requests whose files
    cannot be read are rejected with RISK_PLATFORM_ERROR, as are requests whose run
    fails (``run_isolated``); the others go on.
    """
    from ..sources.csv import scan_positions, scan_prices

    valid, rejects = validate_requests(requests, require_paths=True)
    # In upper case, as cleaning puts tickers (and what they are scoped by) in upper case.
    pair = F.upper(F.sha2(F.concat_ws("\u001f", "portfolio_csv_path", "prices_csv_path"), 256))
    valid = cut_lineage(valid.dropDuplicates(["correlation_id"]).withColumn("source_set", pair), durable=True)
    pairs = valid.select("source_set", "portfolio_csv_path", "prices_csv_path").distinct().collect()
    if not pairs:
        return Outcome(rejects)
    positions, wrong = scan_positions(spark, {p.source_set: p.portfolio_csv_path for p in pairs})
    prices, wrong_prices = scan_prices(spark, {p.source_set: p.prices_csv_path for p in pairs if p.source_set not in wrong})
    wrong |= wrong_prices
    if wrong:
        reasons = spark.createDataFrame(sorted(wrong.items()), "source_set string, reason string")
        rejects = rejects.unionByName(_failed(valid.join(reasons, "source_set"), schemas.ERR_PLATFORM, "files", F.col("reason")))
        valid = cut_lineage(valid.join(reasons, "source_set", "left_anti"), durable=True)
    positions = cut_lineage(positions.withColumn("ticker", schemas.scoped("source_set", F.col("ticker")))
                            .withColumn("portfolio_id", schemas.scoped("source_set", F.col("portfolio_id"))).drop("source_set"))

    def attempt(part: DataFrame) -> None:
        run = run_scenarios(part, positions, prices.prices, periods_per_year)
        try:
            handle(run)
        finally:
            run.release()

    return Outcome(rejects.unionByName(run_isolated(valid, attempt)), prices.rejects)


def run_csv_requests(spark, requests: DataFrame,
                     periods_per_year: float = schemas.DEFAULT_PERIODS_PER_YEAR) -> tuple[DataFrame, DataFrame]:
    """Requests that name their inputs by path: returns ``(results, rejects)``,
    the results written to the checkpoint folder once."""
    parts: list[DataFrame] = []
    outcome = run_path_groups(spark, requests, lambda run: parts.append(cut_lineage(run.results, durable=True)), periods_per_year)
    results = spark.createDataFrame([], schemas.RESULTS)
    for p in parts:
        results = results.unionByName(p)
    results, failed = split_failed(results)
    return results, outcome.rejects.unionByName(failed)
