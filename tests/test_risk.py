"""VaR goldens and properties: the parametric cases, the quantile rule,
historical padding, one-factor calibration, invariance to partitioning."""

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from riskspark.operators import calibration as cal_ops
from riskspark import schemas
from riskspark.operators import enrich, factorisation, risk, scenarios
from riskspark.plans.pipeline import run_scenarios
from riskspark.sources import tables
from riskspark.sources.requests import request_grid

from conftest import SF_SMALL

D0 = date(2017, 11, 10)


def _parametric(spark, alpha):
    # 1000 shares at 100.0, volatility 20 %, one-day sigma = annual / 10.
    dd = spark.createDataFrame([(D0, "P", "X", 1000 * 100.0)],
                               "as_of_date date, portfolio_id string, ticker string, dollar_delta double")
    cov = spark.createDataFrame([(D0, "X", "X", (0.20 / 10) ** 2)], "as_of_date date, ti string, tj string, sigma double")
    req = spark.createDataFrame([("c", D0, alpha)], "correlation_id string, as_of_date date, alpha double")
    return risk.parametric_var(req, risk.portfolio_variance(dd, cov)).first()


@pytest.mark.parametrize("alpha,var,es", [(0.95, 3289.707, 4125.426), (0.99, 4652.696, 5330.428)])
def test_parametric_golden(spark, alpha, var, es):
    r = _parametric(spark, alpha)
    assert abs(r.var_amount - var) < 1e-3 and abs(r.var_amount - var) <= 10
    assert abs(r.expected_shortfall - es) < 1e-3
    assert r.num_scenarios == 0 and r.mean_pnl == 0.0 and abs(r.std_dev_pnl - 2000.0) < 1e-9


@pytest.mark.parametrize("alpha,n,idx", [(0.9, 10, 0), (0.95, 100, 5), (0.99, 1000, 10), (0.5, 1, 0), (0.9999, 3, 0)])
def test_quantile_index(spark, alpha, n, idx):
    df = spark.createDataFrame([(alpha, n)], "alpha double, n long")
    assert df.select(risk.quantile_index("alpha", "n")).first()[0] == idx


def test_scenario_var_rule(spark):
    # 100 scenarios with P&L -100..-1 .. ; alpha 0.95 -> idx 5 -> VaR = -pnl[5]
    pnl = spark.createDataFrame([(D0, "P", i, float(i - 50)) for i in range(100)],
                                "as_of_date date, portfolio_id string, scenario_id int, pnl double")
    req = spark.createDataFrame([("c", D0, 0.95)], "correlation_id string, as_of_date date, alpha double")
    r = risk.scenario_var(req, pnl, ["as_of_date"], "HISTORICAL").first()
    assert r.var_amount == 45.0
    assert r.expected_shortfall == pytest.approx(-sum(i - 50 for i in range(6)) / 6)
    assert r.num_scenarios == 100 and r.mean_pnl == pytest.approx(-0.5)
    assert r.std_dev_pnl == pytest.approx(math.sqrt(sum((i - 49.5) ** 2 for i in range(100)) / 99))


def test_historical_padding(spark):
    own = spark.createDataFrame([(D0, "X", t, D0, r) for t, r in enumerate([0.01, 0.02, 0.03])],
                                "as_of_date date, ticker string, t int, date date, r double")
    sets = spark.createDataFrame([(D0, 5)], "as_of_date date, historical_window int")
    got = sorted((r.scenario_id, r.r) for r in scenarios.historical_shocks(own, sets).collect())
    assert got == [(0, 0.01), (1, 0.01), (2, 0.01), (3, 0.02), (4, 0.03)]


def test_historical_tail_alignment(spark):
    own = spark.createDataFrame([(D0, "X", t, D0, float(t)) for t in range(10)],
                                "as_of_date date, ticker string, t int, date date, r double")
    sets = spark.createDataFrame([(D0, 4)], "as_of_date date, historical_window int")
    got = sorted((r.scenario_id, r.r) for r in scenarios.historical_shocks(own, sets).collect())
    assert got == [(0, 6.0), (1, 7.0), (2, 8.0), (3, 9.0)]


def test_one_factor_calibration(spark):
    prices = spark.createDataFrame([("NVDA", D0 - timedelta(days=40 - i), 100.0 * math.exp(0.03 * math.sin(i)))
                                    for i in range(40)], "ticker string, date date, close double")
    asof = spark.createDataFrame([(D0,)], "as_of_date date")
    cal = cal_ops.calibrate(prices, asof, 252)
    vol = cal.vols.first().vol
    sigma = cal.cov.first().sigma
    rho = cal.corr.first().rho
    assert abs(sigma - vol ** 2) < 1e-9 and abs(rho - 1.0) < 1e-9 and 0.0 < vol


def test_constant_factor_has_zero_correlation(spark):
    rows = [("A", D0 - timedelta(days=10 - i), 5.0) for i in range(10)]
    rows += [("B", D0 - timedelta(days=10 - i), 5.0 + i) for i in range(10)]
    prices = spark.createDataFrame(rows, "ticker string, date date, close double")
    cal = cal_ops.calibrate(prices, spark.createDataFrame([(D0,)], "as_of_date date"), 252)
    rho = {(r.ti, r.tj): r.rho for r in cal.corr.collect()}
    assert rho[("A", "A")] == 0.0 and rho[("A", "B")] == 0.0 and abs(rho[("B", "B")] - 1) < 1e-12


def test_every_factor_keeps_its_own_history(spark):
    rows = [("A", D0 - timedelta(days=10 - i), 5.0 + i) for i in range(10)]
    rows += [("B", D0 - timedelta(days=10 - i), 7.0 + i * i) for i in range(5, 10)]
    prices = spark.createDataFrame(rows, "ticker string, date date, close double")
    cal = cal_ops.calibrate(prices, spark.createDataFrame([(D0,)], "as_of_date date"), 252)
    n = {r.ticker: r.n_obs for r in cal.vols.collect()}
    assert n == {"A": 9, "B": 4}
    # Diagonal = own variance; the matrix is positive semi-definite although the histories differ.
    vol = {r.ticker: r.vol for r in cal.vols.collect()}
    cov = {(r.ti, r.tj): r.sigma for r in cal.cov.collect()}
    assert all(cov[t, t] == pytest.approx(vol[t] ** 2) for t in "AB") and cov["A", "B"] == cov["B", "A"]
    assert cov["A", "A"] * cov["B", "B"] - cov["A", "B"] ** 2 >= 0


def test_equal_calendars_give_the_sample_covariance(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    close = np.exp(np.cumsum(rng.standard_normal((3, 30)) * 0.02, axis=1)) * 50
    rows = [(t, D0 - timedelta(days=40 - i), float(close[k, i])) for k, t in enumerate("ABC") for i in range(30)]
    cal = cal_ops.calibrate(spark.createDataFrame(rows, "ticker string, date date, close double"),
                            spark.createDataFrame([(D0,)], "as_of_date date"), 252)
    r = np.diff(np.log(close), axis=1)
    got = {(x.ti, x.tj): x for x in cal.pairs.collect()}
    for i, a in enumerate("ABC"):
        for j, b in enumerate("ABC"):
            assert got[a, b].rho == pytest.approx(np.corrcoef(r)[i, j], abs=1e-12)
            assert 252 * got[a, b].s == pytest.approx(252 * np.cov(r)[i, j], abs=1e-12)
    ordinal = cal_ops.factor_pairs(cal_ops.scaled_returns(cal.returns, "ordinal"))
    assert {(x.ti, x.tj): round(x.s, 12) for x in ordinal.collect()} == {k: round(x.s, 12) for k, x in got.items()}


def test_ordinal_alignment_rejects_ragged_histories(spark):
    rows = [("A", D0 - timedelta(days=10 - i), 5.0 + i) for i in range(10)] + [("LATE", D0 - timedelta(days=5 - i), 7.0 + i) for i in range(4)]
    cal = cal_ops.calibrate(spark.createDataFrame(rows, "ticker string, date date, close double"),
                            spark.createDataFrame([(D0,)], "as_of_date date"), 252, align="ordinal")
    with pytest.raises(Exception, match="ticker LATE has fewer returns"):
        cal.scaled.collect()


def test_pair_blocks_equal_one_block(spark, monkeypatch):
    prices, _ = _books(spark)
    whole = sorted((r.ti, r.tj, round(r.rho, 10)) for r in cal_ops.calibrate(prices, tables.last_date(prices), 12).corr.collect())
    monkeypatch.setattr(cal_ops, "PAIR_BUCKET", 2)
    parts = sorted((r.ti, r.tj, round(r.rho, 10)) for r in cal_ops.calibrate(prices, tables.last_date(prices), 12).corr.collect())
    assert whole == parts and len(whole) == len({t for t, _, _ in whole}) ** 2


def _market(spark, extra=()):
    import random
    rng, rows = random.Random(5), []
    for t in ("A", "B"):
        p = 100.0
        for i in range(200):
            p *= math.exp(rng.gauss(0, 0.02))
            rows.append((t, D0 - timedelta(days=200 - i), p))
    return spark.createDataFrame(rows + list(extra), "ticker string, date date, close double")


def _run(spark, prices, positions, **kw):
    pos = spark.createDataFrame(positions, "portfolio_id string, ticker string, quantity double").selectExpr(
        "*", "'EQD' asset_class", "1.0D delta", "0.0D gamma", "0.0D maturity_in_years")
    req = request_grid(spark.createDataFrame([(D0,)], "as_of_date date"), num_paths=300, historical_window=60)
    return run_scenarios(req, pos, prices, 252, **kw)


def test_unrelated_short_factor_changes_nothing(spark):
    books = [("P", "A", 10.0), ("P", "B", -4.0), ("Q", "B", 7.0)]
    new = [("NEW", D0 - timedelta(days=2), 5.0), ("NEW", D0 - timedelta(days=1), 6.0)]

    def figures(prices):
        return sorted((r.correlation_id, r.portfolio_id, round(r.var_amount, 9), round(r.expected_shortfall, 9))
                      for r in _run(spark, prices, books).results.collect())

    plain = figures(_market(spark))
    assert plain == figures(_market(spark, new)) and all(v > 0 for _, _, v, _ in plain) and len(plain) == 12


def test_held_short_factor_is_reported_and_never_gives_null(spark):
    new = [("ONE", D0, 5.0), ("TWO", D0 - timedelta(days=1), 5.0), ("TWO", D0, 6.0)]
    run = _run(spark, _market(spark, new), [("P", "A", 10.0), ("P", "ONE", 3.0), ("Q", "ONE", 3.0), ("R", "TWO", 1.0)])
    rows = run.results.collect()
    assert len(rows) == 3 * 6 and all(r.var_amount is not None and r.expected_shortfall is not None for r in rows)
    assert all(r.var_amount == 0 for r in rows if r.portfolio_id == "Q")
    assert [(r.ticker, r.n_prices, r.error_code) for r in run.factor_rejects.collect()] == [("ONE", 1, "VAR_CALCULATION_FAILED")]
    quality = cal_ops.history_quality(run.calibration.index, run.valid.filter("method = 'HISTORICAL'")).collect()
    assert {(r.ticker, r.status, r.reason) for r in quality} >= {("ONE", "MISSING", "VAR_CALCULATION_FAILED"), ("TWO", "SHORT", None), ("A", "OK", None)}
    with pytest.raises(Exception, match="ticker ONE requires at least 2 price observations"):
        _run(spark, _market(spark, new), [("P", "A", 10.0)], strict=True)


def test_penny_losses_are_ranked_as_they_are(spark):
    pnl = spark.createDataFrame([(D0, "P", i, -0.001 * ((i * 7) % 10)) for i in range(10)],
                                "as_of_date date, portfolio_id string, scenario_id int, pnl double")
    req = spark.createDataFrame([("c", D0, 0.8)], "correlation_id string, as_of_date date, alpha double")
    r = risk.scenario_var(req, pnl, ["as_of_date"], "HISTORICAL").first()
    n = risk.quantile_index("alpha", "n")
    assert spark.createDataFrame([(0.8, 10)], "alpha double, n long").select(n).first()[0] == 1
    assert r.expected_shortfall == pytest.approx(0.0085) and r.var_amount == pytest.approx(0.008)


def test_registered_pricer_reaches_the_run(spark):
    from riskspark.functions.pricing import PRICERS, register_pricer
    register_pricer("double", lambda q, d, g, s, r: F.lit(2.0) * PRICERS["linear"](q, d, g, s, r))
    books = [("P", "A", 10.0), ("P", "B", -4.0)]
    for method in ("HISTORICAL", "MONTE_CARLO"):
        plain = {r.correlation_id: r.var_amount for r in _run(spark, _market(spark), books, methods=[method]).results.collect() if r.method == method}
        twice = {r.correlation_id: r.var_amount for r in _run(spark, _market(spark), books, methods=[method], pricer="double").results.collect()}
        assert twice == {k: pytest.approx(2 * v) for k, v in plain.items()} and plain


def test_kernels_agree_on_missing_shocks(spark):
    shocks = spark.createDataFrame([(D0, 5, s, t, None if (s, t) == (1, "A") else 0.01 * (s + 1)) for s in range(4) for t in "AB"],
                                   "as_of_date date, historical_window int, scenario_id int, ticker string, r double")
    exp = spark.createDataFrame([(D0, t, p, 100.0, 5.0) for t in "ABC" for p in ("P", "Q")],
                                "as_of_date date, ticker string, portfolio_id string, lin_exposure double, quad_exposure double")
    a = scenarios.scenario_pnl(shocks, exp, scenarios.HIST_KEYS)
    b = scenarios.scenario_pnl_blocks(shocks, exp, scenarios.HIST_KEYS, 2, 2)

    def rows(df):
        return sorted((r.portfolio_id, r.scenario_id, round(r.pnl, 9)) for r in df.collect())

    assert rows(a) == rows(b) and len(rows(a)) == 8


def test_path_groups_do_not_grow_with_dates_times_partitions(spark, monkeypatch):
    dates = [D0 - timedelta(days=k) for k in range(20)]
    scaled = spark.createDataFrame([(a, D0 - timedelta(days=30 + d), t, 0.01 * (d + 1) * (1 if t == "A" else -2)) for a in dates for d in range(10) for t in "AB"],
                                   "as_of_date date, d date, ticker string, z double")
    sets = spark.createDataFrame([(a, 40, 7, 4, 0.25) for a in dates], "as_of_date date, num_paths int, seed long, steps int, dt double")

    def rows(df):
        return sorted((r.as_of_date, r.scenario_id, r.ticker, round(r.r, 12)) for r in df.collect())

    blocks = rows(scenarios.mc_shocks_blocks(scaled, sets, 12, num_partitions=50))
    assert blocks == rows(scenarios.mc_shocks(scaled, sets, 12)) and len(blocks) == 20 * 40 * 2

    def one_row_a_group(periods):
        keys = list(scenarios.MC_KEYS)
        return lambda normals, z: normals[keys].head(1).assign(scenario_id=0, ticker="A", r=0.0)

    monkeypatch.setattr(scenarios, "_shock_block", one_row_a_group)
    assert scenarios.mc_shocks_blocks(scaled, sets, 12, num_partitions=50).count() == 20 * 3     # 50 partitions over 20 dates
    spark.conf.set("riskspark.pricing.blockRows", "100")                                         # 40 paths x 10 days: 4 blocks a date
    try:
        assert scenarios.mc_shocks_blocks(scaled, sets, 12, num_partitions=50).count() == 20 * 4
    finally:
        spark.conf.unset("riskspark.pricing.blockRows")


@pytest.mark.parametrize("n_scen,n_books", [(200_000, 200_000), (10_000, 3), (5, 1_000_000), (0, 0), (250, 15_000)])
def test_block_groups_are_bounded_by_output_cells(n_scen, n_books):
    cells = 4_000_000
    sb, bb = scenarios.block_grid(n_scen, n_books, 8, cells)
    assert -(-n_scen // sb) * -(-n_books // bb) <= 2 * cells


def test_calibration_window_and_horizon(spark):
    prices, books = _market(spark), [("P", "A", 10.0)]
    asof = spark.createDataFrame([(D0,)], "as_of_date date")
    cal = cal_ops.calibrate(prices, asof, 252, window=50)
    assert {(r.ticker, r.n_obs) for r in cal.vols.collect()} == {("A", 50), ("B", 50)}
    late = prices.filter(F.col("date") >= D0 - timedelta(days=51))
    assert {r.ticker: r.vol for r in cal.vols.collect()} == {r.ticker: pytest.approx(r.vol) for r in cal_ops.calibrate(late, asof, 252).vols.collect()}
    year = {r.correlation_id: r.var_amount for r in _run(spark, prices, books, methods=["PARAMETRIC"]).results.collect()}
    day = {r.correlation_id: r.var_amount for r in _run(spark, prices, books, methods=["PARAMETRIC"], horizon_years=0.01).results.collect()}
    assert day == {k: pytest.approx(v / 10) for k, v in year.items()} and year


def test_repository_lookups(spark, scratch):
    from riskspark.plans.store import Repository
    prices, pos = _books(spark)
    pos.write.parquet(f"{scratch}/positions")
    repo = Repository(f"{scratch}/results", f"{scratch}/calibrations", f"{scratch}/positions")
    run = run_scenarios(request_grid(tables.last_date(prices), methods=("PARAMETRIC",)), pos, prices, 12, methods=["PARAMETRIC"])
    for _ in range(2):
        repo.save(run.results, run.calibration.vols, "2024-01-01 00:00:00", run_id="first")
    assert repo.query_results(spark, portfolio_id="BUILDING", method="parametric").count() == 2
    assert repo.latest_calibration(spark).count() == run.calibration.vols.count() == spark.read.parquet(repo.calibrations).count()
    assert {r.portfolio_id for r in repo.portfolio(spark, "BUILDING").collect()} == {"BUILDING"}


def test_snapshot_can_run_a_method_again(spark, scratch):
    from riskspark.plans import store
    cal = cal_ops.calibrate(_market(spark), spark.createDataFrame([(D0,)], "as_of_date date"), 252)
    path = store.write_snapshot(cal, f"{scratch}/snapshot")
    corr, vols = store.read_snapshot(spark, path)
    cov = {(r.ti, r.tj): r.sigma for r in cal_ops.covariance_from_corr(corr, vols).collect()}
    assert cov == {(r.ti, r.tj): pytest.approx(r.sigma) for r in cal.cov.collect()}
    assert spark.read.parquet(f"{path}/factor_returns").count() == 2 * 199


def _books(spark):
    prices = tables.price_panel(spark, SF_SMALL, "type", "month")
    pos = tables.position_book(spark, SF_SMALL, "segment", "type")
    return prices, pos


def test_projected_variance_equals_quadratic_form(spark):
    prices, pos = _books(spark)
    asof = tables.last_date(prices)
    cal = cal_ops.calibrate(prices, asof, 12)
    from riskspark.operators import enrich
    dd = enrich.dollar_delta(enrich.enrich_positions(pos, enrich.latest_spot(cal.prices_as_of)))
    a = {r.portfolio_id: r.variance for r in risk.portfolio_variance(dd, cal.cov).collect()}
    blocks = {r.portfolio_id: r.variance for r in risk.portfolio_variance_blocks(dd, cal.scaled, 12, 3).collect()}
    assert a.keys() == blocks.keys() and all(abs(a[k] - blocks[k]) <= 1e-9 * abs(a[k]) for k in a)
    lone = dd.withColumn("ticker", F.lit("no such factor"))
    assert {r.variance for r in risk.portfolio_variance_blocks(lone, cal.scaled, 12, 3).collect()} == {0.0}
    b = {r.portfolio_id: r.variance for r in risk.portfolio_variance_projected(dd, cal.scaled, 12).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) <= 1e-9 * abs(a[k]) for k in a)


def test_full_run_properties_and_partition_invariance(spark):
    prices, pos = _books(spark)
    req = request_grid(tables.last_date(prices), num_paths=300, historical_window=40)
    out = []
    for parts in ("1", "8", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        res = run_scenarios(req, pos, prices, 12).results
        out.append(sorted((r.correlation_id, r.portfolio_id, round(r.var_amount, 4), round(r.expected_shortfall, 4))
                          for r in res.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert out[0] == out[1] == out[2]
    assert len(out[0]) == 3 * 2 * 5
    for _, _, var, es in out[0]:
        assert es >= var - 1e-6


def test_invalid_requests_are_rejected_not_run(spark):
    prices, pos = _books(spark)
    req = request_grid(tables.last_date(prices), alphas=(0.4, 0.99), num_paths=100, historical_window=20)
    run = run_scenarios(req, pos, prices, 12)
    assert run.rejects.count() == 3
    assert {r.alpha for r in run.results.collect()} == {0.99}


def test_salted_joins_equal_broadcast_joins(spark):
    """Past the broadcast limit the factor joins are salted shuffle joins; the
    results must not change."""
    prices, pos = _books(spark)
    req = request_grid(tables.last_date(prices), num_paths=200, historical_window=30)

    def run():
        res = run_scenarios(req, pos, prices, 12).results
        return sorted((r.correlation_id, r.portfolio_id, round(r.var_amount, 4), round(r.expected_shortfall, 4),
                       round(r.mean_pnl, 4), r.num_scenarios) for r in res.collect())

    broadcast = run()
    spark.conf.set("riskspark.broadcast.maxRows", "0")
    spark.conf.set("riskspark.join.saltBuckets", "5")
    try:
        salted = run()
    finally:
        spark.conf.unset("riskspark.broadcast.maxRows")
        spark.conf.unset("riskspark.join.saltBuckets")
    assert broadcast == salted and len(broadcast) == 30


def test_block_kernel_equals_relational_kernel(spark):
    """Scenario repricing as block matrix products gives the same VaR figures."""
    prices, pos = _books(spark)
    req = request_grid(tables.year_end_dates(prices), methods=("HISTORICAL", "MONTE_CARLO"),
                       num_paths=150, historical_window=30)

    def run(kernel):
        spark.conf.set("riskspark.pricing.kernel", kernel)
        try:
            res = run_scenarios(req, pos, prices, 12).results.collect()
        finally:
            spark.conf.unset("riskspark.pricing.kernel")
        return sorted((r.correlation_id, r.portfolio_id, round(r.var_amount, 3), round(r.expected_shortfall, 3),
                       round(r.mean_pnl, 3), round(r.std_dev_pnl, 3), r.num_scenarios) for r in res)

    relational, blocks = run("relational"), run("blocks")
    assert relational == blocks and len(relational) > 0


def test_distribution_blocks_equal_relational_for_many_books(spark):
    """Many small books (one per customer): the whole-distribution block path
    (sorted P&L arrays per book) gives the same figures as the window path."""
    prices = tables.price_panel(spark, SF_SMALL, "type", "month")
    pos = tables.position_book(spark, SF_SMALL, "customer", "type")
    req = request_grid(tables.last_date(prices), methods=("HISTORICAL",), alphas=(0.9, 0.99),
                       historical_window=25)

    def run(kernel):
        spark.conf.set("riskspark.pricing.kernel", kernel)
        try:
            res = run_scenarios(req, pos, prices, 12).results.collect()
        finally:
            spark.conf.unset("riskspark.pricing.kernel")
        return sorted((r.correlation_id, r.portfolio_id, round(r.var_amount, 4), round(r.expected_shortfall, 4),
                       round(r.mean_pnl, 4), None if r.std_dev_pnl is None else round(r.std_dev_pnl, 4),
                       r.num_scenarios) for r in res)

    relational, blocks = run("relational"), run("blocks")
    assert len(relational) > 100 and relational == blocks


def _ragged(spark):
    """Four factors: full, starting late, with gaps, constant; and one with a single price."""
    rng = random.Random(4)
    rows = []
    for name, keep in (("full", lambda k: True), ("late", lambda k: k >= 30), ("gaps", lambda k: k % 3 != 1), ("flat", lambda k: True), ("one", lambda k: k == 20)):
        for k in range(60):
            if keep(k):
                rows.append((name, D0 + timedelta(days=k), 5.0 if name == "flat" else 100.0 * math.exp(0.02 * rng.gauss(0, 1) + 0.001 * k)))
    return spark.createDataFrame(rows, "ticker string, date date, close double")


@pytest.mark.parametrize("cells", [1_000_000, 60])
def test_running_sums_equal_the_returns_of_each_date(spark, monkeypatch, cells):
    monkeypatch.setattr(cal_ops, "PAIR_CELLS", cells)
    prices = _ragged(spark)
    days = [D0 + timedelta(days=k) for k in (-5, 0, 1, 2, 20, 21, 31, 32, 33, 45, 59, 400)]
    cal = cal_ops.calibrate(prices, spark.createDataFrame([(d,) for d in days], "as_of_date date"), 252)
    old = {(r.as_of_date, r.ti, r.tj): (r.rho, r.s) for r in cal_ops.factor_pairs(cal.scaled).collect()}
    new = {(r.as_of_date, r.ti, r.tj): (r.rho, r.s) for r in cal.pairs.collect()}
    assert new.keys() == old.keys() and len(new) > 50
    for k, v in new.items():
        assert v == pytest.approx(old[k], abs=1e-12), k
    for window in (None, 7):
        by_row = cal_ops.annualised_vol(cal_ops.newest_returns(cal.returns, window), 252)
        want = {(r.as_of_date, r.ticker): (r.vol, r.n_obs) for r in by_row.collect()}
        moments = cal_ops.running_moments(cal.own, cal.asofs, window)
        got = {(r.as_of_date, r.ticker): (r.vol, r.n_obs) for r in cal_ops.vols_from_moments(moments, 252).collect()}
        assert got.keys() == want.keys()
        for k, (vol, n) in got.items():
            assert n == want[k][1] and (vol is None) == (want[k][0] is None) and (vol is None or vol == pytest.approx(want[k][0], abs=1e-12))


def test_indexed_replay_equals_replay_of_each_dates_returns(spark):
    prices = _ragged(spark)
    days = spark.createDataFrame([(D0 + timedelta(days=k),) for k in (0, 1, 20, 32, 59)], "as_of_date date")
    cal = cal_ops.calibrate(prices, days, 252)
    sets = days.withColumn("historical_window", F.explode(F.array(F.lit(1), F.lit(10), F.lit(100))))
    old = sorted(tuple(r) for r in scenarios.historical_shocks(cal.returns, sets).select("as_of_date", "historical_window", "scenario_id", "ticker", "r").collect())
    for rows in (None, 10, 10 ** 9):
        got = scenarios.historical_shocks_indexed(cal.index, cal.own, sets, rows)
        assert sorted(tuple(r) for r in got.select("as_of_date", "historical_window", "scenario_id", "ticker", "r").collect()) == old


def test_rows_of_a_calibration_do_not_grow_with_dates_times_history(spark):
    """The pair products read each return once per bucket, whatever the number of as-of dates."""
    prices = _ragged(spark)
    cal = cal_ops.calibrate(prices, spark.createDataFrame([(D0 + timedelta(days=k),) for k in range(50, 59)], "as_of_date date"), 252)
    below = cal.pairs._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInPandas")[-1].split("\n", 1)[1]
    assert "ticker" in below and "as_of_date" not in below       # nothing below the groups is per as-of date


def test_latest_spot_forms_agree(spark):
    prices = _ragged(spark)
    cal = cal_ops.calibrate(prices, spark.createDataFrame([(D0 + timedelta(days=k),) for k in (-3, 0, 20, 31, 90)], "as_of_date date"), 252)
    want = sorted(tuple(r) for r in enrich.latest_spot(cal.prices_as_of).collect())
    assert sorted(tuple(r) for r in enrich.latest_spot_window(prices, cal.asofs).collect()) == want
    assert sorted(tuple(r) for r in cal.index.drop("n_prices").collect()) == want


def test_buckets_keep_the_order_of_amounts(spark):
    rng = random.Random(8)
    amounts = [None, -math.inf, -1e308, -5.0, -5.0, -1e-300, -5e-324, -0.0, 0.0, 5e-324, 1e-9, 3.0, 1e308, math.inf, math.nan]
    amounts += [rng.choice((-1, 1)) * math.exp(rng.uniform(-30, 30)) for _ in range(500)]
    rows = spark.createDataFrame([(a,) for a in amounts], "pnl double").withColumn("b", risk.pnl_bucket("pnl")).orderBy("pnl").collect()
    assert [r.b for r in rows] == sorted(r.b for r in rows)
    assert len({r.b for r in rows}) > 400


def _rounded(results):
    """Result rows with amounts at 9 digits: sums may run in another order."""
    return sorted(str([float(f"{v:.9g}") if isinstance(v, float) else v for v in r]) for r in results.collect())


def test_tail_selection_equals_ranking_all(spark):
    rng = random.Random(9)
    rows = []
    for set_, n in ((1, 400), (2, 37), (3, 1)):
        for book in ("A", "B", "ties", "zero", "null"):
            for s in range(n):
                v = {"ties": float(-(s % 5)), "zero": 0.0}.get(book, rng.gauss(0, 1000))
                rows.append((set_, D0, book, s, None if book == "null" and s % 9 == 0 else v))
    pnl = spark.createDataFrame(rows, "set int, as_of_date date, portfolio_id string, scenario_id int, pnl double").repartition(5).persist()
    req = spark.createDataFrame([(f"{s}|{a}", s, D0, a) for s in (1, 2, 3, 4) for a in (0.5, 0.95, 0.99, 0.9999)],
                                "correlation_id string, set int, as_of_date date, alpha double")
    for rows_known in (None, 16):
        a, b = (_rounded(f(req, pnl, ["set", "as_of_date"], "HISTORICAL", rows_known)) for f in (risk.scenario_var, risk.scenario_var_by_tail))
        assert a == b and len(a) == 3 * 5 * 4
        a, b = (sorted(map(str, risk.tail_scenarios(req, pnl, ["set", "as_of_date"], rows_known, by_tail=t).collect())) for t in (False, True))
        assert a == b
    pnl.unpersist()


def test_a_million_paths_exchange_their_tail_only(spark):
    n = 1_000_000
    pnl = (spark.range(n, numPartitions=8).selectExpr("date'2017-11-10' as as_of_date", "explode(array('P', 'Q')) as portfolio_id", "int(id) as scenario_id")
           .withColumn("pnl", (F.xxhash64("portfolio_id", "scenario_id") % 1_000_003).cast("double")).persist())
    req = spark.createDataFrame([("c", D0, 0.99), ("d", D0, 0.999)], "correlation_id string, as_of_date date, alpha double")
    tail = risk.worst_scenarios(req, pnl, ["as_of_date"], 2)
    assert 20_002 <= tail.count() < 21_000          # of two million
    got = {(r.correlation_id, r.portfolio_id): (r.var_amount, r.num_scenarios) for r in risk.scenario_var_by_tail(req, pnl, ["as_of_date"], "MONTE_CARLO", 2).collect()}
    for book in ("P", "Q"):
        amounts = sorted(r.pnl for r in pnl.filter(F.col("portfolio_id") == book).sort("pnl").limit(10_001).collect())
        assert got["c", book] == (-amounts[10_000], n) and got["d", book] == (-amounts[1_000], n)
    pnl.unpersist()


def test_ranking_by_tail_reaches_the_run(spark):
    prices, pos = _books(spark)
    req = request_grid(tables.last_date(prices), num_paths=300, historical_window=20)
    out = []
    for mode in ("window", "tail"):
        spark.conf.set("riskspark.ranking", mode)
        try:
            run = run_scenarios(req, pos, prices, 12)
            out.append(_rounded(run.results))
            run.release()
        finally:
            spark.conf.unset("riskspark.ranking")
    assert out[0] == out[1] and len(out[0]) == 30


@pytest.mark.parametrize("block", [512, 2])
def test_loadings_multiply_out_to_their_covariance(spark, block):
    """Singular tables included: a copy of a factor, a factor without variance, an empty pair."""
    import numpy as np
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for k, n in ((0, 5), (1, 1), (2, 4)):
        x = rng.normal(size=(12, n))
        if n == 5:
            x[:, 3], x[:, 4] = x[:, 1] * 2, 0.0
        s = np.cov(x, rowvar=False).reshape(n, n)
        for i in range(n):
            for j in range(n):
                rows.append((D0 + timedelta(days=k), f"f{i}", f"f{j}", float(s[i, j]) if s[i, j] else None))
                want[k, i, j] = s[i, j]
    cov = spark.createDataFrame(rows, "as_of_date date, ti string, tj string, sigma double")
    loadings = factorisation.factor_loadings(cov, block)
    got = {((r.as_of_date - D0).days, int(r.ti[1]), int(r.tj[1])): r.sigma for r in factorisation.covariance_from_loadings(loadings).collect()}
    assert got.keys() == {(k, i, j) for k, i, j in want if not (k == 0 and 4 in (i, j))}
    for k, v in got.items():
        assert v == pytest.approx(want[k], abs=1e-12)
    per_factor = {(r.as_of_date, r.ticker): r["count"] for r in loadings.groupBy("as_of_date", "ticker").count().collect()}
    assert loadings.filter(F.col("as_of_date") == D0).select("d").distinct().count() == 3       # the rank
    assert all(per_factor.values())


def test_monte_carlo_from_a_stored_covariance(spark):
    prices, pos = _books(spark)
    req = request_grid(tables.last_date(prices), methods=("PARAMETRIC", "MONTE_CARLO"), alphas=(0.95,), num_paths=20_000)
    direct = run_scenarios(req, pos, prices, 12, methods=["PARAMETRIC", "MONTE_CARLO"])
    cov = spark.createDataFrame(direct.calibration.cov.collect(), direct.calibration.cov.schema)         # nothing but Sigma
    stored = run_scenarios(req, pos, prices, 12, methods=["PARAMETRIC", "MONTE_CARLO"], covariance=cov)
    a, b = ({(r.method, r.portfolio_id): r for r in run.results.collect()} for run in (direct, stored))
    assert a.keys() == b.keys() and len(a) == 10
    for k in a:
        exact = k[0] == "PARAMETRIC"
        assert b[k].var_amount == pytest.approx(a[k].var_amount, rel=1e-9 if exact else 0.05), k
        # The volatilities of the smallest tables make P&L so heavy-tailed that its sample deviation tells nothing.
        assert not exact or b[k].std_dev_pnl == pytest.approx(a[k].std_dev_pnl, rel=1e-9), k
    # The sample covariance of the paths against Sigma.
    import numpy as np
    steps, dt = schemas.TIME_GRIDS[schemas.DEFAULT_TIME_GRID]
    sets = tables.last_date(prices).select("as_of_date", F.lit(20_000).alias("num_paths"), F.lit(7).cast("long").alias("seed"), F.lit(steps).alias("steps"), F.lit(dt).alias("dt"))
    shocks = scenarios.mc_shocks(factorisation.factor_loadings(cov), sets, 1.0).toPandas().pivot(index="scenario_id", columns="ticker", values="r")
    sigma = cov.toPandas().pivot(index="ti", columns="tj", values="sigma").loc[shocks.columns, shocks.columns].to_numpy() * steps * dt
    sample = np.cov(shocks.to_numpy(), rowvar=False)
    scale = np.sqrt(np.outer(np.diag(sigma), np.diag(sigma)))
    assert np.abs(sample - sigma).max() < 0.05 * scale.max() and np.abs((sample - sigma) / scale).max() < 0.05
    direct.release(), stored.release()


def test_sizes_are_observed_not_counted_again(spark):
    prices, pos = _books(spark)
    run = run_scenarios(request_grid(tables.last_date(prices), num_paths=10, historical_window=5), pos, prices, 12)
    assert run.sizes["exposures"] == run.exposures.count() and run.sizes["spot"] == run.calibration.index.count()
    run.release()
