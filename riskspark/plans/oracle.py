"""Reference SQL (DuckDB dialect) for the named queries of ``catalog``.

Each statement is written from the model's formulas in plain SQL: pair sums for
covariances, a direct index lookup for historical replay, position-by-position
repricing, conditional aggregates for the quantile rule. The statements share
with the library what the model fixes: the price panel, the AS241 constants and
the hashed normals (tests check those against Python's ``NormalDist``).
Tables are the warehouse views (lineitem, part, orders, customer, events,
pages). Rounding matches the catalog (money 2 dp, rates 8 dp).
"""

from __future__ import annotations

import math

from .. import schemas
from ..functions.normal import AS241_A, AS241_B, AS241_C, AS241_D, AS241_E, AS241_F
from ..sources import tables
from . import catalog as C

D = "::DOUBLE"


def _lit(x: float) -> str:
    return f"({x!r}{D})"


def _poly(coeffs, x: str) -> str:
    acc = _lit(coeffs[-1])
    for c in reversed(coeffs[:-1]):
        acc = f"({acc} * {x} + {_lit(c)})"
    return acc


def sql_norm_ppf(p: str) -> str:
    q = f"(({p}) - 0.5{D})"
    rc = f"(0.180625{D} - {q} * {q})"
    r = f"sqrt(-ln(least({p}, 1.0{D} - ({p}))))"
    mid = f"({_poly(AS241_C, f'({r} - 1.6{D})')} / {_poly(AS241_D, f'({r} - 1.6{D})')})"
    far = f"({_poly(AS241_E, f'({r} - 5.0{D})')} / {_poly(AS241_F, f'({r} - 5.0{D})')})"
    tail = f"(CASE WHEN {r} <= 5.0{D} THEN {mid} ELSE {far} END)"
    return (f"(CASE WHEN ({p}) <= 0 OR ({p}) >= 1 THEN NULL "
            f"WHEN abs({q}) <= 0.425{D} THEN {q} * {_poly(AS241_A, rc)} / {_poly(AS241_B, rc)} "
            f"WHEN {q} < 0 THEN -{tail} ELSE {tail} END)")


def sql_norm_pdf(z: str) -> str:
    return f"(exp(-(({z}) * ({z})) / 2.0{D}) / {_lit(math.sqrt(2.0 * math.pi))})"


def sql_hashed_normal(seed: str, path: str, step: str) -> str:
    h = f"md5(concat_ws('|', CAST({seed} AS VARCHAR), CAST({path} AS VARCHAR), CAST({step} AS VARCHAR)))"
    h1 = f"CAST(('0x' || substr({h}, 1, 13)) AS BIGINT){D}"
    h2 = f"CAST(('0x' || substr({h}, 14, 13)) AS BIGINT){D}"
    two52 = float(2 ** 52)
    u1 = f"(({h1} + 1.0{D}) / {_lit(two52 + 1.0)})"
    u2 = f"({h2} / {_lit(two52)})"
    return f"(sqrt(-2.0{D} * ln({u1})) * cos({_lit(2.0 * math.pi)} * {u2}))"


# ------------------------------------------------------------------ CTE blocks

def panel(by="brand", period="month") -> str:
    col = {"brand": "p_brand", "type": "p_type"}[by]
    return (f"prices AS (SELECT p.{col} AS ticker, CAST(date_trunc('{period}', l.l_shipdate) AS DATE) AS date, "
            f"round(sum(l.l_extendedprice), 2) / sum(l.l_quantity) AS close "
            f"FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1, 2)")


def calendar(kind="all") -> str:
    if kind == "year_end":
        return "asofs AS (SELECT max(date) AS as_of_date FROM prices GROUP BY year(date))"
    if kind == "last":
        return "asofs AS (SELECT max(date) AS as_of_date FROM prices)"
    return "asofs AS (SELECT DISTINCT date AS as_of_date FROM prices)"


PX = "px AS (SELECT a.as_of_date, p.ticker, p.date, p.close FROM prices p JOIN asofs a ON p.date <= a.as_of_date)"

def returns_block(src: str = "px", p: str = "") -> str:
    """Log-returns of each factor's own prices up to the as-of date (CTE names prefixed with ``p``)."""
    return f"""{p}rets0 AS (SELECT as_of_date, ticker, date, ln(close) - ln(lag(close) OVER w) AS r,
                 row_number() OVER w - 2 AS t
          FROM {src} WINDOW w AS (PARTITION BY as_of_date, ticker ORDER BY date)),
{p}returns AS (SELECT as_of_date, ticker, CAST(t AS INTEGER) AS t, date, r FROM {p}rets0 WHERE r IS NOT NULL)"""


RETURNS = returns_block()

OWN = "own AS (SELECT * FROM returns)"

# Centred returns over sqrt(n - 1): sums of their products are covariances.
SCALED = """zs AS (SELECT as_of_date, ticker, date, date_diff('day', DATE '1970-01-01', date) AS d,
                (r - avg(r) OVER w) / sqrt(count(*) OVER w - 1) AS z
       FROM (SELECT *, count(*) OVER (PARTITION BY as_of_date, ticker) AS n FROM returns) WHERE n >= 2
       WINDOW w AS (PARTITION BY as_of_date, ticker))"""


def vols(src="returns", name="vols", periods=C.PERIODS) -> str:
    return (f"{name} AS (SELECT as_of_date, ticker, stddev_samp(r) * sqrt({periods}.0{D}) AS vol, "
            f"CAST(count(*) AS INTEGER) AS n_obs FROM {src} GROUP BY as_of_date, ticker)")


CORR = SCALED + """,
own_sum AS (SELECT as_of_date, ticker, sum(z * z) AS s FROM zs GROUP BY as_of_date, ticker),
prods AS (SELECT a.as_of_date, a.ticker AS ti, b.ticker AS tj, sum(a.z * b.z) AS s
          FROM zs a JOIN zs b ON a.as_of_date = b.as_of_date AND a.date = b.date GROUP BY 1, 2, 3),
corrm AS (SELECT i.as_of_date, i.ticker AS ti, j.ticker AS tj, coalesce(p.s, 0.0::DOUBLE) AS cov_r,
                 CASE WHEN i.s = 0 OR j.s = 0 THEN 0.0::DOUBLE ELSE coalesce(p.s, 0.0::DOUBLE) / sqrt(i.s * j.s) END AS rho
          FROM own_sum i JOIN own_sum j ON i.as_of_date = j.as_of_date
          LEFT JOIN prods p ON p.as_of_date = i.as_of_date AND p.ti = i.ticker AND p.tj = j.ticker)"""


def positions(by="segment", ticker_by="brand", options=False) -> str:
    pcol = {"segment": "c.c_mktsegment", "nation": "CAST(c.c_nationkey AS VARCHAR)"}[by]
    tcol = {"brand": "p.p_brand", "type": "p.p_type"}[ticker_by]
    if options:
        return (f"positions AS (SELECT {pcol} AS portfolio_id, {tcol} AS ticker, l.l_linestatus AS status, "
                f"sum(CASE WHEN l.l_returnflag = 'R' THEN -l.l_quantity ELSE l.l_quantity END) AS quantity "
                f"FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey "
                f"JOIN customer c ON o.o_custkey = c.c_custkey JOIN part p ON l.l_partkey = p.p_partkey "
                f"GROUP BY 1, 2, 3), "
                f"book AS (SELECT portfolio_id, ticker, quantity, "
                f"CASE WHEN status = 'O' THEN 0.5{D} ELSE 1.0{D} END AS delta, "
                f"CASE WHEN status = 'O' THEN 0.01{D} ELSE 0.0{D} END AS gamma FROM positions)")
    return (f"positions AS (SELECT {pcol} AS portfolio_id, {tcol} AS ticker, "
            f"sum(CASE WHEN l.l_returnflag = 'R' THEN -l.l_quantity ELSE l.l_quantity END) AS quantity "
            f"FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey "
            f"JOIN customer c ON o.o_custkey = c.c_custkey JOIN part p ON l.l_partkey = p.p_partkey "
            f"GROUP BY 1, 2), "
            f"book AS (SELECT portfolio_id, ticker, quantity, 1.0{D} AS delta, 0.0{D} AS gamma FROM positions)")


SPOT = """spot AS (SELECT as_of_date, ticker, arg_max(close, date) AS spot_price, max(date) AS spot_date
          FROM px GROUP BY as_of_date, ticker),
enriched AS (SELECT s.as_of_date, b.portfolio_id, b.ticker, b.quantity, b.delta, b.gamma, s.spot_price
             FROM book b JOIN spot s ON b.ticker = s.ticker),
dd AS (SELECT as_of_date, portfolio_id, ticker, sum(quantity * spot_price * delta) AS dollar_delta
       FROM enriched GROUP BY as_of_date, portfolio_id, ticker)"""


def requests(methods=schemas.METHODS) -> str:
    ms = ", ".join(f"('{m}')" for m in methods)
    al = ", ".join(f"({a}{D})" for a in C.ALPHAS)
    return (f"reqs AS (SELECT m.method || '|' || CAST(a.as_of_date AS VARCHAR) || '|' || CAST(al.alpha AS VARCHAR) "
            f"AS correlation_id, a.as_of_date, m.method, al.alpha "
            f"FROM asofs a CROSS JOIN (VALUES {ms}) m(method) CROSS JOIN (VALUES {al}) al(alpha))")


def idx(alpha="alpha", n="n") -> str:
    return f"greatest(0, least(CAST(floor((1.0{D} - {alpha}) * {n}) AS BIGINT), {n} - 1))"


def pnl_expr(q="quantity", d="delta", g="gamma", s="spot_price", r="r") -> str:
    ds = f"({s} * (exp({r}) - 1.0{D}))"
    return f"({q} * ({d} * {ds} + 0.5{D} * {g} * {ds} * {ds}))"


def scenario_stats(pnl: str, keys: str, method: str, req_join: str) -> str:
    """Result rows from a P&L relation (keys..., portfolio_id, scenario_id, pnl)."""
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY {keys}, portfolio_id ORDER BY pnl, scenario_id) AS rn,
                         count(*) OVER (PARTITION BY {keys}, portfolio_id) AS n FROM {pnl}),
res_{method.lower()} AS (
  SELECT q.correlation_id, k.portfolio_id, q.as_of_date, '{method}' AS method,
         -max(CASE WHEN k.rn = {idx('q.alpha', 'k.n')} + 1 THEN k.pnl END) AS var_amount,
         -avg(CASE WHEN k.rn <= {idx('q.alpha', 'k.n')} + 1 THEN k.pnl END) AS expected_shortfall,
         q.alpha, avg(k.pnl) AS mean_pnl, stddev_samp(k.pnl) AS std_dev_pnl,
         CAST(count(*) AS INTEGER) AS num_scenarios
  FROM ranked k JOIN reqs q ON {req_join}
  GROUP BY q.correlation_id, k.portfolio_id, q.as_of_date, q.alpha)"""


def hist_block(windows=(C.HIST_WINDOW,)) -> str:
    ws = ", ".join(f"({w})" for w in windows)
    return f"""{OWN},
hsets AS (SELECT a.as_of_date, w.historical_window FROM asofs a CROSS JOIN (VALUES {ws}) w(historical_window)),
ownn AS (SELECT as_of_date, ticker, count(*) AS n FROM own GROUP BY as_of_date, ticker),
hgrid AS (SELECT h.as_of_date, h.historical_window, f.ticker, f.n,
                 unnest(generate_series(0, h.historical_window - 1)) AS scenario_id
          FROM hsets h JOIN ownn f ON h.as_of_date = f.as_of_date),
hshock AS (SELECT g.as_of_date, g.historical_window, CAST(g.scenario_id AS INTEGER) AS scenario_id, g.ticker, o.r
           FROM hgrid g JOIN own o ON o.as_of_date = g.as_of_date AND o.ticker = g.ticker
            AND o.t = greatest(0, g.n - g.historical_window + g.scenario_id))"""


HPNL = f"""hpnl AS (SELECT s.as_of_date, s.historical_window, e.portfolio_id, s.scenario_id,
                sum({pnl_expr(r='s.r')}) AS pnl
         FROM hshock s JOIN enriched e ON s.as_of_date = e.as_of_date AND s.ticker = e.ticker
         GROUP BY s.as_of_date, s.historical_window, e.portfolio_id, s.scenario_id)"""


def mc_block(paths=C.MC_PATHS, seed=C.SEED, periods=C.PERIODS) -> str:
    steps, dt = schemas.TIME_GRIDS[schemas.DEFAULT_TIME_GRID]
    w = sql_hashed_normal(str(seed), "pth.path", "days.d")
    return f"""normals AS (SELECT days.d, CAST(pth.path AS INTEGER) AS scenario_id, {w} AS w
            FROM (SELECT DISTINCT d FROM zs) days CROSS JOIN range(0, {paths}) pth(path)),
mshock AS (SELECT z.as_of_date, n.scenario_id, z.ticker,
                  sqrt({float(periods)!r}{D} * {steps} * {dt!r}{D}) * sum(n.w * z.z) AS r
           FROM normals n JOIN zs z ON n.d = z.d GROUP BY z.as_of_date, n.scenario_id, z.ticker)"""


MPNL = f"""mpnl AS (SELECT s.as_of_date, e.portfolio_id, s.scenario_id, sum({pnl_expr(r='s.r')}) AS pnl
         FROM mshock s JOIN enriched e ON s.as_of_date = e.as_of_date AND s.ticker = e.ticker
         GROUP BY s.as_of_date, e.portfolio_id, s.scenario_id)"""


PARAM = f"""pvar AS (SELECT a.as_of_date, a.portfolio_id, sum(a.dollar_delta * m.cov_r * {C.PERIODS}.0{D} * b.dollar_delta) AS variance
         FROM dd a JOIN corrm m ON a.as_of_date = m.as_of_date AND a.ticker = m.ti
         JOIN dd b ON b.as_of_date = a.as_of_date AND b.portfolio_id = a.portfolio_id AND b.ticker = m.tj
         GROUP BY a.as_of_date, a.portfolio_id),
res_parametric AS (
  SELECT q.correlation_id, v.portfolio_id, q.as_of_date, 'PARAMETRIC' AS method,
         {sql_norm_ppf('q.alpha')} * sqrt(v.variance) AS var_amount,
         sqrt(v.variance) * {sql_norm_pdf(sql_norm_ppf('q.alpha'))} / (1.0{D} - q.alpha) AS expected_shortfall,
         q.alpha, 0.0{D} AS mean_pnl, sqrt(v.variance) AS std_dev_pnl, CAST(0 AS INTEGER) AS num_scenarios
  FROM reqs q JOIN pvar v ON q.as_of_date = v.as_of_date WHERE q.method = 'PARAMETRIC')"""


def rounded(src: str) -> str:
    return (f"SELECT correlation_id, portfolio_id, as_of_date, method, round(var_amount, 2) AS var_amount, "
            f"round(expected_shortfall, 2) AS expected_shortfall, alpha, round(mean_pnl, 2) AS mean_pnl, "
            f"round(std_dev_pnl, 2) AS std_dev_pnl, num_scenarios FROM {src}")


def _with(*blocks: str) -> str:
    return "WITH " + ",\n".join(blocks) + "\n"


BASE = (panel(), calendar(), PX)


def results_sql(methods=schemas.METHODS, base=BASE, book="segment", paths=C.MC_PATHS, window=C.HIST_WINDOW,
                rounding=True) -> str:
    blocks = [*base, RETURNS, positions(book), SPOT, requests(methods)]
    parts = []
    if "PARAMETRIC" in methods:
        blocks += [CORR, PARAM]
        parts.append("SELECT * FROM res_parametric")
    if "HISTORICAL" in methods:
        blocks += [hist_block((window,)), HPNL,
                   scenario_stats("hpnl", "as_of_date, historical_window", "HISTORICAL",
                                  "q.as_of_date = k.as_of_date AND q.method = 'HISTORICAL'").replace(
                                      "ranked AS", "hranked AS").replace("FROM ranked k", "FROM hranked k")]
        parts.append("SELECT * FROM res_historical")
    if "MONTE_CARLO" in methods:
        if "PARAMETRIC" not in methods:
            blocks.append(SCALED)
        blocks += [mc_block(paths), MPNL,
                   scenario_stats("mpnl", "as_of_date", "MONTE_CARLO",
                                  "q.as_of_date = k.as_of_date AND q.method = 'MONTE_CARLO'").replace(
                                      "ranked AS", "mranked AS").replace("FROM ranked k", "FROM mranked k")]
        parts.append("SELECT * FROM res_monte_carlo")
    blocks.append("priced AS (" + " UNION ALL ".join(parts) + ")")
    # A book none of whose factors has a shock (or a variance) yet moves nowhere.
    blocks.append(f"""allres AS (SELECT * FROM priced UNION ALL
  SELECT q.correlation_id, b.portfolio_id, q.as_of_date, q.method, 0.0{D}, 0.0{D}, q.alpha, 0.0{D}, 0.0{D},
         CAST(CASE q.method WHEN 'HISTORICAL' THEN {window} WHEN 'MONTE_CARLO' THEN {paths} ELSE 0 END AS INTEGER)
  FROM reqs q JOIN (SELECT DISTINCT as_of_date, portfolio_id FROM enriched) b ON b.as_of_date = q.as_of_date
  WHERE NOT EXISTS (SELECT 1 FROM priced p WHERE p.correlation_id = q.correlation_id AND p.portfolio_id = b.portfolio_id))""")
    return _with(*blocks) + rounded("allres")


# --------------------------------------------------------------------- queries

def build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["prices_panel"] = _with(panel()) + "SELECT ticker, date, close FROM prices"
    q["prices_clean"] = (
        "SELECT upper(trim(event_type)) AS ticker, CAST(ts AS DATE) AS date, round(arg_max(value, ts), 6) AS close "
        f"FROM events WHERE value IS NOT NULL AND value > 0 AND CAST(ts AS DATE) <= DATE '{C.TICK_AS_OF}' "
        "AND event_type IS NOT NULL GROUP BY 1, 2")
    q["ticker_from_path"] = (
        "SELECT page_id, upper(url_decode(regexp_replace(regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1), "
        "'\\.[A-Za-z0-9]+$', ''))) AS ticker FROM pages")
    q["portfolio_lookup"] = (_with(positions()) + "SELECT portfolio_id, ticker, round(quantity, 6) AS quantity "
                             f"FROM positions WHERE portfolio_id = '{C.LOOKUP_BOOK}'")
    q["log_returns"] = _with(*BASE, RETURNS) + "SELECT as_of_date, ticker, t, date, round(r, 8) AS r FROM returns"
    q["annualised_vol"] = _with(*BASE, RETURNS, vols()) + \
        "SELECT as_of_date, ticker, round(vol, 8) AS vol, n_obs FROM vols"
    q["correlation_matrix"] = _with(*BASE, RETURNS, CORR) + "SELECT as_of_date, ti, tj, round(rho, 8) AS rho FROM corrm"
    q["covariance_matrix"] = _with(*BASE, RETURNS, CORR) + \
        f"SELECT as_of_date, ti, tj, round(cov_r * {C.PERIODS}.0{D}, 8) AS sigma FROM corrm"
    # Factors without variance have no loadings.
    q["covariance_from_loadings"] = _with(*BASE, RETURNS, CORR) + (
        f"SELECT m.as_of_date, m.ti, m.tj, round(m.cov_r * {C.PERIODS}.0{D}, 6) AS sigma FROM corrm m "
        "JOIN own_sum i ON i.as_of_date = m.as_of_date AND i.ticker = m.ti JOIN own_sum j ON j.as_of_date = m.as_of_date AND j.ticker = m.tj "
        "WHERE i.s > 0 AND j.s > 0")
    q["covariance_from_corr"] = _with(*BASE, RETURNS, CORR, vols("returns", "ovols")) + (
        "SELECT m.as_of_date, m.ti, m.tj, round(m.rho * coalesce(a.vol, 0.0) * coalesce(b.vol, 0.0), 8) AS sigma "
        "FROM corrm m LEFT JOIN ovols a ON a.as_of_date = m.as_of_date AND a.ticker = m.ti "
        "LEFT JOIN ovols b ON b.as_of_date = m.as_of_date AND b.ticker = m.tj")
    q["short_history_factors"] = _with(panel("brand", "week"), calendar("all"), PX) + (
        "SELECT as_of_date, ticker, CAST(count(*) AS INTEGER) AS n_prices, "
        "'requires at least 2 price observations' AS reason FROM px GROUP BY as_of_date, ticker HAVING count(*) < 2")
    ws = ", ".join(f"({w})" for w in C.HIST_WINDOWS)
    q["history_quality"] = _with(*BASE) + (
        "SELECT c.as_of_date, w.historical_window, c.ticker, c.n_returns, "
        "CASE WHEN c.n_returns = 0 THEN 'MISSING' WHEN c.n_returns < w.historical_window THEN 'SHORT' ELSE 'OK' END "
        "AS status, CASE WHEN c.n_returns = 0 THEN 'VAR_CALCULATION_FAILED' END AS reason FROM (SELECT as_of_date, ticker, CAST(greatest(count(*) - 1, 0) AS INTEGER) AS n_returns "
        f"FROM px GROUP BY as_of_date, ticker) c CROSS JOIN (VALUES {ws}) w(historical_window)")
    q["calibration_rows"] = _with(*BASE, RETURNS, vols()) + (
        "SELECT strftime(as_of_date, '%Y-%m-%d') AS as_of_date, ticker, round(vol, 8) AS volatility, "
        f"TIMESTAMP '{C.RUN_TS}' AS ts FROM vols")
    wk_px = ("wprices AS (SELECT p.p_brand AS ticker, CAST(date_trunc('week', l.l_shipdate) AS DATE) AS date, "
             "round(sum(l.l_extendedprice), 2) / sum(l.l_quantity) AS close FROM lineitem l JOIN part p "
             "ON l.l_partkey = p.p_partkey GROUP BY 1, 2), "
             "wpx AS (SELECT a.as_of_date, p.ticker, p.date, p.close FROM wprices p JOIN asofs a ON p.date <= a.as_of_date)")
    wk_returns = returns_block("wpx", "w")
    runs = _with(*BASE, RETURNS, vols(), wk_px, wk_returns, vols("wreturns", "wvols", tables_periods("week")),
                 "runs AS (" + " UNION ALL ".join(
                     f"SELECT strftime(as_of_date, '%Y-%m-%d') AS as_of_date, ticker, round(vol, 8) AS volatility, TIMESTAMP '{ts}' AS ts FROM {v}"
                     for v, ts in (("vols", C.RUN_TS), ("wvols", C.RERUN_TS), ("vols", C.THIRD_TS))) + ")")
    newest = "QUALIFY row_number() OVER (PARTITION BY as_of_date, ticker ORDER BY ts DESC) = 1"
    q["latest_calibration"] = runs + f"SELECT as_of_date, ticker, volatility FROM runs {newest}"
    q["calibration_known_at"] = runs + f"SELECT as_of_date, ticker, volatility FROM runs WHERE ts <= TIMESTAMP '{C.KNOWN_AT}' {newest}"
    q["calibration_versions"] = runs + (
        "SELECT as_of_date, ticker, volatility, ts AS valid_from, lead(ts) OVER (PARTITION BY as_of_date, ticker ORDER BY ts) AS valid_to FROM runs")
    q["latest_spot"] = _with(*BASE) + (
        "SELECT as_of_date, ticker, arg_max(close, date) AS spot_price, max(date) AS spot_date "
        "FROM px GROUP BY as_of_date, ticker")
    q["latest_spot_window"] = _with(*BASE) + (
        "SELECT as_of_date, ticker, close AS spot_price, date AS spot_date FROM px "
        "QUALIFY row_number() OVER (PARTITION BY as_of_date, ticker ORDER BY date DESC) = 1")
    q["enrich_positions"] = _with(*BASE, positions("nation"), SPOT) + (
        "SELECT as_of_date, portfolio_id, ticker, quantity, spot_price "
        "FROM enriched")
    q["unmatched_positions"] = _with(panel("brand", "day"), calendar("all"), positions()) + (
        "SELECT a.as_of_date, b.portfolio_id, b.ticker, round(b.quantity, 6) AS quantity "
        "FROM book b LEFT JOIN (SELECT ticker, min(date) AS first FROM prices WHERE close IS NOT NULL GROUP BY ticker) f "
        "ON f.ticker = b.ticker JOIN asofs a ON f.first IS NULL OR a.as_of_date < f.first")
    q["portfolio_value"] = _with(*BASE, positions(), SPOT) + (
        "SELECT as_of_date, portfolio_id, round(sum(quantity * spot_price), 2) AS total_value "
        "FROM enriched GROUP BY as_of_date, portfolio_id")
    q["dollar_delta"] = _with(*BASE, positions(), SPOT) + (
        "SELECT as_of_date, portfolio_id, ticker, round(dollar_delta, 2) AS dollar_delta FROM dd")
    q["norm_ppf"] = (f"SELECT l_discount, round({sql_norm_ppf(f'(0.5{D} + l_discount * 4.999{D})')}, 10) AS z, "
                     f"round({sql_norm_ppf(f'(1.0{D} - (0.5{D} + l_discount * 4.999{D}))')}, 10) AS z_low "
                     "FROM (SELECT DISTINCT l_discount FROM lineitem)")
    pv = _with(*BASE, RETURNS, positions(), SPOT, CORR, PARAM.split(",\nres_parametric")[0])
    q["portfolio_variance"] = pv + "SELECT as_of_date, portfolio_id, round(sqrt(variance), 2) AS sigma_p FROM pvar"
    q["portfolio_variance_projected"] = _with(*BASE, RETURNS, positions(), SPOT, SCALED) + (
        f"SELECT as_of_date, portfolio_id, round(sqrt(sum(y * y) * {C.PERIODS}.0{D}), 2) AS sigma_p FROM ("
        "SELECT d.as_of_date, d.portfolio_id, z.date, coalesce(sum(d.dollar_delta * z.z), 0.0) AS y FROM dd d LEFT JOIN zs z "
        "ON d.as_of_date = z.as_of_date AND d.ticker = z.ticker GROUP BY d.as_of_date, d.portfolio_id, z.date) "
        "GROUP BY as_of_date, portfolio_id")
    q["parametric_var"] = results_sql(("PARAMETRIC",))
    q["historical_shocks"] = _with(*BASE, RETURNS, hist_block(C.HIST_WINDOWS)) + (
        "SELECT as_of_date, historical_window, scenario_id, ticker, round(r, 8) AS r FROM hshock")
    hp = "SELECT as_of_date, portfolio_id, scenario_id, round(pnl, 2) AS pnl FROM hpnl"
    q["scenario_pnl"] = _with(*BASE, RETURNS, positions(options=True), SPOT, hist_block(), HPNL) + hp
    q["pnl_linear"] = _with(*BASE, RETURNS, positions(), SPOT, hist_block(), HPNL) + hp
    q["pnl_delta_gamma"] = q["scenario_pnl"]
    q["historical_var"] = results_sql(("HISTORICAL",))
    q["tail_scenarios"] = _with(*BASE, RETURNS, positions(), SPOT, requests(("HISTORICAL",)), hist_block(), HPNL) + (
        "SELECT q.correlation_id, k.portfolio_id, CAST(k.rn AS INTEGER) AS rank, "
        "round(k.pnl, 2) AS pnl FROM (SELECT *, row_number() OVER (PARTITION BY as_of_date, historical_window, "
        "portfolio_id ORDER BY pnl, scenario_id) AS rn, count(*) OVER (PARTITION BY as_of_date, historical_window, "
        f"portfolio_id) AS n FROM hpnl) k JOIN reqs q ON q.as_of_date = k.as_of_date "
        f"WHERE k.rn <= {idx('q.alpha', 'k.n')} + 1")
    q["worst_paths"] = _with(*BASE, RETURNS, positions(), SPOT, requests(("MONTE_CARLO",)), SCALED, mc_block(), MPNL) + (
        "SELECT q.correlation_id, k.portfolio_id, CAST(k.rn AS INTEGER) AS rank, round(k.pnl, 2) AS pnl FROM (SELECT *, row_number() OVER w AS rn, "
        "count(*) OVER (PARTITION BY as_of_date, portfolio_id) AS n FROM mpnl WINDOW w AS (PARTITION BY as_of_date, portfolio_id ORDER BY pnl, "
        f"scenario_id)) k JOIN reqs q ON q.as_of_date = k.as_of_date WHERE k.rn <= {idx('q.alpha', 'k.n')} + 1")
    q["mc_shocks"] = _with(*BASE, RETURNS, SCALED, mc_block()) + (
        "SELECT as_of_date, scenario_id, ticker, round(r, 8) AS r FROM mshock")
    q["monte_carlo_var"] = results_sql(("MONTE_CARLO",))
    q["var_all_methods"] = results_sql()
    q["default_size_var"] = results_sql(("HISTORICAL", "MONTE_CARLO"), (panel(), calendar("last"), PX), C.DEFAULT_BOOK,
                                        schemas.DEFAULT_NUM_PATHS, schemas.DEFAULT_HISTORICAL_WINDOW)
    q["results_json"] = (
        "SELECT correlation_id AS key, correlation_id AS correlationId, portfolio_id AS portfolioId, "
        "strftime(as_of_date, '%Y-%m-%d') AS asOfDate, method, var_amount AS varAmount, expected_shortfall AS expectedShortfall, "
        f"alpha, mean_pnl AS meanPnL, std_dev_pnl AS stdDevPnL FROM ({results_sql()})")
    q["positions_panel"] = _with(positions(options=True)) + (
        f"SELECT portfolio_id, ticker, round(quantity, 6) AS quantity, 'EQD' AS asset_class, delta, gamma, 0.0{D} AS maturity_in_years FROM book")
    q["positions_csv"] = f"SELECT * REPLACE (upper(ticker) AS ticker) FROM ({q['positions_panel']})"
    faults = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tables.PRICE_FAULTS.items())
    q["price_rejects"] = (
        "WITH l AS (SELECT upper(trim(event_type)) AS ticker, CAST(ts AS DATE) AS date, value, ts, CASE WHEN event_type IS NULL THEN 'ticker' "
        "WHEN ts IS NULL THEN 'date' WHEN value IS NULL OR isnan(value) OR value = 'inf' THEN 'close' WHEN value <= 0 THEN 'sign' END AS fault "
        "FROM events), d AS (SELECT ticker, date, value, CASE WHEN fault IS NULL AND row_number() OVER (PARTITION BY ticker, date, fault "
        "ORDER BY ts DESC NULLS LAST, value DESC) > 1 THEN 'duplicate' ELSE fault END AS fault FROM l) "
        f"SELECT ticker, date, round(value, 6) AS value, CASE fault {faults} END AS reason FROM d WHERE fault IS NOT NULL")
    q["price_quality"] = (
        "WITH d AS (SELECT upper(trim(event_type)) AS ticker, CAST(ts AS DATE) AS day, CASE WHEN event_type IS NULL THEN 'ticker' "
        "WHEN ts IS NULL THEN 'date' WHEN value IS NULL OR isnan(value) OR value = 'inf' THEN 'close' WHEN value <= 0 THEN 'sign' END AS fault, "
        "count(*) AS n FROM events GROUP BY 1, 2, 3) SELECT ticker, CAST(sum(n) AS BIGINT) AS n_rows, "
        + ", ".join(f"CAST(coalesce(sum(n) FILTER (fault = '{k}'), 0) AS BIGINT) AS {c}" for k, c in
                    (("ticker", "n_bad_ticker"), ("date", "n_bad_date"), ("close", "n_bad_close"), ("sign", "n_not_positive")))
        + ", CAST(coalesce(sum(n - 1) FILTER (fault IS NULL), 0) AS BIGINT) AS n_duplicate FROM d GROUP BY ticker")
    q["validate_requests"] = validate_sql()
    ms = ", ".join(f"('{m.lower()}')" for m in schemas.METHODS)
    al = ", ".join(f"({a}{D})" for a in C.ALPHAS)
    q["parse_requests"] = _with(*BASE) + (
        "SELECT m.m || '|' || CAST(a.as_of_date AS VARCHAR) || '|' || CAST(al.alpha AS VARCHAR) AS correlation_id, "
        "a.as_of_date, upper(m.m) AS method, al.alpha, "
        f"CAST({schemas.DEFAULT_NUM_PATHS} AS BIGINT) AS num_paths, "
        f"CAST({schemas.DEFAULT_HISTORICAL_WINDOW} AS BIGINT) AS historical_window, "
        f"'{schemas.DEFAULT_TIME_GRID}' AS time_grid, CAST({schemas.DEFAULT_SEED} AS BIGINT) AS seed, "
        f"false AS malformed FROM asofs a CROSS JOIN (VALUES {ms}) m(m) CROSS JOIN (VALUES {al}) al(alpha) "
        "UNION ALL SELECT sha256('|' || body), CASE WHEN NOT bad THEN as_of_date END, "
        f"'{schemas.DEFAULT_METHOD}', {schemas.DEFAULT_CONFIDENCE}{D}, CAST({schemas.DEFAULT_NUM_PATHS} AS BIGINT), "
        f"CAST({schemas.DEFAULT_HISTORICAL_WINDOW} AS BIGINT), '{schemas.DEFAULT_TIME_GRID}', CAST({schemas.DEFAULT_SEED} AS BIGINT), bad "
        "FROM (SELECT as_of_date, bad, CASE WHEN bad THEN 'not json ' || strftime(as_of_date, '%Y-%m-%d') "
        "ELSE '{\"asOfDate\":\"' || strftime(as_of_date, '%Y-%m-%d') || '\"}' END AS body "
        "FROM asofs CROSS JOIN (VALUES (true), (false)) v(bad))")
    allres = results_sql()
    stored = (f"SELECT correlation_id, portfolio_id, strftime(as_of_date, '%Y-%m-%d') AS as_of_date, method, "
              f"var_amount, expected_shortfall, alpha, mean_pnl, std_dev_pnl, num_scenarios, "
              f"CASE WHEN alpha = {C.ALPHAS[0]}{D} THEN TIMESTAMP '{C.RUN_TS}' ELSE TIMESTAMP '{C.RERUN_TS}' END AS ts, "
              f"CAST(CASE WHEN alpha = {C.ALPHAS[0]}{D} THEN DATE '{C.RUN_TS[:10]}' ELSE DATE '{C.RERUN_TS[:10]}' END AS DATE) AS result_date "
              f"FROM ({allres})")
    q["results_rows"] = stored
    q["query_results"] = (
        f"SELECT correlation_id, portfolio_id, as_of_date, method, var_amount, expected_shortfall, alpha, mean_pnl, "
        f"std_dev_pnl, num_scenarios FROM ({stored}) WHERE portfolio_id = '{C.LOOKUP_BOOK}' "
        f"AND CAST(as_of_date AS DATE) >= DATE '{C.LOOKUP_FROM}' AND CAST(as_of_date AS DATE) <= DATE '{C.LOOKUP_TO}' "
        f"AND method = '{C.LOOKUP_METHOD.upper()}'")
    return q


def tables_periods(period: str) -> int:
    from ..sources.tables import PERIODS_PER_YEAR
    return PERIODS_PER_YEAR[period]


def validate_sql() -> str:
    methods = ", ".join(f"('{m}')" for m in (*schemas.METHODS, "DELTA"))
    known_methods = ", ".join(f"'{m}'" for m in schemas.METHODS)
    known_grids = ", ".join(f"'{g}'" for g in schemas.TIME_GRIDS)
    return _with(*BASE) + f"""SELECT correlation_id, error_code, fields FROM (
  SELECT concat_ws('|', m, CAST(as_of_date AS VARCHAR), CAST(c AS VARCHAR), CAST(n AS VARCHAR), g) AS correlation_id,
         CASE WHEN m NOT IN ({known_methods}) OR (regexp_full_match(g, 'GRID_[0-9]+') AND g NOT IN ({known_grids}))
              THEN '{schemas.ERR_BAD_PARAMETER}'
              WHEN c < {schemas.MIN_CONFIDENCE} OR c > {schemas.MAX_CONFIDENCE} OR n < {schemas.MIN_NUM_PATHS}
                   OR n > {schemas.MAX_NUM_PATHS} OR NOT regexp_full_match(g, 'GRID_[0-9]+')
              THEN '{schemas.ERR_INVALID}' END AS error_code,
         concat_ws(',',
           CASE WHEN m NOT IN ({known_methods}) THEN 'varMethod' END,
           CASE WHEN regexp_full_match(g, 'GRID_[0-9]+') AND g NOT IN ({known_grids}) THEN 'timeGrid' END,
           CASE WHEN c < {schemas.MIN_CONFIDENCE} THEN 'confidenceLevel' END,
           CASE WHEN c > {schemas.MAX_CONFIDENCE} THEN 'confidenceLevel' END,
           CASE WHEN n < {schemas.MIN_NUM_PATHS} THEN 'numPaths' END,
           CASE WHEN n > {schemas.MAX_NUM_PATHS} THEN 'numPaths' END,
           CASE WHEN NOT regexp_full_match(g, 'GRID_[0-9]+') THEN 'timeGrid' END) AS fields
  FROM asofs CROSS JOIN (VALUES {methods}) mm(m) CROSS JOIN (VALUES (0.4{D}), (0.95{D}), (0.99{D}), (1.0{D})) cc(c)
       CROSS JOIN (VALUES (0), (1000)) nn(n) CROSS JOIN (VALUES ('GRID_53'), ('GRID_X'), ('GRID_7')) gg(g))
WHERE error_code IS NOT NULL"""


ORACLES = build()
