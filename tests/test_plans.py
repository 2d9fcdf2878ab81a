"""Plan properties that matter at scale, checked on the physical plan."""

import contextlib
import io
import re

from riskspark.plans.pipeline import run_scenarios
from riskspark.sources import tables
from riskspark.sources.requests import request_grid

from conftest import SF_SMALL


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return re.sub(r"#\d+L?", "", buf.getvalue())


def test_pipeline_plan_has_no_pairing_or_hot_key_joins(spark):
    prices = tables.price_panel(spark, SF_SMALL, "type", "month")
    pos = tables.position_book(spark, SF_SMALL, "segment", "type")
    run = run_scenarios(request_grid(tables.year_end_dates(prices), num_paths=100, historical_window=20),
                        pos, prices, 12)
    plan = _plan(run.results)
    # No cartesian product and no nested-loop join anywhere: as-of dates are exploded, not joined.
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # No sort-merge join keyed by the ticker or the date alone (few keys, hot keys).
    join_keys = re.findall(r"\(\d+\) (\w*Join)[^\n]*\nLeft keys \[\d+\]: \[([^\]]*)\]", plan)
    assert join_keys, "no join details found in the plan"
    smj = [k.strip() for kind, k in join_keys if kind == "SortMergeJoin"]
    assert all(k not in ("ticker", "as_of_date") for k in smj), smj
    # Monte Carlo paths are distributed once, explicitly, on (set, scenario).
    assert re.search(r"hashpartitioning\(seed, scenario_id, \d+\), REPARTITION_BY_NUM", plan)
    for lazy in (run.calibration.prices_as_of, run.calibration.returns, run.calibration.index):
        assert "NestedLoop" not in _plan(lazy) and "Cartesian" not in _plan(lazy)
    run.release()


def test_no_query_pairs_rows_or_stays_cached(spark):
    """No nested-loop join in any registered query (the plans of its stages included) and nothing left persisted."""
    from riskspark.plans.catalog import QUERIES
    # Result queries return a written table, whose plan is a scan; the run's own plan is tested above.
    written = {"parametric_var", "historical_var", "monte_carlo_var", "var_all_methods", "default_size_var", "results_json", "results_rows", "query_results"}
    names = [n for n in QUERIES if n not in written]
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    plans = {n: _plan(QUERIES[n](spark, SF_SMALL)) for n in names}
    for name, plan in plans.items():
        assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan, name
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    for name in ("portfolio_variance", "correlation_matrix"):
        tree = plans[name].split("\n\n")[0]
        assert len(re.findall(r"\bExchange\b", tree)) < 15, (name, tree)
