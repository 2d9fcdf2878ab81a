"""Structured Streaming: JSON request files -> foreachBatch scenario job."""

import json
import math
import os

from pyspark.errors import StreamingQueryException

from riskspark.sources import tables
from riskspark.streaming.scenario_stream import ScenarioSink, file_requests, start_scenario_stream

from conftest import SF_SMALL


def test_file_stream_runs_requests_and_replay_adds_nothing(spark, scratch):
    inbox = os.path.join(scratch, "inbox")
    os.makedirs(inbox)
    lines = [
        {"correlationId": "mc-1", "asOfDate": "2001-06-01", "varMethod": "MONTE_CARLO", "numPaths": 200},
        {"correlationId": "hs-1", "asOfDate": "2001-06-01", "varMethod": "HISTORICAL", "historicalWindow": 30},
        {"correlationId": "bad-1", "asOfDate": "2001-06-01", "confidenceLevel": 0.2},
    ]
    with open(os.path.join(inbox, "batch-1.json"), "w") as f:
        f.write("\n".join(json.dumps(x) for x in lines) + "\nnot json\n")
    prices = tables.price_panel(spark, SF_SMALL, "type", "month")
    pos = tables.position_book(spark, SF_SMALL, "segment", "type")
    sink = ScenarioSink(results_path=os.path.join(scratch, "results"), rejects_path=os.path.join(scratch, "rejects"),
                        messages_path=os.path.join(scratch, "messages"))
    for ckpt in ("ckpt-a", "ckpt-b"):  # the second run replays everything on a fresh checkpoint
        q = start_scenario_stream(file_requests(spark, inbox), pos, prices, sink,
                                  os.path.join(scratch, ckpt), periods_per_year=12, available_now=True)
        q.awaitTermination(300)
        assert q.exception() is None
    results = spark.read.parquet(sink.results_path)
    assert results.count() == 2 * 5
    assert {r.correlation_id for r in results.select("correlation_id").distinct().collect()} == {"mc-1", "hs-1"}
    rejects = spark.read.parquet(sink.rejects_path)
    codes = sorted(r.error_code for r in rejects.collect())
    assert codes == ["SCENARIO_REQUEST_INVALID", "SCENARIO_REQUEST_MALFORMED"]
    msgs = spark.read.text(sink.messages_path)
    assert msgs.count() == 10


def _inbox(scratch, lines):
    inbox = os.path.join(scratch, "inbox")
    os.makedirs(inbox, exist_ok=True)
    with open(os.path.join(inbox, "batch-1.json"), "w") as f:
        f.write("\n".join(json.dumps(x) for x in lines))
    return inbox


def _drain(spark, inbox, sink, ckpt, pos=None, prices=None):
    q = start_scenario_stream(file_requests(spark, inbox), pos, prices, sink, ckpt, periods_per_year=12, available_now=True)
    try:
        q.awaitTermination(300)
    except StreamingQueryException as e:
        return e
    return q.exception()


def test_out_of_range_windows_are_rejected_and_the_rest_runs(spark, scratch):
    inbox = _inbox(scratch, [
        {"correlationId": f"w{k}", "asOfDate": "2001-06-01", "varMethod": "HISTORICAL", "historicalWindow": w}
        for k, w in enumerate((3_000_000_000, 2_147_483_647, 30))] + [
        {"correlationId": "same", "asOfDate": "2001-06-01", "varMethod": "PARAMETRIC", "confidenceLevel": a} for a in (0.95, 0.99)])
    prices = tables.price_panel(spark, SF_SMALL, "type", "month")
    pos = tables.position_book(spark, SF_SMALL, "segment", "type").filter("portfolio_id = 'BUILDING'")
    sink = ScenarioSink(os.path.join(scratch, "results"), os.path.join(scratch, "rejects"))
    assert _drain(spark, inbox, sink, os.path.join(scratch, "ckpt"), pos, prices) is None
    assert [r.correlation_id for r in spark.read.parquet(sink.results_path).collect()] == ["w2"]
    rejects = [(r.correlation_id, r.error_code) for r in spark.read.parquet(sink.rejects_path).collect()]
    assert sorted(rejects) == [(c, "SCENARIO_REQUEST_INVALID") for c in ("same", "same", "w0", "w1")]


def test_requests_run_on_their_own_files_and_a_failed_sink_catches_up(spark, scratch):
    paths = {}
    for name, start, step in (("up", 100.0, 1.01), ("wild", 50.0, 1.10)):
        root = os.path.join(scratch, name)
        os.makedirs(root)
        with open(os.path.join(root, "x.csv"), "w") as f:
            f.write("Ticker,Date,Open,High,Low,Close,Volume,OpenInt\n")
            for i in range(28):
                f.write(f"X,2001-05-{i + 1:02d},0,0,0,{start * step ** (i % 3) + i},0,0\n")
        paths[name] = (os.path.join(scratch, f"{name}-book.csv"), root)
        with open(paths[name][0], "w") as f:
            f.write(f"portfolioId,ticker,quantity,assetClass\nBOOK-{name},x,10,EQD\nBOOK-{name},x,1,XYZ\n")
    lines = [{"correlationId": n, "asOfDate": "2001-06-01", "varMethod": "HISTORICAL", "historicalWindow": 20, "portfolioCsvPath": p, "pricesCsvPath": d}
             for n, (p, d) in paths.items()]
    lines += [{"correlationId": "gone", "asOfDate": "2001-06-01", "portfolioCsvPath": "/nowhere.csv", "pricesCsvPath": paths["up"][1]},
              {"correlationId": "none", "asOfDate": "2001-06-01"}]
    inbox, got, failures = _inbox(scratch, lines), [], [1]

    def flaky(results):
        if failures:
            failures.pop()
            raise RuntimeError("sink is down")
        got.extend((r.correlation_id, r.portfolio_id) for r in results.collect())

    sink = ScenarioSink(os.path.join(scratch, "results"), os.path.join(scratch, "rejects"), calibration_path=os.path.join(scratch, "calibration"), extra=[flaky])
    assert _drain(spark, inbox, sink, os.path.join(scratch, "ckpt")) is not None        # the first try fails after the append
    for _ in range(2):
        assert _drain(spark, inbox, sink, os.path.join(scratch, "ckpt")) is None
    assert sorted(got) == [("up", "BOOK-up"), ("wild", "BOOK-wild")]
    stored = {r.correlation_id: r.var_amount for r in spark.read.parquet(sink.results_path).collect()}
    assert set(stored) == {"up", "wild"} and stored["up"] != stored["wild"]
    codes = {r.correlation_id: r.error_code for r in spark.read.parquet(sink.rejects_path).collect()}
    assert codes == {"gone": "RISK_PLATFORM_ERROR", "none": "SCENARIO_REQUEST_INVALID"}
    assert spark.read.parquet(sink.calibration_path).count() == 2


def _pairs(scratch, n):
    """n books and price folders; pair k prices factor X at its own level and shares file names with the others."""
    out = []
    for k in range(n):
        root = os.path.join(scratch, "files", str(k))
        os.makedirs(os.path.join(root, "prices"))
        with open(os.path.join(root, "prices", "x.csv"), "w") as f:
            f.write("Date,Ticker,Close\n" if k % 2 else "Ticker,Date,Close\n")
            for i in range(28):
                row = ("X", f"2001-05-{i + 1:02d}", str(100.0 * (k + 1) * (1 + 0.01 * ((i * (k + 3)) % 7))))
                f.write(",".join((row[1], row[0], row[2]) if k % 2 else row) + "\n")
            f.write("2001-05-30,X,abc\n" if k % 2 else "X,2001-05-30,abc\n")
        with open(os.path.join(root, "book.csv"), "w") as f:
            f.write("portfolioId,ticker,quantity,assetClass\n" if k != 3 else "portfolioId,ticker,amount,assetClass\n")
            f.write("BOOK,x,10,EQD\n")
        out.append((os.path.join(root, "book.csv"), os.path.join(root, "prices")))
    return out


def test_many_path_pairs_are_one_run(spark, scratch):
    """50 pairs, three methods: one scenario run; the pair with a broken file rejects its own requests only."""
    from riskspark.plans import pipeline
    from riskspark.sources.csv import read_position_csv, read_price_csv
    from riskspark.sources.requests import normalise_requests

    pairs, methods = _pairs(scratch, 50), ("HISTORICAL", "PARAMETRIC", "MONTE_CARLO")
    rows = [(f"{m[0]}{k}", p, d, "2001-06-01", m, 20, 50, 0.95 if k % 2 else 0.9) for k, (p, d) in enumerate(pairs) for m in methods]
    wire = "correlationId string, portfolioCsvPath string, pricesCsvPath string, asOfDate string, varMethod string, historicalWindow long, numPaths long, confidenceLevel double"
    requests, runs, results = normalise_requests(spark.createDataFrame(rows, wire)), [], []

    def handle(run):
        runs.append(run.valid.count())
        results.extend(run.results.collect())

    outcome = pipeline.run_path_groups(spark, requests, handle, 12)
    assert runs == [147]
    assert sorted((r.correlation_id, r.error_code) for r in outcome.rejects.collect()) == [(c, "RISK_PLATFORM_ERROR") for c in ("H3", "M3", "P3")]
    assert "book.csv lacks column 'quantity'" in outcome.rejects.first().violations[0].message
    assert outcome.price_rejects.count() == 49 and outcome.price_rejects.first().ticker == "X"
    got = {r.correlation_id: r for r in results}
    assert len(results) == len(got) == 147 and {r.portfolio_id for r in results} == {"BOOK"}
    for k in (0, 7, 48):                       # the same as a run of the pair alone
        one = pipeline.run_scenarios(requests.filter(f"substring(correlation_id, 2) = '{k}'"), read_position_csv(spark, pairs[k][0]).drop("source_file"),
                                     read_price_csv(spark, pairs[k][1]), 12)
        alone = one.results.collect()
        assert len(alone) == 3
        for r in alone:
            for c in ("var_amount", "expected_shortfall", "mean_pnl", "std_dev_pnl"):
                assert math.isclose(r[c], got[r.correlation_id][c], rel_tol=1e-9, abs_tol=1e-9), (r, c)
        one.release()


def test_a_failing_request_does_not_stop_the_others(spark, scratch):
    """On the default tables: a request whose pricing raises and one whose figures overflow become rejects."""
    from pyspark.sql import functions as F
    from riskspark.functions import pricing

    def touchy(quantity, delta, gamma, spot, r):
        base = pricing.PRICERS["auto"](quantity, delta, gamma, spot, r)
        return F.when(F.col(spot) > 500, F.raise_error(F.lit("spot out of range"))).when(F.col(spot) > 200, F.lit(float("inf"))).otherwise(base)

    pricing.register_pricer("touchy", touchy)
    from datetime import date, timedelta
    rows = [("X", date(2001, 1, 1) + timedelta(days=k), c) for k, c in enumerate([100.0, 101.0, 99.0, 102.0, 300.0, 600.0])]
    prices = spark.createDataFrame(rows, "ticker string, date date, close double")
    pos = spark.createDataFrame([("P", "X", 10.0, "EQD", 1.0, 0.0, 0.0)], "portfolio_id string, ticker string, quantity double, asset_class string, "
                                "delta double, gamma double, maturity_in_years double")
    lines = [{"correlationId": f"d{k}", "asOfDate": str(rows[k][1]), "varMethod": "HISTORICAL", "historicalWindow": 3} for k in range(2, 6)]
    inbox = _inbox(scratch, lines)
    sink = ScenarioSink(os.path.join(scratch, "results"), os.path.join(scratch, "rejects"))
    q = start_scenario_stream(file_requests(spark, inbox), pos, prices, sink, os.path.join(scratch, "ckpt"), 12, available_now=True, pricer="touchy")
    q.awaitTermination(300)
    assert q.exception() is None
    from riskspark.plans import store
    assert sorted(r.correlation_id for r in store.read_results(spark, sink.results_path).collect()) == ["d2", "d3"]
    rejects = {r.correlation_id: (r.error_code, r.violations[0].message) for r in store.read_committed(spark, sink.rejects_path, store.REJECT_ROWS).collect()}
    assert rejects["d4"] == ("VAR_CALCULATION_FAILED", "VaR of portfolio P is not a number")
    assert rejects["d5"][0] == "RISK_PLATFORM_ERROR" and len(rejects) == 2


def test_a_fault_of_the_whole_job_is_raised(spark):
    import pytest
    from riskspark.plans.pipeline import run_isolated
    requests = spark.createDataFrame([(f"c{k}", None) for k in range(5)], "correlation_id string, as_of_date date")

    def broken(part):
        raise OSError("disk is gone")

    with pytest.raises(OSError, match="disk is gone"):
        run_isolated(requests, broken)
    seen = []

    def one_bad(part):
        ids = sorted(r.correlation_id for r in part.collect())
        if "c3" in ids:
            raise ValueError("c3 is bad")
        seen.extend(ids)

    assert [r.correlation_id for r in run_isolated(requests, one_bad).collect()] == ["c3"] and sorted(seen) == ["c0", "c1", "c2", "c4"]
