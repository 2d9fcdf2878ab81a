"""Request decoding and validation; CSV sources; stores and lookups."""

import json
import os

import pytest
from pyspark.sql import functions as F

from riskspark import schemas
from riskspark.operators.validation import validate_requests
from riskspark.plans import store
from riskspark.plans.pipeline import run_csv_requests
from riskspark.sources import csv as csv_src
from riskspark.sources import tables
from riskspark.sources.requests import parse_requests

from conftest import SF_SMALL


def _raw(spark, lines):
    return spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "pos long, value string")


def test_parse_defaults_and_ids(spark):
    lines = [json.dumps({"portfolioCsvPath": "/p.csv", "pricesCsvPath": "/d", "asOfDate": "2017-11-10"}),
             json.dumps({"correlationId": "abc", "portfolioCsvPath": "/p.csv", "pricesCsvPath": "/d",
                         "asOfDate": "2017-11-10", "varMethod": "historical", "historicalWindow": 250})]
    rows = parse_requests(_raw(spark, lines), "value", ["pos"]).orderBy("pos").collect()
    a, b = rows
    assert a.method == schemas.DEFAULT_METHOD and a.alpha == 0.99 and a.num_paths_raw == 10000
    assert a.time_grid == "GRID_53" and a.window_raw == 500 and len(a.correlation_id) == 64
    assert b.correlation_id == "abc" and b.method == "HISTORICAL" and b.window_raw == 250
    again = parse_requests(_raw(spark, lines), "value", ["pos"]).orderBy("pos").collect()
    assert again[0].correlation_id == a.correlation_id


def test_validation_codes(spark):
    ok = {"portfolioCsvPath": "/p.csv", "pricesCsvPath": "/d", "asOfDate": "2017-11-10"}
    cases = {
        "good": ok,
        "blank": {**ok, "portfolioCsvPath": "  "},
        "alpha": {**ok, "confidenceLevel": 0.4},
        "paths": {**ok, "numPaths": 0},
        "grid_pattern": {**ok, "timeGrid": "GRID_X"},
        "grid_unknown": {**ok, "timeGrid": "GRID_7"},
        "method": {**ok, "varMethod": "DELTA"},
        "date": {**ok, "asOfDate": "10/11/2017"},
    }
    lines = [json.dumps({**v, "correlationId": k}) for k, v in cases.items()] + ["not json", "{}"]
    valid, rejects = validate_requests(parse_requests(_raw(spark, lines), "value", ["pos"]), require_paths=True)
    assert [r.correlation_id for r in valid.collect()] == ["good"]
    codes = {r.correlation_id: (r.error_code, [v.field for v in r.violations]) for r in rejects.collect()}
    assert codes["blank"] == (schemas.ERR_INVALID, ["portfolioCsvPath"])
    assert codes["alpha"] == (schemas.ERR_INVALID, ["confidenceLevel"])
    assert codes["paths"] == (schemas.ERR_INVALID, ["numPaths"])
    assert codes["grid_pattern"] == (schemas.ERR_INVALID, ["timeGrid"])
    assert codes["grid_unknown"] == (schemas.ERR_BAD_PARAMETER, ["timeGrid"])
    assert codes["method"] == (schemas.ERR_BAD_PARAMETER, ["varMethod"])
    assert codes["date"] == (schemas.ERR_INVALID, ["asOfDate"])
    malformed = [c for c, (code, _) in codes.items() if code == schemas.ERR_MALFORMED]
    assert len(malformed) == 2


def _write_price_dir(spark, root):
    """Price files per ticker derived from the sf0.001 part-type panel."""
    panel = tables.price_panel(spark, SF_SMALL, "type", "month").collect()
    by = {}
    for r in panel:
        by.setdefault(r.ticker, []).append(r)
    os.makedirs(root, exist_ok=True)
    for t, rows in by.items():
        with open(os.path.join(root, f"{t.lower()}.csv"), "w") as f:
            f.write(",".join(csv_src.PRICE_HEADER) + "\n")
            for r in sorted(rows, key=lambda x: x.date):
                f.write(f"{t},{r.date.isoformat()},0,0,0,{r.close!r},0,0\n")
            f.write(f"{t},2001-12-31,0,0,0,abc,0,0\n")  # bad number: dropped, never fails the job
    return by


def test_price_csv_and_file_ticker(spark, scratch):
    d = os.path.join(scratch, "prices")
    by = _write_price_dir(spark, d)
    px = csv_src.read_price_csv(spark, d)
    assert px.count() == sum(len(v) for v in by.values())
    by_file = csv_src.read_price_csv(spark, d, ticker_from="file")
    assert {r.ticker for r in by_file.select("ticker").distinct().collect()} == {t.upper() for t in by}


def test_ticker_from_path(spark):
    df = spark.createDataFrame([("/data/prices/brk.b.csv",), ("s3://b/x/my%20co.csv",), ("/a/nvda.csv",),
                                ("https://h.example.com/en/685?page=2#top",)], "p string")
    got = [r[0] for r in df.select(csv_src.ticker_from_path("p")).collect()]
    assert got == ["BRK.B", "MY CO", "NVDA", "685"]


def test_position_csv_with_bom_and_csv_requests(spark, scratch):
    d = os.path.join(scratch, "prices")
    _write_price_dir(spark, d)
    pos_path = os.path.join(scratch, "portfolio.csv")
    with open(pos_path, "w", encoding="utf-8-sig") as f:
        f.write("portfolioId,ticker,quantity,assetClass\n")
        f.write("PTFL-001,economy,100,EQD\nPTFL-001,promo,50,EQD\nPTFL-002,large,x,EQD\nPTFL-002,small,20,EQD\n")
    pos = csv_src.read_position_csv(spark, pos_path)
    assert "portfolio_id" in pos.columns and pos.count() == 3
    assert {r.ticker for r in pos.collect()} == {"ECONOMY", "PROMO", "SMALL"}
    assert [(r.ticker, r.quantity_raw, r.reason) for r in csv_src.position_rejects(spark, pos_path).collect()] == [
        ("LARGE", "x", "quantity is not a number")]
    reqs = spark.createDataFrame([("r1", pos_path, d, "2001-06-30", "MONTE_CARLO", 0.99, 1000),
                                  ("r2", pos_path, d, "2001-06-30", "HISTORICAL", 0.99, 1000),
                                  ("r3", "", d, "2001-06-30", "PARAMETRIC", 0.99, 1000)],
                                 "correlationId string, portfolioCsvPath string, pricesCsvPath string, asOfDate string, "
                                 "varMethod string, confidenceLevel double, numPaths long")
    from riskspark.sources.requests import normalise_requests
    results, rejects = run_csv_requests(spark, normalise_requests(reqs), periods_per_year=12)
    res = results.collect()
    assert {(r.correlation_id, r.portfolio_id) for r in res} == {
        ("r1", "PTFL-001"), ("r1", "PTFL-002"), ("r2", "PTFL-001"), ("r2", "PTFL-002")}
    assert all(r.var_amount > 0 for r in res)
    assert [r.correlation_id for r in rejects.collect()] == ["r3"]


def test_result_store_roundtrip_and_idempotent_append(spark, scratch):
    prices = tables.price_panel(spark, SF_SMALL, "type", "month")
    pos = tables.position_book(spark, SF_SMALL, "segment", "type")
    from riskspark.plans.pipeline import run_scenarios
    from riskspark.sources.requests import request_grid
    run = run_scenarios(request_grid(tables.last_date(prices), methods=("PARAMETRIC",)), pos, prices, 12)
    path = os.path.join(scratch, "var_results")
    store.append_results(run.results, path)
    store.append_results(run.results, path)  # replay: nothing new
    stored = spark.read.parquet(path)
    assert stored.count() == 10
    later = run.results.withColumn("correlation_id", F.concat(F.lit("later|"), "correlation_id"))
    store.append_results(run.results, path, "2024-01-01 00:00:00")           # nothing new either
    store.append_results(later, path, "2099-01-01 00:00:00")
    newest = [r.correlation_id.startswith("later|") for r in store.query_results(spark.read.parquet(path)).collect()]
    assert newest == [True] * 10 + [False] * 10                              # newest first
    q = store.query_results(stored, portfolio_id="BUILDING", method="parametric").collect()
    assert len(q) == 2 and all(r.method == "PARAMETRIC" for r in q)
    msgs = store.results_json(run.results).collect()
    body = json.loads(msgs[0].value)
    assert set(body) == {"correlationId", "portfolioId", "asOfDate", "method", "varAmount", "expectedShortfall",
                         "alpha", "meanPnL", "stdDevPnL"}
    assert msgs[0].key == body["correlationId"]


def test_latest_calibration_picks_newest(spark):
    rows = [("2017-11-10", "A", 0.2, "2024-01-01 00:00:00"), ("2017-11-10", "A", 0.3, "2024-01-02 00:00:00"),
            ("2017-11-09", "A", 0.9, "2024-01-03 00:00:00")]
    df = spark.createDataFrame(rows, "as_of_date string, ticker string, volatility double, ts string") \
        .withColumn("ts", F.col("ts").cast("timestamp"))
    got = store.latest_calibration(df, "2017-11-10").collect()
    assert [(r.ticker, r.volatility) for r in got] == [("A", 0.3)]


def test_a_calibration_that_comes_back_is_the_newest(spark, scratch):
    path = os.path.join(scratch, "calibrations")
    for run, value in enumerate((0.2, 0.3, 0.2)):
        vols = spark.createDataFrame([("2017-11-10", "A", value), ("2017-11-10", "B", None)], "as_of_date string, ticker string, vol double") \
            .withColumn("as_of_date", F.to_date("as_of_date"))
        sent = [store.append_calibration(vols, path, f"2024-01-0{run + 1} 00:00:00", run_id=f"run-{run}") for _ in range(2)]
        assert sent == [2, None]                                        # the replay writes nothing
    stored = store.read_calibrations(spark, path)
    assert stored.count() == 6
    assert {r.ticker: r.volatility for r in store.latest_calibration(stored, "2017-11-10").collect()} == {"A": 0.2, "B": None}
    known = store.latest_calibration(stored, "2017-11-10", known_at="2024-01-02 23:00:00").filter("ticker = 'A'").first()
    assert known.volatility == 0.3
    versions = [(r.volatility, str(r.valid_from)[:10], r.valid_to and str(r.valid_to)[:10])
                for r in store.calibration_versions(stored).filter("ticker = 'A'").orderBy("valid_from").collect()]
    assert versions == [(0.2, "2024-01-01", "2024-01-02"), (0.3, "2024-01-02", "2024-01-03"), (0.2, "2024-01-03", None)]
    same_time = store.append_calibration(vols.withColumn("vol", F.lit(0.9)), path, "2024-01-03 00:00:00")
    assert same_time == 2 and store.latest_calibration(store.read_calibrations(spark, path)).filter("ticker = 'A'").first().volatility == 0.9


def _result_rows(spark, n, executed, first=0):
    """n results; every row that is computed counts."""
    def run(batches):
        for b in batches:
            executed.add(b.num_rows)
            yield b
    return (spark.range(first, first + n).selectExpr(
        "concat('c', id div 2) as correlation_id", "concat('b', id % 2) as portfolio_id", "date'2020-01-01' + int(id % 3) as as_of_date",
        "'HISTORICAL' as method", "1.0 + id as var_amount", "2.0 + id as expected_shortfall", "0.99d as alpha", "0.0d as mean_pnl",
        "1.0d as std_dev_pnl", "int(5) as num_scenarios").selectExpr("* except (var_amount, expected_shortfall)",
        "double(var_amount) as var_amount", "double(expected_shortfall) as expected_shortfall")
        .mapInArrow(run, "correlation_id string, portfolio_id string, as_of_date date, method string, alpha double, mean_pnl double, "
                         "std_dev_pnl double, num_scenarios int, var_amount double, expected_shortfall double"))


def test_an_append_computes_its_rows_once_and_commits_whole_runs(spark, scratch, monkeypatch):
    path, executed = os.path.join(scratch, "results"), spark.sparkContext.accumulator(0)
    assert store.append_results(_result_rows(spark, 10, executed), path, run_id="a") == 10 and executed.value == 10
    # An overlapping run: compared with the store, still computed once; c4 is there already.
    assert store.append_results(_result_rows(spark, 10, executed, 8), path, run_id="b", as_of_dates=None) == 8 and executed.value == 20
    assert store.append_results(_result_rows(spark, 10, executed), path, run_id="a") is None and executed.value == 20
    assert store.read_results(spark, path).count() == 18

    def die(*_):
        raise RuntimeError("killed before the commit")

    with monkeypatch.context() as m:
        m.setattr(store, "_write_manifest", die)
        with pytest.raises(RuntimeError, match="killed"):
            store.append_results(_result_rows(spark, 6, executed, 100), path, run_id="c")
    assert spark.read.parquet(path).count() == 24                       # the files are there,
    assert store.read_results(spark, path).count() == 18                # nobody reads them,
    assert store.append_results(_result_rows(spark, 6, executed, 100), path, run_id="c") == 6
    assert store.read_results(spark, path).count() == 24                # and the retry adds each row once
    assert store.query_results(store.read_results(spark, path), date_from="2020-01-02", date_to="2020-01-02").count() > 0


def test_reject_store_reads_the_days_it_needs(spark, scratch):
    path = os.path.join(scratch, "rejects")
    lines = [json.dumps({"correlationId": f"r{k}", "asOfDate": d, "confidenceLevel": 0.1}) for k, d in enumerate(("2020-01-01", "2020-01-02", "soon"))]
    _, rejects = validate_requests(parse_requests(_raw(spark, lines + ["not json"]), "value", ["pos"]))
    import datetime
    days = [datetime.date(2020, 1, 1), datetime.date(2020, 1, 2), None]
    assert [store.append_rejects(rejects, path, as_of_dates=days) for _ in range(2)] == [4, 0]
    assert store.append_rejects(rejects, path) == 0
    assert store.read_committed(spark, path, store.REJECT_ROWS).filter("as_of_date is null").count() == 2


def _files(root, **texts):
    os.makedirs(root)
    for name, text in texts.items():
        with open(os.path.join(root, f"{name}.csv"), "w", encoding="utf-8") as f:
            f.write(text)
    return root


def test_position_files_are_read_by_their_own_header(spark, scratch):
    d = _files(os.path.join(scratch, "books"),
               a="portfolioId,ticker,quantity,assetClass\nP1,aaa,1,EQD\n",
               b="\ufeffticker,portfolioId,assetClass,quantity,delta\nBBB,P2,EQD,2,0.5\n\"C,C\",P2,FX,3,\n",
               c="QUANTITY , Comment,assetClass,Ticker,portfolioId\r\n4,\"x, y\",EQD,ddd,P3\r\n",
               d="", e="ticker,portfolioId,assetClass,quantity\n")
    rows = {(r.portfolio_id, r.ticker, r.quantity, r.asset_class, r.delta) for r in csv_src.read_position_csv(spark, d).collect()}
    assert rows == {("P1", "AAA", 1.0, "EQD", 1.0), ("P2", "BBB", 2.0, "EQD", 0.5), ("P2", "C,C", 3.0, "FX", 1.0), ("P3", "DDD", 4.0, "EQD", 1.0)}
    assert csv_src.position_rejects(spark, d).count() == 0
    for k, header in enumerate(("portfolioId,ticker,quantity", "portfolioId,ticker,quantity,assetClass,Ticker")):
        bad = _files(os.path.join(scratch, f"bad{k}"), good="portfolioId,ticker,quantity,assetClass\nP,A,1,EQD\n", bad=header + "\nP,A,1,EQD,A\n")
        with pytest.raises(ValueError, match="bad.csv"):
            csv_src.read_position_csv(spark, bad)


def test_price_files_are_read_by_their_own_header(spark, scratch):
    d = _files(os.path.join(scratch, "swapped"),
               x="Date,Ticker,Open,High,Low,Close,Volume,OpenInt\n2001-01-01,X,0,0,0,10.0,0,0\n",
               y="\ufeffClose,Date,Ticker\n11.5,2001-01-01,y\n")
    assert {tuple(r) for r in csv_src.read_price_csv(spark, d).select("ticker", "close").collect()} == {("X", 10.0), ("Y", 11.5)}
    with pytest.raises(ValueError, match="lacks column 'Date'"):
        csv_src.read_price_csv(spark, _files(os.path.join(scratch, "short"), x="Ticker,Close\nX,1\n"))


def test_price_scan_returns_rejects_from_one_scan(spark, scratch):
    d = _files(os.path.join(scratch, "faulty"),
               x="Ticker,Date,Close\nx,2001-01-01,10\nx,2001-01-01,11\nx,2001-01-02,abc\nx,2001-13-01,3\nx,2001-01-03,-1\n,2001-01-04,5\nx,2001-01-05,\nx,2001-01-06,NaN\n",
               y="Close,Ticker,Date\n7,y,2001-01-01\n")
    scan = csv_src.scan_price_csv(spark, d)
    assert {tuple(r) for r in scan.prices.select("ticker", "close").collect()} == {("X", 11.0), ("Y", 7.0)}
    got = sorted((r.ticker or "", str(r.date), r.value or "", r.reason, r.source_file.rsplit("/", 1)[1]) for r in scan.rejects.collect())
    why = tables.PRICE_FAULTS
    assert got == sorted([("X", "2001-01-01", "10", why["duplicate"], "x.csv"), ("X", "2001-01-02", "abc", why["close"], "x.csv"),
                          ("X", "None", "3", why["date"], "x.csv"), ("X", "2001-01-03", "-1", why["sign"], "x.csv"),
                          ("", "2001-01-04", "5", why["ticker"], "x.csv"), ("X", "2001-01-05", "", why["close"], "x.csv"),
                          ("X", "2001-01-06", "NaN", why["close"], "x.csv")])
    assert [f.name for f in scan.rejects.schema.fields] == [f.name for f in schemas.PRICE_REJECTS.fields]


def test_price_quality_counts_what_cleaning_drops(spark):
    rows = [("a", "2001-01-01", "1"), ("A", "2001-01-01", "2"), ("a", "2001-01-02", "x"), ("a", "2001-13-01", "1"), ("a", "2001-01-03", "-1"),
            (None, "2001-01-01", "1"), ("a", "2001-01-04", None), ("a", "2001-01-05", "3")]
    raw = spark.createDataFrame(rows, "ticker string, date string, close string")
    q = {r.ticker: r for r in tables.price_quality(raw).collect()}
    assert tuple(q["A"])[1:] == (7, 0, 1, 2, 1, 1) and tuple(q[None])[1:] == (1, 1, 0, 0, 0, 0)
    assert tables.clean_prices(raw).count() == 2


def test_a_cluster_session_needs_a_shared_checkpoint_folder(spark, monkeypatch):
    import pytest
    from riskspark import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
