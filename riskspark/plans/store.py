"""Result and calibration stores: sinks (append, JSON messages, fan-out) and lookups.

Stored results are a Parquet table partitioned by ``as_of_date`` and ``commit_id``,
one row per portfolio per request; stored calibrations are partitioned by
``result_date`` (the day of ``ts``) and ``commit_id``, one row per factor and run.

Appends are commits: a run's rows are written first, under a commit id of their
own, and one manifest row (run id, commit id, row count) after them. Readers see
the rows of commits in the manifest only (``read_committed``), so a job that dies
in between leaves nothing visible, and its retry writes under another commit id.
A run id that is in the manifest already is a replay: nothing is computed and
nothing written. The plan that makes the rows runs once per append.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass
from typing import Callable, Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..session import cut_lineage
from .joins import may_broadcast


def _ts(ts) -> Column:
    """Write time as TIMESTAMP_NTZ (session-zone wall clock; UTC on a UTC session)."""
    return F.localtimestamp() if ts is None else F.lit(ts).cast("timestamp_ntz")


def results_rows(results: DataFrame, ts=None) -> DataFrame:
    """Stored-result rows: ids and method as text, ``as_of_date`` as yyyy-MM-dd
    text, a server timestamp ``ts`` and its day ``result_date`` (partition key)."""
    t = _ts(ts)
    return results.select(
        "correlation_id", "portfolio_id", F.date_format("as_of_date", "yyyy-MM-dd").alias("as_of_date"),
        "method", "var_amount", "expected_shortfall", "alpha", "mean_pnl", "std_dev_pnl",
        F.col("num_scenarios").cast("int").alias("num_scenarios"),
        t.alias("ts"), F.to_date(t).alias("result_date"))


def calibration_rows(vols: DataFrame, ts=None) -> DataFrame:
    """Stored-calibration rows (as_of_date text, ticker, volatility, ts, result_date)."""
    t = _ts(ts)
    return vols.select(F.date_format("as_of_date", "yyyy-MM-dd").alias("as_of_date"), "ticker",
                       F.col("vol").alias("volatility"), t.alias("ts"), F.to_date(t).alias("result_date"))


def table_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)  # Hadoop FS check, works for any shared store
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(jvm_path)


# ---------------------------------------------------------------------------
# Commits
# ---------------------------------------------------------------------------

MANIFEST = "run_id string, commit_id string, seq long, n_rows long"


def _manifest(spark: SparkSession, path: str) -> DataFrame | None:
    commits = f"{path.rstrip('/')}-commits"
    return spark.read.schema(MANIFEST).parquet(commits) if table_exists(spark, commits) else None


def is_committed(spark: SparkSession, path: str, run_id: str) -> bool:
    """Whether the run's rows are in the table at ``path``."""
    manifest = _manifest(spark, path)
    return manifest is not None and not manifest.filter(F.col("run_id") == run_id).isEmpty()


def _write_manifest(spark: SparkSession, path: str, row: tuple) -> None:
    """One file with one row: it becomes visible whole or not at all."""
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}-commits")


def append_run(rows: DataFrame, path: str, partition_by: str, run_id: str | None = None) -> int | None:
    """Append ``rows`` as one commit; returns their number, or None for a run that is committed already.

    Without a ``run_id`` every append is a run of its own. ``rows`` is computed
    once; its size is observed by the write.
    """
    spark = rows.sparkSession
    if run_id is not None and is_committed(spark, path, run_id):
        return None
    commit, seq, seen = uuid.uuid4().hex, time.time_ns(), Observation()
    (rows.withColumns({"run_id": F.lit(run_id or commit), "seq": F.lit(seq), "commit_id": F.lit(commit)})
     .observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy(partition_by, "commit_id").parquet(path))
    n = int(seen.get["n"])
    _write_manifest(spark, path, (run_id or commit, commit, seq, n))
    return n


def read_committed(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The rows of committed runs. ``schema`` names the columns of a table that may hold no row yet.

    The manifest has one row per run; it is broadcast behind a size check, so the
    scan skips the partitions of other commits.
    """
    manifest = _manifest(spark, path)
    data = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if manifest is None:
        return data.filter(F.lit(False))
    ids = manifest.select("commit_id")
    if may_broadcast(ids, ids.count()):
        ids = F.broadcast(ids)
    return data.join(ids, "commit_id", "left_semi")


RESULT_ROWS = ("correlation_id string, portfolio_id string, method string, var_amount double, expected_shortfall double, alpha double, "
               "mean_pnl double, std_dev_pnl double, num_scenarios int, ts timestamp_ntz, result_date date, run_id string, seq long, "
               "as_of_date string, commit_id string")
REJECT_ROWS = ("correlation_id string, error_code string, violations array<struct<field: string, message: string>>, as_of_raw string, "
               "raw_payload string, epoch_id long, run_id string, seq long, as_of_date date, commit_id string")
CALIBRATION_ROWS = ("as_of_date string, ticker string, volatility double, ts timestamp_ntz, run_id string, seq long, result_date date, "
                    "commit_id string")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Committed result rows."""
    return read_committed(spark, path, RESULT_ROWS).drop("commit_id", "run_id", "seq")


def read_calibrations(spark: SparkSession, path: str) -> DataFrame:
    """Committed calibration rows; ``seq`` orders runs of one ``ts``."""
    return read_committed(spark, path, CALIBRATION_ROWS).drop("commit_id")


def _on(dates, column: str) -> Column:
    """Rows of the given days (a calendar-bounded list that may hold None); all rows without a list."""
    if dates is None:
        return F.lit(True)
    known, day = [d for d in dates if d is not None], F.col(column).cast("date")
    hit = day.isin(known) if known else F.lit(False)
    return hit | day.isNull() if len(known) < len(dates) else hit


def request_set_id(requests: DataFrame) -> str:
    """An id of a set of requests that depends on their content only (one small aggregate)."""
    h = F.xxhash64(*[F.col(c).cast("string") for c in sorted(requests.columns)])
    row = requests.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first()
    return "-".join(str(v) for v in row)


def append_results(results: DataFrame, path: str, ts=None, skip_existing: bool = True, run_id: str | None = None,
                   as_of_dates=None) -> int | None:
    """Append results as one commit, without (correlation_id, portfolio_id) pairs that committed runs hold.

    ``as_of_dates`` (the days of the requests, where the caller knows them) lets
    that comparison read those partitions of the store only.
    """
    spark = results.sparkSession
    if run_id is not None and is_committed(spark, path, run_id):
        return None
    if skip_existing and table_exists(spark, path):
        stored = read_results(spark, path).filter(_on(as_of_dates, "as_of_date")).select("correlation_id", "portfolio_id")
        results = results.join(stored, ["correlation_id", "portfolio_id"], "left_anti")
    return append_run(results_rows(results, ts), path, "as_of_date", run_id)


def append_rejects(rejects: DataFrame, path: str, run_id: str | None = None, as_of_dates=None) -> int | None:
    """Append rejected requests as one commit, without correlation ids that are recorded already.

    The store is partitioned by the requests' days (NULL where they name none).
    """
    spark = rejects.sparkSession
    if run_id is not None and is_committed(spark, path, run_id):
        return None
    rows = rejects.withColumn("as_of_date", F.to_date(F.try_to_timestamp("as_of_raw", F.lit("yyyy-MM-dd"))))
    if "epoch_id" not in rows.columns:
        rows = rows.withColumn("epoch_id", F.lit(None).cast("long"))
    if table_exists(spark, path):
        stored = read_committed(spark, path, REJECT_ROWS).filter(_on(as_of_dates, "as_of_date")).select("correlation_id")
        rows = rows.join(stored, "correlation_id", "left_anti")
    return append_run(rows.withColumn("epoch_id", F.col("epoch_id").cast("long")), path, "as_of_date", run_id)


def append_calibration(vols: DataFrame, path: str, ts=None, run_id: str | None = None) -> int | None:
    """Append one run's volatilities, whatever values are stored: a value that comes back is a new version."""
    return append_run(calibration_rows(vols, ts), path, "result_date", run_id)


def write_snapshot(calibration, path: str) -> str:
    """Store vols, correlations and returns of a calibration, so that a saved one can run any method."""
    calibration.vols.write.parquet(f"{path}/vols")
    calibration.corr.write.parquet(f"{path}/corr")
    calibration.returns.write.parquet(f"{path}/factor_returns")
    return path


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(corr, vols) of a stored calibration; its returns are in ``<path>/factor_returns``."""
    return spark.read.parquet(f"{path}/corr"), spark.read.parquet(f"{path}/vols")


def results_json(results: DataFrame) -> DataFrame:
    """(key, value) messages: key = correlation id, value = JSON with the
    published field names (no scenario count)."""
    body = F.struct(
        F.col("correlation_id").alias("correlationId"), F.col("portfolio_id").alias("portfolioId"),
        F.date_format("as_of_date", "yyyy-MM-dd").alias("asOfDate"), F.col("method"),
        F.col("var_amount").alias("varAmount"), F.col("expected_shortfall").alias("expectedShortfall"),
        F.col("alpha"), F.col("mean_pnl").alias("meanPnL"), F.col("std_dev_pnl").alias("stdDevPnL"))
    return results.select(F.col("correlation_id").alias("key"), F.to_json(body).alias("value"))


def publish_kafka(results: DataFrame, bootstrap_servers: str, topic: str = "var-results") -> None:
    """Write result messages to a Kafka topic (needs the spark-sql-kafka package)."""
    (results_json(results).write.format("kafka")
     .option("kafka.bootstrap.servers", bootstrap_servers).option("topic", topic).save())


def write_json_messages(results: DataFrame, path: str) -> None:
    """File stand-in for the message sink: one JSON line per result."""
    results_json(results).select("value").write.mode("append").text(path)


def fan_out(results: DataFrame, sinks: Iterable[Callable[[DataFrame], None]]) -> None:
    """Hand the same results to every sink; computed once (cached, rebuilt from
    lineage if an executor is lost), then released."""
    cached = cut_lineage(results, durable=False)
    try:
        for sink in sinks:
            sink(cached)
    finally:
        cached.unpersist()


def publish_pending(stored: DataFrame, name: str, sink: Callable[[DataFrame], None], marker_path: str) -> None:
    """Hand a sink the stored results it has not had yet, then mark them.

    Every sink keeps its own marks, so a sink that failed after the results were
    stored gets them on the next try, and a sink that succeeded gets nothing
    twice (unless the job dies between the sink and its mark).
    """
    spark, path = stored.sparkSession, f"{marker_path.rstrip('/')}/{name}"
    if table_exists(spark, path):
        stored = stored.join(spark.read.parquet(path), ["correlation_id", "portfolio_id"], "left_anti")
    pending = cut_lineage(stored, durable=False)
    try:
        if not pending.isEmpty():
            sink(pending)
            pending.select("correlation_id", "portfolio_id").write.mode("append").parquet(path)
    finally:
        pending.unpersist()


# ---------------------------------------------------------------------------
# Lookups
# ---------------------------------------------------------------------------

def _write_order(calibrations: DataFrame) -> Column:
    """When a row was written: its time, and the order of runs of one time where the table has it."""
    return F.struct("ts", *([F.col("seq")] if "seq" in calibrations.columns else []))


def latest_calibration(calibrations: DataFrame, as_of_date=None, known_at=None) -> DataFrame:
    """(as_of_date, ticker, volatility): the newest stored vol per factor; restricted to one
    as-of date, and to what had been written at ``known_at``, when given."""
    c = calibrations
    if as_of_date is not None:
        c = c.filter(F.col("as_of_date") == F.lit(str(as_of_date)))
    if known_at is not None:
        c = c.filter(F.col("ts") <= F.lit(str(known_at)).cast("timestamp_ntz"))
    return c.groupBy("as_of_date", "ticker").agg(F.max_by("volatility", _write_order(c)).alias("volatility"))


def calibration_versions(calibrations: DataFrame) -> DataFrame:
    """(as_of_date, ticker, volatility, valid_from, valid_to): every stored version and the times between
    which it was the newest (``valid_to`` NULL: still is).

    A group holds the versions of one factor and date, one per run.
    """
    w = Window.partitionBy("as_of_date", "ticker").orderBy(_write_order(calibrations))
    return calibrations.select("as_of_date", "ticker", "volatility", F.col("ts").alias("valid_from"), F.lead("ts").over(w).alias("valid_to"))


def query_results(stored: DataFrame, portfolio_id: str | None = None, date_from=None, date_to=None,
                  method: str | None = None) -> DataFrame:
    """Stored results filtered like the results endpoint, newest first.

    Filters are optional: portfolio equality, ``date_from <= as_of_date <=
    date_to`` and method equality (input upper-cased). NULL numbers read as 0.
    """
    q = stored
    as_of = F.to_date(F.col("as_of_date"))
    if portfolio_id is not None:
        q = q.filter(F.col("portfolio_id") == portfolio_id)
    if date_from is not None:
        q = q.filter(as_of >= F.lit(str(date_from)).cast("date"))
    if date_to is not None:
        q = q.filter(as_of <= F.lit(str(date_to)).cast("date"))
    if method is not None:
        q = q.filter(F.col("method") == method.upper())
    num = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    return (q.orderBy(F.col("ts").desc())
            .select("correlation_id", "portfolio_id", F.col("as_of_date").cast("string").alias("as_of_date"), "method", num("var_amount"),
                    num("expected_shortfall"), num("alpha"), num("mean_pnl"), num("std_dev_pnl"),
                    F.col("num_scenarios").cast("int").alias("num_scenarios")))


@dataclass(frozen=True)
class Repository:
    """Where the tables of one deployment are; lookups read them through it."""
    results: str
    calibrations: str
    positions: str

    def query_results(self, spark: SparkSession, **filters) -> DataFrame:
        return query_results(read_results(spark, self.results), **filters)

    def latest_calibration(self, spark: SparkSession, as_of_date=None, known_at=None) -> DataFrame:
        return latest_calibration(read_calibrations(spark, self.calibrations), as_of_date, known_at)

    def portfolio(self, spark: SparkSession, portfolio_id: str | None = None) -> DataFrame:
        return portfolio_lookup(spark.read.parquet(self.positions), portfolio_id)

    def save(self, results: DataFrame, vols: DataFrame, ts=None, run_id: str | None = None) -> None:
        """Append one run's results and volatilities; a ``run_id`` makes it replay-safe."""
        append_results(results, self.results, ts, run_id=run_id)
        append_calibration(vols, self.calibrations, ts, run_id)


def portfolio_lookup(positions: DataFrame, portfolio_id: str | None = None) -> DataFrame:
    """Positions of one book (or all books)."""
    return positions if portfolio_id is None else positions.filter(F.col("portfolio_id") == portfolio_id)
