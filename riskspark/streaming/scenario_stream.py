"""Structured Streaming: scenario requests in, VaR results out.

Source: a message topic (Kafka, ``startingOffsets=earliest``) or a directory of
JSON-lines files (the same payloads, one request per line). Each micro-batch
is decoded (``parse_requests``), validated, and run as one
``run_scenarios`` job inside ``foreachBatch``; results and rejects are
appended to their stores, and result messages can be produced as JSON.

A request that names its files (``portfolioCsvPath``, ``pricesCsvPath``) runs on
them; one without runs on the stream's default tables. A request that cannot be
run becomes a reject row, the others go on.

Replay: the stream checkpoint records which offsets/files were done, and the
result append skips (correlation_id, portfolio_id) pairs already stored, so a
batch that is retried after a failure, or a message delivered twice with the same
id, never duplicates results: a run is a commit named by its requests, and what a
killed job wrote without committing is never read. Other sinks are fed from the store, each with its
own marks: one that failed gets its results on the retry, one that succeeded
gets none twice. Ids not given in the payload are derived from the message
position and payload (topic, partition and offset; or file path), which are
stable under replay.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators.validation import validate_requests
from ..plans import store
from ..plans.pipeline import ScenarioRun, run_isolated, run_path_groups, run_scenarios, split_failed
from ..session import cut_lineage
from ..sources.requests import parse_requests


def kafka_requests(spark: SparkSession, bootstrap_servers: str, topic: str = schemas.REQUEST_TOPIC,
                   group_id: str | None = None) -> DataFrame:
    """Streaming requests from a Kafka topic (needs the spark-sql-kafka package)."""
    reader = (spark.readStream.format("kafka")
              .option("kafka.bootstrap.servers", bootstrap_servers)
              .option("subscribe", topic)
              .option("startingOffsets", "earliest"))
    if group_id:
        reader = reader.option("kafka.group.id", group_id)
    raw = reader.load().select(F.col("value").cast("string").alias("value"), "topic", "partition", "offset")
    return parse_requests(raw, "value", ["topic", "partition", "offset"])


def file_requests(spark: SparkSession, directory: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming requests from JSON-lines files dropped into ``directory``."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.load(directory).select(F.col("value"), F.col("_metadata.file_path").alias("file_path"))
    raw = raw.filter(F.length(F.trim("value")) > 0)
    return parse_requests(raw, "value", ["file_path"])


@dataclass
class ScenarioSink:
    """Where a stream's batches go. ``results_path`` and ``rejects_path`` are
    Parquet tables; ``messages_path`` (optional) receives JSON result lines;
    ``extra`` sinks get the results DataFrame of every batch."""
    results_path: str
    rejects_path: str
    messages_path: str | None = None
    calibration_path: str | None = None
    price_rejects_path: str | None = None
    extra: list[Callable[[DataFrame], None]] = field(default_factory=list)


def batch_handler(positions: DataFrame | None, prices: DataFrame | None, sink: ScenarioSink,
                  periods_per_year: float = schemas.DEFAULT_PERIODS_PER_YEAR, pricer: str | None = None):
    """foreachBatch function: one scenario job per micro-batch for the default tables, one for all named files.

    A request that fails, on the default tables too, becomes a reject row; so do
    portfolios whose figures are not numbers.
    """
    def handle(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        dates = [r[0] for r in batch.select("as_of_date").distinct().collect()]
        failures: list[DataFrame] = []

        def keep(run: ScenarioRun) -> None:
            # The id comes from the requests' content: the same requests sent again are the same run.
            run_id = store.request_set_id(run.valid)
            known = [d for d in dates if d is not None]
            results, failed = split_failed(cut_lineage(run.results))       # computed once, read for both
            store.append_results(results, sink.results_path, run_id=run_id, as_of_dates=known)
            if sink.calibration_path:
                vols = run.calibration.vols
                if "source_set" in run.valid.columns:
                    vols = vols.withColumn("ticker", schemas.unscoped("ticker"))
                store.append_calibration(vols, sink.calibration_path, run_id=run_id)
            failures.append(failed)

        def default_run(part: DataFrame) -> None:
            run = run_scenarios(part, positions, prices, periods_per_year, pricer=pricer)
            try:
                keep(run)
            finally:
                run.release()

        named = F.length(F.trim(F.coalesce("portfolio_csv_path", F.lit("")))) > 0
        own_files, default = batch.filter(named), batch.filter(~named)
        if positions is None or prices is None:
            own_files, default = batch, None
        outcome = run_path_groups(spark, own_files, keep, periods_per_year)
        rejects = outcome.rejects
        if default is not None:
            valid, invalid = validate_requests(default)
            rejects = rejects.unionByName(invalid).unionByName(run_isolated(valid.dropDuplicates(["correlation_id"]), default_run))
        for failed in failures:
            rejects = rejects.unionByName(failed)
        store.append_rejects(rejects.withColumn("epoch_id", F.lit(epoch_id)), sink.rejects_path, as_of_dates=dates)
        if sink.price_rejects_path and outcome.price_rejects is not None:
            store.append_run(outcome.price_rejects, sink.price_rejects_path, "reason", store.request_set_id(own_files))
        if store.table_exists(spark, sink.results_path):
            stored = (store.read_results(spark, sink.results_path).filter(F.col("as_of_date").cast("date").isin([d for d in dates if d]))
                      .join(batch.select("correlation_id").distinct(), "correlation_id", "left_semi")
                      .withColumn("as_of_date", F.col("as_of_date").cast("date")).select(*schemas.RESULT_COLUMNS))
            sinks = [("messages", lambda r: store.write_json_messages(r, sink.messages_path))] if sink.messages_path else []
            sinks += [(f"extra-{k}", f) for k, f in enumerate(sink.extra)]
            for name, write in sinks:
                store.publish_pending(stored, name, write, f"{sink.results_path.rstrip('/')}-published")
        batch.unpersist()

    return handle


def start_scenario_stream(requests: DataFrame, positions: DataFrame | None, prices: DataFrame | None, sink: ScenarioSink,
                          checkpoint_location: str, periods_per_year: float = schemas.DEFAULT_PERIODS_PER_YEAR,
                          available_now: bool = False, processing_time: str | None = None, pricer: str | None = None) -> StreamingQuery:
    """Start the request stream. ``available_now=True`` drains what is there
    and stops (batch-style scheduling); otherwise it runs on ``processing_time``."""
    writer = (requests.writeStream.foreachBatch(batch_handler(positions, prices, sink, periods_per_year, pricer))
              .option("checkpointLocation", checkpoint_location))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
