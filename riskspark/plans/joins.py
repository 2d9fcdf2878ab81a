"""Join strategies for the factor-level sides of the scenario joins.

The scenario joins pair a large side (paths or scenarios x factors) with a
factor-level side (a return matrix, or exposures per book and factor) on a key
that has few distinct values (the factor). Two strategies:

* ``broadcast`` when the small side's row count — measured on a materialised
  copy, so it is exact — is under ``riskspark.broadcast.maxRows`` and its size
  by row width under ``riskspark.broadcast.maxBytes``: the large
  side streams through without a shuffle and keeps its partitioning;
* ``salted`` otherwise: each key is split into ``riskspark.join.saltBuckets``
  sub-keys — large-side rows go to the bucket of their scenario id, small-side
  rows are copied into every bucket — so one hot factor (held by every book)
  is spread over that many tasks instead of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_BROADCAST_ROWS = 2_000_000
DEFAULT_MAX_BROADCAST_BYTES = 256 << 20
DEFAULT_SALT_BUCKETS = 32
# Bytes a value takes in a broadcast table, roughly; anything else counts as text.
_WIDTHS = {"boolean": 8, "tinyint": 8, "smallint": 8, "int": 8, "bigint": 8, "float": 8, "double": 8, "date": 8, "timestamp": 8, "timestamp_ntz": 8}


def conf_int(spark, key: str, default: int) -> int:
    return int(spark.conf.get(key, str(default)))


def max_broadcast_rows(spark) -> int:
    return conf_int(spark, "riskspark.broadcast.maxRows", DEFAULT_MAX_BROADCAST_ROWS)


def may_broadcast(df: DataFrame, rows: int | None) -> bool:
    """Whether a table of exactly ``rows`` rows is under both broadcast limits
    (``riskspark.broadcast.maxRows`` and ``.maxBytes``)."""
    if rows is None:
        return False
    spark = df.sparkSession
    width = 16 + sum(_WIDTHS.get(t, 64) for _, t in df.dtypes)
    return (rows <= max_broadcast_rows(spark)
            and rows * width <= conf_int(spark, "riskspark.broadcast.maxBytes", DEFAULT_MAX_BROADCAST_BYTES))


def salt_buckets(spark) -> int:
    return conf_int(spark, "riskspark.join.saltBuckets", DEFAULT_SALT_BUCKETS)


def salted_join(large: DataFrame, small: DataFrame, on: list[str], spread_by: Column, buckets: int) -> DataFrame:
    """Inner equi-join on ``on`` with every key split into ``buckets`` sub-keys:
    ``large`` rows go to bucket ``spread_by mod buckets``, ``small`` rows are
    copied into every bucket."""
    lg = large.withColumn("_salt", F.pmod(spread_by.cast("long"), F.lit(buckets)))
    sm = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))
    return lg.join(sm, [*on, "_salt"]).drop("_salt")


def factor_join(left: DataFrame, right: DataFrame, on: list[str], left_spread: Column,
                right_rows: int | None, left_rows: int | None = None,
                right_spread: Column | None = None, right_cluster: list[str] | None = None) -> DataFrame:
    """Inner join of a scenario-side table (``left``) with a factor-level table.

    Row counts are exact sizes of materialised inputs (None = unknown, taken
    as large). A side under the broadcast limit is broadcast (the right side
    first, so the left keeps its partitioning); otherwise the larger side is
    salted by its spread column and the smaller one copied into each bucket.
    With no size known at all the optimizer and AQE decide. When the left side
    is broadcast, ``right_cluster`` hash-partitions the streamed right side
    first (e.g. by book, so that every later aggregate or window on that key
    runs in place).
    """
    spark = left.sparkSession
    if right_rows is None and left_rows is None:
        return left.join(right, on)
    if may_broadcast(right, right_rows):
        return left.join(F.broadcast(right), on)
    if may_broadcast(left, left_rows):
        streamed = right.repartition(*right_cluster) if right_cluster else right
        return F.broadcast(left).join(streamed, on)
    buckets = salt_buckets(spark)
    if right_spread is not None and left_rows is not None and right_rows is not None and right_rows > left_rows:
        return salted_join(right, left, on, right_spread, buckets)
    return salted_join(left, right, on, left_spread, buckets)
