"""Connected components by alternating large-star and small-star rounds.

Works on an edge table only: no link list, label table or component ever
reaches the driver. Each round is a groupBy-min (map-side combined) and an
equi-join that Spark may split on skewed hubs; its result is written to the
shared folder, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v): every neighbour is hung below the minimum."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = both.join(low, "u")
    if large:
        out = hung.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = (hung.select(F.col("v").alias("u"), F.col("m").alias("v"))
               .unionByName(low.select("u", F.col("m").alias("v"))))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``; component = smallest node.

    Self links and repeated links are ignored, NULL ends are dropped. Nodes
    without a link to another node do not appear. Raises if ``max_rounds``
    rounds (enough for chains of 2^max_rounds nodes) do not converge.
    """
    cur = stage(edges.where("u is not null and v is not null and u <> v")
                .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    for _ in range(max_rounds):
        mark = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        if not mark[0]:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = mark
        cur = stage(_star(_star(cur, True), False), "star")
    raise RuntimeError("connected components did not converge")
