"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

1. Rows fall into blocks by a hash of their content (so a lost task recomputes
   the same blocks) and are permuted inside their block.
2. How many rows of each block go to each shard is drawn exactly: block after
   block, shard after shard, a hypergeometric count given what is left. The matrix
   has blocks x shards cells, whatever the number of rows; every column adds up
   to its shard's size.
3. A block's permuted rows are cut by its line of the matrix, exchanged, and
   permuted again inside their shard, in parts that are numbered in parallel.

DataFrame functions only; all draws are hashes of the seed, so the result does
not depend on the cluster's layout.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.common import stage

ROWS_PER_BLOCK = 50_000
BLOCKS = (64, 4096)      # least and most blocks


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 11, carried back by ten factors."""
    z = n + 11.0
    factors = F.lit(1.0)
    for i in range(1, 11):
        factors = factors * (n + float(i))
    return ((z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + 1.0 / (12.0 * z)
            - 1.0 / (360.0 * z * z * z) + 1.0 / (1260.0 * F.pow(z, F.lit(5.0))) - F.ln(factors))


def _log_choose(n: Column, k: Column) -> Column:
    return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """Count of ``good`` among ``draws`` rows of ``total``, by inversion of the uniform ``u``.

    The search leaves the mode in both directions, so it takes about one
    standard deviation of steps; twelve deviations hold all mass a double can see.
    """
    def search(v: Column) -> Column:
        t, g, n = v["t"], v["g"], v["n"]
        low = F.greatest(F.lit(0.0), n + g - t)
        high = F.least(n, g)
        spread = F.sqrt(n * (g / t) * (1.0 - g / t) * (t - n) / F.greatest(t - 1.0, F.lit(1.0)))
        steps = F.least(high - low, F.ceil(spread * 12.0) + 30.0)
        mode = F.least(high, F.greatest(low, F.floor((n + 1.0) * (g + 1.0) / (t + 2.0)).cast("double")))

        def state(left: Column, up: Column, up_p: Column, down: Column, down_p: Column, found: Column) -> Column:
            return F.struct(left.alias("left"), up.alias("up"), up_p.alias("up_p"), down.alias("down"),
                            down_p.alias("down_p"), found.alias("found"))

        def start(m: Column) -> Column:
            p = F.exp(_log_choose(g, m) + _log_choose(t - g, n - m) - _log_choose(t, n))
            return _let(p, lambda q: state(v["u"] - q, m, q, m, q, F.when(v["u"] < q, m)))

        def outwards(a: Column, _: Column) -> Column:
            up_p = F.when(a["up"] < high, a["up_p"] * (g - a["up"]) * (n - a["up"])
                          / ((a["up"] + 1.0) * (t - g - n + a["up"] + 1.0))).otherwise(0.0)
            down_p = F.when(a["down"] > low, a["down_p"] * a["down"] * (t - g - n + a["down"])
                            / ((g - a["down"] + 1.0) * (n - a["down"] + 1.0))).otherwise(0.0)
            nxt = F.struct(up_p.alias("u"), down_p.alias("d"))
            moved = _let(nxt, lambda q: state(
                a["left"] - q["u"] - q["d"], a["up"] + 1.0, q["u"], a["down"] - 1.0, q["d"],
                F.when((q["u"] > 0) & (a["left"] < q["u"]), a["up"] + 1.0)
                .when((q["d"] > 0) & (a["left"] < q["u"] + q["d"]), a["down"] - 1.0)))
            return F.when(a["found"].isNotNull(), a).otherwise(moved)

        walked = F.aggregate(F.sequence(F.lit(0), F.greatest(steps, F.lit(0.0)).cast("int")), _let(mode, start), outwards)
        return _let(walked, lambda w: F.coalesce(w["found"], mode))

    args = F.struct(total.cast("double").alias("t"), good.cast("double").alias("g"), draws.cast("double").alias("n"), u.alias("u"))
    return (F.when(draws <= 0, F.lit(0)).when(good <= 0, F.lit(0)).when(good >= total, draws)
            .when(draws >= total, good).otherwise(_let(args, search)).cast("long"))


def communication_matrix(counts: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """(block, ends): per block, the running number of its rows up to each shard.

    ``counts(block, n)`` has one row per block (at most ``BLOCKS[1]``).
    """
    lines = counts.agg(F.sort_array(F.collect_list(F.struct(F.col("block").cast("long").alias("block"), F.col("n").cast("long").alias("n")))).alias("lines"))
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    quota = F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)),
                        lambda s: (F.floor(F.col("total") / n_shards) + F.when(s < F.col("total") % n_shards, 1).otherwise(0)).cast("long"))

    def uniform(block: Column, shard: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("matrix"), block, shard), 11).cast("double") * 2.0 ** -53

    def line(acc: Column, b: Column) -> Column:
        def cell(x: Column, s: Column) -> Column:
            good = F.element_at(acc["quota"], s + 1)
            drawn = hypergeometric(x["total"], good, x["n"], uniform(b["block"], s))
            return _let(drawn, lambda k: F.struct((x["total"] - good).alias("total"), (x["n"] - k).alias("n"),
                                                  F.concat(x["row"], F.array(k)).alias("row")))

        begin = F.struct(F.aggregate(acc["quota"], F.lit(0).cast("long"), lambda a, q: a + q).alias("total"), b["n"].alias("n"),
                         F.expr("cast(array() as array<bigint>)").alias("row"))
        drawn = F.aggregate(F.sequence(F.lit(0), F.lit(n_shards - 1)), begin, cell, lambda x: x["row"])
        return _let(drawn, lambda row: F.struct(F.zip_with(acc["quota"], row, lambda q, k: q - k).alias("quota"),
                                                F.concat(acc["rows"], F.array(F.struct(b["block"].alias("block"), row.alias("row")))).alias("rows")))

    begin = F.struct(F.col("quota"), F.expr("cast(array() as array<struct<block: bigint, row: array<bigint>>>)").alias("rows"))
    drawn = (lines.withColumn("total", total).withColumn("quota", quota)
             .select(F.explode(F.aggregate("lines", begin, line, lambda a: a["rows"])).alias("r")))
    ends = F.transform(F.sequence(F.lit(1), F.lit(n_shards)),
                       lambda s: F.aggregate(F.slice(F.col("r.row"), F.lit(1), s), F.lit(0).cast("long"), lambda a, k: a + k))
    return drawn.select(F.col("r.block").cast("int").alias("block"), ends.alias("ends"))


def shuffle_into_shards(rows: DataFrame, n_shards: int, seed: int = 42, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """``rows`` with ``shard`` (0..n_shards-1) and ``slot`` (gapless from 0 in each shard).

    Shard sizes differ by one at most; every assignment and every order is
    equally likely over the seeds. Columns of ``rows`` called shard or slot are
    replaced; very long rows are exchanged like any other. Repeated rows are interchangeable and each get
    their own place; NULLs hash like any value; an empty table stays empty. Only
    hashes are read to draw and count; the whole rows are exchanged twice, once
    for each permutation. ``rows`` must read the same each time (a stored table).
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    cols = [F.col(f"`{c}`") for c in rows.columns]
    packed = rows.select(F.struct(*cols).alias("row"), *[
        F.xxhash64(F.lit(seed), F.lit(what), *cols).alias(name) for what, name in (("block", "h1"), ("local", "h2"), ("slot", "h3"))])
    n_rows = packed.count()
    n_blocks = min(BLOCKS[1], max(BLOCKS[0], 2 ** math.ceil(math.log2(max(1, n_rows / rows_per_block)))))
    blocks = packed.withColumn("block", F.pmod("h1", F.lit(n_blocks)).cast("int"))
    matrix = stage(communication_matrix(blocks.groupBy("block").agg(F.count("*").alias("n")), n_shards, seed), "shard_matrix")
    local = F.row_number().over(Window.partitionBy("block").orderBy("h2", "h3")) - 1
    cut = blocks.withColumn("at", local).join(F.broadcast(matrix), "block")
    shard = F.size(F.filter("ends", lambda e: e <= F.col("at")))
    sent = cut.select("row", "h3", shard.cast("int").alias("shard"), F.pmod(F.xxhash64("h3"), F.lit(n_blocks)).cast("int").alias("part"))
    parts = stage(sent.groupBy("shard", "part").agg(F.count("*").alias("n")), "shard_parts")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    again = F.row_number().over(Window.partitionBy("shard", "part").orderBy("h3")) - 1
    return (sent.withColumn("at", again).join(F.broadcast(base), ["shard", "part"])
            .select(*[F.col(f"row.`{c}`") for c in rows.columns if c.lower() not in ("shard", "slot")], "shard", (F.col("base") + F.col("at")).cast("long").alias("slot")))


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order inside its files."""
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(path)
