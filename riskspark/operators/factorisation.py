"""Loadings of a covariance table: Sigma = L L' without the returns it came from.

A stored snapshot may hold nothing but ``(as_of_date, ti, tj, sigma)``. Its blocks of
``block`` x ``block`` factors are factored panel by panel. With the panel's diagonal
block ``A = V diag(lambda) V'`` and its eigenvalues above the rounding level kept,
``W = V lambda^(-1/2)`` gives the panel's columns of L for every block row below,
``L_i = A_i W``, and the rest of the matrix loses ``L_i L_j'``. A singular Sigma is
no error: dependent factors get fewer columns. One panel is one join per block row
and one per block of the rest, on block numbers; blocks are written between panels.

The loadings have the form of the scaled returns (``calibration.scaled_returns``)
with the column number in place of the date, so the scenario and variance operators
take them with ``periods_per_year = 1``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

BLOCK = 512          # factors of one block: 2 MB of doubles


def _pack(m: np.ndarray) -> bytes:
    return np.ascontiguousarray(m, dtype="<f8").tobytes()


def _matrix(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(rows, -1)


@F.pandas_udf(T.StructType([T.StructField("w", T.BinaryType()), T.StructField("rank", T.IntegerType())]))
def _root(a: pd.Series, n: pd.Series, noise: pd.Series) -> pd.DataFrame:
    """W of each diagonal block: L = A W has L L' = A but for eigenvalues up to ``noise``."""
    out = []
    for data, size, least in zip(a, n, noise):
        m = _matrix(data, int(size))
        values, vectors = np.linalg.eigh((m + m.T) / 2)
        keep = values > least
        out.append((_pack(vectors[:, keep] / np.sqrt(values[keep])), int(keep.sum())))
    return pd.DataFrame(out, columns=["w", "rank"])


@F.pandas_udf(T.BinaryType())
def _times(a: pd.Series, n: pd.Series, w: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([_pack(_matrix(x, int(r)) @ _matrix(y, int(k))) for x, r, y, k in zip(a, n, w, m)])


@F.pandas_udf(T.BinaryType())
def _less_product(a: pd.Series, n: pd.Series, left: pd.Series, right: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([_pack(_matrix(x, int(r)) - _matrix(p, int(r)) @ _matrix(q, int(k)).T)
                      for x, r, p, q, k in zip(a, n, left, right, m)])


def _block_of(names: DataFrame, block: int) -> DataFrame:
    """(as_of_date, ticker, b, at, size): each factor's block and place in it, in order of the names."""
    w = Window.partitionBy("as_of_date").orderBy("ticker")
    placed = names.select("as_of_date", "ticker", (F.row_number().over(w) - 1).alias("k"))
    placed = placed.select("as_of_date", "ticker", F.floor(F.col("k") / block).cast("int").alias("b"), (F.col("k") % block).cast("int").alias("at"))
    return placed.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("as_of_date", "b")).cast("int"))


def _dense(rows: pd.DataFrame) -> pd.DataFrame:
    n, m = int(rows["n"].iloc[0]), int(rows["m"].iloc[0])
    out = np.zeros((n, m))
    out[rows["ai"], rows["aj"]] = rows["sigma"]
    return pd.DataFrame({"as_of_date": [rows["as_of_date"].iloc[0]], "i": [rows["i"].iloc[0]], "j": [rows["j"].iloc[0]], "n": [n], "m": [m],
                         "a": [_pack(out)]})


def factor_loadings(cov: DataFrame, block: int = BLOCK) -> DataFrame:
    """(as_of_date, ticker, d, z) with sum_d z[i, d] z[j, d] = sigma[i, j] for every pair of ``cov``.

    ``cov(as_of_date, ti, tj, sigma)`` has both orders of every pair; a missing or
    NULL pair counts as 0. Factors without variance have no rows.
    """
    cov = cov.select("as_of_date", "ti", "tj", F.coalesce("sigma", F.lit(0.0)).alias("sigma"))
    places = cut_lineage(_block_of(cov.select("as_of_date", F.col("ti").alias("ticker")).distinct(), block))
    panels = (places.agg(F.max("b")).first()[0] or 0) + 1
    left = places.select("as_of_date", F.col("ticker").alias("ti"), F.col("b").alias("i"), F.col("at").alias("ai"), F.col("size").alias("n"))
    right = places.select("as_of_date", F.col("ticker").alias("tj"), F.col("b").alias("j"), F.col("at").alias("aj"), F.col("size").alias("m"))
    cells = cov.join(left, ["as_of_date", "ti"]).join(right, ["as_of_date", "tj"]).filter("i >= j")
    rest = cut_lineage(cells.select("as_of_date", "i", "j", "n", "m", "ai", "aj", "sigma").groupBy("as_of_date", "i", "j")
                       .applyInPandas(_dense, "as_of_date date, i int, j int, n int, m int, a binary"))
    # What is left of a dependent factor is rounding noise of the whole table's size.
    eps = 8.0 * float(np.finfo(float).eps)
    noise = cov.filter("ti = tj").groupBy("as_of_date").agg((F.max("sigma") * F.count(F.lit(1)) * eps).alias("noise"))
    columns = None
    for p in range(panels):
        root = (rest.filter((F.col("i") == p) & (F.col("j") == p)).join(noise, "as_of_date")
                .select("as_of_date", _root("a", "n", "noise").alias("r")).select("as_of_date", "r.*"))
        below = (rest.filter(F.col("j") == p).join(root, "as_of_date").filter("rank > 0")
                 .select("as_of_date", F.col("i"), "n", "rank", _times("a", "n", "w", "m").alias("l")))
        below = cut_lineage(below)
        mine = below.withColumn("panel", F.lit(p))
        columns = mine if columns is None else columns.unionByName(mine)
        if p + 1 < panels:
            up = below.select("as_of_date", "i", F.col("l").alias("li"), "rank")
            across = below.select("as_of_date", F.col("i").alias("j"), F.col("l").alias("lj"))
            rest = cut_lineage(rest.filter(F.col("j") > p).join(up, ["as_of_date", "i"], "left").join(across, ["as_of_date", "j"], "left")
                               .select("as_of_date", "i", "j", "n", "m",
                                       F.when(F.col("rank").isNull(), F.col("a")).otherwise(
                                           _less_product("a", "n", F.coalesce("li", F.lit(b"")), F.coalesce("lj", F.lit(b"")),
                                                         F.col("m"))).alias("a")))
    return _long(columns, places, block)


def _long(columns: DataFrame, places: DataFrame, block: int) -> DataFrame:
    """The blocks of L as (as_of_date, ticker, d, z); zeros left out."""
    def run(batches):
        for b in batches:
            for as_of, i, n, panel, data in zip(b["as_of_date"], b["i"], b["n"], b["panel"], b["l"]):
                m = _matrix(data, int(n))
                at, k = np.nonzero(m)
                yield pd.DataFrame({"as_of_date": as_of, "b": i, "at": at.astype("int32"), "d": (k + panel * block).astype("int32"), "z": m[at, k]})

    cells = columns.select("as_of_date", "i", "n", "panel", "l").mapInPandas(run, "as_of_date date, b int, at int, d int, z double")
    return cells.join(places.select("as_of_date", "ticker", "b", "at"), ["as_of_date", "b", "at"]).select("as_of_date", "ticker", "d", "z")


def covariance_from_loadings(loadings: DataFrame) -> DataFrame:
    """(as_of_date, ti, tj, sigma) of the factorisation, to check it against its table."""
    from .calibration import factor_pairs

    return factor_pairs(loadings).select("as_of_date", "ti", "tj", F.col("s").alias("sigma"))
