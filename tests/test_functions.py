"""Column functions: inverse normal, density, hashed normals, pricing."""

import math
from statistics import NormalDist

from pyspark.sql import functions as F

from riskspark.functions.normal import hashed_normal, norm_pdf, norm_ppf
from riskspark.functions.pricing import exposure_columns, exposure_pnl, pnl_auto, pnl_delta_gamma, pnl_linear
from riskspark.functions.rounding import round_half_away


def test_norm_ppf_matches_python(spark):
    ps = [1e-10, 1e-5, 0.001, 0.01, 0.05, 0.1, 0.3, 0.5, 0.5 + 1e-9, 0.7, 0.9, 0.95, 0.975, 0.99, 0.9999, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = {r.p: r.z for r in df.select("p", norm_ppf("p").alias("z")).collect()}
    nd = NormalDist()
    for p in ps:
        assert abs(got[p] - nd.inv_cdf(p)) <= 1e-12 * max(1.0, abs(nd.inv_cdf(p))), p


def test_norm_ppf_outside_unit_interval_is_null(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (-0.5,), (1.5,)], "p double")
    assert all(r.z is None for r in df.select(norm_ppf("p").alias("z")).collect())


def test_norm_pdf(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (-2.5,)], "z double")
    for r in df.select("z", norm_pdf("z").alias("d")).collect():
        assert abs(r.d - NormalDist().pdf(r.z)) < 1e-15


def test_hashed_normals_are_standard_normal(spark):
    df = spark.range(40000).select(hashed_normal(F.lit(42), F.col("id"), F.lit(3)).alias("w"))
    s = df.agg(F.avg("w").alias("m"), F.stddev_samp("w").alias("sd"), F.kurtosis("w").alias("k")).first()
    assert abs(s.m) < 0.02 and abs(s.sd - 1) < 0.02 and abs(s.k) < 0.1


def test_hashed_normals_do_not_depend_on_partitioning(spark):
    a = spark.range(0, 3000, 1, 1).select("id", hashed_normal(F.lit(7), "id", F.lit(0)).alias("w"))
    b = spark.range(0, 3000, 1, 13).select("id", hashed_normal(F.lit(7), "id", F.lit(0)).alias("w"))
    assert sorted(a.collect()) == sorted(b.collect())


def test_pricers_agree_when_gamma_is_zero(spark):
    df = spark.createDataFrame([(100.0, 1.0, 0.0, 50.0, 0.1), (-20.0, 0.5, 0.0, 10.0, -0.3)],
                               "q double, d double, g double, s double, r double")
    for row in df.select(pnl_linear("q", "d", "s", "r").alias("a"), pnl_delta_gamma("q", "d", "g", "s", "r").alias("b"),
                         pnl_auto("q", "d", "g", "s", "r").alias("c")).collect():
        assert abs(row.a - row.b) < 1e-9 and abs(row.a - row.c) < 1e-9


def test_delta_gamma_formula(spark):
    q, d, g, s, r = 10.0, 0.5, 0.01, 100.0, 0.05
    ds = s * (math.exp(r) - 1)
    expected = q * (d * ds + 0.5 * g * ds * ds)
    df = spark.createDataFrame([(q, d, g, s, r)], "q double, d double, g double, s double, r double")
    assert abs(df.select(pnl_auto("q", "d", "g", "s", "r")).first()[0] - expected) < 1e-9


def test_exposure_collapse_equals_position_pricing(spark):
    rows = [("A", 10.0, 1.0, 0.0, 50.0), ("A", -3.0, 0.5, 0.02, 50.0), ("A", 7.0, 0.2, 0.1, 50.0)]
    pos = spark.createDataFrame(rows, "ticker string, quantity double, delta double, gamma double, spot_price double")
    r = -0.07
    by_position = pos.select(F.sum(pnl_auto("quantity", "delta", "gamma", "spot_price", F.lit(r)))).first()[0]
    exp = pos.groupBy("ticker").agg(*exposure_columns())
    collapsed = exp.select(exposure_pnl(log_return=F.lit(r))).first()[0]
    assert abs(by_position - collapsed) < 1e-9


def test_round_half_away(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (0.125,), (1.005,)], "x double")
    got = [r[0] for r in df.select(round_half_away("x", 0)).collect()]
    assert got[:2] == [3.0, -3.0]
