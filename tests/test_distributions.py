import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.functions.distributions import incomplete_beta, ln_gamma, nbinom_cdf, nbinom_pmf


def pmf(k, mu, r):
    p = r / (r + mu)
    return math.exp(math.lgamma(k + r) - math.lgamma(r) - math.lgamma(k + 1) + r * math.log(p) + k * math.log(1 - p))


CASES = [(0, 4.0, 2.0), (3, 4.0, 2.0), (17, 250.0, 40.5), (400, 250.0, 40.5), (5, 0.02, 0.11), (2500, 2400.0, 300.0)]


def test_density_and_distribution_match_the_sums(spark):
    frame = spark.createDataFrame(CASES, "k long, mu double, r double")
    out = frame.select(
        "*", nbinom_pmf(F.col("k"), F.col("mu"), F.col("r")).alias("p"), nbinom_cdf(F.col("k"), F.col("mu"), F.col("r")).alias("c")
    )
    for row in out.collect():
        assert row.p == pytest.approx(pmf(row.k, row.mu, row.r), rel=1e-9)
        assert row.c == pytest.approx(sum(pmf(i, row.mu, row.r) for i in range(row.k + 1)), rel=1e-9)


def test_undefined_parameters_give_null(spark):
    frame = spark.createDataFrame(
        [(1, 0.0, 2.0), (1, 2.0, 0.0), (1, None, 2.0), (None, 2.0, 2.0)], "k long, mu double, r double"
    )
    rows = frame.select(
        nbinom_cdf(F.col("k"), F.col("mu"), F.col("r")).alias("c"), nbinom_pmf(F.col("k"), F.col("mu"), F.col("r")).alias("p")
    ).collect()
    assert all(r.c is None and r.p is None for r in rows)


def test_large_counts_stay_cheap_and_exact():
    a, b = np.array([300.0, 300.0]), np.array([2_000_001.0, 1.0])
    x = 300.0 / (300.0 + 2_000_000.0)
    got = incomplete_beta(a, b, np.array([x, x]))
    assert 0.4 < got[0] < 0.6
    assert got[1] == pytest.approx(x**300, abs=1e-300)


def test_log_gamma_column(spark):
    values = [0.01, 0.5, 1.0, 2.0, 7.3, 150.0, 1e6]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    for row in frame.select("x", ln_gamma(F.col("x")).alias("g")).collect():
        assert row.g == pytest.approx(math.lgamma(row.x), rel=1e-12, abs=1e-12)


def test_very_large_arguments():
    a = np.array([5e11, 4e9, 2.0])
    x = np.array([0.5, 0.5 + 1e-5, 0.3])
    got = incomplete_beta(a, a, x)
    spread = 0.5 / math.sqrt(2 * 4e9 + 1)
    assert math.isclose(got[0], 0.5, abs_tol=1e-9)
    assert math.isclose(got[1], 0.5 * math.erfc(-(1e-5 / spread) / math.sqrt(2)), abs_tol=1e-6)
    assert math.isclose(got[2], 3 * 0.3**2 - 2 * 0.3**3, abs_tol=1e-12)
