"""P-values of the query results against numeric integration of their densities."""

import math
import os

import numpy as np
import pytest

from siteseries.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")


def tail(density, start, width=4000.0, n=400_001):
    """Integral of a density from `start` on, over a grid that widens."""
    x = start + (np.exp(np.linspace(0, math.log(width + 1), n)) - 1)
    return float(np.trapezoid(density(x), x))


def test_welch_p_and_flag(spark):
    rows = QUERIES["m16b_welch_p_values"](spark, FOLDER).limit(12).collect()
    for r in rows:
        c = math.exp(math.lgamma((r.df + 1) / 2) - math.lgamma(r.df / 2)) / math.sqrt(r.df * math.pi)
        assert r.p_value == pytest.approx(2 * tail(lambda x: c * (1 + x * x / r.df) ** (-(r.df + 1) / 2), abs(r.t_stat)), abs=2e-5)
        assert r.significant == ("yes" if r.p_value < 1 - 0.95 ** (1 / 6) else "no")


def test_anova_p(spark):
    for r in QUERIES["m18b_anova_p_values"](spark, FOLDER).limit(5).collect():
        a, b = r.df_between / 2, r.df_within / 2
        c = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) * (a / b) ** a
        assert r.p_value == pytest.approx(tail(lambda x: c * x ** (a - 1) * (1 + a / b * x) ** (-(a + b)), r.f_stat), abs=2e-5)


def test_rank_sum_p(spark):
    for r in QUERIES["m20b_rank_sum_p_values"](spark, FOLDER).collect():
        assert r.p_value == pytest.approx(math.erfc(abs(r.z_stat) / math.sqrt(2)), abs=1e-6)


def test_tukey_p_orders_with_the_statistic(spark):
    rows = sorted(QUERIES["m19b_tukey_p_values"](spark, FOLDER).collect(), key=lambda r: r.q_stat)
    p = [r.p_value for r in rows]
    assert p == sorted(p, reverse=True) and all(0 <= x <= 1 for x in p)
