import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteseries.functions import dates as D
from siteseries.functions import numeric as N
from siteseries.functions import special as S
from siteseries.functions import text as X


def one(spark, expr, value, kind="date"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("day,inclusive,strict", [
    (dt.date(1997, 3, 19), dt.date(1997, 3, 1), dt.date(1997, 3, 1)),
    (dt.date(1997, 3, 20), dt.date(1997, 3, 1), dt.date(1997, 4, 1)),
    (dt.date(1997, 3, 21), dt.date(1997, 4, 1), dt.date(1997, 4, 1)),
    (dt.date(1997, 12, 31), dt.date(1998, 1, 1), dt.date(1998, 1, 1)),
])
def test_survey_period_rules(spark, day, inclusive, strict):
    assert one(spark, D.survey_period("c"), day) == inclusive
    assert one(spark, D.survey_period("c", inclusive=False), day) == strict
    assert one(spark, D.survey_period_by_era("c", "1997-03-20"), day) == (inclusive if day < dt.date(1997, 3, 20) else strict)


def test_window_bounds(spark):
    edge = dt.date(1997, 6, 1)
    for closed, hit in (("none", False), ("right", False), ("left", True), ("both", True)):
        assert one(spark, D.in_window("c", "1997-06-01", "1997-07-01", closed), edge) is hit
    assert one(spark, D.flag_window("c", "1997-06-01", "1997-07-01"), None) is None


def test_calendar(spark):
    d = dt.date(1997, 8, 27)
    assert one(spark, D.week_of_year("c"), d) == 35
    assert one(spark, D.season("c"), d) == "Summer"
    assert one(spark, D.month_shift("c", -1), dt.date(1997, 1, 15)) == 12
    assert one(spark, D.weeks_to("c", "1997-08-27"), dt.date(1997, 9, 4)) == 2
    assert one(spark, D.months_to("c", "1997-08-27"), dt.date(1997, 10, 11)) == 2  # 45 days: 1.5 to even
    assert one(spark, D.quarter_label("c"), d) == "1997 Q3"


def test_guards(spark):
    assert one(spark, N.ln_pos("c"), 0.0, "double") is None
    assert one(spark, N.ln_or("c", -100000.0), 0.0, "double") == -100000.0
    assert one(spark, N.ratio(F.lit(1.0), "c"), 0.0, "double") is None
    assert one(spark, N.clamp_low("c"), None, "double") is None
    assert one(spark, N.clamp_low("c"), -2.0, "double") == 0.0


def test_names(spark):
    assert X.title_name("ph_mean", {"Ph": "pH"}) == "pH Mean"
    assert X.snake_name("Mean Flow.Max") == "mean_flow_max"
    assert one(spark, X.repair_taxon("c", {"A b": "A c"}), "A.. b", "string") == "A c"


def test_normal_quantile_inverts_cdf(spark):
    ps = [1e-6, 0.01, 0.2, 0.5, 0.7, 0.99, 1 - 1e-6]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(N.normal_quantile("p")).collect()]
    assert np.allclose(S.normal_cdf(np.array(got)), ps, rtol=1e-6)


def test_distributions_against_commons_math(spark):
    m = spark._jvm.org.apache.commons.math3.distribution
    for t, df in ((0.3, 3.0), (2.1, 17.4), (8.0, 40.0)):
        want = 2 * m.TDistribution(df).cumulativeProbability(-t)
        assert S.t_two_sided(t, df)[0] == pytest.approx(want, rel=1e-9)
    for f, a, b in ((0.5, 1.0, 20.0), (4.2, 3.0, 200.0), (30.0, 5.0, 12.0)):
        assert S.f_upper(f, a, b)[0] == pytest.approx(1 - m.FDistribution(a, b).cumulativeProbability(f), rel=1e-6)
    for x, k in ((0.1, 1.0), (5.0, 4.0), (60.0, 30.0)):
        assert S.chi2_upper(x, k)[0] == pytest.approx(1 - m.ChiSquaredDistribution(k).cumulativeProbability(x), rel=1e-8)


def test_studentized_range_known_points():
    # upper 5 % points of published tables
    for q, k, df in ((3.877, 3, 10), (3.685, 4, 120), (4.574, 5, 11)):
        p = S.studentized_range_upper(np.array([q]), np.array([float(k)]), np.array([float(df)]))[0]
        assert p == pytest.approx(0.05, abs=2e-4)
    # two groups: the range is sqrt(2) |t|
    p = S.studentized_range_upper(np.array([2.5 * np.sqrt(2)]), np.array([2.0]), np.array([14.0]))[0]
    assert p == pytest.approx(S.t_two_sided(2.5, 14.0)[0], rel=1e-6)


def test_seeded_hash_is_stable(spark):
    rows = spark.range(1000).withColumn("u", N.seeded_uniform(7, "id"))
    a = {r.id: r.u for r in rows.collect()}
    b = {r.id: r.u for r in rows.repartition(7).collect()}
    assert a == b and 0 <= min(a.values()) and max(a.values()) < 1
    assert abs(np.mean(list(a.values())) - 0.5) < 0.05
