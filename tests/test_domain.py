import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siteseries.operators import baseline, diversity, fill, flow, rarity

TEST = ("1997-06-01", "1998-09-01")


def panel(spark, rows):
    return spark.createDataFrame([(s, dt.date(*d), t, v) for s, d, t, v in rows],
                                 "site_code string, collection_period date, lowest_taxon string, density double")


def test_response_ratio_by_hand(spark):
    df = panel(spark, [
        ("a", (1996, 7, 1), "t", 4.0), ("a", (1999, 7, 1), "t", 6.0), ("a", (1999, 1, 1), "t", 2.0),
        ("a", (1997, 7, 1), "t", 5.0), ("a", (1997, 7, 1), "u", 3.0), ("a", (1997, 10, 1), "t", 4.0),
        ("b", (1997, 7, 1), "t", 1.0), ("a", (1997, 6, 1), "t", 8.0)])
    got = {(r.site_code, r.collection_period.month): r for r in baseline.response_ratio(df, "density", None, TEST).collect()}
    assert set(got) == {("a", 7), ("a", 10), ("b", 7)}     # the first day of the window is not inside
    july = got["a", 7]                                     # 8 against the third-quarter mean (4 + 6) / 2
    assert july.x == 8.0 and july.b_qtr == 5.0 and july.b_all == 5.0
    assert july.rr_qtr == pytest.approx(3.0 / 5.01) and july.lrr_qtr == pytest.approx(math.log(3.0 / 5.01))
    assert july.b_sd == pytest.approx(np.std([4, 6, 2, 8], ddof=1))
    october = got["a", 10]                                 # no fourth-quarter baseline: all-time mean 5
    assert october.b_qtr is None and october.b_qtr_fill == 5.0 and october.rr_qtr == pytest.approx(-1.0 / 5.01)
    alone = got["b", 7]                                    # no baseline at all: 0
    assert alone.b_all == 0.0 and alone.b_sd is None and alone.rr_all == pytest.approx(100.0)


def test_zero_ratio_gets_the_sentinel(spark):
    df = panel(spark, [("a", (1996, 7, 1), "t", 4.0), ("a", (1997, 7, 1), "t", 4.0)])
    row = baseline.response_ratio(df, "density", "lowest_taxon", TEST).first()
    assert row.rr_qtr == 0.0 and row.lrr_qtr == -100000.0 and row.lrr_all == -100000.0


def test_band_position(spark):
    df = spark.createDataFrame([(5.0, 2.0, 1.0), (0.0, 2.0, 1.0), (2.5, 2.0, 1.0), (9.0, 2.0, None)], "x double, b_qtr_fill double, b_sd double")
    assert [r[0] for r in df.select(baseline.band_position()).collect()] == ["Above", "Below", "Inside", None]


def test_hill_numbers_order_and_even_case(spark):
    even = [("a", (1997, 1, 1), f"t{i}", 2.0) for i in range(5)]
    rng = np.random.default_rng(1)
    odd = [("b", (1997, 1, 1), f"t{i}", float(v)) for i, v in enumerate(rng.lognormal(0, 1, 12))] + [("b", (1997, 1, 1), "zero", 0.0)]
    got = {r.site_code: r for r in diversity.hill_numbers(panel(spark, even + odd), "density").collect()}
    assert (got["a"].richness, got["a"].shannon, got["a"].simpson) == (5, pytest.approx(5.0), pytest.approx(5.0))
    p = np.array([r[3] for r in odd if r[3] > 0]); p = p / p.sum()
    assert got["b"].richness == 12
    assert got["b"].shannon == pytest.approx(math.exp(-(p * np.log(p)).sum()))
    assert got["b"].simpson == pytest.approx(1 / (p * p).sum())
    assert got["b"].simpson <= got["b"].shannon <= got["b"].richness


def test_hellinger_rows_have_unit_length(spark):
    df = panel(spark, [("a", (1997, 1, 1), "t", 3.0), ("a", (1997, 1, 1), "u", 1.0), ("b", (1997, 1, 1), "t", 9.0)])
    sums = diversity.hellinger(df, "density").groupBy("site_code").agg(F.sum(F.col("hell") ** 2).alias("s")).collect()
    assert all(r.s == pytest.approx(1.0) for r in sums)


def rare_rows():
    return [("a", (1997, 1, 1), "t", 1.0), ("a", (1997, 2, 1), "t", 0.0), ("a", (1997, 3, 1), "u", 2.0), ("a", (1997, 4, 1), "u", 2.0),
            ("b", (1997, 1, 1), "u", 1.0)]


def test_explicit_zero_counts_as_absent(spark):
    df = panel(spark, rare_rows())
    got = {(r.site_code, r.lowest_taxon): r.prob_present for r in rarity.occurrence_probability(df, "density").collect()}
    assert got == {("a", "t"): 0.25, ("a", "u"): 0.5, ("b", "t"): 0.0, ("b", "u"): 1.0}
    blank = {(r.site_code, r.lowest_taxon): r.prob_present for r in rarity.occurrence_probability(df, "density", zero_blanks_group=True).collect()}
    assert blank["a", "t"] == 0.0 and blank["a", "u"] == 0.5


def test_rare_total_reports_every_survey_of_the_site(spark):
    got = {(r.site_code, r.collection_period.month): r.rare_tot for r in rarity.rare_total(panel(spark, rare_rows()), "density", below=0.4).collect()}
    assert got == {("a", 1): 1.0, ("a", 2): 0.0, ("a", 3): 0.0, ("a", 4): 0.0}


def test_only_in_window(spark):
    df = panel(spark, [("a", (1997, 9, 1), "new", 1.0), ("a", (1997, 9, 1), "old", 1.0), ("a", (1996, 9, 1), "old", 1.0), ("a", (1999, 1, 1), "late", 1.0)])
    assert [tuple(r) for r in rarity.only_in_window(df, "density", "1997-08-20", "1998-10-01").collect()] == [("new", 1)]


def brute_fill(values, k, widen):
    out = []
    for i, v in enumerate(values):
        if v is not None:
            out.append(v)
            continue
        reach = k
        while True:
            near = [(abs(i - j), w) for j, w in enumerate(values) if w is not None and abs(i - j) <= reach]
            if len(near) >= 2 or not widen or reach > len(values):
                break
            reach += 1
        out.append(sum(w / (d + 1) for d, w in near) / sum(1 / (d + 1) for d, _ in near) if len(near) >= 2 else None)
    return out


@pytest.mark.parametrize("gap", [1, 5, 10])
def test_gap_fill_against_brute_force(spark, gap):
    values = [1.0, 4.0, 2.0] + [None] * gap + [8.0, 5.0, None, 3.0] + [None] * 3
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "k string, t int, v double")
    for fn, widen in ((fill.moving_average_fill, False), (fill.moving_average_fill_widening, True)):
        got = [r.v for r in fn(df, ["k"], "t", ["v"]).orderBy("t").collect()]
        want = brute_fill(values, 4, widen)
        assert len(got) == len(values)
        for g, w in zip(got, want):
            assert (g is None) == (w is None) and (g is None or g == pytest.approx(w))


def daily(spark, q, skip=()):
    start = dt.date(1997, 1, 1)
    rows = [("s", start + dt.timedelta(days=i), float(v)) for i, v in enumerate(q) if i not in skip]
    return spark.createDataFrame(rows, "site_code string, d date, q double")


def test_low_spell_length_and_calendar_gaps(spark):
    q = [10.0] * 10 + [1.0] * 8 + [10.0] * 60 + [1.0] * 7 + [10.0] * 60 + [1.0] * 9
    got = sorted((r.start_date.timetuple().tm_yday, r.days) for r in flow.low_spells(daily(spark, q), "site_code", "d", "q", 0.25).collect())
    assert got == [(11, 8), (146, 9)]        # seven days are too short; a run may last to the end of the record
    broken = flow.low_spells(daily(spark, q, skip={14}), "site_code", "d", "q", 0.25).collect()
    assert [r.days for r in broken] == [9]   # a missing day breaks the first run


def test_trailing_extremes_exclude_the_day_itself(spark):
    rows = {r.d.day: (r.q_max, r.q_min) for r in flow.trailing_extremes(daily(spark, [5, 1, 9]), "site_code", "d", "q", 28).collect()}
    assert rows == {1: (None, None), 2: (5.0, 5.0), 3: (5.0, 1.0)}


def test_event_durations_by_hand(spark):
    q = [2.0] * 40 + [100.0, 60.0, 30.0] + [2.0] * 40
    rows = {r.d: r for r in flow.event_durations(daily(spark, q), "site_code", "d", "q").collect()}
    after = rows[dt.date(1997, 1, 1) + dt.timedelta(days=50)]
    assert after.flood_duration == 3         # peak on day 40, below 10 x the median 2 on day 43
    ends = flow.event_durations(daily(spark, [2.0] * 40 + [100.0, 100.0]), "site_code", "d", "q").orderBy(F.desc("d")).first()
    assert ends.flood_duration is None       # not yet over


def test_regime_indices(spark):
    rng = np.random.default_rng(5)
    q = rng.lognormal(0, 1, 400)
    r = flow.regime_indices(daily(spark, q), "site_code", "d", "q").first()
    assert r.q_med == pytest.approx(np.median(q)) and r.q_rsd == pytest.approx(q.std(ddof=1) / np.median(q))
    assert r.q_hfpp3 == pytest.approx((q > 3 * np.median(q)).mean()) and r.q_lfpp == pytest.approx((q < np.quantile(q, 0.25)).mean())
    assert r.q_flashiness == pytest.approx(np.abs(np.diff(q)).sum() / q.sum())


def test_averaged_prediction(spark):
    pdf = pd.DataFrame({"x": [0.0, 1.0, 2.0], "y": [1.0, 2.0, 3.0]})
    second = pd.DataFrame({"x": [0.0, 1.0, 2.0], "y": [4.0, 4.0, 4.0]})
    out = diversity.averaged_prediction(spark.createDataFrame([(4.0,)], "x double"), "x", spark.createDataFrame(pdf),
                                        spark.createDataFrame(second), ["y"], ["y"]).first()
    assert out.y == math.ceil((5.0 + 2 * 4.0) / 3)
