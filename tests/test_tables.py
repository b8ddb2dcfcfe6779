import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siteseries.operators import aggregate, assembly, filters, joins, ranking, reshape, scaling, select
from siteseries.sources import files


def test_natural_join_matches_null_keys(spark):
    a = spark.createDataFrame([("x", 1, 10), (None, 1, 20), ("y", 2, 30)], "k string, j int, a int")
    b = spark.createDataFrame([("x", 1, 5), (None, 1, 6), ("z", 9, 7)], "k string, j int, b int")
    assert {tuple(r) for r in joins.natural_join(a, b).collect()} == {("x", 1, 10, 5), (None, 1, 20, 6), ("y", 2, 30, None)}
    full = {tuple(r) for r in joins.natural_join(a, b, "full").collect()}
    assert full == {("x", 1, 10, 5), (None, 1, 20, 6), ("y", 2, 30, None), ("z", 9, None, 7)}
    assert [tuple(r) for r in joins.natural_join(a, b, "anti").collect()] == [("y", 2, 30)]
    with pytest.raises(ValueError):
        joins.natural_join(a, b.toDF("p", "q", "r"))


def test_group_stats_agree_for_window_and_join(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0)], "k string, v double")
    for how in ({}, {"small": True}, {"bounded": True}):
        rows = {tuple(r) for r in joins.with_group_stats(df, ["k"], {"m": F.avg("v")}, **how).select("k", "v", "m").collect()}
        assert rows == {("a", 1.0, 2.0), ("a", 3.0, 2.0), (None, 5.0, 5.0)}


def test_broadcast_only_within_bound(spark):
    df = spark.range(50)
    assert "broadcast" in joins.broadcast_if_small(df, 50)._jdf.queryExecution().logical().toString()
    assert "broadcast" not in joins.broadcast_if_small(df, 49)._jdf.queryExecution().logical().toString()


def test_full_grid_and_zero_completion(spark):
    df = spark.createDataFrame([("s1", 1, "a", 2.0), ("s1", 2, "b", 3.0), ("s2", 1, "a", 4.0)], "s string, p int, t string, v double")
    out = reshape.zero_complete(df, ["s", "p"], ["t"], "v")
    assert out.count() == 3 * 2
    assert out.agg(F.sum("v")).first()[0] == 9.0


def test_melt_spread_round_trip(spark):
    wide = spark.createDataFrame([("a", 1.0, None), ("b", 3.0, 4.0)], "k string, x double, y double")
    long = reshape.melt(wide, ["k"], drop_null=True)
    assert long.count() == 3
    back = reshape.spread(long, ["k"], "xvar", "xval", ["x", "y"])
    assert {tuple(r) for r in back.collect()} == {("a", 1.0, None), ("b", 3.0, 4.0)}
    with pytest.raises(ValueError):
        reshape.pivot_names(spark.range(20).select(F.col("id").cast("string").alias("n")), "n", limit=10)
    flipped = reshape.transpose(wide, "k", ["x", "y"], ["a", "b"])
    assert {tuple(r) for r in flipped.collect()} == {("x", 1.0, 3.0), ("y", None, 4.0)}


def test_sums_of_nothing(spark):
    df = spark.createDataFrame([("a", "p", None), ("b", "p", 1.0)], "site_code string, collection_period string, v double")
    got = {r.site_code: r.v for r in aggregate.community_total(df, ["v"]).collect()}
    assert got == {"a": 0.0, "b": 1.0}
    stats = {r.site_code: (r.x_mean, r.x_sd) for r in aggregate.mean_sd_n(df, ["site_code"], "v").collect()}
    assert stats == {"a": (None, None), "b": (1.0, None)}


def test_near_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0 + 1e-9, 3.0), (1.0, 9.0)], "flat double, moves double")
    assert filters.constant_columns(df) == ["flat"]


def test_small_values_that_vary_are_not_constant(spark):
    df = spark.createDataFrame([(0.05, 0.0, 3.5), (0.0501, 0.0, 3.5), (0.0499, 0.0, 3.5)], "x1 double, zero double, flat double")
    assert filters.constant_columns(df) == ["zero", "flat"]


def skewed(spark, n=6000):
    """A third of all rows share one group and one value."""
    rng = np.random.default_rng(3)
    g = np.where(rng.random(n) < 0.5, "hot", rng.choice(["b", "c", "d"], n))
    v = np.where(rng.random(n) < 0.33, 7.0, np.round(rng.normal(5, 3, n), 1))
    pdf = pd.DataFrame({"g": g, "v": v})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("group_rows", [0, 10**6])
def test_quantiles_match_pandas_on_skewed_groups(spark, group_rows):
    pdf, df = skewed(spark)
    got = ranking.exact_quantiles(df, ["g"], "v", {"lo": 0.1, "me": 0.5, "hi": 0.93}, group_rows).toPandas().set_index("g").sort_index()
    for name, p in (("lo", 0.1), ("me", 0.5), ("hi", 0.93)):
        assert np.allclose(got[name], pdf.groupby("g").v.quantile(p).sort_index())


@pytest.mark.parametrize("group_rows", [0, 10**6])
@pytest.mark.parametrize("keys", [["g"], []])
def test_cumulative_counts_match_pandas_ranks(spark, group_rows, keys):
    pdf, df = skewed(spark, 3000)
    got = ranking.cumulative_counts(df, keys, "v", 16, group_rows).toPandas()
    grouped = pdf.groupby("g").v if keys else pdf.v
    pdf["r"] = grouped.rank(method="min") - 1
    want = pdf.drop_duplicates([*keys, "v"])
    both = got.merge(want, on=[*keys, "v"])
    assert len(both) == len(got) == len(want)
    assert (both.below == both.r).all()
    assert got.n.sum() == len(pdf)


def test_hash_ranks_use_every_position_once(spark):
    df = spark.range(2000).withColumn("h", F.md5(F.col("id").cast("string")))
    got = ranking.cumulative_counts(df, [], "h", group_rows=0).orderBy("h").toPandas()
    assert got.below.tolist() == list(range(2000))


def test_ranked_and_best(spark):
    df = spark.createDataFrame([("a", 3.0, "p"), ("a", 1.0, "q"), ("a", 1.0, "r"), ("b", 2.0, "s")], "g string, v double, n string")
    got = {r.n: r["rank"] for r in ranking.ranked(df, ["g"], "v").collect()}
    assert got == {"q": 1.5, "r": 1.5, "p": 3.0, "s": 1.0}
    assert {tuple(r) for r in ranking.best_per_group(df, ["g"], "v", ["n"]).collect()} == {("a", 1.0, "q"), ("b", 2.0, "s")}


def test_centred_means_are_zero(spark):
    pdf, df = skewed(spark)
    for bounded in (True, False):
        means = scaling.centred(df, ["g"], ["v"], bounded=bounded).groupBy("g").agg(F.avg("z_v").alias("m")).toPandas()
        assert np.abs(means.m).max() < 1e-12
    z = scaling.z_scores(df, ["g"], ["v"], bounded=True).groupBy("g").agg(F.stddev_samp("v_scaled").alias("s")).toPandas()
    assert np.allclose(z.s, 1.0)


def test_lag_needs_the_previous_month(spark):
    rows = [("a", dt.date(1997, 1, 1), 1.0), ("a", dt.date(1997, 2, 1), 4.0), ("a", dt.date(1997, 4, 1), 9.0)]
    df = spark.createDataFrame(rows, "site_code string, collection_period date, v double")
    out = scaling.lag_difference(df, "v", "site_code", "collection_period", "1997-01-01", 5)
    got = {r.collection_period.month: r.delta_k1 for r in out.collect()}
    assert got == {1: None, 2: 3.0, 3: None, 4: None, 5: None}


def test_transform_rule_uses_either_end_of_the_range(spark):
    df = spark.createDataFrame([(1.0, -9.0, 1.0), (1.0, -1.0, 2.0), (100.0, -1.0, 3.0)], "up double, down double, flat double")
    assert assembly.choose_transforms(df, ["up", "down", "flat"], 2.5, "mean") == ["up"]
    assert set(assembly.choose_transforms(df, ["up", "down", "flat"], 5.0, "median")) == {"up", "down"}
    out = assembly.transform_columns(df, ["down"], "ln")
    assert out.columns == ["up", "flat", "ln_down"] and out.filter("ln_down is not null").count() == 0


def test_selection_helpers(spark):
    df = spark.createDataFrame([(1, "RDA1 (22.5%)", 2.0)], "q_a int, label string, q_b double")
    assert select.names_matching(df, "^q_") == ["q_a", "q_b"]
    assert select.rename_regex(df, "^q_", "z_").columns == ["z_a", "label", "z_b"]
    assert df.select(select.number_from_label("label").alias("v")).first().v == 22.5
    assert select.restore_names(["a", "b"], {"ln_": ["a"]}) == ["ln_a", "b"]
    packed = select.pack_key(df, "k", ["q_a", "q_b"], "@")
    assert tuple(select.unpack_key(packed, "k", {"q_a": "int", "q_b": "double"}, "@").select("q_a", "q_b").first()) == (1, 2.0)


def test_csv_round_trip_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([("a", dt.date(1997, 3, 1), 1.5), ("b", None, None), ("c", dt.date(1997, 4, 1), float("nan"))],
                               "s string, d date, v double")
    files.write_csv(df, str(tmp_path / "t"), single_file=True)
    back = files.read_csv(spark, str(tmp_path / "t"), "s string, d date, v double")
    assert {tuple(r) for r in back.collect()} == {("a", dt.date(1997, 3, 1), 1.5), ("b", None, None), ("c", dt.date(1997, 4, 1), None)}
    assert files.stage(df, str(tmp_path / "p")).count() == 3
