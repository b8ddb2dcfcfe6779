"""Both ways of ranking give the same rows, for null keys, every orderable type, negatives and ties; and sums far from zero."""

import datetime
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from siteseries.models.resample import stratified_split
from siteseries.operators.ranking import _range_parts, cumulative_counts, exact_quantiles, ranked
from siteseries.plans import views
from siteseries.stats.compare import anova, rank_sum_vs, tukey_pairs

FOLDER = "/root/testdata/sf0.001"

VALUES = {
    "double": [-3.5, 0.0, 2.0, 2.0, None, 10.0, 9.0, float("nan"), -40.0, 7.25], "int": [5, -1, 5, 30, 4, None, 100, 9, 9, -20],
    "smallint": [5, -1, 5, 30, 4, None, 100, 9, 9, -20], "decimal(10,2)": [Decimal(x) for x in "9.00 10.00 19.00 -2.50 100.00 25.00 19.00 3.10 0.00 7.70".split()],
    "date": [datetime.date(2000, 1, 1) + datetime.timedelta(days=d) for d in (5, 1, 5, 900, 4, 0, 100, 9, 9, -20)],
    "timestamp": [datetime.datetime(2000, 1, 1) + datetime.timedelta(hours=d) for d in (5, 1, 5, 900, 4, 0, 100, 9, 9, -20)],
    "binary": [bytearray(x) for x in (b"b", b"ab", b"", b"\xff", b"b", b"10", b"9", b"zz", b"z", b"\x00")],
    "string": ["b", "ab", "", "é", "b", "10", "9", "zz", "z", None], "boolean": [True, False, None, True, True, False, False, True, True, True]}


def frame(spark, kind, n=60):
    rows = [((None, "a", "b")[k % 3], VALUES[kind][k % 10], k) for k in range(n)]
    return spark.createDataFrame(rows, f"g string, v {kind}, i int")


@pytest.mark.parametrize("kind", sorted(VALUES))
@pytest.mark.parametrize("keys", [["g"], []])
def test_counts_at_every_size(spark, kind, keys):
    df = frame(spark, kind)
    small, large = ([str(r) for r in cumulative_counts(df, keys, "v", buckets=5, group_rows=n).orderBy(*keys, "v").collect()] for n in (10**6, 0))
    assert small == large and len(small) > 0


@pytest.mark.parametrize("kind", ["double", "int", "smallint", "decimal(10,2)"])
def test_quantiles_at_every_size(spark, kind):
    df = frame(spark, kind).where(~F.isnan(F.col("v").cast("double")) | F.col("v").isNull())
    got = [exact_quantiles(df, ["g"], "v", {"lo": 0.1, "me": 0.5, "hi": 0.93}, group_rows=n).orderBy("g").collect() for n in (10**6, 0)]
    assert got[0] == got[1] and len(got[0]) == 3


@pytest.mark.parametrize("make", ["concat('one common beginning of every key ', lpad(id, 9, '0'))", "encode(lpad(id, 30, 'x'), 'UTF-8')",
                                  "timestamp_seconds(1000000000 + id)"])
def test_large_groups_of_any_type_spread_over_buckets(spark, make):
    df = spark.range(40_000).selectExpr("if(id % 4 = 0, 'rare', 'hot') AS g", f"{make} AS v")
    parts = _range_parts(df.withColumn("n", F.lit(1)), ["g"], "v", 8)
    sizes = [r["count"] for r in parts.groupBy("bucket").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 40_000 / 8
    got = cumulative_counts(df, ["g"], "v", buckets=8, group_rows=100)
    want = cumulative_counts(df, ["g"], "v")
    assert got.count() == 40_000 and got.exceptAll(want).isEmpty()


def test_null_keys_stay(spark):
    df = frame(spark, "int")
    assert ranked(df, ["g"], "v").count() == df.where("v IS NOT NULL").count()
    split = stratified_split(df, ["i"], ["g"], 0.8)
    assert split.count() == 60 and split.columns == ["g", "v", "i", "part"]
    assert split.where("part = 'train'").groupBy("g").count().select("count").distinct().collect()[0][0] == 16
    by = df.withColumn("h", F.when(F.col("i") % 2 == 0, "x").otherwise("y"))
    assert tukey_pairs(by, ["g"], "h", "v").count() == 3
    assert rank_sum_vs(by, ["g"], "h", "v", "x", ["y"]).where("rank_sum IS NULL").count() == 0


def test_anova_far_from_zero(spark):
    near = spark.createDataFrame([(k % 3, float((k * 7) % 11 + k % 3)) for k in range(60)], "h int, v double")
    f = [anova(df, [], "h", "v").first()["f_stat"] for df in (near, near.withColumn("v", F.col("v") + 1e8))]
    assert f[1] == pytest.approx(f[0], rel=1e-6)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")
def test_surveys_keep_no_lines_in_memory(spark, monkeypatch):
    """Lines are summed in a hash table, not sorted by their labels; and the paths of large tables give the same surveys."""
    plan = views.survey(spark, FOLDER)
    assert "SortAggregate" not in plan._jdf.queryExecution().executedPlan().toString()
    want = {tuple(r)[:6]: (round(r.density, 6), round(r.biomass, 6)) for r in plan.collect()}
    monkeypatch.setattr(views, "TASK_ROWS", 100)
    large = views.survey(spark, FOLDER)
    assert "REPARTITION_BY_NUM" in large._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r)[:6]: (round(r.density, 6), round(r.biomass, 6)) for r in large.collect()} == want
    assert len(want) == large.count()
