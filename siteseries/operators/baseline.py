"""Response ratios against a baseline period."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteseries.functions.dates import flag_window
from siteseries.functions.numeric import distance2, ln_or, ratio, sum0
from siteseries.operators.joins import with_group_stats
from siteseries.operators.reshape import melt

ZERO_LRR = -100000.0
OFFSET = 0.01


def response_ratio(df: DataFrame, value: str, level: str | None, test: tuple, closed: str = "none",
                   site: str = "site_code", period: str = "collection_period",
                   by: list[str] | None = None) -> DataFrame:
    """Response of each test survey relative to the baseline mean of its site.

    Sums per survey and level; the baseline is the mean over baseline surveys of the same site, quarter
    and level, or of the same site and level where that quarter has none, or 0 where the site has none.
    Ratio = (x - b) / (b + 0.01); log ratio = ln|ratio| with -100000 for a ratio of 0. `by` adds key
    columns (such as the metric name), so that many metrics run in one job.

    After the survey sums a (site, level) holds one row per period, so both baselines are windows over
    calendar-bounded groups that share one exchange, and the raw rows are read once.
    """
    by = by or []
    levels = by + ([level] if level else [])
    keyed = df.withColumns({"qtr": F.quarter(period), "is_baseline": flag_window(period, *test, closed)})
    surveys = keyed.groupBy(site, "qtr", period, *levels, "is_baseline").agg(sum0(value).alias("x"))
    base = F.when(F.col("is_baseline") == "baseline", F.col("x"))
    out = with_group_stats(surveys, [site, *levels], {"b_all": F.avg(base), "b_sd": F.stddev_samp(base)}, bounded=True)
    out = with_group_stats(out, [site, *levels, "qtr"], {"b_qtr": F.avg(base)}, bounded=True)
    out = out.filter(F.col("is_baseline") == "test").withColumn("b_all", F.coalesce("b_all", F.lit(0.0)))
    out = out.withColumn("b_qtr_fill", F.coalesce("b_qtr", "b_all"))
    for name, b in (("qtr", "b_qtr_fill"), ("all", "b_all")):
        out = out.withColumn(f"rr_{name}", ratio(F.col("x") - F.col(b), F.col(b) + F.lit(OFFSET)))
        out = out.withColumn(f"lrr_{name}", ln_or(F.abs(F.col(f"rr_{name}")), ZERO_LRR))
    return out


def response_ratios(df: DataFrame, metrics: list[str], level: str | None, test: tuple,
                    site: str = "site_code", period: str = "collection_period") -> DataFrame:
    """`response_ratio` for several metric columns in one pass, keyed by `metric`."""
    ids = [site, period] + ([level] if level else [])
    long = melt(df.select(*ids, *metrics), ids, metrics, ("metric", "value"))
    return response_ratio(long, "value", level, test, "none", site, period, ["metric"])


def response_ratio_levels(df: DataFrame, metrics: list[str], levels: list[str | None], test: tuple,
                          site: str = "site_code", period: str = "collection_period") -> DataFrame:
    """All metrics at all levels of grouping; `level` names the grouping and `item` its value."""
    parts = []
    for level in levels:
        name = level or "community"
        part = response_ratios(df, metrics, level, test, site, period)
        item = F.col(level) if level else F.lit("community")
        part = part.withColumns({"level": F.lit(name), "item": item})
        parts.append(part.drop(level) if level else part)
    return reduce(lambda a, b: a.unionByName(b), parts)


def band_position(x: str = "x", base: str = "b_qtr_fill", sd: str = "b_sd") -> Column:
    """Above, Below or Inside the baseline band of one sd; null without an sd."""
    lo, hi = F.col(base) - F.col(sd), F.col(base) + F.col(sd)
    return F.when(F.col(x) > hi, "Above").when(F.col(x) < lo, "Below").when(F.col(sd).isNotNull(), "Inside")


def centroid_distance(df: DataFrame, keys: list[str], x: str = "axis1", y: str = "axis2") -> DataFrame:
    """Distance of each row to the mean point of its group."""
    rows = with_group_stats(df, keys, {"mu1": F.avg(x), "mu2": F.avg(y)}, small=True)
    return rows.withColumn("centroid_dist", distance2(x, y, "mu1", "mu2"))


def baseline_centroid_distance(df: DataFrame, test: tuple, site: str = "site_code", period: str = "collection_period",
                               x: str = "axis1", y: str = "axis2") -> DataFrame:
    """Distance of each row to the mean point of the baseline rows of its site (one row per site and period)."""
    base = flag_window(period, *test, "none") == "baseline"
    rows = with_group_stats(df, [site], {"mu1": F.avg(F.when(base, F.col(x))), "mu2": F.avg(F.when(base, F.col(y)))}, bounded=True)
    return rows.withColumn("cdis", distance2(x, y, "mu1", "mu2"))
