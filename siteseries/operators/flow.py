"""Daily-flow metrics: trailing extremes, event magnitude, spells, durations and regime indices.

Input is one row per site and day (aggregate first where several gauges or rows share a day), so an
ordered window holds at most one row per calendar day of the record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteseries.functions.numeric import ratio
from siteseries.operators.joins import with_group_stats


def trailing_extremes(df: DataFrame, site: str, date: str, value: str, days: int = 28) -> DataFrame:
    """Largest and smallest value of the `days` days before each date, gaps in the calendar respected."""
    w = Window.partitionBy(site).orderBy(F.unix_date(date)).rangeBetween(-days, -1)
    return df.withColumns({"q_max": F.max(value).over(w), "q_min": F.min(value).over(w)})


def event_magnitude(df: DataFrame, site: str, date: str, value: str, days: int = 28) -> DataFrame:
    """Trailing extremes relative to the site's median of the year."""
    rows = trailing_extremes(df, site, date, value, days).withColumn("year", F.year(date))
    rows = with_group_stats(rows, [site, "year"], {"q_base": F.median(value)}, bounded=True)
    return rows.withColumns({
        "flood_magnitude": ratio(F.col("q_max") - F.col("q_base"), "q_base"),
        "drought_magnitude": ratio(F.col("q_min") - F.col("q_base"), "q_base")})


def low_spells(df: DataFrame, site: str, date: str, value: str, prob: float = 0.25, longer_than: int = 7) -> DataFrame:
    """Runs of consecutive days below the site's low quantile of the year, longer than a minimum."""
    rows = with_group_stats(df.withColumn("year", F.year(date)), [site, "year"],
                            {"q_low": F.percentile(value, F.lit(prob))}, bounded=True)
    low = rows.filter(F.col(value) < F.col("q_low"))
    order = Window.partitionBy(site).orderBy(date)
    # consecutive days keep day number minus position constant; a missing day breaks the run
    low = low.withColumn("_run", F.unix_date(date) - F.row_number().over(order))
    spells = low.groupBy(site, "_run").agg(
        F.min(date).alias("start_date"), F.max(date).alias("end_date"),
        F.count(F.lit(1)).alias("days"), F.min(value).alias("q_min"))
    return spells.filter(F.col("days") > longer_than).drop("_run")


def event_durations(df: DataFrame, site: str, date: str, value: str, days: int = 28, times: float = 10.0,
                    prob: float = 0.25) -> DataFrame:
    """Days from the trailing peak to the first day under `times` x the annual median, and from the trailing
    low to the first day above the annual low quantile.

    Null while the flow has not yet returned by the end of the record.
    """
    order = Window.partitionBy(site).orderBy(F.unix_date(date))
    rows = with_group_stats(df.withColumn("year", F.year(date)), [site, "year"],
                            {"q_base": F.median(value), "q_low": F.percentile(value, F.lit(prob))}, bounded=True)
    # from the day on, as a running frame over the days in descending order
    onward = Window.partitionBy(site).orderBy(F.unix_date(date).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({
        "_calm": F.min(F.when(F.col(value) < times * F.col("q_base"), F.col(date))).over(onward),
        "_wet": F.min(F.when(F.col(value) > F.col("q_low"), F.col(date))).over(onward)})
    span = order.rangeBetween(-days, -1)
    # extreme first, then the earliest date that shows it
    peak = F.max(F.struct(F.col(value).alias("v"), (-F.unix_date(date)).alias("nd"), F.col("_calm").alias("r"))).over(span)
    low = F.min(F.struct(F.col(value).alias("v"), F.unix_date(date).alias("nd"), F.col("_wet").alias("r"))).over(span)
    rows = rows.withColumns({"_peak": peak, "_lowest": low})
    return rows.withColumns({
        "flood_duration": F.unix_date("_peak.r") + F.col("_peak.nd"),
        "drought_duration": F.unix_date("_lowest.r") - F.col("_lowest.nd"),
    }).drop("_calm", "_wet", "_peak", "_lowest", "q_base", "q_low", "year")


def regime_indices(df: DataFrame, site: str, date: str, value: str, times: tuple[int, ...] = (3, 7, 15)) -> DataFrame:
    """Location, spread, pulse shares and flashiness of each site's record."""
    rows = with_group_stats(df, [site], {"_med": F.median(value), "_q25": F.percentile(value, F.lit(0.25))}, bounded=True)
    step = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(site).orderBy(date)))
    rows = rows.withColumn("_step", step)
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    return rows.groupBy(site).agg(
        F.median(value).alias("q_med"), F.max(value).alias("q_max"), F.avg(value).alias("q_mu"),
        F.stddev_samp(value).alias("q_sd"), ratio(F.stddev_samp(value), F.median(value)).alias("q_rsd"),
        F.percentile(value, F.lit(0.25)).alias("q_q25"), F.percentile(value, F.lit(0.75)).alias("q_q75"),
        share(F.col(value) < F.col("_q25")).alias("q_lfpp"),
        *[share(F.col(value) > k * F.col("_med")).alias(f"q_hfpp{k}") for k in times],
        ratio(F.sum("_step"), F.sum(value)).alias("q_flashiness"))


def predictor_set(flow: DataFrame, site: str = "site_code", date: str = "d", value: str = "q") -> DataFrame:
    """Magnitudes and durations of floods and droughts before each day, negative durations raised to 0."""
    out = event_durations(event_magnitude(flow, site, date, value).drop("q_max", "q_min", "q_base", "year"), site, date, value)
    return out.select(site, date, "flood_magnitude", "drought_magnitude", *[
        F.when(F.col(c) < 0, 0).otherwise(F.col(c)).alias(c) for c in ("flood_duration", "drought_duration")])
