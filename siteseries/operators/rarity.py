"""Occurrence probability and rare taxa.

A taxon's presence is counted where it was recorded; surveys without it enter through the number of
surveys of the site. The complete taxon x survey grid is therefore never written out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteseries.operators.filters import outside_dates, between_dates
from siteseries.operators.joins import full_grid, natural_join, with_group_stats
from siteseries.operators.aggregate import presence_by_quarter


def occurrence_probability(df: DataFrame, value: str, site: str = "site_code", period: str = "collection_period",
                           taxon: str = "lowest_taxon", zero_blanks_group: bool = False) -> DataFrame:
    """Share of a site's surveys in which each taxon occurs, 0 for taxa never seen at the site.

    An explicit 0 counts as absent. With `zero_blanks_group=True` one explicit 0 makes the whole
    (taxon, site) share 0.
    """
    cells = df.groupBy(site, period, taxon).agg(F.max(F.col(value)).alias("v"))
    surveys = cells.select(site, period).distinct().groupBy(site).agg(F.count(F.lit(1)).alias("n_surveys"))
    seen = cells.groupBy(site, taxon).agg(
        F.sum(F.when(F.col("v") > 0, 1).otherwise(0)).alias("present"),
        F.max(F.when(F.col("v") > 0, 0).otherwise(1)).alias("has_zero"))
    grid = full_grid(surveys.select(site), cells.select(taxon))
    out = natural_join(natural_join(grid, surveys, "left", [site]), seen, "left", [site, taxon])
    share = F.coalesce(F.col("present"), F.lit(0)) / F.col("n_surveys")
    if zero_blanks_group:
        share = F.when(F.col("has_zero") == 1, 0.0).otherwise(share)
    return out.select(taxon, site, share.alias("prob_present"))


def rare_total(df: DataFrame, value: str, below: float = 0.25, site: str = "site_code",
               period: str = "collection_period", taxon: str = "lowest_taxon") -> DataFrame:
    """Summed value per survey of the taxa that are rare at the site (0 < share < below).

    Sites that have a rare taxon report every survey, with 0 where none was caught.
    """
    cells = df.groupBy(site, period, taxon).agg(F.sum(value).alias("v"), F.max(F.when(F.col(value) > 0, 1).otherwise(0)).alias("present"))
    surveys = cells.select(site, period).distinct().groupBy(site).agg(F.count(F.lit(1)).alias("n_surveys"))
    seen = natural_join(cells.groupBy(site, taxon).agg(F.sum("present").alias("seen")), surveys, "left", [site])
    share = F.col("seen") / F.col("n_surveys")
    rare = seen.filter((share > 0) & (share < below)).select(site, taxon, F.lit(1).alias("rare"))
    marked = natural_join(cells, rare, "left", [site, taxon])
    out = marked.groupBy(site, period).agg(
        F.sum(F.when(F.col("rare") == 1, F.col("v")).otherwise(0.0)).alias("rare_tot"), F.max("rare").alias("any_rare"))
    # one row per site and period: the window is bounded by the calendar
    out = with_group_stats(out, [site], {"site_rare": F.max("any_rare")}, bounded=True)
    return out.filter(F.col("site_rare") == 1).select(site, period, "rare_tot")


def only_in_window(df: DataFrame, value: str, start, end, taxon: str = "lowest_taxon",
                   period: str = "collection_period") -> DataFrame:
    """Taxa recorded inside the window (both ends open) and never outside it."""
    inside = (presence_by_quarter(between_dates(df, period, start, end, "none"), taxon, value, period)
              .select(taxon, "presence").distinct())
    outside = outside_dates(df, period, start, end).select(taxon).distinct()
    return natural_join(inside, outside, "anti", [taxon])
