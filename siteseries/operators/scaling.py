"""Centring, z-scores, ratios to the site mean and differences from baselines.

`bounded=True` says that the table holds one row per group and period, so that a group is limited by the
calendar and one window reads the input once. Otherwise rows get their statistics by aggregate-and-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteseries.functions.dates import month_sequence
from siteseries.functions.numeric import ln_pos, ratio
from siteseries.operators.aggregate import community_stats
from siteseries.operators.joins import full_grid, key_grid, natural_join, on_grid, with_group_stats
from siteseries.operators.reshape import melt


def centred(df: DataFrame, keys: list[str], cols: list[str], prefix: str = "z_", bounded: bool = False) -> DataFrame:
    """x minus the group mean for every column at once (not divided by the sd)."""
    rows = with_group_stats(df, keys, {f"_mu_{c}": F.avg(c) for c in cols}, bounded=bounded)
    return rows.withColumns({prefix + c: F.col(c) - F.col(f"_mu_{c}") for c in cols}).drop(*[f"_mu_{c}" for c in cols])


def z_scores(df: DataFrame, keys: list[str], cols: list[str], suffix: str = "_scaled", bounded: bool = False) -> DataFrame:
    """(x - mean) / sd with n - 1; null where the sd is null or 0."""
    stats = {}
    for c in cols:
        stats |= {f"_mu_{c}": F.avg(c), f"_sd_{c}": F.stddev_samp(c)}
    rows = with_group_stats(df, keys, stats, bounded=bounded)
    made = {c + suffix: ratio(F.col(c) - F.col(f"_mu_{c}"), F.col(f"_sd_{c}")) for c in cols}
    return rows.withColumns(made).drop(*stats)


def zero_filled_levels(df: DataFrame, level: str, values: dict[str, object], unit: list[str]) -> DataFrame:
    """Aggregates per unit and level on the grid of all units and all levels, 0 where nothing was caught.

    One job covers every level (families, trait values).
    """
    facts = df.groupBy(*unit, level).agg(*[v.alias(n) for n, v in values.items()])
    grid = full_grid(df.select(*unit), df.select(level).filter(F.col(level).isNotNull()))
    return natural_join(grid, facts, "left", [*unit, level]).fillna(0, subset=list(values))


def zero_filled_z(df: DataFrame, level: str, values: dict[str, object], site: str = "site_code",
                  period: str = "collection_period") -> DataFrame:
    """z-score per site and level of zero-filled survey aggregates; null z dropped."""
    filled = zero_filled_levels(df, level, values, [site, period])
    names = list(values)
    return (z_scores(filled, [site, level], names, "_s", bounded=True)  # one row per site, level and period
            .select(site, period, level, *[f"{n}_s" for n in names]).dropna("all", subset=[f"{n}_s" for n in names]))


def count_and_size_series(individuals: DataFrame, level: str, length: str, taxon: str = "lowest_taxon",
                          site: str = "site_code", period: str = "collection_period") -> DataFrame:
    """Long series of count and mean-size z-scores for every level of a grouping at once."""
    by_taxon = individuals.groupBy(site, period, taxon, level).agg(
        F.count(F.lit(1)).cast("double").alias("cnt"), F.avg(length).alias("mu"))
    z = zero_filled_z(by_taxon, level, {"count": F.sum("cnt"), "size": F.sum("mu")}, site, period)
    z = z.withColumnsRenamed({"count_s": "count", "size_s": "size"})
    return melt(z, [site, period, level], ["count", "size"], ("xvar", "x"), drop_null=True)


def log_ratio_to_mean(df: DataFrame, keys: list[str], cols: list[str], prefix: str = "LRR_",
                      bounded: bool = False) -> DataFrame:
    """ln(x / group mean), null where the ratio is not positive."""
    rows = with_group_stats(df, keys, {f"_mu_{c}": F.avg(c) for c in cols}, bounded=bounded)
    made = {prefix + c: ln_pos(ratio(c, f"_mu_{c}")) for c in cols}
    return rows.withColumns(made).drop(*[f"_mu_{c}" for c in cols])


def monthly_grid(df: DataFrame, site: str, period: str, start, months: int) -> DataFrame:
    """Every site of the table with every month of the range."""
    return key_grid(df.select(site), period, month_sequence(start, months))


def lag_difference(df: DataFrame, value: str, site: str, period: str, start, months: int,
                   name: str = "delta_k1") -> DataFrame:
    """x minus the previous month's x on the complete grid; null when that month is missing.

    The window runs over one row per site and month, so its size is bounded by the calendar.
    """
    grid = on_grid(monthly_grid(df, site, period, start, months), df.select(site, period, value))
    before = F.lag(value).over(Window.partitionBy(site).orderBy(period))
    return grid.withColumn(name, F.col(value) - before)


def deltas(df: DataFrame, value: str, start, months: int, site: str = "site_code",
           period: str = "collection_period") -> DataFrame:
    """Survey total minus mean and median of all time, year and quarter, on the complete monthly grid."""
    stats = community_stats(df, value, site, period)
    t = f"{value}_com"
    grid = on_grid(monthly_grid(df, site, period, start, months), stats)
    made = [(F.col(t) - F.col(f"{t}_{s}_{g}")).alias(f"{t}_delta_{g}_{s}")
            for g in ("at", "yr", "qt") for s in ("mu", "me")]
    return grid.select(site, period, t, *made)
