"""Grouped summaries of survey panels. All use partial aggregation before their shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteseries.functions.dates import season
from siteseries.functions.numeric import ratio, sum0
from siteseries.operators.joins import natural_join, with_group_stats
from siteseries.operators.ranking import GROUP_ROWS, exact_quantiles, largest_group
from siteseries.operators.reshape import spread

SURVEY = ["site_code", "collection_period"]


def community_total(df: DataFrame, values: list[str], keys: list[str] = SURVEY) -> DataFrame:
    """Sums per survey; 0 where every value is missing."""
    return df.groupBy(*keys).agg(*[sum0(v).alias(v) for v in values])


def level_stats(df: DataFrame, value: str, keys: list[str], suffix: str, bounded: bool = False) -> DataFrame:
    """Mean, median, sd and count of raw measurements at one level.

    A level may hold any number of measurements. `bounded=True` says that its groups were counted and are
    small enough for the built-in exact median; otherwise the median comes from the distributed quantiles.
    """
    plain = [F.avg(value).alias(f"mu_{suffix}"), F.stddev_samp(value).alias(f"sd_{suffix}"),
             F.count(F.lit(1)).alias(f"n_{suffix}")]
    if bounded:
        return df.groupBy(*keys).agg(*plain, F.median(value).alias(f"me_{suffix}"))
    return natural_join(df.groupBy(*keys).agg(*plain), exact_quantiles(df, keys, value, {f"me_{suffix}": 0.5}), "left", keys)


def taxonomic_levels(df: DataFrame, value: str, unit: list[str] = SURVEY, family: str = "family",
                     taxon: str = "lowest_taxon", group_rows: int = GROUP_ROWS) -> DataFrame:
    """Species rows (mean above 0) with the statistics of their family and of the whole community.

    The community groups are counted once; the finer groups are parts of them. The raw rows are read
    several times, so a costly input should be staged.
    """
    bounded = largest_group(df, unit) <= group_rows
    species = level_stats(df, value, [*unit, taxon], "spe", bounded).filter(F.col("mu_spe") > 0)
    species = natural_join(species, df.select(family, taxon).distinct(), "left", [taxon])
    species = natural_join(species, level_stats(df, value, [*unit, family], "fam", bounded), "left", [*unit, family])
    return natural_join(species, level_stats(df, value, unit, "com", bounded), "left", unit)


def community_stats(df: DataFrame, value: str, site: str = "site_code", period: str = "collection_period") -> DataFrame:
    """Survey totals with mean, median and count over all time, the year and the quarter of the site.

    Statistics are taken over survey totals (at most one row per site and period).
    """
    t = f"{value}_com"
    totals = (community_total(df, [value], [site, period]).withColumnRenamed(value, t)
              .withColumns({"collection_year": F.year(period), "collection_qtr": F.quarter(period)}))
    out = totals
    for suffix, extra in (("at", []), ("yr", ["collection_year"]), ("qt", ["collection_qtr"])):
        out = with_group_stats(out, [site, *extra], {
            f"{t}_mu_{suffix}": F.avg(t), f"{t}_me_{suffix}": F.median(t), f"{t}_n_{suffix}": F.count(F.lit(1))}, bounded=True)
    return out


def taxa_with_community_stats(df: DataFrame, value: str, site: str = "site_code",
                              period: str = "collection_period") -> DataFrame:
    """`community_stats` on every taxon row."""
    return natural_join(df, community_stats(df, value, site, period), "left", [site, period])


def column_means(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Mean of many columns at once, without a melt."""
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols])


def shifted_quarter_variance(df: DataFrame, values: list[str], date: str = "collection_period",
                             shift_days: int = 35, keys: list[str] | None = None) -> DataFrame:
    """Variance and count by calendar quarter after moving dates forward."""
    quarter = F.trunc(F.date_add(F.col(date), shift_days), "quarter").alias("quarter")
    return df.groupBy(*(keys or []), quarter).agg(
        *[F.var_samp(v).alias(f"{v}_var") for v in values], F.count(F.lit(1)).alias("n"))


def effort_matrix(df: DataFrame, rows: str | Column, columns: str, values: list, zero: bool = False) -> DataFrame:
    """Counts of surveys by row and column key; empty cells are null, or 0 on request."""
    out = df.groupBy(rows).pivot(columns, values).agg(F.count(F.lit(1)))
    return out.fillna(0) if zero else out


def envelope(df: DataFrame, keys: list[str], cols: list[str], low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Mean and interpolated low/high quantiles of columns; groups of any size."""
    out = df.groupBy(*keys).agg(*[F.avg(c).alias(f"{c}_mu") for c in cols])
    for c in cols:
        out = natural_join(out, exact_quantiles(df, keys, c, {f"{c}_lwr": low, f"{c}_upr": high}), "left", keys)
    return out


def mean_sd_n(df: DataFrame, keys: list[str], value: str, name: str = "x") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(f"{name}_mean"), F.stddev_samp(value).alias(f"{name}_sd"),
                                 F.count(F.lit(1)).alias(f"{name}_n"))


def mean_sd_label(df: DataFrame, keys: list[str], value: str, label: str = "label", digits: int = 2) -> DataFrame:
    """Text 'mean (sd)' per group, rounded half to even."""
    fmt = f"%.{digits}f"
    text = F.concat(F.format_string(fmt, F.bround(F.avg(value), digits)), F.lit(" ("),
                    F.coalesce(F.format_string(fmt, F.bround(F.stddev_samp(value), digits)), F.lit("NA")), F.lit(")"))
    return df.groupBy(*keys).agg(text.alias(label))


def event_percent(df: DataFrame, keys: list[str], flags: dict[str, Column]) -> DataFrame:
    """Count and percentage of rows with each flag."""
    aggs = [F.count(F.lit(1)).alias("n_obs")]
    for name, cond in flags.items():
        hits = F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0))
        aggs += [hits.alias(f"n_{name}"), (hits * 100.0 / F.count(F.lit(1))).alias(f"percent_{name}")]
    return df.groupBy(*keys).agg(*aggs)


def event_counts(df: DataFrame, keys: list[str], flags: dict[str, Column]) -> DataFrame:
    """Number of distinct flagged rows per key."""
    return df.distinct().groupBy(*keys).agg(
        *[F.count(F.when(cond, 1)).alias(f"n_{name}") for name, cond in flags.items()])


def composition_percent(df: DataFrame, unit: list[str], part: str, value: str,
                        named: list[str] | None = None, other: str = "Other") -> DataFrame:
    """Share of each part in its unit, in percent; parts outside `named` are lumped first."""
    if named is not None:
        df = df.withColumn(part, F.when(F.col(part).isin(*named), F.col(part)).otherwise(other))
    parts = df.groupBy(*unit, part).agg(sum0(value).alias(value))
    parts = with_group_stats(parts, unit, {"unit_total": F.sum(value)}, bounded=named is not None)
    return parts.withColumn("percent", 100.0 * ratio(value, "unit_total"))


def regional_composition(df: DataFrame, period: str, part: str, value: str) -> DataFrame:
    """Mean by month of each row's percentage of the regional total of its period."""
    rows = with_group_stats(df, [period], {"region_total": F.sum(value)}, small=True)
    share = 100.0 * ratio(value, "region_total")
    return (rows.groupBy(F.month(period).alias("month"), part)
            .agg(F.avg(share).alias("percent_mu")))


def trait_totals(df: DataFrame, traits: DataFrame, trait: str, value: str, unit: list[str] = SURVEY,
                 taxon: str = "lowest_taxon") -> DataFrame:
    """Value summed per survey and trait value; the trait comes from a taxon table."""
    by_taxon = df.groupBy(*unit, taxon).agg(F.sum(value).alias(value))
    return (natural_join(by_taxon, traits.select(taxon, trait).distinct(), "left", [taxon])
            .groupBy(*unit, trait).agg(sum0(value).alias(value)))


def regional_index(df: DataFrame, site: str, date: str, value: str, center: str = "median") -> DataFrame:
    """Mean over sites of value / site centre, by date. The input has one row per site and date."""
    stat = F.median(value) if center == "median" else F.avg(value)
    rows = with_group_stats(df, [site], {"centre": stat}, bounded=True)
    return rows.groupBy(date).agg(F.avg(ratio(value, "centre")).alias("q_region"))


def regime_ratio(df: DataFrame, site: str, date: str, value: str, fine: Column, fine_name: str,
                 coarse: Column | None = None, coarse_center: str = "mean") -> DataFrame:
    """Mean over a fine grain divided by the mean or median of a coarser grain of the same site."""
    base = df.select(site, fine.alias(fine_name), F.col(value), *([coarse.alias("coarse")] if coarse is not None else []))
    keys = [site] + (["coarse"] if coarse is not None else [])
    by_fine = base.groupBy(*keys, fine_name).agg(F.avg(value).alias("fine_mu"))
    centre = F.avg(value) if coarse_center == "mean" else F.median(value)
    by_coarse = base.groupBy(*keys).agg(centre.alias("centre"))
    return natural_join(by_fine, by_coarse, "left", keys).withColumn("ratio", ratio("fine_mu", "centre"))


def presence_by_quarter(df: DataFrame, taxon: str, value: str, date: str = "collection_period") -> DataFrame:
    """1 when the taxon's regional sum in a quarter is above 0, else 0."""
    q = F.trunc(F.col(date), "quarter").alias("quarter")
    return df.groupBy(q, taxon).agg(F.when(F.sum(value) > 0, 1).otherwise(0).alias("presence"))


def quarters_occupied(df: DataFrame, taxon: str, value: str, date: str = "collection_period") -> DataFrame:
    return (presence_by_quarter(df, taxon, value, date).groupBy(taxon)
            .agg(F.sum("presence").alias("occurrence")))


def occurrence_matrix(df: DataFrame, taxon: str, value: str, below: int, quarters: list[str],
                      date: str = "collection_period") -> DataFrame:
    """Quarter columns with the presence of taxa that occupy fewer than `below` quarters."""
    presence = presence_by_quarter(df, taxon, value, date)
    rare = presence.groupBy(taxon).agg(F.sum("presence").alias("occurrence")).filter(F.col("occurrence") < below)
    rows = natural_join(presence, rare.select(taxon), "semi", [taxon])
    rows = rows.withColumn("quarter", F.date_format("quarter", "yyyy-MM-dd"))
    return spread(rows, [taxon], "quarter", "presence", quarters)


def even_out(df: DataFrame, keys: list[str], date: str, metrics: list[str]) -> DataFrame:
    """One mean per key, year and quarter, so that densely sampled years do not dominate."""
    return df.groupBy(*keys, F.year(date).alias("year"), F.quarter(date).alias("qtr")).agg(
        *[F.avg(m).alias(m) for m in metrics])


def normalised_monthly_mean(df: DataFrame, numerator: str, area: str, date: str, scale: float = 1000.0) -> DataFrame:
    """Mean by year and month of a volume divided by its catchment area and a unit scale."""
    value = ratio(numerator, area) / F.lit(scale)
    return df.groupBy(F.year(date).alias("year"), F.month(date).alias("month")).agg(F.avg(value).alias("depth_mu"))


def seasonal(df: DataFrame, date: str = "collection_period") -> DataFrame:
    return df.withColumn("season", season(date))
