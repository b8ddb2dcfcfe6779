"""Diversity of surveys and the imputation of missing surveys from regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteseries.operators.joins import with_group_stats
from siteseries.functions.numeric import ratio

SURVEY = ["site_code", "collection_period"]


def pseudo_abundance(df: DataFrame, value: str, name: str = "pseudo_abun", scale: float = 1000.0) -> DataFrame:
    return df.withColumn(name, F.ceil(F.col(value) * F.lit(scale)))


def hill_columns(x: str) -> dict[str, Column]:
    """Aggregates for a group with one row per taxon: richness, exponential Shannon and inverse Simpson.

    With N = sum x: ln of the Shannon number is ln N - sum(x ln x)/N and the Simpson number is
    N^2 / sum(x^2), so one partial aggregate is enough and no row needs its survey total.
    """
    c = F.when(F.col(x) > 0, F.col(x).cast("double"))
    n = F.sum(c)
    return {"richness": F.count(c), "shannon": F.exp(F.ln(n) - F.sum(c * F.ln(c)) / n), "simpson": n * n / F.sum(c * c)}


def hill_numbers(df: DataFrame, value: str, unit: list[str] = SURVEY, taxon: str = "lowest_taxon") -> DataFrame:
    """Hill numbers of order 0, 1 and 2 per survey from a long table of any grain."""
    taxa = df.filter(F.col(value) > 0).groupBy(*unit, taxon).agg(F.sum(value).alias("_x"))
    return taxa.groupBy(*unit).agg(*[c.alias(n) for n, c in hill_columns("_x").items()])


def line_fit(df: DataFrame, x: str, ys: list[str], keys: list[str] | None = None) -> DataFrame:
    """Intercept and slope of each y on x (one row per group)."""
    aggs = []
    for y in ys:
        aggs += [F.regr_slope(y, x).alias(f"{y}_slope"), F.regr_intercept(y, x).alias(f"{y}_icpt")]
    return df.groupBy(*(keys or [])).agg(*aggs)


def averaged_prediction(targets: DataFrame, x: str, first: DataFrame, second: DataFrame, ys: list[str],
                        rounded_up: list[str] = ()) -> DataFrame:
    """Mean of two fitted lines at the targets, the second weighted double.

    Each ungrouped fit is one row of constants, which enters the plan as literals.
    """
    a, b = line_fit(first, x, ys).first(), line_fit(second, x, ys).first()
    made = []
    for y in ys:
        p1, p2 = (F.lit(fit[f"{y}_icpt"]) + F.lit(fit[f"{y}_slope"]) * F.col(x) for fit in (a, b))
        mean = (p1 + 2.0 * p2) / 3.0
        made.append((F.ceil(mean).cast("double") if y in rounded_up else mean).alias(y))
    return targets.select(*targets.columns, *made)


def fill_period(actual: DataFrame, simulated: DataFrame, period: str, value, covariate: str, above: float) -> DataFrame:
    """Add simulated surveys of one period for targets whose covariate exceeds a cut."""
    extra = simulated.filter(F.col(covariate) > above).drop(covariate).withColumn(period, F.lit(value).cast("date"))
    return actual.unionByName(extra, allowMissingColumns=True)


def hellinger(df: DataFrame, value: str, unit: list[str] = SURVEY, name: str = "hell") -> DataFrame:
    """Square root of the share of each taxon in its survey; absent taxa stay absent (they are 0)."""
    rows = with_group_stats(df, unit, {"_tot": F.sum(value)})
    return rows.withColumn(name, F.sqrt(ratio(value, "_tot"))).drop("_tot")
