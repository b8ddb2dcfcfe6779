"""Assembly of predictor and outcome tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteseries.functions.numeric import ln_pos
from siteseries.operators.aggregate import column_means
from siteseries.operators.fill import group_mean_impute, moving_average_fill
from siteseries.operators.filters import drop_constant_columns
from siteseries.operators.joins import natural_join
from siteseries.operators.ranking import exact_quantiles
from siteseries.operators.reshape import melt
from siteseries.operators.select import numeric_names


def choose_transforms(df: DataFrame, cols: list[str], threshold: float, center: str = "mean") -> list[str]:
    """Columns whose maximum or minimum exceeds `threshold` x the mean (or median).

    One aggregate over all columns, and for medians one job over the melted columns; the driver sees one
    row per column.
    """
    if not cols:
        return []
    row = df.agg(*[f(c).alias(f"{c}__{n}") for c in cols for n, f in (("hi", F.max), ("lo", F.min), ("mid", F.avg))]).first()
    mid = {c: row[f"{c}__mid"] for c in cols}
    if center == "median":
        mid |= {r.xvar: r.me for r in exact_quantiles(melt(df, [], cols), ["xvar"], "xval", {"me": 0.5}).collect()}
    return [c for c in cols if mid[c] and max(row[f"{c}__hi"] / mid[c], row[f"{c}__lo"] / mid[c]) > threshold]


def transform_columns(df: DataFrame, cols: list[str], how: str = "ln", prefix: str | None = None) -> DataFrame:
    """Replace columns by their log (null where not positive) or square root, under a prefixed name."""
    prefix = prefix or f"{how}_"
    fn = ln_pos if how == "ln" else (lambda c: F.when(F.col(c) >= 0, F.sqrt(c)))
    return df.withColumns({prefix + c: fn(c) for c in cols}).drop(*cols)


def reduce_skew(df: DataFrame, keys: list[str], ln_above: float = 50.0, sqrt_above: float = 5.0,
                center: str = "median", compat: bool = False) -> DataFrame:
    """Log the most skewed columns and take roots of the moderately skewed ones.

    `compat=True` also logs the second set (while still naming it sqrt_).
    """
    cols = numeric_names(df, keys)
    logged = choose_transforms(df, cols, ln_above, center)
    rooted = choose_transforms(df, [c for c in cols if c not in logged], sqrt_above, center)
    out = transform_columns(df, logged, "ln")
    return transform_columns(out, rooted, "ln" if compat else "sqrt", "sqrt_")


def long_term_predictors(site_attributes: DataFrame, flow_indices: DataFrame, monthly: DataFrame,
                         monthly_cols: list[str], site: str = "site_code") -> DataFrame:
    """One row per site: attributes, flow indices and study averages, constant columns removed."""
    out = natural_join(site_attributes, flow_indices, "left", [site])
    out = natural_join(out, column_means(monthly, [site], monthly_cols), "left", [site])
    return drop_constant_columns(out)


def short_term_predictors(base: DataFrame, others: list[DataFrame], keys: list[str]) -> DataFrame:
    """One row per key: tables joined on the keys, duplicates averaged for every numeric column."""
    out = base
    for other in others:
        out = natural_join(out, other, "left", keys)
    return column_means(out, keys, numeric_names(out, keys))


def model_matrix(outcomes: DataFrame, predictors: DataFrame, cols: list[str], site: str = "site_code",
                 period: str = "collection_period", k: int = 4) -> DataFrame:
    """Outcomes with predictors whose gaps take the mean of site and quarter, then neighbours in time."""
    filled = group_mean_impute(predictors.withColumn("qtr", F.quarter(period)), [site, "qtr"], cols)
    filled = moving_average_fill(filled, [site], period, cols, k)
    return natural_join(outcomes, filled, "left", [site, period])
