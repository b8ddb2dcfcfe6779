"""Row and column filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteseries.functions.numeric import col
from siteseries.operators.select import numeric_names


def between_dates(df: DataFrame, date: str, start, end, closed: str = "left") -> DataFrame:
    """Rows of a date range. Bounds are cast once, so the filter reaches the Parquet scan."""
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    d = F.col(date)
    lower = d >= lo if closed in ("left", "both") else d > lo
    upper = d <= hi if closed in ("right", "both") else d < hi
    return df.filter(lower & upper)


def outside_dates(df: DataFrame, date: str, start, end) -> DataFrame:
    """Rows strictly before the start or strictly after the end."""
    d = F.col(date)
    return df.filter((d < F.lit(start).cast("date")) | (d > F.lit(end).cast("date")))


def every_nth_day(df: DataFrame, date: str, n: int = 7) -> DataFrame:
    """Systematic sample: days of the year divisible by n."""
    return df.filter(F.dayofyear(F.col(date)) % n == 0)


def complete_cases(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=cols)


def inside_box(df: DataFrame, x: str, y: str, x_range, y_range) -> DataFrame:
    """Strict bounding box."""
    return df.filter((F.col(x) > x_range[0]) & (F.col(x) < x_range[1])
                     & (F.col(y) > y_range[0]) & (F.col(y) < y_range[1]))


def groups_where(df: DataFrame, keys: list[str], stat: Column, condition) -> DataFrame:
    """Aggregate, then keep the groups for which `condition(stat column)` holds."""
    return df.groupBy(*keys).agg(stat.alias("stat")).filter(condition(F.col("stat")))


def constant_columns(df: DataFrame, cols: list[str] | None = None, tol: float = 1.5e-8) -> list[str]:
    """Numeric columns whose sd is zero or within `tol` of their mean, whatever their unit: one aggregate, one row to the driver."""
    cols = cols or numeric_names(df)
    row = df.agg(*[f(F.col(c)).alias(f"{c}__{n}") for c in cols for n, f in (("sd", F.stddev_samp), ("mid", F.avg))]).first()
    return [c for c in cols if row[f"{c}__sd"] is not None and row[f"{c}__sd"] <= tol * abs(row[f"{c}__mid"])]


def drop_constant_columns(df: DataFrame, cols: list[str] | None = None, tol: float = 1.5e-8) -> DataFrame:
    return df.drop(*constant_columns(df, cols, tol))


def is_member(c: Column | str, values: list) -> Column:
    """Membership that is false, not null, for a null value."""
    return F.coalesce(col(c).isin(*values), F.lit(False))
