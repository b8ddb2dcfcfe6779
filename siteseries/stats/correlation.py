"""Correlation tables."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteseries.stats.moments import corr, correlations, pair_aggregates


def _long(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    melted = []
    for part in parts:
        names = [c for c in part.columns if c not in keys]
        melted.append(part.unpivot(keys, names, "pair", "r"))
    rows = reduce(lambda a, b: a.unionByName(b), melted)
    cells = F.split("pair", r"\|")
    return rows.select(*keys, cells.getItem(0).alias("x"), cells.getItem(1).alias("y"), "r")


def correlation_pairs(df: DataFrame, cols: list[str], keys: list[str] | None = None) -> DataFrame:
    """Pearson r for each pair (lower triangle), pairwise complete."""
    if keys:
        return _long(pair_aggregates(df, [(b, a) for a, b in combinations(cols, 2)], corr, keys), keys)
    r = correlations(df, cols)
    rows = [(cols[j], cols[i], None if r[i, j] != r[i, j] else float(r[i, j])) for i, j in combinations(range(len(cols)), 2)]
    return df.sparkSession.createDataFrame(rows, "x string, y string, r double")


def correlation_matrix(df: DataFrame, cols: list[str], digits: int = 2) -> DataFrame:
    """Lower triangle as a wide table, rounded; upper cells null."""
    long = correlation_pairs(df, cols)
    cells = [F.first(F.when(F.col("y") == c, F.col("r")), ignorenulls=True) for c in cols]
    return long.groupBy(F.col("x").alias("term")).agg(*[F.round(v, digits).alias(c) for v, c in zip(cells, cols)])


def target_correlations(df: DataFrame, targets: list[str], predictors: list[str], keys: list[str]) -> DataFrame:
    """r of every predictor with every target per group, over rows that are complete."""
    rows = df.select(*keys, *targets, *predictors).dropna("any")
    return _long(pair_aggregates(rows, [(t, p) for t in targets for p in predictors], corr, keys), keys)


def by_strength(r: str = "r") -> list[Column]:
    """Sort order: strongest first, nulls last."""
    return [F.abs(F.col(r)).desc_nulls_last()]
