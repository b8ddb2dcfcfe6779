"""Means, covariances and correlations of column sets, computed in chunked aggregates."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteseries.functions.numeric import col, ratio

CHUNK = 120


def corr(a: Column | str, b: Column | str) -> Column:
    """Pearson r over rows where both are known, null where one of them does not vary (`F.corr` raises there)."""
    a, b = col(a), col(b)
    known = a.isNotNull() & b.isNotNull()
    return ratio(F.covar_pop(a, b), F.stddev_pop(F.when(known, a)) * F.stddev_pop(F.when(known, b)))


def pair_aggregates(df: DataFrame, pairs: list[tuple[str, str]], fn, keys: list[str] | None = None) -> list[DataFrame]:
    """One grouped aggregate per chunk of column pairs (a very wide aggregate would not compile well)."""
    out = []
    for i in range(0, len(pairs), CHUNK):
        part = pairs[i:i + CHUNK]
        out.append(df.groupBy(*(keys or [])).agg(*[fn(a, b).alias(f"{a}|{b}") for a, b in part]))
    return out


def pair_products(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, ...]:
    """(means, n, sx, sxx, sxy): for every pair of columns, over rows where both are known, the count and the sums of the
    first, of its square and of the product, all taken from the column means.

    One scan for the means and one for the products, however many columns there are; each task sends its sums only.
    """
    k = len(cols)
    rows = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)])
    head = rows.agg(*[F.avg(c).alias(c) for c in rows.columns]).first()
    means = np.array([0.0 if head[i] is None else head[i] for i in range(k)])

    def fold(batches):
        import pandas as pd

        total = np.zeros((4, k, k))
        for pdf in batches:
            x = pdf.to_numpy(dtype=float) - means
            known = ~np.isnan(x)
            x, m = np.where(known, x, 0.0), known.astype(float)
            total += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        yield pd.DataFrame({"i": np.arange(4 * k * k), "v": total.ravel()})

    sums = rows.mapInPandas(fold, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # 4 k x k numbers
    total = np.zeros(4 * k * k)
    for r in sums:
        total[r["i"]] = r["v"]
    return means, *total.reshape(4, k, k)


def correlations(df: DataFrame, cols: list[str]) -> np.ndarray:
    """Pearson r of every pair of columns over rows where both are known; NaN where it is not defined."""
    _, n, sx, sxx, sxy = pair_products(df, cols)
    with np.errstate(all="ignore"):
        cov, var = sxy - sx * sx.T / n, sxx - sx * sx / n
        return cov / np.sqrt(var * var.T)


def covariance(df: DataFrame, cols: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, covariance with n - 1) over complete rows."""
    means, n, sx, _, sxy = pair_products(df.select(*cols).dropna("any"), cols)
    rows = int(n[0, 0])
    if not rows:
        return 0, np.full(len(cols), np.nan), np.full((len(cols), len(cols)), np.nan)
    off = np.diag(sx) / rows  # what rounding left in the means
    with np.errstate(all="ignore"):
        return rows, means + off, (sxy - rows * np.outer(off, off)) / (rows - 1 if rows > 1 else np.nan)


def group_covariances(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """n, means and all covariances per group as one wide row; complete rows only."""
    rows = df.select(*keys, *cols).dropna("any", subset=cols)
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(c).alias(f"mu|{c}") for c in cols]
    aggs += [F.covar_samp(a, b).alias(f"{a}|{b}") for a, b in combinations_with_replacement(cols, 2)]
    return rows.groupBy(*keys).agg(*aggs)


def matrix_of(row, cols: list[str]) -> np.ndarray:
    """The symmetric matrix held in a row of `group_covariances`."""
    k = len(cols)
    out = np.empty((k, k))
    for i, a in enumerate(cols):
        for j in range(i, k):
            out[i, j] = out[j, i] = row[f"{a}|{cols[j]}"]
    return out
