"""Least squares by group from aggregated moments."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteseries.functions.numeric import ratio
from siteseries.functions.special import t_two_sided
from siteseries.operators.joins import natural_join
from siteseries.stats.moments import covariance, group_covariances, matrix_of


def simple_ols(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """slope, intercept, r2, F statistic, t statistic, standard error and n per group, in one aggregate."""
    fit = df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("nobs"))
    return fit.withColumns({
        "f_stat": ratio(F.col("r2") * (F.col("nobs") - 2), 1.0 - F.col("r2")),
        "t_stat": F.signum("slope") * F.sqrt(ratio(F.col("r2") * (F.col("nobs") - 2), 1.0 - F.col("r2"))),
    }).withColumn("std_error", ratio("slope", "t_stat"))


def outcome_by_predictor_ols(df: DataFrame, keys: list[str], outcomes: list[str], predictors: list[str]) -> DataFrame:
    """`simple_ols` for every outcome x predictor pair and group; the rows are melted before the one shuffle."""
    pairs = F.array(*[
        F.struct(F.lit(o).alias("outcome"), F.lit(p).alias("predictor"),
                 F.col(o).cast("double").alias("y"), F.col(p).cast("double").alias("x"))
        for o, p in itertools.product(outcomes, predictors)])
    rows = df.select(*keys, F.explode(pairs).alias("c")).select(*keys, "c.*")
    return simple_ols(rows, [*keys, "outcome", "predictor"], "x", "y")


def _solve(s: np.ndarray, means: np.ndarray, n: float) -> dict:
    """OLS of the last variable on the others, from a covariance matrix with n - 1."""
    k = s.shape[0] - 1
    sxx, sxy, syy = s[:k, :k], s[:k, k], s[k, k]
    inv = np.linalg.inv(sxx)
    beta = inv @ sxy
    df = n - k - 1
    rss = max((syy - sxy @ beta) * (n - 1), 0.0)
    sigma2 = rss / df if df > 0 else np.nan
    se = np.sqrt(np.diag(inv) * sigma2 / (n - 1))
    b0 = means[k] - means[:k] @ beta
    se0 = np.sqrt(sigma2 * (1.0 / n + means[:k] @ inv @ means[:k] / (n - 1)))
    return {"beta": np.concatenate([[b0], beta]), "se": np.concatenate([[se0], se]),
            "df": df, "rss": rss, "r2": 1.0 - rss / (syy * (n - 1)) if syy > 0 else np.nan}


def multiple_ols(df: DataFrame, keys: list[str], xs: list[str], y: str) -> DataFrame:
    """Coefficient table per group. Spark aggregates the moments; each task solves small systems row by row."""
    cols = [*xs, y]
    wide = group_covariances(df, keys, cols)
    types = dict(wide.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys]
                       + ["term string", "estimate double", "std_error double", "statistic double",
                          "p_value double", "r2 double", "nobs bigint"])

    def solve(batches):
        for pdf in batches:
            rows = []
            for rec in pdf.to_dict("records"):
                n = rec["n"]
                if n <= len(xs) + 1:
                    continue
                s = matrix_of(rec, cols)
                if not np.isfinite(s).all() or np.linalg.matrix_rank(s[:-1, :-1]) < len(xs):
                    continue
                fit = _solve(s, np.array([rec[f"mu|{c}"] for c in cols]), n)
                t = fit["beta"] / fit["se"]
                p = t_two_sided(t, fit["df"]) if fit["df"] > 0 else np.full(len(t), np.nan)
                for i, term in enumerate(["(Intercept)", *xs]):
                    rows.append([*[rec[k] for k in keys], term, fit["beta"][i], fit["se"][i], t[i], p[i], fit["r2"], n])
            yield pd.DataFrame(rows, columns=[*keys, "term", "estimate", "std_error", "statistic", "p_value", "r2", "nobs"])

    return wide.mapInPandas(solve, schema)


def quadratic_fit(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """y = b0 + b1 x + b2 x^2 and the straight line, from power sums about the group mean of x.

    Rows meet their group mean first, so the powers stay small; coefficients are in terms of x - mean.
    """
    from siteseries.operators.joins import with_group_stats

    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = with_group_stats(rows, keys, {"x_mu": F.avg(x)}, small=bool(keys)).withColumn("_u", F.col(x) - F.col("x_mu"))
    u, v = F.col("_u"), F.col(y)
    s = rows.groupBy(*keys).agg(
        F.max("x_mu").alias("x_mu"), F.count(F.lit(1)).alias("nobs"),
        *[F.sum(F.pow(u, i)).alias(f"s{i}") for i in (1, 2, 3, 4)],
        F.sum(v).alias("t0"), F.sum(u * v).alias("t1"), F.sum(u * u * v).alias("t2"),
        F.regr_r2(y, "_u").alias("r2_line"), F.regr_slope(y, "_u").alias("slope_line"))
    n, s1, s2, s3, s4 = (F.col(c) for c in ("nobs", "s1", "s2", "s3", "s4"))
    t0, t1, t2 = F.col("t0"), F.col("t1"), F.col("t2")

    def det(a, b, c, d, e, f, g, h, i) -> Column:
        return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)

    base = det(n, s1, s2, s1, s2, s3, s2, s3, s4)
    return s.select(
        *keys, "nobs", "x_mu", "slope_line", "r2_line",
        ratio(det(t0, s1, s2, t1, s2, s3, t2, s3, s4), base).alias("b0"),
        ratio(det(n, t0, s2, s1, t1, s3, s2, t2, s4), base).alias("b1"),
        ratio(det(n, s1, t0, s1, s2, t1, s2, s3, t2), base).alias("b2"))


def stepwise_aic(df: DataFrame, y: str, candidates: list[str], direction: str = "both",
                 start: list[str] | None = None) -> dict:
    """Add or drop one predictor at a time while n ln(RSS/n) + 2p falls.

    The data are read once for the covariance matrix; every sub-model is solved from it.
    """
    cols = [*candidates, y]
    n, means, cov = covariance(df, cols)
    at = {c: i for i, c in enumerate(cols)}

    def aic(names: tuple) -> float:
        if not names:
            rss = cov[-1, -1] * (n - 1)
        else:
            pick = [at[c] for c in names] + [len(cols) - 1]
            rss = _solve(cov[np.ix_(pick, pick)], means[pick], n)["rss"]
        return n * np.log(max(rss, 1e-300) / n) + 2 * (len(names) + 1)

    current = tuple(candidates if start is None else start)
    trail = [("start", "", aic(current))]
    while True:
        moves = [("drop", c, tuple(x for x in current if x != c)) for c in current] if direction in ("both", "backward") else []
        if direction in ("both", "forward"):
            moves += [("add", c, tuple(x for x in candidates if x in current or x == c)) for c in candidates if c not in current]
        scored = [(aic(names), action, c, names) for action, c, names in moves]
        if not scored:
            break
        best = min(scored, key=lambda m: (m[0], m[2]))
        if best[0] >= trail[-1][2] - 1e-10:
            break
        current = best[3]
        trail.append((best[1], best[2], best[0]))
    return {"terms": list(current), "aic": trail[-1][2], "trail": trail, "n": n}


def label_trend(fit: DataFrame, p: str = "p_value", r2: str = "r2", alpha: float = 0.05, r2_min: float = 0.1) -> DataFrame:
    """Mark the fits whose trend line is worth drawing."""
    return fit.withColumn("draw", F.coalesce((F.col(p) < alpha) | (F.col(r2) > r2_min), F.lit(False)))


def weighted_slope(df: DataFrame, keys: list[str], x: str, y: str, weight: str) -> DataFrame:
    """Slope of y on x per group with row weights; means first, then sums of products taken from them."""
    w = F.col(weight)
    means = df.groupBy(*keys).agg((F.sum(w * F.col(x)) / F.sum(w)).alias("_mx"), (F.sum(w * F.col(y)) / F.sum(w)).alias("_my"))
    dx, dy = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    return natural_join(df, means, "inner", keys).groupBy(*keys).agg(ratio(F.sum(w * dx * dy), F.sum(w * dx * dx)).alias("slope"))
