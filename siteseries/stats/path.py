"""Recursive path models on observed variables."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteseries.functions.special import chi2_upper
from siteseries.operators.joins import natural_join
from siteseries.session import scratch_path
from siteseries.sources.files import stage
from siteseries.stats.moments import group_covariances, matrix_of


def parse(equations: list[str]) -> list[tuple[str, list[str]]]:
    """'y ~ a + b' lines as (response, predictors)."""
    out = []
    for eq in equations:
        left, right = eq.split("~")
        out.append((left.strip(), [v.strip() for v in right.split("+")]))
    return out


def _variables(model) -> tuple[list[str], list[str]]:
    inner = [y for y, _ in model]
    seen = [x for _, xs in model for x in xs]
    outer = [x for x in dict.fromkeys(seen) if x not in inner]
    return inner, outer


def solve_path(s: np.ndarray, names: list[str], model, n: int) -> tuple[list[tuple], dict]:
    """Equation-wise estimates from the covariance matrix (divisor n) and the fit of the implied matrix."""
    at = {c: i for i, c in enumerate(names)}
    inner, outer = _variables(model)
    k = len(names)
    b, psi = np.zeros((k, k)), np.zeros((k, k))
    estimates = []
    for y, xs in model:
        ix, iy = [at[x] for x in xs], at[y]
        beta = np.linalg.solve(s[np.ix_(ix, ix)], s[ix, iy])
        b[iy, ix] = beta
        psi[iy, iy] = s[iy, iy] - s[ix, iy] @ beta
        estimates += [(y, x, float(v), float(v * math.sqrt(s[at[x], at[x]] / s[iy, iy]))) for x, v in zip(xs, beta)]
    io = [at[x] for x in outer]
    psi[np.ix_(io, io)] = s[np.ix_(io, io)]
    total = np.linalg.inv(np.eye(k) - b)
    sigma = total @ psi @ total.T
    f = np.linalg.slogdet(sigma)[1] - np.linalg.slogdet(s)[1] + np.trace(s @ np.linalg.inv(sigma)) - k
    q, e = len(outer), len(inner)
    free = sum(len(xs) for _, xs in model) + e + q * (q + 1) // 2
    df = k * (k + 1) // 2 - free
    chi2 = max(n * f, 0.0)
    # independence model: inner variables uncorrelated with everything, outer ones left as observed
    base = np.zeros((k, k))
    base[np.diag_indices(k)] = np.diag(s)
    base[np.ix_(io, io)] = s[np.ix_(io, io)]
    fb = np.linalg.slogdet(base)[1] - np.linalg.slogdet(s)[1]
    df_b = e * (e - 1) // 2 + e * q
    chi2_b = n * fb
    d, d_b = max(chi2 - df, 0.0), max(chi2_b - df_b, chi2 - df, 0.0)
    sd = np.sqrt(np.diag(s))
    resid = (s - sigma) / np.outer(sd, sd)
    fit = {
        "chi2": chi2, "df": df, "p_value": float(chi2_upper(chi2, df)[0]) if df > 0 else None,
        "rmsea": math.sqrt(d / (df * n)) if df > 0 else 0.0,
        "cfi": 1.0 - d / d_b if d_b > 0 else 1.0,
        "srmr": math.sqrt(float((resid[np.tril_indices(k)] ** 2).mean())),
    }
    return estimates, fit


def fit_label(chi2: Column | str = "chi2", rmsea: Column | str = "rmsea", cfi: Column | str = "cfi",
              chi2_min: float = 0.05, rmsea_max: float = 0.08, cfi_min: float = 0.9) -> Column:
    """Good or Poor. The threshold is on the chi-square value itself; pass a p column for the usual test."""
    good = (F.col(chi2) > chi2_min) & (F.col(rmsea) < rmsea_max) & (F.col(cfi) > cfi_min)
    return F.when(good, "Good").otherwise("Poor")


def path_models(df: DataFrame, outcomes: list[str], equations: list[str], keys: list[str],
                placeholder: str = "OUTCOME") -> tuple[DataFrame, DataFrame]:
    """(parameters, fit indices) of the same path model for several outcomes and groups.

    Outcomes are melted beside the shared variables, Spark aggregates one covariance row per group and
    outcome, and tasks solve the small systems on those result rows.
    """
    model = parse([e.replace(placeholder, "_y") for e in equations])
    inner, outer = _variables(model)
    names = inner + outer
    shared = [c for c in names if c != "_y"]
    cells = F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).cast("double").alias("_y")) for o in outcomes])
    rows = df.select(*keys, *shared, F.explode(cells).alias("_o")).select(*keys, *shared, "_o.outcome", "_o._y")
    wide = group_covariances(rows, [*keys, "outcome"], names)
    types = dict(wide.dtypes)
    head = ", ".join(f"`{k}` {types[k]}" for k in [*keys, "outcome"])
    schema = (f"{head}, response string, predictor string, estimate double, std_estimate double, nobs bigint, "
              "chi2 double, df int, p_value double, rmsea double, cfi double, srmr double")

    def solve(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for rec in pdf.to_dict("records"):
                n = rec["n"]
                if n <= len(names) + 1:
                    continue
                s = matrix_of(rec, names) * (n - 1) / n
                if not np.isfinite(s).all() or np.linalg.matrix_rank(s) < len(names):
                    continue
                estimates, fit = solve_path(s, names, model, n)
                for y, x, est, std in estimates:
                    out.append([*[rec[k] for k in keys], rec["outcome"], rec["outcome"] if y == "_y" else y, x,
                                est, std, n, *fit.values()])
            yield pd.DataFrame(out, columns=[*keys, "outcome", "response", "predictor", "estimate", "std_estimate",
                                             "nobs", "chi2", "df", "p_value", "rmsea", "cfi", "srmr"])

    # one row per parameter: written once, read for both result tables
    table = stage(wide.mapInPandas(solve, schema), scratch_path(df.sparkSession, "paths"))
    params = table.select(*keys, "outcome", "response", "predictor", "estimate", "std_estimate", "nobs")
    fits = table.select(*keys, "outcome", "nobs", "chi2", "df", "p_value", "rmsea", "cfi", "srmr").distinct()
    return params, fits.withColumn("model_fit", fit_label())


def compare_sets(params: DataFrame, fits: DataFrame, by: str, names: dict[str, str], rename: dict[str, str]) -> DataFrame:
    """Parameters of well-fitting models of two data sets side by side, with shared variable names."""
    good = natural_join(params, fits.filter(F.col("model_fit") == "Good").select(by, "outcome"), "inner", [by, "outcome"])
    for c in ("response", "predictor"):
        for pattern, repl in rename.items():
            good = good.withColumn(c, F.regexp_replace(c, re.compile(pattern).pattern, repl))
    sides = [good.filter(F.col(by) == value).select(
        "outcome", "response", "predictor", F.col("estimate").alias(f"estimate_{tag}"),
        F.col("std_estimate").alias(f"std_estimate_{tag}")).distinct() for value, tag in names.items()]
    return natural_join(sides[0], sides[1], "left", ["outcome", "response", "predictor"])
