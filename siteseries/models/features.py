"""Feature steps fitted on training rows and applied to all rows."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteseries.functions.numeric import ratio


def normalise(df: DataFrame, cols: list[str], train: Column) -> DataFrame:
    """(x - mean) / sd with both taken from the training rows (one row of constants)."""
    aggs = []
    for c in cols:
        x = F.when(train, F.col(c))
        aggs += [F.avg(x).alias(f"{c}__mu"), F.stddev_samp(x).alias(f"{c}__sd")]
    row = df.agg(*aggs).first()
    made = {}
    for c in cols:
        mu, sd = row[f"{c}__mu"], row[f"{c}__sd"]
        made[c] = ratio(F.col(c) - F.lit(mu), F.lit(sd)) if mu is not None and sd else F.col(c)
    return df.withColumns(made)


def polynomial(df: DataFrame, cols: list[str], degree: int = 2, interactions: bool = True) -> tuple[DataFrame, list[str]]:
    """Powers up to `degree` and products of all pairs, as named columns."""
    made = {f"{c}_p{d}": F.pow(c, d) for c in cols for d in range(2, degree + 1)}
    if interactions:
        made |= {f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in itertools.combinations(cols, 2)}
    return df.withColumns(made), [*cols, *made]


def orthogonal_polynomial(df: DataFrame, cols: list[str], train: Column, degree: int = 2) -> tuple[DataFrame, list[str]]:
    """Polynomials of each column up to `degree` that are orthonormal over the training rows, as columns `<c>_o1`, `<c>_o2`, ...

    The three-term recurrence p[k+1] = (x - a[k]) p[k] - b[k] p[k-1] needs sums of powers over the training rows only: one aggregate
    over all columns, taken about their means and in units of their sd so that high powers stay exact. The recurrence is then
    applied to every row as plain column expressions. A column with fewer distinct training values than a degree needs, and
    null or missing values, give nulls.
    """
    heads = df.agg(*[f(F.when(train, F.col(c))).alias(f"{c}|{n}") for c in cols for n, f in (("mu", F.avg), ("sd", F.stddev_pop))]).first()
    z = {c: (F.col(c) - F.lit(heads[f"{c}|mu"] or 0.0)) / F.lit(heads[f"{c}|sd"] or 1.0) for c in cols}
    sums = df.agg(*[F.sum(F.when(train, F.pow(z[c], d))).alias(f"{c}|{d}") for c in cols for d in range(2 * degree + 2)]).first()
    made = {}
    for c in cols:
        power = np.array([sums[f"{c}|{d}"] if sums[f"{c}|{d}"] is not None else np.nan for d in range(2 * degree + 2)])

        def inner(p: np.ndarray, q: np.ndarray, power=power) -> float:
            """The sum of p q over the training rows; p and q are coefficients from the lowest."""
            both = np.convolve(p, q)
            return float(both @ power[:len(both)])

        before, now, size_before = np.zeros(1), np.ones(1), 1.0
        before_x, now_x = F.lit(0.0), F.lit(1.0)
        for k in range(degree):
            size = inner(now, now)
            ok = size > 1e-9 * abs(power[0])
            a = inner(np.r_[0.0, now], now) / size if ok else np.nan
            b = size / size_before if k and ok else 0.0
            after = np.r_[0.0, now] - np.r_[a * now, 0.0]
            after[:len(before)] -= b * before
            after_x = (z[c] - F.lit(float(a))) * now_x - F.lit(float(b)) * before_x
            before, now, size_before, before_x, now_x = now, after, size, now_x, after_x
            norm = inner(now, now)
            fine = ok and np.isfinite(norm) and norm > 1e-9 * abs(power[0])
            made[f"{c}_o{k + 1}"] = now_x / F.lit(float(np.sqrt(norm))) if fine else F.lit(None).cast("double")
    return df.withColumns(made), list(made)


def reduced_features(cols: list[str], reduce: list[str], k: int = 2) -> list:
    """ML stages that replace some columns by k principal components."""
    rest = [c for c in cols if c not in reduce]
    return [
        VectorAssembler(inputCols=reduce, outputCol="_raw", handleInvalid="skip"),
        StandardScaler(inputCol="_raw", outputCol="_std", withMean=True, withStd=True),
        PCA(k=k, inputCol="_std", outputCol="_pcs"),
        VectorAssembler(inputCols=[*rest, "_pcs"], outputCol="features", handleInvalid="skip"),
    ]


def standard_features(cols: list[str]) -> list:
    return [VectorAssembler(inputCols=cols, outputCol="_raw", handleInvalid="skip"),
            StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True)]


def workflow(stages: list, engine) -> Pipeline:
    return Pipeline(stages=[*stages, engine])
