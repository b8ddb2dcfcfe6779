"""Random-intercept and random-slope models with optional AR(1) errors, by REML.

Spark folds the rows of each group (site) into cross-products, including those with the previous row.
Each search round evaluates a batch of variance parameters on that table: tasks add the groups of their
batch in numpy, a shuffle adds the partial sums, and the driver sees one row per model and parameter.
The number of models is the number of outcome x predictor pairs, not a function of the data.
"""

from __future__ import annotations

import itertools
import json
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteseries.functions.special import t_two_sided
from siteseries.operators.joins import natural_join, settled
from siteseries.session import scratch_path
from siteseries.sources.files import stage


def group_products(df: DataFrame, models: list[str], group: str, time: str, xs: list[str], y: str) -> DataFrame:
    """Per model and group: n and arrays s0, si, s1 over the column pairs of (1, xs, y).

    s0 = sum a b, si = the same without the first and last row, s1 = sum of the lag-1 products. Rows are one
    per group and time, so the ordered window is bounded by the calendar.
    """
    cols = ["_one", *xs, y]
    rows = df.select(*models, group, time, *xs, y).dropna("any", subset=[*xs, y]).withColumn("_one", F.lit(1.0))
    by_time = Window.partitionBy(*models, group).orderBy(time)
    rows = rows.withColumns({f"_p_{c}": F.lag(c).over(by_time) for c in cols})
    rows = rows.withColumn("_t", F.col(time))
    pairs = list(itertools.combinations_with_replacement(cols, 2))
    first, last = lambda a: F.min_by(a, "_t"), lambda a: F.max_by(a, "_t")
    s0, si, s1 = [], [], []
    for a, b in pairs:
        ab = F.col(a) * F.col(b)
        s0.append(F.sum(ab))
        si.append(F.sum(ab) - first(ab) - last(ab))
        s1.append(F.coalesce(F.sum(F.col(a) * F.col(f"_p_{b}") + F.col(f"_p_{a}") * F.col(b)), F.lit(0.0)))
    return rows.groupBy(*models, group).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.array(*s0).alias("s0"), F.array(*si).alias("si"), F.array(*s1).alias("s1"))


def _square(packed: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((packed.shape[0], k, k))
    for c, (i, j) in enumerate(itertools.combinations_with_replacement(range(k), 2)):
        out[:, i, j] = out[:, j, i] = packed[:, c]
    return out


def _psi(theta: np.ndarray, q: int) -> tuple[np.ndarray, float]:
    """(relative covariance of the random effects, AR parameter) from unbounded search parameters."""
    sd = np.exp(theta[:q])
    phi = math.tanh(theta[-1])
    if q == 1:
        return np.array([[sd[0] ** 2]]), phi
    rho = math.tanh(theta[q])
    return np.array([[sd[0] ** 2, rho * sd[0] * sd[1]], [rho * sd[0] * sd[1], sd[1] ** 2]]), phi


def _weighted(n, s0, si, s1, z, theta):
    """(K x K products in the metric V^-1, ln|V|, M^-1, U) for each group."""
    psi, phi = _psi(theta, len(z))
    r = (s0 + phi * phi * si - phi * s1) / (1.0 - phi * phi)
    u = r[:, :, z]
    m = np.linalg.inv(psi)[None] + r[:, z][:, :, z]
    minv = np.linalg.inv(m)
    v = r - u @ minv @ np.swapaxes(u, 1, 2)
    logdet = (n - 1.0) * math.log(1.0 - phi * phi) + np.linalg.slogdet(psi)[1] + np.linalg.slogdet(m)[1]
    return v, logdet, minv, u


def _reml(total: np.ndarray, logdet: float, n: float) -> dict:
    p = total.shape[0] - 1
    a, b, c = total[:p, :p], total[:p, p], total[p, p]
    ainv = np.linalg.inv(a)
    beta = ainv @ b
    rss = max(c - b @ beta, 1e-300)
    s2 = rss / (n - p)
    ll = -0.5 * ((n - p) * (math.log(2.0 * math.pi * s2) + 1.0) + logdet + np.linalg.slogdet(a)[1])
    return {"ll": ll, "beta": beta, "se": np.sqrt(np.diag(ainv) * s2), "s2": s2}


@dataclass
class MixedFit:
    coefficients: DataFrame
    summary: DataFrame
    effects: DataFrame


def fit_mixed(df: DataFrame, models: list[str], group: str, time: str, xs: list[str], y: str,
              slope: str | None = None, ar1: bool = False, rounds: int = 7) -> MixedFit:
    """y ~ xs with a random intercept per group, plus a random slope on `slope` when given."""
    spark = df.sparkSession
    products = stage(group_products(df, models, group, time, xs, y), scratch_path(spark, "products"))
    k = len(xs) + 2
    z = [0] if slope is None else [0, 1 + xs.index(slope)]
    q = len(z)
    dims = q + (q - 1) + 1
    free = [i for i in range(dims) if i < dims - 1 or ar1]
    lanes = [np.linspace(-4.0, 3.0, 8)] * q + [np.array([-0.6, 0.0, 0.6])] * (q - 1) + [
        np.array([-0.5, 0.0, 0.5]) if ar1 else np.array([0.0])]
    grid0 = [list(map(float, t)) for t in itertools.product(*lanes)]
    npair = k * (k + 1) // 2

    def evaluate(grids: dict | None) -> dict:
        """Best parameter per model among its own grid (or the common first grid)."""
        def partial(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                out = []
                for key, part in pdf.groupby("_m", sort=False):
                    n = part["n"].to_numpy(float)
                    s0, si, s1 = (_square(np.stack(part[c].to_numpy()), k) for c in ("s0", "si", "s1"))
                    for i, theta in enumerate(grid0 if grids is None else grids[key]):
                        v, logdet, _, _ = _weighted(n, s0, si, s1, z, np.array(theta))
                        total = v.sum(axis=0)
                        out.append([key, i, n.sum(), len(n), logdet.sum(),
                                    *[total[a, b] for a, b in itertools.combinations_with_replacement(range(k), 2)]])
                yield pd.DataFrame(out, columns=["_m", "i", "n", "groups", "logdet", *[f"v{c}" for c in range(npair)]])

        coded = products.withColumn("_m", F.to_json(F.struct(*models))).select("_m", "n", "s0", "si", "s1")
        schema = "_m string, i int, n double, groups bigint, logdet double, " + ", ".join(f"v{c} double" for c in range(npair))
        sums = coded.mapInPandas(partial, schema).groupBy("_m", "i").agg(
            *[F.sum(c).alias(c) for c in ("n", "groups", "logdet", *[f"v{c}" for c in range(npair)])]).collect()
        best: dict = {}
        for row in sums:
            key = row["_m"]
            theta = (grid0 if grids is None else grids[key])[row["i"]]
            total = _square(np.array([[row[f"v{c}"] for c in range(npair)]]), k)[0]
            if row["n"] <= k or np.linalg.matrix_rank(total[:-1, :-1]) < k - 1:
                continue
            fit = _reml(total, row["logdet"], row["n"])
            if key not in best or fit["ll"] > best[key]["ll"]:
                best[key] = fit | {"theta": theta, "n": row["n"], "groups": row["groups"]}
        return best

    best = evaluate(None)
    step = np.array([1.0] * q + [0.4] * (q - 1) + [0.3])
    offsets = (-1.0, -0.5, 0.0, 0.5, 1.0) if len(free) <= 2 else (-1.0, 0.0, 1.0)
    for _ in range(rounds):
        grids = {}
        for key, fit in best.items():
            around = []
            for move in itertools.product(*[offsets if i in free else (0.0,) for i in range(dims)]):
                t = np.array(fit["theta"]) + step * np.array(move)
                t[:q] = np.clip(t[:q], -9.0, 9.0)
                t[q:] = np.clip(t[q:], -3.0, 3.0)
                around.append(list(map(float, t)))
            grids[key] = around
        if grids:
            # models without an estimate keep the common grid and stay without one
            known = products.select(F.to_json(F.struct(*models)).alias("_m")).distinct().count()
            if known > len(grids):
                for row in products.select(F.to_json(F.struct(*models)).alias("_m")).distinct().collect():
                    grids.setdefault(row["_m"], [grid0[0]])
            fresh = evaluate(grids)
            best = {key: fresh[key] if fresh[key]["ll"] >= best[key]["ll"] else best[key] for key in best}
        step = step * 0.55

    return _tables(spark, products, models, group, xs, z, best, k, ar1)


def _group_level(products: DataFrame, models: list[str], xs: list[str]) -> dict[str, list[bool]]:
    """Per model, which predictors never vary within a group: they are tested on the number of groups."""
    pairs = list(itertools.combinations_with_replacement(range(len(xs) + 2), 2))
    aggs = []
    for i in range(1, len(xs) + 1):
        squares, sums = F.get("s0", F.lit(pairs.index((i, i)))), F.get("s0", F.lit(pairs.index((0, i))))
        aggs += [F.sum(squares - sums * sums / F.col("n")).alias(f"w{i}"), F.sum(squares).alias(f"t{i}")]
    rows = products.groupBy(F.to_json(F.struct(*models)).alias("_m")).agg(*aggs).collect()
    return {r["_m"]: [r[f"w{i}"] <= 1e-9 * r[f"t{i}"] for i in range(1, len(xs) + 1)] for r in rows}


def _tables(spark, products: DataFrame, models, group, xs, z, best, k, ar1) -> MixedFit:
    q = len(z)
    kinds = dict(products.dtypes)
    head = ", ".join(f"`{m}` {kinds[m]}" for m in models)
    coef_rows, sum_rows, fixed = [], [], _group_level(products, models, xs)
    for key, fit in best.items():
        ids = list(json.loads(key).values())
        psi, phi = _psi(np.array(fit["theta"]), q)
        p = len(fit["beta"])
        params = p + 1 + q + (q - 1) + (1 if ar1 else 0)
        outer = sum(fixed[key])
        inner_df, outer_df = fit["n"] - fit["groups"] - (p - 1 - outer), fit["groups"] - 1 - outer
        for term, b, se, at_group in zip(["(Intercept)", *xs], fit["beta"], fit["se"], [False, *fixed[key]]):
            t = b / se
            pv = float(t_two_sided(t, max(outer_df if at_group else inner_df, 1.0))[0])
            coef_rows.append((*ids, term, float(b), float(se), float(t), pv))
        sum_rows.append((*ids, float(fit["ll"]), float(-2 * fit["ll"] + 2 * params), math.sqrt(fit["s2"]),
                         math.sqrt(fit["s2"] * psi[0, 0]),
                         math.sqrt(fit["s2"] * psi[1, 1]) if q == 2 else None, phi if ar1 else None,
                         int(fit["n"]), int(fit["groups"])))
    coefficients = spark.createDataFrame(
        coef_rows, f"{head}, term string, estimate double, std_error double, statistic double, p_value double")
    summary = spark.createDataFrame(
        sum_rows, f"{head}, loglik double, aic double, sigma double, sd_intercept double, sd_slope double, phi double, nobs bigint, groups bigint")
    gtype = kinds[group]

    def effects(batches):
        for pdf in batches:
            out = []
            for key, part in pdf.groupby("_m", sort=False):
                if key not in best:
                    continue
                fit = best[key]
                n = part["n"].to_numpy(float)
                s0, si, s1 = (_square(np.stack(part[c].to_numpy()), k) for c in ("s0", "si", "s1"))
                theta = np.array(fit["theta"])
                v, _, _, _ = _weighted(n, s0, si, s1, z, theta)
                psi, _ = _psi(theta, q)
                # effect = Psi Z' V^-1 (y - X beta)
                r = v[:, z, k - 1] - v[:, z][:, :, :k - 1] @ fit["beta"]
                b = r @ psi
                ids = list(json.loads(key).values())
                for i, g in enumerate(part[group]):
                    full = [fit["beta"][c] + b[i, j] for j, c in enumerate(z)]
                    out.append([*ids, g, n[i], b[i, 0], full[0], b[i, 1] if q == 2 else None, full[1] if q == 2 else None])
            yield pd.DataFrame(out, columns=[*models, group, "n", "intercept_effect", "intercept", "slope_effect", "slope"])

    coded = products.withColumn("_m", F.to_json(F.struct(*models)))
    table = coded.mapInPandas(effects, f"{head}, `{group}` {gtype}, n double, intercept_effect double, intercept double, "
                                       "slope_effect double, slope double")
    return MixedFit(coefficients, summary, table)


def outcome_predictor_rows(df: DataFrame, ids: list[str], outcomes: list[str], predictors: list[str]) -> DataFrame:
    """(outcome, predictor, y, x) rows for a grid of models."""
    cells = F.array(*[
        F.struct(F.lit(o).alias("outcome"), F.lit(p).alias("predictor"), F.col(o).cast("double").alias("y"),
                 F.col(p).cast("double").alias("x")) for o, p in itertools.product(outcomes, predictors)])
    return df.select(*ids, F.explode(cells).alias("c")).select(*ids, "c.*")


def residuals(rows: DataFrame, fit: MixedFit, models: list[str], group: str, xs: list[str], y: str,
              slope: str | None = None) -> DataFrame:
    """Fitted values and residuals with the group effects included."""
    terms = fit.coefficients.groupBy(*models).pivot("term", ["(Intercept)", *xs]).agg(F.first("estimate"))
    terms = terms.toDF(*models, "_b0", *[f"_b_{x}" for x in xs])
    out = natural_join(rows, settled(terms), "inner", models)
    out = natural_join(out, settled(fit.effects.select(*models, group, "intercept_effect", "slope_effect")), "inner", [*models, group])
    fitted = F.col("_b0") + F.col("intercept_effect")
    for x in xs:
        fitted = fitted + F.col(f"_b_{x}") * F.col(x)
    if slope is not None:
        fitted = fitted + F.col("slope_effect") * F.col(slope)
    return (out.withColumn("fitted", fitted).withColumn("residual", F.col(y) - fitted)
            .drop("_b0", *[f"_b_{x}" for x in xs], "intercept_effect", "slope_effect"))


def model_table(fit: MixedFit, models: list[str], term: str, slopes: DataFrame | None = None) -> DataFrame:
    """One row per model: AIC, the chosen coefficient, its p and a flag, optionally the second-stage slope."""
    coef = fit.coefficients.filter(F.col("term") == term).select(*models, "estimate", "std_error", "p_value")
    out = natural_join(fit.summary.select(*models, "aic", "sigma", "nobs"), coef, "inner", models)
    out = out.withColumn("significant", F.when(F.col("p_value") < 0.05, "*").otherwise(""))
    return natural_join(out, slopes, "left", models) if slopes is not None else out
