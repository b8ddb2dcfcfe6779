"""Local regression of long series from moments of bins.

The tricube weight is a polynomial in the distance on either side of the evaluation point, so what a bin adds to the local
normal equations follows from its power sums whenever it lies wholly on one side and wholly inside the window. Bins hold a
bounded number of neighbouring x; only those that contain the point or an end of its window are read row by row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteseries.operators.joins import natural_join
from siteseries.operators.ranking import cumulative_counts
from siteseries.session import scratch_path
from siteseries.sources.files import stage

BIN_ROWS = 4096  # distinct x of a bin
TRICUBE = {0: 1.0, 3: -3.0, 6: 3.0, 9: -1.0}  # (1 - v^3)^3 by powers of v


def neighbours_wanted(total: float, span: float, degree: int) -> int:
    """How many rows the window of a point reaches to."""
    return max(int(math.floor(total * span + 1e-9)), degree + 1) if span < 1 else int(total)


def _keyed(out: pd.DataFrame, keys: list[str], pdf: pd.DataFrame) -> pd.DataFrame:
    for i, k in enumerate(keys):
        out.insert(i, k, [pdf[k].iloc[0]] * len(out))
    return out


def _moments(pdf: pd.DataFrame, keys: list[str], degree: int) -> pd.DataFrame:
    """One row for a bin: its ends, its rows, and power sums of the rows and of y about its middle."""
    x, n, y = (pdf[c].to_numpy(float) for c in ("_x", "_n", "_y"))
    lo, hi = x.min(), x.max()
    z = np.vander((x - (lo + hi) / 2) / ((hi - lo) / 2 or 1.0), 10 + 2 * degree, increasing=True)
    out = pd.DataFrame({"lo": [lo], "hi": [hi], "n": [n.sum()], "m": [n @ z], "t": [(n * y) @ z[:, :10 + degree]]})
    out.insert(0, "bin", pdf["bin"].iloc[0])
    return _keyed(out, keys, pdf)


def _shifted(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Power sums of a + b z, for each bin (row), from those of z."""
    powers = sums.shape[1]
    left, right = (np.vander(v, powers, increasing=True) for v in (a, b))
    out = np.zeros_like(sums)
    for p in range(powers):
        for j in range(p + 1):
            out[:, p] += math.comb(p, j) * left[:, p - j] * right[:, j] * sums[:, j]
    return out


def _weighted(sums: np.ndarray, side: np.ndarray, wanted: int) -> np.ndarray:
    """Sums of tricube weight times u^0 .. u^(wanted - 1) over all bins, from power sums of u; `side` is -1 or 1."""
    return np.array([sum(c * (side**e * sums[:, k + e]).sum() for e, c in TRICUBE.items()) for k in range(wanted)])


def _distances(bins: pd.DataFrame, x0: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest distance of each bin's rows from the point."""
    lo, hi = bins["lo"].to_numpy(), bins["hi"].to_numpy()
    return np.maximum(np.maximum(lo - x0, x0 - hi), 0.0), np.maximum(np.abs(lo - x0), np.abs(hi - x0))


def _candidates(bins: pd.DataFrame, keys: list[str], span: float, points: int, degree: int) -> pd.DataFrame:
    """For each point the bins among whose rows its last neighbour lies, and the number of rows that are surely nearer."""
    n = bins["n"].to_numpy()
    wanted = neighbours_wanted(n.sum(), span, degree)
    out = []
    for i, x0 in enumerate(np.linspace(bins["lo"].min(), bins["hi"].max(), points)):
        near, far = _distances(bins, x0)

        def reached(d: np.ndarray) -> float:
            order = np.argsort(d, kind="stable")
            return d[order][min(np.searchsorted(np.cumsum(n[order]), wanted), len(d) - 1)]

        low, high = reached(near), reached(far)
        sure = far < low
        for b in bins["bin"].to_numpy()[~sure & (near <= high)]:
            out.append((i, x0, float(min(wanted, n.sum())), n[sure].sum(), b))
    return _keyed(pd.DataFrame(out, columns=["point", "x0", "wanted", "sure", "bin"]), keys, bins)


def _from_bins(at: pd.DataFrame, bins: pd.DataFrame, keys: list[str], degree: int) -> pd.DataFrame:
    """For each point the sums over bins that count as a whole, and the bins whose rows must be read."""
    m, t = (np.stack(bins[c].to_numpy()) for c in ("m", "t"))
    lo, hi = bins["lo"].to_numpy(), bins["hi"].to_numpy()
    centre, half = (lo + hi) / 2, np.where(hi > lo, (hi - lo) / 2, 1.0)
    out = []
    for i, x0, reach in zip(at["point"], at["x0"], at["reach"]):
        near, far = _distances(bins, x0)
        whole = (far <= reach) & ((lo >= x0) | (hi <= x0)) & (reach > 0)
        a, b = (centre[whole] - x0) / (reach or 1.0), half[whole] / (reach or 1.0)
        side = np.where(lo[whole] >= x0, 1.0, -1.0)
        sums = np.concatenate([_weighted(_shifted(m[whole], a, b), side, 2 * degree + 1),
                               _weighted(_shifted(t[whole], a, b), side, degree + 1)])
        out.append((i, x0, reach, sums, bins["bin"].to_numpy()[~whole & (near <= reach)]))
    return _keyed(pd.DataFrame(out, columns=["point", "x0", "reach", "sums", "read"]), keys, at)


def solved(sums: np.ndarray, degree: int) -> float:
    """Value at the point from the sums of its normal equations; NaN where no row has weight."""
    if sums[0] <= 0:
        return math.nan
    s, t = sums[:2 * degree + 1], sums[2 * degree + 1:]
    matrix = s[np.add.outer(np.arange(degree + 1), np.arange(degree + 1))]
    return float(np.linalg.lstsq(matrix, t, rcond=1e-13)[0][0])


def long_series(folded: DataFrame, keys: list[str], span: float, points: int, degree: int, bin_rows: int = BIN_ROWS) -> DataFrame:
    """(keys, x, fitted) from rows (keys, _x, _n, _y) with distinct _x; no task holds more than bins' summaries or a few bins' rows."""
    spark = folded.sparkSession
    types = dict(folded.dtypes)
    head = "".join(f"`{k}` {types[k]}, " for k in keys)
    order = cumulative_counts(folded, keys, "_x").select(*keys, "_x", F.floor(F.col("below") / F.lit(bin_rows)).alias("bin"))
    rows = stage(natural_join(folded, order, "inner", [*keys, "_x"]), scratch_path(spark, "series"))
    bins = rows.groupBy(*keys, "bin").applyInPandas(
        lambda pdf: _moments(pdf, keys, degree), f"{head}bin bigint, lo double, hi double, n double, m array<double>, t array<double>")
    bins = stage(bins, scratch_path(spark, "bins"))

    tried = bins.select(*keys, "bin", "lo", "hi", "n").groupBy(*keys).applyInPandas(
        lambda pdf: _candidates(pdf, keys, span, points, degree), f"{head}point int, x0 double, wanted double, sure double, bin bigint")
    away = F.abs(F.col("_x") - F.col("x0"))
    nearer = Window.partitionBy(*keys, "point").orderBy("d")
    at = (natural_join(rows, tried, "inner", [*keys, "bin"]).withColumn("d", away)
          .withColumn("upto", F.col("sure") + F.sum("_n").over(nearer)).where("upto >= wanted")
          .groupBy(*keys, "point", "x0").agg((F.min("d") * max(span, 1.0)).alias("reach")))

    sums = at.groupBy(*keys).cogroup(bins.groupBy(*keys)).applyInPandas(
        lambda a, b: _from_bins(a, b, keys, degree), f"{head}point int, x0 double, reach double, sums array<double>, read array<bigint>")
    sums = stage(sums, scratch_path(spark, "sums"))
    u = F.when(F.col("reach") > 0, (F.col("_x") - F.col("x0")) / F.col("reach")).otherwise(0.0)
    w = F.col("_n") * F.pow(1.0 - F.pow(F.abs(u), 3.0), 3.0)
    inside = natural_join(rows, sums.select(*keys, "point", "x0", "reach", F.explode("read").alias("bin")), "inner", [*keys, "bin"]).where(away <= F.col("reach"))
    terms = [w * F.pow(u, F.lit(k)) for k in range(2 * degree + 1)] + [w * F.col("_y") * F.pow(u, F.lit(k)) for k in range(degree + 1)]
    read = inside.groupBy(*keys, "point").agg(F.array(*[F.sum(e) for e in terms]).alias("more"))
    both = natural_join(sums.select(*keys, "point", F.col("x0").alias("x"), "sums"), read, "left", [*keys, "point"])
    total = F.when(F.col("more").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "more", lambda a, b: a + b))

    def solve(batches):
        for pdf in batches:
            pdf["fitted"] = [solved(np.asarray(s), degree) for s in pdf.pop("total")]
            yield pdf

    return both.select(*keys, "x", total.alias("total")).mapInPandas(solve, f"{head}x double, fitted double")
