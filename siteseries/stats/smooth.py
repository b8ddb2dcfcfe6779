"""Local regression, histograms, kernel densities, box-plot statistics and hulls."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteseries.operators.joins import natural_join, settled
from siteseries.operators.ranking import GROUP_ROWS, exact_quantiles
from siteseries.session import scratch_path
from siteseries.sources.files import stage
from siteseries.stats.local import long_series, neighbours_wanted


def local_fit(x: np.ndarray, n: np.ndarray, y: np.ndarray, at: np.ndarray, span: float, degree: int = 2) -> np.ndarray:
    """Tricube-weighted local polynomial at each point of `at`; x are distinct with n values of mean y."""
    near = neighbours_wanted(n.sum(), span, degree)
    out = np.full(len(at), np.nan)
    for i, x0 in enumerate(at):
        d = np.abs(x - x0)
        order = np.argsort(d, kind="stable")
        reach = d[order][min(np.searchsorted(np.cumsum(n[order]), near), len(order) - 1)]
        reach = reach * span if span > 1 else reach
        if reach <= 0:
            hit = d == 0
            out[i] = y[hit][0] if hit.any() else np.nan
            continue
        w = n * np.clip(1.0 - (d / reach) ** 3, 0.0, None) ** 3
        use = w > 0
        if not use.any():
            continue
        design = np.vander((x[use] - x0) / reach, degree + 1, increasing=True)
        root = np.sqrt(w[use])
        out[i] = np.linalg.lstsq(design * root[:, None], y[use] * root, rcond=None)[0][0]
    return out


def loess(df: DataFrame, keys: list[str], x: str, y: str, span: float = 0.75, points: int = 80, degree: int = 2,
          series_rows: int = GROUP_ROWS) -> DataFrame:
    """Local-regression trend of each series at evenly spaced points; x is a number, a date or a time (days, seconds).

    Rows with the same x are folded to (count, mean) first: the weights depend on x alone, so nothing is lost. Series are counted:
    those with at most `series_rows` distinct x are fitted in one call each, longer ones from moments of bins (`long_series`).
    Rows without x or y count as absent; where all rows of a window lie at its end, the fit is null.
    """
    kind = dict(df.dtypes)[x]
    number = (F.unix_date(x) if kind == "date" else F.unix_micros(x) / 1e6 if kind == "timestamp" else F.col(x)).cast("double")
    folded = df.select(*keys, number.alias("_x"), F.col(y).cast("double").alias("_y")).where("_y IS NOT NULL AND _x IS NOT NULL AND NOT isnan(_x)")
    folded = folded.groupBy(*keys, "_x").agg(F.count(F.lit(1)).cast("double").alias("_n"), F.avg("_y").alias("_y"))
    folded = stage(folded, scratch_path(df.sparkSession, "folded"))
    types = dict(df.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["x double", "fitted double"])
    sizes = folded.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    long = settled(sizes.where(F.col("_size") > series_rows).select(*keys, F.lit(True).alias("_long")))
    some = not long.isEmpty()
    short = folded
    if some and keys:
        short = natural_join(folded, long, "anti", keys)
        folded = natural_join(folded, long.drop("_long"), "semi", keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_x")
        xs, ns, ys = (pdf[c].to_numpy(float) for c in ("_x", "_n", "_y"))
        at = np.linspace(xs[0], xs[-1], points) if len(xs) > 1 else xs
        out = pd.DataFrame({"x": at, "fitted": local_fit(xs, ns, ys, at, span, degree)})
        for i, k in enumerate(keys):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    fitted = long_series(folded, keys, span, points, degree) if some else None
    if some and not keys:
        return fitted
    made = short.groupBy(*keys).applyInPandas(run, schema)
    return made.unionByName(fitted) if some else made


def histogram(df: DataFrame, cols: list[str], bins: int = 30) -> DataFrame:
    """Counts in equal-width bins for every column; the last bin holds the maximum."""
    v = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("v")) for c in cols])
    rows = df.select(F.explode(v).alias("e")).select("e.*").filter(F.col("v").isNotNull())
    limits = rows.groupBy("variable").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    joined = rows.join(settled(limits), "variable")
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    b = F.least(F.floor(F.try_divide(F.col("v") - F.col("lo"), width)), F.lit(bins - 1))
    return joined.groupBy("variable", F.coalesce(b, F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


#: Bins of half a bandwidth with twelve moments: what is left out of a kernel is below 0.25^12 / sqrt(12!), 3e-12 of its peak.
BIN, MOMENTS, REACH = 0.5, 12, 9.0


def kernel_density(df: DataFrame, keys: list[str], value: str, points: int = 64, cut: float = 3.0) -> DataFrame:
    """Gaussian density per group on an even grid, bandwidth 0.9 min(sd, IQR/1.34) n^-1/5.

    Rows are folded to moments of narrow bins around the bins' middles (one partial aggregate, one row per bin shuffled). The
    kernels of a bin's rows add up to a Hermite series of those moments, which is summed at the grid points within nine
    bandwidths; kernels further off are below 3e-18. Groups without spread are left out.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    q = exact_quantiles(rows, keys, "_v", {"q25": 0.25, "q75": 0.75})
    s = rows.groupBy(*keys).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.stddev_samp("_v").alias("sd"),
                                F.count(F.lit(1)).alias("nobs"))
    iqr = (F.col("q75") - F.col("q25")) / 1.34
    s = natural_join(s, q, "left", keys).withColumn(
        "bw", 0.9 * F.when(iqr > 0, F.least("sd", iqr)).otherwise(F.col("sd")) * F.pow(F.col("nobs"), F.lit(-0.2)))
    s = settled(s.filter(F.col("bw") > 0).select(*keys, "lo", "hi", "bw", "nobs"))
    width, scale = BIN * F.col("bw"), math.sqrt(2.0) * F.col("bw")
    middle = F.col("lo") + (F.col("bin") + 0.5) * width
    placed = natural_join(rows, s, "inner", keys).withColumn("bin", F.floor((F.col("_v") - F.col("lo")) / width))
    off = (F.col("_v") - middle) / scale
    sums = [F.sum(F.pow(off, F.lit(k)) / math.factorial(k) if k else F.lit(1.0)).alias(f"m{k}") for k in range(MOMENTS)]
    bins = natural_join(placed.groupBy(*keys, "bin").agg(*sums), s, "inner", keys)
    start, stop = F.col("lo") - cut * F.col("bw"), F.col("hi") + cut * F.col("bw")
    step = (stop - start) / float(points - 1)
    at = start + (stop - start) * F.col("point") / F.lit(float(points - 1))
    first = F.greatest(F.lit(0), F.ceil((middle - REACH * F.col("bw") - start) / step))
    last = F.least(F.lit(points - 1), F.floor((middle + REACH * F.col("bw") - start) / step))
    near = bins.withColumns({"first": first.cast("int"), "last": last.cast("int")}).where("first <= last")
    near = near.withColumn("point", F.explode(F.sequence("first", "last"))).withColumn("t", (at - middle) / scale)

    def hermite(k: int):
        """The k-th Hermite polynomial at t, by Horner's rule."""
        out = F.lit(0.0)
        for c in np.polynomial.hermite.herm2poly([0] * k + [1])[::-1]:
            out = out * F.col("t") + float(c)
        return out

    series = sum((F.col(f"m{k}") * hermite(k) for k in range(1, MOMENTS)), F.col("m0")) * F.exp(-F.col("t") * F.col("t"))
    grid = s.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    grid = grid.select(*keys, "point", at.alias("x"), (F.col("nobs") * F.col("bw") * math.sqrt(2.0 * math.pi)).alias("area"))
    found = near.groupBy(*keys, "point").agg(F.sum(series).alias("mass"))
    return (natural_join(grid, found, "left", [*keys, "point"])
            .select(*keys, "point", "x", F.greatest(F.coalesce(F.col("mass"), F.lit(0.0)) / F.col("area"), F.lit(0.0)).alias("density")))


def box_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Quartiles, whiskers to the last point within 1.5 IQR, and the number of outliers."""
    rows = df.filter(F.col(value).isNotNull())
    q = settled(exact_quantiles(rows, keys, value, {"lower": 0.25, "middle": 0.5, "upper": 0.75}))
    joined = natural_join(rows.select(*keys, value), q, "inner", keys)
    reach = 1.5 * (F.col("upper") - F.col("lower"))
    inside = (F.col(value) >= F.col("lower") - reach) & (F.col(value) <= F.col("upper") + reach)
    stats = joined.groupBy(*keys).agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_low"), F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(1)).alias("outliers"), F.count(F.lit(1)).alias("nobs"))
    return natural_join(q, stats, "inner", keys)


def _hull(points: np.ndarray) -> np.ndarray:
    """Convex hull in counter-clockwise order, from the lowest-left point (monotone chain)."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def half(seq):
        chain: list = []
        for p in seq:
            while len(chain) > 1:
                a, b = chain[-2], chain[-1]
                if (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) > 0:
                    break
                chain.pop()
            chain.append(p)
        return chain

    return np.array(half(pts)[:-1] + half(pts[::-1])[:-1])


def outer_points(rows: DataFrame, keys: list[str], directions: int = 64) -> DataFrame:
    """Rows (keys, x, y) without those strictly inside the polygon of their group's extreme points.

    One partial aggregate finds, for each of some directions, the point that lies farthest out; joined in turn these corners form a
    convex polygon of hull points, and built-in functions drop what it contains. No corner of the hull is dropped.
    """
    angles = [2 * math.pi * k / directions for k in range(directions)]
    point = F.struct("x", "y")
    far = [F.max_by(point, F.struct((F.col("x") * math.cos(t) + F.col("y") * math.sin(t)).alias("reach"), F.col("x"), F.col("y"))) for t in angles]
    corners = settled(rows.groupBy(*keys).agg(F.array(*far).alias("corners")), 20_000)
    joined = natural_join(rows, corners, "left", keys)
    following = F.concat(F.slice("corners", 2, directions - 1), F.slice("corners", 1, 1))
    edges = F.filter(F.zip_with("corners", following, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda e: e["a"] != e["b"])

    def beyond(e):
        """Not clearly left of the edge: a little room is left for rounding."""
        (ax, ay), (bx, by) = ((e[p]["x"], e[p]["y"]) for p in ("a", "b"))
        width, height = bx - ax, by - ay
        turn = width * (F.col("y") - ay) - height * (F.col("x") - ax)
        return turn <= 1e-9 * (F.abs(width) + F.abs(height)) * (F.abs(F.col("x") - ax) + F.abs(F.col("y") - ay))

    return joined.where((F.size(edges) < 3) | F.exists(edges, beyond)).drop("corners")


def convex_hull(df: DataFrame, keys: list[str], x: str, y: str, lanes: int = 16) -> DataFrame:
    """Hull corners per group in order.

    Built-in functions drop points inside the polygon of each group's extreme points; of the few that are left, each input batch
    is reduced to the corners of its own hulls inside its task, then corners are merged per (group, lane) and finally per group.
    The hull of hulls is the hull of all points, so the reduction is exact and no group is gathered raw.
    """
    types = dict(df.dtypes)
    head = ", ".join(f"`{k}` {types[k]}" for k in keys)
    rows = df.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna("any", subset=["x", "y"])
    rows = outer_points(rows, keys)

    def local(batches):
        for pdf in batches:
            parts = []
            for key, part in pdf.groupby(keys, dropna=False, sort=False):
                corners = _hull(part[["x", "y"]].to_numpy())
                out = pd.DataFrame(corners, columns=["x", "y"])
                for i, k in enumerate(keys):
                    out.insert(i, k, part[k].iloc[0])
                parts.append(out)
            if parts:
                yield pd.concat(parts)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        corners = _hull(pdf[["x", "y"]].to_numpy())
        out = pd.DataFrame({"corner": np.arange(1, len(corners) + 1), "x": corners[:, 0], "y": corners[:, 1]})
        for i, k in enumerate(keys):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    corners = rows.mapInPandas(local, f"{head}, x double, y double")
    schema = f"{head}, corner int, x double, y double"
    lane = F.pmod(F.xxhash64("x", "y"), F.lit(lanes)).alias("lane")
    corners = corners.select("*", lane)
    merged = corners.groupBy(*keys, "lane").applyInPandas(merge, schema).drop("corner")
    return merged.groupBy(*keys).applyInPandas(merge, schema)
