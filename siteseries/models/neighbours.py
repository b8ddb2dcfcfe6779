"""k-nearest-neighbour regression over pivot cells with exact pruning."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteseries.operators.joins import natural_join
from siteseries.session import scratch_path
from siteseries.sources.files import stage

INFINITE = float("inf")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of every row of a to every row of b, summed feature by feature so that equal rows give equal distances."""
    d = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        d += (a[:, j:j + 1] - b[None, :, j]) ** 2
    return np.sqrt(d)


def may_be_nearest(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of a, row of b) of all pairs, in order, in which b can be among the k nearest of a.

    One matrix product gives lower bounds of all squared distances: the squares and the product, less the most that rounding can
    make of them. Pairs whose bound exceeds what k rows are known to reach are left out; none if a number is too large for that.
    """
    square_a, square_b = (a * a).sum(axis=1), (b * b).sum(axis=1)
    if not (square_a.max() < 1e300 and square_b.max() < 1e300):  # NaN too
        return np.repeat(np.arange(len(a)), len(b)), np.tile(np.arange(len(b)), len(a))
    rounding, tiny = 16 * (a.shape[1] + 8) * np.finfo(float).eps, 1e-290  # tiny: products below the normal range
    left = np.column_stack([-2 * a, square_a * (1 - rounding) - tiny, np.ones(len(a))])
    low = left @ np.column_stack([b, np.ones(len(b)), square_b * (1 - rounding)]).T
    # The least bounds of k of several groups belong to k different rows.
    k = min(k, len(b))
    groups = max(k, -(-len(b) // 32))
    least = low[:, :groups].copy()
    for start in range(groups, len(b), groups):
        part = low[:, start:start + groups]
        np.minimum(least[:, :part.shape[1]], part, out=least[:, :part.shape[1]])
    reached = np.partition(least, k - 1, axis=1)[:, k - 1] + 4 * (rounding * (square_a + square_b.max()) + tiny)
    return np.nonzero(low <= reached[:, None])


def nearest_rows(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, distance) of the k nearest rows of b to each row of a, by distance; equal ones by their place in b."""
    row, col = may_be_nearest(a, b, k)
    d = np.zeros(len(row))
    for x, y in zip(a.T, b.T):  # feature by feature, as in `distances`
        d += (x[row] - y[col]) ** 2
    d = np.sqrt(d)
    order = np.lexsort((col, d, row))
    row, col, d = row[order], col[order], d[order]
    n = np.bincount(row, minlength=len(a))
    first = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) < k
    return row[first], col[first], d[first]


def to_pivots(pivots: np.ndarray):
    """Distances of the column _x to every pivot."""
    @F.pandas_udf("array<double>")
    def measure(xs: pd.Series) -> pd.Series:
        return pd.Series([row for s in range(0, len(xs), 256) for row in distances(np.stack(xs.iloc[s:s + 256].to_numpy()), pivots)], dtype=object)

    return measure("_x")


def further_cells(tests: DataFrame, radius: dict[int, float]) -> DataFrame:
    """One row (cell) per test row and further cell that can hold a nearer row than its `reach`: by the triangle inequality no row
    of a cell is nearer than the distance of its pivot less its radius."""
    cells = F.array(*[F.when((F.col("own") != c) & (F.element_at("far", c + 1) - r <= F.col("reach") * (1 + 1e-9) + 1e-12), c) for c, r in sorted(radius.items())])
    return tests.withColumn("cell", F.explode(F.filter(cells, lambda c: c.isNotNull())))


def knn_regression(train: DataFrame, test: DataFrame, key: list[str], features: list[str], y: str, k: int = 5,
                   block_rows: int = 20_000, pivots: int = 32) -> DataFrame:
    """Mean of y over the k nearest training rows, weighted by 1 / (distance + 1e-9).

    Training rows belong to the cell of the nearest of some pivots (training rows drawn by hash). A test row first visits the cell
    nearest to it; its k-th distance there decides which cells can still hold nearer rows, and only those are visited; there a matrix
    product tells which rows need be measured. Results are exact. Rows of a cell and its visitors are cut into hash blocks of bounded size; a task keeps only the k nearest of each
    test row, which are then merged per test row. Ties go to the smaller training key. The driver sees pivots and cell sizes.
    """
    spark, types = train.sparkSession, dict(test.dtypes)
    x = F.array(*[F.col(c).cast("double") for c in features]).alias("_x")
    rows = train.select(F.concat_ws("|", *[F.col(c).cast("string") for c in key]).alias("_k"), x, F.col(y).cast("double").alias("_y"))
    drawn = rows.orderBy(F.xxhash64("_k"), "_k").limit(pivots).collect()
    if not drawn:
        return test.select(*key, F.lit(None).cast("double").alias("prediction")).limit(0)
    measure = to_pivots(np.array([r["_x"] for r in drawn]))
    nearest_pivot = (F.array_position("far", F.array_min("far")) - 1).cast("int")
    rows = rows.withColumn("far", measure).select("_k", "_x", "_y", nearest_pivot.alias("cell"), F.array_min("far").alias("home"))
    rows = stage(rows, scratch_path(spark, "neighbour-rows"))
    cells = {r["cell"]: r for r in rows.groupBy("cell").agg(F.max("home").alias("radius"), F.count("*").alias("n")).collect()}
    radius = {c: r["radius"] for c, r in cells.items()}
    filled = F.array(*[F.when(F.lit(c in cells), F.element_at("far", c + 1)).otherwise(INFINITE) for c in range(len(drawn))])
    tests = test.select(*key, x).withColumn("far", measure).withColumn("own", (F.array_position(filled, F.array_min(filled)) - 1).cast("int"))
    tests = stage(tests, scratch_path(spark, "neighbour-tests"))

    schema = ", ".join(f"`{c}` {types[c]}" for c in key) + ", d double, rk string, v double"

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=[*key, "d", "rk", "v"])
        b = b.sort_values("_k").reset_index(drop=True)
        xa, xb = np.stack(a["_x"].to_numpy()), np.stack(b["_x"].to_numpy())
        out = []
        for start in range(0, len(xa), 256):
            row, col, d = nearest_rows(xa[start:start + 256], xb, k)
            ids = a.iloc[start + row][key].reset_index(drop=True)
            ids["d"], ids["rk"], ids["v"] = d, b["_k"].to_numpy()[col], b["_y"].to_numpy()[col]
            out.append(ids)
        return pd.concat(out)

    def visited(visits: DataFrame, name: str) -> DataFrame:
        """The k nearest rows of each block of the visited cells, for each visit."""
        visitors = {r["cell"]: -(-r["n"] // block_rows) for r in visits.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        blocks = {c: -(-r["n"] // block_rows) for c, r in cells.items()}

        def of(sizes: dict[int, int]):
            return F.element_at(F.array(*[F.lit(sizes.get(c, 0)) for c in range(len(drawn))]), F.col("cell") + 1)

        def lanes(sizes):
            return F.explode(F.sequence(F.lit(0), of(sizes) - 1))

        here = F.col("cell").isin(list(visitors))
        left = visits.select(*key, "_x", "cell", F.pmod(F.xxhash64(*key), of(visitors)).cast("int").alias("tb")).withColumn("rb", lanes(blocks))
        right = rows.where(here).select("_k", "_x", "_y", "cell", F.pmod(F.xxhash64("_k"), of(blocks)).cast("int").alias("rb")).withColumn("tb", lanes(visitors))
        at = ["cell", "tb", "rb"]
        return stage(left.groupBy(*at).cogroup(right.groupBy(*at)).applyInPandas(nearest, schema), scratch_path(spark, name))

    best = F.slice(F.array_sort(F.collect_list(F.struct("d", "rk", "v"))), 1, k).alias("near")  # at most k per visited block
    first = visited(tests.withColumn("cell", F.col("own")), "neighbour-first")
    reach = first.groupBy(*key).agg(best).select(*key, F.when(F.size("near") == k, F.get("near", F.lit(k - 1))["d"]).otherwise(INFINITE).alias("reach"))
    further = visited(further_cells(natural_join(tests, reach, "inner", key), radius), "neighbour-further")
    merged = first.unionByName(further).groupBy(*key).agg(best)
    w = lambda e: 1.0 / (e["d"] + F.lit(1e-9))
    num = F.aggregate("near", F.lit(0.0), lambda s, e: s + e["v"] * w(e))
    den = F.aggregate("near", F.lit(0.0), lambda s, e: s + w(e))
    return merged.select(*key, (num / den).alias("prediction"))
