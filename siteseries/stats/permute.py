"""Vector fits of many variables on two axes, with p-values from seeded permutations.

A permutation is a keyed bijection of the row numbers 0 .. n - 1: a Feistel network on the next even number of bits (eight at
least, for few rows need room to mix), walked on until it falls below n. It needs no sort and no table, so any number of permutations can be computed side by side
wherever a row happens to lie. Variables are long and sparse (absent means zero): a row adds its value times the permuted axis
scores to its variable's sums, and each task keeps one block of sums per variable.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteseries.functions.numeric import ratio, seeded_hash
from siteseries.operators.joins import natural_join
from siteseries.operators.ranking import cumulative_counts
from siteseries.session import scratch_path
from siteseries.sources.files import stage

SCORES = 1 << 22   # rows whose scores are broadcast at once; more take a pass for each part
HELD = 32 << 20    # bytes of sums that a task keeps before it hands them on
BATCH = 1 << 20    # products of one step
ROUNDS = 6


def _mixed(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    x = (x ^ key) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def permuted(rows: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    """Where each permutation (one for each key) sends each of some row numbers below n: an array (rows, keys)."""
    half = max(4, -(-max(n - 1, 1).bit_length() // 2))
    low = np.uint64((1 << half) - 1)
    with np.errstate(over="ignore"):
        rounds = [_mixed(keys.astype(np.uint64), np.uint64(0x9E3779B97F4A7C15 * (r + 1) & 0xFFFFFFFFFFFFFFFF)) for r in range(ROUNDS)]
        out = np.repeat(rows.astype(np.uint64)[:, None], len(keys), axis=1)
        todo = np.ones(out.shape, bool)
        while todo.any():
            x, which = out[todo], np.nonzero(todo)[1]
            left, right = x >> np.uint64(half), x & low
            for key in rounds:
                left, right = right, left ^ (_mixed(right, key[which]) & low)
            out[todo] = (left << np.uint64(half)) | right
            todo &= out >= n
    return out.astype(np.int64)


def numbered(df: DataFrame, key: list[str], seed: int) -> DataFrame:
    """Rows with `row`, their place in a seeded hash order of their key: 0 .. n - 1 in any partitioning."""
    rows = df.withColumn("_h", seeded_hash(seed, *key))
    order = cumulative_counts(rows, [], "_h").select("_h", F.col("below").alias("row"))
    return rows.join(order, "_h").drop("_h")


def axis_sums(values: DataFrame, scores: DataFrame, n: int, permutations: int, seed: int) -> DataFrame:
    """(variable, kind, sums): for written values (variable, kind, row, v) the sums of v times both scores (row, a, b) under each
    permutation, packed doubles (permutations, 2). Scores are read in parts of bounded size, one pass for each."""
    keys = np.arange(1, permutations + 1, dtype=np.uint64) + np.uint64(seed << 20)
    spark, parts = values.sparkSession, None
    for first in range(0, max(n, 1), SCORES):
        near = scores.where((F.col("row") >= first) & (F.col("row") < first + SCORES)).orderBy("row").toPandas()
        table = spark.sparkContext.broadcast(np.stack([near["a"].to_numpy(float), near["b"].to_numpy(float), near["row"].to_numpy(float)], axis=1))

        def fold(batches, first=first, table=table):
            import pandas as pd

            own = np.zeros((min(SCORES, n - first), 2))
            own[table.value[:, 2].astype(np.int64) - first] = table.value[:, :2]
            step, sums = max(1, BATCH // permutations), {}

            def handed():
                return pd.DataFrame([(*k, s.tobytes()) for k, s in sums.items()], columns=["variable", "kind", "sums"])

            for pdf in batches:
                pdf = pdf.sort_values(["variable", "kind"], kind="stable")
                names, rows, v = list(zip(pdf["variable"], pdf["kind"])), pdf["row"].to_numpy(), pdf["v"].to_numpy(float)
                for at in range(0, len(pdf), step):
                    to = permuted(rows[at:at + step], n, keys) - first
                    here = (to >= 0) & (to < len(own))
                    added = own[np.where(here, to, 0)] * (here * v[at:at + step, None])[:, :, None]
                    some = names[at:at + step]
                    edges = [0] + [k for k in range(1, len(some)) if some[k] != some[k - 1]]
                    for k, total in zip(edges, np.add.reduceat(added, edges, axis=0)):
                        sums[some[k]] = sums[some[k]] + total if some[k] in sums else total
                if len(sums) * permutations * 16 > HELD:
                    yield handed()
                    sums.clear()
            yield handed()

        part = values.select("variable", "kind", "row", "v").mapInPandas(fold, "variable string, kind string, sums binary")
        parts = part if parts is None else parts.unionByName(part)

    def merge(pdf):
        import pandas as pd

        total = sum(np.frombuffer(bytes(s)) for s in pdf["sums"])
        return pd.DataFrame({"variable": [pdf["variable"].iat[0]], "kind": [pdf["kind"].iat[0]], "sums": [total.tobytes()]})

    return parts.groupBy("variable", "kind").applyInPandas(merge, "variable string, kind string, sums binary")


def fit_on_axes(sites: DataFrame, key: list[str], axes: tuple[str, str], values: DataFrame, permutations: int = 999, seed: int = 1503) -> DataFrame:
    """The fit of every variable of `values` (key, variable, kind, v; absent means zero) on two axes of `sites` (key, axes).

    One row per variable and kind: nobs, r (squared multiple correlation), axis1 and axis2 (direction of its arrow, of length 1) and
    p, the share of permutations of the sites, the given order among them, whose r is as large. Without permutations p is null.
    Variables that do not vary get nulls. Rows with a null value take part as zeros; values of unknown sites are left out.
    """
    spark = sites.sparkSession
    a, b = axes
    scores = numbered(sites.select(*key, F.col(a).alias("a"), F.col(b).alias("b")).dropna("any"), key, seed)
    scores = stage(scores, scratch_path(spark, "scores"))
    n, ma, mb = scores.agg(F.count("*"), F.avg("a"), F.avg("b")).first()
    scores = scores.withColumns({"a": F.col("a") - F.lit(ma or 0.0), "b": F.col("b") - F.lit(mb or 0.0)})
    head = scores.agg(F.sum(F.col("a") * F.col("a")), F.sum(F.col("b") * F.col("b")), F.sum(F.col("a") * F.col("b"))).first()
    saa, sbb, sab = (float(x or 0.0) for x in head)
    rows = natural_join(values.where("v IS NOT NULL"), scores, "inner", key)
    rows = stage(rows.select(F.col("variable").cast("string").alias("variable"), F.col("kind").cast("string").alias("kind"), "row",
                             F.col("v").cast("double").alias("v"), "a", "b"), scratch_path(spark, "variables"))
    c = rows.groupBy("variable", "kind").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"),
                                             F.sum(F.col("v") * F.col("a")).alias("va"), F.sum(F.col("v") * F.col("b")).alias("vb"))
    # The axes are centred, so that sums with them are covariances; the normal equations of two axes.
    whole = F.col("ss") - F.col("s") * F.col("s") / n
    whole = F.when(whole > 1e-12 * F.col("ss"), whole)
    det = saa * sbb - sab * sab
    if det <= 1e-24 * saa * sbb or not n:
        return c.select("variable", "kind", F.lit(n).cast("long").alias("nobs"), *[F.lit(None).cast("double").alias(x) for x in ("r", "axis1", "axis2", "p")])
    b1, b2 = (F.col("va") * sbb - F.col("vb") * sab) / det, (F.col("vb") * saa - F.col("va") * sab) / det
    size = F.sqrt(b1 * b1 + b2 * b2)
    fit = c.select("variable", "kind", F.lit(n).cast("long").alias("nobs"), ratio(b1 * F.col("va") + b2 * F.col("vb"), whole).alias("r"),
                   ratio(b1, size).alias("axis1"), ratio(b2, size).alias("axis2"), whole.alias("whole"))
    if not permutations:
        return fit.drop("whole").withColumn("p", F.lit(None).cast("double"))
    shuffled = axis_sums(rows, scores.select("row", "a", "b"), n, permutations, seed)

    @F.pandas_udf("double")
    def tail(sums, r, whole):
        import pandas as pd

        out = []
        for blob, seen, total in zip(sums, r, whole):
            va, vb = np.frombuffer(bytes(blob)).reshape(-1, 2).T
            made = (va * va * sbb - 2 * va * vb * sab + vb * vb * saa) / det / total
            out.append(None if seen != seen else float((1 + (made >= seen - 1e-12).sum()) / (1 + len(made))))
        return pd.Series(out, dtype=float)

    joined = natural_join(fit, shuffled, "inner", ["variable", "kind"])
    return joined.withColumn("p", F.when(F.col("r").isNotNull(), tail("sums", "r", "whole"))).drop("sums", "whole")
