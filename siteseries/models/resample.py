"""Reproducible splits: every choice follows from a seeded hash of the row key, not from row order."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteseries.functions.numeric import seeded_hash, seeded_uniform
from siteseries.operators.joins import natural_join
from siteseries.operators.ranking import cumulative_counts
from siteseries.session import scratch_path
from siteseries.sources.files import stage


def stratified_split(df: DataFrame, key: list[str], strata: list[str], prop: float = 0.8, seed: int = 1503) -> DataFrame:
    """Mark rows train or test so that `prop` of every stratum trains (exact to one row)."""
    rows = df.withColumn("_h", seeded_hash(seed, *key))
    order = cumulative_counts(rows, strata, "_h").select(*strata, "_h", "below", "total")
    out = natural_join(rows, order, "inner", [*strata, "_h"])
    return out.withColumn("part", F.when(F.col("below") < F.floor(F.col("total") * F.lit(prop)), "train")
                          .otherwise("test")).select(*df.columns, "part")


def repeated_folds(df: DataFrame, key: list[str], folds: int = 10, repeats: int = 5, seed: int = 1503) -> DataFrame:
    """Each row once per repeat with its fold 1..folds; folds of a repeat differ by at most one row."""
    rows = df.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    rows = rows.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("repeat").cast("string"),
                                                   *[F.col(k).cast("string") for k in key])))
    order = cumulative_counts(rows, ["repeat"], "_h").select("repeat", "_h", (F.pmod("below", F.lit(folds)) + 1).cast("int").alias("fold"))
    return rows.join(order, ["repeat", "_h"]).drop("_h")


# Cumulative Poisson(1) probabilities up to 12 events. The uniform numbers have 32 bits, too few to draw 13.
POISSON_ONE = tuple(sum(math.exp(-1.0) / math.factorial(j) for j in range(i + 1)) for i in range(13))


def bootstrap_weights(df: DataFrame, key: list[str], times: int = 100, seed: int = 1503) -> DataFrame:
    """Poisson(1) draw counts per row and resample; rows with weight 0 are left out of that resample."""
    rows = df.withColumn("resample", F.explode(F.sequence(F.lit(1), F.lit(times))))
    u = seeded_uniform(seed, "resample", *key)
    weight = sum((F.when(F.col("_u") >= p, 1).otherwise(0) for p in POISSON_ONE), F.lit(0))
    return rows.withColumn("_u", u).withColumn("weight", weight).filter(F.col("weight") > 0).drop("_u")


LEAF = 1 << 14  # positions that one task splits down to single rows
LANES = 4       # resamples that share a digest: four numbers of 32 bits


def _left_draws(draws: np.ndarray, u: np.ndarray, left: int, right: int) -> np.ndarray:
    """Of each number of draws, how many fall on the left positions: the binomial quantile at u.

    Probabilities are built outwards from the likeliest count, within twelve standard deviations, once per distinct number of draws.
    """
    out = draws.copy()
    if right == 0:
        return out
    order = np.argsort(draws, kind="stable")
    values, starts = np.unique(draws[order], return_index=True)
    p = left / (left + right)
    odds = math.log(left / right)
    for d, start, stop in zip(values.tolist(), starts, [*starts[1:], len(order)]):
        at = order[start:stop]
        reach = 12.0 * math.sqrt(d * p * (1.0 - p)) + 30.0
        low, high = max(0, int(d * p - reach)), min(d, int(d * p + reach))
        k = np.arange(low, high, dtype=float)
        logs = np.concatenate([[0.0], np.cumsum(np.log((d - k) / (k + 1.0)) + odds)])
        mass = np.cumsum(np.exp(logs - logs.max()))
        out[at] = np.minimum(low + np.searchsorted(mass, u[at] * mass[-1], side="right"), high)
    return out


def _split(draws: np.ndarray, total: int, start: int, span: int, stop: int, seed: int | str, block: int) -> np.ndarray:
    """Draws (one row per resample of the block) of the span at `start`, split down to spans of `stop` positions: (resamples, spans)."""
    nodes = draws.reshape(len(draws), 1)
    while span > stop:
        half = span // 2
        below = np.zeros_like(nodes)
        even, uneven = [], []
        for j in np.nonzero(nodes.any(axis=0))[0].tolist():
            (even if start + (j + 1) * span <= total else uneven).append(j)
        for some in (even, uneven):
            if not some:
                continue
            first = start + some[-1] * span
            left, right = min(total - first, half), min(max(total - first - half, 0), half)
            digests = b"".join(hashlib.md5(f"{seed}|{block}|{start + j * span}|{half}".encode()).digest() for j in some)
            u = (np.frombuffer(digests, ">u4").reshape(len(some), LANES).T[:len(nodes)].astype(float) + 0.5) / 4294967296.0
            below[:, some] = _left_draws(nodes[:, some].ravel(), u.ravel(), left, right).reshape(len(nodes), -1)
        nodes = np.stack([below, nodes - below], axis=2).reshape(len(nodes), -1)
        span = half
    return nodes


def bootstrap_draws(df: DataFrame, key: list[str], times: int = 100, seed: int = 1503, leaf: int = LEAF) -> DataFrame:
    """Resamples of exactly as many draws, with replacement, as there are keys; rows drawn `weight` > 0 times, one per resample.

    Keys are ordered by their hash, and the draws of a resample go down a binary tree over the positions: at each span of
    positions a seeded binomial decides how many go left. The number depends on seed, resample and span alone, so results
    do not change with partitioning. The tree down to spans of `leaf` positions needs only the number of keys; below that each
    span is one task's, and no draw is ever a row of its own. Rows that share a key are drawn together. An empty table gives none.
    """
    spark = df.sparkSession
    rows = df.withColumn("_h", seeded_hash(seed, *key))
    order = stage(cumulative_counts(rows.select("_h").distinct(), [], "_h").select("_h", F.col("below").alias("_at")),
                  scratch_path(spark, "positions"))
    total = order.count()
    root = 1 << max(total - 1, 0).bit_length()
    span = min(leaf, root)
    blocks = -(-times // LANES)

    def upper(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block in pdf["id"].tolist():
                lanes = min(LANES, times - LANES * block)
                parts = _split(np.full(lanes, total, np.int64), total, 0, root, span, seed, block)
                for at in range(0, parts.shape[1], 1 << 16):
                    piece = parts[:, at:at + (1 << 16)]
                    used = np.nonzero(piece.any(axis=0))[0]
                    yield pd.DataFrame({"_span": used + at, "block": block, "draws": list(piece[:, used].T)})

    def lower(key: tuple, here: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        here = here.sort_values("_at")
        start = int(key[0]) * span
        weights = np.zeros((times, len(here)), np.int64)
        for block, draws in zip(drawn["block"].tolist(), drawn["draws"]):
            draws = np.asarray(draws, np.int64)
            weights[LANES * block:LANES * block + len(draws)] = _split(draws, total, start, span, 1, seed, block)[:, :len(here)]
        hit = [np.nonzero(w)[0] for w in weights.T]
        return pd.DataFrame({"_h": here["_h"], "_r": [h + 1 for h in hit], "_w": [w[h] for w, h in zip(weights.T, hit)]})

    drawn = spark.range(0, blocks if total else 0, 1, max(1, blocks)).mapInPandas(upper, "_span bigint, block bigint, draws array<bigint>")
    placed = order.withColumn("_span", F.floor(F.col("_at") / F.lit(span)))
    found = placed.groupBy("_span").cogroup(drawn.groupBy("_span")).applyInPandas(lower, "_h string, _r array<int>, _w array<int>")
    pairs = F.explode(F.arrays_zip("_r", "_w")).alias("_e")
    return (rows.join(found, "_h").select(*df.columns, pairs)
            .select(*df.columns, F.col("_e._r").alias("resample"), F.col("_e._w").alias("weight")))
