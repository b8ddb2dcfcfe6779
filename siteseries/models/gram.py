"""Resampled search of linear models on fold-complement Gram matrices.

One scan folds every row into the cross-products of its repeat and fold. The training set of a fold is the total of its repeat
minus the fold, so every workflow and configuration is fitted and scored from these small matrices alone: penalised fits by
coordinate descent on the complement, held-out errors from the fold's own matrix. Nothing is read again, however large the
grid is, and what a worker holds has the size of the columns squared.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 150  # sums of one aggregate; wider grams take several aggregates over the same rows


def fold_grams(df: DataFrame, cols: list[str], label: str, repeat: str = "repeat", fold: str = "fold") -> DataFrame:
    """(repeat, fold, n, gram): the cross-products of (1, cols..., label), row by row, of each repeat and fold.

    Products are taken about the overall means, so that a difference of two matrices loses no digits. Rows with a null in any
    of the columns take no part.
    """
    names = [*cols, label]
    rows = df.select(repeat, fold, *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)]).dropna("any")
    means = rows.agg(*[F.avg(f"c{i}") for i in range(len(names))]).first()
    x = [F.lit(1.0)] + [F.col(f"c{i}") - F.lit(float(m or 0.0)) for i, m in enumerate(means)]
    cells = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    parts = []
    for at in range(0, len(cells), CHUNK):
        part = rows.groupBy(repeat, fold).agg(*[F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i, j in cells[at:at + CHUNK]])
        parts.append(part)
    wide = reduce(lambda a, b: a.join(b, [repeat, fold]), parts)
    k = len(x)
    gram = F.array(*[F.col(f"g{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(k)])
    shift = F.array(F.lit(0.0), *[F.lit(float(m or 0.0)) for m in means])
    return wide.select(F.col(repeat).alias("repeat"), F.col(fold).alias("fold"), F.col("g0_0").cast("long").alias("n"),
                       gram.alias("gram"), shift.alias("shift"))


def moments(gram: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(n, means, covariances with n) of the columns behind the leading one."""
    n = gram[0, 0]
    means = gram[0, 1:] / n
    return n, means, gram[1:, 1:] / n - np.outer(means, means)


def elastic_net(cov: np.ndarray, xy: np.ndarray, configs: list[tuple[float, float]], rounds: int = 2000, near: float = 1e-9) -> np.ndarray:
    """For each (penalty, mixture) the slopes that minimise half the mean squared error + penalty * (mixture * |b|_1 +
    (1 - mixture) / 2 * |b|^2) for predictors scaled to unit variance, given back on their own scale.

    Coordinate descent runs over all configurations at once until no slope moves by more than `near` of the largest one.
    Without penalty the equations are solved directly. Columns that do not vary get 0.
    """
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    use = sd > 1e-12 * max(sd.max(initial=0.0), 1e-300)
    out = np.zeros((len(configs), len(xy)))
    if not use.any():
        return out
    r, c = cov[np.ix_(use, use)] / np.outer(sd[use], sd[use]), xy[use] / sd[use]
    penalty, mixture = np.array(configs, float).T
    l1, l2 = penalty * mixture, penalty * (1 - mixture)
    b = np.zeros((len(configs), len(c)))
    b[penalty == 0] = np.linalg.lstsq(r, c, rcond=1e-12)[0]
    todo = np.flatnonzero(penalty > 0)
    for _ in range(rounds):
        if not len(todo):
            break
        now, moved = b[todo], np.zeros(len(todo))
        for k in range(len(c)):
            pull = c[k] - now @ r[k] + now[:, k] * r[k, k]
            new = np.sign(pull) * np.maximum(np.abs(pull) - l1[todo], 0.0) / (r[k, k] + l2[todo])
            moved = np.maximum(moved, np.abs(new - now[:, k]))
            now[:, k] = new
        b[todo] = now
        todo = todo[moved > near * np.maximum(np.abs(now).max(axis=1), 1e-300)]
    out[:, use] = b / sd[use]
    return out


def grid(penalties: Iterable[float], mixtures: Iterable[float]) -> list[tuple[float, float]]:
    """Every (penalty, mixture)."""
    return [(float(p), float(m)) for p, m in product(penalties, mixtures)]


def resampled_fits(grams: DataFrame, cols: list[str], workflows: dict[str, list[str]], configs: list[tuple[float, float]]) -> DataFrame:
    """Every workflow (its columns) and (penalty, mixture), fitted on the complement of every fold and scored on the fold.

    One row per model, configuration, repeat and fold: rmse, rsq (squared correlation of predictions and outcome), n, intercept
    and slopes in the order of the workflow's columns. A fold that leaves no other row to train on gives nulls.
    """
    k = len(cols) + 2
    places = {name: np.array([cols.index(c) for c in own], dtype=int) for name, own in workflows.items()}
    # A repeat has as many rows as it has folds.
    total = grams.groupBy("repeat").agg(F.array(*[F.sum(F.col("gram")[i]) for i in range(k * k)]).alias("total"))

    def fit(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                fold, shift = np.asarray(r.gram, float).reshape(k, k), np.asarray(r.shift, float)[1:]
                train = np.asarray(r.total, float).reshape(k, k) - fold
                nf, mf, sf = moments(fold)
                nt, mt, st = moments(train) if train[0, 0] > 0.5 else (0.0, None, None)
                if not nt:
                    out.extend((name, *c, r.repeat, r.fold, None, None, r.n, None, None) for name, c in product(places, configs))
                    continue
                fits = {name: elastic_net(st[np.ix_(at, at)], st[at, -1], configs) for name, at in places.items()}
                for (name, at), (c, (penalty, mixture)) in product(places.items(), enumerate(configs)):
                    b = fits[name][c]
                    off = mt[-1] - mt[at] @ b  # the intercept about the overall means
                    var = b @ sf[np.ix_(at, at)] @ b
                    cov = b @ sf[at, -1]
                    bias = mf[-1] - mf[at] @ b - off
                    mse = max(sf[-1, -1] - 2 * cov + var, 0.0) + bias * bias
                    spread = var * sf[-1, -1]
                    rsq = cov * cov / spread if spread > 1e-24 * sf[-1, -1] ** 2 and nf > 1 else None
                    out.append((name, penalty, mixture, r.repeat, r.fold, float(np.sqrt(mse)), rsq, r.n,
                                float(off + shift[-1] - shift[at] @ b), b.tolist()))
            yield pd.DataFrame(out, columns=["model", "penalty", "mixture", "repeat", "fold", "rmse", "rsq", "n", "intercept", "slopes"])

    types = dict(grams.dtypes)
    schema = (f"model string, penalty double, mixture double, repeat {types['repeat']}, fold {types['fold']}, rmse double, rsq double, "
              "n long, intercept double, slopes array<double>")
    n = int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return grams.join(total, "repeat").repartition(n, "repeat", "fold").mapInPandas(fit, schema)


def search(df: DataFrame, workflows: dict[str, list[str]], label: str, configs: list[tuple[float, float]], repeat: str = "repeat",
           fold: str = "fold") -> DataFrame:
    """`resampled_fits` of a table with its repeats and folds, in one scan."""
    cols = list(dict.fromkeys(c for own in workflows.values() for c in own))
    return resampled_fits(fold_grams(df, cols, label, repeat, fold), cols, workflows, configs)
