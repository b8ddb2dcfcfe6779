"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Each text is reduced to a few statistics, transformed towards symmetry. Each class gets a mean and a covariance, shrunk
towards the pooled one and its own diagonal, from one aggregate of sums and cross-products over the labelled rows. The score
is the logistic of the difference of log densities, computed from the cached Cholesky factors as Mahalanobis distances.

Labels outside 0 and 1, and null ids, teach nothing; several labels of one document count each. With one class only or none
the score is the share of label 1 (one half without labels). Null texts count as empty; empty texts have statistics and a
score like others. Repeated rows get equal scores. An empty table gives an empty result. Extra columns are not read by
`scores` and carried unchanged by `keep_good`, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteseries.llm.common import packed, staged, text_of

THRESHOLD = 0.3
FOLDS = 5
#: Statistics of a text, in the order of the vectors.
STATISTICS = ("words", "word_length", "symbols", "exclamations", "upper", "bars", "digits", "same_as_last", "repeated",
              "distinct", "line_length", "repeated_lines", "letters", "worst_line")
_COUNTED = {"symbols": "#*$%&<>", "exclamations": "!", "bars": "|", "digits": "0123456789"}


def statistics(text: str) -> list[float]:
    """Shares are per word or per character and stretched near zero by log(1 + 100 x); eight
    more in the divisor keep a few marks in a short text from weighing as much as many in a long one."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n, size = len(words), max(1, sum(map(len, words)))
    safe = max(1, n)
    share = lambda x, of=safe: np.log1p(100.0 * x / (of + 8))
    counted = {k: sum(data.count(c.encode()) for c in chars) for k, chars in _COUNTED.items()}
    upper = sum(map(bytes.isupper, words))
    same = sum(map(bytes.__eq__, words, words[1:]))
    pairs = list(zip(words, words[1:], words[2:]))
    lines = [x for x in data.split(b"\n") if x.strip()]
    odd = size - len(data.translate(None, b"".join(bytes([c]) for c in range(128) if not chr(c).isalpha())))
    return [np.log1p(n), np.log(size / safe + 0.1), share(counted["symbols"]), share(counted["exclamations"]), share(upper),
            share(counted["bars"]), share(counted["digits"], size), share(same), share(len(pairs) - len(set(pairs))),
            np.log(len(set(words)) / safe + 0.05), np.log1p(n / max(1, len(lines))), share(len(lines) - len(set(lines)), max(1, len(lines))),
            share(odd, size), _worst_line(lines)]


def _worst_line(lines: list[bytes]) -> float:
    """The largest share of marked, shouted or repeated words that a stretch of at least twenty words reaches."""
    worst, n, bad = 0.0, 0, 0
    for line in lines:
        words = line.split()
        marks = sum(line.count(c) for c in (b"***", b"###", b"$$$", b"%%%", b"&&&", b"!!", b" | "))
        n += len(words)
        bad += min(len(words), marks + sum(map(bytes.__eq__, words, words[1:])))
        if n >= 20:
            worst, n, bad = max(worst, bad / n), 0, 0
    return np.log1p(100.0 * worst)


def statistics_column(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def stats(texts):
        import pandas as pd

        return pd.Series([statistics(t) for t in texts])

    return stats(text)


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors of the covariances and log determinants of classes 0 and 1, and their log odds."""

    means: list[np.ndarray]
    whiten: list[np.ndarray]
    log_det: list[float]
    log_odds: float
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        density = []
        for mean, whiten, log_det in zip(self.means, self.whiten, self.log_det):
            z = (x - mean) @ whiten.T
            density.append(-0.5 * (z * z).sum(axis=1) - 0.5 * log_det)
        d = np.clip(density[1] - density[0] + self.log_odds, -700, 700)
        return 1 / (1 + np.exp(-d))


def moments(labelled: DataFrame, k: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per label, the number of rows and the sums and cross-products of `stats`; each task sends one row per label."""

    def fold(batches):
        import pandas as pd

        total = {}
        for pdf in batches:
            for label, part in pdf.groupby("label"):
                x = np.stack(part["stats"].to_numpy())
                total[label] = total.get(label, 0) + np.r_[len(x), x.sum(axis=0), (x.T @ x).ravel()]
        yield pd.DataFrame([(int(q), i, float(v)) for q, row in total.items() for i, v in enumerate(row)], columns=["label", "i", "v"])

    sums = labelled.select("label", "stats").mapInPandas(fold, "label int, i int, v double").groupBy("label", "i").agg(F.sum("v").alias("v"))
    out = {}
    for r in sums.collect():  # two classes of 1 + k + k * k numbers
        out.setdefault(r["label"], np.zeros(1 + k + k * k))[r["i"]] = r["v"]
    return {q: (v[0], v[1:k + 1], v[k + 1:].reshape(k, k)) for q, v in out.items()}


def discriminant(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = 0.15, diagonal: float = 0.1,
                 floor: float = 1e-3) -> Discriminant:
    """Class covariances shrunk by the shares `pooled` and `diagonal`, with `floor` added to every variance."""
    n = [sums[q][0] if q in sums else 0.0 for q in (0, 1)]
    if min(n) < 2:
        return Discriminant([], [], [], 0.0, constant=n[1] / sum(n) if sum(n) else 0.5)
    means = [sums[q][1] / n[q] for q in (0, 1)]
    own = [sums[q][2] / n[q] - np.outer(means[q], means[q]) for q in (0, 1)]
    both = (n[0] * own[0] + n[1] * own[1]) / sum(n)
    whiten, log_det = [], []
    for cov in own:
        cov = (1 - pooled) * cov + pooled * both
        cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(cov)) + floor * np.eye(len(cov))
        factor = np.linalg.cholesky(cov)
        whiten.append(np.linalg.inv(factor))
        log_det.append(2 * float(np.log(np.diag(factor)).sum()))
    return Discriminant(means, whiten, log_det, float(np.log(n[1] / n[0])))


def held_out(id: Column) -> Column:
    """One fold of five, by the checksum of the id as text."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    """Learn from rows (doc_id, stats) and labels (doc_id, `label`) outside the held-out fold."""
    known = labels.select(F.col("doc_id"), F.col(f"`{label}`").cast("int").alias("label")).where("label IN (0, 1)").where(~held_out(F.col("doc_id")))
    return discriminant(moments(stats.select("doc_id", "stats").join(known, "doc_id"), len(STATISTICS)))


def scored(rows: DataFrame, model: Discriminant) -> DataFrame:
    @F.pandas_udf("double")
    def score(stats):
        import pandas as pd

        return pd.Series(model.score(np.stack(stats.to_numpy())) if len(stats) else np.empty(0))

    return rows.withColumn("score", score("stats"))


def scores(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = staged(docs.select(F.col(f"`{id}`").alias("doc_id"), statistics_column(text_of(text)).alias("stats")), "quality-statistics")
    out = scored(rows, fit(rows, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows predicted good, with all their columns."""
    stats = statistics_column(text_of(text)).alias("stats")
    light = staged(docs.select(F.col(f"`{id}`").alias("doc_id"), stats).join(labels.select("doc_id").distinct(), "doc_id", "left_semi"), "quality-labelled")
    model = fit(light, labels)
    return scored(docs.select(packed(docs), stats), model).where(F.col("score") >= threshold).select("row.*")


def op7_quality_classifier(spark, folder: str) -> DataFrame:
    return scores(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
