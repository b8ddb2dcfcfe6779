"""Principal components and constrained ordination.

The data meet Spark aggregates only; eigenproblems are k x k with k the number of predictors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteseries.operators.diversity import hellinger
from siteseries.operators.joins import natural_join, settled, with_group_stats
from siteseries.session import scratch_path
from siteseries.sources.files import stage
from siteseries.stats.moments import covariance, group_covariances, matrix_of


def fix_signs(vectors: np.ndarray) -> np.ndarray:
    """Columns turned so that the entry of largest size is positive."""
    lead = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return vectors * np.where(lead < 0, -1.0, 1.0)


@dataclass
class PCA:
    cols: list[str]
    n: int
    means: np.ndarray
    sds: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def share(self) -> np.ndarray:
        return self.values / self.values.sum()

    @property
    def axis_correlations(self) -> np.ndarray:
        """Correlation of each variable with each axis: loading x sqrt(eigenvalue)."""
        return self.vectors * np.sqrt(np.maximum(self.values, 0.0))

    def importance(self, spark) -> DataFrame:
        rows = [(f"PC{i + 1}", float(v), float(s), float(c), f"PC{i + 1} ({100 * s:.1f}%)")
                for i, (v, s, c) in enumerate(zip(self.values, self.share, np.cumsum(self.share)))]
        return spark.createDataFrame(rows, "axis string, eigenvalue double, share double, cumulative double, label string")

    def correlations(self, spark, axes: int = 2) -> DataFrame:
        schema = "predictor string, " + ", ".join(f"PC{i + 1}_r double" for i in range(axes))
        return spark.createDataFrame(
            [(c, *map(float, self.axis_correlations[i, :axes])) for i, c in enumerate(self.cols)], schema)

    def scores(self, df: DataFrame, axes: int = 2) -> DataFrame:
        """Row coordinates as plain column expressions; rows with a null predictor get null."""
        made = {}
        for j in range(axes):
            total = F.lit(0.0)
            for i, c in enumerate(self.cols):
                total = total + (F.col(c) - F.lit(float(self.means[i]))) * F.lit(float(self.vectors[i, j] / self.sds[i]))
            made[f"axis{j + 1}"] = total
        return df.withColumns(made)


def fit_pca(df: DataFrame, cols: list[str]) -> PCA:
    """PCA of standardised columns over complete rows."""
    return pca_of(cols, *covariance(df, cols))


def pca_by(df: DataFrame, keys: list[str], cols: list[str]) -> list[tuple[tuple, PCA]]:
    """A PCA per group, all groups from one aggregate of k x k numbers each; groups whose variables don't vary are left out."""
    out = []
    for row in group_covariances(df, keys, cols).collect():
        cov = matrix_of(row, cols).astype(float)
        if row["n"] > 1 and np.isfinite(cov).all() and (np.diag(cov) > 0).all():
            out.append((tuple(row[k] for k in keys), pca_of(cols, row["n"], np.array([row[f"mu|{c}"] for c in cols]), cov)))
    return sorted(out, key=lambda x: str(x[0]))


def pca_of(cols: list[str], n: int, means: np.ndarray, cov: np.ndarray) -> PCA:
    sds = np.sqrt(np.diag(cov))
    values, vectors = np.linalg.eigh(cov / np.outer(sds, sds))
    order = np.argsort(values)[::-1]
    return PCA(cols, n, means, sds, values[order], fix_signs(vectors[:, order]))


def cluster_predictors(coords: DataFrame, features: list[str], k: int, seed: int = 1503, max_iter: int = 50) -> DataFrame:
    """k-means clusters of variable coordinates."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=features, outputCol="_f").transform(coords)
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_f", predictionCol="cluster").fit(data)
    return model.transform(data).drop("_f")


@dataclass
class RDA:
    xs: list[str]
    unit: list[str]
    taxon: str
    n: int
    x_means: np.ndarray
    values: np.ndarray          # eigenvalues of the fitted values
    total: float                # total variance of the transformed community
    weights: np.ndarray         # predictors x axes: fitted scores = (x - mean) @ weights
    species: DataFrame          # taxon, axis1.. scores
    community: DataFrame        # long table with the transformed value `hell`
    env: DataFrame

    @property
    def share(self) -> np.ndarray:
        return self.values / self.total

    @property
    def constrained_share(self) -> np.ndarray:
        return self.values / self.values.sum()

    def axes(self, spark, axes: int = 2) -> DataFrame:
        rows = [(i + 1, f"axis{i + 1}", f"RDA{i + 1} ({100 * s:.1f}%)", float(s), float(c))
                for i, (s, c) in enumerate(list(zip(self.share, self.constrained_share))[:axes])]
        return spark.createDataFrame(rows, "axis int, name string, label string, variation_explained double, constrained_share double")

    def fitted_sites(self, axes: int = 2) -> DataFrame:
        """Constrained site scores: linear combinations of the predictors."""
        made = {}
        for j in range(axes):
            total = F.lit(0.0)
            for i, c in enumerate(self.xs):
                total = total + (F.col(c) - F.lit(float(self.x_means[i]))) * F.lit(float(self.weights[i, j]))
            made[f"axis{j + 1}"] = total
        return self.env.withColumns(made)

    def sites(self, axes: int = 2) -> DataFrame:
        """Site scores as weighted sums of species scores, centred over sites."""
        names = [f"axis{j + 1}" for j in range(axes)]
        rows = natural_join(self.community, self.species.select(self.taxon, *names), "inner", [self.taxon])
        sums = rows.groupBy(*self.unit).agg(*[F.sum(F.col("hell") * F.col(a)).alias(a) for a in names])
        centre = sums.agg(*[F.avg(a).alias(a) for a in names]).first()
        return sums.withColumns({a: F.col(a) - F.lit(centre[a]) for a in names})


def fit_rda(community: DataFrame, env: DataFrame, xs: list[str], value: str, unit: list[str],
            taxon: str = "lowest_taxon", already_transformed: bool = False) -> RDA:
    """Redundancy analysis of a Hellinger-transformed community on predictors.

    The community stays long and sparse. Per taxon one aggregate gives its cross-products with the
    centred predictors (absent taxa add nothing), a second one folds taxa into a p x p matrix. The
    nonzero eigenvalues of the fitted values are those of that matrix in the metric of (X'X)^-1, so no
    taxon x taxon matrix and no pair of taxa is ever formed.
    """
    env = env.select(*unit, *xs).dropna("any")
    rows = community.filter(F.col(value) > 0).groupBy(*unit, taxon).agg(F.sum(value).alias(value))
    long = rows.withColumnRenamed(value, "hell") if already_transformed else hellinger(rows, value, unit).drop(value)
    long = natural_join(long, env.select(*unit), "semi", unit)
    # both walk through several jobs below: write them once
    spark = community.sparkSession
    long = stage(long.select(*unit, taxon, "hell"), scratch_path(spark, "community"))
    env = stage(natural_join(env, long.select(*unit).distinct(), "semi", unit), scratch_path(spark, "predictors"))
    n, means, cov = covariance(env, xs)
    p = len(xs)
    joined = natural_join(long, env, "inner", unit)
    centred = [F.col(c) - F.lit(float(m)) for c, m in zip(xs, means)]
    per_taxon = joined.groupBy(taxon).agg(
        *[F.sum(F.col("hell") * c).alias(f"g{i}") for i, c in enumerate(centred)],
        F.sum(F.col("hell") * F.col("hell")).alias("ss"), F.sum("hell").alias("s"))
    per_taxon = stage(per_taxon, scratch_path(spark, "taxa"))
    aggs = [F.sum(F.col(f"g{i}") * F.col(f"g{j}")).alias(f"m{i}_{j}") for i in range(p) for j in range(i, p)]
    row = per_taxon.agg(*aggs, F.sum(F.col("ss") - F.col("s") * F.col("s") / n).alias("total")).first()
    m = np.empty((p, p))
    for i in range(p):
        for j in range(i, p):
            m[i, j] = m[j, i] = row[f"m{i}_{j}"]
    inv = np.linalg.inv(cov * (n - 1))
    half = np.linalg.cholesky(inv)                     # inv = half half'
    values, vectors = np.linalg.eigh(half.T @ m @ half)
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0.0), fix_signs(vectors[:, order])
    # species direction v = B' (half u) / sqrt(value), with B = inv G
    w = half @ vectors / np.sqrt(np.where(values > 0, values, np.inf))
    weights = inv @ m @ w
    species = per_taxon.select(taxon, *[
        sum((F.col(f"g{i}") * F.lit(float(w[i, j])) for i in range(p)), F.lit(0.0)).alias(f"axis{j + 1}")
        for j in range(p)])
    return RDA(xs, unit, taxon, n, means, values / (n - 1), row["total"] / (n - 1), weights, species, long, env)


def rda_axes_by(community: DataFrame, env: DataFrame, xs: list[str], value: str, unit: list[str], slice: str,
                taxon: str = "lowest_taxon") -> DataFrame:
    """Axes of a redundancy analysis of every slice at once: slice, axis, eigenvalue, variation_explained, constrained_share, n.

    `env` (slice, unit, xs) names the units of each slice; a unit may be in several. The community is transformed once; one
    aggregate keyed by slice and taxon gives the cross-products, one keyed by slice folds them, and a worker solves a p x p
    problem per slice. Slices whose predictors do not vary, or are collinear, have no axes.
    """
    p, spark = len(xs), community.sparkSession
    env = env.select(slice, *unit, *xs).dropna("any", subset=xs)
    rows = community.filter(F.col(value) > 0).groupBy(*unit, taxon).agg(F.sum(value).alias(value))
    long = natural_join(hellinger(rows, value, unit).drop(value), env.select(*unit).distinct(), "semi", unit)
    long = stage(long.select(*unit, taxon, "hell"), scratch_path(spark, "community"))
    env = stage(natural_join(env, long.select(*unit).distinct(), "semi", unit), scratch_path(spark, "predictors"))
    moments = stage(group_covariances(env, [slice], xs), scratch_path(spark, "moments"))
    centres = moments.select(slice, *[F.col(f"`mu|{c}`").alias(f"mu{i}") for i, c in enumerate(xs)])
    near = natural_join(env, settled(centres), "inner", [slice])
    near = near.select(slice, *unit, *[(F.col(c) - F.col(f"mu{i}")).alias(f"d{i}") for i, c in enumerate(xs)])
    per_taxon = natural_join(long, near, "inner", unit).groupBy(slice, taxon).agg(
        *[F.sum(F.col("hell") * F.col(f"d{i}")).alias(f"g{i}") for i in range(p)],
        F.sum(F.col("hell") * F.col("hell")).alias("ss"), F.sum("hell").alias("s"))
    counted = natural_join(per_taxon, settled(moments.select(slice, "n")), "inner", [slice])
    folded = counted.groupBy(slice).agg(
        F.array(*[F.sum(F.col(f"g{i}") * F.col(f"g{j}")) for i in range(p) for j in range(p)]).alias("m"),
        F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n")).alias("total"))
    cov = F.array(*[F.col(f"`{xs[min(i, j)]}|{xs[max(i, j)]}`") for i in range(p) for j in range(p)])
    solved = natural_join(folded, moments.select(slice, "n", cov.alias("cov")), "inner", [slice])

    def solve(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                s = np.array(r.cov, float).reshape(p, p) * (r.n - 1)
                m = np.array(r.m, float).reshape(p, p)
                if not np.isfinite(s).all() or np.linalg.matrix_rank(s) < p:
                    continue
                half = np.linalg.cholesky(np.linalg.inv(s))
                values = np.sort(np.maximum(np.linalg.eigvalsh(half.T @ m @ half), 0.0))[::-1]
                for k, v in enumerate(values):
                    out.append((r.name, k + 1, v / (r.n - 1), v / r.total, v / values.sum() if values.sum() else None, r.n))
            yield pd.DataFrame(out, columns=[slice, "axis", "eigenvalue", "variation_explained", "constrained_share", "n"])

    kind = dict(env.dtypes)[slice]
    schema = f"`{slice}` {kind}, axis int, eigenvalue double, variation_explained double, constrained_share double, n long"
    return solved.select(F.col(slice).alias("name"), "m", "total", "n", "cov").mapInPandas(solve, schema)


def site_means(scores: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """Mean coordinates per site."""
    return scores.groupBy(*keys).agg(*[F.avg(a).alias(f"{a}_mu") for a in axes])


def centroid_table(scores: DataFrame, keys: list[str], axes: tuple[str, str]) -> DataFrame:
    from siteseries.functions.numeric import distance2

    rows = with_group_stats(scores, keys, {f"{a}_mu": F.avg(a) for a in axes}, small=True)
    return rows.withColumn("centroid_dist", distance2(axes[0], axes[1], f"{axes[0]}_mu", f"{axes[1]}_mu"))
