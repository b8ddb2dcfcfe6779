"""Regression engines of Spark ML under the names used in a model grid."""

from __future__ import annotations

from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor


def elastic_net(label: str, penalty: float = 0.01, mixture: float = 0.5) -> LinearRegression:
    return LinearRegression(labelCol=label, regParam=penalty, elasticNetParam=mixture, maxIter=100)


def tree(label: str, depth: int = 5, min_rows: int = 5, seed: int = 1503) -> DecisionTreeRegressor:
    return DecisionTreeRegressor(labelCol=label, maxDepth=depth, minInstancesPerNode=min_rows, seed=seed)


def bagged_trees(label: str, trees: int = 50, depth: int = 5, seed: int = 1503) -> RandomForestRegressor:
    """Bagging: a forest that may use every predictor at every split."""
    return RandomForestRegressor(labelCol=label, numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", seed=seed)


def forest(label: str, trees: int = 1000, depth: int = 5, min_rows: int = 5, seed: int = 1503) -> RandomForestRegressor:
    return RandomForestRegressor(labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=min_rows,
                                 featureSubsetStrategy="onethird", seed=seed)


def boosted(label: str, rounds: int = 20, depth: int = 4, step: float = 0.1, seed: int = 1503) -> GBTRegressor:
    return GBTRegressor(labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed)
