"""Grid search over resamples, metric tables, final fits and expectations."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteseries.functions.numeric import ratio
from siteseries.operators.joins import natural_join
from siteseries.stats.correlation import correlation_pairs
from siteseries.stats.moments import corr


def workflow_grid(predictor_sets: dict[str, list[str]], preprocessing: dict[str, object],
                  engines: dict[str, object]) -> dict[str, Pipeline]:
    """Every predictor set x preprocessing x engine as a named ML workflow."""
    out = {}
    for (s, cols), (p, make), (e, engine) in itertools.product(
            predictor_sets.items(), preprocessing.items(), engines.items()):
        out[f"{s}_{p}_{e}"] = Pipeline(stages=[*make(cols), engine.copy()])
    return out


def fold_metrics(df: DataFrame, workflows: dict[str, Pipeline], label: str, folds: int,
                 fold: str = "fold", repeat: str = "repeat", repeats: int = 1) -> DataFrame:
    """rmse and r2 of every workflow on every held-out fold. Each fit and each score is a Spark job."""
    parts = []
    for name, wf in workflows.items():
        for r, f in itertools.product(range(1, repeats + 1), range(1, folds + 1)):
            one = df.filter(F.col(repeat) == r)
            model = wf.fit(one.filter(F.col(fold) != f))
            held = model.transform(one.filter(F.col(fold) == f))
            parts.append(score(held, label).select(
                F.lit(name).alias("model"), F.lit(r).alias("repeat"), F.lit(f).alias("fold"), "*"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def score(held: DataFrame, label: str, prediction: str = "prediction", keys: list[str] | None = None) -> DataFrame:
    """Root mean squared error and squared correlation."""
    return held.groupBy(*(keys or [])).agg(
        F.sqrt(F.avg(F.pow(F.col(label) - F.col(prediction), 2))).alias("rmse"),
        F.pow(corr(label, prediction), 2).alias("rsq"), F.count(F.lit(1)).alias("n"))


def tune(df: DataFrame, wf: Pipeline, grid: dict, label: str, fold: str = "fold", folds: int = 10,
         parallelism: int = 4):
    """Grid search with a user-given fold column (values 1..folds)."""
    builder = ParamGridBuilder()
    for param, values in grid.items():
        builder = builder.addGrid(param, values)
    numbered = df.withColumn("_fold", (F.col(fold) - 1).cast("int"))
    cv = CrossValidator(estimator=wf, estimatorParamMaps=builder.build(),
                        evaluator=RegressionEvaluator(labelCol=label, metricName="rmse"), numFolds=folds,
                        foldCol="_fold", parallelism=parallelism)
    return cv.fit(numbered)


def collect_metrics(metrics: DataFrame, model: str = "model", values: tuple[str, ...] = ("rmse", "rsq")) -> DataFrame:
    """Mean, standard error and count by model and metric."""
    rows = metrics.select(model, F.explode(F.array(*[
        F.struct(F.lit(v).alias("metric"), F.col(v).alias("v")) for v in values])).alias("e")).select(model, "e.*")
    return rows.groupBy(model, "metric").agg(
        F.avg("v").alias("mean"), F.count("v").alias("n"),
        ratio(F.stddev_samp("v"), F.sqrt(F.count("v"))).alias("std_err"))


def rank_models(collected: DataFrame, metric: str = "rmse", model: str = "model") -> DataFrame:
    """Models from best to worst; the table has one row per configuration, so the ranking window is small."""
    by_value = Window.partitionBy("metric").orderBy(F.col("mean").asc() if metric == "rmse" else F.col("mean").desc(), F.col(model))
    return collected.filter(F.col("metric") == metric).withColumn("rank", F.row_number().over(by_value))


def wide_fold_metric(metrics: DataFrame, models: list[str], value: str = "rsq") -> DataFrame:
    """One row per fold, one column per model."""
    return metrics.groupBy("repeat", "fold").pivot("model", models).agg(F.first(value))


def between_model_correlation(metrics: DataFrame, models: list[str], value: str = "rsq") -> DataFrame:
    return correlation_pairs(wide_fold_metric(metrics, models, value), models)


def finalise(df: DataFrame, wf: Pipeline, label: str, part: str = "part") -> tuple[PipelineModel, DataFrame]:
    """Fit on the training rows and score the test rows once."""
    model = wf.fit(df.filter(F.col(part) == "train"))
    return model, score(model.transform(df.filter(F.col(part) == "test")), label)


def observed_minus_expected(df: DataFrame, wf: Pipeline, label: str, is_base: Column, events: DataFrame | None = None,
                            ratios: tuple[str, ...] = ()) -> DataFrame:
    """Fit on baseline rows, predict all rows and take the residual, beside the logs of the event statistics of `events`.

    `events` is joined on the columns it shares with the rows, null keys included; each of its `ratios` gives an `ln_` column,
    null where the ratio is not positive. Rows without an event keep their residual.
    """
    model = wf.fit(df.filter(is_base))
    out = model.transform(df).withColumn("residual", F.col(label) - F.col("prediction"))
    if events is not None:
        out = natural_join(out, events, "left")
    return out.withColumns({f"ln_{c}": F.when(F.col(c) > 0, F.ln(c)) for c in ratios})


def importance(model: PipelineModel, cols: list[str]) -> list[tuple[str, float]]:
    """Predictor importances of a fitted tree model, largest first."""
    scores = model.stages[-1].featureImportances.toArray()
    return sorted(zip(cols, map(float, scores)), key=lambda t: (-t[1], t[0]))
