"""Resampling, feature, engine and model-selection queries."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from siteseries.models import engines as E, features as X, gram, neighbours, resample, search
from siteseries.plans import views as V
from siteseries.session import scratch_path as scratch
from siteseries.plans.registry import query, r, tidy
from siteseries.plans.statistics import FRAME_CTE, frame
from siteseries.sources.files import stage
from siteseries.stats import regression as R, smooth as S

KEYS = ["site_code", "collection_period"]
PREDICTORS = ["annualrain", "x1", "x2", "x3"]
SEED = 1503


def staged(spark, sf):
    """The model frame as a stage table: every fit below reads it again."""
    return stage(frame(spark, sf), scratch(spark, "frame"))


def plain(cols):
    return [VectorAssembler(inputCols=cols, outputCol="features")]


SPLIT = f"""split AS (SELECT *, CASE WHEN k - 1 < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM (
  SELECT *, row_number() OVER (PARTITION BY site_code ORDER BY md5(concat_ws('|', '{SEED}', site_code, collection_period::VARCHAR))) AS k,
         count(*) OVER (PARTITION BY site_code) AS n FROM outcomes))"""


@query("l1_stratified_split", ("outcomes",), f"WITH {SPLIT} SELECT site_code, collection_period, part FROM split")
def l1(spark, sf):
    return resample.stratified_split(V.staged(V.totals(spark, sf).select(*KEYS)), KEYS, ["site_code"], 0.8, SEED).select(*KEYS, "part")


FOLDS = f"""folds AS (SELECT *, ((row_number() OVER (PARTITION BY repeat ORDER BY md5(concat_ws('|', '{SEED}', repeat::VARCHAR, site_code, collection_period::VARCHAR))) - 1) % 10 + 1)::BIGINT AS fold
  FROM outcomes CROSS JOIN (SELECT unnest(range(1, __REPEATS__ + 1)) AS repeat))"""


@query("l2_repeated_folds", ("outcomes",), f"WITH {FOLDS.replace('__REPEATS__', '5')} SELECT site_code, collection_period, repeat::BIGINT AS repeat, fold FROM folds")
def l2(spark, sf):
    return tidy(resample.repeated_folds(V.staged(V.totals(spark, sf).select(*KEYS)), KEYS, 10, 5, SEED).select(*KEYS, "repeat", "fold"))


BOOT = f"""boot AS (SELECT *, ({' + '.join(f'CASE WHEN u >= {p!r}::DOUBLE THEN 1 ELSE 0 END' for p in resample.POISSON_ONE)}) AS weight FROM (
  SELECT *, ('0x' || substr(md5(concat_ws('|', '{SEED}', resample::VARCHAR, site_code, collection_period::VARCHAR)), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM outcomes CROSS JOIN (SELECT unnest(range(1, __TIMES__ + 1)) AS resample)))"""


@query("l3_bootstrap_weights", ("outcomes",), f"""
WITH {BOOT.replace('__TIMES__', '100')} SELECT site_code, collection_period, resample::BIGINT AS resample, weight::BIGINT AS weight FROM boot WHERE weight > 0""")
def l3(spark, sf):
    out = resample.bootstrap_weights(V.totals(spark, sf).select(*KEYS), KEYS, 100, SEED)
    return tidy(out.select(*KEYS, "resample", "weight"))


def _tree_level(half: int) -> str:
    """Draws of spans of `half` positions from those of twice as many, by the binomial distribution written out."""
    return f"""t{half} AS MATERIALIZED (SELECT resample, unnest([lo, lo + {half}]) AS lo, unnest([below, d - below]) AS d FROM (
  SELECT resample, lo, d, least(d, count(*) FILTER (f <= u * tot)) AS below FROM (
    SELECT *, sum(q) OVER (PARTITION BY resample, lo ORDER BY k) AS f, sum(q) OVER (PARTITION BY resample, lo) AS tot FROM (
      SELECT resample, lo, d, k, (('0x' || substr(md5(concat_ws('|', '{SEED}', ((resample - 1) // 4)::VARCHAR, lo::VARCHAR, '{half}')), 1 + 8 * ((resample - 1) % 4)::INT, 8))::BIGINT
               + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u,
             CASE WHEN b = 0 THEN (k = d)::INT::DOUBLE ELSE exp(lgamma(d + 1) - lgamma(k + 1) - lgamma(d - k + 1) + k * ln(a / (a + b)::DOUBLE) + (d - k) * ln(b / (a + b)::DOUBLE)) END AS q
      FROM (SELECT *, unnest(range(0, d + 1)) AS k, least(n - lo, {half}) AS a, least(greatest(n - lo - {half}, 0), {half}) AS b
            FROM t{2 * half}, (SELECT count(*) AS n FROM outcomes) WHERE d > 0)))
  GROUP BY resample, lo, d))"""


#: Down from 4096 positions; the made panels have 25 sites and 80 months at every size.
DRAWS = f"""t4096 AS (SELECT unnest(range(1, __TIMES__ + 1)) AS resample, 0::BIGINT AS lo, (SELECT count(*) FROM outcomes) AS d),
{', '.join(_tree_level(1 << k) for k in range(11, -1, -1))},
placed AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '{SEED}', site_code, collection_period::VARCHAR))) - 1 AS lo FROM outcomes),
boot AS (SELECT placed.*, resample, d AS weight FROM placed JOIN t1 ON t1.lo = placed.lo WHERE d > 0)"""


@query("l3b_bootstrap_draws", ("outcomes",), f"""
WITH {DRAWS.replace('__TIMES__', '100')} SELECT site_code, collection_period, resample::BIGINT AS resample, weight::BIGINT AS weight FROM boot""")
def l3b(spark, sf):
    out = resample.bootstrap_draws(V.staged(V.totals(spark, sf).select(*KEYS)), KEYS, 100, SEED)
    return tidy(out.select(*KEYS, "resample", "weight"))


@query("l4_normalise", ("outcomes",), f"""
WITH {SPLIT}, c AS (SELECT {', '.join(f'avg({x}) AS {x}_m, stddev_samp({x}) AS {x}_s' for x in ('biomass', 'shannon', 'annualrain'))} FROM split WHERE part = 'train')
SELECT site_code, collection_period, part, {', '.join(f"{r(f'({x} - {x}_m) / {x}_s')} AS {x}" for x in ('biomass', 'shannon', 'annualrain'))} FROM split, c""")
def l4(spark, sf):
    cols = ["biomass", "shannon", "annualrain"]
    s = V.staged(resample.stratified_split(V.staged(V.outcomes(spark, sf).select(*KEYS, *cols)), KEYS, ["site_code"], 0.8, SEED))
    return tidy(X.normalise(s, cols, F.col("part") == "train").select(*KEYS, "part", *cols))


@query("l5_polynomial_features", ("env",), f"""
SELECT site_code, collection_period, {', '.join(f'{r(c)} AS {c}, {r(f"{c} * {c}")} AS {c}_p2' for c in ('x1', 'x2', 'x3'))},
  {', '.join(f'{r(f"{a} * {b}")} AS {a}_x_{b}' for a, b in (('x1', 'x2'), ('x1', 'x3'), ('x2', 'x3')))} FROM env""")
def l5(spark, sf):
    out, cols = X.polynomial(V.env(spark, sf), ["x1", "x2", "x3"])
    return tidy(out.select(*KEYS, *cols))


POLY = ["biomass", "annualrain"]


@query("l5b_orthogonal_polynomials", ("outcomes",), f"""
WITH {SPLIT},
a AS (SELECT {', '.join(f"avg({c}) AS {c}_a0" for c in POLY)} FROM split WHERE part = 'train'),
b AS (SELECT {', '.join(f"sum(pow({c} - {c}_a0, 2)) AS {c}_n2, sum(pow({c} - {c}_a0, 3)) / sum(pow({c} - {c}_a0, 2)) AS {c}_a1, sum(pow({c} - {c}_a0, 2)) / count(*) AS {c}_b1" for c in POLY)}
  FROM split, a WHERE part = 'train'),
q AS (SELECT site_code, collection_period, part, {', '.join(f"({c} - {c}_a0) / sqrt({c}_n2) AS {c}_o1, ({c} - {c}_a0 - {c}_a1) * ({c} - {c}_a0) - {c}_b1 AS {c}_q" for c in POLY)} FROM split, a, b),
n AS (SELECT {', '.join(f"sqrt(sum({c}_q * {c}_q)) AS {c}_n" for c in POLY)} FROM q WHERE part = 'train')
SELECT site_code, collection_period, part, {', '.join(f"{r(f'{c}_o1')} AS {c}_o1, {r(f'{c}_q / {c}_n')} AS {c}_o2" for c in POLY)} FROM q, n""")
def l5b(spark, sf):
    s = V.staged(resample.stratified_split(V.staged(V.outcomes(spark, sf).select(*KEYS, *POLY)), KEYS, ["site_code"], 0.8, SEED))
    out, cols = X.orthogonal_polynomial(s, POLY, F.col("part") == "train")
    return tidy(out.select(*KEYS, "part", *cols))


def _finished(spark, sf, stages, engine, label="density"):
    """Split, fit on the training part, score the test part once."""
    df = stage(resample.stratified_split(staged(spark, sf), KEYS, ["site_code"], 0.8, SEED), scratch(spark, "split"))
    _, metrics = search.finalise(df, X.workflow(stages, engine), label)
    return tidy(metrics, 3)


@query("l6_pca_features")
def l6(spark, sf):
    return _finished(spark, sf, X.reduced_features(PREDICTORS, ["x1", "x2", "x3"], 2), E.elastic_net("density"))


@query("l7_elastic_net")
def l7(spark, sf):
    return _finished(spark, sf, X.standard_features(PREDICTORS), E.elastic_net("density", 0.05, 0.5))


@query("l8_regression_tree")
def l8(spark, sf):
    return _finished(spark, sf, plain(PREDICTORS), E.tree("density"))


@query("l9_bagged_trees")
def l9(spark, sf):
    return _finished(spark, sf, plain(PREDICTORS), E.bagged_trees("density", 50))


@query("l10_random_forest")
def l10(spark, sf):
    return _finished(spark, sf, plain(PREDICTORS), E.forest("density"))


@query("l11_boosted_trees")
def l11(spark, sf):
    return _finished(spark, sf, plain(PREDICTORS), E.boosted("density"))


@query("l12_nearest_neighbours", ("vectors",), f"""
WITH s AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '{SEED}', vec_id::VARCHAR))) <= floor(count(*) OVER (PARTITION BY label) * 0.8::DOUBLE) AS train FROM vectors),
t AS (SELECT * FROM s WHERE train), q AS (SELECT * FROM s WHERE NOT train),
d AS (SELECT q.vec_id, t.{V.VECTOR_COLUMNS[-1]} AS y, t.vec_id::VARCHAR AS rk, sqrt({' + '.join(f'pow(q.x{i} - t.x{i}, 2)' for i in range(1, V.VECTOR_SIZE))}) AS d FROM q CROSS JOIN t),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, rk) AS k FROM d)
SELECT vec_id, {r('sum(y / (d + 1e-9::DOUBLE)) / sum(1 / (d + 1e-9::DOUBLE))')} AS prediction FROM k WHERE k <= 5 GROUP BY vec_id""")
def l12(spark, sf):
    v = stage(resample.stratified_split(V.vectors(spark, sf), ["vec_id"], ["label"], 0.8, SEED), scratch(spark, "vectors"))
    train, test = v.filter(F.col("part") == "train"), v.filter(F.col("part") == "test")
    return tidy(neighbours.knn_regression(train, test, ["vec_id"], V.VECTOR_COLUMNS[:-1], V.VECTOR_COLUMNS[-1], 5))


# Workflows by predictor set and preprocessing, and their columns. Those of the checked queries have closed forms in SQL.
SQUARES = ["annualrain", "biomass"]
WORKFLOWS = {"rain_norm": ["annualrain"], "rain_poly": ["annualrain", "annualrain_p2"], "size_norm": ["biomass"], "size_poly": ["biomass", "biomass_p2"],
             "both_norm": ["biomass", "annualrain"], "habitat_norm": ["x1", "x2"]}
PENALTIES, MIXTURES = (0.0, 0.1, 1.0, 10.0, 100.0), (0.0, 0.25, 0.5, 0.75, 1.0)


def folded(spark, sf):
    """The model frame with squares, ten folds, five times."""
    df = staged(spark, sf).withColumns({f"{c}_p2": F.col(c) * F.col(c) for c in SQUARES})
    return stage(resample.repeated_folds(df, KEYS, 10, 5, SEED), scratch(spark, "folds"))


GRID_FOLDS = f"""{FRAME_CTE},
{FOLDS.replace('FROM outcomes', 'FROM frame').replace('__REPEATS__', '5')},
wf AS (SELECT f.site_code, f.collection_period, f.repeat, f.fold, f.density AS y, w.model, w.a, w.b FROM folds f, LATERAL (VALUES
  ('rain_norm', annualrain, 0::DOUBLE), ('rain_poly', annualrain, annualrain * annualrain), ('size_norm', biomass, 0), ('size_poly', biomass, biomass * biomass),
  ('both_norm', biomass, annualrain), ('habitat_norm', x1, x2)) w(model, a, b)),
held AS (SELECT DISTINCT repeat, fold FROM folds)"""
GRID_FIT = f"""{GRID_FOLDS},
tr AS (SELECT w.model, h.repeat, h.fold, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS saa, var_pop(b) AS sbb, covar_pop(a, b) AS sab, covar_pop(a, y) AS say, covar_pop(b, y) AS sby
  FROM held h JOIN wf w ON w.repeat = h.repeat AND w.fold <> h.fold GROUP BY ALL),
co AS (SELECT *, CASE WHEN sbb = 0 THEN say / saa ELSE (say * sbb - sby * sab) / (saa * sbb - sab * sab) END AS ca,
  CASE WHEN sbb = 0 THEN 0 ELSE (sby * saa - say * sab) / (saa * sbb - sab * sab) END AS cb FROM tr),
p AS (SELECT w.model, w.repeat, w.fold, w.y, my + ca * (a - ma) + cb * (b - mb) AS yhat FROM wf w JOIN co ON co.model = w.model AND co.repeat = w.repeat AND co.fold = w.fold),
fm AS (SELECT model, repeat, fold, sqrt(avg(pow(y - yhat, 2))) AS rmse, pow(corr(y, yhat), 2) AS rsq, count(*) AS n FROM p GROUP BY ALL)"""


def grid_metrics(spark, sf):
    """Held-out rmse and rsq of every unpenalised workflow over 10 x 5 folds."""
    return gram.search(folded(spark, sf), WORKFLOWS, "density", [(0.0, 0.0)])


@query("l13_workflow_grid", ("outcomes", "env"), f"""
WITH {GRID_FIT} SELECT model, repeat::BIGINT AS repeat, fold::BIGINT AS fold, {r('rmse', 4)} AS rmse, {r('rsq', 5)} AS rsq, n::BIGINT AS n FROM fm""")
def l13(spark, sf):
    return tidy(grid_metrics(spark, sf).select("model", "repeat", "fold", "rmse", "rsq", "n"), 4, rsq=5)


# With one predictor, scaled to unit variance, a penalised fit has a closed form: the shrunk soft-thresholded covariance.
@query("l14_grid_search", ("outcomes", "env"), f"""
WITH {GRID_FOLDS},
tr AS (SELECT w.model, h.repeat, h.fold, avg(y) AS my, avg(a) AS ma, stddev_pop(a) AS sa, covar_pop(a, y) / stddev_pop(a) AS c
  FROM held h JOIN wf w ON w.repeat = h.repeat AND w.fold <> h.fold WHERE w.model IN ('rain_norm', 'size_norm') GROUP BY ALL),
co AS (SELECT tr.*, penalty, mixture, sign(c) * greatest(abs(c) - penalty * mixture, 0) / (1 + penalty * (1 - mixture)) / sa AS ca
  FROM tr, (SELECT unnest({list(PENALTIES)})::DOUBLE AS penalty), (SELECT unnest({list(MIXTURES)})::DOUBLE AS mixture)),
p AS (SELECT w.model, penalty, mixture, w.repeat, w.fold, w.y, my + ca * (a - ma) AS yhat FROM wf w JOIN co ON co.model = w.model AND co.repeat = w.repeat AND co.fold = w.fold),
fm AS (SELECT model, penalty, mixture, repeat, fold, sqrt(avg(pow(y - yhat, 2))) AS rmse FROM p GROUP BY ALL)
SELECT model, penalty, mixture, {r('avg(rmse)', 4)} AS rmse, {r('stddev_samp(rmse) / sqrt(count(*))', 4)} AS std_err, count(*)::BIGINT AS n FROM fm GROUP BY model, penalty, mixture""")
def l14(spark, sf):
    some = {w: WORKFLOWS[w] for w in ("rain_norm", "size_norm")}
    fits = gram.search(folded(spark, sf), some, "density", gram.grid(PENALTIES, MIXTURES))
    keys = ["model", "penalty", "mixture"]
    return tidy(fits.groupBy(*keys).agg(F.avg("rmse").alias("rmse"), (F.stddev_samp("rmse") / F.sqrt(F.count("rmse"))).alias("std_err"),
                                        F.count("rmse").alias("n")), 4)


@query("l14b_full_grid")
def l14b(spark, sf):
    """Every predictor set with and without squares and products x 25 configurations x 10 x 5 folds, best first."""
    df = staged(spark, sf)
    wide, _ = X.polynomial(df, PREDICTORS)
    sets = {"all": PREDICTORS, "habitat": ["x1", "x2", "x3"], "rain": ["annualrain"]}
    flows = {f"{name}_norm": cols for name, cols in sets.items()} | {f"{name}_poly": X.polynomial(df, cols)[1] for name, cols in sets.items()}
    fits = gram.search(stage(resample.repeated_folds(wide, KEYS, 10, 5, SEED), scratch(spark, "folds")), flows, "density", gram.grid(PENALTIES, MIXTURES))
    named = fits.withColumn("model", F.concat_ws("_", "model", "penalty", "mixture"))
    return tidy(search.rank_models(search.collect_metrics(named), "rmse"), 4)


@query("l15_collected_metrics", ("outcomes", "env"), f"""
WITH {GRID_FIT}, c AS (SELECT model, 'rmse' AS metric, avg(rmse) AS mean, count(*) AS n, stddev_samp(rmse) / sqrt(count(*)) AS std_err FROM fm GROUP BY ALL)
SELECT model, metric, {r('mean', 4)} AS mean, n::BIGINT AS n, {r('std_err', 4)} AS std_err, row_number() OVER (ORDER BY mean)::BIGINT AS rank FROM c""")
def l15(spark, sf):
    return tidy(search.rank_models(search.collect_metrics(grid_metrics(spark, sf)), "rmse"), 4)


PAIRS = [(b, a) for k, b in enumerate(sorted(WORKFLOWS)) for a in sorted(WORKFLOWS)[:k]]


@query("l16_between_model_correlation", ("outcomes", "env"), f"""
WITH {GRID_FIT}, w AS (SELECT repeat, fold, {', '.join(f"max(rsq) FILTER (WHERE model = '{m}') AS {m}" for m in sorted(WORKFLOWS))} FROM fm GROUP BY ALL)
{' UNION ALL '.join(f"SELECT '{x}' AS x, '{y}' AS y, {r(f'corr({x}, {y})', 5)} AS r FROM w" for x, y in PAIRS)}""")
def l16(spark, sf):
    return tidy(search.between_model_correlation(stage(grid_metrics(spark, sf), scratch(spark, "metrics")), sorted(WORKFLOWS)), 5)


@query("l17_final_fit", ("outcomes",), f"""
WITH {SPLIT}, f AS (SELECT regr_slope(density, richness) AS b, regr_intercept(density, richness) AS a FROM split WHERE part = 'train')
SELECT {r('sqrt(avg(pow(density - a - b * richness, 2)))', 4)} AS rmse, {r('pow(corr(density, a + b * richness), 2)', 5)} AS rsq, count(*)::BIGINT AS n FROM split, f WHERE part = 'test'""")
def l17(spark, sf):
    df = stage(resample.stratified_split(V.staged(V.outcomes(spark, sf)), KEYS, ["site_code"], 0.8, SEED), scratch(spark, "split"))
    _, metrics = search.finalise(df, X.workflow(plain(["richness"]), E.elastic_net("density", 0.0, 0.0)), "density")
    return tidy(metrics, 4, rsq=5)


COEFFICIENTS = f"""w AS (SELECT season, resample, sum(weight) AS sw, sum(weight * annualrain) / sum(weight) AS mx, sum(weight * richness) / sum(weight) AS my FROM boot WHERE weight > 0 GROUP BY ALL),
s AS (SELECT b.season, b.resample, sum(weight * (annualrain - mx) * (richness - my)) / sum(weight * pow(annualrain - mx, 2)) AS slope
  FROM boot b JOIN w ON w.season = b.season AND w.resample = b.resample WHERE weight > 0 GROUP BY ALL),
q AS (SELECT season, quantile_cont(slope, 0.25) AS lo, median(slope) AS me, quantile_cont(slope, 0.75) AS hi FROM s GROUP BY ALL)
SELECT s.season, {r('lo', 8)} AS lower, {r('me', 8)} AS middle, {r('hi', 8)} AS upper, {r('min(slope) FILTER (WHERE slope >= lo - 1.5 * (hi - lo))', 8)} AS whisker_low,
  {r('max(slope) FILTER (WHERE slope <= hi + 1.5 * (hi - lo))', 8)} AS whisker_high, count(*) FILTER (WHERE slope < lo - 1.5 * (hi - lo) OR slope > hi + 1.5 * (hi - lo))::BIGINT AS outliers, count(*)::BIGINT AS nobs
FROM s JOIN q USING (season) GROUP BY s.season, lo, me, hi"""


def _coefficients(spark, drawn):
    fits = R.weighted_slope(stage(drawn, scratch(spark, "weights")), ["season", "resample"], "annualrain", "richness", "weight")
    return tidy(S.box_stats(stage(fits.select("season", "slope"), scratch(spark, "slopes")), ["season"], "slope"), 8)


@query("l18_coefficient_distribution", ("outcomes",), f"WITH {BOOT.replace('__TIMES__', '100')}, {COEFFICIENTS}")
def l18(spark, sf):
    return _coefficients(spark, resample.bootstrap_weights(V.outcomes(spark, sf).select(*KEYS, "season", "annualrain", "richness"), KEYS, 100, SEED))


@query("l18b_coefficients_of_draws", ("outcomes",), f"WITH {DRAWS.replace('__TIMES__', '100')}, {COEFFICIENTS}")
def l18b(spark, sf):
    rows = V.staged(V.outcomes(spark, sf).select(*KEYS, "season", "annualrain", "richness"))
    return _coefficients(spark, resample.bootstrap_draws(rows, KEYS, 100, SEED))


@query("l19_importance")
def l19(spark, sf):
    model = X.workflow(plain(PREDICTORS), E.forest("density")).fit(staged(spark, sf))
    return tidy(spark.createDataFrame(search.importance(model, PREDICTORS), "variable string, importance double"))
