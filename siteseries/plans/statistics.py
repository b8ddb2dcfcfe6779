"""Correlation, ordination, regression, test, path and smoothing queries."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import functions as F

from siteseries.functions.special import f_upper_p, normal_two_sided_p, studentized_range_p, t_two_sided_p
from siteseries.operators import fill
from siteseries.operators.aggregate import composition_percent, seasonal
from siteseries.operators.joins import attach, natural_join
from siteseries.operators.scaling import centred, log_ratio_to_mean, z_scores
from siteseries.functions.dates import flag_window
from siteseries.functions.numeric import QUANTILE_A, QUANTILE_B, QUANTILE_C, QUANTILE_D, QUANTILE_LOW, ln_pos, ratio
from siteseries.plans import views as V
from siteseries.plans.registry import query, r, tidy
from siteseries.session import scratch_path as scratch
from siteseries.sources.files import stage, table
from siteseries.stats import compare as T, correlation as C, mixed as M, ordination as O, path as P, permute as N, regression as R, smooth as S

KEYS = ["site_code", "collection_period"]
VC = V.VECTOR_COLUMNS
OUT = ["density", "biomass", "richness", "shannon"]
X3 = ["x1", "x2", "x3"]


def filled_env(spark, sf):
    e = V.env(spark, sf).withColumn("qtr", F.quarter("collection_period"))
    return fill.group_mean_impute(e, ["site_code", "qtr"], X3).drop("qtr")


FILLED_CTE = f"""fe AS (SELECT site_code, collection_period, {', '.join(f"coalesce({c}, avg({c}) OVER q) AS {c}" for c in X3)} FROM env
  WINDOW q AS (PARTITION BY site_code, quarter(collection_period)))"""


def frame(spark, sf):
    """Outcomes beside gap-filled predictors, complete rows."""
    return natural_join(V.outcomes(spark, sf), filled_env(spark, sf), "inner", KEYS).dropna("any")


FRAME_CTE = FILLED_CTE + """,
frame AS (SELECT o.*, x1, x2, x3 FROM outcomes o JOIN fe USING (site_code, collection_period)
  WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL)"""


# --- correlation -------------------------------------------------------------------------------

def _matrix_row(i: int) -> str:
    cells = [f"{r(f'corr({VC[i]}, {c})', 2)} AS {c}" if j < i else f"NULL::DOUBLE AS {c}" for j, c in enumerate(VC)]
    return f"SELECT '{VC[i]}' AS term, {', '.join(cells)} FROM vectors"


@query("m1_correlation_matrix", ("vectors",), " UNION ALL ".join(_matrix_row(i) for i in range(1, len(VC))))
def m1(spark, sf):
    return tidy(C.correlation_matrix(V.vectors(spark, sf), VC, 15), 2)


@query("m2_target_correlations", ("outcomes", "env"), f"""
WITH {FRAME_CTE} SELECT site_code, x, y, {r('v')} AS r FROM ({' UNION ALL '.join(
    f"SELECT site_code, '{t}' AS x, '{p}' AS y, corr({t}, {p}) AS v FROM frame GROUP BY ALL" for t in OUT for p in X3)})""")
def m2(spark, sf):
    out = C.target_correlations(frame(spark, sf), OUT, X3, ["site_code"])
    return tidy(out.orderBy(*C.by_strength()))


# --- ordination --------------------------------------------------------------------------------

@query("m3_pca_importance")
def m3(spark, sf):
    fit = O.fit_pca(V.vectors(spark, sf), VC)
    return tidy(fit.importance(spark))


@query("m4_pca_axis_correlations")
def m4(spark, sf):
    return tidy(O.fit_pca(V.vectors(spark, sf), VC).correlations(spark))


@query("m5_pca_coordinates")
def m5(spark, sf):
    v = V.vectors(spark, sf)
    scores = O.fit_pca(v, VC).scores(v)
    return tidy(natural_join(scores.select("vec_id", "label", "axis1", "axis2"),
                             O.site_means(scores, ["label"], ["axis1", "axis2"]), "left", ["label"]))


@query("m6_predictor_clusters")
def m6(spark, sf):
    coords = O.fit_pca(V.vectors(spark, sf), VC).correlations(spark)
    return tidy(O.cluster_predictors(coords, ["PC1_r", "PC2_r"], 6))


@query("m7_pca_by_year")
def m7(spark, sf):
    rows = frame(spark, sf).withColumn("year", F.year("collection_period"))
    parts = [fit.importance(spark).withColumn("slice", F.lit(year)) for (year,), fit in O.pca_by(rows, ["year"], [*OUT, *X3])]
    return tidy(reduce(lambda a, b: a.unionByName(b), parts))


RX = [*X3, "annualrain"]


def rda_inputs(spark, sf):
    # the fit walks the community several times: both inputs become stage tables
    env = natural_join(filled_env(spark, sf), V.site_dim(spark, sf).select("site_code", "annualrain"), "left", ["site_code"])
    return (stage(V.survey(spark, sf).select(*KEYS, "lowest_taxon", "density"), scratch(spark, "community")),
            stage(env.select(*KEYS, *RX), scratch(spark, "env")))


@query("m8_redundancy_axes")
def m8(spark, sf):
    community, env = rda_inputs(spark, sf)
    return tidy(O.fit_rda(community, env, RX, "density", KEYS).axes(spark, 4))


@query("m8b_redundancy_sites")
def m8b(spark, sf):
    community, env = rda_inputs(spark, sf)
    fit = O.fit_rda(community, env, RX, "density", KEYS)
    return tidy(O.centroid_table(fit.sites(2), ["site_code"], ("axis1", "axis2")))


@query("m8c_redundancy_species")
def m8c(spark, sf):
    community, env = rda_inputs(spark, sf)
    return tidy(O.fit_rda(community, env, RX, "density", KEYS).species.select("lowest_taxon", "axis1", "axis2"))


def species_and_environment(fit, xs):
    """(keys, variable, kind, v): the transformed community and the predictors of an ordination, as one long table."""
    species = fit.community.select(*KEYS, F.col("lowest_taxon").alias("variable"), F.lit("species").alias("kind"), F.col("hell").alias("v"))
    return species.unionByName(fit.env.unpivot(KEYS, xs, "variable", "v").withColumn("kind", F.lit("environment")))


# The axes of two predictors span what the predictors span, so the fit of a variable on them follows from correlations with the two.
@query("m9_vector_fit", ("survey", "env"), f"""
WITH {FILLED_CTE},
u AS (SELECT site_code, collection_period, x1, x2 FROM fe WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND (site_code, collection_period) IN (SELECT site_code, collection_period FROM survey WHERE density > 0)),
t AS (SELECT site_code, collection_period, lowest_taxon, sum(density) AS x FROM survey WHERE density > 0 GROUP BY ALL),
d AS (SELECT site_code, collection_period, lowest_taxon, sqrt(x / sum(x) OVER (PARTITION BY site_code, collection_period)) AS hell FROM t),
taxa AS (SELECT DISTINCT lowest_taxon FROM d JOIN u USING (site_code, collection_period)),
v AS (SELECT lowest_taxon AS variable, 'species' AS type, x1, x2, coalesce(hell, 0) AS v FROM u CROSS JOIN taxa LEFT JOIN d USING (site_code, collection_period, lowest_taxon)
  UNION ALL SELECT 'x1', 'environment', x1, x2, x1 FROM u UNION ALL SELECT 'x2', 'environment', x1, x2, x2 FROM u),
c AS (SELECT variable, type, count(*) AS nobs, corr(v, x1) AS r1, corr(v, x2) AS r2, corr(x1, x2) AS r12 FROM v GROUP BY ALL)
SELECT variable, type, nobs::BIGINT AS nobs, {r('(r1 * r1 + r2 * r2 - 2 * r1 * r2 * r12) / (1 - r12 * r12)')} AS r FROM c""")
def m9(spark, sf):
    community, env = rda_inputs(spark, sf)
    fit = O.fit_rda(community, env, ["x1", "x2"], "density", KEYS)
    out = N.fit_on_axes(fit.fitted_sites(2), KEYS, ("axis1", "axis2"), species_and_environment(fit, ["x1", "x2"]), 0)
    return tidy(out.select("variable", F.col("kind").alias("type"), "nobs", "r"))


@query("m9b_vector_fit_permutation")
def m9b(spark, sf):
    """Species and predictors on the first two axes of the whole ordination, those with p < .05 after 999 permutations."""
    community, env = rda_inputs(spark, sf)
    fit = O.fit_rda(community, env, RX, "density", KEYS)
    out = N.fit_on_axes(fit.fitted_sites(2), KEYS, ("axis1", "axis2"), species_and_environment(fit, RX), 999)
    return tidy(out.where("p < 0.05").select("variable", "r", "p", "axis1", "axis2", F.col("kind").alias("type")))


SLICES = {"all": "true", "1997-1998": "year(collection_period) IN (1997, 1998)", "1999-2000": "year(collection_period) IN (1999, 2000)",
          "Winter": "month(collection_period) IN (11, 12, 1, 2, 3)", "Spring": "month(collection_period) IN (4, 5, 6)",
          "Summer": "month(collection_period) IN (7, 8)", "Fall": "month(collection_period) IN (9, 10)"}


def sliced(env):
    """Units by slice: all, the two date slices and the seasons."""
    names = F.array_compact(F.array(*[F.when(F.expr(rule), name) for name, rule in SLICES.items()]))
    return env.withColumn("slice", F.explode(names))


@query("m10_redundancy_by_slice")
def m10(spark, sf):
    community, env = rda_inputs(spark, sf)
    return tidy(O.rda_axes_by(community, sliced(env), RX, "density", KEYS, "slice"))


@query("m10_redundancy_by_season")
def m10_seasons(spark, sf):
    community, env = rda_inputs(spark, sf)
    seasons = sliced(env).where(F.col("slice").isin("Winter", "Spring", "Summer", "Fall"))
    return tidy(O.rda_axes_by(community, seasons, RX, "density", KEYS, "slice").where("axis <= 2"))


# Of two predictors the eigenvalues follow from the trace and the determinant of a 2 x 2 matrix.
@query("m10b_redundancy_two_predictors", ("survey", "env"), f"""
WITH {FILLED_CTE},
u AS (SELECT site_code, collection_period, x1, x2 FROM fe WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND (site_code, collection_period) IN (SELECT site_code, collection_period FROM survey WHERE density > 0)),
sl AS ({' UNION ALL '.join(f"SELECT '{name}' AS slice, * FROM u WHERE {rule}" for name, rule in SLICES.items())}),
mo AS (SELECT slice, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, var_samp(x1) * (count(*) - 1) AS s11, var_samp(x2) * (count(*) - 1) AS s22, covar_samp(x1, x2) * (count(*) - 1) AS s12 FROM sl GROUP BY ALL),
t AS (SELECT site_code, collection_period, lowest_taxon, sum(density) AS x FROM survey WHERE density > 0 GROUP BY ALL),
d AS (SELECT site_code, collection_period, lowest_taxon, sqrt(x / sum(x) OVER (PARTITION BY site_code, collection_period)) AS hell FROM t),
g AS (SELECT sl.slice, lowest_taxon, sum(hell * (x1 - m1)) AS g1, sum(hell * (x2 - m2)) AS g2, sum(hell * hell) AS ss, sum(hell) AS s
  FROM sl JOIN mo ON mo.slice = sl.slice JOIN d USING (site_code, collection_period) GROUP BY ALL),
mm AS (SELECT g.slice, any_value(n) AS n, sum(g1 * g1) AS a, sum(g1 * g2) AS b, sum(g2 * g2) AS c, sum(ss - s * s / n) AS total FROM g JOIN mo ON mo.slice = g.slice GROUP BY g.slice),
td AS (SELECT mm.slice, mm.n, total, (a * s22 - 2 * b * s12 + c * s11) / (s11 * s22 - s12 * s12) AS tr, (a * c - b * b) / (s11 * s22 - s12 * s12) AS det FROM mm JOIN mo ON mo.slice = mm.slice),
ev AS (SELECT slice, n, total, tr, 1::BIGINT AS axis, (tr + sqrt(tr * tr - 4 * det)) / 2 AS v FROM td UNION ALL SELECT slice, n, total, tr, 2, (tr - sqrt(tr * tr - 4 * det)) / 2 FROM td)
SELECT slice, axis, {r('v / (n - 1)')} AS eigenvalue, {r('v / total')} AS variation_explained, {r('v / tr')} AS constrained_share, n::BIGINT AS n FROM ev""")
def m10b(spark, sf):
    community, env = rda_inputs(spark, sf)
    return tidy(O.rda_axes_by(community, sliced(env), ["x1", "x2"], "density", KEYS, "slice"))


# --- regression --------------------------------------------------------------------------------

def _ols(y: str, x: str) -> str:
    return (f"regr_slope({y}, {x}) AS slope, regr_intercept({y}, {x}) AS intercept, regr_r2({y}, {x}) AS r2, regr_count({y}, {x}) AS nobs")


OLS_OUT = f"""{r('slope')} AS slope, {r('r2')} AS r2, {r('r2 * (nobs - 2) / (1 - r2)')} AS f_stat, nobs::BIGINT AS nobs"""
LONG = " UNION ALL ".join(f"SELECT site_code, season, annualrain, '{o}' AS outcome, {o} AS y FROM outcomes" for o in OUT)


@query("m11_season_ols", ("outcomes",), f"""
SELECT season, outcome, {OLS_OUT} FROM (SELECT season, outcome, {_ols('y', 'annualrain')} FROM ({LONG}) GROUP BY ALL)""")
def m11(spark, sf):
    fit = R.outcome_by_predictor_ols(V.outcomes(spark, sf), ["season"], OUT, ["annualrain"])
    return tidy(fit.select("season", "outcome", "slope", "r2", "f_stat", "nobs"))


@query("m12_composition_ols", ("survey", "site_dim"), f"""
WITH c AS (SELECT site_code, collection_period, CASE WHEN family IN ('ECONOMY', 'PROMO') THEN family ELSE 'Other' END AS family, sum(density) AS v FROM survey GROUP BY ALL),
p AS (SELECT *, 100.0 * v / sum(v) OVER (PARTITION BY site_code, collection_period) AS percent FROM c),
s AS (SELECT p.*, annualrain, CASE WHEN month(collection_period) IN (11, 12, 1, 2, 3) THEN 'Winter' WHEN month(collection_period) IN (4, 5, 6) THEN 'Spring'
  WHEN month(collection_period) IN (7, 8) THEN 'Summer' ELSE 'Fall' END AS season FROM p JOIN site_dim USING (site_code) WHERE family <> 'Other')
SELECT season, family, {OLS_OUT} FROM (SELECT season, family, {_ols('percent', 'annualrain')} FROM s GROUP BY ALL)""")
def m12(spark, sf):
    c = composition_percent(V.survey(spark, sf), KEYS, "family", "density", ["ECONOMY", "PROMO"]).filter(F.col("family") != "Other")
    c = attach(seasonal(c), V.site_dim(spark, sf).select("site_code", "annualrain"))
    return tidy(R.simple_ols(c, ["season", "family"], "annualrain", "percent").select("season", "family", "slope", "r2", "f_stat", "nobs"))


@query("m13_site_slopes", ("outcomes", "env", "site_dim"), f"""
WITH {FRAME_CTE}, l AS ({' UNION ALL '.join(f"SELECT site_code, annualrain, '{o}' AS outcome, '{p}' AS predictor, {o} AS y, {p} AS x FROM frame" for o in OUT for p in ('x1', 'x3'))}),
s AS (SELECT site_code, annualrain, outcome, predictor, regr_slope(y, x) AS b FROM l GROUP BY ALL)
SELECT outcome, predictor, {r('slope', 9)} AS slope, {r('r2')} AS r2, {r('r2 * (nobs - 2) / (1 - r2)')} AS f_stat, nobs::BIGINT AS nobs
FROM (SELECT outcome, predictor, {_ols('b', 'annualrain')} FROM s GROUP BY ALL)""")
def m13(spark, sf):
    first = R.outcome_by_predictor_ols(frame(spark, sf), ["site_code"], OUT, ["x1", "x3"]).select(
        "site_code", "outcome", "predictor", F.col("slope").alias("b"))
    first = natural_join(first, V.site_dim(spark, sf).select("site_code", "annualrain"), "left", ["site_code"])
    out = R.simple_ols(first, ["outcome", "predictor"], "annualrain", "b")
    return tidy(out.select("outcome", "predictor", "slope", "r2", "f_stat", "nobs"), 6, slope=9)


@query("m14_multiple_ols", ("outcomes", "env"), f"""
WITH {FRAME_CTE}, m AS (SELECT season, count(*) AS n, covar_samp(x1, x1) AS s11, covar_samp(x1, x3) AS s12, covar_samp(x3, x3) AS s22,
  covar_samp(x1, density) AS s1y, covar_samp(x3, density) AS s2y, covar_samp(density, density) AS syy FROM frame GROUP BY ALL),
b AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM m),
e AS (SELECT *, (syy - b1 * s1y - b2 * s2y) * (n - 1) / (n - 3) AS v FROM b)
SELECT season, 'x1' AS term, {r('b1', 3)} AS estimate, {r('sqrt(v * s22 / (s11 * s22 - s12 * s12) / (n - 1))', 3)} AS std_error,
  {r('(b1 * s1y + b2 * s2y) / syy')} AS r2, n::BIGINT AS nobs FROM e
UNION ALL SELECT season, 'x3', {r('b2', 3)}, {r('sqrt(v * s11 / (s11 * s22 - s12 * s12) / (n - 1))', 3)}, {r('(b1 * s1y + b2 * s2y) / syy')}, n::BIGINT FROM e""")
def m14(spark, sf):
    fit = R.multiple_ols(frame(spark, sf), ["season"], ["x1", "x3"], "density").filter(F.col("term") != "(Intercept)")
    return tidy(fit.select("season", "term", "estimate", "std_error", "r2", "nobs"), 3, r2=6)


@query("m15_quadratic_by_year", ("totals",), f"""
WITH u AS (SELECT year(collection_period) AS year, density AS y, dayofyear(collection_period) - avg(dayofyear(collection_period)) OVER (PARTITION BY year(collection_period)) AS u FROM totals),
s AS (SELECT year, count(*)::DOUBLE AS n, sum(u) AS s1, sum(u*u) AS s2, sum(u*u*u) AS s3, sum(u*u*u*u) AS s4, sum(y) AS t0, sum(u*y) AS t1, sum(u*u*y) AS t2, regr_slope(y, u) AS b, regr_r2(y, u) AS q FROM u GROUP BY ALL),
d AS (SELECT *, n*(s2*s4-s3*s3) - s1*(s1*s4-s3*s2) + s2*(s1*s3-s2*s2) AS det FROM s)
SELECT year::BIGINT AS year, n::BIGINT AS nobs, {r('(t0*(s2*s4-s3*s3) - s1*(t1*s4-s3*t2) + s2*(t1*s3-s2*t2)) / det', 4)} AS b0,
  {r('(n*(t1*s4-s3*t2) - t0*(s1*s4-s3*s2) + s2*(s1*t2-t1*s2)) / det', 5)} AS b1, {r('(n*(s2*t2-t1*s3) - s1*(s1*t2-t1*s2) + t0*(s1*s3-s2*s2)) / det')} AS b2,
  {r('b', 5)} AS slope_line, {r('q')} AS r2_line FROM d""")
def m15(spark, sf):
    t = V.totals(spark, sf).select(*KEYS, "density").select(
        F.year("collection_period").alias("year"), F.dayofyear("collection_period").cast("double").alias("nday"), "density")
    return tidy(R.quadratic_fit(V.staged(t), ["year"], "nday", "density").drop("x_mu"), 6, b0=4, b1=5, slope_line=5)


# --- tests -------------------------------------------------------------------------------------

TEST_SQL = "collection_period > DATE '1997-06-01' AND collection_period < DATE '1998-09-01'"
ZCTE = f"""z AS ({' UNION ALL '.join(f"SELECT site_code, collection_period, '{m}' AS metric, {m} - avg({m}) OVER (PARTITION BY site_code) AS v FROM outcomes" for m in OUT)})"""


def centred_long(spark, sf):
    o = centred(V.outcomes(spark, sf), ["site_code"], OUT, bounded=True).select(*KEYS, *[F.col(f"z_{c}").alias(c) for c in OUT])
    return o.unpivot(KEYS, OUT, "metric", "v")


@query("m16_welch_vs_baseline", ("outcomes",), f"""
WITH {ZCTE}, b AS (SELECT metric, avg(v) AS mu_b, var_samp(v) AS v_b, count(*) AS n_b FROM z WHERE NOT ({TEST_SQL}) GROUP BY ALL),
x AS (SELECT metric, collection_period, avg(v) AS mu_x, var_samp(v) AS v_x, count(*) AS n_x FROM z WHERE {TEST_SQL} GROUP BY ALL)
SELECT metric, collection_period, {r('(mu_x - mu_b) / sqrt(v_x / n_x + v_b / n_b)')} AS t_stat,
  {r('pow(v_x / n_x + v_b / n_b, 2) / (pow(v_x / n_x, 2) / (n_x - 1) + pow(v_b / n_b, 2) / (n_b - 1))')} AS df, n_x::BIGINT AS n_x, n_b::BIGINT AS n_b
FROM x JOIN b USING (metric)""")
def m16(spark, sf):
    base = flag_window("collection_period", *V.TEST, "none") == "baseline"
    out = T.welch_vs_baseline(V.staged(centred_long(spark, sf)), ["metric"], "collection_period", "v", base)
    return tidy(out.select("metric", "collection_period", "t_stat", "df", "n_x", "n_b"))


@query("m16b_welch_p_values")
def m16b(spark, sf):
    """The p-values of m16 and the flag that holds over all its tests."""
    base = flag_window("collection_period", *V.TEST, "none") == "baseline"
    out = T.welch_vs_baseline(V.staged(centred_long(spark, sf)), ["metric"], "collection_period", "v", base)
    out = out.withColumn("p_value", t_two_sided_p("t_stat", "df"))
    return tidy(T.flag_significant(out).select("metric", "collection_period", "t_stat", "df", "p_value", "significant"))


@query("m17_sidak_flag", sql=f"""
SELECT l_suppkey, {r('p', 7)} AS p_value, CASE WHEN p < 1 - pow(0.95::DOUBLE, 1 / 6.0::DOUBLE) THEN 'yes' ELSE 'no' END AS significant
FROM (SELECT l_suppkey, avg(l_discount) / 6 AS p FROM lineitem GROUP BY ALL)""")
def m17(spark, sf):
    p = table(spark, sf, "lineitem").groupBy("l_suppkey").agg((F.avg("l_discount") / 6).alias("p_value"))
    return tidy(T.flag_significant(p), 7)


@query("m17b_sidak_of_welch")
def m17b(spark, sf):
    """The p-values of m16 by metric side by side, each flagged against the threshold over the periods of its metric."""
    base = flag_window("collection_period", *V.TEST, "none") == "baseline"
    out = T.welch_vs_baseline(V.staged(centred_long(spark, sf)), ["metric"], "collection_period", "v", base)
    out = out.withColumn("p_value", t_two_sided_p("t_stat", "df")).select("metric", "collection_period", "p_value")
    wide = out.groupBy("collection_period").pivot("metric", OUT).agg(F.first("p_value"))
    long = wide.unpivot(["collection_period"], OUT, "metric", "p_value").where("p_value IS NOT NULL")
    return tidy(T.flag_significant(long), 7)


FAMILY_Z = """f AS (SELECT family, site_code, collection_period, ln(sum(density)) AS v FROM survey GROUP BY ALL),
z AS (SELECT family, CASE WHEN month(collection_period) IN (11, 12, 1, 2, 3) THEN 'Winter' WHEN month(collection_period) IN (4, 5, 6) THEN 'Spring'
  WHEN month(collection_period) IN (7, 8) THEN 'Summer' ELSE 'Fall' END AS season,
  (v - avg(v) OVER (PARTITION BY family, site_code)) / nullif(stddev_samp(v) OVER (PARTITION BY family, site_code), 0) AS z FROM f),
g AS (SELECT family, season, avg(z) AS mu, count(z) AS n, var_pop(z) AS v FROM z GROUP BY ALL),
a AS (SELECT family, count(*) AS k, sum(n) AS nobs, sum(n * v) AS ssw, sum(n * mu * mu) - pow(sum(n * mu), 2) / sum(n) AS ssb FROM g GROUP BY ALL)"""


def family_z(spark, sf):
    t = V.survey(spark, sf).groupBy("family", *KEYS).agg(F.sum("density").alias("d"))
    t = t.withColumn("v", ln_pos("d"))
    return seasonal(z_scores(t, ["family", "site_code"], ["v"], "_z", bounded=True)).withColumnRenamed("v_z", "z")


@query("m18_anova", ("survey",), f"""
WITH {FAMILY_Z} SELECT family, {r('ssb')} AS ss_between, {r('ssw')} AS ss_within, (k - 1)::BIGINT AS df_between, (nobs - k)::BIGINT AS df_within,
  {r('ssb / (k - 1) / (ssw / (nobs - k))')} AS f_stat FROM a""")
def m18(spark, sf):
    out = T.anova(family_z(spark, sf), ["family"], "season", "z")
    return tidy(out.select("family", "ss_between", "ss_within", "df_between", "df_within", "f_stat"))


@query("m18b_anova_p_values")
def m18b(spark, sf):
    out = T.anova(family_z(spark, sf), ["family"], "season", "z")
    p = f_upper_p("f_stat", F.col("df_between").cast("double"), F.col("df_within").cast("double"))
    return tidy(out.select("family", "f_stat", "df_between", "df_within", p.alias("p_value")))


@query("m19b_tukey_p_values")
def m19b(spark, sf):
    out = T.tukey_pairs(V.staged(family_z(spark, sf)), ["family"], "season", "z")
    p = studentized_range_p("q_stat", F.col("groups").cast("double"), F.col("df_within").cast("double"))
    return tidy(out.select("family", "group_a", "group_b", "diff", "q_stat", p.alias("p_value")))


@query("m20b_rank_sum_p_values")
def m20b(spark, sf):
    out = T.rank_sum_vs(V.staged(family_z(spark, sf)), ["family"], "season", "z", "Winter", ["Spring", "Summer", "Fall"])
    return tidy(out.select("family", "versus", "u_stat", "z_stat", normal_two_sided_p("z_stat").alias("p_value")))


@query("m19_tukey_pairs", ("survey",), f"""
WITH {FAMILY_Z} SELECT x.family, x.season AS group_a, y.season AS group_b, {r('y.mu - x.mu')} AS diff,
  {r('abs(y.mu - x.mu) / sqrt(ssw / (nobs - k) / 2 * (1.0 / x.n + 1.0 / y.n))')} AS q_stat, k::BIGINT AS groups, (nobs - k)::BIGINT AS df_within
FROM g x JOIN g y ON x.family = y.family AND x.season < y.season JOIN a ON a.family = x.family""")
def m19(spark, sf):
    return tidy(T.tukey_pairs(V.staged(family_z(spark, sf)), ["family"], "season", "z"))


@query("m20_rank_sum", ("survey",), f"""
WITH {FAMILY_Z}, p AS (SELECT family, o AS versus, season = 'Winter' AS is_ref, z FROM z JOIN (SELECT unnest(['Spring', 'Summer', 'Fall']) AS o)
   ON season = 'Winter' OR season = o WHERE z IS NOT NULL),
k AS (SELECT *, rank() OVER (PARTITION BY family, versus ORDER BY z) + (count(*) OVER (PARTITION BY family, versus, z) - 1) / 2.0 AS rk,
        count(*) OVER (PARTITION BY family, versus, z) AS ties FROM p),
s AS (SELECT family, versus, count(*) AS n, count(*) FILTER (WHERE is_ref) AS n1, sum(rk) FILTER (WHERE is_ref) AS rs, sum(ties * ties - 1.0) AS tie FROM k GROUP BY ALL),
u AS (SELECT *, rs - n1 * (n1 + 1) / 2.0 AS u FROM s)
SELECT family, versus, n1::BIGINT AS n_ref, (n - n1)::BIGINT AS n_versus, {r('u', 2)} AS u_stat,
  {r('(u - n1 * (n - n1) / 2.0 - sign(u - n1 * (n - n1) / 2.0) * 0.5) / sqrt(n1 * (n - n1) / 12.0 * (n + 1 - tie / (n * (n - 1.0))))')} AS z_stat FROM u""")
def m20(spark, sf):
    out = T.rank_sum_vs(V.staged(family_z(spark, sf)), ["family"], "season", "z", "Winter", ["Spring", "Summer", "Fall"])
    return tidy(out, 6, u_stat=2)


def _poly(coefs, x: str) -> str:
    out = repr(coefs[0])
    for c in coefs[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def _quantile_sql(p: str) -> str:
    tail = f"(CASE WHEN {p} < 0.5 THEN {p} ELSE 1 - {p} END)"
    q = f"sqrt(-2.0 * ln({tail}))"
    outer = f"({_poly(QUANTILE_C, q)} / ({_poly(QUANTILE_D, q)} * {q} + 1.0))"
    c = f"({p} - 0.5)"
    inner = f"({_poly(QUANTILE_A, f'({c} * {c})')} * {c} / ({_poly(QUANTILE_B, f'({c} * {c})')} * ({c} * {c}) + 1.0))"
    text = f"CASE WHEN {p} < {QUANTILE_LOW} THEN {outer} WHEN {p} > 1 - {QUANTILE_LOW} THEN -{outer} ELSE {inner} END"
    import re
    return re.sub(r"(?<![\w.])(\d+\.\d+(?:e[-+]?\d+)?|\d+e[-+]?\d+)(?![\w.])", r"\1::DOUBLE", text)


RES = """fit AS (SELECT season, regr_slope(density, annualrain) AS b, regr_intercept(density, annualrain) AS a FROM outcomes GROUP BY ALL),
e AS (SELECT o.season, density - a - b * annualrain AS e FROM outcomes o JOIN fit USING (season)),
k AS (SELECT *, (row_number() OVER (PARTITION BY season ORDER BY e) - 0.375::DOUBLE) / (count(*) OVER (PARTITION BY season) + 0.25::DOUBLE) AS p FROM e),
s AS (SELECT season, e, __Q__ AS m FROM k)""".replace("__Q__", _quantile_sql("p"))


def season_residuals(spark, sf):
    o = V.outcomes(spark, sf).select("season", "annualrain", "density")
    fit = R.simple_ols(o, ["season"], "annualrain", "density").select("season", "slope", "intercept")
    return natural_join(o, fit, "left", ["season"]).select(
        "season", (F.col("density") - F.col("intercept") - F.col("slope") * F.col("annualrain")).alias("e"))


@query("m21_residual_normality", ("outcomes",), f"""
WITH {RES} SELECT season, count(*)::BIGINT AS nobs, {r('corr(e, m) * corr(e, m)')} AS w_stat FROM s GROUP BY ALL""")
def m21(spark, sf):
    return tidy(T.shapiro_francia(V.staged(season_residuals(spark, sf)), ["season"], "e").select("season", "nobs", "w_stat"))


@query("m22_qq_points", ("outcomes",), f"WITH {RES} SELECT season, {r('e', 4)} AS sample, {r('m', 5)} AS theoretical FROM s")
def m22(spark, sf):
    out = T.normal_scores(V.staged(season_residuals(spark, sf)), ["season"], "e")
    return tidy(out.select("season", F.col("e").alias("sample"), F.col("score").alias("theoretical")), 5, sample=4)


@query("m23_stepwise_aic")
def m23(spark, sf):
    f = stage(frame(spark, sf), scratch(spark, "frame"))
    found = R.stepwise_aic(f, "density", ["annualrain", "x1", "x2", "x3", "shannon", "simpson"])
    rows = [(i, action, name, float(aic)) for i, (action, name, aic) in enumerate(found["trail"])]
    return tidy(spark.createDataFrame(rows, "step int, action string, variable string, aic double"))


# --- mixed models ------------------------------------------------------------------------------

MODELS = ["outcome", "predictor"]


def mixed_rows(spark, sf, predictors=("x1", "x3")):
    f = frame(spark, sf).withColumns({"density": ln_pos("density"), "biomass": ln_pos("biomass")})
    rows = M.outcome_predictor_rows(f.withColumn("t", F.unix_date("collection_period")), ["site_code", "t", "annualrain"],
                                    ["density", "biomass"], list(predictors))
    return stage(rows.withColumn("x_rain", F.col("x") * F.col("annualrain") / 1000.0), scratch(spark, "mixed"))


@query("m24_random_intercept")
def m24(spark, sf):
    fit = M.fit_mixed(mixed_rows(spark, sf), MODELS, "site_code", "t", ["x"], "y", ar1=True)
    return tidy(natural_join(fit.coefficients, fit.summary, "left", MODELS), 4)


@query("m24b_mixed_residuals")
def m24b(spark, sf):
    rows = mixed_rows(spark, sf)
    fit = M.fit_mixed(rows, MODELS, "site_code", "t", ["x"], "y", ar1=True)
    out = M.residuals(rows, fit, MODELS, "site_code", ["x"], "y")
    return tidy(out.select(*MODELS, "site_code", "t", "fitted", "residual"), 4)


@query("m25_random_intercept_interaction")
def m25(spark, sf):
    fit = M.fit_mixed(mixed_rows(spark, sf), MODELS, "site_code", "t", ["x", "annualrain", "x_rain"], "y", ar1=True)
    return tidy(natural_join(fit.coefficients, fit.summary, "left", MODELS), 4)


@query("m26_random_slope")
def m26(spark, sf):
    fit = M.fit_mixed(mixed_rows(spark, sf), MODELS, "site_code", "t", ["x"], "y", slope="x", ar1=True)
    return tidy(fit.effects, 4)


@query("m27_second_stage_slopes")
def m27(spark, sf):
    fit = M.fit_mixed(mixed_rows(spark, sf), MODELS, "site_code", "t", ["x"], "y", slope="x", ar1=True)
    slopes = natural_join(fit.effects, V.site_dim(spark, sf).select("site_code", "annualrain"), "left", ["site_code"])
    return tidy(R.simple_ols(slopes, MODELS, "annualrain", "slope").select(*MODELS, "slope", "r2", "f_stat", "nobs"))


@query("m28_model_table")
def m28(spark, sf):
    rows = mixed_rows(spark, sf)
    return tidy(M.model_table(M.fit_mixed(rows, MODELS, "site_code", "t", ["x"], "y", ar1=True), MODELS, "x"), 4)


# --- path models -------------------------------------------------------------------------------

PATH = ["magnitude ~ rain", "duration ~ rain + magnitude", "OUTCOME ~ magnitude + duration + annualrain"]


def path_rows(spark, sf):
    o = log_ratio_to_mean(frame(spark, sf), ["site_code"], ["density", "biomass"], bounded=True)
    o = o.select("site_code", F.when(F.col("x3") > 25.5, "flood").otherwise("drought").alias("event"),
                 F.col("x1").alias("rain"), F.col("x2").alias("magnitude"), F.col("x3").alias("duration"),
                 (F.col("annualrain") / 1000.0).alias("annualrain"), "LRR_density", "LRR_biomass")
    return stage(o, scratch(spark, "path"))


PR = f"""WITH {FRAME_CTE}, pr AS (SELECT CASE WHEN x3 > 25.5 THEN 'flood' ELSE 'drought' END AS event, x1 AS rain, x2 AS mag, x3 AS dur, annualrain / 1000.0 AS ar,
  ln(density / avg(density) OVER (PARTITION BY site_code)) AS LRR_density, ln(biomass / avg(biomass) OVER (PARTITION BY site_code)) AS LRR_biomass FROM frame),
po AS (SELECT event, rain, mag, dur, ar, 'LRR_density' AS outcome, LRR_density AS y FROM pr UNION ALL SELECT event, rain, mag, dur, ar, 'LRR_biomass', LRR_biomass FROM pr),
c AS (SELECT event, outcome, {', '.join(f'covar_samp({a}, {b}) AS {a}_{b}' for a, b in itertools.combinations_with_replacement(['rain', 'mag', 'dur', 'ar', 'y'], 2))} FROM po GROUP BY ALL)"""
DET3 = "(mag_mag * (dur_dur * ar_ar - dur_ar * dur_ar) - mag_dur * (mag_dur * ar_ar - dur_ar * mag_ar) + mag_ar * (mag_dur * dur_ar - dur_dur * mag_ar))"
N1 = "(mag_y * (dur_dur * ar_ar - dur_ar * dur_ar) - mag_dur * (dur_y * ar_ar - dur_ar * ar_y) + mag_ar * (dur_y * dur_ar - dur_dur * ar_y))"
N2 = "(mag_mag * (dur_y * ar_ar - dur_ar * ar_y) - mag_y * (mag_dur * ar_ar - dur_ar * mag_ar) + mag_ar * (mag_dur * ar_y - dur_y * mag_ar))"
N3 = "(mag_mag * (dur_dur * ar_y - dur_y * dur_ar) - mag_dur * (mag_dur * ar_y - dur_y * mag_ar) + mag_y * (mag_dur * dur_ar - dur_dur * mag_ar))"
D2 = "(rain_rain * mag_mag - rain_mag * rain_mag)"
PATH_TERMS = [
    ("'magnitude'", "rain", "rain_mag / rain_rain", "rain_rain / mag_mag"),
    ("'duration'", "rain", f"(rain_dur * mag_mag - mag_dur * rain_mag) / {D2}", "rain_rain / dur_dur"),
    ("'duration'", "magnitude", f"(mag_dur * rain_rain - rain_dur * rain_mag) / {D2}", "mag_mag / dur_dur"),
    ("outcome", "magnitude", f"{N1} / {DET3}", "mag_mag / y_y"), ("outcome", "duration", f"{N2} / {DET3}", "dur_dur / y_y"),
    ("outcome", "annualrain", f"{N3} / {DET3}", "ar_ar / y_y")]


@query("m29_path_model", ("outcomes", "env"), PR + " UNION ALL ".join(
    f" SELECT event, outcome, {resp} AS response, '{pred}' AS predictor, {r(est, 4)} AS estimate, {r(f'({est}) * sqrt({sd})')} AS std_estimate FROM c"
    for resp, pred, est, sd in PATH_TERMS))
def m29(spark, sf):
    params, _ = P.path_models(path_rows(spark, sf), ["LRR_density", "LRR_biomass"], PATH, ["event"])
    return tidy(params.drop("nobs"), 6, estimate=4)


@query("m30_path_fit_indices")
def m30(spark, sf):
    _, fits = P.path_models(path_rows(spark, sf), ["LRR_density", "LRR_biomass"], PATH, ["event"])
    return tidy(fits)


#: A model without a direct way from habitat to the outcome, which the made surveys bear out.
SIZE_PATH = ["richness ~ habitat", "biomass ~ richness + habitat", "OUTCOME ~ biomass + richness"]


@query("m31_path_parameter_table")
def m31(spark, sf):
    """Parameters of the well-fitting models after floods beside those after droughts."""
    rows = frame(spark, sf).select(F.when(F.col("x3") > 25.5, "flood").otherwise("drought").alias("event"), F.col("x2").alias("habitat"),
                                   "richness", (F.col("biomass") / 1000.0).alias("biomass"), "density", "shannon")
    params, fits = P.path_models(stage(rows, scratch(spark, "path")), ["density", "shannon"], SIZE_PATH, ["event"])
    fits = fits.withColumn("model_fit", P.fit_label())
    return tidy(P.compare_sets(params, fits, "event", {"flood": "f", "drought": "d"}, {}), 4)


# --- smoothing and distributions ---------------------------------------------------------------

LOESS_DET = "(s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2))"


@query("m32_local_regression", ("survey",), f"""
WITH f AS (SELECT family, date_diff('day', DATE '1970-01-01', collection_period)::DOUBLE AS x, sum(density) AS y FROM survey GROUP BY ALL),
b AS (SELECT family, min(x) AS lo, max(x) AS hi, floor(count(*) * 0.5::DOUBLE + 1e-9)::BIGINT AS near FROM f GROUP BY ALL),
pts AS (SELECT family, near, lo + (hi - lo) * i / 39.0::DOUBLE AS x0, i FROM b CROSS JOIN (SELECT unnest(range(0, 40)) AS i)),
d AS (SELECT pts.family, pts.i, pts.x0, pts.near, f.x, f.y, abs(f.x - pts.x0) AS d, row_number() OVER (PARTITION BY pts.family, pts.i ORDER BY abs(f.x - pts.x0)) AS k
      FROM pts JOIN f ON f.family = pts.family),
h AS (SELECT family, i, max(d) FILTER (WHERE k = near) AS reach FROM d GROUP BY ALL),
w AS (SELECT d.*, (d.x - d.x0) / reach AS u, pow(greatest(1 - pow(d.d / reach, 3), 0), 3) AS w FROM d JOIN h ON h.family = d.family AND h.i = d.i),
s AS (SELECT family, x0, sum(w) AS s0, sum(w*u) AS s1, sum(w*u*u) AS s2, sum(w*u*u*u) AS s3, sum(w*u*u*u*u) AS s4, sum(w*y) AS t0, sum(w*u*y) AS t1, sum(w*u*u*y) AS t2 FROM w GROUP BY ALL)
SELECT family, {r('x0', 4)} AS x, {r(f'(t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / {LOESS_DET}', 3)} AS fitted FROM s""")
def m32(spark, sf):
    t = V.survey(spark, sf).groupBy("family", "collection_period").agg(F.sum("density").alias("y"))
    return tidy(S.loess(t, ["family"], "collection_period", "y", span=0.5, points=40), 3, x=4)


@query("m33_trend_labels")
def m33(spark, sf):
    fit = R.outcome_by_predictor_ols(V.outcomes(spark, sf), ["season"], OUT, ["annualrain"])
    fit = fit.withColumn("p_value", f_upper_p("f_stat", F.lit(1.0), (F.col("nobs") - 2).cast("double")))
    return tidy(R.label_trend(fit).select("season", "outcome", "slope", "r2", "p_value", "draw"))


@query("m33b_trend_by_fit", ("outcomes",), f"""
SELECT season, outcome, {r('slope')} AS slope, {r('r2')} AS r2, nobs::BIGINT AS nobs, r2 > 0.005 AS draw
FROM (SELECT season, outcome, {_ols('y', 'annualrain')} FROM ({LONG}) GROUP BY ALL)""")
def m33b(spark, sf):
    # the share-of-variance half of the rule, with a cut-off inside the range of the made data
    fit = R.outcome_by_predictor_ols(V.outcomes(spark, sf), ["season"], OUT, ["annualrain"]).withColumn("p_value", F.lit(1.0))
    return tidy(R.label_trend(fit, r2_min=0.005).select("season", "outcome", "slope", "r2", "nobs", "draw"))


@query("m34_histogram", ("vectors",), " UNION ALL ".join(f"""
SELECT '{c}' AS variable, least(floor(({c} - lo) / ((hi - lo) / 30.0::DOUBLE)), 29)::BIGINT AS bin, count(*)::BIGINT AS n
FROM vectors, (SELECT min({c}) AS lo, max({c}) AS hi FROM vectors) GROUP BY ALL""" for c in VC))
def m34(spark, sf):
    return tidy(S.histogram(V.vectors(spark, sf), VC, 30))


@query("m35_kernel_density", ("vectors",), f"""
WITH s AS (SELECT label, min(x1) AS lo, max(x1) AS hi, count(*) AS n, 0.9::DOUBLE * least(stddev_samp(x1), (quantile_cont(x1, 0.75) - quantile_cont(x1, 0.25)) / 1.34::DOUBLE)
    * pow(count(*), -0.2::DOUBLE) AS bw FROM vectors GROUP BY ALL),
g AS (SELECT label, n, bw, i, lo - 3 * bw + (hi + 3 * bw - (lo - 3 * bw)) * i / 63.0::DOUBLE AS x FROM s CROSS JOIN (SELECT unnest(range(0, 64)) AS i))
SELECT g.label::BIGINT AS label, g.i::BIGINT AS point, {r('g.x')} AS x, {r('sum(exp(-0.5::DOUBLE * pow((g.x - v.x1) / g.bw, 2))) / (g.n * g.bw * sqrt(2 * pi()))')} AS density
FROM g JOIN vectors v ON v.label = g.label GROUP BY g.label, g.i, g.x, g.n, g.bw""")
def m35(spark, sf):
    return tidy(S.kernel_density(V.vectors(spark, sf), ["label"], "x1"))


@query("m36_box_stats", ("individual",), f"""
WITH q AS (SELECT family, quantile_cont(lengthmm, 0.25) AS lo, median(lengthmm) AS me, quantile_cont(lengthmm, 0.75) AS hi FROM individual GROUP BY ALL)
SELECT i.family, {r('lo', 4)} AS lower, {r('me', 4)} AS middle, {r('hi', 4)} AS upper,
  {r('min(lengthmm) FILTER (WHERE lengthmm >= lo - 1.5 * (hi - lo))', 4)} AS whisker_low, {r('max(lengthmm) FILTER (WHERE lengthmm <= hi + 1.5 * (hi - lo))', 4)} AS whisker_high,
  count(*) FILTER (WHERE lengthmm < lo - 1.5 * (hi - lo) OR lengthmm > hi + 1.5 * (hi - lo))::BIGINT AS outliers, count(*)::BIGINT AS nobs
FROM individual i JOIN q USING (family) GROUP BY i.family, lo, me, hi""")
def m36(spark, sf):
    return tidy(S.box_stats(V.staged(V.individual(spark, sf).select("family", "lengthmm")), ["family"], "lengthmm"), 4)


@query("m37_convex_hull", ("vectors",), f"""
SELECT DISTINCT a.label::BIGINT AS label, {r('a.x1')} AS x, {r('a.x2')} AS y FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id
WHERE NOT EXISTS (SELECT 1 FROM vectors c WHERE c.label = a.label AND (b.x1 - a.x1) * (c.x2 - a.x2) - (b.x2 - a.x2) * (c.x1 - a.x1) < 0)""")
def m37(spark, sf):
    return tidy(S.convex_hull(V.vectors(spark, sf), ["label"], "x1", "x2").drop("corner"))


@query("m38_observed_minus_expected", ("outcomes", "flow"), f"""
WITH f AS (SELECT regr_slope(ln(density), annualrain) AS b, regr_intercept(ln(density), annualrain) AS a FROM outcomes WHERE NOT ({TEST_SQL})),
e AS (SELECT site_code AS site_group, max(q) FILTER (WHERE d >= DATE '1997-08-27' AND d < DATE '1997-08-27' + 28) / median(q) AS flood_ratio FROM flow GROUP BY ALL)
SELECT site_code, collection_period, {r('a + b * annualrain', 5)} AS prediction, {r('ln(density) - a - b * annualrain', 5)} AS residual, {r('ln(flood_ratio)', 5)} AS ln_flood_ratio
FROM outcomes o LEFT JOIN e ON e.site_group IS NOT DISTINCT FROM o.site_group, f""")
def m38(spark, sf):
    from pyspark.ml.feature import VectorAssembler

    from siteseries.models import engines, features, search

    o = stage(V.outcomes(spark, sf).withColumn("ln_density", ln_pos("density")), scratch(spark, "outcomes"))
    wf = features.workflow([VectorAssembler(inputCols=["annualrain"], outputCol="features")], engines.elastic_net("ln_density", 0.0, 0.0))
    base = flag_window("collection_period", *V.TEST, "none") == "baseline"
    # the flood of the event: the largest flow of the four weeks from its day on, over the median of the series
    near = F.col("d").between(F.lit("1997-08-27").cast("date"), F.date_add(F.lit("1997-08-27").cast("date"), 27))
    events = V.flow(spark, sf).groupBy(F.col("site_code").alias("site_group")).agg(
        ratio(F.max(F.when(near, F.col("q"))), F.median("q")).alias("flood_ratio"))
    out = search.observed_minus_expected(o, wf, "ln_density", base, events, ("flood_ratio",))
    return tidy(out.select(*KEYS, "prediction", "residual", "ln_flood_ratio"), 5)
