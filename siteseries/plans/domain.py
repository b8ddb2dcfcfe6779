"""Diversity, rarity, response-ratio and table-assembly queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteseries.operators import assembly, baseline as B, diversity as Dv, fill, flow as W, joins as J, rarity, reshape, scaling as Z
from siteseries.plans import views as V
from siteseries.plans.registry import query, r, tidy

KEYS = ["site_code", "collection_period"]
TEST_SQL = "collection_period > DATE '1997-06-01' AND collection_period < DATE '1998-09-01'"


@query("b1_pseudo_abundance", ("survey",), """
SELECT site_code, collection_period, lowest_taxon, ceil(density / 7.0 * 1000)::BIGINT AS pseudo_abun FROM survey""")
def b1(spark, sf):
    s = V.survey(spark, sf).withColumn("density", F.col("density") / 7.0)
    return Dv.pseudo_abundance(s, "density").select(*KEYS, "lowest_taxon", "pseudo_abun")


@query("b2_hill_numbers", ("hill",), f"""
SELECT site_code, collection_period, richness::BIGINT AS richness, {r('shannon')} AS shannon, {r('simpson')} AS simpson FROM hill""")
def b2(spark, sf):
    return tidy(Dv.hill_numbers(V.survey(spark, sf), "density"))


@query("b3_averaged_regressions", ("outcomes", "site_dim"), f"""
WITH f1 AS (SELECT {', '.join(f"regr_slope({y}, annualrain) AS {y}_s, regr_intercept({y}, annualrain) AS {y}_i" for y in ('richness', 'shannon', 'simpson'))}
            FROM outcomes WHERE collection_period < DATE '1996-01-01'),
f2 AS (SELECT {', '.join(f"regr_slope({y}, annualrain) AS {y}_s, regr_intercept({y}, annualrain) AS {y}_i" for y in ('richness', 'shannon', 'simpson'))}
       FROM outcomes WHERE collection_period >= DATE '2000-01-01')
SELECT site_code, ceil((f1.richness_i + f1.richness_s * annualrain + 2 * (f2.richness_i + f2.richness_s * annualrain)) / 3.0)::DOUBLE + 0.0::DOUBLE AS richness,
  {', '.join(f"{r(f'(f1.{y}_i + f1.{y}_s * annualrain + 2 * (f2.{y}_i + f2.{y}_s * annualrain)) / 3.0')} AS {y}" for y in ('shannon', 'simpson'))}
FROM site_dim, f1, f2""")
def b3(spark, sf):
    o = V.staged(V.outcomes(spark, sf))
    first = o.filter(F.col("collection_period") < F.lit("1996-01-01").cast("date"))
    second = o.filter(F.col("collection_period") >= F.lit("2000-01-01").cast("date"))
    out = Dv.averaged_prediction(V.site_dim(spark, sf).select("site_code", "annualrain"), "annualrain", first, second,
                                 ["richness", "shannon", "simpson"], ["richness"])
    return tidy(out.drop("annualrain"))


@query("b4_fill_period", ("totals", "site_dim"), f"""
SELECT site_code, collection_period, {r('density', 2)} AS density FROM totals WHERE collection_period >= DATE '1997-06-01'
UNION ALL SELECT site_code, DATE '1997-04-01', {r('annualrain / 10', 2)} FROM site_dim WHERE annualrain > 4500""")
def b4(spark, sf):
    actual = V.totals(spark, sf).select(*KEYS, "density").filter(F.col("collection_period") >= F.lit("1997-06-01").cast("date"))
    simulated = V.site_dim(spark, sf).select("site_code", "annualrain", (F.col("annualrain") / 10).alias("density"))
    return tidy(Dv.fill_period(actual, simulated, "collection_period", "1997-04-01", "annualrain", 4500.0), 2)


def _prob(src: str) -> str:
    return f"""n AS (SELECT site_code, count(*) AS k FROM (SELECT DISTINCT site_code, collection_period FROM {src}) GROUP BY ALL),
prob AS (SELECT t.lowest_taxon, n.site_code, coalesce(p.seen, 0) / n.k::DOUBLE AS prob_present
  FROM n CROSS JOIN (SELECT DISTINCT lowest_taxon FROM {src}) t
  LEFT JOIN (SELECT site_code, lowest_taxon, count(*) AS seen FROM {src} WHERE density > 0 GROUP BY ALL) p
    ON p.site_code = n.site_code AND p.lowest_taxon = t.lowest_taxon)"""


@query("b5_occurrence_probability", ("survey",), f"""
WITH {_prob('survey')} SELECT lowest_taxon, site_code, {r('prob_present')} AS prob_present FROM prob""")
def b5(spark, sf):
    return tidy(rarity.occurrence_probability(V.staged(V.survey(spark, sf)), "density"))


@query("b6_only_in_window", ("part_survey",), """
SELECT DISTINCT lowest_taxon, p::BIGINT AS presence FROM (
  SELECT lowest_taxon, date_trunc('quarter', collection_period) AS q, CASE WHEN sum(density) > 0 THEN 1 ELSE 0 END AS p FROM part_survey
  WHERE collection_period > DATE '1995-06-01' AND collection_period < DATE '2001-03-01' GROUP BY ALL)
WHERE lowest_taxon NOT IN (SELECT lowest_taxon FROM part_survey WHERE collection_period < DATE '1995-06-01' OR collection_period > DATE '2001-03-01')""")
def b6(spark, sf):
    # the made taxa are recorded throughout; a wide window leaves some that occur only inside it
    return tidy(rarity.only_in_window(V.staged(V.part_survey(spark, sf)), "density", "1995-06-01", "2001-03-01"))


@query("b7_rare_total", ("survey",), f"""
WITH {_prob('survey')}, rt AS (SELECT lowest_taxon, site_code FROM prob WHERE prob_present > 0 AND prob_present < 0.03),
t AS (SELECT u.site_code, u.collection_period, coalesce(sum(s.density), 0) AS rare_tot
  FROM (SELECT DISTINCT site_code, collection_period FROM survey WHERE site_code IN (SELECT site_code FROM rt)) u
  LEFT JOIN (SELECT r.* FROM survey r SEMI JOIN rt ON rt.site_code = r.site_code AND rt.lowest_taxon = r.lowest_taxon) s
    ON s.site_code = u.site_code AND s.collection_period = u.collection_period GROUP BY ALL)
SELECT site_code, collection_period, {r('rare_tot', 2)} AS rare_tot,
  {r('(rare_tot - avg(rare_tot) OVER w) / nullif(stddev_samp(rare_tot) OVER w, 0)')} AS rare_tot_scaled FROM t WINDOW w AS (PARTITION BY site_code)""")
def b7(spark, sf):
    t = rarity.rare_total(V.staged(V.survey(spark, sf)), "density", below=0.03)
    return tidy(Z.z_scores(t, ["site_code"], ["rare_tot"], bounded=True), 6, rare_tot=2)


def _rr(src: str, keys: str, value: str) -> str:
    """SQL of the response ratio; `keys` are level columns followed by a comma, or empty."""
    on = "".join(f" AND b.{k.strip()} IS NOT DISTINCT FROM s.{k.strip()}" for k in keys.split(",") if k.strip())
    return f"""
s AS (SELECT site_code, quarter(collection_period) AS qtr, collection_period, {keys} {TEST_SQL} AS t, coalesce(sum({value}), 0) AS x FROM {src} GROUP BY ALL),
ba AS (SELECT site_code, {keys} avg(x) AS b_all, stddev_samp(x) AS b_sd FROM s WHERE NOT t GROUP BY ALL),
bq AS (SELECT site_code, qtr, {keys} avg(x) AS b_qtr FROM s WHERE NOT t GROUP BY ALL),
f AS (SELECT s.*, coalesce(b.b_all, 0) AS b_all, b.b_sd, bq.b_qtr, coalesce(bq.b_qtr, b.b_all, 0) AS b_fill FROM s
  LEFT JOIN ba b ON b.site_code = s.site_code {on} LEFT JOIN bq ON bq.site_code = s.site_code AND bq.qtr = s.qtr {on.replace('b.', 'bq.')} WHERE s.t),
rr AS (SELECT *, (x - b_fill) / (b_fill + 0.01::DOUBLE) AS rr_qtr, (x - b_all) / (b_all + 0.01::DOUBLE) AS rr_all FROM f)"""


RR_COLUMNS = f"""site_code, qtr::BIGINT AS qtr, collection_period, 'test' AS is_baseline, {r('x', 3)} AS x, {r('b_all', 3)} AS b_all, {r('b_sd', 3)} AS b_sd,
  {r('b_qtr', 3)} AS b_qtr, {r('b_fill', 3)} AS b_qtr_fill, {r('rr_qtr', 4)} AS rr_qtr, {r('rr_all', 4)} AS rr_all,
  {r('CASE WHEN rr_qtr = 0 THEN -100000 ELSE ln(abs(rr_qtr)) END', 4)} AS lrr_qtr, {r('CASE WHEN rr_all = 0 THEN -100000 ELSE ln(abs(rr_all)) END', 4)} AS lrr_all"""
RR_DIGITS = {c: 3 for c in ("x", "b_all", "b_sd", "b_qtr", "b_qtr_fill")}


@query("b8_response_ratio", ("survey",), f"WITH {_rr('survey', '', 'density')} SELECT {RR_COLUMNS} FROM rr")
def b8(spark, sf):
    return tidy(B.response_ratio(V.survey(spark, sf), "density", None, V.TEST), 4, **RR_DIGITS)


@query("b8b_response_ratio_family", ("survey",), f"WITH {_rr('survey', 'family,', 'density')} SELECT family, {RR_COLUMNS} FROM rr")
def b8b(spark, sf):
    return tidy(B.response_ratio(V.survey(spark, sf), "density", "family", V.TEST), 4, **RR_DIGITS)


LONG_LEVELS = " UNION ALL ".join(
    f"SELECT site_code, collection_period, '{m}' AS metric, '{lv}' AS level, {item} AS item, {m} AS v FROM survey"
    for m in ("density", "biomass") for lv, item in (("lowest_taxon", "lowest_taxon"), ("family", "family"), ("community", "'community'")))
# shares of identical values cancel to exact zeros in one summation order and to rounding noise in another, so log
# ratios of nearly-zero ratios are compared at the level of the ratio itself
B9_SQL = f"""WITH u AS ({LONG_LEVELS}), {_rr('u', 'metric, level, item,', 'v')}
SELECT metric, level, item, site_code, qtr::BIGINT AS qtr, collection_period, {r('x', 3)} AS x, {r('b_fill', 3)} AS b_qtr_fill, {r('rr_qtr', 4)} AS rr_qtr, {r('rr_all', 4)} AS rr_all FROM rr"""


@query("b9_response_ratio_levels", ("survey",), B9_SQL)
def b9(spark, sf):
    out = B.response_ratio_levels(V.staged(V.survey(spark, sf)), ["density", "biomass"], ["lowest_taxon", "family", None], V.TEST)
    return tidy(out.select("metric", "level", "item", "site_code", "qtr", "collection_period", "x", "b_qtr_fill", "rr_qtr", "rr_all"),
                4, x=3, b_qtr_fill=3)


@query("b9b_response_ratio_diversity", ("outcomes",), f"""
WITH u AS ({' UNION ALL '.join(f"SELECT site_code, collection_period, '{m}' AS metric, {m} AS v FROM outcomes" for m in ('richness', 'shannon', 'simpson'))}),
{_rr('u', 'metric,', 'v')} SELECT metric, site_code, collection_period, {r('x', 4)} AS x, {r('b_sd', 4)} AS b_sd, {r('rr_qtr', 4)} AS rr_qtr, {r('rr_all', 4)} AS rr_all FROM rr""")
def b9b(spark, sf):
    out = B.response_ratios(V.outcomes(spark, sf), ["richness", "shannon", "simpson"], None, V.TEST)
    return tidy(out.select("metric", *KEYS, "x", "b_sd", "rr_qtr", "rr_all"), 4)


@query("b10_baseline_band", ("survey",), f"""
WITH {_rr('survey', 'family,', 'density')} SELECT family, site_code, collection_period,
  CASE WHEN x > b_fill + b_sd THEN 'Above' WHEN x < b_fill - b_sd THEN 'Below' WHEN b_sd IS NOT NULL THEN 'Inside' END AS position FROM rr""")
def b10(spark, sf):
    out = B.response_ratio(V.survey(spark, sf), "density", "family", V.TEST)
    return out.select("family", *KEYS, B.band_position().alias("position"))


@query("b11_centroid_distance", ("vectors",), f"""
SELECT vec_id, label::BIGINT AS label, {r('avg(x1) OVER w')} AS mu1, {r('avg(x2) OVER w')} AS mu2,
  {r('sqrt(pow(x1 - avg(x1) OVER w, 2) + pow(x2 - avg(x2) OVER w, 2))')} AS centroid_dist FROM vectors WINDOW w AS (PARTITION BY label)""")
def b11(spark, sf):
    out = B.centroid_distance(V.vectors(spark, sf), ["label"], "x1", "x2")
    return tidy(out.select("vec_id", "label", "mu1", "mu2", "centroid_dist"))


@query("b12_baseline_centroid_distance", ("outcomes",), f"""
WITH c AS (SELECT site_code, avg(shannon) AS m1, avg(simpson) AS m2 FROM outcomes WHERE NOT ({TEST_SQL}) GROUP BY ALL),
u AS (SELECT o.site_code, collection_period, sqrt(pow(shannon - m1, 2) + pow(simpson - m2, 2)) AS v FROM outcomes o JOIN c USING (site_code)),
{_rr('u', '', 'v')} SELECT site_code, collection_period, {r('x', 4)} AS x, {r('b_qtr', 4)} AS b_qtr, {r('rr_qtr', 4)} AS rr_qtr, {r('rr_all', 4)} AS rr_all FROM rr""")
def b12(spark, sf):
    d = B.baseline_centroid_distance(V.outcomes(spark, sf), V.TEST, x="shannon", y="simpson")
    out = B.response_ratio(d, "cdis", None, V.TEST)
    return tidy(out.select(*KEYS, "x", "b_qtr", "rr_qtr", "rr_all"), 4)


@query("b13_hellinger", ("survey",), f"""
SELECT site_code, collection_period, lowest_taxon, {r('sqrt(density / sum(density) OVER (PARTITION BY site_code, collection_period))')} AS hell FROM survey""")
def b13(spark, sf):
    return tidy(Dv.hellinger(V.staged(V.survey(spark, sf)), "density").select(*KEYS, "lowest_taxon", "hell"))


@query("b14_monthly_heat_map", ("survey",), f"""
WITH t AS (SELECT site_code, family, collection_period, sum(density) AS v FROM survey GROUP BY ALL),
l AS (SELECT *, ln(v / avg(v) OVER (PARTITION BY site_code, family)) AS lrr FROM t),
m AS (SELECT site_code, family, month(collection_period) AS month, avg(lrr) AS x FROM l GROUP BY ALL),
g AS (SELECT * FROM (SELECT DISTINCT site_code, family FROM m) CROSS JOIN (SELECT unnest(range(1, 13)) AS month)),
j AS (SELECT g.*, m.x FROM g LEFT JOIN m ON m.site_code = g.site_code AND m.family = g.family AND m.month = g.month)
SELECT site_code, family, month::BIGINT AS month, {r('__FILL__')} AS x FROM j WINDOW w AS (PARTITION BY site_code, family ORDER BY month)""")
def b14(spark, sf):
    t = V.survey(spark, sf).groupBy("site_code", "family", "collection_period").agg(F.sum("density").alias("v"))
    lrr = Z.log_ratio_to_mean(t, ["site_code", "family"], ["v"], bounded=True)
    m = V.staged(lrr.groupBy("site_code", "family", F.month("collection_period").alias("month")).agg(F.avg("LRR_v").alias("x")))
    grid = J.key_grid(m.select("site_code", "family"), "month", F.sequence(F.lit(1), F.lit(12)))
    return tidy(fill.moving_average_fill(J.on_grid(grid, m), ["site_code", "family"], "month", ["x"]))


X3 = ["x1", "x2", "x3"]


@query("b15_model_matrix", ("totals", "env"), f"""
WITH i AS (SELECT site_code, collection_period, {', '.join(f"coalesce({c}, avg({c}) OVER q) AS {c}" for c in X3)} FROM env
  WINDOW q AS (PARTITION BY site_code, quarter(collection_period))),
n AS (SELECT site_code, collection_period, __FILLS__ FROM i WINDOW w AS (PARTITION BY site_code ORDER BY collection_period))
SELECT t.site_code, t.collection_period, {r('t.density', 2)} AS density, quarter(n.collection_period)::BIGINT AS qtr, {', '.join(f"{r(f'n.{c}')} AS {c}" for c in X3)}
FROM totals t LEFT JOIN n ON n.site_code = t.site_code AND n.collection_period = t.collection_period""")
def b15(spark, sf):
    out = assembly.model_matrix(V.totals(spark, sf).select(*KEYS, "density"), V.env(spark, sf), X3)
    return tidy(out, 6, density=2)


@query("b16_predictor_split", ("env", "totals", "site_dim"), f"""
SELECT 'long' AS term, d.site_code, NULL::DATE AS collection_period, {r('d.annualrain')} AS annualrain, {', '.join(f"{r(f'e.{c}')} AS {c}" for c in X3)}, NULL::DOUBLE AS biomass
FROM site_dim d LEFT JOIN (SELECT site_code, avg(x1) AS x1, avg(x2) AS x2, avg(x3) AS x3 FROM env GROUP BY ALL) e USING (site_code)
UNION ALL
SELECT 'short', e.site_code, e.collection_period, NULL, {', '.join(r(f'e.{c}') for c in X3)}, {r('t.biomass', 3)} FROM env e
LEFT JOIN totals t ON t.site_code = e.site_code AND t.collection_period = e.collection_period""")
def b16(spark, sf):
    e = V.staged(V.env(spark, sf))
    sites = V.site_dim(spark, sf).select("site_code", "annualrain", F.lit(1.0).alias("flat"))
    flow = e.groupBy("site_code").agg(F.lit(7.0).alias("q_flat"))
    long = assembly.long_term_predictors(sites, flow, e, X3)
    totals = V.totals(spark, sf).select(*KEYS, "biomass")
    short = assembly.short_term_predictors(e, [totals], KEYS)
    out = long.withColumn("term", F.lit("long")).unionByName(short.withColumn("term", F.lit("short")), allowMissingColumns=True)
    out = out.select("term", *KEYS, "annualrain", *X3, "biomass")
    return tidy(out, 6, biomass=3)


@query("n1_transform_choice", ("totals",), f"""
WITH t AS (SELECT site_code, collection_period, density, biomass, biomass / density AS size FROM totals),
l AS ({' UNION ALL '.join(f"SELECT site_code, collection_period, '{c}' AS xvar, {c} AS v FROM t" for c in ('density', 'biomass', 'size'))}),
m AS (SELECT xvar, max(v) / median(v) AS hi FROM l GROUP BY ALL)
SELECT site_code, collection_period, CASE WHEN hi > 20 THEN 'ln_' WHEN hi > 3 THEN 'sqrt_' ELSE '' END || xvar AS variable,
  {r('CASE WHEN hi > 20 THEN ln(v) WHEN hi > 3 THEN sqrt(v) ELSE v END', 4)} AS v FROM l JOIN m USING (xvar)""")
def n1(spark, sf):
    t = V.totals(spark, sf).withColumn("size", F.col("biomass") / F.col("density"))
    # cut-offs set between the max/median ratios of the made measures, so that each branch is taken
    out = assembly.reduce_skew(V.staged(t), KEYS, ln_above=20.0, sqrt_above=3.0)
    return tidy(reshape.melt(out, KEYS, to=("variable", "v")), 4)


@query("n2_predictor_set", ("flow",), f"""
WITH t AS (SELECT *, max(q) OVER w AS q_max, min(q) OVER w AS q_min FROM flow
           WINDOW w AS (PARTITION BY site_code ORDER BY d RANGE BETWEEN INTERVAL 28 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)),
b AS (SELECT site_code, year(d) AS y, median(q) AS q_base, quantile_cont(q, 0.25) AS q_low FROM flow GROUP BY ALL),
n AS (SELECT f.site_code, f.d, f.q, min(CASE WHEN f.q < 10 * b.q_base THEN f.d END) OVER w AS calm, min(CASE WHEN f.q > b.q_low THEN f.d END) OVER w AS wet
      FROM flow f JOIN b ON b.site_code = f.site_code AND b.y = year(f.d)
      WINDOW w AS (PARTITION BY f.site_code ORDER BY f.d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
p AS (SELECT a.site_code, a.d, x.d AS xd, x.calm, x.wet, row_number() OVER (PARTITION BY a.site_code, a.d ORDER BY x.q DESC, x.d) AS kmax,
             row_number() OVER (PARTITION BY a.site_code, a.d ORDER BY x.q, x.d) AS kmin
      FROM flow a LEFT JOIN n x ON x.site_code = a.site_code AND x.d < a.d AND x.d >= a.d - 28),
u AS (SELECT site_code, d, max(date_diff('day', xd, calm)) FILTER (WHERE kmax = 1)::BIGINT AS flood_duration,
       max(date_diff('day', xd, wet)) FILTER (WHERE kmin = 1)::BIGINT AS drought_duration FROM p GROUP BY ALL)
SELECT t.site_code, t.d, {r('(q_max - q_base) / q_base')} AS flood_magnitude, {r('(q_min - q_base) / q_base')} AS drought_magnitude, u.flood_duration, u.drought_duration
FROM t JOIN b ON b.site_code = t.site_code AND b.y = year(t.d) JOIN u ON u.site_code = t.site_code AND u.d = t.d""")
def n2(spark, sf):
    return tidy(W.predictor_set(V.flow(spark, sf)))


def _finish_sql() -> None:
    """Put the shared moving-average expression into the two queries that use it."""
    from siteseries.plans.registry import SQL
    from siteseries.plans.windows import _ma

    SQL["b14_monthly_heat_map"] = SQL["b14_monthly_heat_map"].replace("__FILL__", _ma("x"))
    SQL["b15_model_matrix"] = SQL["b15_model_matrix"].replace("__FILLS__", ", ".join(f"{_ma(c)} AS {c}" for c in X3))


_finish_sql()
