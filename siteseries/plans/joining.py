"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteseries.functions.dates import month_sequence
from siteseries.functions.numeric import ratio
from siteseries.operators import joins as J
from siteseries.plans import views as V
from siteseries.plans.registry import query, r, tidy

KEYS = ["site_code", "collection_period"]


@query("j1_natural_left", ("totals", "env"), f"""
SELECT t.site_code, t.collection_period, {r('t.density', 2)} AS density, {r('e.x1')} AS x1, {r('e.x2')} AS x2, {r('e.x3')} AS x3
FROM totals t LEFT JOIN env e ON t.site_code IS NOT DISTINCT FROM e.site_code AND t.collection_period IS NOT DISTINCT FROM e.collection_period""")
def j1(spark, sf):
    t = V.totals(spark, sf).select(*KEYS, "density")
    return tidy(J.natural_join(t, V.env(spark, sf), "left"), 6, density=2)


@query("j2_attach_site", ("survey", "site_dim"), f"""
SELECT s.site_code, s.collection_period, s.lowest_taxon, {r('s.density', 2)} AS density, {r('d.annualrain')} AS annualrain
FROM survey s LEFT JOIN site_dim d ON s.site_code = d.site_code""")
def j2(spark, sf):
    s = V.survey(spark, sf).select("site_code", "collection_period", "lowest_taxon", "density")
    return tidy(J.attach(s, V.site_dim(spark, sf).select("site_code", "annualrain")), 6, density=2)


@query("j3_natural_full", ("totals", "env"), f"""
SELECT coalesce(t.site_code, e.site_code) AS site_code, coalesce(t.collection_period, e.collection_period) AS collection_period,
       {r('t.density', 2)} AS density, {r('e.x3')} AS x3
FROM totals t FULL JOIN env e ON t.site_code = e.site_code AND t.collection_period = e.collection_period""")
def j3(spark, sf):
    t = V.totals(spark, sf).select(*KEYS, "density")
    return tidy(J.natural_join(t, V.env(spark, sf).select(*KEYS, "x3"), "full"), 6, density=2)


@query("j4_anti", ("totals", "env"), """
SELECT e.site_code, e.collection_period FROM env e
WHERE NOT EXISTS (SELECT 1 FROM totals t WHERE t.site_code = e.site_code AND t.collection_period = e.collection_period)""")
def j4(spark, sf):
    t = V.totals(spark, sf).select(*KEYS, "density")
    return J.natural_join(V.env(spark, sf).select(*KEYS), t.select(*KEYS), "anti")


@query("j5_never_on_right", ("survey", "rare_survey"), """
SELECT DISTINCT site_code, lowest_taxon FROM survey EXCEPT SELECT site_code, lowest_taxon FROM rare_survey""")
def j5(spark, sf):
    keys = ["site_code", "lowest_taxon"]
    return J.only_in(V.survey(spark, sf).select(*keys).distinct(), V.rare_survey(spark, sf), keys)


@query("j6_restrict_to_events", ("survey", "env"), f"""
SELECT s.site_code, s.collection_period, s.lowest_taxon, {r('s.density', 2)} AS density FROM survey s
WHERE EXISTS (SELECT 1 FROM env e WHERE e.x3 > 26 AND e.site_code = s.site_code AND e.collection_period = s.collection_period)""")
def j6(spark, sf):
    s = V.survey(spark, sf).select(*KEYS, "lowest_taxon", "density")
    return tidy(J.restrict_to(s, V.env(spark, sf).filter(F.col("x3") > 26), KEYS), 2)


@query("j7_full_grid", ("survey",), """
SELECT * FROM (SELECT DISTINCT site_code FROM survey) CROSS JOIN
  (SELECT CAST(m AS DATE) AS collection_period FROM generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 MONTH) t(m))""")
def j7(spark, sf):
    t = V.staged(V.totals(spark, sf).select("site_code", "collection_period"))
    return J.key_grid(t.select("site_code"), "collection_period", month_sequence(*V.survey_months(t)))


@query("j8_grid_with_gaps", ("env",), f"""
SELECT g.site_code, g.collection_period, {r('e.x1')} AS x1 FROM (
  SELECT * FROM (SELECT DISTINCT site_code FROM env) CROSS JOIN
    (SELECT CAST(unnest(generate_series(min(collection_period) - INTERVAL 7 MONTH, max(collection_period) + INTERVAL 6 MONTH, INTERVAL 1 MONTH)) AS DATE) AS collection_period FROM env)) g
LEFT JOIN env e ON e.site_code = g.site_code AND e.collection_period = g.collection_period""")
def j8(spark, sf):
    e = V.staged(V.env(spark, sf))
    # a margin of gaps around the data's own months
    first, months = V.survey_months(e.withColumn("collection_period", F.add_months("collection_period", -7)))
    grid = J.key_grid(e.select("site_code"), "collection_period", month_sequence(first, months + 13))
    return tidy(J.on_grid(grid, e.select(*KEYS, "x1")))


@query("j9_aggregate_and_join_back", ("survey",), f"""
SELECT site_code, collection_period, lowest_taxon, {r('density', 2)} AS density, {r('avg(density) OVER (PARTITION BY site_code, family)')} AS mu,
       {r('density / avg(density) OVER (PARTITION BY site_code, family)')} AS relative FROM survey""")
def j9(spark, sf):
    s = J.with_group_stats(V.staged(V.survey(spark, sf)), ["site_code", "family"], {"mu": F.avg("density")}, small=True)
    return tidy(s.select(*KEYS, "lowest_taxon", "density", "mu", ratio("density", "mu").alias("relative")), 6, density=2)


@query("j10_multi_level_join_back", ("individual",), f"""
SELECT site_code, collection_period, family, lowest_taxon, count(*)::BIGINT AS n, {r('max(m1)')} AS mu_com, {r('max(m2)')} AS mu_fam, {r('avg(lengthmm)')} AS mu_spe
FROM (SELECT *, avg(lengthmm) OVER (PARTITION BY site_code, collection_period) AS m1,
             avg(lengthmm) OVER (PARTITION BY site_code, collection_period, family) AS m2 FROM individual) GROUP BY ALL""")
def j10(spark, sf):
    i = V.individual(spark, sf)
    # finest level first; coarser means are rebuilt from its sums, so the raw rows are read once
    spe = i.groupBy(*KEYS, "family", "lowest_taxon").agg(F.count(F.lit(1)).alias("n"), F.sum("lengthmm").alias("s"))
    spe = V.staged(spe)
    out = J.with_group_stats(spe, [*KEYS, "family"], {"mu_fam": F.sum("s") / F.sum("n")})
    out = J.with_group_stats(out, KEYS, {"mu_com": F.sum("s") / F.sum("n")})
    return tidy(out.withColumn("mu_spe", F.col("s") / F.col("n")).drop("s"))
