"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteseries.functions import dates as D
from siteseries.operators import aggregate as A
from siteseries.operators.joins import attach
from siteseries.plans import views as V
from siteseries.plans.registry import query, r, tidy
from siteseries.sources.files import table

KEYS = ["site_code", "collection_period"]
SEASON_SQL = """CASE WHEN month({c}) IN (11, 12, 1, 2, 3) THEN 'Winter' WHEN month({c}) IN (4, 5, 6) THEN 'Spring'
  WHEN month({c}) IN (7, 8) THEN 'Summer' ELSE 'Fall' END"""


@query("a1_community_total", ("survey",), f"""
SELECT site_code, collection_period, {r('coalesce(sum(density), 0)', 2)} AS density, {r('coalesce(sum(biomass), 0)', 3)} AS biomass
FROM survey GROUP BY ALL""")
def a1(spark, sf):
    return tidy(A.community_total(V.survey(spark, sf), ["density", "biomass"]), 3, density=2)


def _level(keys: str, tag: str) -> str:
    return (f"SELECT {keys}, avg(lengthmm) AS mu_{tag}, median(lengthmm) AS me_{tag}, stddev_samp(lengthmm) AS sd_{tag}, "
            f"count(*) AS n_{tag} FROM individual GROUP BY ALL")


@query("a2_taxonomic_levels", ("individual",), f"""
SELECT s.site_code, s.collection_period, s.lowest_taxon, p.family,
       {', '.join(f'{r(f"{c}_{t}", 5)} AS {c}_{t}' for t in ('spe', 'fam', 'com') for c in ('mu', 'me', 'sd'))},
       n_spe::BIGINT AS n_spe, n_fam::BIGINT AS n_fam, n_com::BIGINT AS n_com
FROM ({_level('site_code, collection_period, lowest_taxon', 'spe')}) s
JOIN (SELECT DISTINCT family, lowest_taxon FROM individual) p USING (lowest_taxon)
JOIN ({_level('site_code, collection_period, family', 'fam')}) f ON f.site_code = s.site_code AND f.collection_period = s.collection_period AND f.family = p.family
JOIN ({_level('site_code, collection_period', 'com')}) c ON c.site_code = s.site_code AND c.collection_period = s.collection_period
WHERE mu_spe > 0""")
def a2(spark, sf):
    return tidy(A.taxonomic_levels(V.staged(V.individual(spark, sf)), "lengthmm"), 5)


@query("a3_community_stats", ("survey", "totals"), f"""
SELECT s.site_code, s.collection_period, s.lowest_taxon, {r('t.density', 2)} AS density_com,
       {r('avg(t.density) OVER a')} AS density_com_mu_at, {r('median(t.density) OVER a')} AS density_com_me_at, (count(*) OVER a)::BIGINT AS density_com_n_at,
       {r('y_mu')} AS density_com_mu_yr, {r('y_me')} AS density_com_me_yr, y_n::BIGINT AS density_com_n_yr,
       {r('q_mu')} AS density_com_mu_qt, {r('q_me')} AS density_com_me_qt, q_n::BIGINT AS density_com_n_qt
FROM survey s JOIN totals t USING (site_code, collection_period)
JOIN (SELECT site_code, year(collection_period) AS y, avg(density) AS y_mu, median(density) AS y_me, count(*) AS y_n FROM totals GROUP BY ALL) yy
  ON yy.site_code = s.site_code AND yy.y = year(s.collection_period)
JOIN (SELECT site_code, quarter(collection_period) AS qn, avg(density) AS q_mu, median(density) AS q_me, count(*) AS q_n FROM totals GROUP BY ALL) qq
  ON qq.site_code = s.site_code AND qq.qn = quarter(s.collection_period)
WINDOW a AS (PARTITION BY s.site_code)""".replace("avg(t.density) OVER a", "a_mu").replace("median(t.density) OVER a", "a_me")
    .replace("(count(*) OVER a)", "a_n").replace("WINDOW a AS (PARTITION BY s.site_code)", """
JOIN (SELECT site_code, avg(density) AS a_mu, median(density) AS a_me, count(*) AS a_n FROM totals GROUP BY ALL) aa ON aa.site_code = s.site_code"""))
def a3(spark, sf):
    out = A.taxa_with_community_stats(V.staged(V.survey(spark, sf).select(*KEYS, "lowest_taxon", "density")), "density")
    return tidy(out.drop("density", "collection_year", "collection_qtr"), 6, density_com=2)


@query("a4_quarter_means", ("env",), f"""
SELECT site_code, CAST(date_trunc('quarter', collection_period) AS DATE) AS quarter, {r('avg(x1)')} AS x1, {r('avg(x2)')} AS x2, {r('avg(x3)')} AS x3
FROM env GROUP BY ALL""")
def a4(spark, sf):
    e = V.env(spark, sf).withColumn("quarter", D.bucket("collection_period", "quarter"))
    return tidy(A.column_means(e, ["site_code", "quarter"], ["x1", "x2", "x3"]))


@query("a5_collapse_duplicates", sql=f"""
SELECT l_suppkey, CAST(l_shipdate AS DATE) AS d, {r('avg(l_discount)')} AS l_discount, {r('avg(l_tax)')} AS l_tax FROM lineitem GROUP BY ALL""")
def a5(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("d", F.col("l_shipdate").cast("date"))
    return tidy(A.column_means(lines, ["l_suppkey", "d"], ["l_discount", "l_tax"]))


@query("a6_study_average", ("env",), f"SELECT site_code, {r('avg(x1)')} AS x1, {r('avg(x2)')} AS x2, {r('avg(x3)')} AS x3 FROM env GROUP BY ALL")
def a6(spark, sf):
    return tidy(A.column_means(V.env(spark, sf), ["site_code"], ["x1", "x2", "x3"]))


@query("a7_shifted_quarter_variance", ("totals",), f"""
SELECT CAST(date_trunc('quarter', collection_period + 35) AS DATE) AS quarter, {r('var_samp(density)', 3)} AS density_var,
       {r('var_samp(biomass)', 3)} AS biomass_var, count(*)::BIGINT AS n FROM totals GROUP BY ALL""")
def a7(spark, sf):
    return tidy(A.shifted_quarter_variance(V.totals(spark, sf), ["density", "biomass"]), 3)


YEARS = list(range(1995, 2002))  # of the given tables, for the SQL only; the queries read them from the data


@query("a8_effort_matrix", ("totals",), f"""
SELECT month(collection_period)::BIGINT AS month, {', '.join(f'nullif(count(*) FILTER (WHERE year(collection_period) = {y}), 0)::BIGINT AS "{y}"' for y in YEARS)}
FROM totals GROUP BY ALL""")
def a8(spark, sf):
    t = V.staged(V.totals(spark, sf).select(*KEYS, "density").withColumn("year", F.year("collection_period")))
    return tidy(A.effort_matrix(t, F.month("collection_period").alias("month"), "year", V.survey_years(t)))


@query("a9_envelope", ("vectors",), f"""
SELECT label::BIGINT AS label, {', '.join(f"{r(f'avg({c})')} AS {c}_mu, {r(f'quantile_cont({c}, 0.1)')} AS {c}_lwr, {r(f'quantile_cont({c}, 0.9)')} AS {c}_upr" for c in ('x1', 'x2'))}
FROM vectors GROUP BY ALL""")
def a9(spark, sf):
    return tidy(A.envelope(V.vectors(spark, sf), ["label"], ["x1", "x2"]))


@query("a10_mean_sd_label", ("totals",), """
SELECT month(collection_period)::BIGINT AS month, printf('%.0f', round_even(avg(density), 0)) || ' (' || printf('%.0f', round_even(stddev_samp(density), 0)) || ')' AS label
FROM totals GROUP BY ALL""")
def a10(spark, sf):
    t = V.totals(spark, sf).select(*KEYS, "density").withColumn("month", F.month("collection_period"))
    return tidy(A.mean_sd_label(t, ["month"], "density", digits=0))


@query("a11_mean_sd_n", ("outcomes",), f"""
SELECT site_group, season, {r('avg(density)')} AS x_mean, {r('stddev_samp(density)')} AS x_sd, count(*)::BIGINT AS x_n FROM outcomes GROUP BY ALL""")
def a11(spark, sf):
    return tidy(A.mean_sd_n(V.outcomes(spark, sf), ["site_group", "season"], "density"))


@query("a12_event_percent", ("env",), f"""
SELECT season, site_code, count(*)::BIGINT AS n_obs, sum(fl)::BIGINT AS n_flood, {r('sum(fl) * 100.0 / count(*)')} AS percent_flood,
       sum(dr)::BIGINT AS n_drought, {r('sum(dr) * 100.0 / count(*)')} AS percent_drought
FROM (SELECT *, {SEASON_SQL.format(c='collection_period')} AS season, CASE WHEN x3 > 26 THEN 1 ELSE 0 END AS fl,
             CASE WHEN x3 < 24 THEN 1 ELSE 0 END AS dr FROM env) GROUP BY ALL""")
def a12(spark, sf):
    e = A.seasonal(V.env(spark, sf))
    return tidy(A.event_percent(e, ["season", "site_code"], {"flood": F.col("x3") > 26, "drought": F.col("x3") < 24}))


@query("a13_event_counts", ("env",), """
SELECT site_code, count(*) FILTER (WHERE x3 > 26)::BIGINT AS n_flood, count(*) FILTER (WHERE x3 < 24)::BIGINT AS n_drought
FROM (SELECT DISTINCT site_code, collection_period, x3 FROM env) GROUP BY ALL""")
def a13(spark, sf):
    e = V.env(spark, sf).select(*KEYS, "x3")
    return A.event_counts(e, ["site_code"], {"flood": F.col("x3") > 26, "drought": F.col("x3") < 24})


@query("a14_composition_percent", ("survey",), f"""
SELECT site_code, collection_period, family, {r('density', 2)} AS density, {r('sum(density) OVER (PARTITION BY site_code, collection_period)', 2)} AS unit_total,
       {r('100.0 * density / sum(density) OVER (PARTITION BY site_code, collection_period)')} AS percent
FROM (SELECT site_code, collection_period, CASE WHEN family IN ('ECONOMY', 'PROMO') THEN family ELSE 'Other' END AS family, sum(density) AS density
      FROM survey GROUP BY ALL)""")
def a14(spark, sf):
    return tidy(A.composition_percent(V.survey(spark, sf), KEYS, "family", "density", ["ECONOMY", "PROMO"]), 6, density=2, unit_total=2)


@query("a15_regional_composition", ("survey",), f"""
SELECT month(collection_period)::BIGINT AS month, family, {r('avg(p)')} AS percent_mu
FROM (SELECT *, 100.0 * density / sum(density) OVER (PARTITION BY collection_period) AS p FROM survey) GROUP BY ALL""")
def a15(spark, sf):
    return tidy(A.regional_composition(V.staged(V.survey(spark, sf)), "collection_period", "family", "density"))


@query("a16_trait_totals", ("survey",), f"SELECT site_code, collection_period, trait, {r('sum(density)', 2)} AS density FROM survey GROUP BY ALL")
def a16(spark, sf):
    traits = table(spark, sf, "part").select(F.concat_ws(" ", "p_type", "p_brand").alias("lowest_taxon"), F.col("p_brand").alias("trait"))
    return tidy(A.trait_totals(V.survey(spark, sf).drop("trait"), traits, "trait", "density"), 2)


@query("a17_regional_index", ("flow",), f"""
SELECT d, {r('avg(q / m)')} AS q_region, CASE WHEN d <= DATE '1997-01-01' THEN '1995-1996' WHEN d < DATE '1999-01-01' THEN '1997-1998' ELSE '1999-2001' END AS era
FROM flow JOIN (SELECT site_code, median(q) AS m FROM flow GROUP BY ALL) USING (site_code) GROUP BY ALL""")
def a17(spark, sf):
    out = A.regional_index(V.flow(spark, sf), "site_code", "d", "q", "median")
    era = (F.when(F.col("d") <= F.lit("1997-01-01").cast("date"), "1995-1996")
           .when(F.col("d") < F.lit("1999-01-01").cast("date"), "1997-1998").otherwise("1999-2001"))
    return tidy(out.withColumn("era", era))


@query("a18_regime_ratio", ("flow",), f"""
SELECT 'week' AS grain, site_code, NULL::BIGINT AS coarse, fine::BIGINT AS fine, {r('fine_mu / centre')} AS ratio FROM (
  SELECT site_code, (dayofyear(d) - 1) // 7 + 1 AS fine, avg(q) AS fine_mu FROM flow GROUP BY ALL)
  JOIN (SELECT site_code, avg(q) AS centre FROM flow GROUP BY ALL) USING (site_code)
UNION ALL
SELECT 'month', site_code, y::BIGINT, fine::BIGINT, {r('fine_mu / centre')} FROM (
  SELECT site_code, year(d) AS y, month(d) AS fine, avg(q) AS fine_mu FROM flow GROUP BY ALL)
  JOIN (SELECT site_code, year(d) AS y, median(q) AS centre FROM flow GROUP BY ALL) USING (site_code, y)""")
def a18(spark, sf):
    f = V.staged(V.flow(spark, sf))
    week = A.regime_ratio(f, "site_code", "d", "q", D.week_of_year("d").cast("int"), "fine")
    month = A.regime_ratio(f, "site_code", "d", "q", F.month("d"), "fine", F.year("d"), "median")
    week = week.select(F.lit("week").alias("grain"), "site_code", F.lit(None).cast("int").alias("coarse"), "fine", "ratio")
    month = month.select(F.lit("month").alias("grain"), "site_code", "coarse", "fine", "ratio")
    return tidy(week.unionByName(month))


@query("a19_quarters_occupied", ("part_survey",), """
SELECT lowest_taxon, sum(p)::BIGINT AS occurrence FROM (
  SELECT date_trunc('quarter', collection_period) AS q, lowest_taxon, CASE WHEN sum(density) > 0 THEN 1 ELSE 0 END AS p FROM part_survey GROUP BY ALL)
GROUP BY lowest_taxon""")
def a19(spark, sf):
    return A.quarters_occupied(V.part_survey(spark, sf), "lowest_taxon", "density")


def quarters_of(years: list[int]) -> list[str]:
    return [f"{y}-{m:02d}-01" for y in years for m in (1, 4, 7, 10)]


QUARTERS = quarters_of(YEARS)


@query("a20_occurrence_matrix", ("part_survey",), f"""
WITH pq AS (SELECT CAST(date_trunc('quarter', collection_period) AS DATE) AS q, lowest_taxon,
             CASE WHEN sum(density) > 0 THEN 1 ELSE 0 END AS p FROM part_survey GROUP BY ALL)
SELECT lowest_taxon, {', '.join(f'''max(p) FILTER (WHERE q = DATE '{q}')::BIGINT AS "{q}"''' for q in QUARTERS)}
FROM pq GROUP BY ALL HAVING sum(p) < 15""")
def a20(spark, sf):
    t = V.staged(V.part_survey(spark, sf))
    return tidy(A.occurrence_matrix(t, "lowest_taxon", "density", 15, quarters_of(V.survey_years(t))))


@query("a21_even_out", ("outcomes",), f"""
SELECT site_code, year(collection_period)::BIGINT AS year, quarter(collection_period)::BIGINT AS qtr, {r('avg(density)')} AS density,
       {r('avg(shannon)')} AS shannon FROM outcomes GROUP BY ALL""")
def a21(spark, sf):
    return tidy(A.even_out(V.outcomes(spark, sf), ["site_code"], "collection_period", ["density", "shannon"]))


@query("a22_normalised_monthly_mean", ("totals", "site_dim"), f"""
SELECT year(collection_period)::BIGINT AS year, month(collection_period)::BIGINT AS month, {r('avg(biomass / annualrain / 1000.0)', 9)} AS depth_mu
FROM totals JOIN site_dim USING (site_code) GROUP BY ALL""")
def a22(spark, sf):
    t = V.totals(spark, sf).select(*KEYS, "biomass")
    t = attach(t, V.site_dim(spark, sf).select("site_code", "annualrain"))
    return tidy(A.normalised_monthly_mean(t, "biomass", "annualrain", "collection_period"), 9)
