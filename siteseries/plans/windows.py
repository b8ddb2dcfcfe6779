"""Scaling, gap-filling and daily-flow queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteseries.operators import fill, flow as W, joins as J, scaling as Z
from siteseries.plans import views as V
from siteseries.plans.registry import query, r, tidy

KEYS = ["site_code", "collection_period"]


@query("w1_centred", ("totals",), f"""
SELECT site_code, collection_period, {r('density - avg(density) OVER (PARTITION BY site_code)')} AS z_density,
       {r('biomass - avg(biomass) OVER (PARTITION BY site_code)')} AS z_biomass FROM totals""")
def w1(spark, sf):
    t = V.totals(spark, sf)
    return tidy(Z.centred(t, ["site_code"], ["density", "biomass"], bounded=True).select(*KEYS, "z_density", "z_biomass"))


@query("w2_z_scores", ("env",), f"""
SELECT site_code, collection_period, {', '.join(f"{r(f'({c} - avg({c}) OVER w) / nullif(stddev_samp({c}) OVER w, 0)')} AS {c}_scaled" for c in ('x1', 'x2', 'x3'))}
FROM env WINDOW w AS (PARTITION BY site_code)""")
def w2(spark, sf):
    cols = ["x1", "x2", "x3"]
    return tidy(Z.z_scores(V.env(spark, sf), ["site_code"], cols, bounded=True).drop(*cols))


FILLED = """
WITH g AS (SELECT * FROM (SELECT DISTINCT site_code, collection_period FROM {src}) CROSS JOIN (SELECT DISTINCT {lvl} FROM {src})),
v AS (SELECT g.site_code, g.collection_period, g.{lvl}, coalesce(c, 0)::DOUBLE AS c, coalesce(s, 0) AS s FROM g LEFT JOIN (
   SELECT site_code, collection_period, {lvl}, sum(cnt) AS c, sum(mu) AS s FROM (
     SELECT site_code, collection_period, {lvl}, lowest_taxon, {cnt} AS cnt, {mu} AS mu FROM {src} GROUP BY ALL) GROUP BY ALL) f
   ON f.site_code = g.site_code AND f.collection_period = g.collection_period AND f.{lvl} = g.{lvl}),
z AS (SELECT *, (c - avg(c) OVER w) / nullif(stddev_samp(c) OVER w, 0) AS count_s, (s - avg(s) OVER w) / nullif(stddev_samp(s) OVER w, 0) AS size_s
      FROM v WINDOW w AS (PARTITION BY site_code, {lvl}))"""


@query("w3_zero_filled_z", ("survey",), FILLED.format(src="survey", lvl="family", cnt="sum(density)", mu="sum(biomass)") + f"""
SELECT site_code, collection_period, family, {r('count_s')} AS density_s FROM z WHERE count_s IS NOT NULL""")
def w3(spark, sf):
    return tidy(Z.zero_filled_z(V.staged(V.survey(spark, sf)), "family", {"density": F.sum("density")}))


@query("w4_count_and_size", ("individual",), FILLED.format(src="individual", lvl="family", cnt="count(*)", mu="avg(lengthmm)") + f"""
SELECT site_code, collection_period, family, 'count' AS xvar, {r('count_s')} AS x FROM z WHERE count_s IS NOT NULL
UNION ALL SELECT site_code, collection_period, family, 'size', {r('size_s')} FROM z WHERE size_s IS NOT NULL""")
def w4(spark, sf):
    return tidy(Z.count_and_size_series(V.staged(V.individual(spark, sf)), "family", "lengthmm"))


@query("w5_log_ratio_to_mean", ("outcomes",), f"""
SELECT site_code, collection_period, {', '.join(f"{r(f'ln({c} / avg({c}) OVER (PARTITION BY site_code))')} AS LRR_{c}" for c in ('density', 'biomass', 'richness', 'shannon'))}
FROM outcomes""")
def w5(spark, sf):
    cols = ["density", "biomass", "richness", "shannon"]
    return tidy(Z.log_ratio_to_mean(V.outcomes(spark, sf), ["site_code"], cols, bounded=True).select(*KEYS, *[f"LRR_{c}" for c in cols]))


GRID = """SELECT * FROM (SELECT DISTINCT site_code FROM totals) CROSS JOIN
  (SELECT CAST(m AS DATE) AS collection_period FROM generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 MONTH) t(m))"""


@query("w6_lag_difference", ("totals",), f"""
SELECT g.site_code, g.collection_period, {r('t.density', 2)} AS density, {r('t.density - p.density', 2)} AS delta_k1
FROM ({GRID}) g LEFT JOIN totals t ON t.site_code = g.site_code AND t.collection_period = g.collection_period
LEFT JOIN totals p ON p.site_code = g.site_code AND p.collection_period = g.collection_period - INTERVAL 1 MONTH""")
def w6(spark, sf):
    t = V.staged(V.totals(spark, sf).select(*KEYS, "density"))
    return tidy(Z.lag_difference(t, "density", "site_code", "collection_period", *V.survey_months(t)), 2)


@query("w7_deltas", ("totals",), f"""
WITH st AS (SELECT site_code, collection_period, density,
    avg(density) OVER a AS mu_at, avg(density) OVER y AS mu_yr, avg(density) OVER q AS mu_qt,
    median(density) OVER a AS me_at, median(density) OVER y AS me_yr, median(density) OVER q AS me_qt FROM totals
  WINDOW a AS (PARTITION BY site_code), y AS (PARTITION BY site_code, year(collection_period)), q AS (PARTITION BY site_code, quarter(collection_period)))
SELECT g.site_code, g.collection_period, {r('density', 2)} AS density_com,
  {', '.join(f"{r(f'density - {s}_{k}')} AS density_com_delta_{k}_{s}" for k in ('at', 'yr', 'qt') for s in ('mu', 'me'))}
FROM ({GRID}) g LEFT JOIN st ON st.site_code = g.site_code AND st.collection_period = g.collection_period""")
def w7(spark, sf):
    t = V.staged(V.totals(spark, sf))
    return tidy(Z.deltas(t, "density", *V.survey_months(t)), 6, density_com=2)


def _ma(c: str, k: int = 4) -> str:
    num = " + ".join(f"coalesce({f}({c}, {d}) OVER w / {d + 1}.0::DOUBLE, 0)" for d in range(1, k + 1) for f in ("lag", "lead"))
    den = " + ".join(f"CASE WHEN {f}({c}, {d}) OVER w IS NULL THEN 0 ELSE 1 / {d + 1}.0::DOUBLE END" for d in range(1, k + 1) for f in ("lag", "lead"))
    cnt = " + ".join(f"CASE WHEN {f}({c}, {d}) OVER w IS NULL THEN 0 ELSE 1 END" for d in range(1, k + 1) for f in ("lag", "lead"))
    return f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN {cnt} >= 2 THEN ({num}) / ({den}) END"


@query("w8_moving_average_fill", ("env",), f"""
SELECT site_code, collection_period, {', '.join(f"{r(_ma(c))} AS {c}" for c in ('x1', 'x2', 'x3'))} FROM env
WINDOW w AS (PARTITION BY site_code ORDER BY collection_period)""")
def w8(spark, sf):
    return tidy(fill.moving_average_fill(V.env(spark, sf), ["site_code"], "collection_period", ["x1", "x2", "x3"]))


@query("w8b_widening_fill", ("env",), f"""
WITH g AS (SELECT e.site_code, e.collection_period, CASE WHEN quarter(e.collection_period) <= 2 THEN NULL ELSE x1 END AS x1,
             row_number() OVER (PARTITION BY site_code ORDER BY collection_period) AS p FROM env e),
d AS (SELECT a.site_code, a.p, abs(a.p - b.p) AS dist, b.x1 AS v,
             row_number() OVER (PARTITION BY a.site_code, a.p ORDER BY abs(a.p - b.p)) AS k
      FROM g a JOIN g b ON a.site_code = b.site_code AND b.x1 IS NOT NULL WHERE a.x1 IS NULL),
f AS (SELECT d.site_code, d.p, sum(v / (dist + 1.0::DOUBLE)) / sum(1 / (dist + 1.0::DOUBLE)) AS v FROM d
      JOIN (SELECT site_code, p, greatest(4, dist) AS reach FROM d WHERE k = 2) h ON h.site_code = d.site_code AND h.p = d.p
      WHERE dist <= reach GROUP BY ALL)
SELECT g.site_code, g.collection_period, {r('coalesce(g.x1, f.v)')} AS x1 FROM g LEFT JOIN f ON f.site_code = g.site_code AND f.p = g.p""")
def w8b(spark, sf):
    e = V.env(spark, sf).select(*KEYS, F.when(F.quarter("collection_period") > 2, F.col("x1")).alias("x1"))
    return tidy(fill.moving_average_fill_widening(e, ["site_code"], "collection_period", ["x1"]))


@query("w9_seasonal_grid_fill", ("survey",), f"""
WITH t AS (SELECT site_code, family, month(collection_period) AS month, avg(density) AS v FROM survey GROUP BY ALL),
g AS (SELECT * FROM (SELECT DISTINCT site_code, family FROM t) CROSS JOIN (SELECT unnest(range(1, 13)) AS month)),
j AS (SELECT g.site_code, g.family, g.month, t.v FROM g LEFT JOIN t ON t.site_code = g.site_code AND t.family = g.family AND t.month = g.month)
SELECT site_code, family, month::BIGINT AS month, {r(_ma('v'))} AS v FROM j WINDOW w AS (PARTITION BY site_code, family ORDER BY month)""")
def w9(spark, sf):
    s = V.survey(spark, sf).withColumn("month", F.month("collection_period"))
    t = V.staged(s.groupBy("site_code", "family", "month").agg(F.avg("density").alias("v")))
    grid = J.key_grid(t.select("site_code", "family"), "month", F.sequence(F.lit(1), F.lit(12)))
    return tidy(fill.moving_average_fill(J.on_grid(grid, t), ["site_code", "family"], "month", ["v"]))


@query("w10_group_mean_impute", ("env",), f"""
SELECT site_code, collection_period, {', '.join(f"{r(f'coalesce({c}, avg({c}) OVER w)')} AS {c}" for c in ('x1', 'x2', 'x3'))} FROM env
WINDOW w AS (PARTITION BY site_code, quarter(collection_period))""")
def w10(spark, sf):
    e = V.env(spark, sf).withColumn("qtr", F.quarter("collection_period"))
    return tidy(fill.group_mean_impute(e, ["site_code", "qtr"], ["x1", "x2", "x3"]).drop("qtr"))


TRAIL = """
WITH t AS (SELECT *, max(q) OVER w AS q_max, min(q) OVER w AS q_min FROM flow
           WINDOW w AS (PARTITION BY site_code ORDER BY d RANGE BETWEEN INTERVAL 28 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)),
b AS (SELECT site_code, year(d) AS y, median(q) AS q_base, quantile_cont(q, 0.25) AS q_low FROM flow GROUP BY ALL)"""


@query("w11_trailing_extremes", ("flow",), TRAIL + f"""
SELECT site_code, d, {r('q', 2)} AS q, {r('q_max', 2)} AS q_max, {r('q_min', 2)} AS q_min FROM t""")
def w11(spark, sf):
    return tidy(W.trailing_extremes(V.flow(spark, sf), "site_code", "d", "q"), 2)


@query("w12_event_magnitude", ("flow",), TRAIL + f"""
SELECT site_code, d, {r('(q_max - q_base) / q_base')} AS flood_magnitude, {r('(q_min - q_base) / q_base')} AS drought_magnitude
FROM t JOIN b USING (site_code) WHERE b.y = year(t.d)""")
def w12(spark, sf):
    return tidy(W.event_magnitude(V.flow(spark, sf), "site_code", "d", "q").select("site_code", "d", "flood_magnitude", "drought_magnitude"))


@query("w13_low_spells", ("flow",), TRAIL + f""",
l AS (SELECT f.site_code, f.d, f.q, date_diff('day', DATE '1970-01-01', f.d) - row_number() OVER (PARTITION BY f.site_code ORDER BY f.d) AS run
      FROM flow f JOIN (SELECT site_code, year(d) AS y, median(q) AS cut FROM flow GROUP BY ALL) m ON m.site_code = f.site_code AND m.y = year(f.d) WHERE f.q < m.cut)
SELECT site_code, min(d) AS start_date, max(d) AS end_date, count(*)::BIGINT AS days, {r('min(q)', 2)} AS q_min FROM l GROUP BY site_code, run HAVING count(*) > 4""")
def w13(spark, sf):
    # the made flow is day-to-day noise: half the days and runs above 4 days give spells to compare
    return tidy(W.low_spells(V.flow(spark, sf), "site_code", "d", "q", prob=0.5, longer_than=4), 2)


@query("w14_event_durations", ("flow",), TRAIL + f""",
n AS (SELECT f.site_code, f.d, f.q, min(CASE WHEN f.q < 1.5 * b.q_base THEN f.d END) OVER w AS calm, min(CASE WHEN f.q > b.q_low THEN f.d END) OVER w AS wet
      FROM flow f JOIN b ON b.site_code = f.site_code AND b.y = year(f.d)
      WINDOW w AS (PARTITION BY f.site_code ORDER BY f.d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
p AS (SELECT a.site_code, a.d, x.d AS xd, x.calm, x.wet, row_number() OVER (PARTITION BY a.site_code, a.d ORDER BY x.q DESC, x.d) AS kmax,
             row_number() OVER (PARTITION BY a.site_code, a.d ORDER BY x.q, x.d) AS kmin
      FROM flow a LEFT JOIN n x ON x.site_code = a.site_code AND x.d < a.d AND x.d >= a.d - 28)
SELECT site_code, d, max(date_diff('day', xd, calm)) FILTER (WHERE kmax = 1)::BIGINT AS flood_duration,
       max(date_diff('day', xd, wet)) FILTER (WHERE kmin = 1)::BIGINT AS drought_duration FROM p GROUP BY ALL""")
def w14(spark, sf):
    # the made flow never reaches ten times its median: 1.5 x gives durations above zero
    out = W.event_durations(V.flow(spark, sf), "site_code", "d", "q", times=1.5)
    return tidy(out.select("site_code", "d", "flood_duration", "drought_duration"))


@query("w15_regime_indices", ("flow",), f"""
WITH m AS (SELECT site_code, median(q) AS med, quantile_cont(q, 0.25) AS q25 FROM flow GROUP BY ALL),
s AS (SELECT f.*, med, q25, abs(q - lag(q) OVER (PARTITION BY f.site_code ORDER BY d)) AS step FROM flow f JOIN m USING (site_code))
SELECT site_code, {r('median(q)', 2)} AS q_med, {r('max(q)', 2)} AS q_max, {r('avg(q)', 3)} AS q_mu, {r('stddev_samp(q)', 3)} AS q_sd,
  {r('stddev_samp(q) / median(q)')} AS q_rsd, {r('quantile_cont(q, 0.25)', 2)} AS q_q25, {r('quantile_cont(q, 0.75)', 2)} AS q_q75,
  {r('avg(CASE WHEN q < q25 THEN 1.0::DOUBLE ELSE 0 END)')} AS q_lfpp,
  {', '.join(f"{r(f'avg(CASE WHEN q > {k} * med THEN 1.0::DOUBLE ELSE 0 END)')} AS q_hfpp{k}" for k in (2, 3, 7))},
  {r('sum(step) / sum(q)')} AS q_flashiness FROM s GROUP BY ALL""")
def w15(spark, sf):
    return tidy(W.regime_indices(V.flow(spark, sf), "site_code", "d", "q", (2, 3, 7)), 6, q_med=2, q_max=2, q_mu=3, q_sd=3, q_q25=2, q_q75=2)
