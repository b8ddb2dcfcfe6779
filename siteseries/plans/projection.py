"""Sources, projection, filters, sorting, set operations, reshaping and scalar functions."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from siteseries.functions import dates as D
from siteseries.functions import numeric as N
from siteseries.functions import text as X
from siteseries.operators import filters, ranking, reshape, select
from siteseries.operators.joins import natural_join
from siteseries.plans import views as V
from siteseries.plans.registry import query, r, tidy
from siteseries.session import scratch_path as scratch
from siteseries.sources import files
from siteseries.sources.files import table

KEYS = ["site_code", "collection_period"]


# --- sources and sinks -------------------------------------------------------------------------

@query("s1_scan", sql=f"""
SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, {r('sum(l_quantity)', 2)} AS qty
FROM lineitem WHERE l_shipdate < DATE '1998-09-01' GROUP BY ALL""")
def s1(spark, sf):
    lines = table(spark, sf, "lineitem").filter(F.col("l_shipdate") < F.lit("1998-09-01").cast("timestamp"))
    return tidy(lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty")), 2)


@query("s2_csv_sink", ("totals",), f"""
SELECT site_code, collection_period, {r('density', 2)} AS density, {r('biomass', 3)} AS biomass FROM totals""")
def s2(spark, sf):
    path = scratch(spark, "csv")
    files.write_csv(V.totals(spark, sf), path)
    back = files.read_csv(spark, path, "site_code string, collection_period date, density double, biomass double")
    return tidy(back, 3, density=2)


@query("s3_batch_sink", ("survey",), f"""
SELECT 'by_family' AS name, family AS item, {r('sum(density)', 2)} AS density FROM survey GROUP BY ALL
UNION ALL SELECT 'by_trait', trait, {r('sum(density)', 2)} FROM survey GROUP BY ALL""")
def s3(spark, sf):
    shared = files.stage(V.survey(spark, sf).groupBy("family", "trait").agg(F.sum("density").alias("density")),
                         scratch(spark, "stage"))
    tables = {f"by_{c}": shared.groupBy(F.col(c).alias("item")).agg(F.sum("density").alias("density"))
              for c in ("family", "trait")}
    folder = scratch(spark, "batch")
    files.write_tables(tables, folder)
    parts = [files.read_csv(spark, os.path.join(folder, n), "item string, density double")
             .select(F.lit(n).alias("name"), "item", "density") for n in tables]
    return tidy(parts[0].unionByName(parts[1]), 2)


@query("s4_stage_table", ("survey",), f"""
SELECT site_code, count(*)::BIGINT AS taxa_rows, {r('max(density)', 2)} AS peak FROM survey GROUP BY ALL""")
def s4(spark, sf):
    staged = files.stage(V.survey(spark, sf), scratch(spark, "stage"))
    return tidy(staged.groupBy("site_code").agg(F.count(F.lit(1)).alias("taxa_rows"), F.max("density").alias("peak")), 2)


# --- projection --------------------------------------------------------------------------------

@query("p1_select_existing", ("survey",), f"""
SELECT site_code, collection_period, lowest_taxon, {r('density', 2)} AS density FROM survey""")
def p1(spark, sf):
    wanted = ["site_code", "collection_period", "lowest_taxon", "density", "not_a_column"]
    kept = select.keep_existing(V.survey(spark, sf), wanted)
    return tidy(select.drop_existing(kept, ["another_missing"]), 2)


@query("p2_select_by_pattern", ("vectors",), f"""
SELECT label::BIGINT AS label, vec_id, {', '.join(f"{r(f'x{i}')} AS x{i}" for i in range(1, 5))} FROM vectors""")
def p2(spark, sf):
    v = V.vectors(spark, sf)
    numeric = select.numeric_names(v, ["vec_id", "label"])
    spanned = [c for c in select.names_between(v, "x1", "x4") if c in numeric and c in select.names_matching(v, r"^x\d$")]
    return tidy(select.to_front(v.select("vec_id", "label", *spanned), ["label"]))


@query("p3_rename", sql="SELECT n_name AS site_code, n_nationkey::BIGINT AS site_no, n_regionkey::BIGINT AS region_no FROM nation")
def p3(spark, sf):
    return tidy(table(spark, sf, "nation").withColumnsRenamed(
        {"n_name": "site_code", "n_nationkey": "site_no", "n_regionkey": "region_no"}))


@query("p4_rename_by_pattern", sql=f"""
SELECT s_suppkey AS sup_suppkey, s_name AS sup_name, s_nationkey::BIGINT AS sup_nationkey, {r('s_acctbal', 2)} AS sup_acctbal
FROM supplier""")
def p4(spark, sf):
    return tidy(select.rename_regex(table(spark, sf, "supplier"), "^s_", "sup_"), 2)


@query("p5_snake_columns", sql=f"""
SELECT p_partkey AS part_key, p_type AS part_type, {r('p_retailprice', 2)} AS retail_price FROM part""")
def p5(spark, sf):
    odd = table(spark, sf, "part").select(F.col("p_partkey").alias("Part Key"), F.col("p_type").alias("Part.Type"),
                                          F.col("p_retailprice").alias("Retail_Price"))
    return tidy(select.snake_columns(odd), 2)


@query("p6_title_labels", sql="""
SELECT DISTINCT event_type, upper(substr(event_type, 1, 1)) || lower(substr(event_type, 2)) || ' Events' AS "Label Of Event"
FROM events""")
def p6(spark, sf):
    kinds = table(spark, sf, "events").select("event_type").distinct()
    return kinds.select("event_type", X.title_label(F.concat("event_type", F.lit("_events"))).alias(X.title_name("label_of_event")))


@query("p7_computed_columns", ("totals",), f"""
SELECT site_code, collection_period, {r('CASE WHEN density > 0 THEN ln(density) END')} AS ln_density,
       {r('sqrt(biomass)')} AS sqrt_biomass, {r('biomass / density')} AS mean_size FROM totals""")
def p7(spark, sf):
    t = V.totals(spark, sf)
    return tidy(t.select(*KEYS, N.ln_pos("density").alias("ln_density"), F.sqrt("biomass").alias("sqrt_biomass"),
                         N.ratio("biomass", "density").alias("mean_size")))


@query("p8_conditional_category", ("totals",), """
SELECT site_code, collection_period, CASE WHEN density < 500 THEN 'low' WHEN density < 1000 THEN 'middle' ELSE 'high' END AS grade
FROM totals""")
def p8(spark, sf):
    t = V.totals(spark, sf).select(*KEYS, "density")
    grade = select.categorise([(F.col("density") < 500, "low"), (F.col("density") < 1000, "middle")], "high")
    return t.select(*KEYS, grade.alias("grade"))


@query("p9_rowwise", ("env",), f"""
SELECT site_code, collection_period, {r('(x1 + x2 + x3) / 3.0')} AS row_mean, {r('x1 * x1 + x2 * x2 + x3 * x3')} AS row_ss
FROM env""")
def p9(spark, sf):
    cols = ["x1", "x2", "x3"]
    return tidy(V.env(spark, sf).select(*KEYS, N.row_mean(cols).alias("row_mean"), N.row_sum_squares(cols).alias("row_ss")))


@query("p10_pack_key", ("totals",), f"""
SELECT site_code || '@' || collection_period::VARCHAR AS uid, {r('density', 2)} AS density FROM totals""")
def p10(spark, sf):
    t = V.totals(spark, sf).select(*KEYS, "density")
    return tidy(select.pack_key(t, "uid", KEYS, "@"), 2)


@query("p11_unpack_key", ("totals",), f"""
SELECT site_code, collection_period, year(collection_period)::BIGINT AS y, {r('round_even(density / 7.0, 1)', 1)} AS share
FROM totals""")
def p11(spark, sf):
    t = V.totals(spark, sf).select(*KEYS, "density")
    packed = select.pack_key(t, "uid", KEYS, "@").withColumn(
        "label", F.concat(F.lit("axis ("), F.format_string("%.1f", F.bround(F.col("density") / 7.0, 1)), F.lit("%)")))
    back = select.unpack_key(packed, "uid", {"site_code": "string", "collection_period": "date"}, "@")
    return tidy(back.select(*KEYS, F.substring(F.col("collection_period").cast("string"), 1, 4).cast("int").alias("y"),
                            select.number_from_label("label").alias("share")), 1)


@query("p12_row_id", ("totals",), f"""
SELECT site_code, collection_period, row_number() OVER (PARTITION BY site_code ORDER BY collection_period)::BIGINT AS id
FROM totals""")
def p12(spark, sf):
    from pyspark.sql import Window
    t = V.totals(spark, sf).select(*KEYS, "density")
    # one row per site and month, so the per-site order is bounded by the calendar
    return tidy(t.select(*KEYS, F.row_number().over(Window.partitionBy("site_code").orderBy("collection_period")).alias("id")))


@query("p13_ordered_categories", ("totals",), """
SELECT site_code, collection_period, CASE season WHEN 'Winter' THEN 1 WHEN 'Spring' THEN 2 WHEN 'Summer' THEN 3 ELSE 4 END::BIGINT AS sort_key,
       CASE WHEN n_nationkey < 9 THEN 'dry' WHEN n_nationkey < 17 THEN 'middle' ELSE 'wet' END AS site_band
FROM (SELECT *, CASE WHEN month(collection_period) IN (11,12,1,2,3) THEN 'Winter' WHEN month(collection_period) IN (4,5,6) THEN 'Spring'
      WHEN month(collection_period) IN (7,8) THEN 'Summer' ELSE 'Fall' END AS season FROM totals) t JOIN nation ON n_name = site_code""")
def p13(spark, sf):
    t = V.totals(spark, sf).select(*KEYS, "density")
    t = t.withColumn("season", D.season("collection_period"))
    bands = table(spark, sf, "nation").select(F.col("n_name").alias("site_code"), select.categorise(
        [(F.col("n_nationkey") < 9, "dry"), (F.col("n_nationkey") < 17, "middle")], "wet").alias("site_band"))
    return tidy(natural_join(t, bands, "inner").select(
        *KEYS, select.order_key("season", list(D.SEASON_MONTHS)).alias("sort_key"), "site_band"))


# --- filters -----------------------------------------------------------------------------------

@query("f1_date_range", sql=f"""
SELECT o_orderkey, {r('o_totalprice', 2)} AS o_totalprice FROM orders
WHERE o_orderdate >= DATE '1997-03-01' AND o_orderdate < DATE '1998-01-01'""")
def f1(spark, sf):
    o = table(spark, sf, "orders").filter((F.col("o_orderdate") >= F.lit("1997-03-01").cast("timestamp"))
                                          & (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")))
    return tidy(o.select("o_orderkey", "o_totalprice"), 2)


@query("f2_outside_window", ("totals",), f"""
SELECT site_code, collection_period, {r('density', 2)} AS density FROM totals
WHERE collection_period < DATE '1997-08-01' OR collection_period > DATE '1998-10-01'""")
def f2(spark, sf):
    t = V.totals(spark, sf).select(*KEYS, "density")
    return tidy(filters.outside_dates(t, "collection_period", "1997-08-01", "1998-10-01"), 2)


@query("f3_membership", ("survey",), """
SELECT site_code, count(*)::BIGINT AS n FROM survey WHERE family IN ('ECONOMY', 'PROMO') GROUP BY ALL""")
def f3(spark, sf):
    s = V.survey(spark, sf).filter(filters.is_member("family", ["ECONOMY", "PROMO"]))
    return s.groupBy("site_code").agg(F.count(F.lit(1)).alias("n"))


@query("f4_every_seventh_day", ("flow",), f"""
SELECT site_code, d, {r('q', 2)} AS q FROM flow WHERE dayofyear(d) % 7 = 0""")
def f4(spark, sf):
    return tidy(filters.every_nth_day(V.flow(spark, sf), "d", 7), 2)


@query("f5_complete_cases", ("env",), f"""
SELECT site_code, collection_period, {r('x1')} AS x1, {r('x2')} AS x2, {r('x3')} AS x3 FROM env
WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL""")
def f5(spark, sf):
    return tidy(filters.complete_cases(V.env(spark, sf)))


@query("f6_null_rows", ("env",), "SELECT site_code, collection_period FROM env WHERE x1 IS NULL")
def f6(spark, sf):
    return V.env(spark, sf).filter(F.col("x1").isNull()).select(*KEYS)


@query("f7_drop_constant_columns", sql=f"""
SELECT site_code, {r('annualrain')} AS annualrain, site_no::BIGINT AS site_no
FROM (SELECT n_name AS site_code, avg(c_acctbal) AS annualrain, n_nationkey AS site_no FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)""")
def f7(spark, sf):
    d = V.site_dim(spark, sf).select("site_code", "annualrain", "site_no", F.lit(3.5).alias("flat"))
    return tidy(filters.drop_constant_columns(d))


@query("f8_pattern", sql="SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(red|blue).*t$')")
def f8(spark, sf):
    return table(spark, sf, "part").filter(F.col("p_name").rlike("^(red|blue).*t$")).select("p_partkey", "p_name")


@query("f9_bounding_box", sql=f"""
SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey, {r('c_acctbal', 2)} AS c_acctbal FROM customer
WHERE c_nationkey > 4 AND c_nationkey < 20 AND c_acctbal > 100 AND c_acctbal < 5000""")
def f9(spark, sf):
    c = filters.inside_box(table(spark, sf, "customer"), "c_nationkey", "c_acctbal", (4, 20), (100, 5000))
    return tidy(c.select("c_custkey", "c_nationkey", "c_acctbal"), 2)


@query("f10_group_threshold", ("part_survey",), """
SELECT lowest_taxon, count(*)::BIGINT AS stat FROM part_survey GROUP BY ALL HAVING count(*) < 20""")
def f10(spark, sf):
    return filters.groups_where(V.part_survey(spark, sf), ["lowest_taxon"], F.count(F.lit(1)), lambda c: c < 20)


# --- sort, limit, set operations ---------------------------------------------------------------

@query("t1_sorted", ("env",), f"""
SELECT site_code, collection_period, {r('x1')} AS x1 FROM env ORDER BY abs(x1) DESC NULLS LAST, site_code, collection_period""")
def t1(spark, sf):
    e = V.env(spark, sf).select(*KEYS, "x1")
    return tidy(e.orderBy(F.abs("x1").desc_nulls_last(), "site_code", "collection_period"))


@query("t2_best_per_group", ("totals",), f"""
SELECT site_code, {r('density', 2)} AS density, collection_period FROM (
  SELECT *, row_number() OVER (PARTITION BY site_code ORDER BY density, collection_period) AS k FROM totals) WHERE k = 1""")
def t2(spark, sf):
    t = V.totals(spark, sf).select(*KEYS, "density")
    return tidy(ranking.best_per_group(t, ["site_code"], "density", ["collection_period"]), 2)


@query("t3_distinct", ("survey",), "SELECT DISTINCT family, trait, lowest_taxon FROM survey")
def t3(spark, sf):
    return V.survey(spark, sf).select("family", "trait", "lowest_taxon").distinct()


@query("t4_union_by_name", ("totals",), f"""
SELECT site_code, collection_period, {r('density', 2)} AS density, NULL::DOUBLE AS biomass FROM totals WHERE collection_period < DATE '1998-01-01'
UNION ALL SELECT site_code, collection_period, NULL::DOUBLE, {r('biomass', 3)} FROM totals WHERE collection_period >= DATE '1998-01-01'""")
def t4(spark, sf):
    t = V.staged(V.totals(spark, sf))
    cut = F.lit("1998-01-01").cast("date")
    early = t.filter(F.col("collection_period") < cut).drop("biomass")
    late = t.filter(F.col("collection_period") >= cut).drop("density")
    return tidy(early.unionByName(late, allowMissingColumns=True), 3, density=2)


@query("w16_top_ranked", ("totals",), f"""
SELECT site_code, collection_period, {r('density', 2)} AS density FROM totals ORDER BY density DESC, site_code, collection_period LIMIT 20""")
def w16(spark, sf):
    t = V.totals(spark, sf).select(*KEYS, "density")
    return tidy(ranking.top_k(t, [F.col("density").desc(), F.col("site_code"), F.col("collection_period")], 20), 2)


# --- reshape -----------------------------------------------------------------------------------

@query("h1_melt", ("env",), f"""
SELECT site_code, collection_period, xvar, {r('xval')} AS xval FROM (
  SELECT site_code, collection_period, 'x1' AS xvar, x1 AS xval FROM env UNION ALL
  SELECT site_code, collection_period, 'x2', x2 FROM env UNION ALL
  SELECT site_code, collection_period, 'x3', x3 FROM env) WHERE xval IS NOT NULL""")
def h1(spark, sf):
    return tidy(reshape.melt(V.env(spark, sf), KEYS, ["x1", "x2", "x3"], drop_null=True))


SEASONS = list(D.SEASON_MONTHS)


@query("h2_pivot", ("survey",), f"""
SELECT site_code, {', '.join(f"{r(f'coalesce(sum(density) FILTER (WHERE quarter(collection_period) = {q}), 0)', 2)} AS q_{q}" for q in range(1, 5))}
FROM survey GROUP BY ALL""")
def h2(spark, sf):
    s = V.survey(spark, sf).groupBy("site_code", F.quarter("collection_period").cast("string").alias("q")).agg(
        F.sum("density").alias("density"))
    return tidy(reshape.spread(s, ["site_code"], "q", "density", ["1", "2", "3", "4"], fill=0.0, prefix="q_"), 2)


FIVE = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query("h3_transpose", ("flow",), f"""
SELECT xvar, {', '.join(f'''{r(f"max(v) FILTER (WHERE site_code = '{s}')", 2)} AS "{s}"''' for s in FIVE)} FROM (
  SELECT site_code, 'days' AS xvar, count(*)::DOUBLE AS v FROM flow GROUP BY ALL
  UNION ALL SELECT site_code, 'q_mean', avg(q) FROM flow GROUP BY ALL
  UNION ALL SELECT site_code, 'q_max', max(q) FROM flow GROUP BY ALL) GROUP BY ALL""")
def h3(spark, sf):
    f = V.flow(spark, sf).groupBy("site_code").agg(
        F.count(F.lit(1)).alias("days"), F.avg("q").alias("q_mean"), F.max("q").alias("q_max"))
    names = reshape.pivot_names(table(spark, sf, "region"), "r_name")
    return tidy(reshape.transpose(f, "site_code", ["days", "q_mean", "q_max"], names), 2)


@query("h4_zero_completion", ("survey",), f"""
WITH fs AS (SELECT site_code, collection_period, family, sum(density) AS density FROM survey GROUP BY ALL)
SELECT u.site_code, u.collection_period, i.family, {r('coalesce(s.density, 0)', 2)} AS density
FROM (SELECT DISTINCT site_code, collection_period FROM fs) u
CROSS JOIN (SELECT DISTINCT family FROM fs) i
LEFT JOIN fs s ON s.site_code = u.site_code AND s.collection_period = u.collection_period AND s.family = i.family""")
def h4(spark, sf):
    families = V.survey(spark, sf).groupBy(*KEYS, "family").agg(F.sum("density").alias("density"))
    return tidy(reshape.zero_complete(V.staged(families), KEYS, ["family"], "density"), 2)


@query("h5_summary_table", ("flow", "env"), f"""
SELECT g.r_name AS "Region", {r('f.q_med', 2)} AS "Flow Median", {r('e.x3', 6)} AS "Mean X3" FROM region g
LEFT JOIN (SELECT site_code, median(q) AS q_med FROM flow GROUP BY ALL) f ON f.site_code = g.r_name
LEFT JOIN (SELECT r_name, avg(x3) AS x3 FROM env JOIN nation ON n_name = site_code JOIN region ON r_regionkey = n_regionkey GROUP BY ALL) e ON e.r_name = g.r_name""")
def h5(spark, sf):
    sites = table(spark, sf, "region").select(F.col("r_name").alias("region"), "r_regionkey")
    flows = V.flow(spark, sf).groupBy(F.col("site_code").alias("region")).agg(F.median("q").alias("flow_median"))
    n = table(spark, sf, "nation").select(F.col("n_name").alias("site_code"), F.col("n_regionkey").alias("r_regionkey"))
    means = natural_join(V.env(spark, sf), n, "inner").groupBy("r_regionkey").agg(F.avg("x3").alias("mean_x3"))
    out = natural_join(natural_join(sites, flows), means).drop("r_regionkey")
    return tidy(select.rename_all(out, X.title_name), 6, **{"Flow Median": 2})


# --- scalar functions --------------------------------------------------------------------------

O = "CAST(o_orderdate AS DATE)"


def orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))


@query("x1_date_parts", sql=f"""
SELECT o_orderkey, year({O})::BIGINT AS year, month({O})::BIGINT AS month, day({O})::BIGINT AS day,
       dayofyear({O})::BIGINT AS nday, quarter({O})::BIGINT AS qtr FROM orders""")
def x1(spark, sf):
    return tidy(D.date_vars(orders(spark, sf), "d").drop("d", "year_week", "year_month"))


@query("x2_calendar_buckets", sql=f"""
SELECT o_orderkey, CAST(date_trunc('week', {O}) AS DATE) AS year_week, CAST(date_trunc('month', {O}) AS DATE) AS year_month,
       year({O})::VARCHAR || ' Q' || quarter({O})::VARCHAR AS quarter_label, strftime({O}, '%Y %b') AS month_label FROM orders""")
def x2(spark, sf):
    o = D.date_vars(orders(spark, sf), "d")
    return o.select("o_orderkey", "year_week", "year_month", D.quarter_label("d").alias("quarter_label"),
                    D.month_label("d").alias("month_label"))


def _lump(op: str, last: int = 20) -> str:
    m = f"CAST(date_trunc('month', {O}) AS DATE)"
    return f"CASE WHEN day({O}) {op} {last} THEN {m} ELSE CAST({m} + INTERVAL 1 MONTH AS DATE) END"


@query("x3_survey_period", sql=f"""
SELECT o_orderkey, CASE WHEN {O} = DATE '1999-03-21' THEN DATE '1999-03-01' ELSE {_lump('<=')} END AS period FROM orders""")
def x3(spark, sf):
    o = orders(spark, sf)
    keep = F.col("d") == F.lit("1999-03-21").cast("date")
    return o.select("o_orderkey", D.survey_period_with_exceptions("d", keep).alias("period"))


@query("x4_survey_period_strict", sql=f"SELECT o_orderkey, {_lump('<')} AS period FROM orders")
def x4(spark, sf):
    return orders(spark, sf).select("o_orderkey", D.survey_period("d", 20, inclusive=False).alias("period"))


@query("x5_survey_period_by_era", sql=f"""
SELECT o_orderkey, CASE WHEN {O} < DATE '2000-01-01' THEN {_lump('<=')} ELSE {_lump('<')} END AS period FROM orders""")
def x5(spark, sf):
    return orders(spark, sf).select("o_orderkey", D.survey_period_by_era("d", "2000-01-01").alias("period"))


@query("x6_season", sql=f"""
SELECT o_orderkey, CASE WHEN month({O}) IN (11, 12, 1, 2, 3) THEN 'Winter' WHEN month({O}) IN (4, 5, 6) THEN 'Spring'
  WHEN month({O}) IN (7, 8) THEN 'Summer' ELSE 'Fall' END AS season FROM orders""")
def x6(spark, sf):
    return orders(spark, sf).select("o_orderkey", D.season("d").alias("season"))


def _window_query(name, start, end, closed, inside, outside):
    lo = ">=" if closed in ("left", "both") else ">"
    hi = "<=" if closed in ("right", "both") else "<"

    @query(name, sql=f"""SELECT o_orderkey, CASE WHEN {O} {lo} DATE '{start}' AND {O} {hi} DATE '{end}' THEN '{inside}'
      ELSE '{outside}' END AS flag FROM orders""")
    def run(spark, sf):
        return orders(spark, sf).select("o_orderkey", D.flag_window("d", start, end, closed, inside, outside).alias("flag"))


_window_query("x7_test_or_baseline", "1997-04-20", "1998-03-31", "right", "test", "baseline")
_window_query("x8_test_open_window", "1997-06-01", "1998-09-01", "none", "test", "baseline")
_window_query("x9_rapid_response", "1997-08-27", "1998-03-31", "right", "yes", "no")
_window_query("x10_recovery_window", "1997-08-20", "1998-10-01", "none", "recovery", "other")


@query("x11_time_to_event", sql=f"""
SELECT o_orderkey, date_diff('day', DATE '1997-08-27', {O})::BIGINT AS days,
       ceil(date_diff('day', DATE '1997-08-27', {O}) / 7.0::DOUBLE)::BIGINT AS weeks,
       round_even(date_diff('day', DATE '1997-08-27', {O}) / 30.0::DOUBLE, 0)::BIGINT AS months FROM orders""")
def x11(spark, sf):
    return tidy(orders(spark, sf).select("o_orderkey", D.days_to("d", V.EVENT).alias("days"),
                                         D.weeks_to("d", V.EVENT).alias("weeks"),
                                         D.months_to("d", V.EVENT).cast("bigint").alias("months")))


@query("x12_month_sequence", sql="""
SELECT n_name AS site_code, CAST(m AS DATE) AS ymonth FROM nation, generate_series(DATE '1997-03-01', DATE '2000-12-01', INTERVAL 1 MONTH) t(m)""")
def x12(spark, sf):
    sites = table(spark, sf, "nation").select(F.col("n_name").alias("site_code"))
    return sites.withColumn("ymonth", F.explode(D.month_sequence("1997-03-01", 46)))


@query("x13_week_from_january", sql=f"SELECT o_orderkey, ((dayofyear({O}) - 1) // 7 + 1)::BIGINT AS week FROM orders")
def x13(spark, sf):
    return tidy(orders(spark, sf).select("o_orderkey", D.week_of_year("d").alias("week")))


@query("x14_math", sql=f"""
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {r('ln(l_extendedprice)')} AS ln_x, {r('exp(l_discount)')} AS exp_x,
       {r('sqrt(l_quantity)')} AS sqrt_x, {r('abs(l_tax - 0.05)')} AS abs_x, round_even(l_quantity / 2.0, 0)::BIGINT AS round_x,
       ceil(l_quantity / 3.0)::BIGINT AS ceil_x, {r('pow(l_discount, 2)')} AS pow_x FROM lineitem""")
def x14(spark, sf):
    q = F.col("l_quantity")
    return tidy(table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", N.ln_pos("l_extendedprice").alias("ln_x"), F.exp("l_discount").alias("exp_x"),
        F.sqrt(q).alias("sqrt_x"), F.abs(F.col("l_tax") - 0.05).alias("abs_x"),
        F.bround(q / 2.0, 0).cast("bigint").alias("round_x"), F.ceil(q / 3.0).alias("ceil_x"), F.pow("l_discount", F.lit(2)).alias("pow_x")))


@query("x15_guarded_infinity", sql=f"""
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {r('CASE WHEN l_discount > 0 THEN ln(l_discount) END')} AS ln_null,
       {r('CASE WHEN l_discount > 0 THEN ln(l_discount) ELSE -100000 END')} AS ln_flag,
       {r('l_tax / nullif(l_discount, 0)')} AS safe_ratio FROM lineitem""")
def x15(spark, sf):
    return tidy(table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", N.ln_pos("l_discount").alias("ln_null"), N.ln_or("l_discount", -100000.0).alias("ln_flag"),
        N.finite(N.ratio("l_tax", "l_discount")).alias("safe_ratio")))


@query("x16_text_functions", sql="""
SELECT p_partkey, replace(p_name, ' ', '_') AS snake, lower(p_brand) AS lower_brand, upper(p_name) AS upper_name,
       regexp_matches(p_name, 'ring') AS has_ring, substr(p_type, 1, 4) AS short_type, p_type || '-' || p_brand AS pasted,
       regexp_replace(p_brand, '#', ' No ') AS first_swap FROM part""")
def x16(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", F.regexp_replace("p_name", " ", "_").alias("snake"), F.lower("p_brand").alias("lower_brand"),
        F.upper("p_name").alias("upper_name"), F.col("p_name").rlike("ring").alias("has_ring"),
        F.substring("p_type", 1, 4).alias("short_type"), F.concat_ws("-", "p_type", "p_brand").alias("pasted"),
        F.regexp_replace("p_brand", "#", " No ").alias("first_swap"))


@query("x17_null_fill", ("env",), f"SELECT site_code, collection_period, {r('coalesce(x1, 0)')} AS x1, {r('coalesce(x2, x3)')} AS x2 FROM env")
def x17(spark, sf):
    return tidy(V.env(spark, sf).select(*KEYS, F.coalesce("x1", F.lit(0.0)).alias("x1"), F.coalesce("x2", "x3").alias("x2")))


@query("x18_clamp", ("env",), f"""
SELECT site_code, collection_period, {r('CASE WHEN x1 - 0.05 < 0 THEN 0 ELSE x1 - 0.05 END')} AS clamped FROM env""")
def x18(spark, sf):
    return tidy(V.env(spark, sf).select(*KEYS, N.clamp_low(F.col("x1") - 0.05).alias("clamped")))


@query("x19_distance", ("vectors",), f"SELECT vec_id, {r('sqrt((x1 - x3) * (x1 - x3) + (x2 - x4) * (x2 - x4))')} AS dist FROM vectors")
def x19(spark, sf):
    return tidy(V.vectors(spark, sf).select("vec_id", N.distance2("x1", "x2", "x3", "x4").alias("dist")))


@query("x20_name_repair", sql="""
SELECT p_partkey, CASE WHEN trim(regexp_replace(p_name || '..' || p_type, '[\\s.]+', ' ', 'g')) = 'small ring ECONOMY' THEN 'Small Ring Economy'
  ELSE trim(regexp_replace(p_name || '..' || p_type, '[\\s.]+', ' ', 'g')) END AS taxon FROM part""")
def x20(spark, sf):
    raw = F.concat("p_name", F.lit(".."), "p_type")
    return table(spark, sf, "part").select("p_partkey", X.repair_taxon(raw, {"small ring ECONOMY": "Small Ring Economy"}).alias("taxon"))


@query("x21_month_shift", sql=f"SELECT o_orderkey, (CASE WHEN month({O}) = 1 THEN 12 ELSE month({O}) - 1 END)::BIGINT AS month FROM orders")
def x21(spark, sf):
    return tidy(orders(spark, sf).select("o_orderkey", D.month_shift("d", -1).alias("month")))
