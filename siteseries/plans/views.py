"""Panel-shaped views of the given tables, as DataFrames and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteseries.functions.dates import season
from siteseries.operators.diversity import hill_columns
from siteseries.operators.joins import broadcast_if_small, natural_join
from siteseries.session import scratch_path
from siteseries.sources.files import stage, table

TEST = ("1997-06-01", "1998-09-01")
EVENT = "1997-08-27"
TASK_ROWS = 2_000_000  # lines that one task sorts, and rows that it keeps in a hash table, when a table is large


def _day(c: str):
    return F.col(c).cast("date")


def survey_months(totals: DataFrame, period: str = "collection_period") -> tuple[str, int]:
    """First month of the data and the number of months up to the last."""
    first, last = totals.agg(F.min(period), F.max(period)).first()
    if first is None:
        return "1970-01-01", 0
    return f"{first:%Y-%m}-01", (last.year - first.year) * 12 + last.month - first.month + 1


def survey_years(totals: DataFrame, period: str = "collection_period") -> list[int]:
    """All years from the first to the last of the data."""
    first, last = totals.agg(F.min(F.year(period)), F.max(F.year(period))).first()
    return [] if first is None else list(range(first, last + 1))


def spread(rows: DataFrame, count: int, key: str) -> DataFrame:
    """Rows dealt by key over more tasks than usual where each would get over `TASK_ROWS`. For keys without large groups only,
    as adaptive execution does not split these tasks."""
    n = -(-count // TASK_ROWS)
    return rows.repartition(n, key) if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def looked_up(side: DataFrame, count: int) -> DataFrame:
    """A side that is kept in hash tables by parts, so that the rows that meet it need no sort, if its parts are small enough."""
    parts = int(side.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return side.hint("shuffle_hash") if TASK_ROWS // 8 < count <= TASK_ROWS * parts else side


def line_places(spark: SparkSession, sf: str, at_least: float | None = None) -> DataFrame:
    """One row per order line with the key of its site and the period.

    Rows stay narrow, and a task sorts a bounded number of them: an order has few lines, so they spread evenly. How each side
    travels is else left to the size estimates of the scans and to adaptive execution.
    """
    places = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("site_no"))
    orders = (table(spark, sf, "orders").select("o_orderkey", "o_custkey", _day("o_orderdate").alias("collection_date"))
              .join(places, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey"))
    lines = table(spark, sf, "lineitem")
    count = lines.count()
    lines = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    if at_least is not None:
        lines = lines.filter(F.col("l_quantity") >= at_least)
    lines = spread(lines, count, "l_orderkey")
    return (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .withColumn("collection_period", F.trunc("collection_date", "month")))


def site_named(rows: DataFrame, sf: str) -> DataFrame:
    """Site and site group for the key of the site; the names are a row per nation, so the rows need not travel for them."""
    spark = rows.sparkSession
    names = (table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
             .select("n_nationkey", F.col("n_name").alias("site_code"), F.col("r_name").alias("site_group")))
    return rows.join(broadcast_if_small(names), F.col("site_no") == F.col("n_nationkey")).drop("site_no", "n_nationkey")


def line_sites(spark: SparkSession, sf: str, at_least: float | None = None) -> DataFrame:
    """One row per order line with site and period."""
    return site_named(line_places(spark, sf, at_least), sf)


def line_surveys(spark: SparkSession, sf: str, at_least: float | None = None) -> DataFrame:
    """`line_sites` with the taxon of the part."""
    parts = table(spark, sf, "part")
    parts = looked_up(parts.select("p_partkey", F.concat_ws(" ", "p_type", "p_brand").alias("lowest_taxon"),
                                   F.col("p_type").alias("family"), F.col("p_brand").alias("trait")), parts.count())
    return site_named(line_places(spark, sf, at_least).join(parts, F.col("l_partkey") == F.col("p_partkey")), sf)


def totals(spark: SparkSession, sf: str) -> DataFrame:
    """One row per survey. Every line has a part, so the parts need not be joined for totals."""
    return line_sites(spark, sf).groupBy("site_code", "collection_period").agg(
        F.sum("l_quantity").alias("density"), (F.sum("l_extendedprice") / 1000.0).alias("biomass"))


def survey(spark: SparkSession, sf: str, at_least: float | None = None) -> DataFrame:
    """One row per site, period and taxon. The labels that depend on those keys are grouped by, not carried along: sums alone
    are kept in a hash table as long as the result, while strings among the aggregates would have every line sorted."""
    return line_surveys(spark, sf, at_least).groupBy("site_code", "collection_period", "lowest_taxon", "site_group", "family", "trait").agg(
        F.sum("l_quantity").alias("density"), (F.sum("l_extendedprice") / 1000.0).alias("biomass"))


def rare_survey(spark: SparkSession, sf: str) -> DataFrame:
    return survey(spark, sf, 49.0)


def part_survey(spark: SparkSession, sf: str) -> DataFrame:
    """Every line at its sparsest natural grain: each part is a taxon of its own, with some thirty lines at any scale."""
    return line_sites(spark, sf).groupBy("site_code", "collection_period", F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("lowest_taxon")).agg(
        F.sum("l_quantity").alias("density"))


def individual(spark: SparkSession, sf: str) -> DataFrame:
    return line_surveys(spark, sf).select(
        "site_code", "collection_period", "family", "lowest_taxon", (F.col("l_extendedprice") / 1000.0).alias("lengthmm"))


def site_dim(spark: SparkSession, sf: str) -> DataFrame:
    """One row per nation: at most 25 rows, whatever the scale."""
    rain = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("annualrain"))
    return (table(spark, sf, "nation").join(rain, F.col("n_nationkey") == F.col("c_nationkey"))
            .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("n_name").alias("site_code"), F.col("r_name").alias("site_group"), "annualrain",
                    F.col("n_nationkey").alias("site_no")))


def flow(spark: SparkSession, sf: str) -> DataFrame:
    regions = (table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
               .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
               .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
               .select("s_suppkey", F.col("r_name").alias("site_code")))
    # days of one supplier are summed before the supplier is looked up
    daily = table(spark, sf, "lineitem").groupBy("l_suppkey", _day("l_shipdate").alias("d")).agg(
        F.sum("l_extendedprice").alias("q"))
    return (daily.join(regions, F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy("site_code", "d").agg(F.sum("q").alias("q")))


def env(spark: SparkSession, sf: str) -> DataFrame:
    places = (table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
              .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
              .select("s_suppkey", "s_nationkey", F.col("n_name").alias("site_code")))
    base = (table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", "l_discount", "l_tax", "l_quantity")
            .join(places, F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy("site_code", "s_nationkey", F.trunc(_day("l_shipdate"), "month").alias("collection_period"))
            .agg(F.avg("l_discount").alias("a1"), F.avg("l_tax").alias("a2"), F.avg("l_quantity").alias("a3")))
    gap = (F.month("collection_period") + F.col("s_nationkey")) % 4
    return base.select("site_code", "collection_period",
                       *[F.when(gap != i, F.col(f"a{i + 1}")).alias(f"x{i + 1}") for i in range(3)])


VECTOR_SIZE = 64  # of the embeddings
VECTOR_COLUMNS = [f"x{i}" for i in range(1, VECTOR_SIZE + 1)]


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"x{i + 1}") for i in range(VECTOR_SIZE)])


def staged(df: DataFrame) -> DataFrame:
    """A view written once for queries that read it several times, instead of repeating its joins."""
    return stage(df, scratch_path(df.sparkSession, "view"))


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """One row per survey: totals, diversity, rainfall of the site and season, from one pass over the survey."""
    out = survey(spark, sf).groupBy("site_code", "collection_period").agg(
        F.sum("density").alias("density"), F.sum("biomass").alias("biomass"),
        *[c.alias(n) for n, c in hill_columns("density").items()])
    out = natural_join(out, site_dim(spark, sf).select("site_code", "site_group", "annualrain"), "left", ["site_code"])
    return out.withColumns({"season": season("collection_period"), "richness": F.col("richness").cast("double")})


CTE = {
    "survey": ((), """
survey AS (
  SELECT n.n_name AS site_code, g.r_name AS site_group,
         CAST(date_trunc('month', o.o_orderdate) AS DATE) AS collection_period,
         p.p_type || ' ' || p.p_brand AS lowest_taxon, p.p_type AS family, p.p_brand AS trait,
         sum(l.l_quantity) AS density, sum(l.l_extendedprice) / 1000.0::DOUBLE AS biomass
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region g ON n.n_regionkey = g.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey GROUP BY ALL)"""),
    "rare_survey": ((), """
rare_survey AS (
  SELECT n.n_name AS site_code, g.r_name AS site_group,
         CAST(date_trunc('month', o.o_orderdate) AS DATE) AS collection_period,
         p.p_type || ' ' || p.p_brand AS lowest_taxon, p.p_type AS family, p.p_brand AS trait,
         sum(l.l_quantity) AS density, sum(l.l_extendedprice) / 1000.0::DOUBLE AS biomass
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region g ON n.n_regionkey = g.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey WHERE l.l_quantity >= 49 GROUP BY ALL)"""),
    "part_survey": ((), """
part_survey AS (
  SELECT n.n_name AS site_code, CAST(date_trunc('month', o.o_orderdate) AS DATE) AS collection_period,
         'part ' || l.l_partkey::VARCHAR AS lowest_taxon, sum(l.l_quantity) AS density
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY ALL)"""),
    "individual": ((), """
individual AS (
  SELECT n.n_name AS site_code, CAST(date_trunc('month', o.o_orderdate) AS DATE) AS collection_period,
         p.p_type AS family, p.p_type || ' ' || p.p_brand AS lowest_taxon, l.l_extendedprice / 1000.0::DOUBLE AS lengthmm
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN part p ON l.l_partkey = p.p_partkey)"""),
    "site_dim": ((), """
site_dim AS (
  SELECT n.n_name AS site_code, g.r_name AS site_group, avg(c.c_acctbal) AS annualrain, n.n_nationkey AS site_no
  FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN region g ON n.n_regionkey = g.r_regionkey
  GROUP BY ALL)"""),
    "flow": ((), """
flow AS (
  SELECT g.r_name AS site_code, CAST(l.l_shipdate AS DATE) AS d, sum(l.l_extendedprice) AS q
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region g ON n.n_regionkey = g.r_regionkey GROUP BY ALL)"""),
    "env": ((), """
env0 AS (
  SELECT n.n_name AS site_code, s.s_nationkey AS k, CAST(date_trunc('month', l.l_shipdate) AS DATE) AS collection_period,
         avg(l.l_discount) AS a1, avg(l.l_tax) AS a2, avg(l.l_quantity) AS a3
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY ALL),
env AS (
  SELECT site_code, collection_period,
         CASE WHEN (month(collection_period) + k) % 4 <> 0 THEN a1 END AS x1,
         CASE WHEN (month(collection_period) + k) % 4 <> 1 THEN a2 END AS x2,
         CASE WHEN (month(collection_period) + k) % 4 <> 2 THEN a3 END AS x3 FROM env0)"""),
    "vectors": ((), """
vectors AS (
  SELECT vec_id, label, """ + ", ".join(f"embedding[{i}]::DOUBLE AS x{i}" for i in range(1, VECTOR_SIZE + 1)) + """ FROM embeddings)"""),
    "totals": (("survey",), """
totals AS (
  SELECT site_code, collection_period, sum(density) AS density, sum(biomass) AS biomass FROM survey GROUP BY ALL)"""),
    "hill": (("survey", "totals"), """
hill AS (
  SELECT s.site_code, s.collection_period, count(*) AS richness,
         exp(-sum(s.density / t.density * ln(s.density / t.density))) AS shannon,
         1.0 / sum((s.density / t.density) * (s.density / t.density)) AS simpson
  FROM survey s JOIN totals t USING (site_code, collection_period) WHERE s.density > 0 GROUP BY ALL)"""),
    "outcomes": (("survey", "totals", "hill", "site_dim"), """
outcomes AS (
  SELECT t.site_code, t.collection_period, t.density, t.biomass, h.richness::DOUBLE AS richness, h.shannon, h.simpson,
         d.site_group, d.annualrain,
         CASE WHEN month(t.collection_period) IN (11, 12, 1, 2, 3) THEN 'Winter'
              WHEN month(t.collection_period) IN (4, 5, 6) THEN 'Spring'
              WHEN month(t.collection_period) IN (7, 8) THEN 'Summer' ELSE 'Fall' END AS season
  FROM totals t LEFT JOIN hill h USING (site_code, collection_period) LEFT JOIN site_dim d USING (site_code))"""),
}


def with_views(sql: str, names: tuple[str, ...]) -> str:
    """Prefix a query with the views it needs; the query may itself start with further `name AS (...)` parts."""
    need: list[str] = []

    def visit(name: str) -> None:
        for dep in CTE[name][0]:
            visit(dep)
        if name not in need:
            need.append(name)

    for n in names:
        visit(n)
    body = sql.strip()
    parts = [CTE[n][1].strip() for n in need]
    if body.startswith("WITH "):
        return "WITH " + ",\n".join([*parts, body[5:].strip()])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
