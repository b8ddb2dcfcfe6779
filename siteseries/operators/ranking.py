"""Exact ranks and quantiles without gathering a group in one task.

Ties are first folded to (group, value, count) rows. A range exchange then spreads these over buckets of
any orderable type, ranks are counted inside each (group, bucket), and a small table of bucket totals gives
the offset. The cut points only steer how rows spread; ranks and quantiles are exact for any cut points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteseries.operators.joins import natural_join
from siteseries.session import scratch_path
from siteseries.sources.files import stage

BUCKETS = 128
BUCKET_ROWS = 2_000_000
GROUP_ROWS = 200_000


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Row count of the largest group (partial counts, one row to the driver)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def _range_parts(folded: DataFrame, keys: list[str], value: str, parts: int) -> DataFrame:
    """The rows dealt to `parts` ranges of (group, value), written once with their range number as `bucket`.

    The exchange samples its cut points afresh on every run, so later steps read the written numbers.
    """
    spread = folded.repartitionByRange(parts, *keys, value).withColumn("bucket", F.spark_partition_id())
    return stage(spread, scratch_path(folded.sparkSession, "ranges"))


def cumulative_counts(df: DataFrame, keys: list[str], value: str, buckets: int | None = None,
                      group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per (group, value): n equal values, `below` smaller ones, `total` in the group.

    Groups are counted first: when the largest has at most `group_rows` rows an ordinary window per group
    does; otherwise a range exchange on (group, value) spreads them over buckets of about two million rows.
    Ranges are contiguous, so all groups together have at most one total per group and one per bucket. Both ways
    give the same rows for every orderable type, and groups with null keys are groups like others.
    """
    rows = df.filter(F.col(value).isNotNull())
    folded = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("largest"), F.sum("n").alias("rows")).first()
    if (sizes["largest"] or 0) <= group_rows:
        order = Window.partitionBy(*keys).orderBy(value)
        return folded.select(*keys, value, "n", (F.sum("n").over(order) - F.col("n")).alias("below"),
                             F.sum("n").over(Window.partitionBy(*keys)).alias("total"))
    parts = buckets or max(BUCKETS, sizes["rows"] // BUCKET_ROWS)
    folded = _range_parts(folded, keys, value, parts)
    totals = folded.groupBy(*keys, "bucket").agg(F.sum("n").alias("bn"))
    by_bucket = Window.partitionBy(*keys).orderBy("bucket")
    totals = totals.select(
        *keys, "bucket",
        (F.sum("bn").over(by_bucket) - F.col("bn")).alias("offset"),
        F.sum("bn").over(Window.partitionBy(*keys)).alias("total"))
    inside = Window.partitionBy(*keys, "bucket").orderBy(value)
    return (natural_join(folded, totals, "inner", [*keys, "bucket"])
            .withColumn("below", F.sum("n").over(inside) - F.col("n") + F.col("offset"))
            .select(*keys, value, "n", "below", "total"))


def ranked(df: DataFrame, keys: list[str], value: str, name: str = "rank", ties: str = "average") -> DataFrame:
    """Rank of each row's value in its group. `ties`: average or min. Adds `<name>` and `<name>_n`."""
    counts = cumulative_counts(df, keys, value)
    rank = F.col("below") + (F.lit(1.0) + F.col("n")) / 2.0 if ties == "average" else F.col("below") + 1
    table = counts.select(*keys, value, rank.alias(name), F.col("total").alias(f"{name}_n"))
    return natural_join(df, table, "inner", [*keys, value]).select(*df.columns, name, f"{name}_n")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                    group_rows: int = GROUP_ROWS) -> DataFrame:
    """Interpolated quantiles (position (n-1)p) per group.

    The built-in exact percentile buffers the distinct values of a group, so it is used only when the
    largest group was counted to be within `group_rows`; beyond that the value counts are ranked in buckets.
    """
    rows = df.filter(F.col(value).isNotNull()).withColumn(value, F.col(value).cast("double"))
    if largest_group(rows, keys) <= group_rows:
        return rows.groupBy(*keys).agg(*[F.percentile(value, F.lit(p)).alias(n) for n, p in probs.items()])
    counts = cumulative_counts(rows, keys, value, group_rows=0)

    def at(position: Column) -> Column:
        hit = (F.col("below") <= position) & (position < F.col("below") + F.col("n"))
        return F.max(F.when(hit, F.col(value)))

    parts = []
    for name, p in probs.items():
        where = (F.col("total") - 1) * F.lit(p)
        parts += [at(F.floor(where)).alias(f"_lo_{name}"), at(F.ceil(where)).alias(f"_hi_{name}")]
    out = counts.groupBy(*keys).agg(F.max("total").alias("_n"), *parts)
    made = []
    for name, p in probs.items():
        where = (F.col("_n") - 1) * F.lit(p)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        share = where - F.floor(where)  # the same arithmetic as the built-in percentile
        made.append(F.when(share == 0, lo).otherwise((F.ceil(where) - where) * lo + share * hi).alias(name))
    return out.select(*keys, *made)


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """First k rows: each task keeps k, one task merges."""
    return df.orderBy(*order).limit(k)


def best_per_group(df: DataFrame, keys: list[str], metric: str, payload: list[str]) -> DataFrame:
    """Payload of the row with the smallest metric, ties by payload order; combines map-side."""
    best = F.min(F.struct(metric, *payload)).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, "_b.*")
