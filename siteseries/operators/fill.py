"""Gap filling on panels with one row per site and period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteseries.functions.numeric import ratio
from siteseries.operators.joins import with_group_stats


def _weighted_neighbours(c: str, order: Window, k: int) -> tuple[Column, Column, Column]:
    """(sum of weights x values, sum of weights, number of values) among the k rows on either side."""
    num = den = cnt = None
    for d in range(1, k + 1):
        w = 1.0 / (d + 1)
        for near in (F.lag(c, d).over(order), F.lead(c, d).over(order)):
            a, b = F.coalesce(near * F.lit(w), F.lit(0.0)), F.when(near.isNotNull(), w).otherwise(0.0)
            one = F.when(near.isNotNull(), 1).otherwise(0)
            num = a if num is None else num + a
            den = b if den is None else den + b
            cnt = one if cnt is None else cnt + one
    return num, den, cnt


def moving_average_fill(df: DataFrame, keys: list[str], order: str, cols: list[str], k: int = 4) -> DataFrame:
    """Replace nulls by the distance-weighted mean (weight 1/(d+1)) of up to k rows on either side.

    Needs two values among the neighbours; wider gaps stay null (see `moving_average_fill_widening`).
    """
    w = Window.partitionBy(*keys).orderBy(order)
    made = {}
    for c in cols:
        num, den, cnt = _weighted_neighbours(c, w, k)
        made[c] = F.when(F.col(c).isNotNull(), F.col(c)).when(cnt >= 2, ratio(num, den))
    return df.withColumns(made)


def moving_average_fill_widening(df: DataFrame, keys: list[str], order: str, cols: list[str], k: int = 4) -> DataFrame:
    """As above, but the span grows until it holds two values.

    For a null at position p the span must reach the second-nearest value in either direction. The two
    last values before and the two first values after p give that radius. The widest radius of each column
    (one row to the driver) then limits the frame in which values are gathered. All windows run over one
    row per key and period.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    out = df.withColumn("_p", F.row_number().over(w))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    # what follows, as a running frame in descending order
    after = Window.partitionBy(*keys).orderBy(F.col("_p").desc()).rowsBetween(Window.unboundedPreceding, -1)
    for i, c in enumerate(cols):
        known = F.when(F.col(c).isNotNull(), F.col("_p"))
        out = out.withColumns({"_b1": F.max(known).over(before), "_a1": F.min(known).over(after)})
        # position of the second value away: the neighbour of the first one, on its far side
        out = out.withColumns({
            "_b2": F.max(F.when(F.col(c).isNotNull(), F.col("_b1"))).over(before),
            "_a2": F.min(F.when(F.col(c).isNotNull(), F.col("_a1"))).over(after)})
        gaps = F.array_sort(F.filter(F.array(
            F.col("_p") - F.col("_b1"), F.col("_p") - F.col("_b2"),
            F.col("_a1") - F.col("_p"), F.col("_a2") - F.col("_p")), lambda g: g.isNotNull()))
        # second-nearest distance, but never below k
        radius = F.when(F.col(c).isNull() & (F.size(gaps) >= 2), F.greatest(F.lit(k), F.element_at(gaps, 2)))
        out = out.withColumn(f"_r{i}", radius).drop("_b1", "_b2", "_a1", "_a2")
    widest = out.agg(*[F.max(f"_r{i}").alias(f"_r{i}") for i in range(len(cols))]).first()
    for i, c in enumerate(cols):
        reach = widest[f"_r{i}"]
        if reach is None:
            continue
        cells = F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col("_p").alias("p"), F.col(c).alias("v"))))
        out = out.withColumn("_s", cells.over(w.rowsBetween(-reach, reach)))
        radius = F.col(f"_r{i}")
        near = F.filter("_s", lambda e: F.abs(e["p"] - F.col("_p")) <= radius)

        def weight(e):
            return 1.0 / (F.abs(e["p"] - F.col("_p")) + 1.0)

        num = F.aggregate(near, F.lit(0.0), lambda s, e: s + e["v"] * weight(e))
        den = F.aggregate(near, F.lit(0.0), lambda s, e: s + weight(e))
        out = out.withColumn(c, F.coalesce(F.col(c), F.when(radius.isNotNull(), ratio(num, den)))).drop("_s")
    return out.drop("_p", *[f"_r{i}" for i in range(len(cols))])


def group_mean_impute(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Replace nulls by the mean of the group, all columns at once. One row per key and period is assumed."""
    rows = with_group_stats(df, keys, {f"_mu_{c}": F.avg(c) for c in cols}, bounded=True)
    return rows.withColumns({c: F.coalesce(F.col(c), F.col(f"_mu_{c}")) for c in cols}).drop(*[f"_mu_{c}" for c in cols])
