"""Dense ranks of a distributed table within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteseries.llm.common import sized, staged


def ranked(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Written `rows` with `rank` (from 0, by `order` within `group`, nulls first) and `of` (rows of the group).

    Rows are dealt by ranges of (group, order), so a group of any size lies in as many tasks as it needs. A row's rank is
    its place in its task plus the rows of its group in the tasks before; only these counts are gathered, one a task and
    group. `group` must not be null, and rows equal in `group` and `order` must be interchangeable.
    """
    keys = [group, *order]
    laid = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    laid = staged(laid.withColumn("at", F.monotonically_increasing_id()).withColumn("task", F.shiftright("at", 33)), name)
    counts = laid.groupBy(group, "task").agg(F.count("*").alias("n"), F.min("at").alias("low"))
    counts = staged(counts, f"{name}-counts")
    earlier = W.partitionBy(group).orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(group, "task", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("low")).alias("shift"))
    starts = staged(starts.join(counts.groupBy(group).agg(F.sum("n").alias("of")), group), f"{name}-starts")
    return (laid.join(sized(starts), [group, "task"])
            .select(*rows.columns, (F.col("at") + F.col("shift")).alias("rank"), "of"))
