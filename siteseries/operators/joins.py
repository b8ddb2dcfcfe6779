"""Joins on all shared columns, complete grids and group statistics joined back to rows.

A side is broadcast only after its row count was checked (`broadcast_if_small`); beyond the bound the
plan stays a shuffle join, where adaptive execution splits skewed keys. Windows are used only over groups
of bounded size, because one site or taxon may hold a large part of all raw rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteseries.session import scratch_path
from siteseries.sources.files import stage

BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a table for broadcast when a bounded count shows that it has at most `max_rows` rows."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def settled(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Write a small result table once to the shared folder, and broadcast it when its counted rows allow.

    The count reads the written table, so the work behind it is not repeated for the check.
    """
    return broadcast_if_small(stage(df, scratch_path(df.sparkSession, "settled")), max_rows)


def _shared(left: DataFrame, right: DataFrame) -> list[str]:
    names = set(right.columns)
    keys = [c for c in left.columns if c in names]
    if not keys:
        raise ValueError("the tables share no column")
    return keys


def natural_join(left: DataFrame, right: DataFrame, how: str = "left",
                 keys: list[str] | None = None) -> DataFrame:
    """Join on every shared column, null matching null. `how`: inner, left, right, full, semi, anti."""
    keys = keys or _shared(left, right)
    l, r = left.alias("l"), right.alias("r")
    cond = reduce(Column.__and__, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    if how in ("semi", "anti"):
        return l.join(r, cond, f"left_{how}")
    rest_l = [c for c in left.columns if c not in keys]
    rest_r = [c for c in right.columns if c not in keys]
    joined = l.join(r, cond, how)
    if how in ("inner", "left"):
        key_cols = [F.col(f"l.{k}").alias(k) for k in keys]
    elif how == "right":
        key_cols = [F.col(f"r.{k}").alias(k) for k in keys]
    else:
        key_cols = [F.coalesce(F.col(f"l.{k}"), F.col(f"r.{k}")).alias(k) for k in keys]
    return joined.select(*key_cols, *[F.col(f"l.{c}") for c in rest_l], *[F.col(f"r.{c}") for c in rest_r])


def attach(df: DataFrame, dim: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Left natural join to a dimension table, settled first and broadcast when its count allows."""
    return natural_join(df, settled(dim, max_rows), "left")


def with_group_stats(df: DataFrame, keys: list[str], stats: dict[str, Column],
                     small: bool = False, bounded: bool = False) -> DataFrame:
    """Put statistics of each group on its rows.

    The default is a partial aggregation joined back on the keys, which never gathers a group in one
    task but reads its input twice (stage the input when it is costly). With `small=True` the
    statistics are settled and broadcast if within the bound, so that the rows are not shuffled at all.
    `bounded=True` is for groups whose size is limited by the calendar or a fixed list, such as the
    periods of a site in a table with one row per site and period: there one window reads the input once.
    """
    if bounded:
        group = Window.partitionBy(*keys)
        return df.withColumns({k: v.over(group) for k, v in stats.items()})
    table = df.groupBy(*keys).agg(*[v.alias(k) for k, v in stats.items()])
    if small:
        table = settled(table)
    return natural_join(df, table, "left", keys)


def only_in(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left whose key never occurs on the right (nulls compare as equal)."""
    return natural_join(left, right.select(*keys).distinct(), "anti", keys)


def restrict_to(left: DataFrame, flagged: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left whose key occurs among the flagged events."""
    return natural_join(left, flagged.select(*keys).distinct(), "semi", keys)


def key_grid(keys: DataFrame, name: str, values: Column) -> DataFrame:
    """Every distinct key with every element of a literal array: a row-local explode, no cross join."""
    return keys.distinct().withColumn(name, F.explode(values))


GRID_BLOCK = 1024
GRID_BROADCAST_BLOCKS = 1000


def full_grid(units: DataFrame, items: DataFrame) -> DataFrame:
    """Every distinct unit with every distinct item (the result is units x items long by definition).

    Items are packed into list rows of about a thousand items. Each unit meets every list row and unfolds
    it locally, so single rows are never repeated through a shuffle. Up to a thousand list rows (a million
    items) are broadcast; beyond that units and list rows meet by block number.
    """
    names = items.columns
    listed = settled(items.distinct())
    blocks = -(-listed.count() // GRID_BLOCK) or 1
    packed = (listed.withColumn("_block", F.pmod(F.xxhash64(*names), F.lit(blocks)))
              .groupBy("_block").agg(F.collect_list(F.struct(*names)).alias("_items")))
    packed = settled(packed, GRID_BROADCAST_BLOCKS)
    lanes = F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")
    return (units.distinct().withColumn("_block", F.explode(lanes)).join(packed, "_block")
            .select(*units.columns, F.explode("_items").alias("_i"))
            .select(*units.columns, *[F.col(f"_i.{c}").alias(c) for c in names]))


def on_grid(grid: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts on a complete grid; cells without facts become null rows."""
    return natural_join(grid, facts, "left")
