"""Wide and long forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteseries.operators.joins import full_grid, natural_join

MAX_PIVOT = 2000


def melt(df: DataFrame, ids: list[str], names: list[str] | None = None, to: tuple[str, str] = ("xvar", "xval"),
         drop_null: bool = False) -> DataFrame:
    """Columns to (name, value) rows."""
    names = names or [c for c in df.columns if c not in ids]
    out = df.select(*ids, *[F.col(n).cast("double").alias(n) for n in names]).unpivot(ids, names, to[0], to[1])
    return out.filter(F.col(to[1]).isNotNull()) if drop_null else out


def pivot_names(df: DataFrame, name: str, limit: int = MAX_PIVOT) -> list:
    """The distinct values that become columns; refuses sets too wide for a table schema."""
    rows = df.select(name).filter(F.col(name).isNotNull()).distinct().orderBy(name).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{name} has more than {limit} values; keep the table long")
    return [r[0] for r in rows]


def spread(df: DataFrame, keys: list[str], name: str, value: str | Column, names: list | None = None,
           fill=None, prefix: str = "", how=F.first) -> DataFrame:
    """(name, value) rows to columns. `names` makes the plan static; without it they are read first."""
    names = names if names is not None else pivot_names(df, name)
    cell = F.col(value) if isinstance(value, str) else value
    out = df.groupBy(*keys).pivot(name, names).agg(how(cell))
    made = [str(n) for n in names]
    if fill is not None:
        out = out.fillna(fill, subset=made)
    return out.withColumnsRenamed({n: prefix + n for n in made}) if prefix else out


def transpose(df: DataFrame, row_key: str, names: list[str], row_values: list, label: str = "xvar") -> DataFrame:
    """Swap rows and columns of a small summary table."""
    return spread(melt(df, [row_key], names, (label, "value")), [label], row_key, "value", row_values)


def zero_complete(df: DataFrame, unit: list[str], item: list[str], value: str) -> DataFrame:
    """Every item in every unit, 0 where it was not recorded."""
    grid = full_grid(df.select(*unit), df.select(*item))
    facts = df.groupBy(*unit, *item).agg(F.sum(value).alias(value))
    return natural_join(grid, facts, "left").withColumn(value, F.coalesce(F.col(value), F.lit(0.0)))
