"""Registry of queries and the shared output conventions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteseries.plans.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Results are rounded on a grid shifted off the exact decimal ties, so that the last-bit noise of a
# distributed sum cannot flip a digit. Both sides use the same shift.
SHIFT = 0.0137


def query(name: str, views: tuple[str, ...] = (), sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_views(sql, views)
        return fn
    return add


def rnd(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(SHIFT * 10.0 ** -digits), digits) + F.lit(0.0)


def r(expr: str, digits: int = 6) -> str:
    """SQL text of `rnd`."""
    return f"(round(({expr}) + {SHIFT * 10.0 ** -digits!r}::DOUBLE, {digits}) + 0.0::DOUBLE)"


def tidy(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double (per-column digits in `special`) and widen every integer, for comparison."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = rnd(c.cast("double"), special.get(name, digits))
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        cols.append(c.alias(name))
    return df.select(*cols)
