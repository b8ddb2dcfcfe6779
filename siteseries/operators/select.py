"""Projection and schema operators. Column sets are resolved on the driver; the plan stays static."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteseries.functions.text import snake_name

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def keep_existing(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Keep those of `names` that the table has, in the order given."""
    return df.select([n for n in names if n in df.columns])


def drop_existing(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.drop(*names)


def names_matching(df: DataFrame, pattern: str) -> list[str]:
    return [c for c in df.columns if re.search(pattern, c)]


def names_between(df: DataFrame, first: str, last: str) -> list[str]:
    cols = df.columns
    return cols[cols.index(first): cols.index(last) + 1]


def numeric_names(df: DataFrame, but: Iterable[str] = ()) -> list[str]:
    skip = set(but)
    return [c for c, t in df.dtypes if c not in skip and (t in NUMERIC or t.startswith("decimal"))]


def to_front(df: DataFrame, names: Iterable[str]) -> DataFrame:
    head = list(names)
    return df.select(head + [c for c in df.columns if c not in head])


def rename_all(df: DataFrame, fn: Callable[[str], str], but: Iterable[str] = ()) -> DataFrame:
    skip = set(but)
    return df.toDF(*[c if c in skip else fn(c) for c in df.columns])


def rename_regex(df: DataFrame, pattern: str, repl: str, but: Iterable[str] = ()) -> DataFrame:
    return rename_all(df, lambda c: re.sub(pattern, repl, c), but)


def add_prefix(df: DataFrame, prefix: str, but: Iterable[str] = ()) -> DataFrame:
    return rename_all(df, lambda c: prefix + c, but)


def snake_columns(df: DataFrame) -> DataFrame:
    return rename_all(df, snake_name)


def restore_names(names: Iterable[str], prefixes: dict[str, Iterable[str]]) -> list[str]:
    """Give each name the prefix of the set it belongs to; other names stay."""
    lookup = {n: p + n for p, group in prefixes.items() for n in group}
    return [lookup.get(n, n) for n in names]


def categorise(cases: list[tuple[Column, object]], otherwise: object | None = None) -> Column:
    """First matching label; a null condition does not match, no match gives `otherwise`."""
    out = None
    for cond, label in cases:
        label = label if isinstance(label, Column) else F.lit(label)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out if otherwise is None else out.otherwise(otherwise)


def pack_key(df: DataFrame, name: str, parts: list[str], sep: str = "_") -> DataFrame:
    """Replace several key columns by one text key."""
    packed = F.concat_ws(sep, *[F.col(p).cast("string") for p in parts]).alias(name)
    return df.select(packed, *[c for c in df.columns if c not in parts])


def unpack_key(df: DataFrame, name: str, parts: dict[str, str], sep: str = "_") -> DataFrame:
    """Split a text key into typed columns; `parts` maps new column names to types."""
    cells = F.split(F.col(name), re.escape(sep))
    made = [cells.getItem(i).cast(t).alias(n) for i, (n, t) in enumerate(parts.items())]
    return df.select(*made, *[c for c in df.columns if c != name])


def number_from_label(c: str) -> Column:
    """Number inside a label such as 'RDA1 (22.1%)': the part in brackets, without the percent sign."""
    return F.regexp_extract(F.col(c), r"\(([-0-9.]+)%?\)", 1).cast("double")


def order_key(c: str, ordered: list) -> Column:
    """Position of a category in an explicit order; null when it is not listed."""
    position = F.array_position(F.array(*[F.lit(v) for v in ordered]), F.col(c))
    return F.when(position > 0, position)
