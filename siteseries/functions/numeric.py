"""Numeric column expressions with one fixed meaning for zero, null and NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ln_pos(c: Column | str) -> Column:
    """Natural log; null for zero or negative input."""
    c = col(c)
    return F.when(c > 0, F.ln(c))


def ln_or(c: Column | str, sentinel: float) -> Column:
    """Natural log with a sentinel in place of minus infinity; null stays null."""
    c = col(c)
    return F.when(c > 0, F.ln(c)).when(c == 0, F.lit(float(sentinel)))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(col(a), col(b))


def sum0(c: Column | str) -> Column:
    """Sum that is 0 for a group without values."""
    return F.coalesce(F.sum(col(c)), F.lit(0.0))


def clamp_low(c: Column | str, low: float = 0.0) -> Column:
    """Raise values below `low` to it; null stays null."""
    c = col(c)
    return F.when(c < low, F.lit(low)).otherwise(c)


def finite(c: Column | str) -> Column:
    """Null for NaN and infinities."""
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into null in every floating column (done once, at ingest)."""
    wide = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in wide}) if wide else df


def distance2(x1, y1, x2, y2) -> Column:
    """Euclidean distance in the plane."""
    return F.sqrt(F.pow(col(x1) - col(x2), 2) + F.pow(col(y1) - col(y2), 2))


def row_mean(cols: list[str]) -> Column:
    """Mean over columns of one row; null when any is null."""
    total = F.col(cols[0])
    for c in cols[1:]:
        total = total + F.col(c)
    return total / F.lit(float(len(cols)))


def row_sum_squares(cols: list[str]) -> Column:
    """Sum of squares over columns of one row; null when any is null."""
    total = F.col(cols[0]) * F.col(cols[0])
    for c in cols[1:]:
        total = total + F.col(c) * F.col(c)
    return total


def seeded_hash(seed: int | str, *keys: Column | str) -> Column:
    """32 hex digits fixed by the seed and the row key: stable under any partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in keys]))


def seeded_uniform(seed: int | str, *keys: Column | str) -> Column:
    """A number in [0, 1) fixed by the seed and the row key."""
    head = F.substring(seeded_hash(seed, *keys), 1, 8)
    return F.conv(head, 16, 10).cast("bigint") / F.lit(4294967296.0)


# Coefficients of the published rational approximation of the normal quantile
# (relative error below 1.2e-9).
QUANTILE_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
              1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
QUANTILE_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
              6.680131188771972e01, -1.328068155288572e01)
QUANTILE_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
              -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
QUANTILE_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
              3.754408661907416e00)
QUANTILE_LOW = 0.02425


def _horner(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[0])
    for k in coefficients[1:]:
        out = out * x + F.lit(k)
    return out


def normal_quantile(p: Column | str) -> Column:
    """Quantile of the standard normal as a plain column expression."""
    p = col(p)
    tail = F.when(p < 0.5, p).otherwise(1.0 - p)
    q = F.sqrt(-2.0 * F.ln(tail))
    outer = _horner(QUANTILE_C, q) / (_horner(QUANTILE_D, q) * q + 1.0)
    c = p - 0.5
    r = c * c
    inner = _horner(QUANTILE_A, r) * c / (_horner(QUANTILE_B, r) * r + 1.0)
    return F.when(p < QUANTILE_LOW, outer).when(p > 1.0 - QUANTILE_LOW, -outer).otherwise(inner)
