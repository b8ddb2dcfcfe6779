"""Calendar buckets, survey periods, seasons and window flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteseries.functions.numeric import col

# Season of each month, in natural order.
SEASON_MONTHS = {
    "Winter": (11, 12, 1, 2, 3),
    "Spring": (4, 5, 6),
    "Summer": (7, 8),
    "Fall": (9, 10),
}


def date_vars(df: DataFrame, date: str = "collection_period") -> DataFrame:
    """Add year, month, day, nday (day of year), qtr, year_week and year_month."""
    d = F.col(date)
    return df.withColumns({
        "year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d), "nday": F.dayofyear(d),
        "qtr": F.quarter(d), "year_week": bucket(d, "week"), "year_month": bucket(d, "month"),
    })


def bucket(c: Column | str, unit: str) -> Column:
    """First day of the week, month, quarter or year that holds the date."""
    return F.trunc(col(c), unit)


def quarter_label(c: Column | str) -> Column:
    """Text such as '1997 Q3'."""
    c = col(c)
    return F.concat(F.year(c).cast("string"), F.lit(" Q"), F.quarter(c).cast("string"))


def month_label(c: Column | str) -> Column:
    """Text such as '1997 Mar'."""
    return F.date_format(col(c), "yyyy MMM")


def survey_period(c: Column | str, last_day: int = 20, inclusive: bool = True) -> Column:
    """First of the month a survey is booked to: days after `last_day` go to the next month.

    With `inclusive=False` the day `last_day` itself already goes to the next month. December rolls
    over to January of the next year.
    """
    c = col(c)
    day = F.dayofmonth(c)
    stays = day <= last_day if inclusive else day < last_day
    month = F.trunc(c, "month")
    return F.when(stays, month).otherwise(F.add_months(month, 1))


def survey_period_with_exceptions(c: Column | str, keep_month: Column, last_day: int = 20) -> Column:
    """`survey_period`, but rows where `keep_month` holds stay in their own month."""
    return F.when(keep_month, F.trunc(col(c), "month")).otherwise(survey_period(c, last_day))


def survey_period_by_era(c: Column | str, switch, last_day: int = 20) -> Column:
    """Inclusive rule before the `switch` date, exclusive rule from it on."""
    c = col(c)
    return F.when(c < F.lit(switch).cast("date"), survey_period(c, last_day, True)).otherwise(
        survey_period(c, last_day, False))


def season(c: Column | str) -> Column:
    month = F.month(col(c))
    out = None
    for name, months in SEASON_MONTHS.items():
        hit = month.isin(*months)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def in_window(c: Column | str, start, end, closed: str = "right") -> Column:
    """Whether the date lies between start and end; `closed` is none, left, right or both."""
    c = col(c)
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    after = c >= lo if closed in ("left", "both") else c > lo
    before = c <= hi if closed in ("right", "both") else c < hi
    return after & before


def flag_window(c: Column | str, start, end, closed: str = "right",
                inside: str = "test", outside: str = "baseline") -> Column:
    """Label dates inside and outside a window; a missing date has no label."""
    hit = in_window(c, start, end, closed)
    return F.when(hit, inside).when(~hit, outside)


def days_to(c: Column | str, event) -> Column:
    return F.date_diff(col(c), F.lit(event).cast("date"))


def weeks_to(c: Column | str, event) -> Column:
    """Whole weeks since the event, rounded up."""
    return F.ceil(days_to(c, event) / F.lit(7.0))


def months_to(c: Column | str, event) -> Column:
    """Months of 30 days since the event, half to even."""
    return F.bround(days_to(c, event) / F.lit(30.0), 0)


def week_of_year(c: Column | str) -> Column:
    """Seven-day blocks counted from January 1 (not the ISO week)."""
    return F.floor((F.dayofyear(col(c)) - 1) / F.lit(7)) + 1


def month_shift(c: Column | str, n: int = -1) -> Column:
    """The month number n months away, wrapping around the year."""
    return F.month(F.add_months(F.trunc(col(c), "month"), n))


def month_sequence(start, length: int) -> Column:
    """Array of `length` month starts."""
    first = F.lit(start).cast("date")
    return F.sequence(first, F.add_months(first, length - 1), F.expr("interval 1 month"))
