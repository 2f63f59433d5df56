"""Calendar columns: year, month, day of year, season, decimal year, semi-month bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def time_parts(df: DataFrame, t: str = "t") -> DataFrame:
    """Add ``year, month, dayofyear`` as INT."""
    return df.withColumns(
        {
            "year": F.year(t).cast("int"),
            "month": F.month(t).cast("int"),
            "dayofyear": F.dayofyear(t).cast("int"),
        }
    )


# Meteorological seasons and their display order.
SEASONS = ["DJF", "MAM", "JJA", "SON"]


def season(t: str | Column = "t") -> Column:
    """DJF / MAM / JJA / SON; December belongs to the DJF group of its own year (no year key)."""
    m = F.month(t)
    return (
        F.when(m.isin(12, 1, 2), "DJF")
        .when(m.isin(3, 4, 5), "MAM")
        .when(m.isin(6, 7, 8), "JJA")
        .otherwise("SON")
    )


def season_order(s: str | Column = "season") -> Column:
    c = F.col(s) if isinstance(s, str) else s
    return F.when(c == "DJF", 0).when(c == "MAM", 1).when(c == "JJA", 2).otherwise(3).cast("int")


def decimal_year(t: str | Column = "t") -> Column:
    """``year + (dayofyear - 1) / 365.25`` in double arithmetic (a DECIMAL literal would truncate)."""
    return F.year(t).cast("double") + (F.dayofyear(t).cast("double") - F.lit(1.0)) / F.lit(365.25)


def semi_month_label(t: str | Column = "t") -> Column:
    """Semi-month-end bin label: bins start on the 15th and on the last day of each month,
    are closed on the left and are labelled by their start."""
    d = F.to_date(t) if isinstance(t, str) else F.to_date(t)
    return (
        F.when(d == F.last_day(d), d)
        .when(F.dayofmonth(d) >= 15, F.date_add(F.trunc(d, "MM"), 14))
        .otherwise(F.date_sub(F.trunc(d, "MM"), 1))
    )


def semi_month_number(label: str | Column) -> Column:
    """A running number of semi-month bins from their labels: 15ths are even, month ends odd."""
    d = F.col(label) if isinstance(label, str) else label
    return 2 * (F.year(d) * 12 + F.month(d)) + (F.dayofmonth(d) > 15).cast("int")
