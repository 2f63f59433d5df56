"""Rolling means over rows, semi-month resampling, and resample-then-roll."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thermocline.functions.scalar import dense_line, lit_array
from thermocline.functions.time import semi_month_label, semi_month_number
from thermocline.model import CELL, with_time_index


def rows_for_years(years: int, steps_per_year: float) -> int:
    """Window length in rows for ``years`` at ``steps_per_year`` (the app uses 3 * int(52 / 3) = 51)."""
    return int(years) * int(steps_per_year)


# Bits of the whole part of scaled values and of their rest: running sums of 2^23 steps fit a long.
_WHOLE_BITS, _REST_BITS = 39, 40


def rolling_mean(df: DataFrame, value: str, window: int, keys=CELL, out: str = "rolled", axis: DataFrame | None = None) -> DataFrame:
    """Centered rolling mean over steps; NULL unless the window is complete and has no missing value.

    Even ``window`` covers ``-w/2 .. w/2 - 1``, odd ``-(w-1)/2 .. (w-1)/2`` steps of the time
    axis all cells share: a step the cell has no row for is missing, as is an infinite value.  ``axis`` is the
    ``(t, time_idx)`` table (derived from ``df`` if absent).

    The cost does not depend on ``window``: a window's sum is the difference of two running sums, read
    from the rows at its ends, whose positions and counts tell whether it is complete.  The
    running sums are exact: a value is scaled by a power of two of its series and split into two
    whole numbers, 79 bits below the series' largest value, and whole numbers are summed.
    """
    w = int(window)
    before, after = w // 2, w - 1 - w // 2
    has = "time_idx" in df.columns
    d = with_time_index(df, axis)
    series = Window.partitionBy(*keys)
    ordered = series.orderBy("time_idx")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    v = F.col(value).cast("double")
    v = F.when(F.col("time_idx").isNotNull() & (F.abs(v) < F.lit(float("inf"))), v)
    top = F.max(F.abs(v)).over(series)
    d = d.withColumn("_scale", F.when(top > 0, F.pow(F.lit(2.0), F.lit(_WHOLE_BITS) - F.ceil(F.log2(top)))).otherwise(F.lit(1.0)))
    whole = F.floor(v * F.col("_scale"))
    rest = F.floor((v * F.col("_scale") - whole) * F.lit(2.0**_REST_BITS))
    d = d.withColumn("_own", F.struct(F.when(v.isNotNull(), 1).otherwise(0).alias("n"), F.coalesce(whole, F.lit(0)).alias("a"), F.coalesce(rest, F.lit(0)).alias("b")))
    d = d.withColumn("_sum", F.struct(F.col("time_idx").alias("i"), *[F.sum(f"_own.{x}").over(so_far).alias(x) for x in "nab"]))
    low = F.struct(F.col("time_idx").alias("i"), *[(F.col(f"_sum.{x}") - F.col(f"_own.{x}")).alias(x) for x in "nab"])
    d = d.withColumns({"_lo": F.lag(low, before).over(ordered), "_hi": F.lead("_sum", after).over(ordered)})
    complete = (F.col("_lo.i") == F.col("time_idx") - before) & (F.col("_hi.i") == F.col("time_idx") + after) & (F.col("_hi.n") - F.col("_lo.n") == w)
    total = (F.col("_hi.a") - F.col("_lo.a")) + (F.col("_hi.b") - F.col("_lo.b")) / F.lit(2.0**_REST_BITS)
    d = d.withColumn(out, F.when(complete, total / F.col("_scale") / w)).drop("_scale", "_own", "_sum", "_lo", "_hi")
    return d if has else d.drop("time_idx")


def sme_bins(lo: _dt.date, hi: _dt.date) -> list[_dt.date]:
    """All semi-month bin labels (15th and last day of each month) from ``lo`` to ``hi``."""
    out, y, m = [], lo.year, lo.month
    first = _dt.date(lo.year, lo.month, 1) - _dt.timedelta(days=1)  # a bin may start on the previous month end
    if first >= lo:
        out.append(first)
    while (y, m) <= (hi.year, hi.month):
        nxt = _dt.date(y + (m == 12), m % 12 + 1, 1)
        for d in (_dt.date(y, m, 15), nxt - _dt.timedelta(days=1)):
            if lo <= d <= hi:
                out.append(d)
        y, m = nxt.year, nxt.month
    return out


def resample_sme(df: DataFrame, value: str = "sst", keys=CELL, out: str = "mean", axis: DataFrame | None = None) -> DataFrame:
    """Semi-month-end means, see ``_sme_steps``: ``(keys, t, out)``."""
    return _sme_steps(df, value, keys, out, axis).select(*keys, "t", out)


def _sme_steps(df: DataFrame, value: str, keys, out: str, axis: DataFrame | None) -> DataFrame:
    """Semi-month-end resample: mean per bin, bins starting on the 15th and on month ends,
    closed left, labelled by their start.  Empty bins between the first and last bin of the
    whole table appear with a NULL mean (the time axis is shared by all cells).

    One read and one shuffle: the bin means of a key become a dense line by their bins' numbers.  ``axis`` gives the first and last step without a scan of the table.
    """
    label = semi_month_label("t")
    means = df.groupBy(*keys, label.alias("t")).agg(F.avg(value).alias(out))
    span = (axis if axis is not None else df).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    span = span.select(semi_month_label("lo").alias("lo"), semi_month_label("hi").alias("hi")).first()
    if span["lo"] is None:
        return means.withColumn("time_idx", F.lit(0))
    bins = lit_array(sme_bins(span["lo"], span["hi"]))  # 24 per year
    first, last = (2 * (d.year * 12 + d.month) + (d.day > 15) for d in (span["lo"], span["hi"]))
    means = means.where("t is not null").withColumn("_n", (semi_month_number("t") - first).cast("int"))
    lines = means.groupBy(*keys).agg(F.collect_list(F.struct("_n", out)).alias("_e"))
    rows = lines.select(*keys, F.posexplode(dense_line(F.col("_e"), last - first + 1, "_n", out)).alias("time_idx", out))
    return rows.select(*keys, F.element_at(bins, F.col("time_idx") + 1).alias("t"), "time_idx", out)


def rolling_sme(df: DataFrame, value: str = "anom", years: int = 3, per_year: int = 24, keys=CELL, axis: DataFrame | None = None) -> DataFrame:
    """Semi-month resample, then a centered rolling mean of ``years * per_year`` bins."""
    r = _sme_steps(df, value, keys, "mean", axis)
    return rolling_mean(r, "mean", years * per_year, keys=keys, out="rolled").drop("time_idx")
