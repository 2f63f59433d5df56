"""Least-squares trend per cell (slope per decade) and fitted values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thermocline.functions.time import decimal_year
from thermocline.model import CELL
from thermocline.operators.common import cell_labels


def trend_map(df: DataFrame, y: str = "anom", keys=CELL, labels: bool = True) -> DataFrame:
    """Per cell: OLS of ``y`` on the decimal year; ``trend_decade = slope * 10`` and its value
    rounded half-even to 3 places as displayed.  Pairs with a missing value are ignored."""
    x = decimal_year("t")
    aggs = [
        (F.regr_slope(F.col(y), x) * F.lit(10.0)).alias("trend_decade"),
        F.regr_intercept(F.col(y), x).alias("intercept"),
        F.regr_count(F.col(y), x).alias("n"),
    ]
    if labels:
        aggs = cell_labels() + aggs
    out = df.groupBy(*keys).agg(*aggs)
    return out.withColumn("trend_r3", F.bround("trend_decade", 3))


def trend_fit(df: DataFrame, y: str = "anom", keys=CELL) -> DataFrame:
    """Adds ``continuous_time`` and the fitted line ``pred_ols`` per row (window over the cell,
    so it reuses the cell partitioning of earlier per-cell steps)."""
    x = decimal_year("t")
    w = Window.partitionBy(*keys)
    out = df.withColumn("continuous_time", x)
    slope = F.regr_slope(F.col(y), F.col("continuous_time")).over(w)
    icpt = F.regr_intercept(F.col(y), F.col("continuous_time")).over(w)
    return out.withColumn("pred_ols", icpt + slope * F.col("continuous_time"))
