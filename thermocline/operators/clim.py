"""Climatologies, variability, seasonal / yearly / whole-period statistics, anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thermocline.functions.scalar import maybe_round
from thermocline.functions.time import season, season_order
from thermocline.model import CELL
from thermocline.operators.common import cell_labels


def monthly_climatology(cube: DataFrame) -> DataFrame:
    """Per cell and calendar month over all years: mean ``clim`` and population std ``sd``.

    Partial aggregation runs before the shuffle, so only (cell, month) partial sums move.
    """
    return cube.groupBy(*CELL, F.month("t").cast("int").alias("month")).agg(
        *cell_labels(),
        F.avg("sst").alias("clim"),
        F.stddev_pop("sst").alias("sd"),
    )


def monthly_std(cube: DataFrame) -> DataFrame:
    return monthly_climatology(cube).select(*CELL, "lat", "lon", "month", "sd")


def variability_map(cube: DataFrame) -> DataFrame:
    """Monthly std averaged over months, each month with equal weight (months without data skipped)."""
    return (
        monthly_climatology(cube)
        .groupBy(*CELL)
        .agg(*cell_labels(), F.avg("sd").alias("variability"))
    )


def season_stats(cube: DataFrame) -> DataFrame:
    """Mean and population std per cell and season (DJF, MAM, JJA, SON), with a sort column."""
    return (
        cube.withColumn("season", season("t"))
        .groupBy(*CELL, "season")
        .agg(*cell_labels(), F.avg("sst").alias("mean"), F.stddev_pop("sst").alias("sd"))
        .withColumn("season_order", season_order("season"))
    )


def yearly_stats(cube: DataFrame) -> DataFrame:
    return cube.groupBy(*CELL, F.year("t").cast("int").alias("year")).agg(
        *cell_labels(), F.avg("sst").alias("mean"), F.stddev_pop("sst").alias("sd")
    )


def cell_stats(cube: DataFrame) -> DataFrame:
    """Whole-period mean and population std per cell."""
    return cube.groupBy(*CELL).agg(*cell_labels(), F.avg("sst").alias("mean"), F.stddev_pop("sst").alias("sd"))


def doy_climatology(cube: DataFrame) -> DataFrame:
    return cube.groupBy(*CELL, F.dayofyear("t").cast("int").alias("dayofyear")).agg(
        *cell_labels(), F.avg("sst").alias("clim")
    )


def anomaly(cube: DataFrame, clim: DataFrame | None = None, ndigits: int | None = None) -> DataFrame:
    """``anom = sst - monthly mean of the cell``; adds ``month``.

    Without ``clim`` the mean is a window over (cell, month): it shares the cube's cell
    partitioning with later per-cell windows.  With a stored climatology it is an equi
    join on (cell, month); the climatology is 12 rows per cell.
    """
    month = F.month("t").cast("int")
    if clim is None:
        w = Window.partitionBy(*CELL, "month")
        out = cube.withColumn("month", month).withColumn("anom", F.col("sst") - F.avg("sst").over(w))
    else:
        c = clim.select(*CELL, "month", "clim")
        out = cube.withColumn("month", month).join(c, [*CELL, "month"], "left")
        out = out.withColumn("anom", F.col("sst") - F.col("clim")).drop("clim")
    return out.withColumn("anom", maybe_round(F.col("anom"), ndigits))


def region_series(cube: DataFrame, weights: str | None = None) -> DataFrame:
    """Mean over all cells per time step, its monthly climatology and anomaly.

    ``weights='coslat'`` weights each cell by cos(latitude); the default is the plain mean.
    One row per time step: the series length is bounded by the time axis.
    """
    if weights == "coslat":
        w = F.cos(F.radians("lat"))
        num = F.sum(F.when(F.col("sst").isNotNull(), w * F.col("sst")))
        den = F.sum(F.when(F.col("sst").isNotNull(), w))
        series = cube.groupBy("t").agg((num / den).alias("region_mean"))
    elif weights is None:
        series = cube.groupBy("t").agg(F.avg("sst").alias("region_mean"))
    else:
        raise ValueError(f"unknown weights {weights!r}")
    series = series.withColumns({"year": F.year("t").cast("int"), "month": F.month("t").cast("int")})
    return series.withColumn(
        "anom", F.col("region_mean") - F.avg("region_mean").over(Window.partitionBy("month"))
    )


def region_yearly(series: DataFrame) -> DataFrame:
    return series.groupBy("year").agg(F.avg("region_mean").alias("mean"))


def region_quantiles(series: DataFrame, qs=(0.10, 0.90)) -> DataFrame:
    """Quantiles of the region series and its mean truncated to an integer (one row)."""
    p = F.percentile("region_mean", F.array(*[F.lit(float(q)) for q in qs]))
    aggs = [F.avg("region_mean").cast("int").alias("mean_int"), p.alias("_p")]
    out = series.agg(*aggs)
    return out.select(
        *[F.col("_p")[i].alias(f"q{int(round(q * 100)):02d}") for i, q in enumerate(qs)], "mean_int"
    )
