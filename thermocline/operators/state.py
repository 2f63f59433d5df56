"""Incremental climatologies: statistics kept as states that merge.

A state is the number of valid values of a cell and month of one year, their mean and their sum of squared deviations.
States of several files merge into those of all of them, and into every statistic that a
cell, month, season or year has. A store keeps one folder of states per source file: a
new file costs reading that file, and a file that comes again replaces its own states.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thermocline.functions.time import season_order
from thermocline.model import CELL
from thermocline.operators.common import cell_labels
from thermocline.sources.store import exists

STATE = [*CELL, "year", "month"]


def cube_states(cube: DataFrame) -> DataFrame:
    """``(cell, lat, lon, year, month, n, mean, m2)`` of a cube: a partial aggregate, then one small shuffle."""
    n = F.count("sst")
    return cube.groupBy(*CELL, F.year("t").cast("int").alias("year"), F.month("t").cast("int").alias("month")).agg(
        *cell_labels(), n.alias("n"), F.avg("sst").alias("mean"), (F.var_pop("sst") * n).alias("m2")
    )


def merged(states: DataFrame, keys) -> DataFrame:
    """States by ``keys`` (columns of ``states``), merged: the deviations of the parts and of their means.

    The mean of a key is a window over its states, so that deviations are taken from it and not from
    sums of squares; the window and the aggregate share one shuffle of the states.
    """
    key = Window.partitionBy(*keys)
    total = F.sum("n").over(key)
    s = states.withColumn("_mean", F.when(total > 0, F.sum(F.col("n") * F.col("mean")).over(key) / total))
    between = F.col("n") * F.pow(F.col("mean") - F.col("_mean"), 2)
    labels = [a for a in cell_labels()] if "lat" in states.columns else []
    return s.groupBy(*keys).agg(*labels, F.sum("n").alias("n"), F.first("_mean", ignorenulls=True).alias("mean"), (F.sum("m2") + F.sum(between)).alias("m2"))


def _with_sd(m: DataFrame, mean: str) -> DataFrame:
    return m.withColumn("sd", F.when(F.col("n") > 0, F.sqrt(F.col("m2") / F.col("n")))).withColumnRenamed("mean", mean)


def monthly_climatology(states: DataFrame) -> DataFrame:
    """``clim.monthly_climatology`` from states."""
    return _with_sd(merged(states, [*CELL, "month"]), "clim").select(*CELL, "month", "lat", "lon", "clim", "sd")


def variability_map(states: DataFrame) -> DataFrame:
    """``clim.variability_map`` from states."""
    return monthly_climatology(states).groupBy(*CELL).agg(*cell_labels(), F.avg("sd").alias("variability"))


def season_stats(states: DataFrame) -> DataFrame:
    """``clim.season_stats`` from states."""
    m = F.col("month")
    name = F.when(m.isin(12, 1, 2), "DJF").when(m.isin(3, 4, 5), "MAM").when(m.isin(6, 7, 8), "JJA").otherwise("SON")
    out = _with_sd(merged(states.withColumn("season", name), [*CELL, "season"]), "mean")
    return out.select(*CELL, "season", "lat", "lon", "mean", "sd").withColumn("season_order", season_order("season"))


def yearly_stats(states: DataFrame) -> DataFrame:
    """``clim.yearly_stats`` from states."""
    return _with_sd(merged(states, [*CELL, "year"]), "mean").select(*CELL, "year", "lat", "lon", "mean", "sd")


def cell_stats(states: DataFrame) -> DataFrame:
    """``clim.cell_stats`` from states."""
    return _with_sd(merged(states, CELL), "mean").select(*CELL, "lat", "lon", "mean", "sd")


# ---- the store ---------------------------------------------------------------------------------


def _folder(path: str, source: str) -> str:
    return f"{path.rstrip('/')}/source={hashlib.sha256(source.encode()).hexdigest()[:24]}"


def append_states(cube: DataFrame, path: str, source: str) -> None:
    """Add the states of ``cube``, the contents of ``source``; the same source again replaces its states.

    Sources must not share steps of a cell: a step in two of them counts twice (the ingest's upsert
    keeps one row per step and cell).
    """
    cube_states(cube).withColumn("from", F.lit(source)).write.mode("overwrite").parquet(_folder(path, source))


def has_source(spark: SparkSession, path: str, source: str) -> bool:
    """Whether the states of ``source`` are in the store, alone or compacted with others."""
    if exists(spark, f"{_folder(path, source)}/_SUCCESS"):
        return True
    compacted = f"{path.rstrip('/')}/compacted"
    return exists(spark, f"{compacted}/sources/_SUCCESS") and not spark.read.parquet(f"{compacted}/sources").where(F.col("from") == source).isEmpty()


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """All states of the store: one row per source, cell, year and month."""
    root = path.rstrip("/")
    folders = [f"{root}/source=*"] if exists(spark, f"{root}/source=*") else []
    if exists(spark, f"{root}/compacted/states/_SUCCESS"):
        folders.append(f"{root}/compacted/states")
    if not folders:
        raise ValueError(f"{path} holds no states")
    return spark.read.parquet(*folders).select(*STATE, "lat", "lon", "n", "mean", "m2")


def compact_states(spark: SparkSession, path: str, target: str) -> None:
    """Write the store ``path`` anew under ``target``: one state per cell, year and month, and the sources' names."""
    merged(read_states(spark, path), STATE).select(*STATE, "lat", "lon", "n", "mean", "m2").write.mode("overwrite").parquet(f"{target.rstrip('/')}/compacted/states")
    root = path.rstrip("/")
    names = [spark.read.parquet(f"{root}/source=*").select("from")] if exists(spark, f"{root}/source=*") else []
    if exists(spark, f"{root}/compacted/sources/_SUCCESS"):
        names.append(spark.read.parquet(f"{root}/compacted/sources").select("from"))
    every = names[0] if len(names) == 1 else names[0].unionByName(names[1])
    every.distinct().write.mode("overwrite").parquet(f"{target.rstrip('/')}/compacted/sources")
