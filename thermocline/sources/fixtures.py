"""Grid views derived from the driver's test tables.

``sst_daily`` turns ``lineitem`` into a 6 x 4 daily grid (one cell is land) so every
operator runs on data whose size grows with the tables.  The same definition is
written in SQL for the DuckDB oracle (``thermocline.plans.oracle``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermocline.model import nan_to_null


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sst_daily_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily grid with labels only: ``t, lat, lon, sst`` (indices not yet attached)."""
    return sst_daily(spark, sf_dir).drop("lat_idx", "lon_idx")


def sst_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``t date, lat_idx, lon_idx int, lat, lon double, sst double`` from lineitem.

    Fixed values of the test grid: lat = 20.5 + 5 * (suppkey % 6), lon = 0.5 + 10 * (partkey % 4),
    cell (0, 0) is land, sst = 0.6 * sum(quantity) / count per day and cell.
    """
    li = _table(spark, sf_dir, "lineitem").select("l_shipdate", "l_suppkey", "l_partkey", "l_quantity")
    g = li.groupBy(
        F.to_date("l_shipdate").alias("t"),
        (F.col("l_suppkey") % 6).cast("int").alias("lat_idx"),
        (F.col("l_partkey") % 4).cast("int").alias("lon_idx"),
    ).agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("q"),
        F.count(F.lit(1)).alias("n"),
    )
    land = (F.col("lat_idx") == 0) & (F.col("lon_idx") == 0)
    value = F.col("q").cast("double") * F.lit(0.6) / F.col("n")
    return g.select(
        "t",
        "lat_idx",
        "lon_idx",
        (F.lit(20.5) + F.lit(5.0) * F.col("lat_idx")).alias("lat"),
        (F.lit(0.5) + F.lit(10.0) * F.col("lon_idx")).alias("lon"),
        nan_to_null(F.when(land, F.lit(None)).otherwise(value)).alias("sst"),
    )


def sst_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly means (weeks start on Monday), rounded to 6 places, like the weekly source files."""
    from thermocline.functions.scalar import round_arith

    d = sst_daily(spark, sf_dir)
    return d.groupBy(F.to_date(F.date_trunc("week", "t")).alias("t"), "lat_idx", "lon_idx").agg(
        F.first("lat").alias("lat"),
        F.first("lon").alias("lon"),
        round_arith(round_arith(F.avg("sst"), 9), 6).alias("sst"),
    )


def sst_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly grid of up to 180 x 360 cells, of which a larger table fills more.

    Fixed values: lat = -89.5 + suppkey % 180, lon = 0.5 + partkey % 360, sst = 0.6 * mean quantity
    per month and cell.
    """
    li = _table(spark, sf_dir, "lineitem").select("l_shipdate", "l_suppkey", "l_partkey", "l_quantity")
    g = li.groupBy(
        F.trunc(F.to_date("l_shipdate"), "month").alias("t"),
        (F.col("l_suppkey") % 180).cast("int").alias("lat_idx"),
        (F.col("l_partkey") % 360).cast("int").alias("lon_idx"),
    ).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("q"), F.count(F.lit(1)).alias("n"))
    return g.select(
        "t", "lat_idx", "lon_idx",
        (F.col("lat_idx") - F.lit(89.5)).alias("lat"),
        (F.col("lon_idx") + F.lit(0.5)).alias("lon"),
        (F.col("q").cast("double") * F.lit(0.6) / F.col("n")).alias("sst"),
    )


def sst_spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sst_daily`` with warm spells: +40 on the days of year 60 to 79 of 1994 and 200 to 205 of 1996."""
    y, d = F.year("t"), F.dayofyear("t")
    warm = ((y == 1994) & d.between(60, 79)) | ((y == 1996) & d.between(200, 205))
    return sst_daily(spark, sf_dir).withColumn("sst", F.when(warm, F.col("sst") + F.lit(40.0)).otherwise(F.col("sst")))


def reference_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second data set on the grid's labels, from ``orders``: which cells it has in its first
    step depends on its own rows (the reference of the mask)."""
    o = _table(spark, sf_dir, "orders").select("o_orderdate", "o_custkey", "o_totalprice")
    return o.groupBy(
        F.trunc(F.to_date("o_orderdate"), "month").alias("t"),
        (F.col("o_custkey") % 6).cast("int").alias("lat_idx"),
        (F.floor(F.col("o_custkey") / 6) % 4).cast("int").alias("lon_idx"),
    ).agg(F.sum(F.floor("o_totalprice")).cast("bigint").alias("q")).select(
        "t", "lat_idx", "lon_idx",
        (F.lit(20.5) + F.lit(5.0) * F.col("lat_idx")).alias("lat"),
        (F.lit(0.5) + F.lit(10.0) * F.col("lon_idx")).alias("lon"),
        F.when(F.col("q") % 4 != 0, F.col("q").cast("double")).alias("sst"),
    )


# Points used by the point queries (ids, lat, lon).  23.0 lies midway between
# the rows 20.5 and 25.5; (5.0, 99.0) lies outside the grid on both axes.
POINTS = [
    (1, 23.0, 5.5),
    (2, 40.4, 30.5),
    (3, 5.0, 99.0),
    (4, 31.0, 16.0),
]


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed points, and a point per nation: lat = 2 * nationkey + 0.75, lon = 47 - 2.25 * nationkey."""
    fixed = spark.createDataFrame(POINTS, "point_id long, lat double, lon double")
    n = F.col("n_nationkey").cast("long")
    more = _table(spark, sf_dir, "nation").select((n + 100).alias("point_id"), (n * 2 + F.lit(0.75)).alias("lat"), (F.lit(47.0) - n * F.lit(2.25)).alias("lon"))
    return fixed.unionByName(more)
