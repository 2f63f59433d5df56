"""Dense lines in one pass, and rolling means whose cost does not depend on their width."""

import math
import random
import time

import pytest
from conftest import days, make_cube
from pyspark.sql import functions as F

from thermocline.functions.scalar import dense_line
from thermocline.functions.time import semi_month_label, semi_month_number
from thermocline.model import by_cell, time_axis
from thermocline.operators import roll


def test_dense_line(spark):
    r = random.Random(1)
    rows, want = [], {}
    for k in range(60):
        n = 12
        at = r.sample(range(n), r.randrange(0, n + 1))
        rows.append((k, [(i, None if r.random() < 0.2 else i * 1.5) for i in at]))
        want[k] = [dict(rows[-1][1]).get(i) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, e array<struct<i:int,v:double>>")
    got = {x["k"]: x["r"] for x in df.select("k", dense_line(F.col("e"), 12).alias("r")).collect()}
    assert got == want
    nested = spark.createDataFrame([(1, [(2, [1, 2]), (0, [3])])], "k int, e array<struct<i:int,v:array<int>>>")
    assert nested.select(dense_line(F.col("e"), F.lit(4)).alias("r")).first()["r"] == [[3], None, [1, 2], None]


def test_dense_lines_grow_with_their_length_only(spark, tmp_path):
    took = {}
    for n in (500, 2000, 4000):
        entries = F.expr(f"transform(filter(sequence(0, {n - 1}), x -> x % 3 != 1), x -> named_struct('i', x, 'v', cast(x as double)))")
        spark.range(400).select("id", entries.alias("e")).write.parquet(str(tmp_path / str(n)))
        out = spark.read.parquet(str(tmp_path / str(n))).select(dense_line(F.col("e"), n).alias("r"))
        runs = []
        for _ in range(4):
            t0 = time.perf_counter()
            out.write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        took[n] = min(runs)
    assert took[4000] <= 2.5 * took[2000], took


def test_semi_month_numbers_follow_each_other(spark):
    from thermocline.operators.roll import sme_bins

    bins = sme_bins(days("1999-11-30", 1)[0], days("2001-03-15", 1)[0])
    df = spark.createDataFrame([(b,) for b in bins], "t date")
    got = [r["n"] for r in df.where(F.col("t") == semi_month_label("t")).select("t", semi_month_number("t").alias("n")).orderBy("t").collect()]
    assert got == list(range(got[0], got[0] + len(bins)))


@pytest.mark.parametrize("window", [1, 2, 51, 1095])
def test_rolling_mean_of_any_width(spark, window):
    r = random.Random(window)
    dates = days("1990-01-01", 2400)
    series = {(0, 0): 1.0, (0, 1): 1e-9, (1, 0): 1e12}
    rows, values = [], {}
    for (i, j), size in series.items():
        for k, t in enumerate(dates):
            if (i, j) == (0, 1) and k in (40, 700):
                continue  # absent steps
            v = None if (i, j) == (1, 0) and k == 1200 else (r.random() - 0.3) * size + (20 if size == 1.0 else 0)
            rows.append((t, i, j, v))
            values[i, j, k] = v
    cube = make_cube(spark, rows)
    got = {(x["lat_idx"], x["lon_idx"], x["time_idx"]): x["rolled"] for x in roll.rolling_mean(by_cell(cube).join(time_axis(cube), "t"), "sst", window).collect()}
    lo, hi = window // 2, window - 1 - window // 2
    for (i, j), size in series.items():
        for k in range(0, len(dates), 7):
            if (i, j, k) not in values:
                continue
            part = [values.get((i, j, x)) if 0 <= x < len(dates) else None for x in range(k - lo, k + hi + 1)]
            want = None if None in part else math.fsum(part) / window
            if want is None:
                assert got[i, j, k] is None
            else:
                assert got[i, j, k] == pytest.approx(want, rel=1e-13, abs=size * 1e-15), (i, j, k)


def test_rolling_mean_of_odd_values(spark):
    inf = float("inf")
    cube = make_cube(spark, [(t, 0, 0, v) for t, v in zip(days("2000-01-01", 7), (0.0, 0.0, 0.0, inf, -3.0, 2.5, 0.5), strict=True)])
    got = [x["rolled"] for x in roll.rolling_mean(cube, "sst", 3).orderBy("t").collect()]
    assert got == [None, 0.0, None, None, None, 0.0, None]
    land = make_cube(spark, [(t, 0, 0, None) for t in days("2000-01-01", 4)])
    assert [x["rolled"] for x in roll.rolling_mean(land, "sst", 1).collect()] == [None] * 4


def test_rolling_time_does_not_depend_on_the_width(spark, tmp_path):
    cells = spark.range(40).select(F.lit(0).alias("lat_idx"), F.col("id").cast("int").alias("lon_idx"))
    steps = F.explode(F.sequence(F.lit(0), F.lit(7999))).alias("time_idx")
    cells.select("*", steps).withColumn("sst", F.sin("time_idx")).withColumn("t", F.expr("date_add(date'1980-01-01', time_idx)")).write.parquet(str(tmp_path / "c"))
    cube = spark.read.parquet(str(tmp_path / "c"))

    def took(w):
        runs = []
        for _ in range(3):
            t0 = time.perf_counter()
            roll.rolling_mean(cube, "sst", w).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        return min(runs)

    took(51)
    narrow, wide = took(51), took(1095)
    assert wide < 1.6 * narrow + 0.3, (narrow, wide)
