"""Properties: run rules against a direct loop on random series; row order does not matter."""

import datetime as dt

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import days, make_cube
from thermocline.operators import clim, roll, runs
from thermocline.operators.udf import runs_at_least


def _loop(flags, n):
    out, run = [False] * len(flags), 0
    for i, f in enumerate(flags + [False]):
        if f:
            run += 1
        else:
            if run >= n:
                out[i - run:i] = [True] * run
            run = 0
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.booleans(), max_size=80), st.integers(min_value=1, max_value=7))
def test_numpy_run_helper_matches_loop(flags, n):
    assert list(runs_at_least(np.array(flags, dtype=bool), n)) == _loop(flags, n)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.booleans(), min_size=1, max_size=60), st.integers(min_value=2, max_value=6))
def test_spark_runs_match_loop(spark, flags, n):
    rows = [(d, 0, 0, f) for d, f in zip(days("2000-12-01", len(flags)), flags)]
    df = spark.createDataFrame(rows, "t date, lat_idx int, lon_idx int, f boolean")
    got = [r["in_run"] for r in runs.mark_runs(df, "f", n).orderBy("t").collect()]
    assert got == _loop(flags, n)


def test_row_order_does_not_matter(spark):
    rng = np.random.default_rng(9)
    rows = [(d, i, j, float(rng.normal(15, 2))) for d in days("2001-01-01", 400) for i in range(2) for j in range(2)]
    a = make_cube(spark, rows)
    b = make_cube(spark, list(reversed(rows))).repartition(7)

    def summary(c):
        an = roll.rolling_mean(clim.anomaly(c), "anom", 31)
        mask = runs.mark_runs(an.withColumn("f", F.col("anom") > 1.0), "f", 3, out="m")
        return sorted(
            (r["t"], r["lat_idx"], r["lon_idx"], round(r["rolled"], 9) if r["rolled"] is not None else None, r["m"])
            for r in mask.collect()
        )

    assert summary(a) == summary(b)
