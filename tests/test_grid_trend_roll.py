"""Block means, reshaping, trends, rolling means and semi-month bins against NumPy / pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import days, make_cube
from thermocline.functions.time import decimal_year
from thermocline.operators import clim, grid, roll, trend


def test_coarsen_exact_and_trim(spark):
    rng = np.random.default_rng(5)
    vals = rng.normal(size=(2, 5, 7))
    vals[0, 0, 0] = np.nan
    rows = [(dt.date(2000, 1, 1 + t), i, j, None if np.isnan(vals[t, i, j]) else float(vals[t, i, j]))
            for t in range(2) for i in range(5) for j in range(7)]
    cube = make_cube(spark, rows, dlat=0.5, dlon=0.25)
    with pytest.raises(ValueError):
        grid.coarsen(cube, 2, 2, boundary="exact")
    out = grid.coarsen(cube, 2, 2, boundary="trim")
    got = {(r["t"].day - 1, r["lat_idx"], r["lon_idx"]): (r["sst"], r["lat"], r["lon"]) for r in out.collect()}
    assert len(got) == 2 * 2 * 3
    for (t, bi, bj), (v, la, lo) in got.items():
        block = vals[t, 2 * bi:2 * bi + 2, 2 * bj:2 * bj + 2]
        assert v == pytest.approx(float(np.nanmean(block)))
        assert la == pytest.approx(10.0 + 0.5 * (2 * bi + 0.5))
        assert lo == pytest.approx(100.0 + 0.25 * (2 * bj + 0.5))
    assert grid.coarsen(cube.where("lat_idx < 4 and lon_idx < 6"), 2, 2).count() == 12


def test_unstack_year_is_dense(spark):
    rows = [(d, 0, 0, 1.0) for d in days("2000-12-30", 4)] + [(dt.date(2000, 12, 31), 0, 1, 2.0)]
    out = grid.unstack_year(make_cube(spark, rows))
    assert out.count() == 2 * 2 * 4  # cells x years x days of year present
    assert out.where("sst is null").count() == 16 - 5


def test_trend_on_linear_series(spark):
    rows = []
    for d in days("1990-01-01", 365 * 6):
        x = d.year + (d.timetuple().tm_yday - 1) / 365.25
        rows.append((d, 0, 0, 3.0 + 0.02 * (x - 1990)))
        rows.append((d, 0, 1, -1.0 - 0.05 * (x - 1990)))
    cube = make_cube(spark, rows)
    tm = {r["lon_idx"]: r for r in trend.trend_map(cube, y="sst").collect()}
    assert tm[0]["trend_decade"] == pytest.approx(0.2, abs=1e-9)
    assert tm[1]["trend_decade"] == pytest.approx(-0.5, abs=1e-9)
    assert tm[0]["trend_r3"] == 0.2
    fit = trend.trend_fit(cube, y="sst").select((F.abs(F.col("pred_ols") - F.col("sst"))).alias("e")).agg(F.max("e")).first()[0]
    assert fit < 1e-9


def test_anomaly_monthly_mean_is_zero(spark):
    rng = np.random.default_rng(2)
    rows = [(d, 0, j, float(rng.normal(20, 3))) for j in range(2) for d in days("2001-01-01", 700)]
    an = clim.anomaly(make_cube(spark, rows))
    m = an.groupBy("lat_idx", "lon_idx", "month").agg(F.avg("anom").alias("m")).agg(F.max(F.abs("m"))).first()[0]
    assert m < 1e-12
    # the join form with a stored climatology gives the same anomalies
    j = clim.anomaly(make_cube(spark, rows), clim=clim.monthly_climatology(make_cube(spark, rows)))
    d = an.alias("a").join(j.alias("b"), ["t", "lat_idx", "lon_idx"]).select(F.max(F.abs(F.col("a.anom") - F.col("b.anom")))).first()[0]
    assert d < 1e-12


@pytest.mark.parametrize("w", [4, 5, 51])
def test_rolling_mean_matches_pandas(spark, w):
    rng = np.random.default_rng(w)
    v = rng.normal(size=120)
    v[40] = np.nan
    ds = days("2001-01-01", 120)
    rows = [(d, 0, 0, None if np.isnan(x) else float(x)) for d, x in zip(ds, v)]
    got = [r["rolled"] for r in roll.rolling_mean(make_cube(spark, rows), "sst", w).orderBy("t").collect()]
    want = pd.Series(v).rolling(w, center=True).mean().tolist()
    for a, b in zip(got, want):
        if np.isnan(b):
            assert a is None
        else:
            assert a == pytest.approx(b)


def test_rows_for_years():
    assert roll.rows_for_years(3, 52 / 3) == 51


def test_resample_sme_matches_pandas(spark):
    ds = [d for d in days("2000-01-10", 90) if not (dt.date(2000, 2, 15) <= d < dt.date(2000, 2, 29))]
    rng = np.random.default_rng(1)
    v = rng.normal(size=len(ds))
    rows = [(d, 0, 0, float(x)) for d, x in zip(ds, v)]
    got = {r["t"]: r["mean"] for r in roll.resample_sme(make_cube(spark, rows), "sst").collect()}
    s = pd.Series(v, index=pd.to_datetime(ds)).resample("SME").mean()
    want = {k.date(): x for k, x in s.items()}
    assert set(got) == set(want)
    for k, x in want.items():
        if np.isnan(x):
            assert got[k] is None  # the empty half-month is a missing bin
        else:
            assert got[k] == pytest.approx(x)
    assert dt.date(2000, 2, 15) in got and got[dt.date(2000, 2, 15)] is None


def test_decimal_year_is_double(spark):
    df = spark.createDataFrame([(dt.date(2001, 7, 2),)], "t date")
    v = df.select(decimal_year("t")).first()[0]
    assert v == 2001 + (183 - 1) / 365.25


def test_frames_are_dense_and_clipped(spark):
    rows = [(d, i, j, float(i * 10 + j)) for d in days("2000-01-01", 5) for i in range(3) for j in range(4)
            if not (i == 1 and j == 2)]
    cube = make_cube(spark, rows)
    fr = grid.frames(cube, "sst", every=2, lo=0.0, hi=15.0).orderBy("t", "lat_idx").collect()
    assert [(r["time_idx"], r["lat_idx"]) for r in fr] == [(t, i) for t in (0, 2, 4) for i in range(3)]
    m = [r["row"] for r in fr[:3]]
    assert all(len(row) == 4 for row in m)
    assert m[1][2] is None and m[0][3] == 3.0 and m[2][3] == 15.0  # 23 clipped to 15
    cells = grid.frame_cells(grid.frames(cube, "sst", every=2, lo=0.0, hi=15.0)).collect()
    assert len(cells) == 3 * 3 * 4 and sum(r["v"] is None for r in cells) == 3


def test_missing_values_stay_missing_when_clipped(spark):
    rows = [(days("2000-01-01", 1)[0], 0, 0, None), (days("2000-01-01", 1)[0], 0, 1, 99.0), (days("2000-01-01", 1)[0], 1, 1, -5.0)]
    cube = make_cube(spark, rows)
    got = {(r["lat_idx"], r["lon_idx"]): r["v"] for r in grid.frame_cells(grid.frames(cube, "sst", every=1, lo=0.0, hi=15.0)).collect()}
    assert got == {(0, 0): None, (0, 1): 15.0, (1, 0): None, (1, 1): 0.0}
    from pyspark.sql import functions as F

    from thermocline.functions.scalar import clip_scale

    out = [r[0] for r in cube.orderBy("lat_idx", "lon_idx").select(clip_scale(F.col("sst"), 0.0, 10.0, scale=True)).collect()]
    assert out == [None, 1.0, 0.0]
