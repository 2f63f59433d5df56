"""Missing-value rules, land masks and reference masks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import days, make_cube
from thermocline.model import normalize_cube
from thermocline.operators import clim, extremes, select


def _land_cube(spark):
    rows = []
    for k, d in enumerate(days("2000-01-01", 60)):
        rows.append((d, 0, 0, None))                      # land: all missing
        rows.append((d, 0, 1, float(k) if k % 2 else None))  # half missing
        rows.append((d, 1, 0, float(k % 7)))
        rows.append((d, 1, 1, float("nan") if k == 3 else float(k % 5)))  # NaN in the file
    return rows


def test_nan_becomes_null_and_stats_skip_it(spark):
    cube = normalize_cube(make_cube(spark, _land_cube(spark)))
    assert cube.where(F.isnan("sst")).count() == 0
    st = {(r["lat_idx"], r["lon_idx"]): r for r in clim.cell_stats(cube).collect()}
    assert st[(0, 0)]["mean"] is None and st[(0, 0)]["sd"] is None
    vals = [float(k) for k in range(60) if k % 2]
    assert st[(0, 1)]["mean"] == pytest.approx(sum(vals) / len(vals))
    assert st[(1, 1)]["mean"] is not None


def test_land_mask_and_apply(spark):
    cube = normalize_cube(make_cube(spark, _land_cube(spark)))
    land = select.land_mask(cube)
    assert {(r["lat_idx"], r["lon_idx"]) for r in land.where("land").collect()} == {(0, 0)}
    counts = cube.groupBy("lat_idx", "lon_idx").agg(F.count(F.lit(1)).alias("n"))
    out = {(r["lat_idx"], r["lon_idx"]): r["n"] for r in select.mask_apply(counts, land, ["n"]).collect()}
    assert out[(0, 0)] is None and out[(1, 0)] == 60


def test_quantile_policy(spark):
    cube = normalize_cube(make_cube(spark, _land_cube(spark)))
    skip = {(r["lat_idx"], r["lon_idx"]): r["q95"] for r in extremes.point_quantiles(cube, "sst", (0.95,)).collect()}
    prop = {(r["lat_idx"], r["lon_idx"]): r["q95"]
            for r in extremes.point_quantiles(cube, "sst", (0.95,), nan_policy="propagate").collect()}
    assert skip[(0, 1)] is not None and prop[(0, 1)] is None
    assert skip[(1, 0)] == prop[(1, 0)]
    fl = extremes.extreme_flags(cube, "sst", 0.95, nan_policy="propagate")
    assert fl.where("lat_idx = 0 and lon_idx = 1 and q95 = 1").count() == 0  # NULL threshold: no extremes


def test_exceed_fraction_divides_by_all_steps(spark):
    rows = [(d, 0, 0, float(k)) for k, d in enumerate(days("2001-01-01", 10))]
    rows += [(d, 0, 1, 100.0) for d in days("2001-01-01", 5)]  # half the steps missing
    cube = make_cube(spark, rows)
    fr = {(r["lon_idx"], r["year"]): r["fraction"] for r in extremes.exceed_fraction(cube, 0.5).collect()}
    # threshold = median of all 15 values = 7.0 -> cell 0 has 8, 9 above (2/10); cell 1 all 5 of 10 steps
    assert fr[(0, 2001)] == pytest.approx(0.2)
    assert fr[(1, 2001)] == pytest.approx(0.5)


def test_reference_mask_modes(spark):
    t0, t1 = dt.date(2000, 1, 1), dt.date(2000, 1, 2)
    rows = [(t, i, j, 1.0) for t in (t0, t1) for i in range(4) for j in range(2)]
    target = make_cube(spark, rows)
    ref_rows = [(t0, i, j, None if (i, j) in {(1, 0), (0, 1)} else 2.0) for i in range(4) for j in range(2)]
    ref_rows += [(t1, i, j, 2.0) for i in range(4) for j in range(2)]  # later steps do not matter
    ref = make_cube(spark, ref_rows)

    def masked(mode):
        out = select.mask_reference(target, ref, mode=mode)
        return {(r["lat_idx"], r["lon_idx"]) for r in out.where("sst is null and t = date'2000-01-01'").collect()}

    assert masked("coord") == {(1, 0), (0, 1)}
    assert masked("index_negate") == {(3, 0), (0, 1)}  # row 1 -> 4 - 1 = 3, row 0 stays
    assert masked("flip") == {(2, 0), (3, 1)}


def test_nearest_point_ties_and_clamping(spark):
    rows = [(dt.date(2000, 1, 1), i, j, 1.0) for i in range(3) for j in range(3)]
    cube = make_cube(spark, rows, lat0=10.0, lon0=100.0, dlat=2.0, dlon=2.0)  # lat 10,12,14 lon 100,102,104
    pts = spark.createDataFrame([(1, 11.0, 101.0), (2, -50.0, 500.0), (3, 12.0, 103.9), (4, 13.0, 99.0)],
                                "point_id long, lat double, lon double")
    got = {r["point_id"]: (r["lat"], r["lon"]) for r in select.nearest_point(cube, pts).collect()}
    assert got == {1: (12.0, 102.0), 2: (10.0, 104.0), 3: (12.0, 104.0), 4: (14.0, 100.0)}


def test_region_index_requires_exact_edges(spark):
    cube = make_cube(spark, [(dt.date(2000, 1, 1), i, j, 1.0) for i in range(3) for j in range(3)])
    assert select.region_index(cube, (12.0, 11.0), (100.0, 101.0)).count() == 4
    with pytest.raises(KeyError):
        select.region_index(cube, (12.5, 11.0), (100.0, 101.0))


def test_time_selection_is_inclusive(spark):
    cube = make_cube(spark, [(d, 0, 0, 1.0) for d in days("1999-12-30", 5)])
    assert select.time_range(cube, "1999-12-31", "2000-01-01").count() == 2
    assert select.year_slice(cube, 2000).count() == 3
    assert select.frame_at(cube, -1).first()["t"] == dt.date(2000, 1, 3)
    assert select.frame_at(cube, 0).first()["t"] == dt.date(1999, 12, 30)
    assert select.last_frame(cube).first()["t"] == dt.date(2000, 1, 3)


def test_null_on_land_from_yearly_counts(spark):
    from thermocline.operators import runs

    rows = [(d, 0, j, None if j == 0 else 1.0) for d in days("2000-12-30", 4) for j in range(2)]
    cube = make_cube(spark, rows).withColumn("mhw", F.lit(True))
    out = {(r["lon_idx"], r["year"]): r["days"] for r in runs.null_on_land(runs.days_per_year(cube), ["days"]).collect()}
    assert out == {(0, 2000): None, (0, 2001): None, (1, 2000): 2, (1, 2001): 2}


def test_cube_axes_and_literal_arrays(spark):
    from thermocline.functions.scalar import lit_array
    from thermocline.model import cube_axes

    rows = [(d, i, j, 1.0) for d in days("2000-02-28", 3) for i in range(2) for j in range(3)]
    ax = cube_axes(make_cube(spark, rows, dlat=0.25), time=True, doy=True)
    assert ax["lat"] == [(0, 10.0), (1, 10.25)] and [i for i, _ in ax["lon"]] == [0, 1, 2]
    assert ax["time"] == days("2000-02-28", 3) and ax["doy"] == [59, 60, 61]
    got = spark.range(1).select(lit_array([3, 1, 2]).alias("a"), lit_array([0.1, -2.5]).alias("b")).first()
    assert got["a"] == [3, 1, 2] and got["b"] == [0.1, -2.5]
