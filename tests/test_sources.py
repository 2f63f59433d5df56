"""Loading, decoding, stores and the cache-aside materializer."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from conftest import days, make_cube
from thermocline.sources import cube as cube_io
from thermocline.sources import store


def _raw(spark):
    rows = [(d, 40.5 - i, 0.5 + j, float(i + j) if (i, j) != (0, 0) else float("nan"))
            for d in days("2001-01-01", 3) for i in range(3) for j in range(2)]
    return spark.createDataFrame(rows, "t date, lat double, lon double, sst double")


def test_load_parquet_csv_json(spark, tmp_path):
    raw = _raw(spark)
    raw.write.parquet(str(tmp_path / "pq"))
    raw.write.option("header", "true").csv(str(tmp_path / "csv"))
    raw.write.json(str(tmp_path / "js"))
    for fmt, sub in [("parquet", "pq"), ("csv", "csv"), ("json", "js")]:
        c = cube_io.load_cube(spark, str(tmp_path / sub), fmt=fmt, lat_descending=True)
        assert c.count() == 18
        assert c.where("sst is null").count() == 3  # NaN is missing
        got = {(r["lat"], r["lat_idx"]) for r in c.select("lat", "lat_idx").distinct().collect()}
        assert got == {(40.5, 0), (39.5, 1), (38.5, 2)}  # descending latitude axis


def test_multi_file_concat_skips_other_files_and_fails_on_broken_ones(spark, tmp_path):
    d = tmp_path / "daily"
    _raw(spark).where("t = date'2001-01-01'").write.parquet(str(d / "a"))
    _raw(spark).where("t = date'2001-01-02'").write.parquet(str(d / "b"))
    for f in os.listdir(d / "b"):
        if f.endswith(".parquet"):
            os.rename(d / "b" / f, d / "b" / "part.txt")  # other extension: ignored
    c = cube_io.load_cube(spark, [str(d / "a"), str(d / "b")], glob="*.parquet")
    assert c.count() == 6
    (d / "a" / "broken.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        cube_io.load_cube(spark, [str(d / "a"), str(d / "b")], glob="*.parquet").count()
    good, bad = cube_io.readable_files(spark, str(d / "a"), glob="*.parquet")
    assert [os.path.basename(f) for f in bad] == ["broken.parquet"]
    assert cube_io.load_cube(spark, good).count() == 6


def test_sub_daily_times_are_not_truncated(spark, tmp_path):
    p = tmp_path / "csv"
    p.mkdir()
    (p / "a.csv").write_text("t,lat,lon,sst\n2001-01-01 06:00:00,1.5,2.5,3.0\n2001-01-01 18:00:00,1.5,2.5,4.0\n")
    c = cube_io.load_cube(spark, str(p), fmt="csv", time_type="timestamp_ntz", dedupe=True)
    assert dict(c.dtypes)["t"] == "timestamp_ntz"
    assert sorted((r["t"].hour, r["sst"]) for r in c.collect()) == [(6, 3.0), (18, 4.0)]
    with pytest.raises(Exception, match="time of day"):
        cube_io.load_cube(spark, str(p), fmt="csv").collect()


def test_labels_off_the_axis_are_an_error(spark):
    from thermocline.model import axis_frame, off_axis_rows

    d = days("2001-01-01", 1)[0]
    raw = spark.createDataFrame([(d, 1.0, 5.0, 1.0), (d, 2.0, 5.0, 1.0), (d, None, 5.0, 1.0), (d, 1.0, 6.0, 1.0)], "t date, lat double, lon double, sst double")
    lat, lon = axis_frame(spark, [(0, 1.0)], "lat_idx", "lat"), axis_frame(spark, [(0, 5.0)], "lon_idx", "lon")
    assert cube_io.index_cube(raw.limit(1), lat_axis=lat, lon_axis=lon).count() == 1
    with pytest.raises(Exception, match="not on its axis"):
        cube_io.index_cube(raw, lat_axis=lat, lon_axis=lon).collect()
    with pytest.raises(Exception, match="not on its axis"):
        cube_io.index_cube(raw).collect()  # a NULL label has no place on a derived axis either
    assert sorted((r["lat"] or 0, r["lon"]) for r in off_axis_rows(raw, lat, lon).collect()) == [(0, 5.0), (1.0, 6.0), (2.0, 5.0)]


def test_conflicting_copies_keep_a_stated_value(spark):
    d = days("2001-01-01", 1)[0]
    c = make_cube(spark, [(d, 0, 0, None), (d, 0, 0, 9.0), (d, 0, 0, 7.5), (d, 0, 1, None), (d, 0, 1, None)])
    assert {r["lon_idx"]: r["sst"] for r in cube_io.dedupe_steps(c).collect()} == {0: 7.5, 1: None}


def test_more_steps_and_points_than_the_broadcast_limit(spark, monkeypatch):
    from thermocline import model
    from thermocline.operators import select

    monkeypatch.setattr(model.small_or_plain, "__defaults__", (3,))
    ds = days("2001-01-01", 8)
    c = make_cube(spark, [(d, i, j, float(i + j)) for d in ds for i in range(5) for j in range(4)])
    assert {(r["t"], r["time_idx"]) for r in model.with_time_index(c).collect()} == {(d, k) for k, d in enumerate(ds)}
    pts = spark.createDataFrame([(k, 10.0 + k % 5 + 0.2, 100.0 + k % 4) for k in range(20)], "point_id long, lat double, lon double")
    s = select.point_series(c, select.nearest_point(c, pts))
    assert s.count() == 20 * 8 and s.where("sst <> lat_idx + lon_idx").count() == 0


def test_axes_are_stored_beside_the_cube(spark, tmp_path):
    from thermocline import model
    from thermocline.operators import select

    ds = days("2001-01-01", 5)
    c = make_cube(spark, [(d, i, 0, 1.0 * i) for d in ds for i in range(2)])
    model.write_axes(c, str(tmp_path / "axes"))
    axes = model.read_axes(spark, str(tmp_path / "axes"))
    assert [r["t"] for r in axes["time"].orderBy("time_idx").collect()] == ds and axes["lat"].count() == 2
    assert {r["t"] for r in select.frame_at(c, -1, axes["time"]).collect()} == {ds[-1]}
    with pytest.raises(IndexError):
        select.frame_at(c, 9, axes["time"])
    # with stored axes, building the operators reads the axes only: a cube that cannot be read is no trouble
    from pyspark.sql import functions as F

    from thermocline.operators import grid, roll, runs

    never = c.select([F.when(F.raise_error(F.lit("the cube was read")).isNull(), F.col(n)).alias(n) for n in c.columns])
    pairs = [[(r[0], r[1]) for r in axes[n].orderBy(f"{n}_idx").select(f"{n}_idx", n).collect()] for n in ("lat", "lon")]
    select.stride_subsample(never, axis=axes["time"])
    roll.rolling_mean(never, "sst", 3, axis=axes["time"])
    runs.yearly_runs(never.withColumn("mhw", F.lit(True)), axis=axes["time"])
    grid.unstack_year(never, axis=axes["time"])
    grid.coarsen(never, 2, 1, axes=pairs)
    select.nearest_point(never, spark.createDataFrame([(1, 10.0, 100.0)], "point_id long, lat double, lon double"), axes=pairs)
    grid.frames(never, "sst", axes={"lat": pairs[0], "lon": pairs[1], "time": ds})
    with pytest.raises(Exception, match="the cube was read"):
        select.stride_subsample(never, axis=axes["time"]).collect()


def test_decode_cf_time_and_values(spark):
    df = spark.createDataFrame([(0.0, 3), (1.5, -32767), (24.0, 100)], "hours double, raw int")
    out = cube_io.decode_cf_time(df, "hours", "hours since 1990-01-01 06:00:00")
    ts = [r["t"] for r in out.orderBy("hours").collect()]
    assert ts == [dt.datetime(1990, 1, 1, 6), dt.datetime(1990, 1, 1, 7, 30), dt.datetime(1990, 1, 2, 6)]
    vals = [r[0] for r in df.orderBy("hours").select(cube_io.decode_values(F.col("raw"), 0.01, 273.15, -32767)).collect()]
    assert vals[0] == pytest.approx(273.18) and vals[1] is None and vals[2] == pytest.approx(274.15)


def test_cube_stats(spark):
    c = make_cube(spark, [(d, i, 0, None if i == 0 else 1.0 * i) for d in days("2000-01-01", 4) for i in range(3)])
    r = cube_io.cube_stats(c).first()
    assert (r["n_time"], r["n_lat"], r["n_lon"], r["n_valid"], r["n_missing"]) == (4, 3, 1, 8, 4)
    assert (r["sst_min"], r["sst_max"]) == (1.0, 2.0)


def test_materialize_is_keyed_on_its_input(spark, tmp_path):
    src, p = str(tmp_path / "src"), str(tmp_path / "cache" / "map")
    spark.createDataFrame([(0, 0, 1.25)], "lat_idx int, lon_idx int, variability double").coalesce(1).write.parquet(src)

    def run(params=()):
        return store.materialize(spark, p, lambda: spark.read.parquet(src), float_cols=["variability"], params=params)

    assert dict(run().dtypes)["variability"] == "float" and run().first()["variability"] == 1.25
    assert len(os.listdir(p)) == 1  # the second call read the first one's files
    run(params=[2])
    assert len(os.listdir(p)) == 2
    spark.createDataFrame([(0, 0, 7.5), (0, 1, 1.0)], "lat_idx int, lon_idx int, variability double").coalesce(1).write.mode("overwrite").parquet(src)
    assert run().count() == 2 and len(os.listdir(p)) == 3


def test_write_store_partitioned_by_year(spark, tmp_path):
    c = make_cube(spark, [(d, 0, 0, 1.0) for d in days("2000-12-30", 4)])
    store.write_store(c, str(tmp_path / "st"))
    assert sorted(f for f in os.listdir(tmp_path / "st") if not f.startswith(".")) == ["_SUCCESS", "year=2000", "year=2001"]
    back = store.read_store(spark, str(tmp_path / "st"))
    assert back.where("year = 2001").count() == 2


def test_concat_and_sort_time(spark):
    c = make_cube(spark, [(d, 0, 0, 1.0) for d in days("2000-01-01", 10)])
    u = cube_io.concat_time([c.where("t < date'2000-01-05'"), c.where("t >= date'2000-01-05'")])
    assert u.count() == 10
    s = cube_io.sort_time(u, 2)
    assert [r["t"] for r in s.collect()] == sorted(r["t"] for r in c.collect())


def test_concat_drops_repeated_steps(spark):
    c = make_cube(spark, [(d, 0, j, 1.0) for d in days("2000-01-01", 5) for j in range(2)])
    piece = c.where("t = date'2000-01-02'")
    assert cube_io.concat_time([c, piece, piece]).count() == 10
    assert cube_io.concat_time([c, piece], dedupe=False).count() == 12


def test_store_files_are_sorted_by_cell(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    rows = [(d, i, j, float(i + j)) for d in days("2000-12-20", 30) for i in range(5) for j in range(3)]
    c = make_cube(spark, rows).repartition(6)  # scrambled order
    store.write_store(c, str(tmp_path / "st"))
    files = glob.glob(str(tmp_path / "st" / "year=*" / "*.parquet"))
    assert files
    for f in files:
        t = pq.read_table(f).to_pandas()
        key = list(zip(t["lat_idx"], t["lon_idx"]))
        assert key == sorted(key), f
