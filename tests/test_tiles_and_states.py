"""The chunked tile store and the incremental climatologies."""

import datetime as dt
import random
import re

import pytest
from conftest import days, make_cube
from pyspark.sql import functions as F

from thermocline.operators import clim, state
from thermocline.sources import tiles


def rows_of(df):
    return sorted(((r["t"], r["lat_idx"], r["lon_idx"], r["lat"], r["lon"], r["sst"]) for r in df.collect()), key=lambda x: x[:3])


@pytest.fixture(scope="module")
def cube(spark):
    r = random.Random(2)
    rows = []
    for t in days("2001-01-01", 23):
        for i in range(7):
            for j in range(11):
                if r.random() < 0.85 and not (i == 3 and j < 4):  # absent rows, an absent stretch
                    rows.append((t, i, j, None if r.random() < 0.1 else round(r.gauss(15, 4), 3)))
    return make_cube(spark, rows).cache()


@pytest.mark.parametrize("chunk", [(5, 3, 4), (48, 180, 180), (1, 1, 1), (23, 7, 11)])
def test_tiles_round_trip(spark, cube, tmp_path, chunk):
    path = str(tmp_path / "tiles")
    tiles.write_tiles(cube, path, chunk)
    want = rows_of(cube)
    assert rows_of(tiles.read_tiles(spark, path)) == want
    t0 = dt.date(2001, 1, 1)
    box = tiles.read_tiles(spark, path, time=(4, 17), lat=(2, 5), lon=(3, 3))
    assert rows_of(box) == [x for x in want if 4 <= (x[0] - t0).days <= 17 and 2 <= x[1] <= 5 and x[2] == 3]
    assert rows_of(tiles.read_tiles(spark, path, above=20.0)) == [x for x in want if x[5] is not None and x[5] > 20.0]
    assert rows_of(tiles.read_tiles(spark, path, below=6.0, lat=(0, 2))) == [x for x in want if x[5] is not None and x[5] < 6.0 and x[1] <= 2]
    stats = tiles.select_tiles(spark, path).agg(F.min("lo"), F.max("hi"), F.sum("n")).first()
    valid = [x[5] for x in want if x[5] is not None]
    assert tuple(stats) == (min(valid), max(valid), len(valid))


def test_a_point_reads_its_tile_column_only(spark, cube, tmp_path):
    path = str(tmp_path / "tiles")
    tiles.write_tiles(cube, path, (5, 3, 4))
    every = tiles.select_tiles(spark, path)
    point = tiles.select_tiles(spark, path, lat=(4, 4), lon=(9, 9))
    assert every.select("tile_lat", "tile_lon").distinct().count() == 9
    mine = [f for f in every.inputFiles() if "tile_lat=1/tile_lon=2/" in f]
    point.collect()
    scan = point._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert 0 < scan.metrics().get("numFiles").get().value() == len(mine) < len(every.inputFiles())

    def plan(df):
        return df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    assert re.search(r"PartitionFilters: \[[^\]]*tile_lat", plan(point))
    late = plan(tiles.select_tiles(spark, path, time=(20, 22), above=5.0))
    assert "GreaterThanOrEqual(tile_time,4)" in late and "GreaterThan(hi,5.0)" in late


def test_tiles_need_times(spark, tmp_path):
    with pytest.raises(Exception, match="no time"):
        tiles.write_tiles(make_cube(spark, [(None, 0, 0, 1.0), (dt.date(2000, 1, 1), 0, 0, 1.0)]), str(tmp_path / "x"))


def close(a, b, keys, values):
    ra = {tuple(r[k] for k in keys): [r[v] for v in values] for r in a.collect()}
    rb = {tuple(r[k] for k in keys): [r[v] for v in values] for r in b.collect()}
    assert set(ra) == set(rb)
    for k, x in ra.items():
        assert x == pytest.approx(rb[k], rel=1e-10, abs=1e-10) if None not in x else x == rb[k], k


def test_states_give_the_statistics_of_the_whole(spark, tmp_path):
    r = random.Random(4)
    rows = [(t, i, j, None if (i, j) == (0, 0) or r.random() < 0.1 else 1e3 + r.gauss(10, 3)) for t in days("2000-11-01", 500) for i in range(2) for j in range(2) if r.random() < 0.9]
    path, base = str(tmp_path / "states"), str(tmp_path / "base")
    cuts = [rows[:600], rows[600:1100], rows[1100:]]
    for n, part in enumerate(cuts):
        state.append_states(make_cube(spark, part), path, f"file {n}")
    state.append_states(make_cube(spark, cuts[1]), path, "file 1")  # the same file again
    assert state.has_source(spark, path, "file 2") and not state.has_source(spark, path, "file 3")
    whole = make_cube(spark, rows)
    pairs = [
        (state.monthly_climatology, clim.monthly_climatology, ["lat_idx", "lon_idx", "month"], ["clim", "sd", "lat", "lon"]),
        (state.season_stats, clim.season_stats, ["lat_idx", "lon_idx", "season"], ["mean", "sd", "season_order"]),
        (state.yearly_stats, clim.yearly_stats, ["lat_idx", "lon_idx", "year"], ["mean", "sd"]),
        (state.cell_stats, clim.cell_stats, ["lat_idx", "lon_idx"], ["mean", "sd"]),
        (state.variability_map, clim.variability_map, ["lat_idx", "lon_idx"], ["variability"]),
    ]
    state.compact_states(spark, path, base)
    assert state.has_source(spark, base, "file 0") and state.has_source(spark, base, "file 2")
    for store in (path, base):
        for ours, theirs, keys, values in pairs:
            close(ours(state.read_states(spark, store)), theirs(whole), keys, values)
    # more after the compaction
    more = [(t, 0, 1, 7.0) for t in days("2003-01-01", 3)]
    state.append_states(make_cube(spark, more), base, "file 9")
    close(state.monthly_climatology(state.read_states(spark, base)), clim.monthly_climatology(make_cube(spark, rows + more)), ["lat_idx", "lon_idx", "month"], ["clim", "sd"])
    with pytest.raises(ValueError, match="no states"):
        state.read_states(spark, str(tmp_path / "none"))


def test_appending_reads_the_new_file_only(spark, tmp_path):
    path = str(tmp_path / "states")
    for n in range(3):
        make_cube(spark, [(t, 0, 0, float(n)) for t in days(f"200{n}-01-01", 5)]).write.parquet(str(tmp_path / f"f{n}"))
    for n in range(2):
        state.append_states(spark.read.parquet(str(tmp_path / f"f{n}")), path, f"f{n}")
    new = spark.read.parquet(str(tmp_path / "f2"))
    assert all("/f2/" in f for f in state.cube_states(new).inputFiles())
    before = {f for f in spark.read.parquet(f"{path}/source=*").inputFiles()}
    state.append_states(new, path, "f2")
    after = {f for f in spark.read.parquet(f"{path}/source=*").inputFiles()}
    assert before < after  # nothing else was written anew
    merged = state.variability_map(state.read_states(spark, path))
    assert all("/states/" in f for f in merged.inputFiles())  # the cube's files are not read again
