"""Run marker, heatwave days and events per year on hand-made flag series."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from conftest import days
from thermocline.operators import runs, udf


def _loop_runs(flags, n):
    out, i = [False] * len(flags), 0
    while i < len(flags):
        if flags[i]:
            j = i
            while j < len(flags) and flags[j]:
                j += 1
            if j - i >= n:
                out[i:j] = [True] * (j - i)
            i = j
        else:
            i += 1
    return out


def _series():
    """One cell: runs of 4, 5, 6 days; a 10-day run over New Year (5/5); a NULL inside a run;
    a missing date inside a run."""
    ds = days("2000-11-01", 92)  # to 2001-01-31
    flag = {d: False for d in ds}
    def on(start, k):
        for d in days(start, k):
            flag[d] = True
    on("2000-11-03", 4)
    on("2000-11-10", 5)
    on("2000-11-20", 6)
    on("2000-12-27", 10)           # 5 in 2000, 5 in 2001
    on("2000-12-05", 7); flag[dt.date(2000, 12, 8)] = None   # NULL splits 3 / 3
    on("2001-01-15", 6)
    del flag[dt.date(2001, 1, 17)]  # a date this cell lacks: 2 / 3
    return flag


def _frame(spark, flag, cell=(0, 0)):
    rows = [(d, cell[0], cell[1], v) for d, v in sorted(flag.items())]
    return spark.createDataFrame(rows, "t date, lat_idx int, lon_idx int, f boolean")


def _two_cells(spark):
    """The series as cell (0, 0), and a neighbour that has every date."""
    every = {d: False for d in days("2000-11-01", 92)}
    return _frame(spark, _series()).unionByName(_frame(spark, every, (0, 1)))


def test_mark_runs_matches_loop(spark):
    """A step the cell lacks but its neighbour has ends a run, as in a dense cube."""
    flag = _series()
    rows = runs.mark_runs(_two_cells(spark), "f", 5).orderBy("t").collect()
    got = [r["in_run"] for r in rows if r["lon_idx"] == 0]
    every = days("2000-11-01", 92)
    want = dict(zip(every, _loop_runs([bool(flag.get(d)) for d in every], 5)))
    assert got == [want[d] for d in sorted(flag)]
    assert sum(got) == 5 + 6 + 10 and not any(r["in_run"] for r in rows if r["lon_idx"] == 1)


def test_runs_and_windows_of_a_cell_that_lacks_a_step(spark):
    from thermocline.operators import roll

    ds = days("2001-01-01", 7)
    rows = [(d, 0, j, True, 1.0) for d in ds for j in range(2) if (d, j) != (ds[3], 0)]
    df = spark.createDataFrame(rows, "t date, lat_idx int, lon_idx int, f boolean, sst double")
    marked = {j: 0 for j in range(2)}
    for r in runs.mark_runs(df, "f", 5).collect():
        marked[r["lon_idx"]] += r["in_run"]
    assert marked == {0: 0, 1: 7}
    rolled = [r["lon_idx"] for r in roll.rolling_mean(df, "sst", 5).where("rolled is not null").collect()]
    assert rolled == [1, 1, 1]
    assert [r["in_run"] for r in udf.mark_runs_pandas(df, "f", 5).where("lon_idx = 0").collect()] == [False] * 6


def test_years_without_rows_count_zero(spark):
    rows = [(d, 0, j, True) for d in days("2000-01-01", 3) + days("2002-05-01", 6) for j in range(2) if (d.year, j) != (2002, 1)]
    df = spark.createDataFrame(rows + [(dt.date(2001, 1, 1), 0, 0, False)], "t date, lat_idx int, lon_idx int, mhw boolean")
    got = {(r["lon_idx"], r["year"]): (r["days"], r["events"]) for r in runs.yearly_runs(df, "mhw", 5).collect()}
    assert got == {(0, 2000): (3, 0), (0, 2001): (0, 0), (0, 2002): (6, 1), (1, 2000): (3, 0), (1, 2001): (0, 0), (1, 2002): (0, 0)}
    d = {(r["lon_idx"], r["year"]): r["days"] for r in runs.days_per_year(df).collect()}
    assert d == {k: v[0] for k, v in got.items()}


def test_days_and_events_cut_at_new_year(spark):
    mask = runs.mark_runs(_two_cells(spark), "f", 5, out="mhw")
    d = {r["year"]: r["days"] for r in runs.days_per_year(mask).where("lon_idx = 0").collect()}
    e = {r["year"]: r["events"] for r in runs.events_per_year(mask, "mhw", 5).where("lon_idx = 0").collect()}
    assert d == {2000: 5 + 6 + 5, 2001: 5}
    # 2000: the 5-day, the 6-day run and the 5-day piece of the New Year run; 2001: its 5-day piece.
    assert e == {2000: 3, 2001: 1}


def test_new_year_piece_too_short(spark):
    flag = {d: False for d in days("2000-12-20", 20)}
    for d in days("2000-12-28", 7):  # 4 days in 2000, 3 in 2001
        flag[d] = True
    mask = runs.mark_runs(_frame(spark, flag), "f", 5, out="mhw")
    e = {r["year"]: r["events"] for r in runs.events_per_year(mask, "mhw", 5).collect()}
    d = {r["year"]: r["days"] for r in runs.days_per_year(mask).collect()}
    assert d == {2000: 4, 2001: 3}
    assert e == {2000: 0, 2001: 0}


def test_calendar_adjacency_breaks_on_missing_date(spark):
    flag = {d: True for d in days("2001-01-01", 6)}
    del flag[dt.date(2001, 1, 3)]
    df = _frame(spark, flag)
    by_rows = runs.mark_runs(df, "f", 5).agg(F.sum(F.col("in_run").cast("int"))).first()[0]
    by_cal = runs.mark_runs_calendar(df, "f", 5).agg(F.sum(F.col("in_run").cast("int"))).first()[0]
    assert by_rows == 5 and by_cal == 0


def test_pandas_path_equals_window_path(spark):
    rng = np.random.default_rng(7)
    rows = []
    for cell in [(0, 0), (0, 1), (1, 0)]:
        for d in days("2001-01-01", 200):
            rows.append((d, cell[0], cell[1], bool(rng.random() < 0.6)))
    df = spark.createDataFrame(rows, "t date, lat_idx int, lon_idx int, f boolean")
    a = runs.mark_runs(df, "f", 3).select("t", "lat_idx", "lon_idx", "in_run")
    b = udf.mark_runs_pandas(df, "f", 3).select("t", "lat_idx", "lon_idx", "in_run")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert 0 < a.where("in_run").count() < len(rows)


def test_properties_days_vs_events(spark):
    rng = np.random.default_rng(11)
    rows = [(d, 0, k, bool(rng.random() < 0.7)) for k in range(3) for d in days("1999-12-01", 800)]
    df = spark.createDataFrame(rows, "t date, lat_idx int, lon_idx int, f boolean")
    mask = runs.mark_runs(df, "f", 5, out="mhw")
    assert mask.where("mhw and not f").count() == 0  # mask implies exceed
    d = runs.days_per_year(mask)
    e = runs.events_per_year(mask, "mhw", 5)
    j = d.join(e, ["lat_idx", "lon_idx", "year"])
    assert j.where("days < 5 * events").count() == 0


def test_mhw_pipeline_end_to_end_and_store(spark, tmp_path):
    """Default parameters (q = 0.9, 5 days, 2 x 2 block mean first) on a hand-made 4 x 4 grid."""
    from conftest import make_cube
    from thermocline.plans import pipelines

    rng = np.random.default_rng(5)
    rows = []
    for d in days("2001-01-01", 8 * 365):
        for i in range(4):
            for j in range(4):
                if (i, j) in {(0, 0), (0, 1), (1, 0), (1, 1)}:
                    rows.append((d, i, j, None))  # a land block
                    continue
                v = 15 + rng.normal()
                if d.year == 2002 and 100 <= d.timetuple().tm_yday < 110:
                    v += 8  # a 10-day heatwave everywhere at sea
                rows.append((d, i, j, float(v)))
    out = pipelines.mhw_pipeline(make_cube(spark, rows), q=0.9, min_days=5, events_block=(2, 2))
    days_ = {(r["lat_idx"], r["lon_idx"], r["year"]): r["days"] for r in out["days"].collect()}
    ev = {(r["lat_idx"], r["lon_idx"], r["year"]): r["events"] for r in out["events"].collect()}
    assert days_[(0, 0, 2002)] is None and ev[(0, 0, 2002)] is None  # land block after the 2 x 2 mean
    assert days_[(1, 1, 2002)] >= 10 and ev[(1, 1, 2002)] >= 1
    assert out["days_ds"].count() == 8  # 2 x 2 coarse grid -> one block per year (2001-2008)
    pipelines.store_mhw(out, str(tmp_path / "mhw"), events_block=(2, 2))
    stored = spark.read.parquet(str(tmp_path / "mhw" / "events_ds")).select("year", "lat_idx", "lon_idx", "lat", "lon", "events")
    want = out["events_ds"].select(*stored.columns)
    assert stored.exceptAll(want).count() == 0 and want.exceptAll(stored).count() == 0
    back = spark.read.parquet(str(tmp_path / "mhw" / "days_ds"))
    assert sorted(r["year"] for r in back.select("year").distinct().collect()) == list(range(2001, 2009))
