"""Day-of-year thresholds on a circular axis vs a NumPy brute force."""

import datetime as dt

import numpy as np
import pytest

from conftest import days, make_cube
from thermocline.operators import extremes


def _leap_cube(spark):
    rng = np.random.default_rng(3)
    rows = []
    for d in days("1999-01-01", (dt.date(2004, 12, 31) - dt.date(1999, 1, 1)).days + 1):
        rows.append((d, 0, 0, round(float(20 + 5 * np.sin(d.timetuple().tm_yday / 58) + rng.normal()), 3)))
        if rng.random() < 0.8:  # a cell with gaps
            rows.append((d, 0, 1, round(float(15 + rng.normal()), 3)))
        rows.append((d, 1, 0, None))  # land
    return rows


def _brute(rows, q, hw):
    doys = sorted({d.timetuple().tm_yday for d, *_ in rows})
    pos = {d: i for i, d in enumerate(doys)}
    n = len(doys)
    out = {}
    cells = sorted({(i, j) for _, i, j, _ in rows})
    for c in cells:
        by_doy = {}
        for d, i, j, v in rows:
            if (i, j) == c and v is not None:
                by_doy.setdefault(d.timetuple().tm_yday, []).append(v)
        for d in doys:
            p = pos[d]
            pool = []
            for o in range(-hw, hw + 1):
                pool += by_doy.get(doys[(p + o) % n], [])
            out[(c, d)] = float(np.quantile(pool, q)) if pool else None
    return out


def test_doy_threshold_matches_brute_force(spark):
    rows = _leap_cube(spark)
    cube = make_cube(spark, rows)
    got = {((r["lat_idx"], r["lon_idx"]), r["dayofyear"]): r["thr"] for r in extremes.doy_threshold(cube, 0.9).collect()}
    want = _brute(rows, 0.9, 5)
    assert set(got) == set(want)
    assert len({d for _, d in got}) == 366
    for k, v in want.items():
        if v is None:
            assert got[k] is None
        else:
            assert got[k] == pytest.approx(v, abs=1e-9)
    # the pool of day 1 reaches days 362..366 and the pool of day 366 reaches days 1..5
    assert got[((0, 0), 1)] is not None and got[((0, 0), 366)] is not None


def test_axis_shorter_than_window_fails(spark):
    cube = make_cube(spark, [(dt.date(2000, 1, k), 0, 0, 1.0) for k in range(1, 4)])
    with pytest.raises(ValueError):
        extremes.doy_threshold(cube, 0.9)


def test_exceedance_is_strict_and_false_on_missing(spark):
    rows = [(d, 0, 0, 1.0) for d in days("2001-01-01", 20)] + [(dt.date(2001, 1, 21), 0, 0, None)]
    cube = make_cube(spark, rows)
    thr = extremes.doy_threshold(cube, 0.9)
    ex = extremes.exceedance(cube, thr)
    assert ex.where("exceed").count() == 0  # equal to the threshold is not above it
    assert ex.count() == 21


def test_sparse_threshold_equals_dense_where_data_exists(spark):
    rows = [r for r in _leap_cube(spark) if not (r[2] == 1 and 100 <= r[0].timetuple().tm_yday <= 110)]
    cube = make_cube(spark, rows)
    dense = {(r["lon_idx"], r["dayofyear"]): r["thr"] for r in extremes.doy_threshold(cube, 0.9).where("lat_idx = 0").collect()}
    sparse = {(r["lon_idx"], r["dayofyear"]): r["thr"]
              for r in extremes.doy_threshold(cube, 0.9, dense=False).where("lat_idx = 0").collect()}
    have = {(j, d.timetuple().tm_yday) for d, i, j, v in rows if i == 0}
    assert set(sparse) == have and len(have) < len(dense)
    assert all(sparse[k] == dense[k] for k in have)
