"""Every registered query equals its DuckDB twin on the small driver tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")
def test_all_queries_match_duckdb(spark):
    from oracle_check import compare

    from thermocline.plans.catalog import QUERIES

    res = compare(spark, SF, keys=sorted(QUERIES), verbose=False)
    bad = {k: v for k, v in res.items() if not (v.startswith("ok") or v.startswith("rows-only"))}
    assert not bad, bad


def test_entry_contract(spark):
    import __spark_entry__ as E
    from thermocline.plans.catalog import QUERIES

    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"lat_idx", "lon_idx", "lat", "lon", "variability"}
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    assert set(QUERIES) <= set(sqls)


@pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")
def test_point_report_equals_cell_report_of_nearest_cell(spark):
    from thermocline.plans import pipelines
    from thermocline.operators import select
    from thermocline.sources import fixtures

    cube = fixtures.sst_daily(spark, SF)
    pts = fixtures.points(spark, SF)
    near = {r["point_id"]: (r["lat_idx"], r["lon_idx"]) for r in select.nearest_point(cube, pts).collect()}
    cells = {(r["lat_idx"], r["lon_idx"]): r for r in pipelines.cell_reports(cube, 0.95, ndigits=9).collect()}
    fields = ["trend_decade", "threshold", "n_valid", "n_extreme", "first_year", "last_year", "trend_r3"]
    for r in pipelines.point_report(cube, pts, 0.95, ndigits=9).collect():
        c = cells[near[r["point_id"]]]
        for f in fields:
            a, b = r[f], c[f]
            assert (a is None and b is None) or a == pytest.approx(b, abs=1e-9), (r["point_id"], f, a, b)
