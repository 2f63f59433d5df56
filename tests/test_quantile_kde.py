"""Distributed exact quantiles and the year density."""

import math

import numpy as np
import pytest

from thermocline.operators import extremes
from thermocline.operators.quantile import exact_quantiles


def _df(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")


def test_exact_quantiles_small(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=1001)
    got = exact_quantiles(_df(spark, list(v) + [None]), "x", [0.01, 0.5, 0.99])
    assert got == pytest.approx(list(np.quantile(v, [0.01, 0.5, 0.99])), abs=1e-12)


def test_exact_quantiles_refinement_path(spark):
    """Several rounds of the bucket search against NumPy."""
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=3000), np.full(2000, 0.25)])  # a value holding 40% of rows
    qs = [0.001, 0.3, 0.5, 0.75, 0.999]
    got = exact_quantiles(_df(spark, v), "x", qs, buckets=16)
    assert got == pytest.approx(list(np.quantile(v, qs)), abs=1e-12)


def test_exact_quantiles_constant_and_empty(spark):
    assert exact_quantiles(_df(spark, [2.0] * 50), "x", [0.1, 0.9]) == [2.0, 2.0]
    assert exact_quantiles(_df(spark, [None, None]), "x", [0.5]) == [None]


def _per_year(spark, counts):
    rows = [(0, 0, y, n) for y, n in counts]
    return spark.createDataFrame(rows, "lat_idx int, lon_idx int, year int, n_extreme long")


def test_kde_matches_formula(spark):
    counts = [(1990, 2), (1991, 0), (1992, 5), (1993, 1), (1994, 0), (1995, 3)]
    out = extremes.kde_years(_per_year(spark, counts)).orderBy("i").collect()
    years = np.repeat([y for y, _ in counts], [n for _, n in counts]).astype(float)
    h = 0.35 * years.std(ddof=1)
    x = np.linspace(1990, 1995, 400)
    k = np.exp(-0.5 * ((x[:, None] - years[None, :]) / h) ** 2).sum(1) / (len(years) * h * math.sqrt(2 * math.pi))
    scaled = k * 5 / k.max()
    assert len(out) == 400
    assert [r["year_x"] for r in out] == pytest.approx(list(x), abs=1e-12)
    assert [r["kde"] for r in out] == pytest.approx(list(k), rel=1e-9)
    assert [r["kde_scaled"] for r in out] == pytest.approx(list(scaled), rel=1e-9)


def test_kde_scott_bandwidth(spark):
    counts = [(2000, 1), (2001, 4), (2003, 2)]
    out = extremes.kde_years(_per_year(spark, counts), bw="scott").orderBy("i").collect()
    years = np.repeat([2000, 2001, 2003], [1, 4, 2]).astype(float)
    h = len(years) ** -0.2 * years.std(ddof=1)
    x0 = 2000.0
    k0 = np.exp(-0.5 * ((x0 - years) / h) ** 2).sum() / (len(years) * h * math.sqrt(2 * math.pi))
    assert out[0]["kde"] == pytest.approx(k0, rel=1e-9)


def test_kde_scaled_to_counts(spark):
    """A histogram's curve: from the first to the last year with events, density x events x one year."""
    counts = [(1990, 0), (1991, 2), (1992, 5), (1993, 1), (1994, 3), (1995, 0)]
    out = extremes.kde_years(_per_year(spark, counts), bw="scott", points=200, scale="counts").orderBy("i").collect()
    years = np.repeat([y for y, _ in counts], [n for _, n in counts]).astype(float)
    h = len(years) ** -0.2 * years.std(ddof=1)
    x = np.linspace(1991, 1994, 200)
    k = np.exp(-0.5 * ((x[:, None] - years[None, :]) / h) ** 2).sum(1) / (h * math.sqrt(2 * math.pi))
    assert [r["year_x"] for r in out] == pytest.approx(list(x), abs=1e-12)
    assert [r["kde_scaled"] for r in out] == pytest.approx(list(k), rel=1e-9)


def test_kde_needs_two_years(spark):
    assert extremes.kde_years(_per_year(spark, [(1999, 0), (2000, 7), (2001, 0)])).count() == 0
    assert extremes.kde_years(_per_year(spark, [(2000, 1)])).count() == 0


def test_extremes_per_year_zero_fill_and_histogram(spark):
    rows = [(0, 0, y, f) for y, f in [(1990, 1), (1990, 1), (1991, 0), (1993, 1), (1994, 0)]]
    flags = spark.createDataFrame(rows, "lat_idx int, lon_idx int, year int, q95 int")
    ep = {r["year"]: r["n_extreme"] for r in extremes.extremes_per_year(flags).collect()}
    assert ep == {1990: 2, 1991: 0, 1992: 0, 1993: 1, 1994: 0}
    hist = {r["bin_start"]: r["n"] for r in extremes.year_histogram(flags).collect()}
    assert hist == {1990: 2, 1991: 0, 1992: 0, 1993: 1}
    rep = sorted(r["year"] for r in extremes.repeat_years(extremes.extremes_per_year(flags)).collect())
    assert rep == [1990, 1990, 1993]
    h2 = {r["bin_start"]: r["n"] for r in extremes.year_histogram(flags, width=2).collect()}
    assert h2 == {1990: 2, 1992: 1}


@pytest.mark.parametrize("heavy", [-5.0, 0.0, 7.0])
def test_exact_quantiles_heavy_value_anywhere(spark, heavy):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.uniform(-3, 3, size=1500), np.full(800, heavy)])
    qs = [0.0, 0.2, 0.5, 0.9, 1.0]
    got = exact_quantiles(_df(spark, v), "x", qs, buckets=8)
    assert got == pytest.approx(list(np.quantile(v, qs)), abs=1e-12)
