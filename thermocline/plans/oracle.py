"""DuckDB SQL twins of the registered queries (same column names, same rounding).

Every statement starts from the same grid view over ``lineitem`` as
``thermocline.sources.fixtures.sst_daily``.
"""

from __future__ import annotations

CUBE = """
cube AS (
  SELECT CAST(l_shipdate AS DATE) AS t,
         CAST(l_suppkey % 6 AS INTEGER) AS lat_idx,
         CAST(l_partkey % 4 AS INTEGER) AS lon_idx,
         CAST(20.5 + 5 * (l_suppkey % 6) AS DOUBLE) AS lat,
         CAST(0.5 + 10 * (l_partkey % 4) AS DOUBLE) AS lon,
         CASE WHEN l_suppkey % 6 = 0 AND l_partkey % 4 = 0 THEN NULL
              ELSE CAST(SUM(CAST(l_quantity AS BIGINT)) AS DOUBLE) * 0.6 / COUNT(*) END AS sst
  FROM lineitem
  GROUP BY CAST(l_shipdate AS DATE), l_suppkey % 6, l_partkey % 4
)"""

SQL: dict[str, str] = {}


def r_arith(expr: str, n: int) -> str:
    p = f"CAST(1e{n} AS DOUBLE)"
    lim = f"CAST({9.0e18 / 10**n!r} AS DOUBLE)"
    return f"(CASE WHEN ABS({expr}) < {lim} THEN FLOOR(({expr}) * {p} + CAST(0.5 AS DOUBLE)) / {p} ELSE ({expr}) END)"


def out_round(text: str) -> str:
    """Rewrite every ``ROUND(expr, 6)`` as ``R6(R9(expr))`` with ``Rn(x) = floor(x * 10^n + 0.5) / 10^n``.

    Same output convention as the Spark side: plain IEEE arithmetic, so equal inputs give
    equal bits in both engines; the 9-place step absorbs last-bit differences of floating sums.
    """
    out, i, tok = [], 0, "ROUND("
    while True:
        j = text.find(tok, i)
        if j < 0 or (j > 0 and (text[j - 1].isalnum() or text[j - 1] == "_")):
            if j < 0:
                out.append(text[i:])
                return "".join(out)
            out.append(text[i : j + len(tok)])
            i = j + len(tok)
            continue
        depth, k = 1, j + len(tok)
        while depth:
            depth += {"(": 1, ")": -1}.get(text[k], 0)
            k += 1
        inner = text[j + len(tok) : k - 1]
        head, sep, digits = inner.rpartition(",")
        if sep and digits.strip() == "6":
            out.append(text[i:j] + r_arith(r_arith(out_round(head), 9), 6))
        else:
            out.append(text[i:j] + tok + out_round(inner) + ")")
        i = k


def sql(name: str, body: str, *ctes: str) -> None:
    """Register ``WITH cube, <ctes> <body>``."""
    SQL[name] = out_round("WITH " + ",\n".join([CUBE, *ctes]) + "\n" + body)


R = "ROUND({}, 6)"
MONTH = "CAST(MONTH(t) AS INTEGER)"
YEAR = "CAST(YEAR(t) AS INTEGER)"
DOY = "CAST(DAYOFYEAR(t) AS INTEGER)"
DECYEAR = "(CAST(YEAR(t) AS DOUBLE) + (CAST(DAYOFYEAR(t) AS DOUBLE) - 1) / CAST(365.25 AS DOUBLE))"
CUBE_COLS = "t, lat_idx, lon_idx, lat, lon, ROUND(sst, 6) AS sst"
TIME_AX = "tax AS (SELECT t, CAST(ROW_NUMBER() OVER (ORDER BY t) - 1 AS INTEGER) AS time_idx FROM (SELECT DISTINCT t FROM cube))"

# --- sources ------------------------------------------------------------------------------------

sql("load_cube", f"SELECT {CUBE_COLS} FROM cube")

sql("tile_store", f"SELECT {CUBE_COLS} FROM cube")

sql("tile_box", f"SELECT {CUBE_COLS} FROM cube JOIN tax USING (t) WHERE time_idx BETWEEN 100 AND 1500 AND lat_idx BETWEEN 1 AND 4 AND lon_idx BETWEEN 2 AND 3 AND sst > 15", TIME_AX)

sql("ingest_upsert", f"SELECT {CUBE_COLS} FROM cube")

sql(
    "cube_stats",
    """SELECT COUNT(DISTINCT t) AS n_time, COUNT(DISTINCT lat_idx) AS n_lat, COUNT(DISTINCT lon_idx) AS n_lon,
       ROUND(MIN(sst), 6) AS sst_min, ROUND(MAX(sst), 6) AS sst_max, COUNT(sst) AS n_valid,
       COUNT(*) - COUNT(sst) AS n_missing, MIN(t) AS t_min, MAX(t) AS t_max FROM cube""",
)

# --- climatologies --------------------------------------------------------------------------------

MONTHLY = f"""SELECT lat_idx, lon_idx, {MONTH} AS month, MIN(lat) AS lat, MIN(lon) AS lon,
       AVG(sst) AS clim, STDDEV_POP(sst) AS sd FROM {{src}} GROUP BY lat_idx, lon_idx, {MONTH}"""

sql(
    "variability_map",
    """SELECT lat_idx, lon_idx, MIN(lat) AS lat, MIN(lon) AS lon, ROUND(AVG(sd), 6) AS variability
FROM m GROUP BY lat_idx, lon_idx""",
    "sel AS (SELECT * FROM cube WHERE t >= DATE '1982-01-01' AND t < DATE '2026-01-01')",
    "tax AS (SELECT t, ROW_NUMBER() OVER (ORDER BY t) - 1 AS time_idx FROM (SELECT DISTINCT t FROM sel))",
    "sub AS (SELECT sel.* FROM sel JOIN tax USING (t) WHERE time_idx % 3 = 0 AND lat_idx % 2 = 0 AND lon_idx % 2 = 0)",
    "m AS (" + MONTHLY.format(src="sub") + ")",
)

sql(
    "variability_full",
    """SELECT lat_idx, lon_idx, MIN(lat) AS lat, MIN(lon) AS lon, ROUND(AVG(sd), 6) AS variability
FROM m GROUP BY lat_idx, lon_idx""",
    "m AS (" + MONTHLY.format(src="cube") + ")",
)

sql(
    "variability_incremental",
    """SELECT lat_idx, lon_idx, MIN(lat) AS lat, MIN(lon) AS lon, ROUND(AVG(sd), 6) AS variability
FROM m GROUP BY lat_idx, lon_idx""",
    "m AS (" + MONTHLY.format(src="cube") + ")",
)

sql("monthly_clim", "SELECT lat_idx, lon_idx, month, lat, lon, ROUND(clim, 6) AS clim, ROUND(sd, 6) AS sd FROM m",
    "m AS (" + MONTHLY.format(src="cube") + ")")

sql("monthly_incremental", "SELECT lat_idx, lon_idx, month, lat, lon, ROUND(clim, 6) AS clim, ROUND(sd, 6) AS sd FROM m",
    "m AS (" + MONTHLY.format(src="cube") + ")")

sql("monthly_std", "SELECT lat_idx, lon_idx, lat, lon, month, ROUND(sd, 6) AS sd FROM m",
    "m AS (" + MONTHLY.format(src="cube") + ")")

SEASON = """CASE WHEN MONTH(t) IN (12, 1, 2) THEN 'DJF' WHEN MONTH(t) IN (3, 4, 5) THEN 'MAM'
            WHEN MONTH(t) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END"""

sql(
    "season_stats",
    """SELECT lat_idx, lon_idx, season, MIN(lat) AS lat, MIN(lon) AS lon, ROUND(AVG(sst), 6) AS mean,
       ROUND(STDDEV_POP(sst), 6) AS sd,
       CAST(CASE season WHEN 'DJF' THEN 0 WHEN 'MAM' THEN 1 WHEN 'JJA' THEN 2 ELSE 3 END AS INTEGER) AS season_order
FROM s GROUP BY lat_idx, lon_idx, season""",
    f"s AS (SELECT *, {SEASON} AS season FROM cube)",
)

sql(
    "yearly_stats",
    f"""SELECT lat_idx, lon_idx, {YEAR} AS year, MIN(lat) AS lat, MIN(lon) AS lon, ROUND(AVG(sst), 6) AS mean,
       ROUND(STDDEV_POP(sst), 6) AS sd FROM cube GROUP BY lat_idx, lon_idx, {YEAR}""",
)

sql(
    "cell_stats",
    """SELECT lat_idx, lon_idx, MIN(lat) AS lat, MIN(lon) AS lon, ROUND(AVG(sst), 6) AS mean,
       ROUND(STDDEV_POP(sst), 6) AS sd FROM cube GROUP BY lat_idx, lon_idx""",
)

sql(
    "doy_clim",
    f"""SELECT lat_idx, lon_idx, {DOY} AS dayofyear, MIN(lat) AS lat, MIN(lon) AS lon, ROUND(AVG(sst), 6) AS clim
FROM cube GROUP BY lat_idx, lon_idx, {DOY}""",
)

ANOM = f"""an AS (SELECT *, {MONTH} AS month,
       sst - AVG(sst) OVER (PARTITION BY lat_idx, lon_idx, MONTH(t)) AS anom FROM cube)"""

sql("anomaly", f"SELECT {CUBE_COLS}, month, ROUND(anom, 6) AS anom FROM an", ANOM)

REGION = """rs AS (SELECT t, CAST(YEAR(t) AS INTEGER) AS year, CAST(MONTH(t) AS INTEGER) AS month, region_mean,
       region_mean - AVG(region_mean) OVER (PARTITION BY MONTH(t)) AS anom
FROM (SELECT t, AVG(sst) AS region_mean FROM cube GROUP BY t))"""

sql("region_series", "SELECT t, year, month, ROUND(region_mean, 6) AS region_mean, ROUND(anom, 6) AS anom FROM rs",
    REGION)

sql(
    "region_series_coslat",
    "SELECT t, year, month, ROUND(region_mean, 6) AS region_mean, ROUND(anom, 6) AS anom FROM rs",
    """rs AS (SELECT t, CAST(YEAR(t) AS INTEGER) AS year, CAST(MONTH(t) AS INTEGER) AS month, region_mean,
       region_mean - AVG(region_mean) OVER (PARTITION BY MONTH(t)) AS anom
FROM (SELECT t, SUM(CASE WHEN sst IS NOT NULL THEN COS(RADIANS(lat)) * sst END)
              / SUM(CASE WHEN sst IS NOT NULL THEN COS(RADIANS(lat)) END) AS region_mean
      FROM cube GROUP BY t))""",
)

sql(
    "region_quantiles",
    """SELECT ROUND(QUANTILE_CONT(region_mean, 0.10), 6) AS q10, ROUND(QUANTILE_CONT(region_mean, 0.90), 6) AS q90,
       CAST(TRUNC(AVG(region_mean)) AS INTEGER) AS mean_int FROM rs""",
    REGION,
)

# --- selection ------------------------------------------------------------------------------------

sql("region_labels", f"SELECT {CUBE_COLS} FROM cube WHERE lat BETWEEN 25.5 AND 40.5 AND lon BETWEEN 10.5 AND 30.5")

sql(
    "region_index",
    f"""SELECT {CUBE_COLS} FROM cube
WHERE lat_idx BETWEEN (SELECT MIN(i) FROM lax WHERE lat IN (40.5, 25.5)) AND (SELECT MAX(i) FROM lax WHERE lat IN (40.5, 25.5))
  AND lon_idx BETWEEN (SELECT MIN(j) FROM lox WHERE lon IN (10.5, 30.5)) AND (SELECT MAX(j) FROM lox WHERE lon IN (10.5, 30.5))""",
    "lax AS (SELECT lat, ROW_NUMBER() OVER (ORDER BY lat) - 1 AS i FROM (SELECT DISTINCT lat FROM cube))",
    "lox AS (SELECT lon, ROW_NUMBER() OVER (ORDER BY lon) - 1 AS j FROM (SELECT DISTINCT lon FROM cube))",
)

sql("time_range", f"SELECT {CUBE_COLS} FROM cube WHERE t >= DATE '1996-03-01' AND t < DATE '1999-01-01'")

sql("year_slice", f"SELECT {CUBE_COLS} FROM cube WHERE t >= DATE '1997-01-01' AND t < DATE '1998-01-01'")

sql(
    "stride_subsample",
    f"SELECT {CUBE_COLS} FROM cube JOIN tax USING (t) WHERE time_idx % 3 = 0 AND lat_idx % 2 = 0 AND lon_idx % 2 = 0",
    TIME_AX,
)

sql("last_frame", f"SELECT {CUBE_COLS} FROM cube WHERE t = (SELECT MAX(t) FROM cube)")

POINTS = """pts(point_id, plat, plon) AS (SELECT * FROM (VALUES (1::BIGINT, 23.0::DOUBLE, 5.5::DOUBLE), (2, 40.4, 30.5), (3, 5.0, 99.0), (4, 31.0, 16.0))
  UNION ALL SELECT CAST(n_nationkey AS BIGINT) + 100, CAST(2 * n_nationkey AS DOUBLE) + CAST(0.75 AS DOUBLE),
         CAST(47.0 AS DOUBLE) - n_nationkey * CAST(2.25 AS DOUBLE) FROM nation)"""
NEAREST = """near AS (
  SELECT p.point_id, p.plat AS point_lat, p.plon AS point_lon, la.lat_idx, la.lat, lo.lon_idx, lo.lon
  FROM pts p
  JOIN (SELECT point_id, lat_idx, lat FROM (
          SELECT p.point_id, a.lat_idx, a.lat,
                 ROW_NUMBER() OVER (PARTITION BY p.point_id ORDER BY ABS(a.lat - p.plat), a.lat DESC) AS rn
          FROM pts p, (SELECT DISTINCT lat_idx, lat FROM cube) a) WHERE rn = 1) la USING (point_id)
  JOIN (SELECT point_id, lon_idx, lon FROM (
          SELECT p.point_id, a.lon_idx, a.lon,
                 ROW_NUMBER() OVER (PARTITION BY p.point_id ORDER BY ABS(a.lon - p.plon), a.lon DESC) AS rn
          FROM pts p, (SELECT DISTINCT lon_idx, lon FROM cube) a) WHERE rn = 1) lo USING (point_id))"""

sql("nearest_point", "SELECT point_id, point_lat, point_lon, lat_idx, lon_idx, lat, lon FROM near", POINTS, NEAREST)

sql(
    "point_series",
    f"""SELECT point_id, t, lat_idx, lon_idx, ROUND(anom, 6) AS anomalies, {YEAR} AS year,
       ROUND({DECYEAR}, 6) AS continuous_time FROM ps""",
    POINTS,
    NEAREST,
    """ps AS (SELECT n.point_id, c.*, c.sst - AVG(c.sst) OVER (PARTITION BY n.point_id, c.lat_idx, c.lon_idx, MONTH(c.t)) AS anom
FROM cube c JOIN near n USING (lat_idx, lon_idx))""",
)

LAND = "land AS (SELECT lat_idx, lon_idx, MIN(lat) AS lat, MIN(lon) AS lon, COUNT(sst) = 0 AS land FROM cube GROUP BY lat_idx, lon_idx)"

sql("land_mask", "SELECT * FROM land", LAND)

sql(
    "mask_apply",
    """SELECT py.lat_idx, py.lon_idx, py.year, CASE WHEN land.land THEN NULL ELSE py.n_steps END AS n_steps
FROM py JOIN land USING (lat_idx, lon_idx)""",
    LAND,
    f"py AS (SELECT lat_idx, lon_idx, {YEAR} AS year, COUNT(*) AS n_steps FROM cube GROUP BY lat_idx, lon_idx, {YEAR})",
)

REFMASK = """refmask AS (
  SELECT g.lat_idx, g.lon_idx, g.lat, g.lon FROM (SELECT DISTINCT lat_idx, lon_idx, lat, lon FROM cube) g
  ANTI JOIN (SELECT DISTINCT lat_idx, lon_idx FROM cube WHERE t = (SELECT MIN(t) FROM cube) AND sst IS NOT NULL) p
  USING (lat_idx, lon_idx))"""

sql(
    "mask_reference",
    """SELECT c.t, c.lat_idx, c.lon_idx, c.lat, c.lon, CASE WHEN m.lat_idx IS NULL THEN ROUND(c.sst, 6) END AS sst
FROM cube c LEFT JOIN m USING (lat_idx, lon_idx)""",
    REFMASK,
    """m AS (SELECT DISTINCT CAST((n - lat_idx) % n AS INTEGER) AS lat_idx, lon_idx
FROM refmask, (SELECT COUNT(DISTINCT lat_idx) AS n FROM cube))""",
)

sql(
    "mask_reference_coord",
    """SELECT c.t, c.lat_idx, c.lon_idx, c.lat, c.lon, CASE WHEN m.lat IS NULL THEN ROUND(c.sst, 6) END AS sst
FROM cube c LEFT JOIN (SELECT DISTINCT lat, lon FROM refmask) m USING (lat, lon)""",
    REFMASK,
)

sql("drop_missing", f"SELECT {CUBE_COLS} FROM cube WHERE sst IS NOT NULL")

sql("exclude_years", f"SELECT {CUBE_COLS} FROM cube WHERE YEAR(t) NOT IN (1995, 2001)")

sql(
    "section_lat",
    """SELECT t, year, lon_idx, lon, ROUND(sst, 6) AS sst, ROUND(MIN(sst) OVER (), 6) AS vmin,
       ROUND(MAX(sst) OVER (), 6) AS vmax FROM s""",
    f"s AS (SELECT t, {YEAR} AS year, lon_idx, lon, sst FROM cube WHERE lat_idx = 2 AND YEAR(t) IN (1996, 2000))",
)

# --- scalar functions ---------------------------------------------------------------------------------

sql("time_parts", f"SELECT {CUBE_COLS}, {YEAR} AS year, {MONTH} AS month, {DOY} AS dayofyear FROM cube")

sql("decimal_year", f"SELECT t, lat_idx, lon_idx, ROUND({DECYEAR}, 6) AS decimal_year FROM cube")


# --- trend, rolling, resampling ---------------------------------------------------------------------


def R9(expr: str) -> str:
    return r_arith(expr, 9)


AN9 = f"""an9 AS (SELECT *, {MONTH} AS month,
       {R9("sst - AVG(sst) OVER (PARTITION BY lat_idx, lon_idx, MONTH(t))")} AS anom FROM cube)"""

sql(
    "trend_map",
    f"""SELECT lat_idx, lon_idx, MIN(lat) AS lat, MIN(lon) AS lon,
       ROUND(REGR_SLOPE(anom, {DECYEAR}) * 10, 6) AS trend_decade,
       ROUND(REGR_INTERCEPT(anom, {DECYEAR}), 6) AS intercept,
       CAST(REGR_COUNT(anom, {DECYEAR}) AS BIGINT) AS n,
       ROUND(ROUND_EVEN(REGR_SLOPE(anom, {DECYEAR}) * 10, 3), 6) AS trend_r3
FROM an9 GROUP BY lat_idx, lon_idx""",
    AN9,
)

sql(
    "trend_fit",
    f"""SELECT t, lat_idx, lon_idx, ROUND(anom, 6) AS anom, ROUND(x, 6) AS continuous_time,
       ROUND(REGR_INTERCEPT(anom, x) OVER w + REGR_SLOPE(anom, x) OVER w * x, 6) AS pred_ols
FROM (SELECT *, {DECYEAR} AS x FROM an9) WINDOW w AS (PARTITION BY lat_idx, lon_idx)""",
    AN9,
)

# every cell x every step of the shared axis: absent rows stand as missing values
DENSE_AN = """dn AS (SELECT cells.lat_idx, cells.lon_idx, tax.t, a.anom, a.t IS NOT NULL AS present
FROM (SELECT DISTINCT lat_idx, lon_idx FROM an9) cells CROSS JOIN tax
LEFT JOIN an9 a ON a.lat_idx = cells.lat_idx AND a.lon_idx = cells.lon_idx AND a.t = tax.t)"""

ROLLED = """SELECT t, lat_idx, lon_idx, ROUND(anom, 6) AS anom, ROUND(rolled, 6) AS rolled
FROM (SELECT *, CASE WHEN COUNT(anom) OVER w = 51 THEN AVG(anom) OVER w END AS rolled
      FROM dn WINDOW w AS (PARTITION BY lat_idx, lon_idx ORDER BY t ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING))
WHERE present"""

sql("rolling_mean", ROLLED, AN9, TIME_AX, DENSE_AN)


def sme(src: str, value: str) -> list[str]:
    """CTEs for a semi-month resample of ``value`` in ``src`` -> ``res(lat_idx, lon_idx, t, mean)``."""
    return [
        f"""b AS (SELECT lat_idx, lon_idx, {value} AS v,
       CASE WHEN t = LAST_DAY(t) THEN t
            WHEN DAY(t) >= 15 THEN CAST(DATE_TRUNC('month', t) + INTERVAL 14 DAY AS DATE)
            ELSE CAST(DATE_TRUNC('month', t) - INTERVAL 1 DAY AS DATE) END AS t FROM {src})""",
        "mm AS (SELECT lat_idx, lon_idx, t, AVG(v) AS mean FROM b GROUP BY lat_idx, lon_idx, t)",
        """months AS (SELECT CAST(generate_series AS DATE) AS m FROM generate_series(
       CAST((SELECT DATE_TRUNC('month', MIN(t)) FROM b) AS TIMESTAMP) - INTERVAL 1 MONTH,
       CAST((SELECT DATE_TRUNC('month', MAX(t)) FROM b) AS TIMESTAMP), INTERVAL 1 MONTH))""",
        """bins AS (SELECT x AS t FROM (SELECT CAST(m + INTERVAL 14 DAY AS DATE) AS x FROM months
                              UNION SELECT LAST_DAY(m) FROM months)
       WHERE x BETWEEN (SELECT MIN(t) FROM b) AND (SELECT MAX(t) FROM b))""",
        """res AS (SELECT c.lat_idx, c.lon_idx, bins.t, mm.mean
FROM (SELECT DISTINCT lat_idx, lon_idx FROM cube) c CROSS JOIN bins
LEFT JOIN mm ON mm.lat_idx = c.lat_idx AND mm.lon_idx = c.lon_idx AND mm.t = bins.t)""",
    ]


sql("resample_sme", "SELECT lat_idx, lon_idx, t, ROUND(mean, 6) AS mean FROM res", *sme("cube", "sst"))

sql(
    "rolling_sme",
    """SELECT lat_idx, lon_idx, t, ROUND(mean, 6) AS mean,
       ROUND(CASE WHEN COUNT(mean) OVER w = 72 THEN AVG(mean) OVER w END, 6) AS rolled
FROM res WINDOW w AS (PARTITION BY lat_idx, lon_idx ORDER BY t ROWS BETWEEN 36 PRECEDING AND 35 FOLLOWING)""",
    AN9,
    *sme("an9", "anom"),
)

# --- extremes -------------------------------------------------------------------------------------------

sql(
    "point_quantiles",
    """SELECT lat_idx, lon_idx, MIN(lat) AS lat, MIN(lon) AS lon,
       ROUND(QUANTILE_CONT(anom, 0.05), 6) AS q05, ROUND(QUANTILE_CONT(anom, 0.10), 6) AS q10,
       ROUND(QUANTILE_CONT(anom, 0.90), 6) AS q90, ROUND(QUANTILE_CONT(anom, 0.95), 6) AS q95
FROM an9 GROUP BY lat_idx, lon_idx""",
    AN9,
)

FL = f"""fl AS (SELECT t, lat_idx, lon_idx, anom, {YEAR} AS year, threshold,
       CAST(COALESCE({R9("anom")} > {R9("threshold")}, FALSE) AS INTEGER) AS q95
FROM (SELECT *, QUANTILE_CONT(anom, 0.95) OVER (PARTITION BY lat_idx, lon_idx) AS threshold FROM an9))"""

sql("point_extremes",
    "SELECT t, lat_idx, lon_idx, ROUND(anom, 6) AS anom, year, ROUND(threshold, 6) AS threshold, q95 FROM fl", AN9, FL)

sql("extreme_rows",
    "SELECT t, lat_idx, lon_idx, ROUND(anom, 6) AS anom, year, ROUND(threshold, 6) AS threshold, q95 FROM fl WHERE q95 = 1",
    AN9, FL)

EP = """ep AS (SELECT s.lat_idx, s.lon_idx, s.year, CAST(COALESCE(p.n, 0) AS BIGINT) AS n_extreme
FROM (SELECT lat_idx, lon_idx, CAST(UNNEST(generate_series(MIN(year), MAX(year))) AS INTEGER) AS year
      FROM fl GROUP BY lat_idx, lon_idx) s
LEFT JOIN (SELECT lat_idx, lon_idx, year, SUM(q95) AS n FROM fl GROUP BY lat_idx, lon_idx, year) p
USING (lat_idx, lon_idx, year))"""

sql("extremes_per_year", "SELECT * FROM ep", AN9, FL, EP)

sql("flag_counts", "SELECT lat_idx, lon_idx, q95 AS flag, COUNT(*) AS n FROM fl GROUP BY lat_idx, lon_idx, q95", AN9, FL)

sql(
    "year_histogram",
    """SELECT s.lat_idx, s.lon_idx, s.bin_start, CAST(COALESCE(c.n, 0) AS BIGINT) AS n
FROM (SELECT lat_idx, lon_idx, CAST(UNNEST(generate_series(MIN(year), MAX(year))) AS INTEGER) AS bin_start
      FROM fl WHERE q95 = 1 GROUP BY lat_idx, lon_idx) s
LEFT JOIN (SELECT lat_idx, lon_idx, year AS bin_start, COUNT(*) AS n FROM fl WHERE q95 = 1 GROUP BY ALL) c
USING (lat_idx, lon_idx, bin_start)""",
    AN9, FL,
)

sql("repeat_years",
    "SELECT lat_idx, lon_idx, year FROM (SELECT lat_idx, lon_idx, year, UNNEST(range(n_extreme)) AS r FROM ep)",
    AN9, FL, EP)


def kde(factor: str, keys: str = "lat_idx, lon_idx", points: int = 400, seen: str = "year") -> list[str]:
    k_of = lambda t: ", ".join(f"{t}.{k.strip()}" for k in keys.split(","))
    return [
        f"""st AS (SELECT {keys}, MIN({seen}) AS y0, MAX({seen}) AS y1, MAX(n_extreme) AS nmax,
       CAST(SUM(n_extreme) AS DOUBLE) AS nn, CAST(SUM(n_extreme * year) AS DOUBLE) / CAST(SUM(n_extreme) AS DOUBLE) AS mu
FROM ep GROUP BY {keys})""",
        f"""par AS (SELECT st.*, {factor} * SQRT(v.ss / (st.nn - 1)) AS h FROM st JOIN (
       SELECT {k_of("e")}, SUM(e.n_extreme * POW(e.year - s.mu, 2)) AS ss
       FROM ep e JOIN st s USING ({keys}) GROUP BY {k_of("e")}) v USING ({keys})
WHERE st.nn >= 2)""",
        f"""g AS (SELECT par.*, CAST(i AS INTEGER) AS i,
       CASE WHEN i = {points - 1} THEN CAST(y1 AS DOUBLE)
            ELSE CAST(y0 AS DOUBLE) + CAST(i AS DOUBLE) * (CAST(y1 - y0 AS DOUBLE) / CAST({points - 1} AS DOUBLE)) END AS x
FROM par, range({points}) r(i) WHERE h > 0)""",
        f"""k AS (SELECT {k_of("g")}, g.i, g.x, g.nmax, g.nn,
       SUM(e.n_extreme * EXP(-0.5 * POW((g.x - e.year) / g.h, 2))) / (g.nn * g.h * SQRT(2 * PI())) AS kde
FROM g JOIN ep e USING ({keys}) GROUP BY {k_of("g")}, g.i, g.x, g.nmax, g.nn, g.h)""",
    ]


def kde_out(keys: str = "lat_idx, lon_idx", scaled: str | None = None) -> str:
    scaled = scaled or f"kde * (nmax / MAX(kde) OVER (PARTITION BY {keys}))"
    return f"""SELECT {keys}, i, ROUND(x, 6) AS year_x, ROUND(kde, 6) AS kde,
       ROUND({scaled}, 6) AS kde_scaled FROM k"""


sql("kde_years", kde_out(), AN9, FL, EP, *kde("0.35"))
# a histogram's curve: over the years with events, density x events x one year
sql("kde_scott", kde_out(scaled="kde * nn"), AN9, FL, EP,
    *kde("POW(st.nn, -0.2)", points=200, seen="CASE WHEN n_extreme > 0 THEN year END"))

sql(
    "global_quantiles",
    "SELECT ROUND(QUANTILE_CONT(anom, 0.01), 6) AS p001, ROUND(QUANTILE_CONT(anom, 0.99), 6) AS p099 FROM an9",
    AN9,
)

sql(
    "exceed_fraction",
    f"""SELECT c.lat_idx, c.lon_idx, CAST(st.y AS INTEGER) AS year, ROUND(COUNT(a.t) / st.n, 6) AS fraction
FROM (SELECT DISTINCT lat_idx, lon_idx FROM cube) c
CROSS JOIN (SELECT YEAR(t) AS y, COUNT(*) AS n FROM (SELECT DISTINCT t FROM cube) GROUP BY YEAR(t)) st
LEFT JOIN (SELECT * FROM cube WHERE sst > (SELECT QUANTILE_CONT(sst, 0.9) FROM cube)) a
  ON a.lat_idx = c.lat_idx AND a.lon_idx = c.lon_idx AND YEAR(a.t) = st.y
GROUP BY c.lat_idx, c.lon_idx, st.y, st.n""",
)

sql(
    "clip_scale",
    """SELECT t, lat_idx, lon_idx, ROUND(anom, 6) AS anom, ROUND(c, 6) AS clipped,
       ROUND((c - CAST(-2.0892258 AS DOUBLE)) / (CAST(2.215498 AS DOUBLE) - CAST(-2.0892258 AS DOUBLE)), 6) AS scaled
FROM (SELECT *, CASE WHEN anom IS NOT NULL THEN LEAST(GREATEST(anom, CAST(-2.0892258 AS DOUBLE)), CAST(2.215498 AS DOUBLE)) END AS c FROM an9)""",
    AN9,
)

# --- heatwaves --------------------------------------------------------------------------------------------

THR = [
    """ax AS (SELECT d, CAST(ROW_NUMBER() OVER (ORDER BY d) - 1 AS INTEGER) AS pos, COUNT(*) OVER () AS n
FROM (SELECT DISTINCT CAST(DAYOFYEAR(t) AS INTEGER) AS d FROM cube))""",
    """thr AS (SELECT c.lat_idx, c.lon_idx, a.d AS dayofyear, QUANTILE_CONT(v.sst, 0.75) AS thr
FROM (SELECT DISTINCT lat_idx, lon_idx FROM cube) c
CROSS JOIN ax a CROSS JOIN range(-5, 6) o(off)
JOIN ax a2 ON a2.pos = (a.pos + o.off + a.n) % a.n
LEFT JOIN (SELECT lat_idx, lon_idx, CAST(DAYOFYEAR(t) AS INTEGER) AS d, sst FROM cube WHERE sst IS NOT NULL) v
  ON v.lat_idx = c.lat_idx AND v.lon_idx = c.lon_idx AND v.d = a2.d
GROUP BY c.lat_idx, c.lon_idx, a.d)""",
]

EX = f"""ex AS (SELECT c.t, c.lat_idx, c.lon_idx, c.lat, c.lon, c.sst, {DOY} AS dayofyear, thr.thr,
       COALESCE({R9("c.sst")} > {R9("thr.thr")}, FALSE) AS exceed
FROM cube c JOIN thr ON thr.lat_idx = c.lat_idx AND thr.lon_idx = c.lon_idx AND thr.dayofyear = DAYOFYEAR(c.t))"""


def marked(n: int = 3) -> list[str]:
    """Runs of ``n`` on a dense spine: a step without a row is not an exceedance; ``mk`` has all steps."""
    return [
        TIME_AX,
        """dx AS (SELECT cells.lat_idx, cells.lon_idx, tax.t, e.lat, e.lon, e.sst, e.thr, COALESCE(e.exceed, FALSE) AS exceed,
       e.t IS NOT NULL AS present
FROM (SELECT DISTINCT lat_idx, lon_idx FROM ex) cells CROSS JOIN tax
LEFT JOIN ex e ON e.lat_idx = cells.lat_idx AND e.lon_idx = cells.lon_idx AND e.t = tax.t)""",
        f"""mk AS (SELECT *, exceed AND SUM(CAST(exceed AS INTEGER)) OVER (PARTITION BY lat_idx, lon_idx, isl) >= {n} AS mhw
FROM (SELECT *, SUM(CASE WHEN exceed THEN 0 ELSE 1 END)
                OVER (PARTITION BY lat_idx, lon_idx ORDER BY t ROWS UNBOUNDED PRECEDING) AS isl FROM dx))""",
    ]


MK = marked()

sql("doy_threshold", "SELECT lat_idx, lon_idx, dayofyear, ROUND(thr, 6) AS thr FROM thr", *THR)

sql("exceedance",
    "SELECT t, lat_idx, lon_idx, ROUND(sst, 6) AS sst, dayofyear, ROUND(thr, 6) AS thr, exceed FROM ex", *THR, EX)

MASK_OUT = "SELECT t, lat_idx, lon_idx, ROUND(sst, 6) AS sst, ROUND(thr, 6) AS thr, exceed, mhw FROM mk WHERE present"
sql("mhw_mask", MASK_OUT, *THR, EX, *MK)
sql("apply_along_time", MASK_OUT, *THR, EX, *MK)

DAYS = f"""days AS (SELECT m.lat_idx, m.lon_idx, {YEAR} AS year,
       CASE WHEN MAX(l.land) THEN NULL ELSE CAST(SUM(CAST(mhw AS INTEGER)) AS BIGINT) END AS days
FROM mk m JOIN land l USING (lat_idx, lon_idx) GROUP BY m.lat_idx, m.lon_idx, {YEAR})"""

sql("mhw_days", "SELECT * FROM days", *THR, EX, *MK, LAND, DAYS)

def events(n: int = 3) -> str:
    return f"""events AS (SELECT e.lat_idx, e.lon_idx, e.year, CASE WHEN l.land THEN NULL ELSE e.events END AS events
FROM (SELECT lat_idx, lon_idx, year, CAST(SUM(CAST(st AS INTEGER)) AS BIGINT) AS events FROM (
        SELECT *, lng AND NOT COALESCE(LAG(lng) OVER (PARTITION BY lat_idx, lon_idx, year ORDER BY t), FALSE) AS st
        FROM (SELECT *, mhw AND SUM(CAST(mhw AS INTEGER)) OVER (PARTITION BY lat_idx, lon_idx, year, isl2) >= {n} AS lng
              FROM (SELECT *, SUM(CASE WHEN mhw THEN 0 ELSE 1 END) OVER (
                        PARTITION BY lat_idx, lon_idx, year ORDER BY t ROWS UNBOUNDED PRECEDING) AS isl2
                    FROM (SELECT *, {YEAR} AS year FROM mk))))
      GROUP BY lat_idx, lon_idx, year) e
JOIN land l USING (lat_idx, lon_idx))"""


EVENTS = events()

sql("mhw_events", "SELECT * FROM events", *THR, EX, *MK, LAND, EVENTS)

sql(
    "mhw_pipeline",
    """SELECT d.year, d.lat_idx, d.lon_idx, bl.lat, bo.lon, ROUND(d.days, 6) AS days
FROM (SELECT year, CAST(lat_idx // 2 AS INTEGER) AS lat_idx, CAST(lon_idx // 2 AS INTEGER) AS lon_idx,
             AVG(days) AS days FROM days WHERE lat_idx < 6 AND lon_idx < 4 GROUP BY ALL) d
JOIN (SELECT CAST(lat_idx // 2 AS INTEGER) AS lat_idx, AVG(lat) AS lat
      FROM (SELECT DISTINCT lat_idx, lat FROM cube) WHERE lat_idx < 6 GROUP BY 1) bl USING (lat_idx)
JOIN (SELECT CAST(lon_idx // 2 AS INTEGER) AS lon_idx, AVG(lon) AS lon
      FROM (SELECT DISTINCT lon_idx, lon FROM cube) WHERE lon_idx < 4 GROUP BY 1) bo USING (lon_idx)""",
    *THR, EX, *MK, LAND, DAYS,
)

sql(
    "dedup_days",
    f"""SELECT {CUBE_COLS} FROM (SELECT *, ROW_NUMBER() OVER (
       PARTITION BY lat_idx, lon_idx, YEAR(t), DAYOFYEAR(t) ORDER BY t, sst) AS rn FROM cube) WHERE rn = 1""",
)

# --- grid reshaping ------------------------------------------------------------------------------------------


def coarsen_sql(k_lat: int, k_lon: int, keep_lat: int, keep_lon: int) -> str:
    return f"""SELECT d.t, d.lat_idx, d.lon_idx, bl.lat, bo.lon, ROUND(d.sst, 6) AS sst
FROM (SELECT t, CAST(lat_idx // {k_lat} AS INTEGER) AS lat_idx, CAST(lon_idx // {k_lon} AS INTEGER) AS lon_idx,
             AVG(sst) AS sst FROM cube WHERE lat_idx < {keep_lat} AND lon_idx < {keep_lon} GROUP BY ALL) d
JOIN (SELECT CAST(lat_idx // {k_lat} AS INTEGER) AS lat_idx, AVG(lat) AS lat
      FROM (SELECT DISTINCT lat_idx, lat FROM cube) WHERE lat_idx < {keep_lat} GROUP BY 1) bl USING (lat_idx)
JOIN (SELECT CAST(lon_idx // {k_lon} AS INTEGER) AS lon_idx, AVG(lon) AS lon
      FROM (SELECT DISTINCT lon_idx, lon FROM cube) WHERE lon_idx < {keep_lon} GROUP BY 1) bo USING (lon_idx)"""


sql("coarsen_exact", coarsen_sql(2, 2, 6, 4))
sql("coarsen_trim", coarsen_sql(4, 4, 4, 4))

sql(
    "unstack_year",
    """SELECT s.lat_idx, s.lon_idx, s.year, s.dayofyear, ROUND(c.sst, 6) AS sst
FROM (SELECT * FROM (SELECT DISTINCT lat_idx, lon_idx FROM cube)
      CROSS JOIN (SELECT DISTINCT CAST(YEAR(t) AS INTEGER) AS year FROM cube)
      CROSS JOIN (SELECT DISTINCT CAST(DAYOFYEAR(t) AS INTEGER) AS dayofyear FROM cube)) s
LEFT JOIN cube c ON c.lat_idx = s.lat_idx AND c.lon_idx = s.lon_idx
  AND YEAR(c.t) = s.year AND DAYOFYEAR(c.t) = s.dayofyear""",
)

# --- sources and sinks ---------------------------------------------------------------------------------------

sql("concat_time", f"SELECT {CUBE_COLS} FROM cube")
sql("sort_time", f"SELECT {CUBE_COLS} FROM cube")

sql(
    "decode_time",
    """SELECT t, lat_idx, lon_idx, ROUND(days, 6) AS days,
       CAST(TIMESTAMP '1800-01-01 00:00:00' + TO_MICROSECONDS(CAST(days * CAST(86400000000 AS DOUBLE) AS BIGINT)) AS TIMESTAMP) AS t_decoded
FROM (SELECT t, lat_idx, lon_idx, CAST(DATEDIFF('day', DATE '1800-01-01', t) AS DOUBLE) AS days FROM cube)""",
)

sql(
    "decode_time_fraction",
    """SELECT t, lat_idx, lon_idx, ROUND(hours, 6) AS hours,
       CAST(TIMESTAMP '0001-01-01 00:00:00' + TO_MICROSECONDS(CAST(FLOOR(hours) AS BIGINT) * 3600000000
         + CAST(FLOOR((hours - FLOOR(hours)) * 3600000000 + 0.5) AS BIGINT)) AS TIMESTAMP) AS t_decoded
FROM (SELECT t, lat_idx, lon_idx, CAST(DATEDIFF('day', DATE '0001-01-01', t) AS DOUBLE) * 24 + CAST(lat_idx * 4 + lon_idx AS DOUBLE) / 10 AS hours FROM cube)""",
)

sql(
    "decode_values",
    """SELECT t, lat_idx, lon_idx, raw,
       ROUND(CASE WHEN raw <> -32767 THEN CAST(raw AS DOUBLE) * CAST(0.01 AS DOUBLE) + CAST(0.0 AS DOUBLE) END, 6) AS sst
FROM (SELECT t, lat_idx, lon_idx,
             CAST(CASE WHEN sst IS NULL THEN -32767 ELSE FLOOR(sst * CAST(100.0 AS DOUBLE) + CAST(0.5 AS DOUBLE)) END AS SMALLINT) AS raw
      FROM cube)""",
)

sql(
    "map_float32",
    """SELECT lat_idx, lon_idx, lat, lon, CAST(ROUND(v, 6) AS FLOAT) AS variability FROM (
SELECT lat_idx, lon_idx, MIN(lat) AS lat, MIN(lon) AS lon, AVG(sd) AS v FROM m GROUP BY lat_idx, lon_idx)""",
    "sel AS (SELECT * FROM cube WHERE t >= DATE '1982-01-01' AND t < DATE '2026-01-01')",
    "tax AS (SELECT t, ROW_NUMBER() OVER (ORDER BY t) - 1 AS time_idx FROM (SELECT DISTINCT t FROM sel))",
    "sub AS (SELECT sel.* FROM sel JOIN tax USING (t) WHERE time_idx % 3 = 0 AND lat_idx % 2 = 0 AND lon_idx % 2 = 0)",
    "m AS (" + MONTHLY.format(src="sub") + ")",
)

# --- reports ---------------------------------------------------------------------------------------------------


def report(keys: str, src: str) -> str:
    return f"""SELECT {keys}, MIN(lat) AS lat, MIN(lon) AS lon,
       ROUND(REGR_SLOPE(anom, {DECYEAR}) * 10, 6) AS trend_decade,
       ROUND(MAX(threshold), 6) AS threshold, COUNT(anom) AS n_valid,
       CAST(SUM(flag) AS BIGINT) AS n_extreme, MIN(year) AS first_year, MAX(year) AS last_year,
       ROUND(ROUND_EVEN(REGR_SLOPE(anom, {DECYEAR}) * 10, 3), 6) AS trend_r3
FROM {src} GROUP BY {keys}"""


def flags_over(src: str, keys: str) -> str:
    return f"""(SELECT *, {YEAR} AS year, CAST(COALESCE({R9("anom")} > {R9("threshold")}, FALSE) AS INTEGER) AS flag
FROM (SELECT *, QUANTILE_CONT(anom, 0.95) OVER (PARTITION BY {keys}) AS threshold FROM {src}))"""


sql("cell_reports", report("lat_idx, lon_idx", flags_over("an9", "lat_idx, lon_idx")), AN9)

sql(
    "point_report",
    report("point_id, lat_idx, lon_idx", flags_over("pa", "point_id, lat_idx, lon_idx")),
    POINTS,
    NEAREST,
    f"""pa AS (SELECT n.point_id, c.*,
       {R9("c.sst - AVG(c.sst) OVER (PARTITION BY n.point_id, c.lat_idx, c.lon_idx, MONTH(c.t))")} AS anom
FROM cube c JOIN near n USING (lat_idx, lon_idx))""",
)

REFGRID = """ref AS (SELECT CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS t, CAST(o_custkey % 6 AS INTEGER) AS lat_idx,
       CAST((o_custkey // 6) % 4 AS INTEGER) AS lon_idx, CAST(20.5 + 5 * (o_custkey % 6) AS DOUBLE) AS lat,
       CAST(0.5 + 10 * ((o_custkey // 6) % 4) AS DOUBLE) AS lon, CAST(SUM(FLOOR(o_totalprice)) AS BIGINT) AS q
FROM orders GROUP BY ALL)"""

REGION9 = ["""rmask AS (SELECT lat, lon FROM ref GROUP BY lat, lon
HAVING COALESCE(MAX(CASE WHEN t = (SELECT MIN(t) FROM ref) AND q % 4 <> 0 THEN 1 END), 0) = 0)""",
    """mc AS (SELECT c.t, c.lat_idx, c.lon_idx, c.lat, c.lon, CASE WHEN m.lat IS NULL THEN c.sst END AS sst
FROM cube c LEFT JOIN rmask m USING (lat, lon)
WHERE c.lat BETWEEN 20.5 AND 40.5 AND c.lon BETWEEN 0.5 AND 20.5)""",
    f"""an9 AS (SELECT *, {MONTH} AS month, {R9("sst - AVG(sst) OVER (PARTITION BY lat_idx, lon_idx, MONTH(t))")} AS anom FROM mc)"""]


sql(
    "regional_study",
    f"""SELECT point_id, flag, COUNT(*) AS n FROM {flags_over("ps", "point_id, lat_idx, lon_idx")}
WHERE year <> 2001 GROUP BY point_id, flag""",
    REFGRID,
    *REGION9,
    POINTS,
    NEAREST.replace("FROM cube) a", "FROM mc) a"),
    "ps AS (SELECT n.point_id, a.* FROM an9 a JOIN near n USING (lat_idx, lon_idx))",
)

sql(
    "regional_maps",
    f"""SELECT v.lat_idx, v.lon_idx, v.lat, v.lon, ROUND(v.variability, 6) AS variability, v.n_valid, ROUND(s.slope * 10, 6) AS trend_decade
FROM (SELECT lat_idx, lon_idx, MIN(lat) AS lat, MIN(lon) AS lon, AVG(sd) AS variability, CAST(SUM(n) AS BIGINT) AS n_valid
      FROM (SELECT lat_idx, lon_idx, month, MIN(lat) AS lat, MIN(lon) AS lon, STDDEV_POP(sst) AS sd, COUNT(anom) AS n
            FROM an9 GROUP BY lat_idx, lon_idx, month) GROUP BY lat_idx, lon_idx) v
JOIN (SELECT lat_idx, lon_idx, REGR_SLOPE(anom, {DECYEAR}) AS slope FROM an9 GROUP BY lat_idx, lon_idx) s USING (lat_idx, lon_idx)""",
    REFGRID, *REGION9,
)


def series_report(src: str, keys: str) -> tuple[str, str]:
    """(query, CTE of the dense spine) of the per-step report."""
    on = " AND ".join(f"a.{k.strip()} = cells.{k.strip()}" for k in keys.split(","))
    dense = f"""dn AS (SELECT cells.*, tax.t, a.anom, a.t IS NOT NULL AS present
FROM (SELECT DISTINCT {keys} FROM {src}) cells CROSS JOIN tax LEFT JOIN {src} a ON {on} AND a.t = tax.t)"""
    body = f"""SELECT t, {keys}, ROUND(anom, 6) AS anom, ROUND(x, 6) AS continuous_time, ROUND(rolled, 6) AS rolled,
       ROUND(REGR_INTERCEPT(anom, x) OVER p + REGR_SLOPE(anom, x) OVER p * x, 6) AS pred_ols
FROM (SELECT *, {DECYEAR} AS x, CASE WHEN COUNT(anom) OVER w = 51 THEN AVG(anom) OVER w END AS rolled
      FROM dn WINDOW w AS (PARTITION BY {keys} ORDER BY t ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING))
WHERE present WINDOW p AS (PARTITION BY {keys})"""
    return body, dense


PKEYS = "point_id, lat_idx, lon_idx"
PA = f"""pa AS (SELECT n.point_id, c.*,
       {R9("c.sst - AVG(c.sst) OVER (PARTITION BY n.point_id, c.lat_idx, c.lon_idx, MONTH(c.t))")} AS anom
FROM cube c JOIN near n USING (lat_idx, lon_idx))"""


def yearly(src: str, keys: str) -> list[str]:
    fl = f"fl AS (SELECT * FROM {flags_over(src, keys)})"
    return [fl, f"""ep AS (SELECT {", ".join("s." + k.strip() for k in keys.split(","))}, s.year, CAST(COALESCE(p.n, 0) AS BIGINT) AS n_extreme
FROM (SELECT {keys}, CAST(UNNEST(generate_series(MIN(year), MAX(year))) AS INTEGER) AS year FROM fl GROUP BY {keys}) s
LEFT JOIN (SELECT {keys}, year, SUM(flag) AS n FROM fl GROUP BY {keys}, year) p USING ({keys}, year))"""]


_body, _dense = series_report("pa", PKEYS)
sql("point_report_series", _body, POINTS, NEAREST, PA, TIME_AX, _dense)
sql("point_report_years", "SELECT * FROM ep", POINTS, NEAREST, PA, *yearly("pa", PKEYS))
sql("point_report_density", kde_out(PKEYS), POINTS, NEAREST, PA, *yearly("pa", PKEYS), *kde("0.35", PKEYS))
_body, _dense = series_report("an9", "lat_idx, lon_idx")
sql("cell_report_series", _body, AN9, TIME_AX, _dense)
sql("cell_report_density", kde_out(), AN9, *yearly("an9", "lat_idx, lon_idx"), *kde("0.35"))
sql("regional_series", _body, REFGRID, *REGION9, TIME_AX, _dense)

sql(
    "point_quantiles_propagate",
    "SELECT lat_idx, lon_idx, MIN(lat) AS lat, MIN(lon) AS lon, "
    + ", ".join(f"ROUND(CASE WHEN COUNT(anom) = COUNT(*) THEN QUANTILE_CONT(anom, {q}) END, 6) AS {n}" for q, n in ((0.05, "q05"), (0.10, "q10"), (0.90, "q90"), (0.95, "q95")))
    + " FROM an9 GROUP BY lat_idx, lon_idx",
    AN9,
)

sql(
    "region_yearly",
    """SELECT year, ROUND(mean, 6) AS mean, CAST(MIN(year) OVER () AS INTEGER) AS first_year,
       CAST(MAX(year) OVER () AS INTEGER) AS last_year
FROM (SELECT year, AVG(region_mean) AS mean FROM rs GROUP BY year)""",
    REGION,
)

sql(
    "mhw_events_ds",
    """SELECT d.year, d.lat_idx, d.lon_idx, bl.lat, bo.lon, ROUND(d.events, 6) AS events
FROM (SELECT year, CAST(lat_idx // 4 AS INTEGER) AS lat_idx, CAST(lon_idx // 4 AS INTEGER) AS lon_idx,
             AVG(events) AS events FROM events WHERE lat_idx < 4 AND lon_idx < 4 GROUP BY ALL) d
JOIN (SELECT CAST(lat_idx // 4 AS INTEGER) AS lat_idx, AVG(lat) AS lat
      FROM (SELECT DISTINCT lat_idx, lat FROM cube) WHERE lat_idx < 4 GROUP BY 1) bl USING (lat_idx)
JOIN (SELECT CAST(lon_idx // 4 AS INTEGER) AS lon_idx, AVG(lon) AS lon
      FROM (SELECT DISTINCT lon_idx, lon FROM cube) WHERE lon_idx < 4 GROUP BY 1) bo USING (lon_idx)""",
    *THR, EX, *MK, LAND, EVENTS,
)


# --- materialized map, weekly grid --------------------------------------------------------------------

SQL["materialize"] = SQL["map_float32"]

WEEKLY = """wk AS (SELECT CAST(DATE_TRUNC('week', t) AS DATE) AS t, lat_idx, lon_idx, MIN(lat) AS lat, MIN(lon) AS lon,
       ROUND(AVG(sst), 6) AS sst FROM cube GROUP BY CAST(DATE_TRUNC('week', t) AS DATE), lat_idx, lon_idx)"""

AN9W = f"""an9 AS (SELECT *, {MONTH} AS month,
       {R9("sst - AVG(sst) OVER (PARTITION BY lat_idx, lon_idx, MONTH(t))")} AS anom FROM wk)"""

sql(
    "rolling_mean_long",
    """SELECT t, ROUND(region_mean, 6) AS region_mean, CASE WHEN n = 1095 THEN ROUND(m, 6) END AS rolled
FROM (SELECT t, region_mean, COUNT(region_mean) OVER w AS n, AVG(region_mean) OVER w AS m FROM rs
      WINDOW w AS (ORDER BY t ROWS BETWEEN 547 PRECEDING AND 547 FOLLOWING))""",
    REGION,
)

sql("rolling_mean_weekly", ROLLED, WEEKLY, AN9W, TIME_AX.replace("FROM cube", "FROM wk"), DENSE_AN)

sql("cell_reports_weekly", report("lat_idx, lon_idx", flags_over("an9", "lat_idx, lon_idx")), WEEKLY, AN9W)

# --- frames, stores ---------------------------------------------------------------------------------------

sql(
    "frames",
    f"""SELECT tax.t, tax.time_idx, CAST(i AS INTEGER) AS lat_idx, CAST(j AS INTEGER) AS lon_idx,
       ROUND(CASE WHEN a.anom IS NOT NULL THEN LEAST(GREATEST(a.anom, lim.lo), lim.hi) END, 6) AS v
FROM tax CROSS JOIN range(6) r(i) CROSS JOIN range(4) s(j)
CROSS JOIN (SELECT QUANTILE_CONT(anom, 0.01) AS lo, QUANTILE_CONT(anom, 0.99) AS hi FROM an9) lim
LEFT JOIN an9 a ON a.t = tax.t AND a.lat_idx = i AND a.lon_idx = j WHERE tax.time_idx % 2 = 0""",
    AN9, TIME_AX,
)

sql("store_partitioned", f"SELECT {CUBE_COLS}, {YEAR} AS year FROM cube")
SQL["store_bucketed"] = SQL["cell_stats"]

# --- heatwaves at the reference's parameters: 2 x 2 blocks, quantile 0.9, five days -----------------------

WARM = """spell AS (SELECT t, lat_idx, lon_idx, lat, lon,
       CASE WHEN (YEAR(t) = 1994 AND DAYOFYEAR(t) BETWEEN 60 AND 79) OR (YEAR(t) = 1996 AND DAYOFYEAR(t) BETWEEN 200 AND 205)
            THEN sst + CAST(40.0 AS DOUBLE) ELSE sst END AS sst FROM cube)"""
BLOCKS = """blk AS (SELECT t, CAST(lat_idx // 2 AS INTEGER) AS lat_idx, CAST(lon_idx // 2 AS INTEGER) AS lon_idx, AVG(lat) AS lat, AVG(lon) AS lon,
       AVG(sst) AS sst FROM spell GROUP BY t, lat_idx // 2, lon_idx // 2)"""


def _of_blocks(cte: str) -> str:
    return cte.replace("FROM cube", "FROM blk").replace("0.75", "0.9")


DAYS_REF = f"""days AS (SELECT m.lat_idx, m.lon_idx, {YEAR} AS year,
       CASE WHEN MAX(l.land) THEN NULL ELSE CAST(SUM(CAST(mhw AS INTEGER)) AS BIGINT) END AS days
FROM mk m JOIN land l USING (lat_idx, lon_idx) GROUP BY m.lat_idx, m.lon_idx, {YEAR})"""

sql(
    "mhw_reference",
    "SELECT lat_idx, lon_idx, year, days, events FROM days JOIN events USING (lat_idx, lon_idx, year)",
    WARM, BLOCKS, *[_of_blocks(c) for c in (*THR, EX, *marked(5), LAND)], DAYS_REF, events(5),
)

# --- the grid whose cells grow with the table --------------------------------------------------------------

WIDE = """wide AS (SELECT CAST(DATE_TRUNC('month', l_shipdate) AS DATE) AS t, CAST(l_suppkey % 180 AS INTEGER) AS lat_idx,
       CAST(l_partkey % 360 AS INTEGER) AS lon_idx, CAST(l_suppkey % 180 AS DOUBLE) - CAST(89.5 AS DOUBLE) AS lat,
       CAST(l_partkey % 360 AS DOUBLE) + CAST(0.5 AS DOUBLE) AS lon,
       CAST(SUM(CAST(l_quantity AS BIGINT)) AS DOUBLE) * CAST(0.6 AS DOUBLE) / COUNT(*) AS sst FROM lineitem GROUP BY ALL)"""

sql(
    "wide_variability",
    """SELECT lat_idx, lon_idx, MIN(lat) AS lat, MIN(lon) AS lon, ROUND(AVG(sd), 6) AS variability
FROM m GROUP BY lat_idx, lon_idx""",
    WIDE, "m AS (" + MONTHLY.format(src="wide") + ")",
)

sql("wide_reports", report("lat_idx, lon_idx", flags_over("an9", "lat_idx, lon_idx")), WIDE, AN9W.replace("FROM wk", "FROM wide"))
