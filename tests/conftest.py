import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from thermocline.session import local_session

    s = local_session(cores=4, shuffle_partitions=4, app="thermocline-tests")
    yield s
    s.stop()


def make_cube(spark, rows, lat0=10.0, lon0=100.0, dlat=1.0, dlon=1.0):
    """rows: (date, lat_idx, lon_idx, sst) -> cube with labels from the indices."""
    data = [(d, int(i), int(j), lat0 + dlat * i, lon0 + dlon * j, None if v is None else float(v)) for d, i, j, v in rows]
    return spark.createDataFrame(data, "t date, lat_idx int, lon_idx int, lat double, lon double, sst double")


def days(start, n):
    d0 = dt.date.fromisoformat(start) if isinstance(start, str) else start
    return [d0 + dt.timedelta(days=k) for k in range(n)]
