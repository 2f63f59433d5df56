"""thermocline — gridded climate time series as long Spark tables.

A cube is a DataFrame with one row per grid cell and time step::

    t: date | timestamp_ntz, lat_idx: int, lon_idx: int, lat: double, lon: double, sst: double

``(lat_idx, lon_idx)`` is the cell key and the partition key of every series
operator; ``lat`` / ``lon`` are carried along as labels.  NULL means missing.
"""

from thermocline.model import CELL, normalize_cube  # noqa: F401

__all__ = ["CELL", "normalize_cube"]
