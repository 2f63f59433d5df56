"""DataFrame -> DataFrame operators over long cubes ``(t, lat_idx, lon_idx, lat, lon, sst)``."""
