"""Sources and sinks: cube loading, decoding, stores, caches and test grids."""
