"""DataFrame-level operators: gates, joins, windows, statistics, rasters, run comparison."""
