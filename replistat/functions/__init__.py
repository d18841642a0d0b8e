"""Column-level functions: names, geometry, calibration, labels."""
