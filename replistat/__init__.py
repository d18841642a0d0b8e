"""Replicate-aware measurement analytics as plain DataFrame functions on Apache Spark."""

__version__ = "0.1.0"
