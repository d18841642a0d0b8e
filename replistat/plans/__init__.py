"""Compositions of operators into whole analyses (growth, density, run comparison)."""
