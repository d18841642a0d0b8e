"""Incremental work: process only inputs whose content and parameters are new."""
