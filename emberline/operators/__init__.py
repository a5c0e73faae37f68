"""Operators on DataFrames: statistics, flags, order, repair, detectors, ensembles."""
