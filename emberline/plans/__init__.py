"""Detector registry, full plans, and the queries with their SQL."""
