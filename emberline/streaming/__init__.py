"""Scoring of streams with pinned parameters (an extension)."""
