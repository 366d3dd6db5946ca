"""Gridded analyses of scattered observations, as Spark jobs."""
