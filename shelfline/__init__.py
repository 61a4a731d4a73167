"""Retail analytics jobs on Spark: marts, basket affinity, live figures, stream ingest and lookups."""

__version__ = "0.1.0"
