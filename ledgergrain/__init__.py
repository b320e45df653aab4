"""Contract checks, join checks, business metrics, marts and run-event jobs as Spark DataFrames."""

__version__ = "0.1.0"
