"""Cohort preparation and corpus curation on Spark DataFrames."""

__version__ = "0.1.0"
