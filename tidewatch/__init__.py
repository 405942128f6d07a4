"""Tidewatch: trend analytics over timestamped posts, written as Spark DataFrame jobs."""

__version__ = "0.1.0"
