"""Measuring the quality of tables and streams with Spark."""

__version__ = "0.1.0"
