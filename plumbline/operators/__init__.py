"""Checks, suites, profiles, anomalies, run history and alerts on DataFrames."""
