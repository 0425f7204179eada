"""Actual-to-expected cohort analysis of policy-level in-force data on Spark."""

__version__ = "0.1.0"
