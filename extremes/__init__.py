"""Extreme-value analysis of long timestamped records as Spark batch jobs."""
