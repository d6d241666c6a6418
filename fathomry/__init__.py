"""Spark-first analytics: loan features, scan reports, telemetry and image corpora."""

__version__ = "0.1.0"
