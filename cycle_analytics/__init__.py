"""Backup-cycle and telemetry analytics as PySpark DataFrame and Structured Streaming jobs."""

__version__ = "0.1.0"
