"""Readers for telemetry, metric series, cycle packages and their documents."""
