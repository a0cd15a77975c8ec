"""Structured Streaming jobs: backup passes, request listener, sample windows."""
