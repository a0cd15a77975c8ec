"""DataFrame operators: ordered windows, interval and as-of joins, frequencies, integrity checks."""
