"""Column-level helpers: null rules, dates, statistics."""
