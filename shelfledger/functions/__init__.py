"""Column-level helpers: null rules, rounding, text and periods."""
