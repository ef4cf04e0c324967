"""Column-expression helpers (conversions, text forms, JSON paths)."""
