"""Column expressions (no jobs, no shuffles)."""
