"""Driver queries: each operator over the driver's tables, next to its SQL."""
