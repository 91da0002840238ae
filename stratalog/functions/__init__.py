"""Column expressions with SQLite's meaning."""
