"""Functions with PostgreSQL meaning."""
