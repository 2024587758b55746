"""Query registry and DuckDB oracles."""
