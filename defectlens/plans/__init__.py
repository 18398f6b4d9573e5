"""Query plans: the named query registry, the DuckDB oracles, report entry points."""
