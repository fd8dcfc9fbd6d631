"""Named queries (one per operator of the blueprint) and their DuckDB oracles."""
