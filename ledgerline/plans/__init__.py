"""Query catalog: each module registers (key -> Spark query, DuckDB oracle text)."""
