"""Independent SQL for every registered query, for DuckDB over the same Parquet tables."""
