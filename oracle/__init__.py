"""DuckDB statements that state each registered query independently of the Spark code."""
