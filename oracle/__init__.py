"""DuckDB statements that the registered jobs are compared with."""
