"""Column lineage for SQL statements, computed with Spark DataFrames."""
