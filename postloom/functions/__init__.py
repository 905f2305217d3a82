"""Column rules: each takes Columns and returns a Column, so it stays inside the Spark plan."""
