"""A relational analytics engine on PySpark: a compact, strictly typed SQL dialect planned onto Catalyst."""
