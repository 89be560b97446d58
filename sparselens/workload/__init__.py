"""Queries over the benchmark tables and the SQL they are checked against."""
