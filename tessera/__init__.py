"""Concept analytics on pairwise preference data, as Spark DataFrame operations."""
