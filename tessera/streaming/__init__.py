"""Incremental versions of the count-based operators."""
