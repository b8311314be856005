"""Operators for preparing training text: quality, deduplication, language, toxicity, tokens.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and returns a
DataFrame; ``queries`` holds the thin ``opN_<name>`` wrappers.
"""
