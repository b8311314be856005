"""Column functions: statistics over counts, text helpers, deterministic hashing."""
