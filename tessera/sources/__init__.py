"""Readers and writers of corpora, judgments, conversations and code tables."""
