"""Structured Streaming forms of the sentence and scoring jobs."""
