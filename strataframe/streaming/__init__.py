"""Incremental state: batch forms and Structured Streaming forms of the same rules."""
