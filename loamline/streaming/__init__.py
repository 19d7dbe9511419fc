"""Structured Streaming entry points for operators that are local to a document."""
