"""Structured Streaming: sources, streaming operators and query lifecycle."""
