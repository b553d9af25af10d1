"""Structured Streaming forms of resume, pairing and running counters."""
