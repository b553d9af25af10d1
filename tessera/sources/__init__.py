"""Readers, record normalization and writers."""
