"""Queries over whole tables, with their SQL."""
