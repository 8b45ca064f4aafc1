"""Landed payloads, stored tables, and series derived from the given tables."""
