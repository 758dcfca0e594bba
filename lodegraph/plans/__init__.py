"""Registered queries with their DuckDB oracles."""
